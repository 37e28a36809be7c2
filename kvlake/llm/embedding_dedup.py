"""Exact near-duplicate vectors by int8 tile products with error bounds.

Equal vectors become one with a count.  Distinct ones of the same dimension are dealt to tiles; each pair of tiles is one
task.  There every normalised vector x is rounded to ``s * q`` with q of int8 and its rounding error ``r = |x - s q|`` is
measured, so ``x.y`` differs from ``s t q.p`` by at most ``r_x + (1 + r_x) r_y``.  Products of int8 values are summed
exactly (float32 holds them below 2^24; longer vectors go by slices).  Only pairs whose bound reaches the threshold are
computed again, in double precision from the input.  A task returns, for each vector, its number of links and the root of
its component inside the task, never the pairs, so its output is no longer than its input.

Comparing all pairs is quadratic in the distinct vectors; the tiles make it parallel and give each vector
``vectors / TILE`` copies to move, they don't make it less.

Null or zero vectors and those with null or non-finite components link with nothing and are their own component.
Repeated rows are copies.  Vectors of different dimension are never compared.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm.common import materialize, ship
from kvlake.llm.components import components

TILE = 4096
#: Rows of a tile multiplied at once.
SLAB = 512


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (as float32), scale and rounding error of each row of unit length."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    # The slack covers the arithmetic of the bound itself.
    return q.astype(np.float32), scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1)) + 1e-12


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def product(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    if q.shape[1] <= 1024:
        return q @ p.T
    return sum((q[:, i : i + 1024] @ p[:, i : i + 1024].T).astype(np.float64) for i in range(0, q.shape[1], 1024))


def links_between(x: np.ndarray, y: np.ndarray | None, threshold: float):
    """Index pairs of x and y (None: of x with itself, once each) with cosine >= threshold, slab by slab."""
    own = y is None
    u = unit(x)
    q, s, r = quantise(u)
    v, p, t, w = (u, q, s, r) if own else ((z := unit(y)), *quantise(z))
    for at in range(0, len(q), SLAB):
        rows = slice(at, at + SLAB)
        sums = product(q[rows], p)
        slack = r[rows].max() + (1 + r[rows].max()) * w.max()
        least = (threshold - 1e-9 - slack) / (s[rows].max() * t.max())
        a, b = np.divmod(np.flatnonzero(sums.ravel() >= least), len(p))
        near = sums[a, b] * (s[a + at] * t[b]) + r[a + at] + (1 + r[a + at]) * w[b] >= threshold - 1e-9
        a, b = a[near] + at, b[near]
        if own:
            a, b = a[a < b], b[a < b]
        for i in range(0, len(a), 65536):
            c, d = a[i : i + 65536], b[i : i + 65536]
            sure = np.einsum("ij,ij->i", u[c], v[d]) >= threshold
            yield c[sure], d[sure]


def local_roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of n nodes reaches."""
    label = np.arange(n)
    if not pairs:
        return label
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]
    return label


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """id_col, n_links (other rows with cosine >= threshold), component_id and kept (the component's own row)."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(good, F.col("v")))
    once = materialize(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")
    tiles = max(1, -(-once.count() // tile))
    placed = once.withColumn("dim", F.size("v")).withColumn("tile", F.pmod(F.xxhash64("rep"), F.lit(tiles)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(tiles - 1))
    tasks = placed.withColumn("task", F.explode(F.transform(every, lambda o: F.least(o, F.col("tile")) * tiles + F.greatest(o, F.col("tile")))))

    def run(table):
        import pyarrow as pa

        task = table.column("task")[0].as_py()
        part = table.column("tile").to_numpy()
        ids, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        i, j = divmod(task, tiles)
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        pairs = []
        if len(left) and len(right):
            for a, b in links_between(x[left], None if i == j else x[right], threshold):
                pairs.append((left[a], right[b]))
        counts = np.zeros(len(ids), dtype=np.int64)
        for a, b in pairs:
            np.add.at(counts, a, copies[b])
            np.add.at(counts, b, copies[a])
        linked = np.flatnonzero(counts)
        roots = local_roots(len(ids), pairs)
        return pa.table({"rep": pa.array(ids[linked]), "root": pa.array(ids[roots[linked]]), "links": pa.array(counts[linked])})

    id_type = vectors.schema[id_col].dataType.simpleString()
    found = materialize(tasks.groupBy("dim", "task").applyInArrow(run, f"rep {id_type}, root {id_type}, links long"), "vector-links")
    component = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = once.join(links, "rep", "left").join(component, F.col("rep") == F.col("node"), "left").select("v", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(known, "v", "left")
    own = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    from kvlake.llm.common import table

    return near_vectors(table(spark, sf_dir, "embeddings"), 0.95)
