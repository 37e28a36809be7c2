"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

Documents longer than the capacity are cut into pieces of the capacity; the first piece takes the remainder.  The
histogram of piece lengths (at most ``capacity`` numbers) is all that reaches the driver:

1. Multiplicative weights solve the covering program ``min sum x_p`` with ``sum_p a(p, l) x_p >= n_l``.  A length that
   is already covered weighs little; knapsack dynamic programming prices patterns, and one table gives, for every
   length, the best pattern that holds it.
2. The amounts, largest first, are rounded down to whole sequences, up to ``1 - SPARE`` of every length.
3. What rounding leaves is placed best-fit decreasing on groups of equal sequences, so this also costs time by the
   number of lengths, not of pieces.

Pieces then find their sequence by their distributed rank among the pieces of their length.  Null texts count as empty
and take one token, the end mark.  Whole texts are tokenized, however long.  Pieces of one length are ranked by id, then
piece; ties, as of repeated rows, are packed once each in any order.  An empty table gives an empty result.  Only id and
text are read, whatever other columns are called.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm.common import arrow_map, materialize, rank_in_groups

#: Rounds at most, the coverage that one adds at most, and how near fillers must be to count as equal.
ROUNDS = 120
STEP = 0.25
TIE = 0.01
#: The part of every length that rounding leaves to best fit, which closes gaps only while it has pieces of all lengths.
SPARE = 0.2


def price(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value and the length to take first (0: leave one token empty) for every room."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    lengths = np.flatnonzero(values > 0)
    worth = values[lengths]
    for room in range(1, capacity + 1):
        fits = np.searchsorted(lengths, room, "right")
        best[room] = best[room - 1]
        if fits:
            found = best[room - lengths[:fits]] + worth[:fits]
            k = int(found.argmax())
            if found[k] > best[room]:
                best[room], take[room] = found[k], lengths[k]
    return best, take


def solve_lp(demand: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP) -> dict[tuple[int, ...], float]:
    """Patterns and fractional amounts by multiplicative weights, on average covering every demand once.

    A round prices lengths at their share of the capacity times exp(-coverage / step) and takes, for every length whose
    best pattern is within ``TIE`` of the optimum, that pattern; among fillers of equal worth the draw is random but
    seeded.  Amounts are scaled so that a round covers no length by more than ``step``.
    """
    lengths = np.flatnonzero(demand)
    covered = np.zeros(capacity + 1)
    found: dict[tuple[int, ...], float] = {}
    draw = np.random.default_rng(0)
    for _ in range(rounds):
        if not len(lengths) or covered[lengths].mean() >= 1:
            break
        values = np.zeros(capacity + 1)
        values[lengths] = np.exp((covered[lengths].min() - covered[lengths]) / step) * lengths / capacity
        best, _ = price(values, capacity)
        plan: dict[tuple[int, ...], float] = {}
        worth = values[lengths] + best[capacity - lengths]
        for k in lengths[worth >= (1 - TIE) * worth.max()]:
            pattern, room = [int(k)], capacity - int(k)
            while best[room] > 0:
                fits = lengths[: np.searchsorted(lengths, room, "right")]
                near = fits[values[fits] + best[room - fits] >= best[room] * (1 - TIE)]
                pattern.append(int(near[int(draw.integers(len(near)))]))
                room -= pattern[-1]
            key = tuple(sorted(pattern, reverse=True))
            plan[key] = max(plan.get(key, 0.0), demand[k] / pattern.count(int(k)))
        more = np.zeros(capacity + 1)
        for pattern, x in plan.items():
            for k in pattern:
                more[k] += x / demand[k]
        scale = step / more.max()
        covered += more * scale
        for pattern, x in plan.items():
            found[pattern] = found.get(pattern, 0.0) + x * scale
    return {p: x / covered[lengths].mean() for p, x in found.items()}


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: groups of sequences that hold the same lengths."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for k in range(capacity, 0, -1):
        count = int(left[k])
        room = k
        while count and room <= capacity:
            groups = by_room.get(room)
            if not groups:
                room += 1
                continue
            pattern, many = groups.pop()
            fit = room // k
            whole = min(many, count // fit)
            if whole:
                by_room.setdefault(room - fit * k, []).append((pattern + (k,) * fit, whole))
                count -= whole * fit
            if whole < many:
                part = count if count < fit else 0
                if part:
                    by_room.setdefault(room - part * k, []).append((pattern + (k,) * part, 1))
                    count = 0
                rest = many - whole - bool(part)
                if rest:
                    groups.append((pattern, rest))
        if count:
            fit = capacity // k
            for size, many in ((fit, count // fit), (count % fit, 1)):
                if size and many:
                    by_room.setdefault(capacity - size * k, []).append(((k,) * size, many))
    return [x for groups in by_room.values() for x in groups]


def plan_sequences(demand: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how many sequences follow each; every piece of the histogram has its place."""
    left = demand.astype(np.int64).copy()
    plan = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    spare = np.ceil(left * SPARE).astype(np.int64)
    for pattern, x in sorted(solve_lp(left, capacity).items(), key=lambda p: (-p[1], p[0])):
        if whole := int(min([x, *((left[k] - spare[k]) // pattern.count(k) for k in set(pattern))])):
            plan.append((pattern, whole))
            for k in pattern:
                left[k] -= whole
    return plan + best_fit(left, capacity)


def intervals(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, copies a sequence, offset of the first copy)."""
    used, rows, sequence = [0] * (capacity + 1), [], 0
    for pattern, many in plan:
        offset = 0
        for k in sorted(set(pattern), reverse=True):
            copies = pattern.count(k)
            rows.append((k, used[k], used[k] + many * copies, sequence, copies, offset))
            used[k] += many * copies
            offset += copies * k
        sequence += many
    return rows


def cut_pieces(docs: DataFrame, encode, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id_col, piece, start, length, ids_crc32.  ``encode`` maps a text to unsigned 32-bit ids."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    last = np.array([end_id], dtype="<u4")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encode(text.as_py() or ""), last]).astype("<u4", copy=False)
                first = (len(ids) - 1) % capacity + 1
                ends = range(first, len(ids) + 1, capacity)
                for piece, end in enumerate(ends):
                    start = 0 if piece == 0 else end - capacity
                    for column, value in zip(out, (doc, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], names=[id_col, "piece", "start", "length", "ids_crc32"])

    return arrow_map(docs.select(id_col, text_col), run, schema)


def pack(pieces: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to pieces (id_col, piece, length <= capacity)."""
    import pyarrow as pa

    spark = pieces.sparkSession
    demand = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        demand[length] = n
    rows = intervals(plan_sequences(demand, capacity), capacity)
    names = ["_length", "_first", "_end", "_sequence", "_copies", "_offset"]
    # From Arrow the JVM reads it; rows of Python would start a second family of Python workers, which stay, in every executor.
    plan = spark.createDataFrame(pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(names)}), ", ".join(f"{c} long" for c in names))
    ranked = rank_in_groups(pieces, ["length"], [F.col(id_col), F.col("piece")], "_rank", F.xxhash64(id_col, "piece"), 128)
    # The plan's size follows the number of lengths (at most ``capacity``), not of pieces.
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    at = F.col("_rank") - F.col("_first")
    return placed.withColumn("sequence_id", F.col("_sequence") + F.floor(at / F.col("_copies")).cast("long")).withColumn("offset", F.col("_offset") + at % F.col("_copies") * F.col("length")).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenize, cut and pack whole documents."""
    import public_tokenizers as P

    from kvlake.llm.tokens import encode_ids

    json_path, ranks_path, pattern = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    pieces = cut_pieces(docs, lambda text: encode_ids(text, json_path, ranks_path, pattern), capacity, end_id)
    return pack(materialize(pieces, "pack-pieces"), capacity)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    from kvlake.llm.common import table

    return pack_documents(table(spark, sf_dir, "documents"))
