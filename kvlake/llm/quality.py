"""Document quality: random Fourier features of document statistics, ridge scores, isotonic calibration.

One pass over the texts turns each document into a few statistics that don't depend on its language (shares of character
classes, repetition of words, word pairs and lines, lengths).  Random Fourier features approximate a Gaussian kernel on
the standardised statistics; their normal equations are summed over partitions by Spark and solved on the driver (their
size is fixed).  A part of the training rows, chosen by the caller, calibrates: scores are counted in BINS bins, and the
pool-adjacent-violators rule on the bins gives a rising map to probabilities, linear between its steps.

Labels, languages, sources and ids are never inputs.  Null and empty texts have statistics of zero and get a score as
any other.  Whole texts are read, however long; of a text only its statistics stay in memory.  Rows without a label (null,
or neither 0 nor 1) don't train; repeated rows and repeated labels count each.  Equal raw scores get equal scores.
Without training rows every score is 0.5; an empty table gives an empty result.  Only id and text are read, and of the
labels only id and quality, whatever other columns are called; ``keep_good`` returns all columns of the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.llm.common import arrow_map
from kvlake.llm.shingles import Words, chunks, mix

#: Random features, width of the kernel in standard deviations, ridge penalty per row, bins of the calibration.
FEATURES, WIDTH, RIDGE, BINS = 256, 4.0, 1e-4, 2000
LOW, HIGH = -0.5, 1.5

# Character classes, by byte.
_CLASS = np.full(256, 9, dtype=np.uint8)
_CLASS[[*b" \t"]] = 0
_CLASS[[*b"\r\n\x0b\x0c"]] = 1
_CLASS[[*range(ord("A"), ord("Z") + 1)]] = 2
_CLASS[[*range(ord("a"), ord("z") + 1)]] = 3
_CLASS[[*b"0123456789"]] = 4
_CLASS[[*b".,"]] = 5
_CLASS[[*b"!?"]] = 6
_CLASS[[*b"#$%&*@^~=|<>{}[]\\_+/"]] = 7
_CLASS[0xC0:] = 8
_CLASS[0x80:0xC0] = 10
COUNT = 24


def statistics(texts: list[str | None]) -> np.ndarray:
    """COUNT numbers for each text."""
    parts = [_statistics(chunk) for chunk in chunks((t or "").encode() for t in texts)]
    return np.concatenate(parts) if parts else np.empty((0, COUNT))


def _by_text(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of values between begins; empty ranges give 0."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[begins[1:]] - sums[begins[:-1]]


def _statistics(texts: list[bytes]) -> np.ndarray:
    w = Words(texts)
    kinds = _CLASS[w.buffer]
    edges = np.concatenate([[0], w.ends_of_text])
    byte = np.stack([_by_text(kinds == k, edges) for k in range(10)], axis=1).astype(float)
    byte[:, 0] -= 1  # the separator
    chars = np.maximum(byte.sum(axis=1), 1)
    letters = np.maximum(byte[:, 2] + byte[:, 3] + byte[:, 8], 1)
    count = np.diff(w.begins)
    words = np.maximum(count, 1)
    out = [np.log1p(chars), np.log1p(count), *(byte[:, k] / chars for k in range(10)), byte[:, 2] / letters]
    if len(w.starts):
        stops = w.starts + w.lengths
        uppers, lowers = (np.concatenate([[0], np.cumsum(kinds == k)]) for k in (2, 3))
        shout = (uppers[stops] - uppers[w.starts] >= 2) & (lowers[stops] == lowers[w.starts])
        last = kinds[stops - 1]
        same = np.zeros(len(w.starts), dtype=bool)
        same[1:] = w.hashes[1:] == w.hashes[:-1]
        same[w.begins[:-1][count > 0]] = False
        out += [_by_text(x, w.begins) / words for x in (shout, last == 7, last == 6, last == 5, same, w.lengths, w.lengths > 20)]
        pairs = mix(w.hashes[:-1] * np.uint64(3) + w.hashes[1:])
    else:
        out += [np.zeros(len(texts))] * 7
        pairs = w.hashes
    one, most, two, lines = (np.zeros(len(texts)) for _ in range(4))
    for i, (a, b) in enumerate(zip(w.begins[:-1].tolist(), w.begins[1:].tolist(), strict=True)):
        if b > a:
            ordered = np.sort(w.hashes[a:b])
            steps = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
            one[i], most[i] = (len(steps) - 1) / (b - a), np.diff(steps).max() / (b - a)
        if b - a > 1:
            ordered = np.sort(pairs[a : b - 1])
            two[i] = (1 + np.count_nonzero(ordered[1:] != ordered[:-1])) / (b - a - 1)
        rows = texts[i].split(b"\n")
        lines[i] = len(set(rows)) / len(rows)
    return np.stack([*out, one, most, two, lines], axis=1)


def describe(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and ``stats``, the statistics of every text."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", stats array<float>"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = statistics(batch.column(len(keep)).to_pylist()).astype(np.float32)
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * COUNT)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], names=[*keep, "stats"])

    return arrow_map(docs.select(*keep, text_col), run, schema)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def plane(count: int = COUNT) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.default_rng(11)
        return draw.normal(0, 1 / WIDTH, (count, FEATURES)), draw.uniform(0, 2 * np.pi, FEATURES)

    def lift(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features, the standardised statistics themselves and a constant."""
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        w, b = self.plane(stats.shape[1])
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(x @ w + b), x, np.ones((len(x), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.knots), 0, 1)


def isotonic(x: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and means of the pooled blocks."""
    blocks: list[list[float]] = []
    for at, n, y in zip(x, total, ones, strict=True):
        blocks.append([at * n, n, y])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    # One pseudo-row on either side keeps the ends off 0 and 1, so that scores still rise there.
    ends = [(LOW, (blocks[0][2]) / (blocks[0][1] + 1)), *((b[0] / b[1], (b[2] + 0.5 * b[2] / b[1]) / (b[1] + 0.5)) for b in blocks), (HIGH, (blocks[-1][2] + 1) / (blocks[-1][1] + 1))]
    return np.array([e[0] for e in ends]), np.array([e[1] for e in ends])


def fit(rows: DataFrame, calibrates: Column) -> QualityModel:
    """rows: stats and label (0, 1 or null).  Rows for which ``calibrates`` holds calibrate, the others give the weights."""
    known = rows.where(F.col("label").isin(0, 1)).select("stats", F.col("label").cast("double").alias("label"), F.coalesce(calibrates, F.lit(False)).alias("later"))
    model = QualityModel(np.zeros(COUNT), np.ones(COUNT), np.zeros(COUNT + FEATURES + 1), (np.array([LOW, HIGH]), np.array([0.5, 0.5])))
    sums = known.where("not later").select(F.posexplode("stats").alias("k", "x")).groupBy("k").agg(F.count("x"), F.avg("x"), F.stddev_pop("x")).collect()
    if not sums:
        return model
    for k, _, mean, deviation in sums:
        model.mean[k], model.scale[k] = mean, deviation if deviation > 1e-9 else 1.0
    size = COUNT + FEATURES + 2

    def normal(batches):
        import pyarrow as pa

        total = np.zeros((size, size))
        for batch in batches:
            z = np.concatenate([model.lift(_matrix(batch.column(0))), batch.column(1).to_numpy()[:, None]], axis=1)
            total += z.T @ z
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array((i * size + j).astype(np.int32)), pa.array(total[i, j])], names=["cell", "x"])

    total = np.zeros((size, size))
    # Each partition sends one fixed-size matrix; Spark sums the cells.
    for cell, x in arrow_map(known.where("not later").select("stats", "label"), normal, "cell int, x double").groupBy("cell").agg(F.sum("x")).collect():
        total[cell // size, cell % size] = total[cell % size, cell // size] = x
    left, right = total[:-1, :-1], total[:-1, -1]
    penalty = RIDGE * left[-1, -1] * np.eye(size - 1)
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(left + penalty, right)

    def bins(batches):
        import pyarrow as pa

        for batch in batches:
            at = np.clip((model.raw(_matrix(batch.column(0))) - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["bin", "label"])

    counted = arrow_map(known.where("later").select("stats", "label"), bins, "bin int, label double").groupBy("bin").agg(F.count("label").alias("n"), F.sum("label").alias("ones")).orderBy("bin").collect()
    if counted:
        x = LOW + (np.array([r["bin"] for r in counted]) + 0.5) * (HIGH - LOW) / BINS
        model.knots = isotonic(x, np.array([float(r["n"]) for r in counted]), np.array([r["ones"] for r in counted]))
    else:
        model.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def score(rows: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and the score of each row's statistics."""
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", score double"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(model.score(_matrix(batch.column(len(keep)))), pa.float64())], names=[*keep, "score"])

    return arrow_map(rows.select(*keep, "stats"), run, schema)


def fold(column: str, parts: int) -> Column:
    """crc32 of the number's decimal text, modulo parts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


#: A document is kept from this score on.
KEEP_FROM = 0.3


def fit_on(rows: DataFrame, labels: DataFrame) -> QualityModel:
    """Rows of remainder 0 never train; remainder 1 calibrates, 2 to 4 give the weights."""
    labelled = rows.join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id")
    part = fold("doc_id", 5)
    return fit(labelled.where(part != 0), part == 1)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, whose score reaches KEEP_FROM; texts are read twice and never moved."""
    from kvlake.llm.common import materialize

    model = fit_on(materialize(describe(docs, ["doc_id"]), "quality-stats"), labels)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = statistics(batch.column(at).to_pylist()).astype(np.float32).astype(float)
            yield batch.filter(pa.array(model.score(found) >= KEEP_FROM))

    return arrow_map(docs, run, docs.schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    from kvlake.llm.common import materialize, table

    rows = materialize(describe(table(spark, sf_dir, "documents"), ["doc_id"]), "quality-stats")
    out = score(rows, fit_on(rows, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
