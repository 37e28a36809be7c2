"""Memory beside the JVM's: what Python workers hold at once, and which of them are started."""

import random
import tracemalloc

import numpy as np
import pytest

MB = 1 << 20


@pytest.fixture(scope="module")
def batch():
    """The texts of an Arrow batch of 4 MB."""
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(2, 10))) for _ in range(5000)]
    return [" ".join(draw.choices(words, k=draw.randrange(50, 600))) for _ in range(2000)]


def peak(run) -> float:
    """MB that ``run`` holds at most, as far as Python and numpy know."""
    run_once = iter(run)
    tracemalloc.start()
    for _ in run_once:
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / MB


def test_statistics_of_a_batch(batch):
    from kvlake.llm.quality import statistics

    assert 3.5 < sum(map(len, batch)) / MB < 5
    assert peak(statistics(batch[i:]) for i in (0,)) < 30


def test_labels_of_a_batch(batch):
    from kvlake.llm.language import BUCKETS, SCRIPTS, LanguageModel

    draw = np.random.default_rng(0)
    tables = [draw.normal(-9, 1, (4, BUCKETS)).astype(np.float32) for _ in range(2)]
    assert peak(LanguageModel(list("abcd"), *tables, np.ones((4, len(SCRIPTS)), bool)).label(batch)) < 50


def test_shingles_of_a_batch(batch):
    from kvlake.llm.shingles import shingle_sets

    assert peak(shingle_sets(batch, 5)) < 25


def test_counted_cells():
    """All hashes count, wherever the buffer ends, and no copies of its size are made."""
    from kvlake.llm.jaccard_join import CELL, HELD, counted_cells, unpacked_small

    def sets(many):
        draw = np.random.default_rng(1)
        yield np.empty(0, np.uint64)
        for _ in range(many):
            yield np.unique(draw.integers(0, 2**40, 9000, dtype=np.uint64) * np.uint64(1 << 24))

    values, counts = np.unique(np.concatenate(list(sets(30))) >> np.uint64(64 - 22), return_counts=True)
    want = dict(zip(values.tolist(), counts.tolist(), strict=True))
    for held in (HELD, 1000, 20_001):
        found = dict.fromkeys(want, 0)
        for rows in counted_cells(sets(30), 22, held):
            for cell, counters, numbers in rows:
                at = np.cumsum(unpacked_small(counters), dtype=np.int64) + (cell << CELL)
                for k, n in zip(at.tolist(), unpacked_small(numbers).tolist(), strict=True):
                    found[k] += n
        assert found == want
    assert peak(counted_cells(sets(HELD // 9000 + 2), 27)) < 2 * 8 * HELD / MB
    assert list(counted_cells(iter([]), 22)) == []


def test_packing_plan_starts_no_other_workers(spark):
    """Rows of Python would be an RDD, for which every executor starts workers beside those of mapInArrow."""
    from kvlake.llm.packing import pack

    pieces = spark.range(50).selectExpr("id as doc_id", "0 as piece", "id % 7 + 1 as length")
    out = pack(pieces, 16)
    assert "ExistingRDD" not in out._jdf.queryExecution().simpleString()
    placed = sorted((r["sequence_id"], r["offset"], r["length"]) for r in out.collect())
    assert len(placed) == 50
    for (s, o, n), (t, p, _) in zip(placed, placed[1:]):
        assert p == (o + n if s == t else 0) and o + n <= 16


def test_overlaps_take_one_worker_a_task(spark):
    """Fragments are picked without Python: two maps in a task would hold two workers, and those stay for later stages."""
    from kvlake.llm.jaccard_join import Join

    part = np.arange(5, dtype=np.uint64).tobytes()
    cut = spark.createDataFrame([(i, i, f, part) for i in range(4) for f in (1, 2)], "node long, s1 long, f int, part binary")
    pairs = spark.sql("select 0L a, 1L b, 0L sa, 1L sb")
    sides = [Join.only(cut, pairs.selectExpr(f"{i} as node")) for i in "ab"]
    assert [sorted(r["node"] for r in side.collect()) for side in sides] == [[0, 0], [1, 1]]
    out = Join.partial(pairs, *sides)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert [tuple(r) for r in out.collect()] == [(0, 1, 5, 5, 5)] * 2
