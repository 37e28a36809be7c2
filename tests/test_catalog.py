import pathlib

import pytest

from kvlake.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(map(str, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    import duckdb

    found = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert len(found)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(found) == rows(con.execute(ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["key", "value", "lsn"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables")
def test_crc_roundtrip_covers_all_records(spark):
    from kvlake.functions.codec import encode_log
    from kvlake.plans.adapters import events_kv

    frames = {r["lsn"]: encode_log(r["key"].encode(), None if r["value"] is None else r["value"].encode()) for r in events_kv(spark, SF).collect()}
    found = {r["lsn"]: r for r in QUERIES["crc_roundtrip"](spark, SF).collect()}
    assert set(found) == set(frames) and {r["op"] for r in found.values()} == {1, 2}
    for lsn, frame in frames.items():
        r = found[lsn]
        assert r["valid"] and r["crc"] == r["decoded_crc"] == int.from_bytes(frame[:4], "little") and r["size"] == len(frame)


def test_frames_are_verified(spark):
    from pyspark.sql import functions as F

    from kvlake.functions.codec import encode_log
    from kvlake.functions.expressions import log_frame, read_log_frame

    rows = [(1, b"k\xff", b"v"), (1, b"", b""), (2, b"key", None)]
    good = [bytes(r[0]) for r in spark.createDataFrame(rows, "op int, key binary, value binary").select(log_frame(F.col("op"), F.col("key"), F.col("value"))).collect()]
    assert good == [encode_log(k, None if op == 2 else v) for op, k, v in rows]
    bad = [good[0][:-1] + b"w", good[0][:-1], good[0] + b"x", b"", b"\x00" * 11]
    read = [r[0] for r in spark.createDataFrame([(f,) for f in good + bad], "frame binary").select(read_log_frame(F.col("frame"))).collect()]
    assert [(r["op"], bytes(r["key"]), r["value"] and bytes(r["value"])) for r in read[:3]] == [(1, b"k\xff", b"v"), (1, b"", b""), (2, b"key", None)]
    assert all(r["crc"] == r["computed"] for r in read[:3]) and read[3]["crc"] != read[3]["computed"] and read[4:] == [None] * 4


@pytest.mark.parametrize("chunk", [1 << 20, 50, 2])
def test_blocks_and_prefixes_follow_the_order_of_keys(spark, tmp_path, monkeypatch, chunk):
    """User numbers of five and more digits, whose order as keys isn't that of the numbers."""
    import random

    import duckdb

    from kvlake.operators import stats
    from kvlake.sources.segments import prefix_compression

    draw = random.Random(1)
    users = [99_999, 100_000, 10_000, 10_001, *(draw.randrange(10 ** draw.randrange(1, 8)) for _ in range(400))]
    events = spark.createDataFrame([(i, u, "click", "v" * draw.randrange(200)) for i, u in enumerate(users)], "event_id long, user_id long, event_type string, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(stats.running_offset_by_key, "__defaults__", (chunk,))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert rows(QUERIES["block_index"](spark, str(tmp_path)).toPandas()) == rows(con.execute(ORACLE_SQL["block_index"]).df())
    keys = sorted({f"user:{u:05d}" for u in users} | {"é", "ab", "abc", "z"})
    shared = sum(next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(keys, keys[1:]))
    found = prefix_compression(spark.createDataFrame([(k,) for k in keys], "key string"), chunk).first()
    assert tuple(found) == (shared, sum(map(len, keys)) - shared)
