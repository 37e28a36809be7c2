"""The named queries of the engine and, beside each, the SQL that must give the same rows.

Unless named otherwise they run on the change log of ``events`` (see adapters).
"""

from __future__ import annotations

import functools
import shutil
import tempfile
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.functions.expressions import log_frame, read_log_frame
from kvlake.operators import bloom, resolve, scan, stats
from kvlake.plans.adapters import conversations_kv, events_kv, events_of, orders_kv
from kvlake.schema import PUT
from kvlake.sources.files import closed, decode_files, encode_files, encode_segments, get_in_segments, with_lsn
from kvlake.sources.logs import ChangeLog, IndexedLog
from kvlake.sources.segments import KVTable, prefix_compression
from kvlake.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PROBES = ["user:00001", "user:00005", "user:00042", "user:99999"]
START, END, PREFIX, TARGET = "user:00010", "user:00031", "user:0001", "user:00033"
REPLAY_TO, TRUNCATE_AT, BATCH, BLOCK = 5000, 2001, 1024, 4096
LAYERS = (3000, 6000)

_KV = """WITH kv AS (SELECT printf('user:%05d', user_id) AS key, event_id + 1 AS lsn, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op,
 CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value FROM events),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS rn FROM kv), latest AS (SELECT key, lsn, op, value FROM ranked WHERE rn = 1),
 sized AS (SELECT *, CAST(12 + strlen(key) + CASE WHEN op = 2 THEN 11 ELSE strlen(value) END AS BIGINT) AS size FROM kv),
 placed AS (SELECT *, CAST(coalesce(sum(size) OVER (ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM sized),
 probes AS (SELECT unnest(['user:00001', 'user:00005', 'user:00042', 'user:99999']) AS key) """


def query(sql: str | None, base: str = _KV):
    """Register a query of (spark, sf_dir), its name, and the SQL after the common table expressions."""

    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = base + sql
        return run

    return add


def _probes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PROBES], "key string")


def _folder(spark: SparkSession) -> str:
    """A new folder that executors share: under the checkpoint directory; only on one machine a temporary one will do."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if top:
        import uuid

        return f"{top.rstrip('/')}/kvlake-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="kvlake-")
    weakref.finalize(spark, shutil.rmtree, path, ignore_errors=True)
    return path


@query("SELECT key, lsn, op, value FROM kv")
def scan_changelog(spark, sf_dir):
    return events_kv(spark, sf_dir)


@query("SELECT key, value, lsn FROM latest WHERE op = 1")
def latest_live(spark, sf_dir):
    return resolve.live(events_kv(spark, sf_dir)).select("key", "value", "lsn")


@query("SELECT key, op, lsn FROM latest")
def latest_with_tombstones(spark, sf_dir):
    return resolve.latest_per_key(events_kv(spark, sf_dir)).select("key", "op", "lsn")


@query('SELECT lsn, "offset", size FROM placed')
def record_offsets(spark, sf_dir):
    return stats.record_offsets(events_kv(spark, sf_dir)).select("lsn", "offset", "size")


@query('SELECT p.key, p."offset", p.size FROM placed p JOIN latest l USING (lsn) WHERE l.op = 1')
def build_index(spark, sf_dir):
    return stats.build_index(events_kv(spark, sf_dir))


@query("SELECT key, value FROM latest WHERE op = 1 AND key = 'user:00042'")
def point_get_log(spark, sf_dir):
    return scan.get(events_kv(spark, sf_dir), "user:00042").select("key", "value")


@query("SELECT key, value, 'FOUND' AS state FROM latest WHERE op = 1 AND key = 'user:00042' UNION ALL SELECT 'user:00042', NULL, CASE WHEN max(op) = 2 THEN 'DELETED' ELSE 'ABSENT' END FROM latest WHERE key = 'user:00042' HAVING coalesce(max(op), 2) = 2")
def point_get_index(spark, sf_dir):
    """By way of a stored index: the offset of the newest record, then the frame at that offset, whose checksum is verified."""
    store = IndexedLog(spark, _folder(spark))
    store.append(events_kv(spark, sf_dir))
    return store.get("user:00042").select("key", F.col("value").cast("string").alias("value"), "state")


@query("SELECT p.key, CASE l.op WHEN 1 THEN 'FOUND' WHEN 2 THEN 'DELETED' ELSE 'ABSENT' END AS state, CASE WHEN l.op = 1 THEN l.value END AS value FROM probes p LEFT JOIN latest l USING (key)")
def get_three_state(spark, sf_dir):
    return resolve.three_state_get(events_kv(spark, sf_dir), _probes(spark))


@query("SELECT key, value FROM latest JOIN probes USING (key) WHERE op = 1")
def multi_get(spark, sf_dir):
    return scan.multi_get(events_kv(spark, sf_dir), _probes(spark)).select("key", "value")


@query("SELECT key FROM probes WHERE key NOT IN (SELECT key FROM latest WHERE op = 1)")
def multi_get_missing(spark, sf_dir):
    return scan.multi_get_missing(events_kv(spark, sf_dir), _probes(spark))


@query("SELECT key FROM latest WHERE key >= 'user:00033' ORDER BY key LIMIT 1")
def seek_ge(spark, sf_dir):
    return scan.seek(events_kv(spark, sf_dir), TARGET).select("key")


@query("SELECT key, value FROM latest WHERE op = 1 AND key >= 'user:00010' AND key < 'user:00031'")
def range_scan_live(spark, sf_dir):
    return scan.range_scan(events_kv(spark, sf_dir), START, END).select("key", "value")


@query("SELECT key, op FROM latest WHERE key >= 'user:00010' AND key < 'user:00031'")
def range_scan_raw(spark, sf_dir):
    return scan.range_scan(events_kv(spark, sf_dir), START, END, include_deleted=True).select("key", "op")


@query("SELECT key, value FROM latest WHERE op = 1 AND starts_with(key, 'user:0001')")
def prefix_scan(spark, sf_dir):
    return scan.prefix_scan(events_kv(spark, sf_dir), PREFIX).select("key", "value")


@query("SELECT key, value FROM latest WHERE op = 1 ORDER BY key LIMIT 10")
def first_k(spark, sf_dir):
    return scan.first_k(events_kv(spark, sf_dir), 10).select("key", "value")


@query("SELECT key, strlen(value) AS bytes FROM latest WHERE op = 1 ORDER BY bytes DESC, key LIMIT 10")
def top_n_by_value(spark, sf_dir):
    sized = resolve.live(events_kv(spark, sf_dir)).select("key", F.octet_length("value").cast("long").alias("bytes"))
    return sized.orderBy(F.desc("bytes"), "key").limit(10)


@query("SELECT min(key) AS min_key, max(key) AS max_key FROM kv")
def min_max_key(spark, sf_dir):
    return scan.bounds(events_kv(spark, sf_dir))


_STATS = """SELECT count(*) FILTER (WHERE l.op = 1) AS live_keys, CAST((SELECT sum(size) FROM sized) AS BIGINT) AS total_bytes, CAST(sum(s.size) FILTER (WHERE l.op = 1) AS BIGINT) AS live_bytes,
 (SELECT count(*) FROM kv) - count(*) FILTER (WHERE l.op = 1) AS garbage_records FROM latest l JOIN sized s USING (lsn)"""


@query(_STATS)
def storage_stats(spark, sf_dir):
    return stats.stats(events_kv(spark, sf_dir)).drop("space_amplification")


@query(f"SELECT CAST(total_bytes AS DOUBLE) / live_bytes AS space_amplification, CAST(total_bytes AS DOUBLE) / live_bytes > 3.0 AS compact FROM ({_STATS})")
def space_amplification(spark, sf_dir):
    return stats.stats(events_kv(spark, sf_dir)).select("space_amplification", stats.needs_compaction(F.col("space_amplification")).alias("compact"))


@query("SELECT count(*) AS length, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS byte_size FROM latest")
def memtable_size(spark, sf_dir):
    return stats.memtable_size(events_kv(spark, sf_dir))


@query("SELECT max(lsn) AS max_lsn FROM kv")
def lsn_high_water(spark, sf_dir):
    return stats.lsn_high_water(events_kv(spark, sf_dir))


@query("SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS r FROM kv WHERE lsn <= 5000) WHERE r = 1 AND op = 1")
def replay_to_lsn(spark, sf_dir):
    return resolve.as_of(events_kv(spark, sf_dir), REPLAY_TO).select("key", "value")


@query("SELECT DISTINCT a.key FROM kv a JOIN kv b ON a.key = b.key AND a.op = 2 AND b.op = 1 AND b.lsn > a.lsn")
def resurrected_keys(spark, sf_dir):
    return resolve.resurrected(events_kv(spark, sf_dir))


@query("SELECT key, lsn, CAST(coalesce(strlen(value), 0) - coalesce(lag(coalesce(strlen(value), 0)) OVER (PARTITION BY key ORDER BY lsn), 0) AS BIGINT) AS byte_delta FROM kv")
def overwrite_delta(spark, sf_dir):
    return resolve.overwrite_delta(events_kv(spark, sf_dir))


@query("SELECT printf('order:%08d', o_orderkey) AS key, row_number() OVER (ORDER BY o_orderkey) AS lsn FROM orders", base="")
def lsn_assign(spark, sf_dir):
    """Gapless LSNs in key order: a running sum of ones, in two passes."""
    ones = stats.running_offset(orders_kv(spark, sf_dir), F.lit(1))
    return ones.select("key", (F.col("offset") + 1).cast("long").alias("lsn"))


@query("SELECT (lsn - 1) // 1024 AS batch_id, count(*) AS records, min(lsn) AS first_lsn, max(lsn) AS last_lsn FROM kv GROUP BY 1")
def commit_batches(spark, sf_dir):
    return ingest.commit_batches(events_kv(spark, sf_dir), BATCH)


@query("SELECT key, lsn, op FROM kv WHERE lsn >= 2001 AND lsn <= (SELECT max(lsn) FROM kv)")
def truncate_before(spark, sf_dir):
    """A durable log in three batches, cut inside one of them."""
    log = ChangeLog(spark, _folder(spark))
    events = events_kv(spark, sf_dir)
    log.append(events.withColumn("seq", F.col("lsn")), limit=max(1, -(-events.count() // 3)))
    log.truncate_before(TRUNCATE_AT)
    return log.read().select(F.col("key").cast("string").alias("key"), "lsn", F.col("op").cast("int").alias("op"))


@query("SELECT key, lsn, op, value FROM kv UNION ALL SELECT 'k', (SELECT max(lsn) FROM kv) + 1, 1, 'v' UNION ALL SELECT 'k', (SELECT max(lsn) FROM kv) + 2, 2, NULL")
def durable_append(spark, sf_dir):
    """Appends of a whole log, of one put and of one deletion: the records under the LSNs that they were given."""
    log = ChangeLog(spark, _folder(spark))
    log.append(events_kv(spark, sf_dir).withColumn("seq", F.col("lsn")))
    log.put(b"k", b"v")
    log.delete(b"k")
    return log.read().select(F.col("key").cast("string").alias("key"), "lsn", F.col("op").cast("int").alias("op"), F.col("value").cast("string").alias("value"))


@query("SELECT key, op, value FROM latest")
def flush_and_drop_log(spark, sf_dir):
    """Two rounds of append, freeze, flush and truncation of the log: the state is in the table, the log is empty."""
    top = _folder(spark)
    log, table = ChangeLog(spark, f"{top}/log"), KVTable(spark, f"{top}/table")
    events = events_kv(spark, sf_dir).withColumn("seq", F.col("lsn"))
    for half in (F.col("lsn") <= LAYERS[0], F.col("lsn") > LAYERS[0]):
        log.append(events.where(half))
        log.flush_to(table, threshold=1)
    rows = resolve.layered_raw([table.read(), log.read()])
    return rows.select(F.col("key").cast("string").alias("key"), F.col("op").cast("int").alias("op"), F.col("value").cast("string").alias("value"))


@query(
    "SELECT count(*) AS violations FROM (SELECT key, lag(key) OVER (ORDER BY o_orderkey) AS before FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 7 THEN 'order:00000001' WHEN o_orderkey % 1000 = 9 THEN printf('order:%08d', o_orderkey - 1) ELSE printf('order:%08d', o_orderkey) END AS key FROM orders)) WHERE key <= before",
    base="",
)
def sorted_invariant(spark, sf_dir):
    """Orders in key order, of which some have the least key and some repeat the one before: keys that fail to rise."""
    at = F.col("lsn") % 1000
    planted = F.when(at == 7, F.lit("order:00000001")).when(at == 9, F.format_string("order:%08d", F.col("lsn") - 1)).otherwise(F.col("key"))
    return stats.sorted_violations(orders_kv(spark, sf_dir).withColumn("key", planted))


@query(
    """, k AS (SELECT DISTINCT key FROM kv), p AS (SELECT key, lag(key) OVER (ORDER BY key) AS prev FROM k),
 s AS (SELECT key, CASE WHEN prev IS NULL THEN 0 ELSE coalesce(list_min(list_filter(range(1, length(key) + 1), lambda i: key[i] <> prev[i])) - 1, length(key)) END AS shared FROM p)
 SELECT CAST(sum(shared) AS BIGINT) AS shared_bytes, CAST(sum(length(key) - shared) AS BIGINT) AS suffix_bytes FROM s"""
)
def prefix_compression_bytes(spark, sf_dir):
    return prefix_compression(events_kv(spark, sf_dir))


@query(
    """, k AS (SELECT key, CAST(strlen(key) + strlen(value) + 12 AS BIGINT) AS size, row_number() OVER (ORDER BY key) AS r FROM latest WHERE op = 1),
 b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 4096 AS block_id FROM k)
 SELECT CAST(block_id AS BIGINT) AS block_id, max(key) AS last_key, CAST(sum(size) AS BIGINT) AS bytes FROM b GROUP BY 1"""
)
def block_index(spark, sf_dir):
    """Last key and bytes of blocks of about 4 KB over the sorted live keys; key ranges give the order in two passes."""
    live = resolve.live(events_kv(spark, sf_dir)).select("key", "value").withColumn("op", F.lit(PUT))
    blocks = stats.running_offset_by_key(live, stats.record_size()).withColumn("block_id", F.expr(f"offset div {BLOCK}"))
    return blocks.groupBy("block_id").agg(F.max("key").alias("last_key"), F.sum("size").alias("bytes"))


_SEGMENT = "CASE WHEN lsn <= 3000 THEN 0 WHEN lsn <= 6000 THEN 1 ELSE 2 END"


def _sliced(log: DataFrame) -> DataFrame:
    return log.withColumn("segment_id", F.when(F.col("lsn") <= LAYERS[0], 0).when(F.col("lsn") <= LAYERS[1], 1).otherwise(2))


@query(f", s AS (SELECT *, {_SEGMENT} AS segment_id FROM kv) SELECT segment_id, min(key) AS min_key, max(key) AS max_key, count(*) AS n_entries, count(*) FILTER (WHERE op = 2) AS n_tombstones, min(lsn) AS min_lsn, max(lsn) AS max_lsn FROM s GROUP BY 1")
def segment_meta(spark, sf_dir):
    sliced = _sliced(events_kv(spark, sf_dir))
    return sliced.groupBy("segment_id").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("n_entries"), F.count(F.when(F.col("op") == 2, 1)).alias("n_tombstones"), F.min("lsn").alias("min_lsn"), F.max("lsn").alias("max_lsn"))


def _layers(log: DataFrame) -> list[DataFrame]:
    sliced = _sliced(log)
    return [resolve.latest_per_key(sliced.where(F.col("segment_id") == i).drop("segment_id")) for i in range(3)]


@query("SELECT key, value, lsn FROM latest WHERE op = 1")
def layered_get(spark, sf_dir):
    return resolve.layered(_layers(events_kv(spark, sf_dir))).select("key", "value", "lsn")


@query("SELECT key, op, value FROM latest")
def flush_segment(spark, sf_dir):
    """The content of a segment written from the whole log, read back."""
    kv = KVTable(spark, _folder(spark))
    kv.flush(events_kv(spark, sf_dir))
    return kv.read().select("key", "op", "value")


@query("SELECT key, value FROM latest WHERE op = 1")
def compact(spark, sf_dir):
    """Three flushed segments merged into one."""
    kv = KVTable(spark, _folder(spark))
    for layer in _layers(events_kv(spark, sf_dir)):
        kv.flush(layer)
    kv.compact()
    return kv.read().select("key", "value")


@query("SELECT key, value FROM latest WHERE op = 1 AND key >= 'user:00010' AND key < 'user:00031'")
def segment_range_scan(spark, sf_dir):
    """A range of a flushed table; files outside the bounds are not opened."""
    kv = KVTable(spark, _folder(spark))
    kv.flush(events_kv(spark, sf_dir), 4)
    return kv.read(START, END).where(F.col("op") == PUT).select("key", "value")


@query("SELECT p.key, CASE l.op WHEN 1 THEN 'FOUND' WHEN 2 THEN 'DELETED' ELSE 'ABSENT' END AS state, CASE WHEN l.op = 1 THEN l.value END AS value FROM probes p LEFT JOIN latest l USING (key)")
def segment_get(spark, sf_dir):
    """Point lookups in a flushed table."""
    kv = KVTable(spark, _folder(spark))
    kv.flush(events_kv(spark, sf_dir), 4)
    found = functools.reduce(DataFrame.unionByName, [kv.get(p) for p in PROBES])
    return found.select("key", "state", F.col("value").cast("string").alias("value"))


@query("SELECT key, op, value FROM latest WHERE key >= 'user:00033' ORDER BY key LIMIT 1")
def segment_seek(spark, sf_dir):
    """The first key from a target on, over two segments."""
    kv = KVTable(spark, _folder(spark))
    for layer in _layers(events_kv(spark, sf_dir))[:2]:
        kv.flush(layer, 4)
    kv.flush(events_kv(spark, sf_dir).where(F.col("lsn") > LAYERS[1]), 4)
    return kv.seek(TARGET).select("key", "op", "value")


@query("SELECT key, value FROM latest WHERE op = 1")
def commit_after_crash(spark, sf_dir):
    """Commits go on where a crash has left a manifest without its mark and files that no manifest names."""
    top = _folder(spark)
    kv = KVTable(spark, top)
    first, second, third = _layers(events_kv(spark, sf_dir))
    kv.flush(first)
    first.limit(5).write.parquet(f"{top}/segments/left-behind")
    kv.manifest().write.parquet(f"{top}/manifest/2")
    place, fs = kv._fs(f"{top}/manifest/2/_SUCCESS")
    fs.delete(place, False)
    kv.flush(second)
    kv.flush(third)
    kv.vacuum()
    return resolve.live(kv.read()).select("key", "value")


@query("SELECT key, op, value FROM latest")
def wal_recover(spark, sf_dir):
    """Write-ahead logs with garbage at their ends, read up to it; closed batches replayed in the order of their files."""
    files = encode_files(events_kv(spark, sf_dir), kind="kvwal")
    torn = files.select("path", F.concat("content", F.encode(F.lit("incomplete record garbage"), "UTF-8")).alias("content"))
    records = closed(decode_files(torn, "kvwal"))
    newest = resolve.latest_per_key(with_lsn(records))
    return newest.select(F.col("key").cast("string").alias("key"), F.col("op").cast("int").alias("op"), F.col("value").cast("string").alias("value"))


@query("SELECT key, op, value, key = 'user:00042' AS asked FROM latest")
def foreign_segment(spark, sf_dir):
    """Segment files with filter, index and blocks, decoded whole; one key is also looked up in them."""
    newest = resolve.latest_per_key(events_kv(spark, sf_dir))
    files = encode_segments(newest.withColumn("group", F.substring("key", 1, 8)), "group")
    rows = decode_files(files, "kvsst").select("key", F.col("op").cast("int").alias("op"), "value")
    hit = get_in_segments(files, b"user:00042").select(F.lit(b"user:00042").alias("key"), F.lit(True).alias("asked"))
    joined = rows.join(hit, "key", "left")
    return joined.select(F.col("key").cast("string").alias("key"), "op", F.col("value").cast("string").alias("value"), F.coalesce("asked", F.lit(False)).alias("asked"))


_SIZES = "m AS (SELECT CAST(ceil(-n * ln(0.01) / (ln(2) * ln(2))) AS BIGINT) AS bits, CAST(ceil(ceil(-n * ln(0.01) / (ln(2) * ln(2))) / n * ln(2)) AS BIGINT) AS hashes FROM (SELECT CAST(greatest(count(*), 1) AS DOUBLE) AS n FROM keys))"
_PLACES = "SELECT key, (CAST('0x' || substr(md5(key), 1, 15) AS BIGINT) % bits + i * (CAST('0x' || substr(md5(key), 17, 15) AS BIGINT) % bits)) % bits AS place FROM {}, m, (SELECT unnest(range(20)) AS i) WHERE i < hashes"


@query("SELECT key FROM probes WHERE key IN (SELECT key FROM kv WHERE op = 1)")
def bloom_semi_join(spark, sf_dir):
    """Probes pass a filter of the keys that were ever put, then the join."""
    puts = events_kv(spark, sf_dir).where(F.col("op") == PUT)
    many = puts.select("key").distinct().count()
    return bloom.pruned(puts, _probes(spark), bloom.build(puts, many), many)


@query('SELECT key, lsn, size FROM sized')
def hint_projection(spark, sf_dir):
    return events_kv(spark, sf_dir).select("key", "lsn", stats.record_size().alias("size"))


@query("SELECT printf('conv:%08d/%05d', conv_id, turn) AS key, text AS value FROM conversations WHERE printf('conv:%08d/%05d', conv_id, turn) >= 'conv:00000002' AND printf('conv:%08d/%05d', conv_id, turn) < 'conv:00000005'", base="")
def conversation_range(spark, sf_dir):
    return conversations_kv(spark, sf_dir).where((F.col("key") >= "conv:00000002") & (F.col("key") < "conv:00000005")).select("key", "value")


@query("SELECT key, op, lsn FROM latest")
def stream_latest(spark, sf_dir):
    """The same state by Structured Streaming over the events files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet")
    target = _folder(spark)
    ingest.follow_latest(events_of(events), f"{target}/state", f"{target}/checkpoint").awaitTermination()
    return ingest.current(spark, f"{target}/state").select("key", "op", "lsn")


_BYTES = "list_transform(string_split({}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
_LE32 = "[{0} & 255, ({0} >> 8) & 255, ({0} >> 16) & 255, {0} >> 24]"


@query(
    f""", step AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
 raw AS (SELECT key, lsn, op, size, list_concat({_LE32.format("CAST(strlen(key) AS BIGINT)")}, {_LE32.format("CAST(CASE WHEN op = 2 THEN 11 ELSE strlen(value) END AS BIGINT)")}, {_BYTES.format("key")},
 CASE WHEN op = 2 THEN list_concat([CAST(0 AS BIGINT)], {_BYTES.format("'TOMBSTONE'")}, [CAST(0 AS BIGINT)]) WHEN value = '' THEN CAST([] AS BIGINT[]) ELSE {_BYTES.format("value")} END) AS b FROM sized),
 sums AS (SELECT key, lsn, op, size, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM raw, step)
 SELECT key, lsn, op, crc, crc AS decoded_crc, size, true AS valid FROM sums"""
)
def crc_roundtrip(spark, sf_dir):
    """Frames of all records by expressions, read again: their checksums, sizes, and whether checksum and record come back."""
    framed = events_kv(spark, sf_dir).withColumn("_frame", log_frame(F.col("op"), F.col("key"), F.col("value")))
    read = framed.withColumn("_read", read_log_frame(F.col("_frame")))
    value = F.when(F.col("op") == PUT, F.coalesce("value", F.lit(""))).cast("binary")
    same = (F.col("_read.crc") == F.col("_read.computed")) & (F.col("_read.op") == F.col("op")) & (F.col("_read.key") == F.col("key").cast("binary")) & F.col("_read.value").eqNullSafe(value)
    return read.select("key", "lsn", "op", F.col("_read.crc").alias("crc"), F.col("_read.computed").alias("decoded_crc"), F.octet_length("_frame").cast("long").alias("size"), F.coalesce(same, F.lit(False)).alias("valid"))


@query(
    f""", keys AS (SELECT key FROM latest WHERE op = 1), absent AS (SELECT 'absent:' || CAST(range AS VARCHAR) AS key FROM range(100000)), {_SIZES},
 filled AS (SELECT DISTINCT place FROM ({_PLACES.format("keys")})),
 missed AS (SELECT key, bool_and(f.place IS NOT NULL) AS maybe FROM ({_PLACES.format("absent")}) p LEFT JOIN filled f ON f.place = p.place GROUP BY 1)
 SELECT bits, hashes, 16 + 8 * ((bits + 63) // 64) AS bytes, (SELECT count(*) FROM filled) AS filled, CAST(0 AS BIGINT) AS false_negatives, (SELECT count(*) FROM missed WHERE maybe) AS false_positives, (SELECT count(*) FROM missed WHERE maybe) <= 2000 AS within_two_percent FROM m"""
)
def bloom_fpr(spark, sf_dir):
    """A filter of the live keys, built and probed with all of them and with 100,000 keys that aren't there."""
    keys = resolve.live(events_kv(spark, sf_dir)).select("key")
    expected = keys.count()
    size, words = stats.bloom_sizing(expected, 0.01), bloom.build(keys, expected)
    absent = spark.range(100_000).select(F.concat(F.lit("absent:"), F.col("id").cast("string")).alias("key"))
    asked = bloom.may_contain(keys.select("key").unionByName(absent), words, expected).withColumn("_absent", F.col("key").startswith("absent:"))
    counts = asked.agg(F.count(F.when(~F.col("_absent") & ~F.col("maybe"), 1)).alias("false_negatives"), F.count(F.when(F.col("_absent") & F.col("maybe"), 1)).alias("false_positives"))
    filled = words.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))).first()[0]
    within = (F.col("false_positives") <= 2000).alias("within_two_percent")
    return counts.select(*[F.lit(n).cast("long").alias(name) for name, n in (size | {"filled": filled}).items()], "false_negatives", "false_positives", within)


_DECODED = """SELECT op, count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes FROM sized GROUP BY 1"""


@query(_DECODED)
def codec_crash_tail(spark, sf_dir):
    """The whole log framed as files, each with a torn record at its end, and decoded up to it."""
    files = encode_files(events_kv(spark, sf_dir))
    torn = files.select("path", F.concat("content", F.unhex(F.lit("DEADBE"))).alias("content"))
    return decode_files(torn).groupBy(F.col("op").cast("int").alias("op")).agg(F.count(F.lit(1)).alias("records"), F.sum("size").alias("bytes"))
