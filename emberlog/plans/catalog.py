"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import bloom, codec
from emberlog.operators import changelog
from emberlog.operators.segments import LogTable, Settings
from emberlog.sources import scratch, wal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The changelogs and results that several queries' SQL begins with.
LOG = "log AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, props AS value, event_type = 'error' AS deleted FROM events)"
LATEST = LOG + ", latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1), snap AS (SELECT key, seq, value FROM latest WHERE NOT deleted)"
PROBES = ", probes AS (SELECT CAST(i AS VARCHAR) AS key FROM range(300) t(i))"
FILES = ", l0 AS (SELECT *, seq // 1000 AS file_id FROM log)"
#: Shape of the Bloom filter of the queries: words of 64 bits, lookups; keys that a merged file takes.
WORDS, LOOKUPS, FILE_KEYS = 64, 8, 26
_BIT = "CASE WHEN bit % 64 = 63 THEN -9223372036854775808 ELSE (1::BIGINT << (bit % 64)::INT) END"
_HASHED = "unnest([(h1 + i * h2) & 4095 FOR i IN range(1, 9)]) AS bit FROM (SELECT *, CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(md5(key), 9, 8) AS BIGINT) AS h2 FROM "


def _bits(of: str) -> str:
    return f"SELECT bit // 64 AS word, bit_or({_BIT}) AS bits FROM (SELECT {_HASHED}({of}))) GROUP BY 1"


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL where that exists."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def events_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event changelog: latest event of a user wins, an error deletes."""
    return events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("props").alias("value"), (F.col("event_type") == "error").alias("deleted"))


def probes(spark: SparkSession) -> DataFrame:
    return spark.range(300).select(F.col("id").cast("string").alias("key"))


def l0(spark, sf_dir) -> DataFrame:
    """The changelog cut into files of a thousand sequence numbers, as flushes would leave it."""
    return events_kv(spark, sf_dir).withColumn("file_id", F.expr("seq div 1000"))


def segments_of(log: DataFrame) -> DataFrame:
    """A changelog (key, seq, value, deleted and what else a table may lack) as rows that a table loads."""
    missing = {"ts": F.lit(None).cast("timestamp"), "content_type": F.lit(None).cast("string"), "file_no": F.col("file_id") if "file_id" in log.columns else F.lit(0)}
    for name, value in missing.items():
        log = log if name in log.columns else log.withColumn(name, value)
    return log.select("key", "seq", "ts", F.col("value").cast("binary").alias("value"), "content_type", "deleted", F.col("file_no").cast("long").alias("file_no"))


def new_table(spark: SparkSession, settings: Settings | None = None) -> LogTable:
    return LogTable(spark, scratch.folder(spark), settings)


def text_values(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumn("value", F.col("value").cast("string")).select(*columns)


@query("kv_snapshot", f"WITH {LATEST} SELECT * FROM snap")
def kv_snapshot(spark, sf_dir):
    return changelog.snapshot(events_kv(spark, sf_dir)).select("key", "seq", "value")


@query("kv_snapshot_tombstones", f"WITH {LATEST} SELECT * FROM latest")
def kv_snapshot_tombstones(spark, sf_dir):
    return changelog.latest(events_kv(spark, sf_dir))


@query("kv_get", f"WITH {LATEST} SELECT * FROM snap WHERE key = '7'")
def kv_get(spark, sf_dir):
    return changelog.get(events_kv(spark, sf_dir), "7")


@query("kv_multi_get", f"WITH {LATEST}{PROBES} SELECT p.key, value, seq IS NOT NULL AS found FROM probes p LEFT JOIN snap USING (key)")
def kv_multi_get(spark, sf_dir):
    return changelog.multi_get(events_kv(spark, sf_dir), probes(spark))


@query("kv_exists", f"WITH {LATEST}{PROBES} SELECT key FROM probes WHERE key IN (SELECT key FROM snap)")
def kv_exists(spark, sf_dir):
    return changelog.exists(events_kv(spark, sf_dir), probes(spark))


@query("kv_missing", f"WITH {LATEST}{PROBES} SELECT key FROM probes p WHERE NOT EXISTS (SELECT 1 FROM snap s WHERE s.key = p.key)")
def kv_missing(spark, sf_dir):
    return changelog.missing(events_kv(spark, sf_dir), probes(spark))


@query("kv_as_of_seq", f"WITH {LOG}, l AS (SELECT * FROM log WHERE seq <= 5000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT key, seq, value FROM l WHERE NOT deleted")
def kv_as_of_seq(spark, sf_dir):
    return changelog.as_of(events_kv(spark, sf_dir), 5000)


@query("kv_update_only", "SELECT CAST(o_custkey AS VARCHAR) AS key, max(o_orderkey) AS seq, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1")
def kv_update_only(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return changelog.snapshot(orders.select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"), F.lit(False).alias("deleted")))


@query("kv_typed_values", "SELECT '/kv/' || url AS key, strlen(html) AS bytes, 'text/html' AS content_type FROM pages")
def kv_typed_values(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("/kv/"), "url").alias("key"), F.octet_length("html").cast("long").alias("bytes"), F.lit("text/html").alias("content_type"))


@query("log_backward_get", f"WITH {LOG} SELECT key, value, deleted FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1")
def log_backward_get(spark, sf_dir):
    return changelog.latest(events_kv(spark, sf_dir)).drop("seq")


@query("kv_stats", f"WITH {LATEST} SELECT count(*) AS entries, min(key) AS first, max(key) AS last FROM snap")
def kv_stats(spark, sf_dir):
    return kv_snapshot(spark, sf_dir).agg(F.count(F.lit(1)).alias("entries"), F.min("key").alias("first"), F.max("key").alias("last"))


@query("kv_sorted_keys", f"WITH {LATEST} SELECT key, row_number() OVER (ORDER BY key) - 1 AS place FROM snap")
def kv_sorted_keys(spark, sf_dir):
    return changelog.placed(kv_snapshot(spark, sf_dir)).select("key", "place")


@query("wal_replay", f"WITH {LOG} SELECT * FROM log WHERE seq > (SELECT max(seq) - 1000 FROM log)")
def wal_replay(spark, sf_dir):
    log = events_kv(spark, sf_dir)
    mark = log.agg((F.max("seq") - 1000).alias("mark"))  # one row: what segments hold
    return log.join(F.broadcast(mark), F.col("seq") > F.col("mark")).drop("mark")


@query("wal_json_roundtrip", f"WITH {LOG} SELECT seq, key, value, deleted FROM log")
def wal_json_roundtrip(spark, sf_dir):
    lines = wal.to_lines(events_kv(spark, sf_dir).withColumn("ts", F.timestamp_seconds("seq")))
    return wal.from_lines(lines).where("bad is null").select("seq", "key", F.col("value").cast("string").alias("value"), "deleted")


@query("flush_l0", f"WITH {LOG}{FILES} SELECT file_id, key, seq, value, deleted FROM l0 QUALIFY row_number() OVER (PARTITION BY file_id, key ORDER BY seq DESC) = 1")
def flush_l0(spark, sf_dir):
    """A flush for each thousand sequence numbers, as a table stores them."""
    table = new_table(spark)
    table.load(segments_of(l0(spark, sf_dir)))
    return text_values(table._read(table.manifest.read()).withColumnRenamed("file_no", "file_id"), "file_id", "key", "seq", "value", "deleted")


@query("l0_overlap", f"WITH {LOG}{FILES}, r AS (SELECT file_id, min(key) AS lo, max(key) AS hi FROM l0 GROUP BY 1) SELECT a.file_id AS a, b.file_id AS b FROM r a JOIN r b ON a.file_id < b.file_id AND a.lo <= b.hi AND b.lo <= a.hi")
def l0_overlap(spark, sf_dir):
    ranges = l0(spark, sf_dir).groupBy("file_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    a, b = (ranges.select(F.col("file_id").alias(x), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}")) for x in "ab")
    return a.join(b, (F.col("a") < F.col("b")) & (F.col("lo_a") <= F.col("hi_b")) & (F.col("lo_b") <= F.col("hi_a"))).select("a", "b")


@query("merge_l0_l1", f"WITH {LATEST} SELECT * FROM latest")
def merge_l0_l1(spark, sf_dir):
    """The first half is level 1, the files of the rest are level 0: merged, tombstones kept."""
    return text_values(_merged(spark, sf_dir).log(), "key", *changelog.VERSION)


def _merged(spark, sf_dir) -> LogTable:
    log = l0(spark, sf_dir)
    half = log.agg(F.expr("max(seq) div 2").alias("half"))
    parts = log.join(F.broadcast(half))  # one row
    table = new_table(spark)
    table.load(segments_of(parts.where("seq <= half").withColumn("file_id", F.lit(0))), 1)
    table.load(segments_of(parts.where("seq > half")))
    table.merge(0)
    return table


@query("compact_level", f"WITH {LATEST} SELECT * FROM snap")
def compact_level(spark, sf_dir):
    """The highest level rewritten: tombstones go."""
    table = _merged(spark, sf_dir)
    table.compact(1)
    return text_values(table.log(), "key", "seq", "value")


@query("merge_layout", f"WITH {LATEST}, p AS (SELECT key, (row_number() OVER (ORDER BY key) - 1) // {FILE_KEYS} AS file_no FROM snap) SELECT file_no, count(*) AS keys, min(key) AS first, max(key) AS last FROM p GROUP BY 1")
def merge_layout(spark, sf_dir):
    """The segments of a merge of live entries: one key more than asked for in each."""
    table = new_table(spark, Settings(keys_of_segment=FILE_KEYS - 1))
    table.load(segments_of(kv_snapshot(spark, sf_dir).withColumn("deleted", F.lit(False))))
    table.merge(0)
    rows = [(s["file"], s["entries"], s["min_key"], s["max_key"]) for s in table.manifest.read()]  # as many as the manifest has
    return spark.createDataFrame(rows, "file_no long, keys long, first string, last string")


@query("merge_invariance", "SELECT 0::BIGINT AS only_a, 0::BIGINT AS only_b")
def merge_invariance(spark, sf_dir):
    return changelog.same_rows(kv_snapshot(spark, sf_dir), compact_level(spark, sf_dir))


@query("merge_policy", "WITH f AS (SELECT CASE WHEN event_id // 1000 % 4 = 3 THEN 1 ELSE 0 END AS level, event_id // 1000 AS file_id FROM events GROUP BY ALL) SELECT level, count(*) AS files, count(*) > 2 * (level + 1) AS due FROM f GROUP BY level")
def merge_policy(spark, sf_dir):
    """Which levels of a table are due, one in four of its flushes being of level 1."""
    table, log = new_table(spark, Settings(segments_of_level=2)), l0(spark, sf_dir)
    for level in (0, 1):
        table.load(segments_of(log.where((F.col("file_id") % 4 == 3) == F.lit(level == 1))), level)
    due = table.due()
    return spark.createDataFrame([(i, len(of), i in due) for i, of in table.levels().items()], "level int, files long, due boolean")


@query("level_data_size", f"WITH {LOG}{FILES} SELECT file_id, count(*) AS entries, CAST(sum(9 + strlen(key) + strlen(value)) AS BIGINT) AS bytes, sum(9 + strlen(key) + strlen(value)) > 20000 AS due FROM l0 GROUP BY 1")
def level_data_size(spark, sf_dir):
    sized = l0(spark, sf_dir).withColumn("b", codec.entry_bytes(F.col("key"), F.col("value")))
    return sized.groupBy("file_id").agg(F.count(F.lit(1)).alias("entries"), F.sum("b").alias("bytes")).withColumn("due", F.col("bytes") > 20000)


@query("level_time_window", "WITH f AS (SELECT event_id // 1000 AS file_id, max(epoch(ts)::BIGINT) AS last FROM events GROUP BY 1) SELECT file_id, last < (SELECT max(last) FROM f) - 3600 AS due FROM f")
def level_time_window(spark, sf_dir):
    files = events(spark, sf_dir).groupBy(F.expr("event_id div 1000").alias("file_id")).agg(F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("last"))
    return files.join(F.broadcast(files.agg(F.max("last").alias("now")))).select("file_id", (F.col("last") < F.col("now") - 3600).alias("due"))


@query("write_amplification", f"WITH {LOG} SELECT count(*) AS versions, count(DISTINCT key) AS keys, CAST(sum(CASE WHEN deleted THEN 1 ELSE 0 END) AS BIGINT) AS tombstones FROM log")
def write_amplification(spark, sf_dir):
    by_key = events_kv(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("deleted").cast("long")).alias("t"))
    return by_key.agg(F.sum("n").alias("versions"), F.count(F.lit(1)).alias("keys"), F.sum("t").alias("tombstones"))


_INDEX = f"WITH {LATEST}, e AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS place, CAST(sum(9 + strlen(key) + COALESCE(strlen(value), 0)) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING) - (9 + strlen(key) + COALESCE(strlen(value), 0)) AS BIGINT) AS byte_offset, value, seq FROM latest)"


def _entries(spark, sf_dir) -> DataFrame:
    """Entries of one merged file in key order, with place, byte offset and block."""
    placed = changelog.placed(changelog.latest(events_kv(spark, sf_dir)), codec.entry_bytes(F.col("key"), F.col("value")))
    return placed.withColumn("block_no", F.expr("place div 10"))


@query("sparse_index", f"{_INDEX} SELECT place // 10 AS block_no, key, byte_offset FROM e WHERE place % 10 = 0")
def sparse_index(spark, sf_dir):
    return _entries(spark, sf_dir).where(F.col("place") % 10 == 0).select("block_no", "key", "byte_offset")


@query("find_block", f"{_INDEX}, a AS (SELECT key, place // 10 AS pos FROM e WHERE place % 10 = 0){PROBES} SELECT p.key AS probe, a.key AS key, COALESCE(a.pos, -1) AS pos FROM probes p ASOF LEFT JOIN a ON p.key >= a.key")
def find_block(spark, sf_dir):
    return changelog.floor_lookup(probes(spark).withColumnRenamed("key", "probe"), sparse_index(spark, sf_dir))


@query("block_scan", f"{_INDEX} SELECT key, seq, value, byte_offset FROM e WHERE place // 10 = 2")
def block_scan(spark, sf_dir):
    return _entries(spark, sf_dir).where("block_no = 2").select("key", "seq", "value", "byte_offset")


@query("bloom_build", f"WITH {LOG} {_bits('SELECT DISTINCT key FROM log')}")
def bloom_build(spark, sf_dir):
    return bloom.build(events_kv(spark, sf_dir).select("key"), WORDS, LOOKUPS)


_TEST = f"SELECT key, bool_and(COALESCE(bits & ({_BIT}), 0) <> 0) AS maybe FROM (SELECT key, {_HASHED}probes)) LEFT JOIN f ON word = bit // 64 GROUP BY key"


@query("bloom_test", f"WITH {LOG}{PROBES}, f AS ({_bits('SELECT DISTINCT key FROM log')}) {_TEST}")
def bloom_test(spark, sf_dir):
    return bloom.test(probes(spark), bloom_build(spark, sf_dir), WORDS, LOOKUPS)


def _halves(spark, sf_dir) -> list[DataFrame]:
    log = events_kv(spark, sf_dir)
    return [bloom.build(log.where(F.col("seq") % 2 == k).select("key"), WORDS, LOOKUPS) for k in (0, 1)]


@query("bloom_union", f"WITH {LOG} {_bits('SELECT DISTINCT key FROM log')}")
def bloom_union(spark, sf_dir):
    return bloom.union(*_halves(spark, sf_dir), words=(WORDS, WORDS))


@query("bloom_estimate", f"WITH {LOG}, f AS ({_bits('SELECT DISTINCT key FROM log')}), c AS (SELECT CAST(sum(bit_count(bits)) AS BIGINT) AS bits_set FROM f) SELECT bits_set, CAST(round(4096 / 8 * ln(4096.0 / (4096 - bits_set))) AS BIGINT) AS keys FROM c")
def bloom_estimate(spark, sf_dir):
    return bloom.estimate(bloom_build(spark, sf_dir), WORDS, LOOKUPS)


_KEYED = "keyed AS (SELECT CAST(o_custkey AS VARCHAR) AS key, o_custkey // 50 AS file_id FROM orders)"


@query("bloom_file_skip", f"WITH {_KEYED}{PROBES}, f AS (SELECT file_id, bit // 64 AS word, bit_or({_BIT}) AS bits FROM (SELECT file_id, {_HASHED}(SELECT DISTINCT key, file_id FROM keyed))) GROUP BY 1, 2), h AS (SELECT key, file_id, count(*) AS n FROM (SELECT key, {_HASHED}probes)) JOIN f ON word = bit // 64 AND bits & ({_BIT}) <> 0 GROUP BY 1, 2) SELECT key, count(*) AS files FROM h WHERE n = 8 GROUP BY 1")
def bloom_file_skip(spark, sf_dir):
    keyed = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("string").alias("key"), F.expr("o_custkey div 50").alias("file_id"))
    filters = bloom.build(keyed, WORDS, LOOKUPS, by=("file_id",))
    hits = bloom.test(probes(spark), filters, WORDS, LOOKUPS, by=("file_id",))
    return hits.where("maybe").groupBy("key").agg(F.count(F.lit(1)).alias("files"))


_COUNTERS = f"WITH {LOG}, e AS (SELECT *, sum(CASE WHEN deleted THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS epoch FROM log), c AS (SELECT key, seq, row_number() OVER (PARTITION BY key, epoch ORDER BY seq) - 1 AS n FROM e WHERE NOT deleted)"


@query("seq_increment", f"{_COUNTERS} SELECT * FROM c")
def seq_increment(spark, sf_dir):
    return changelog.counters(events_kv(spark, sf_dir))


@query("seq_codec", f"{_COUNTERS} SELECT key, seq, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS stored, n FROM (SELECT *, printf('%08X', n) AS h FROM c)")
def seq_codec(spark, sf_dir):
    stored = changelog.counters(events_kv(spark, sf_dir)).withColumn("data", codec.encode_counter(F.col("n")))
    return stored.select("key", "seq", F.hex("data").alias("stored"), codec.decode_counter(F.col("data")).alias("n"))


@query("http_replay", """WITH r AS (SELECT event_id, '/kv/' || user_id AS path, CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'view' THEN 'GET' WHEN 'signup' THEN 'OPTIONS' ELSE 'PUT' END AS method FROM events),
s AS (SELECT *, last_value(CASE method WHEN 'PUT' THEN 1 WHEN 'DELETE' THEN 0 END IGNORE NULLS) OVER (PARTITION BY path ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM r)
SELECT event_id, path, method, CASE WHEN method = 'GET' AND COALESCE(state, 0) = 0 THEN 404 ELSE 200 END AS status FROM s""")
def http_replay(spark, sf_dir):
    method = F.when(F.col("event_type") == "error", "DELETE").when(F.col("event_type") == "view", "GET").when(F.col("event_type") == "signup", "OPTIONS").otherwise("PUT")
    requests = events(spark, sf_dir).select("event_id", F.concat(F.lit("/kv/"), F.col("user_id").cast("string")).alias("path"), method.alias("method"))
    state = F.when(F.col("method") == "PUT", 1).when(F.col("method") == "DELETE", 0)
    known = changelog.state_before(requests.withColumn("state", state), "path", "event_id", "state")
    status = F.when((F.col("method") == "GET") & (F.coalesce("before", F.lit(0)) == 0), 404).otherwise(200)
    return known.select("event_id", "path", "method", status.alias("status"))


@query("dump_bin", f"{_INDEX} SELECT place, key, seq, value FROM e")
def dump_bin(spark, sf_dir):
    return _entries(spark, sf_dir).select("place", "key", "seq", "value")


@query("dump_index", f"{_INDEX} SELECT key, byte_offset FROM e WHERE place % 10 = 0")
def dump_index(spark, sf_dir):
    return sparse_index(spark, sf_dir).select("key", "byte_offset")


@query("deep_compare", f"WITH {LATEST} SELECT (SELECT count(*) FROM (SELECT key, seq, value FROM log EXCEPT ALL SELECT * FROM snap)) AS only_a, (SELECT count(*) FROM (SELECT * FROM snap EXCEPT ALL SELECT key, seq, value FROM log)) AS only_b")
def deep_compare(spark, sf_dir):
    return changelog.same_rows(events_kv(spark, sf_dir).select("key", "seq", "value"), kv_snapshot(spark, sf_dir))


@query("datagen_load", "SELECT CAST(i AS VARCHAR) AS key, CAST(i AS VARCHAR) AS value, i // 1025 AS file_id FROM range(150000) t(i)")
def datagen_load(spark, sf_dir):
    """A bulk load, flushed at 1025 keys."""
    text, table = F.col("id").cast("string"), new_table(spark)
    rows = spark.range(150_000).select(text.alias("key"), F.col("id").alias("seq"), text.alias("value"), F.lit(False).alias("deleted"), F.expr("id div 1025").alias("file_id"))
    table.load(segments_of(rows))
    return text_values(table._read(table.manifest.read()).withColumnRenamed("file_no", "file_id"), "key", "value", "file_id")


@query("segment_lookup", f"WITH {LATEST}, p AS (SELECT CAST(i AS VARCHAR) AS key FROM range(0, 300, 25) t(i)) SELECT p.key, value FROM p LEFT JOIN snap USING (key)")
def segment_lookup(spark, sf_dir):
    """Point lookups in a table of many flushes, by key ranges, Bloom filters and sparse index."""
    table = new_table(spark, Settings(keys_of_block=10))
    table.load(segments_of(l0(spark, sf_dir)))
    keys = [str(i) for i in range(0, 300, 25)]
    values = table.get_all(keys)
    return spark.createDataFrame([(k, None if v is None else v.decode()) for k, v in values.items()], "key string, value string")


@query("segment_skip", f"WITH {LOG}{FILES}, p AS (SELECT CAST(i AS VARCHAR) AS key FROM range(0, 300, 5) t(i)), h AS (SELECT key, count(DISTINCT file_id) AS holding FROM l0 GROUP BY 1) SELECT p.key, COALESCE(holding, 0) AS holding, true AS all_kept FROM p LEFT JOIN h USING (key)")
def segment_skip(spark, sf_dir):
    """Of each key the segments that hold it, all of which its lookup must read; a filter only skips others."""
    table, log = new_table(spark), l0(spark, sf_dir)
    table.load(segments_of(log))
    keys = [str(i) for i in range(0, 300, 5)]
    read = spark.createDataFrame([(k, s["file"]) for k, of in table.maybe(keys).items() for s in of] or [(None, None)], "key string, file_id long")
    held = log.where(F.col("key").isin(keys)).select("key", "file_id").distinct().join(read.withColumn("read", F.lit(True)), ["key", "file_id"], "left")
    counts = held.groupBy("key").agg(F.count(F.lit(1)).alias("holding"), F.bool_and(F.coalesce("read", F.lit(False))).alias("all_kept"))
    asked = spark.createDataFrame([(k,) for k in keys], "key string")
    return asked.join(counts, "key", "left").select("key", F.coalesce("holding", F.lit(0)).alias("holding"), F.coalesce("all_kept", F.lit(True)).alias("all_kept"))


@query("segment_index", f"WITH {LATEST}, e AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS place FROM latest) SELECT CAST(sum(n) AS BIGINT) AS entries, min(first) AS first_key, max(last) AS last_key FROM (SELECT place // 10 AS block, count(*) AS n, min(key) AS first, max(key) AS last FROM e GROUP BY 1)")
def segment_index(spark, sf_dir):
    """What the stored sparse index of a merged table covers."""
    table = new_table(spark, Settings(keys_of_block=10))
    table.load(segments_of(changelog.latest(events_kv(spark, sf_dir))))
    return table.sparse_index().agg(F.sum("entries").alias("entries"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))


@query("append_log_get", "SELECT '/kv/' || url AS key, html AS value, 'text/html' AS content_type FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1")
def append_log_get(spark, sf_dir):
    """Pages through lines of the older log format and back; the last line of a key decides."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(F.lit("/kv/"), "url").alias("key"), F.col("html").cast("binary").alias("value"), F.lit("text/html").alias("content_type"), F.lit(False).alias("deleted"))
    last = pages.groupBy("key").agg(F.max_by(F.struct("value", "content_type", "deleted"), "page_id").alias("v")).select("key", "v.*")
    back = wal.from_append_lines(wal.to_append_lines(last)).where("bad is null and not deleted")
    return back.select("key", F.col("value").cast("string").alias("value"), "content_type")


@query("httpgen_requests", "SELECT CAST(i AS VARCHAR) AS id, 'POST' AS method, '/kv/' || i AS path FROM range(100000) t(i)")
def httpgen_requests(spark, sf_dir):
    """The requests of the load generator, as a service gets them."""
    return spark.range(100_000).select(F.col("id").cast("string").alias("id"), F.lit("POST").alias("method"), F.concat(F.lit("/kv/"), F.col("id").cast("string")).alias("path"))


def _stream(spark, sf_dir) -> DataFrame:
    schema = events(spark, sf_dir).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    return rows.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("props").cast("binary").alias("value"), F.lit(None).cast("string").alias("content_type"), (F.col("event_type") == "error").alias("deleted"))


@query("stream_snapshot", f"WITH {LATEST} SELECT * FROM snap")
def stream_snapshot(spark, sf_dir):
    """The stream flushed into a table by micro-batches; its snapshot."""
    from emberlog.streaming import ingest

    folder = scratch.folder(spark)
    table = LogTable(spark, f"{folder}/table")
    ingest.into_table(_stream(spark, sf_dir), table, f"{folder}/checkpoint").awaitTermination()
    return table.snapshot().select("key", "seq", F.col("value").cast("string").alias("value"))


@query("stream_counter", f"{_COUNTERS} SELECT * FROM c")
def stream_counter(spark, sf_dir):
    """Counters kept in a stream's state store, written as it goes."""
    from emberlog.streaming import ingest

    folder, key = scratch.folder(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ingest.ROCKSDB)
    try:
        out = ingest.counters(_stream(spark, sf_dir)).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        out.start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema("key string, seq long, n long").parquet(f"{folder}/out")
