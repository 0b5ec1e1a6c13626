"""Tables of segments, codecs, filters and log lines, on the fixtures of the survey."""

import bisect
import itertools

import pytest
from pyspark.sql import functions as F

from emberlog.functions import bloom, codec
from emberlog.operators import changelog
from emberlog.operators.segments import LogTable, Settings
from emberlog.sources import wal
from emberlog.streaming import ingest

A = {"18": "MTYzOTEwMTYwOTUxNzc4NjMwNA==", "81": "MTYzOTEwMTYwOTUxNzc3NjE2Mw=="}
B = {"0": "zero", "11": "eleven", "25": None, "56": "x", "62": "y", "89": "z", "94": "w"}
C = {"18": None, "25": "old", "40": "f", "47": "g", "59": "h", "81": None, "87": "i"}


def test_compaction_of_three_files(spark):
    rows = [(k, seq, v, v is None) for seq, part in ((17, A), (15, B), (8, C)) for k, v in part.items()]
    got = {r.key: (r.value, r.deleted) for r in changelog.latest(spark.createDataFrame(rows, "key string, seq long, value string, deleted boolean")).collect()}
    assert len(got) == 13 and got["25"] == (None, True) and got["18"] == (A["18"], False)


def test_lifecycle(spark, tmp_path):
    table = LogTable(spark, f"file://{tmp_path}/t", Settings(max_levels=3))
    table.put({str(i): str(i).encode() for i in range(99, -1, -1)})
    table.delete(["100"])
    assert not table.exists("100") and table.get("42") == b"42"
    before = sorted(map(tuple, table.snapshot().collect()))
    table.merge(0)
    assert table.highest_level() == 1 and sorted(map(tuple, table.snapshot().collect())) == before
    for level in (2, 5, -1):
        with pytest.raises(ValueError):
            table.merge(level)
    with pytest.raises(ValueError):
        table.compact(0)
    table.delete([str(i) for i in range(100)])
    assert table.snapshot().isEmpty() and not table.exists("7")
    table.merge(0)  # level 1 exists, so tombstones stay
    assert table.log().where("deleted").count() == 100
    table.merge(1)
    assert table.log().count() == 0 and table.highest_level() == 2
    table.put({"é": b"", "日本": b"x"})
    assert table.get("é") == b"" and table.exists("日本") and not table.exists("z")
    assert [table.increment("n") for _ in range(3)] == [0, 1, 2] and table.get("n") == b"\x02\x00\x00\x00"
    table.delete(["n"])
    assert table.increment("n") == 0
    with pytest.raises(ValueError):
        table.increment("日本")
    assert table.vacuum() > 0
    table.reset()
    assert table.log().isEmpty() and table.due() == []


def test_batches_apply_once_in_any_order(spark, tmp_path):
    table = LogTable(spark, f"file://{tmp_path}/t", Settings(segments_of_level=1))
    rows = spark.range(0, 1000).select(F.col("id").cast("string").alias("key"), F.col("id").alias("seq"), F.current_timestamp().alias("ts"), F.lit(None).cast("binary").alias("value"), F.lit(None).cast("string").alias("content_type"), F.lit(False).alias("deleted"))
    late, early = rows.where("seq >= 500"), rows.where("seq < 500")
    assert table.apply(late, "a", 0) and table.apply(early, "a", 1) and table.snapshot().count() == 1000
    assert not table.apply(late, "a", 1) and not table.apply(early, "a", 0) and len(table.manifest.read()) == 2
    assert table.high_water() == 999 and table.due() == [0]
    table.apply(rows.where("false"))
    folders = [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("segment-") and "." not in p.name]
    assert len(folders) == 2  # an empty batch leaves nothing
    table.run_due()
    assert table.highest_level() == 1 and table.snapshot().count() == 1000
    was = table.manifest.state()
    table.manifest.publish(was, [])
    with pytest.raises(RuntimeError):
        table.manifest.publish(was, [])


def test_lookups_read_few_segments(spark, tmp_path):
    table = LogTable(spark, f"file://{tmp_path}/t", Settings(keys_of_block=8, keys_of_segment=99))
    table.load(spark.range(2000).select(F.format_string("k%05d", F.col("id") * 7).alias("key"), F.col("id").alias("seq"), F.current_timestamp().alias("ts"), F.col("id").cast("string").cast("binary").alias("value"), F.lit("t").alias("content_type"), (F.col("id") % 10 == 3).alias("deleted"), (F.col("id") % 20).alias("file_no")))
    assert len(table.manifest.read()) == 20
    keys = [f"k{i:05d}" for i in (0, 7, 21, 35, 1, 13993, 20000)]
    assert [table.get(k) for k in keys] == [b"0", b"1", None, b"5", None, b"1999", None]
    read = sum(len(of) for of in table.maybe([f"k{7 * i:05d}" for i in range(0, 2000, 20)]).values())
    assert 100 <= read <= 100 * (1 + 20 / 50)  # one each, and few for nothing
    table.merge(0)
    sizes = [s["entries"] for s in table.manifest.read()]
    assert len(sizes) == 20 and sum(sizes) == 1800 and [table.get(k) for k in keys] == [b"0", b"1", None, b"5", None, b"1999", None]
    assert table.sparse_index().agg(F.sum("entries")).first()[0] == 1800 and table.vacuum() == 1


def many_segments(spark, path: str) -> LogTable:
    """300 segments of 40 keys each, of 1000 keys in all; one in seven rows is a tombstone."""
    table = LogTable(spark, path, Settings(keys_of_block=8, keys_of_segment=99))
    key = F.format_string("k%04d", F.col("id") * 7 % 1000)
    table.load(spark.range(12_000).select(key.alias("key"), F.col("id").alias("seq"), F.current_timestamp().alias("ts"), F.col("id").cast("string").cast("binary").alias("value"), F.lit("t").alias("content_type"), (F.col("id") % 7 == 3).alias("deleted"), F.expr("id div 40").alias("file_no")))
    return table


def held_by_many(keys: list[str]) -> dict:
    last = {f"k{i * 7 % 1000:04d}": i for i in range(12_000)}
    return {k: str(last[k]).encode() if k in last and last[k] % 7 != 3 else None for k in keys}


def test_files_go_by_bytes_not_by_segments(spark, tmp_path):
    table = many_segments(spark, f"file://{tmp_path}/t")
    assert len(table.manifest.read()) == 300
    files = lambda: len([p for p in (tmp_path / "t").rglob("*.parquet")])
    assert files() <= 3 * 8  # data, index and filters, a few tasks each
    some = [s for s in table.manifest.read() if s["file"] % 2 or s["file"] > 200]
    assert {r.file_no for r in table._read(some).select("file_no").distinct().collect()} == {s["file"] for s in some}
    table.merge(0)
    assert len(table.manifest.read()) == 10 and table.vacuum() == 1 and files() <= 3 * 8
    table.compact(1)
    got = {r.key: bytes(r.value) for r in table.snapshot().collect()}
    assert got == {k: v for k, v in held_by_many([f"k{i:04d}" for i in range(1000)]).items() if v is not None}


def test_lookups_of_many_keys_are_one(spark, tmp_path):
    """Jobs don't go by the number of keys."""
    table = many_segments(spark, f"file://{tmp_path}/t")
    jobs = {}
    for n in (2, 40):
        keys = [f"k{i * 25:04d}" for i in range(n)] + ["none", "k0001x"]
        spark.sparkContext.setJobGroup(f"lookup-{n}", "")
        got = table.get_all(keys)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"lookup-{n}"))
        assert got == held_by_many(keys)
    assert 0 < jobs[40] <= jobs[2] + 2


def test_filters_are_not_collected(spark, tmp_path, monkeypatch):
    """Of the Bloom filters of 300 segments the driver gets which passed, not their words."""
    table, kind, rows = many_segments(spark, f"file://{tmp_path}/t"), type(spark.range(1)), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: rows.append(len(out := collect(self))) or out)
    keys = [f"k{i * 50:04d}" for i in range(20)]
    near = table.maybe(keys)
    holding = {k: {i // 40 for i in range(12_000) if f"k{i * 7 % 1000:04d}" == k} for k in keys}
    assert all({s["file"] for s in near[k]} >= holding[k] for k in keys)
    assert max(rows) < 1.5 * sum(len(of) for of in holding.values())


def test_stream_counters_share_states(spark, tmp_path):
    """Counts go on from batch to batch, null keys too, with a state for each bucket, not for each key."""
    key = F.when(F.col("id") % 11 != 5, F.concat(F.lit("k"), F.col("id") % 2000))
    log = spark.range(9000).select(key.alias("key"), F.col("id").alias("seq"), (F.col("id") % 13 == 7).alias("deleted"))
    for part in range(3):  # a batch each
        log.where(F.col("seq").between(part * 3000, part * 3000 + 2999)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ingest.ROCKSDB)
    try:
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        run = ingest.counters(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert len([p for p in run.recentProgress if p["numInputRows"]]) == 3
    assert 0 < run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1024
    got, n = {r.seq: (r.key, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()}, {}
    for r in sorted(log.collect(), key=lambda r: r.seq):
        if not r.deleted:
            assert got.pop(r.seq) == (r.key, n.get(r.key, 0))
        n[r.key] = 0 if r.deleted else n.get(r.key, 0) + 1
    assert not got


@pytest.fixture
def sixteen(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_places_of_many_keys(sixteen):
    """Places, offsets, blocks and floors of 100,000 keys are those of a sorted list."""
    keys = sorted(str(i * 7919) for i in range(100_000))
    rows = sixteen.range(100_000).select((F.col("id") * 7919).cast("string").alias("key"))
    got = changelog.placed(rows, F.length("key").cast("long") + 9).toPandas().sort_values("place")
    assert got["key"].tolist() == keys and got["place"].tolist() == list(range(100_000))
    assert got["byte_offset"].tolist() == [0, *itertools.accumulate(len(k) + 9 for k in keys)][:-1]
    anchors = keys[5::10]
    probes = sixteen.range(20_000).select((F.col("id") * 31337 % 9_999_991).cast("string").alias("probe"))
    found = changelog.floor_lookup(probes, sixteen.createDataFrame([(k,) for k in anchors], "key string")).collect()
    assert len(found) == 20_000
    for r in found:
        at = bisect.bisect_right(anchors, r.probe) - 1
        assert (r.pos, r.key) == (at, anchors[at] if at >= 0 else None)


def test_hot_counter_over_many_tasks(sixteen):
    """One key has nearly all rows; its count goes on from range to range and restarts after a delete."""
    log = sixteen.range(200_000).select(F.when(F.col("id") % 50 == 0, F.concat(F.lit("k"), (F.col("id") % 300).cast("string"))).otherwise("hot").alias("key"), F.col("id").alias("seq"), F.col("id").isin(77_777, 150_001, 150_002).alias("deleted"))
    parts = changelog.ranged(log, "key", "seq")
    assert parts.where("key = 'hot'").select("part").distinct().count() > 8
    got, n = {(r.key, r.seq): r.n for r in changelog.counters(log).collect()}, {}
    for r in sorted(log.collect(), key=lambda r: r.seq):
        if r.deleted:
            n[r.key] = 0
        else:
            assert got.pop((r.key, r.seq)) == n.get(r.key, 0)
            n[r.key] = n.get(r.key, 0) + 1
    assert not got
    states = log.withColumn("state", F.when(F.col("seq") % 70_000 == 1, F.col("seq")))
    last: dict = {}
    known = {r.seq: r.before for r in changelog.state_before(states, "key", "seq", "state").collect()}
    for r in sorted(states.collect(), key=lambda r: r.seq):
        assert known[r.seq] == last.get(r.key)
        last[r.key] = r.state if r.state is not None else last.get(r.key)


def test_append_log(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    assert wal.read_append_log(spark, path)[0].isEmpty()
    wal.write_append_log(spark.createDataFrame([("/kv/a", b"1", "text/plain", False), ("/kv/b", None, None, True)], "key string, value binary, content_type string, deleted boolean"), path)
    (tmp_path / "store" / "bad.txt").write_text("{no line")
    good, bad = wal.read_append_log(spark, path)
    assert sorted((r.key, r.value and bytes(r.value), r.content_type, r.deleted) for r in good.collect()) == [("/kv/a", b"1", "text/plain", False), ("/kv/b", None, "", True)] and bad.count() == 1
    assert wal.reset(spark, path) and not wal.reset(spark, path) and wal.read_append_log(spark, path)[0].isEmpty()


def test_filters_of_two_sizes_are_not_united(spark):
    keys = spark.range(5).select(F.col("id").cast("string").alias("key"))
    with pytest.raises(ValueError):
        bloom.union(bloom.build(keys, 4, 2), bloom.build(keys, 8, 2), words=(4, 8))


def test_codecs(spark):
    df = spark.createDataFrame([("",), ("hello",), ("hello, world",), ("19 Jan 2038 at 3:14:07 AM",), ("The quick brown fox jumps over the lazy dog.",)], "s string")
    assert [r[0] for r in df.select(codec.murmur3_hex(F.col("s"))).collect()] == [
        "0" * 32, "cbd8a7b341bd9b025b1e906a48ae1d19", "342fac623a5ebc8e4cdcbc079642414d", "b89e5988b737affc664fc2950231b2cb", "cd99481f9ee902c9695da1a38987b6e7",
    ]
    row = spark.range(1).select(codec.encode_counter(F.lit(261)).alias("b"), codec.decode_counter(codec.encode_counter(F.lit((1 << 32) + 5))).alias("n"), codec.decode_counter(F.unhex(F.lit("0501"))).alias("bad")).first()
    assert bytes(row.b) == b"\x05\x01\x00\x00" and row.n == 5 and row.bad is None


def test_estimate_of_full_filter(spark):
    """A full filter tells no number of keys, and is no error."""
    keys = spark.range(2000).select(F.col("id").cast("string").alias("key"))
    assert bloom.estimate(bloom.build(keys, 4, 8), 4, 8).collect() == [(256, None)]
    few = bloom.estimate(bloom.build(keys.where("key < 5"), 1024, 8), 1024, 8).first()
    assert abs(few.keys - keys.where("key < 5").count()) <= 1


@pytest.mark.parametrize("p", [2, 16, 128])
def test_filters_have_no_false_negatives(spark, p):
    words, lookups = bloom.size_for(500, p)
    keys = spark.range(500).select(F.col("id").cast("string").alias("key"))
    got = bloom.test(spark.range(3000).select(F.col("id").cast("string").alias("key")), bloom.build(keys, words, lookups), words, lookups)
    maybe = {int(r.key) for r in got.where("maybe").collect()}
    assert maybe >= set(range(500)) and len(maybe) < 500 + 2 * 2500 / p


def test_size_rule():
    assert bloom.size_for(5000, 200) == (1024, 8)


def test_log_lines(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, b"1", False), ("é", 2, None, True)], "key string, seq long, value binary, deleted boolean").withColumn("ts", F.timestamp_seconds(F.lit(7)))
    wal.write(log, f"file://{tmp_path}/wal")
    (tmp_path / "wal" / "bad.txt").write_text('{"Id": 3, "Key"')
    good, bad = wal.read(spark, f"file://{tmp_path}/wal")
    assert sorted((r.key, r.seq, r.value and bytes(r.value), r.deleted) for r in good.collect()) == [("a", 1, b"1", False), ("é", 2, None, True)]
    assert bad.count() == 1 and wal.replayable(good, 1).count() == 1


def test_floor_lookup(spark):
    anchors, probes = (spark.createDataFrame([(x,) for x in xs], f"{c} string") for c, xs in (("key", ["ee", "jj", "pp", "uu"]), ("probe", ["aa", "dc", "ee", "gg", "jj", "ll", "ss", "zz"])))
    got = {r.probe: r.pos for r in changelog.floor_lookup(probes, anchors).collect()}
    assert got == {"aa": -1, "dc": -1, "ee": 0, "gg": 0, "jj": 1, "ll": 1, "ss": 2, "zz": 3}
