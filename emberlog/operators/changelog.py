"""Queries over a changelog (key, seq, value, deleted): the latest version of a key by seq wins, a tombstone hides it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.sources import scratch

VERSION = ("seq", "value", "deleted")


def latest(log: DataFrame) -> DataFrame:
    """The latest version of each key, tombstones too. Aggregates before it shuffles, so hot keys are no matter."""
    return log.groupBy("key").agg(F.max_by(F.struct(*VERSION), "seq").alias("v")).select("key", "v.*")


def snapshot(log: DataFrame) -> DataFrame:
    """The live entries: latest() without tombstones. An empty value is live."""
    return latest(log).where("not deleted").drop("deleted")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    return snapshot(log.where(F.col("seq") <= seq))


def get(log: DataFrame, key: str) -> DataFrame:
    """The live entry of one key; the filter reaches the scan."""
    return snapshot(log.where(F.col("key") == key))


def multi_get(log: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, value, found) of every probe."""
    return probes.join(snapshot(log), "key", "left").select("key", "value", F.col("seq").isNotNull().alias("found"))


def exists(log: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.join(snapshot(log), "key", "left_semi")


def missing(log: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.join(snapshot(log), "key", "left_anti")


def ranged(rows: DataFrame, *keys: str) -> DataFrame:
    """rows in stored ranges of ``keys``, with the number of its range in a column part.

    Boundaries come from a sample, so the table is written once, and whatever is derived from it agrees."""
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scratch.stored(rows.repartitionByRange(count, *keys).withColumn("part", F.spark_partition_id()))


def placed(rows: DataFrame, size: Column | None = None) -> DataFrame:
    """rows of distinct keys with their place (from 0) in key order and, given the size of each, its byte_offset.

    Within ranges by windows, after the counts and sizes of the ranges before: no window is over all rows."""
    parts = ranged(rows.withColumn("_size", F.lit(0).cast("long") if size is None else size), "key")
    sums = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("bytes"))  # a row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("part").orderBy("key")
    own = parts.withColumn("place", F.row_number().over(within).cast("long") - 1).withColumn("byte_offset", F.sum("_size").over(within) - F.col("_size"))
    out = own.join(F.broadcast(starts), "part").withColumn("place", F.col("place") + F.col("first")).withColumn("byte_offset", F.col("byte_offset") + F.col("start"))
    return out.drop("part", "first", "start", "_size", *(["byte_offset"] if size is None else []))


def counters(log: DataFrame) -> DataFrame:
    """(key, seq, n) of every increment: 0 at first and after a delete, then one more each time, modulo 2 ** 32.

    Rows are dealt by ranges of key and seq, so a hot key is counted by many tasks; each goes on from the counts before."""
    parts = ranged(log.select("key", "seq", "deleted"), "key", "seq")
    # of the last key of a range: increments since the last delete, and whether there was one
    last_delete = F.max(F.when(F.col("deleted"), F.col("seq")))
    ends = parts.groupBy("part").agg(F.min("key").alias("part_first"), F.max("key").alias("last_key"))  # a row for each range
    tails = parts.join(F.broadcast(ends), "part").where(F.col("key") == F.col("last_key"))
    resets = tails.groupBy("part").agg(last_delete.alias("reset"))
    tails = tails.join(F.broadcast(resets), "part").groupBy("part").agg(F.max("reset").alias("reset"), F.count(F.when(~F.col("deleted") & (F.col("reset").isNull() | (F.col("seq") > F.col("reset"))), 1)).alias("tail"))
    by_key = Window.partitionBy("last_key").orderBy("part")
    state = ends.join(F.broadcast(tails), "part").withColumn("epoch", F.count("reset").over(by_key))
    state = state.withColumn("state", F.sum("tail").over(Window.partitionBy("last_key", "epoch").orderBy("part")))
    order = Window.orderBy("part")
    carry = state.select("part", "part_first", F.when(F.lag("last_key").over(order) == F.col("part_first"), F.lag("state").over(order)).otherwise(0).alias("carry"))
    within = Window.partitionBy("part", "key").orderBy("seq")
    runs = parts.withColumn("epoch", F.sum(F.col("deleted").cast("long")).over(within.rowsBetween(Window.unboundedPreceding, 0))).where("not deleted")
    n = F.row_number().over(Window.partitionBy("part", "key", "epoch").orderBy("seq")).cast("long") - 1
    goes_on = (F.col("epoch") == 0) & (F.col("key") == F.col("part_first"))
    return runs.withColumn("n", n).join(F.broadcast(carry), "part").select("key", "seq", ((F.col("n") + F.when(goes_on, F.col("carry")).otherwise(0)) % (1 << 32)).alias("n"))


def state_before(events: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """events with a column before: the last state of the key that isn't null in the events before, null if there is none.

    As counters(), by ranges of key and order, so that a hot key is split."""
    parts = ranged(events, key, order)
    ends = parts.groupBy("part").agg(F.min(key).alias("part_first"), F.max(key).alias("last_key"))  # a row for each range
    tails = parts.join(F.broadcast(ends), "part").where((F.col(key) == F.col("last_key")) & F.col(state).isNotNull()).groupBy("part").agg(F.max_by(state, order).alias("tail"))
    known = F.last("tail", ignorenulls=True).over(Window.partitionBy("last_key").orderBy("part"))
    after, by_part = ends.join(F.broadcast(tails), "part", "left").withColumn("known", known), Window.orderBy("part")
    carry = after.select("part", "part_first", F.when(F.lag("last_key").over(by_part) == F.col("part_first"), F.lag("known").over(by_part)).alias("carry"))
    within = Window.partitionBy("part", key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = parts.withColumn("before", F.last(state, ignorenulls=True).over(within)).join(F.broadcast(carry), "part")
    return own.withColumn("before", F.coalesce("before", F.when(F.col(key) == F.col("part_first"), F.col("carry")))).drop("part", "part_first", "carry")


def floor_lookup(probes: DataFrame, anchors: DataFrame) -> DataFrame:
    """(probe, key, pos): the greatest anchor key that isn't above the probe, and its place among the anchors (distinct keys); pos -1
    and a null key below the first.

    Anchors and distinct probes are dealt together by ranges; the last anchor and the number of anchors of the ranges before are carried on."""
    both = anchors.select("key", F.lit(True).alias("anchor")).unionByName(probes.select(F.col("probe").alias("key"), F.lit(False).alias("anchor")).distinct())
    parts = ranged(both, "key")
    anchor = F.when(F.col("anchor"), F.col("key"))
    ends = parts.groupBy("part").agg(F.max(anchor).alias("last"), F.count(anchor).alias("n"))  # a row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("part", F.max("last").over(before).alias("last"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    within = Window.partitionBy("part").orderBy("key", F.desc("anchor")).rowsBetween(Window.unboundedPreceding, 0)
    own = parts.withColumn("own", F.max(anchor).over(within)).withColumn("seen", F.count(anchor).over(within)).where("not anchor")
    found = own.join(F.broadcast(carry), "part").select(F.col("key").alias("probe"), F.coalesce("own", "last").alias("key"), (F.col("n") + F.col("seen") - 1).alias("pos"))
    return probes.select("probe").join(found, "probe").select("probe", "key", "pos")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_a, only_b): how many rows, counted as often as they come, only one side has."""
    count = lambda x, y, c: x.exceptAll(y).agg(F.count(F.lit(1)).alias(c))
    return count(a, b, "only_a").crossJoin(count(b, a, "only_b"))
