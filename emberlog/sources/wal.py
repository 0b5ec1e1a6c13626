"""Write-ahead log lines: JSON objects Id, Key, Value (base64 or null), Deleted, Time (seconds)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "Id long, Key string, Value string, Deleted boolean, Time long, _bad string"
APPEND_LINE = "Key string, Data string, ContentType string, Deleted boolean, _bad string"


def to_lines(log: DataFrame) -> DataFrame:
    """A column line for each row (seq, key, value, deleted, ts)."""
    fields = F.struct(F.col("seq").alias("Id"), F.col("key").alias("Key"), F.base64(F.col("value").cast("binary")).alias("Value"), F.col("deleted").alias("Deleted"), F.unix_timestamp("ts").alias("Time"))
    return log.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("line"))


def from_lines(lines: DataFrame) -> DataFrame:
    """Rows (seq, key, ts, value, deleted, bad) of a column line; bad holds a line that can't be read, whose other columns are null."""
    got = F.from_json("line", LINE, {"columnNameOfCorruptRecord": "_bad"}).alias("e")
    return lines.select(got).select(F.col("e.Id").alias("seq"), F.col("e.Key").alias("key"), F.timestamp_seconds("e.Time").alias("ts"), F.unbase64("e.Value").alias("value"), F.col("e.Deleted").alias("deleted"), F.col("e._bad").alias("bad"))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries, and the lines that couldn't be read."""
    rows = from_lines(spark.read.text(path).withColumnRenamed("value", "line"))
    return rows.where("bad is null").drop("bad"), rows.where("bad is not null").select("bad")


def write(log: DataFrame, path: str) -> None:
    to_lines(log).write.mode("append").text(path)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it has it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def reset(spark: SparkSession, path: str) -> bool:
    """Remove a log (of either format) with all its lines; whether there was one."""
    files, at = _files(spark, path)
    return bool(files.delete(at, True))


def to_append_lines(log: DataFrame) -> DataFrame:
    """A column line in the older format for each row (key, value, content_type, deleted)."""
    fields = F.struct(F.col("key").alias("Key"), F.base64(F.col("value").cast("binary")).alias("Data"), F.coalesce("content_type", F.lit("")).alias("ContentType"), F.col("deleted").alias("Deleted"))
    return log.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("line"))


def write_append_log(log: DataFrame, path: str) -> None:
    """Append rows (key, value, content_type, deleted) to a log of the older format."""
    to_append_lines(log).write.mode("append").text(path)


def from_append_lines(lines: DataFrame) -> DataFrame:
    """Rows (key, value, content_type, deleted, bad) of a column line of the older format."""
    got = F.from_json("line", APPEND_LINE, {"columnNameOfCorruptRecord": "_bad"}).alias("e")
    return lines.select(got).select(F.col("e.Key").alias("key"), F.unbase64("e.Data").alias("value"), F.col("e.ContentType").alias("content_type"), F.col("e.Deleted").alias("deleted"), F.col("e._bad").alias("bad"))


def read_append_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries of a log of the older format, and the lines that couldn't be read; a log that isn't there is empty."""
    files, at = _files(spark, path)
    lines = spark.read.text(path).withColumnRenamed("value", "line") if files.exists(at) else spark.createDataFrame([], "line string")
    rows = from_append_lines(lines)
    return rows.where("bad is null").drop("bad"), rows.where("bad is not null").select("bad")


def replayable(log: DataFrame, high_water: int) -> DataFrame:
    """What recovery applies again: entries above the highest sequence number that segments hold."""
    return log.where(F.col("seq") > high_water)
