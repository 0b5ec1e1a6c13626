"""Shared helpers of the training-data operators: shared storage, batches and plain columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that a Python worker gets at once; bounds worker memory for long texts.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
#: Keys that a join deals over several tasks, at most, and over how many.
HOT_KEYS, SALTS = 1000, 32
#: Bits of a sieve for each key, words of 64 bits in a part of it, and parts at most (8 MB in all).
SIEVE_BITS, SIEVE_WORDS, SIEVE_PARTS = 16, 1024, 1024


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only where that is unset and all runs on one machine (tests), a local folder is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        # sparkContext keeps what an earlier call has set
        current = spark.sparkContext.getCheckpointDir()
        if not current:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="emberlog-"))
            current = spark.sparkContext.getCheckpointDir()
        base = current
    return f"{base.rstrip('/')}/emberlog-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: computed once, survives executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes for this session (results don't depend on it)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text is an empty text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def spread_join(big: DataFrame, small: DataFrame, on: list[str], weight: str, salt_by: list[str], how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, which has a row for each key and, in ``weight``, how many rows of ``big`` have it.

    Keys of more than a HOT_KEYS-th of the weight, so fewer than HOT_KEYS of them, are dealt over SALTS tasks by a
    hash of ``salt_by``; their rows of ``small`` go to each of these. So are keys that are null, which match nothing."""
    total = small.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT_KEYS > F.lit(total)
    marks = small.where(hot).select(*on, F.lit(True).alias("_hot"))  # fewer than HOT_KEYS rows
    dealt = big.join(F.broadcast(marks), on, "left")
    spread = F.col("_hot").isNotNull()
    for c in on:
        spread = spread | F.col(c).isNull()
    dealt = dealt.withColumn("_salt", F.when(spread, F.pmod(F.xxhash64(*salt_by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(hot, SALTS - 1).otherwise(0)))).drop(weight)
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


def sieved(big: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of ``big`` whose ``on``, a 64-bit hash, is one of ``keys``, and a few (about 1 in 70) of the others, never a row less.

    A Bloom filter of bounded size is broadcast for it, so that a join with ``keys`` afterwards needn't move all of ``big``.
    More keys than it was made for (4 million) let more of the others through. A null hash isn't one of the keys."""
    parts = min(SIEVE_PARTS, -(-keys.count() * SIEVE_BITS // (64 * SIEVE_WORDS)) or 1)
    part = F.pmod(F.col(on), F.lit(parts)).cast("int")
    bits = [F.pmod(F.xxhash64(on, F.lit(k)), F.lit(64 * SIEVE_WORDS)).cast("int") for k in range(2)]
    word, mask = lambda bit: F.floor(bit / 64).cast("int"), lambda bit: F.call_function("shiftleft", F.lit(1).cast("long"), bit % 64)
    of_keys = keys.where(F.col(on).isNotNull()).select(part.alias("part"), F.explode(F.array(*bits)).alias("bit"))
    cells = of_keys.select("part", word(F.col("bit")).alias("word"), mask(F.col("bit")).alias("bits"))
    blank = keys.sparkSession.range(parts * SIEVE_WORDS).select((F.col("id") % parts).cast("int").alias("part"), F.floor(F.col("id") / parts).cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    whole = cells.unionByName(blank).groupBy("part", "word").agg(F.bit_or("bits").alias("bits"))
    sieve = whole.groupBy(F.col("part").alias("_part")).agg(F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"].alias("_words"))
    same = part == F.col("_part")
    for bit in bits:
        same = same & (F.col("_words")[word(bit)].bitwiseAND(mask(bit)) != 0)
    return big.join(F.broadcast(sieve), same, "left_semi")


def without(docs: DataFrame, gone: DataFrame, keys: list[str], of_text: Callable[[Column], list[Column]]) -> DataFrame:
    """The rows of ``docs`` but for those whose doc_id and keys, which of_text() gives of their text, are rows of ``gone``.

    The columns of docs stand aside in a struct, so their names can't clash with those of the keys."""
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))
    marked = own.select("_row", F.col("_row.doc_id").cast("long").alias("_id"), *[k.alias(f"_{name}") for name, k in zip(keys, of_text(F.col("_row.text")))])
    out = gone.select(F.col("doc_id").alias("gone_id"), *[F.col(k).alias(f"gone_{k}") for k in keys]).distinct()
    same = F.col("_id").eqNullSafe(F.col("gone_id"))
    for k in keys:
        same = same & (F.col(f"_{k}") == F.col(f"gone_{k}"))
    return marked.join(out, same, "left_anti").select("_row.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Give memory that a worker has freed back to the system: workers live on, and the next stage's come beside them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def input_bytes(df: DataFrame) -> int:
    """The planner's estimate of how many bytes ``df`` has: of files their size; 0 where it knows none. Nothing is read."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
