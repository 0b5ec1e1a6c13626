"""Leveled storage: immutable sorted Parquet segments under a manifest that is published as a whole.

A table is a folder of data folders and manifest files; the manifest of the highest number is
current. The segments that are written at once share the files of one folder, sorted by segment (column file_no) and key, so
the number of files goes by bytes, not by segments. Data are written before the manifest that names them, so a crash leaves the former state, and readers
keep the manifest they have read. One writer at a time: of two, one fails. Each segment has a sparse index (the first key
and the place of every block of its rows in their file) and a Bloom filter, both stored, so a lookup reads few blocks.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import bloom
from emberlog.functions.codec import entry_bytes
from emberlog.operators import changelog

SCHEMA = "key string, seq long, ts timestamp, value binary, content_type string, deleted boolean"
STORED = SCHEMA + ", file_no long"
INDEX = "file string, block long, first_key string, last_key string, entries long, file_no long"
FACTS = INDEX + ", max_seq long, bytes long, max_ts long"
#: Rows of a page, which a reader skips by its lowest and highest segment and key; runs of segments that a filter names one by one.
PAGE_ROWS, RUNS = 1000, 32


@dataclass(frozen=True)
class Settings:
    """max_levels: merging into it compacts in place; segments, bytes, seconds: what makes merges due (0: never).

    keys_of_segment: a merge makes segments of so many keys and one more (0: one segment); keys_of_block: of the sparse
    index; one_in: a Bloom filter passes fewer than one in so many keys that a segment doesn't have."""

    max_levels: int = 4
    segments_of_level: int = 4
    level_bytes: int = 0
    window_seconds: int = 0
    keys_of_segment: int = 0
    keys_of_block: int = 100
    one_in: int = 200


class Manifest:
    """Which segments each level has, and which batch of each source was applied last."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(self.root)
        self._last: dict = {"number": 0, "segments": [], "batches": {}}

    def _numbers(self) -> list[int]:
        names = [f.getPath().getName() for f in self.files.listStatus(self.root)]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def state(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "segments": [], "batches": {}}
        if numbers[-1] != self._last["number"]:  # a manifest never changes
            rows = self.spark.read.text(f"{self.path}/manifest-{numbers[-1]}.json", wholetext=True).collect()  # one row
            self._last = {"number": numbers[-1], **json.loads(rows[0][0])}
        return dict(self._last)

    def read(self) -> list[dict]:
        return self.state()["segments"]

    def publish(self, was: dict, segments: list[dict], batches: dict | None = None) -> None:
        """Follow the state ``was``. Written under another name, then renamed without overwriting, which is the commit:
        it fails if another writer was first. The file system's rename must be atomic."""
        number = was["number"] + 1
        new = self._at(f".{uuid.uuid4().hex}")
        out = self.files.create(new, False)
        out.write(bytearray(json.dumps({"segments": segments, "batches": was["batches"] if batches is None else batches}).encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.spark._jsc.hadoopConfiguration())
        option = jvm.org.apache.hadoop.fs.Options.Rename
        never = gateway.new_array(option, 1)
        never[0] = option.NONE
        try:
            context.rename(new, self._at(f"manifest-{number}.json"), never)
        except Exception as e:
            raise RuntimeError("another writer has published a manifest") from e


class LogTable:
    """A key-value table: batches of puts and deletes become level 0 segments; merges move them down."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings or Settings()
        self.manifest = Manifest(spark, self.path)

    def high_water(self) -> int:
        return max((s["max_seq"] for s in self.manifest.read()), default=0)

    def highest_level(self) -> int:
        return max((s["level"] for s in self.manifest.read()), default=-1)

    def _roots(self, segments: list[dict], schema: str, kind: str = "") -> list[tuple[str, DataFrame]]:
        """The folders of segments, each with its rows of the segments that are wanted."""
        roots: dict[str, list[dict]] = {}
        for s in segments:
            if s["entries"]:
                roots.setdefault(s["root"], []).append(s)
        return [(r, self._wanted(self.spark.read.schema(schema).parquet(f"{self.path}/{r}{kind}"), of)) for r, of in roots.items()]

    def _wanted(self, rows: DataFrame, segments: list[dict]) -> DataFrame:
        """Of the rows of a folder those of segments; all of them need no filter, many runs of numbers a join."""
        numbers = sorted({s["file"] for s in segments})
        if len(numbers) == segments[0].get("of"):
            return rows
        first = [n for i, n in enumerate(numbers) if not i or numbers[i - 1] != n - 1]
        if len(first) > RUNS:
            near = rows.where(F.col("file_no").between(numbers[0], numbers[-1]))
            return near.join(F.broadcast(self.spark.createDataFrame([(n,) for n in numbers], "file_no long")), "file_no", "left_semi")
        last = [n for i, n in enumerate(numbers) if i + 1 == len(numbers) or numbers[i + 1] != n + 1]
        return rows.where(reduce(lambda a, b: a | b, (F.col("file_no").between(*x) for x in zip(first, last))))

    def _read(self, segments: list[dict], schema: str = STORED, kind: str = "") -> DataFrame:
        """Rows of segments: each folder once."""
        parts = [rows for _, rows in self._roots(segments, schema, kind)]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, level: int) -> list[dict]:
        """A segment for each file_no of rows (of distinct keys within it), in files sorted by it and key; what the manifest keeps of them."""
        root = f"segment-{uuid.uuid4().hex}"
        ordered = rows.repartitionByRange("file_no", "key").sortWithinPartitions("file_no", "key")  # as many tasks as the size needs
        ordered.write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.path}/{root}")
        written = self.spark.read.schema(STORED).parquet(f"{self.path}/{root}")
        self._index(written, root)
        facts = self.spark.read.schema(FACTS).parquet(f"{self.path}/{root}.index").groupBy("file_no").agg(
            F.sum("entries").alias("entries"), F.min("first_key").alias("min_key"), F.max("last_key").alias("max_key"),
            *(F.max(c).alias(c) for c in ("max_seq", "max_ts")), F.sum("bytes").alias("bytes"),
        ).collect()  # fmt: skip  # a row for each segment, as the manifest has
        if not facts:
            for kind in ("", ".index"):
                self.manifest.files.delete(self.manifest._at(root + kind), True)
            return []
        words, lookups = bloom.size_for(max(f["entries"] for f in facts), self.settings.one_in)
        filters = bloom.build(written, words, lookups, by=("file_no",), distinct=True)
        filters.repartitionByRange("file_no", "word").sortWithinPartitions("file_no", "word").write.parquet(f"{self.path}/{root}.bloom")
        return [{"root": root, "file": f["file_no"], "of": len(facts), "level": level, "words": words, "lookups": lookups, **{k: v for k, v in f.asDict().items() if k != "file_no"}} for f in sorted(facts, key=lambda f: f["file_no"])]

    def _block(self):
        return (F.col("_metadata.row_index") / self.settings.keys_of_block).cast("long").alias("block")

    def _index(self, written: DataFrame, root: str) -> None:
        """Store the sparse index of segments, sorted by segment, and with it what the manifest wants of each block."""
        index = written.groupBy("file_no", F.col("_metadata.file_name").alias("file"), self._block()).agg(
            F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count(F.lit(1)).alias("entries"), F.max("seq").alias("max_seq"),
            F.sum(entry_bytes(F.col("key"), F.col("value"))).alias("bytes"), F.max(F.unix_timestamp("ts")).alias("max_ts"),
        )
        index.repartitionByRange("file_no", "first_key").sortWithinPartitions("file_no", "first_key").write.parquet(f"{self.path}/{root}.index")

    def sparse_index(self, segments: list[dict] | None = None) -> DataFrame:
        """(file_no, file, block, first_key, last_key, entries) of the blocks of segments, all by default."""
        return self._read(self.manifest.read() if segments is None else segments, INDEX, ".index")

    def maybe(self, keys: list[str]) -> dict[str, list[dict]]:
        """For each key the segments that may have it, by their key ranges and Bloom filters, newest level first."""
        roots: dict[str, list[dict]] = {}
        for s in self.manifest.read():
            if s["entries"]:
                roots.setdefault(s["root"], []).append(s)
        asked, reads = [], []
        for root, of in roots.items():
            low, high = min(s["min_key"] for s in of), max(s["max_key"] for s in of)
            near = [k for k in keys if low <= k <= high]
            for k in near:
                masks: dict[int, int] = {}
                for p in bloom.positions_of(k, of[0]["words"], of[0]["lookups"]):
                    masks[p // 64] = masks.get(p // 64, 0) | 1 << p % 64
                asked += [(root, k, word, mask - (mask >> 63 << 64), len(masks)) for word, mask in masks.items()]
            if near:
                reads.append(self.spark.read.schema("word long, bits long, file_no long").parquet(f"{self.path}/{root}.bloom").withColumn("root", F.lit(root)))
        found: dict[str, list[dict]] = {k: [] for k in keys}
        if not asked:
            return found
        wanted = F.broadcast(self.spark.createDataFrame(sorted(set(asked)), "root string, key string, word long, mask long, n long"))  # a few rows for each key and folder
        met = reduce(DataFrame.unionByName, reads).join(wanted, ["root", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
        passed = met.groupBy("root", "file_no", "key", "n").agg(F.count(F.lit(1)).alias("met")).where("met = n")
        by_file = {(s["root"], s["file"]): s for of in roots.values() for s in of}
        for r in passed.select("root", "file_no", "key").collect():  # the answer, and few more
            s = by_file.get((r.root, r.file_no))
            if s is not None and s["min_key"] <= r.key <= s["max_key"]:
                found[r.key].append(s)
        return {k: sorted(of, key=lambda s: (s["level"], s["root"], s["file"])) for k, of in found.items()}

    def _latest(self, rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by, "key").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in by]), "seq").alias("v")).select(*by, "v.*")

    def load(self, rows: DataFrame, level: int = 0) -> None:
        """Flush rows (key, seq, ts, value, content_type, deleted, file_no): the latest of each key of each file_no, a segment for each."""
        was = self.manifest.state()
        segments = self._write(self._latest(rows, "file_no"), level)
        if segments:
            self.manifest.publish(was, [*segments, *was["segments"]])

    def apply(self, batch: DataFrame, source: str | None = None, number: int | None = None) -> bool:
        """Flush a batch (key, seq, ts, value, content_type, deleted) as a level 0 segment; rows may come in any order.

        A batch of a source that has a number is applied once: one not above the last of that source changes nothing.
        Returns whether it was applied. Rows older than a tombstone that a merge has dropped would show again."""
        was = self.manifest.state()
        if source is not None and number <= was["batches"].get(source, -1):
            return False
        segments = self._write(self._latest(batch).withColumn("file_no", F.lit(0).cast("long")), 0)
        batches = was["batches"] if source is None else {**was["batches"], source: number}
        if segments or batches != was["batches"]:
            self.manifest.publish(was, [*segments, *was["segments"]], batches)
        return True

    def _rows(self, records: list[tuple]) -> DataFrame:
        mark = self.high_water()
        typed = [(k, mark + 1 + i, v, c, d) for i, (k, v, c, d) in enumerate(records)]
        return self.spark.createDataFrame(typed, "key string, seq long, value binary, content_type string, deleted boolean").withColumn("ts", F.current_timestamp())

    def write(self, changes: list[tuple[str, bytes | None, str | None, bool]]) -> None:
        """Flush a few changes (key, value, content type, deleted), in order."""
        self.apply(self._rows([(k, None if v is None else bytearray(v), c, d) for k, v, c, d in changes]))

    def put(self, entries: dict[str, bytes], content_type: str | None = None) -> None:
        self.write([(k, v, content_type, False) for k, v in entries.items()])

    def delete(self, keys: list[str]) -> None:
        """Tombstones; those of unknown keys are written too."""
        self.write([(k, None, None, True) for k in keys])

    def log(self) -> DataFrame:
        return self._read(self.manifest.read()).drop("file_no")

    def snapshot(self) -> DataFrame:
        return changelog.snapshot(self.log())

    def entries(self, keys: list[str]) -> dict:
        """The live rows (key, value, content_type) of the keys that have one. Key ranges, Bloom filters and the sparse index say
        which blocks of which files may have a key; of the rest only what shares a page with those is read."""
        near = self.maybe(keys)
        pairs = [(s["root"], s["file"], k) for k, of in near.items() for s in of]
        if not pairs:
            return {}
        segments = list({(s["root"], s["file"]): s for of in near.values() for s in of}.values())
        asked = F.broadcast(self.spark.createDataFrame(pairs, "root string, file_no long, key string"))
        index = reduce(DataFrame.unionByName, (rows.withColumn("root", F.lit(r)) for r, rows in self._roots(segments, INDEX, ".index")))
        blocks = index.join(asked, ["root", "file_no"]).where("first_key <= key and key <= last_key").select("root", "file_no", "file", "block", "key")
        wanted = sorted({k for _, _, k in pairs})
        near_key = F.col("key").isin(wanted) if len(wanted) <= RUNS else F.col("key").between(wanted[0], wanted[-1])
        data = (rows.where(near_key).select("*", F.col("_metadata.file_name").alias("file"), self._block(), F.lit(r).alias("root")) for r, rows in self._roots(segments, STORED))
        rows = reduce(DataFrame.unionByName, data).join(F.broadcast(blocks), ["root", "file_no", "file", "block", "key"])  # one block for each segment and key
        found = rows.groupBy("key").agg(F.max_by(F.struct("value", "content_type", "deleted"), "seq").alias("v")).select("key", "v.*").where("not deleted")
        return {r.key: r for r in found.collect()}  # as many as are asked for

    def entry(self, key: str):
        """The live row (key, value, content_type) or None, as entries()."""
        return self.entries([key]).get(key)

    def get(self, key: str) -> bytes | None:
        """The live value, empty ones too; None for a deleted or unknown key."""
        row = self.entry(key)
        return None if row is None else bytes(row.value or b"")

    def get_all(self, keys: list[str]) -> dict[str, bytes | None]:
        """get() of each key, at once."""
        found = self.entries(keys)
        return {k: bytes(found[k].value or b"") if k in found else None for k in keys}

    def exists(self, key: str) -> bool:
        return self.entry(key) is not None

    def increment(self, key: str) -> int:
        """0 at first or after a delete, else one more; stored in four bytes."""
        n = next_count(key, self.get(key))
        self.put({key: n.to_bytes(4, "little")})
        return n

    def _rewrite(self, was: dict, taken: list[dict], target: int, drop_tombstones: bool) -> None:
        rows = self._latest(self._read(taken).drop("file_no"))
        if self.settings.keys_of_segment:  # places count tombstones too
            rows = changelog.placed(rows).withColumn("file_no", F.expr(f"place div {self.settings.keys_of_segment + 1}")).drop("place")
        else:
            rows = rows.withColumn("file_no", F.lit(0).cast("long"))
        rows = rows.where("not deleted") if drop_tombstones else rows
        segments = self._write(rows, target)
        if not segments:  # a level stays a level
            segments = [{"root": "none", "file": 0, "of": 1, "level": target, "words": 1, "lookups": 1, "entries": 0, "min_key": "", "max_key": "", "bytes": 0, "max_ts": None}]
        mark = max(s["max_seq"] for s in taken)
        gone = {(s["root"], s["file"], s["level"]) for s in taken}
        kept = [s for s in was["segments"] if (s["root"], s["file"], s["level"]) not in gone]
        self.manifest.publish(was, kept + [{**s, "max_seq": mark} for s in segments])

    def merge(self, level: int) -> None:
        """All segments of a level and the next into the next; tombstones go if the level is the highest before."""
        was = self.manifest.state()
        highest = max((s["level"] for s in was["segments"]), default=-1)
        if level < 0 or level > highest:
            raise ValueError(f"no level {level}")
        if level > 0 and level == self.settings.max_levels:
            return self.compact(level)
        self._rewrite(was, [s for s in was["segments"] if s["level"] in (level, level + 1)], level + 1, level == highest)

    def compact(self, level: int) -> None:
        """Rewrite one level in place; level 0 can't be."""
        was = self.manifest.state()
        highest = max((s["level"] for s in was["segments"]), default=-1)
        if level < 1 or level > highest:
            raise ValueError(f"can't compact level {level}")
        self._rewrite(was, [s for s in was["segments"] if s["level"] == level], level, level == highest)

    def levels(self) -> dict[int, list[dict]]:
        by: dict[int, list[dict]] = {}
        for s in self.manifest.read():
            by.setdefault(s["level"], []).append(s)
        return dict(sorted(by.items()))

    def due(self, now: int | None = None) -> list[int]:
        """Levels whose number of segments, bytes or age make a merge due."""
        x = self.settings
        many = lambda i, of: x.segments_of_level and len(of) > x.segments_of_level * (i + 1)
        large = lambda of: x.level_bytes and sum(s["bytes"] or 0 for s in of) > x.level_bytes
        old = lambda of: x.window_seconds and now is not None and max(s["max_ts"] or 0 for s in of) < now - x.window_seconds
        return [i for i, of in self.levels().items() if many(i, of) or large(of) or old(of)]

    def run_due(self, now: int | None = None) -> None:
        for level in self.due(now):
            self.merge(level)

    def reset(self) -> None:
        """Everything goes: the next manifest has no segments. vacuum() removes the files."""
        self.manifest.publish(self.manifest.state(), [])

    def vacuum(self) -> int:
        """Remove folders that the current manifest doesn't name; returns of how many segment folders."""
        named, gone = {s["root"] for s in self.manifest.read()}, 0
        for f in self.manifest.files.listStatus(self.manifest.root):
            name = f.getPath().getName()
            if name.startswith("segment-") and name.split(".")[0] not in named:
                gone += bool(self.manifest.files.delete(f.getPath(), True)) and "." not in name
        return gone

    def stats(self) -> DataFrame:
        return self.snapshot().agg(F.count(F.lit(1)).alias("entries"), F.min("key").alias("first"), F.max("key").alias("last"))


def next_count(key: str, stored: bytes | None) -> int:
    """What an increment of a counter stored as four bytes, or not at all, gives."""
    if stored is not None and len(stored) != 4:
        raise ValueError(f"{key!r} holds no counter")
    return 0 if stored is None else (int.from_bytes(stored, "little") + 1) % (1 << 32)
