"""Quality by perplexity: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is over the bytes of whole texts, so contexts cross from word to word. N-grams are sharded by the two bytes
before the predicted one: a shard has all that orders 3 and up need, and what lies below is a table of at
most 65,536 numbers. Documents meet the model in blocks: a block sends each of its distinct n-grams once to the
shards and gets log probabilities back. A shard's requests are dealt over as many tasks as the blocks need.
Trusted texts are dealt in two: most are counted, the others, which the model has not seen, set the thresholds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blockdict, common

#: Bytes of an n-gram, the least order that a shard holds, and what stands before a text.
ORDER, LEAST, BEFORE = 5, 3, b"\n" * 4
#: Bytes of text of a block (a longer text is a block of its own), n-grams handled at a time, blocks that a shard's task answers.
BLOCK_BYTES, SLICE, BLOCKS_AT_ONCE = 16 << 20, 1 << 19, 512
#: One of so many trusted documents isn't counted but sets thresholds; their quantile; bytes beyond which a mean varies no less.
HELD, HIGH, STEADY = 5, 0.995, 2000
_BYTE = np.uint64(8)
_STATISTICS = 4 * (ORDER - LEAST + 1)


def grams(data: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Codes of the n-grams that end in each byte of the texts, one text after the other in ``data``, some at a time:
    the codes, the number of the first text, and how many codes of it and each following one."""
    back, ends, i = ORDER - 1, np.cumsum(lengths), 0
    while i < len(lengths):
        begin = int(ends[i] - lengths[i])
        j = max(i + 1, int(np.searchsorted(ends, begin + SLICE, "right")))
        pad, sizes = np.frombuffer(BEFORE, np.uint8), lengths[i:j].astype(np.int64)
        raw = np.concatenate([x for k in range(i, j) for x in (pad, data[ends[k] - lengths[k] : ends[k]])])
        at = np.arange(int(sizes.sum())) + np.repeat(back * np.arange(j - i), sizes) if j > i + 1 else np.arange(len(raw) - back)
        for a in range(0, len(at), SLICE):
            some = at[a : a + SLICE]
            window = raw[some[0] : some[-1] + ORDER].astype(np.uint64)
            codes = np.zeros(len(window) - back, np.uint64)
            for k in range(ORDER):
                codes = codes << _BYTE | window[k : k + len(codes)]
            yield codes[some - some[0]], i, sizes if j > i + 1 else np.asarray([len(some)])
        i = j


def distinct_grams(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of all texts, and how often each comes."""
    parts = [np.unique(codes, return_counts=True) for codes, _, _ in grams(data, lengths)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return summed(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes with the sums of their counts."""
    distinct, at = np.unique(codes, return_inverse=True)
    return distinct, np.bincount(at, counts, len(distinct)).astype(np.int64)


def suffix(codes: np.ndarray, order: int) -> np.ndarray:
    return codes & np.uint64((1 << 8 * order) - 1)


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """By the two bytes before the predicted one, which all suffixes of LEAST or more bytes share."""
    mixed = (suffix(codes, 3) >> _BYTE) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)
    return (mixed >> np.uint64(12)).astype(np.int64) % shards


def by_shard(codes: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard and the places of its codes; shards and, if the codes are, places in order."""
    of = shard_of(codes, shards)
    order = np.argsort(of, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else ():
        yield int(of[part[0]]), part


class Shard:
    """The counts of a shard: raw ones of the highest order, how many bytes go before below."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.grams = {ORDER: (codes, counts)}
        for n in range(ORDER - 1, LEAST - 1, -1):
            self.grams[n] = np.unique(suffix(self.grams[n + 1][0], n), return_counts=True)
        self.contexts = {}
        for n, (codes, counts) in self.grams.items():
            context, at = np.unique(codes >> _BYTE, return_inverse=True)
            sums = lambda w: np.bincount(at, w, len(context))  # noqa: B023, E731
            self.contexts[n] = (context, sums(counts), sums(counts == 1), sums(counts == 2), sums(counts >= 3))

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and numbers to sum over shards: how many n-grams of each order have a count of 1 to 4; from
        key _STATISTICS on, how many bytes go before each pair of bytes."""
        of = np.concatenate([np.bincount(np.minimum(self.grams[n][1], 5), minlength=6)[1:5] for n in range(LEAST, ORDER + 1)])
        pairs, before = np.unique(suffix(self.grams[LEAST][0], 2), return_counts=True)
        return np.concatenate([np.arange(_STATISTICS), _STATISTICS + pairs.astype(np.int64)]), np.concatenate([of, before]).astype(np.int64)

    def score(self, wanted: np.ndarray, base: Base) -> np.ndarray:
        """Log probability of the last byte of each n-gram."""
        p = base.pairs[suffix(wanted, 2).astype(np.int64)]
        for n in range(LEAST, ORDER + 1):
            codes, counts = self.grams[n]
            if not len(codes):
                break
            context, total, one, two, more = self.contexts[n]
            gram = suffix(wanted, n)
            c, known = _look(context, gram >> _BYTE)
            g, seen = _look(codes, gram)
            d = base.discounts[n]
            count = np.where(seen, counts[g], 0)
            rest = (d[1] * one + d[2] * two + d[3] * more)[c] / total[c]
            p = np.where(known, np.maximum(count - d[np.minimum(count, 3)], 0) / total[c] + rest * p, p)
        return np.log(p)


def _look(ordered: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
    return at, ordered[at] == wanted


def discounts_of(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """The three discounts of an order (none for a count of 0), from how many n-grams have a count of 1 to 4."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    steps = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.asarray([0, *(min(max(d, 0.05), k + 0.95) for k, d in enumerate(steps))])


class Base:
    """What all shards share: the discounts of each order, and the probability of a byte after a byte."""

    def __init__(self, statistics: dict[int, int]):
        self.discounts = {n: discounts_of(*(float(statistics.get(4 * (n - LEAST) + k, 0)) for k in range(4))) for n in range(LEAST, ORDER + 1)}
        before = np.zeros(1 << 16)
        for k, n in statistics.items():
            if k >= _STATISTICS:
                before[k - _STATISTICS] = n
        before = before.reshape(256, 256)
        single = (before > 0).sum(0) + 0.5
        single = single / single.sum()
        d = discounts_of(*(float((before == k).sum()) for k in range(1, 5)))
        total = before.sum(1, keepdims=True)
        rest = sum(d[k] * (before == k).sum(1, keepdims=True) for k in (1, 2)) + d[3] * (before >= 3).sum(1, keepdims=True)
        seen = np.maximum(before - d[np.minimum(before, 3).astype(int)], 0)
        self.pairs = np.where(total > 0, (seen + rest * single) / np.maximum(total, 1), single).reshape(-1)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, and their lengths."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8), np.diff(at)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined up to BLOCK_BYTES."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, body): the documents in stored blocks, compressed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for made, t in enumerate(_gathered(batches)):
            ids, langs = t.column("doc_id").combine_chunks(), t.column("lang").combine_chunks()
            data, lengths = _flat(t.column("text").combine_chunks())
            lang, lang_lengths = _flat(langs.fill_null(""))
            ends = np.cumsum(lengths)
            body = blockdict.pack(
                9, ids=np.asarray(ids.fill_null(0)), null=np.asarray(ids.is_null()).astype(np.uint8), n_bytes=lengths, lang=lang, lang_bytes=lang_lengths, lang_null=np.asarray(langs.is_null()).astype(np.uint8),
                crc32=np.fromiter((zlib.crc32(data[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())), np.int64, len(lengths)), text=data,
            )
            yield pa.RecordBatch.from_arrays([pa.array([part << 24 | made]), pa.array([body], pa.binary())], names=["block", "body"])
            del t, ids, langs, data, lang, body
            common.trim()

    return common.stored(_texts(docs).mapInArrow(rows, "block long, body binary"))


def _packed(codes: np.ndarray, **more: np.ndarray) -> bytes:
    return blockdict.pack(9, steps=np.diff(codes, prepend=np.uint64(0)), **more)


def _unpacked(data: bytes) -> tuple[np.ndarray, dict]:
    arrays = blockdict.unpack(data)
    return np.cumsum(arrays["steps"], dtype=np.uint64), arrays


def _model(texts: DataFrame, shards: int) -> DataFrame:
    """(shard, data): the distinct n-grams of the texts with their counts, stored."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches):
            codes, counts = distinct_grams(*_flat(t.column("text").combine_chunks()))
            out = [(s, _packed(codes[part], counts=blockdict.smallest(counts[part]))) for s, part in by_shard(codes, shards)]
            numbers, data = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(data, pa.binary())], names=["shard", "data"])
            del t, codes, counts, out, data
            common.trim()

    def merged(table: pa.Table) -> pa.Table:
        parts = [_unpacked(d) for d in table.column("data").to_pylist()]
        codes, counts = summed(np.concatenate([c for c, _ in parts]), np.concatenate([a["counts"] for _, a in parts]))
        return pa.table({"shard": table.column("shard")[:1], "data": pa.array([_packed(codes, counts=blockdict.smallest(counts))], pa.binary())})

    parts = texts.select("text").mapInArrow(counted, "shard int, data binary").withColumn("salt", F.pmod(F.xxhash64("data"), F.lit(common.SALTS)))
    # in two steps, so that no task merges the parts of all the text
    some = parts.repartition(common.parallelism(parts.sparkSession), "shard", "salt").groupBy("shard", "salt").applyInArrow(merged, "shard int, data binary")
    return common.stored(some.groupBy("shard").applyInArrow(merged, "shard int, data binary"))


def _shard(data: bytes | None) -> Shard:
    codes, arrays = _unpacked(data) if data is not None else (np.zeros(0, np.uint64), {"counts": np.zeros(0, np.int64)})
    return Shard(codes, arrays["counts"].astype(np.int64))


def _base(model: DataFrame) -> Base:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("data").to_pylist():
                keys, numbers = _shard(data).statistics()
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(numbers)], names=["i", "n"])

    got = model.mapInArrow(rows, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()  # at most 65,536 pairs and _STATISTICS numbers
    return Base({r.i: r.n for r in got})


def perplexities(docs: DataFrame, counted: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes, text_crc32, log_p and n_grams of every document, by a model of the documents in ``counted`` (doc_id).

    log_p sums the log probabilities of all n_grams of the text, one for each byte; an empty one has none. Rows with equal or
    null doc_id give a row each; of equal doc_ids in ``counted`` all texts are counted. Without any, all bytes are as likely."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    shards = min(4096, max(128, 8 * common.parallelism(spark)))
    blocks = _blocks(docs)
    # stored, so that the planner knows their size: it broadcasts the ids only if they are few
    wanted = common.stored(counted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct())
    model = _model(_texts(docs).join(wanted, "doc_id", "left_semi"), shards)
    base = spark.sparkContext.broadcast(_base(model))  # 65,536 numbers

    def requested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("body").to_pylist()):
                body = blockdict.unpack(data)
                codes, _ = distinct_grams(body["text"], body["n_bytes"])
                del body
                for s, part in by_shard(codes, shards):
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([block]), pa.array([_packed(codes[part])], pa.binary())], names=["shard", "block", "data"])
            common.trim()

    def answered(table: pa.Table) -> pa.Table:
        blocks, data = table.column("block").to_pylist(), table.column("data").to_pylist()
        shard = _shard(next((d for b, d in zip(blocks, data) if b is None), None))
        out = [(b, blockdict.pack(log_p=shard.score(_unpacked(d)[0], base.value).astype(np.float32))) for b, d in zip(blocks, data) if b is not None]
        blocks, data = zip(*out) if out else ((), ())
        return pa.table({"block": pa.array(blocks, pa.int64()), "shard": pa.array([table.column("shard")[0].as_py()] * len(out), pa.int32()), "data": pa.array(data, pa.binary())})

    turns = max(1, -(-blocks.count() // BLOCKS_AT_ONCE))
    asked = blocks.mapInArrow(requested, "shard int, block long, data binary").withColumn("turn", F.pmod(F.xxhash64("block"), F.lit(turns)))
    shown = model.select("shard", F.lit(None).cast("long").alias("block"), "data", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))).alias("turn"))
    tasks = common.parallelism(spark)  # few bytes, much work: the planner would make it too few tasks
    answers = asked.unionByName(shown).repartition(tasks, "shard", "turn").groupBy("shard", "turn").applyInArrow(answered, "block long, shard int, data binary")

    def finished(table: pa.Table) -> pa.Table:
        body, parts = None, []
        for shard, data in zip(table.column("shard").to_pylist(), table.column("data").to_pylist()):
            if shard is None:
                body = blockdict.unpack(data)
            else:
                parts.append((shard, blockdict.unpack(data)["log_p"]))
        codes, _ = distinct_grams(body["text"], body["n_bytes"])
        log_p = np.zeros(len(codes))
        for (_, answer), (_, part) in zip(sorted(parts, key=lambda x: x[0]), by_shard(codes, shards)):
            log_p[part] = answer
        total = np.zeros(len(body["ids"]))
        some = own = at = ends = None
        for some, first, sizes in grams(body["text"], body["n_bytes"]):
            own, at = np.unique(some, return_inverse=True)
            ends = np.concatenate([[0], np.cumsum(log_p[np.searchsorted(codes, own)][at])])
            stop = np.cumsum(sizes)
            total[first : first + len(sizes)] += ends[stop] - ends[stop - sizes]
        del body["text"], some, own, at, ends
        common.trim()
        lang = body["lang"].tobytes()
        ends = np.cumsum(body["lang_bytes"], dtype=np.int64).tolist()
        langs = [None if none else lang[a:e].decode() for a, e, none in zip([0, *ends], ends, body["lang_null"].tolist())]
        return pa.table({
            "doc_id": pa.array(body["ids"], mask=body["null"].astype(bool)), "lang": pa.array(langs, pa.string()), "n_bytes": body["n_bytes"], "text_crc32": body["crc32"],
            "log_p": total, "n_grams": body["n_bytes"],
        })

    both = answers.unionByName(blocks.select("block", F.lit(None).cast("int").alias("shard"), F.col("body").alias("data")))
    return both.repartition(tasks, "block").groupBy("block").applyInArrow(finished, "doc_id long, lang string, n_bytes long, text_crc32 long, log_p double, n_grams long")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_bytes, text_crc32, lang, perplexity, threshold and kept of every document.

    Trusted are documents with labels.quality = 1; one in HELD of them (by a hash of doc_id) isn't counted by the model. Of these,
    the HIGH quantile of how far a document's surprise (log perplexity of a byte) is above their median, times the root
    of its bytes (of at most STEADY), is taken by language. A document is kept if its own is at most that of its
    language: shorter texts vary more, so their threshold is higher. Languages without such trusted text (a null one too)
    use that of all trusted text. Empty texts have a null perplexity and threshold and are kept; without any trusted text
    that isn't counted all are. Rows with equal or null doc_id give a row each; of equal doc_ids, all texts count as
    trusted. An empty table gives no rows; other columns aren't read."""
    trusted = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0
    scores = perplexities(docs, trusted.where(~held))
    scores = common.stored(scores.withColumn("surprise", F.when(F.col("n_grams") > 0, -F.col("log_p") / F.col("n_grams"))).withColumn("root", F.sqrt(F.least("n_grams", F.lit(STEADY)).cast("double"))))
    unseen = common.stored(scores.where("surprise is not null").join(trusted.where(held), "doc_id", "left_semi").select("lang", "surprise", "root"))
    middle = lambda name: F.percentile_approx("surprise", 0.5, 10_000).alias(name)
    spread = lambda m, name: F.percentile_approx((F.col("surprise") - F.col(m)) * F.col("root"), HIGH, 10_000).alias(name)
    own = common.stored(unseen.where("lang is not null").groupBy("lang").agg(middle("own")))
    own_above = unseen.join(own, "lang").groupBy("lang").agg(F.first("own").alias("own"), spread("own", "own_above"))
    any_ = unseen.agg(middle("any"))
    any_above = unseen.crossJoin(F.broadcast(any_)).agg(F.first("any").alias("any"), spread("any", "any_above"))  # one row
    rows = scores.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    by_lang = common.stored(rows.join(own_above, "lang", "left"))
    out = common.spread_join(scores, by_lang, ["lang"], "rows", ["doc_id", "text_crc32"], "left").crossJoin(F.broadcast(any_above))
    threshold = F.coalesce(F.col("own") + F.col("own_above") / F.col("root"), F.col("any") + F.col("any_above") / F.col("root"))
    threshold = F.when(F.col("n_grams") > 0, threshold)
    return out.select("doc_id", "n_bytes", "text_crc32", "lang", F.exp("surprise").alias("perplexity"), F.exp(threshold).alias("threshold"), F.coalesce(F.col("surprise") <= threshold, F.lit(True)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps, with their columns, whatever these are called; nulls and repeats as there.

    Without trusted text, or for an empty table, that is all of them."""
    gone = quality(docs, labels).where("not kept").select("doc_id", "text_crc32")
    return common.without(docs, gone, ["text_crc32"], lambda text: [F.crc32(F.coalesce(text, F.lit("")).cast("binary"))])


def op4_quality(spark, sf_dir) -> DataFrame:
    return quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
