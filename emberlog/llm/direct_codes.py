"""Directly addressable codes for token ids.

A segment splits every id into chunks of fixed widths, one level each. A bitmap beside each level but
the last says which ids go on in the next level; its rank directory counts the ones before each
512-bit word, so the place of any id in the next level is found without decoding what comes before.
Several documents share a segment; their ends are kept beside it. Segments are rows of a Parquet
table, in ascending order, so any store that Spark writes to can hold them.

Format of a segment (little-endian): "DAC1", count u8 of levels, then u8 width in bits and u64 items
for each level; then for each level its chunks (u8 each where the width is at most 8, else u16), its
continuation bitmap (bits in little order, padded to 64 bytes) and its directory (u32 for each 64 bytes);
the last level has neither bitmap nor directory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, pretokens

#: Bits of each level, the lowest first; the last must take what is left of the largest id.
WIDTHS = (8, 8, 16)
#: Ids after which a segment is closed.
SEGMENT_IDS = 1 << 20
SEGMENTS = "part int, inner long, n_ids long, doc_ids array<bigint>, ends array<bigint>, data binary"
_SCHEMA = pa.schema([("part", pa.int32()), ("inner", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("data", pa.binary())])


def compress(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """Ids (unsigned, below 2 ** sum(widths)) as one segment."""
    kind = np.uint32 if sum(widths) <= 32 else np.uint64
    rest, levels = np.asarray(ids, kind), []
    for k, width in enumerate(widths):
        chunk = (rest & kind((1 << width) - 1)).astype("<u1" if width <= 8 else "<u2")
        parts = [chunk.tobytes()]
        if k + 1 < len(widths):
            rest = rest >> kind(width)
            more = rest > 0
            bits = np.packbits(more, bitorder="little").tobytes()
            bits += bytes(-len(bits) % 64)
            words = np.bitwise_count(np.frombuffer(bits, np.uint8)).reshape(-1, 64).sum(1, dtype=np.uint32) if bits else np.zeros(0, np.uint32)
            parts += [bits, (np.cumsum(words, dtype=np.uint32) - words).astype("<u4").tobytes()]
            rest = rest[more]
        levels.append((width, len(chunk), b"".join(parts)))
    head = b"DAC1" + bytes([len(levels)]) + b"".join(bytes([w]) + n.to_bytes(8, "little") for w, n, _ in levels)
    return head + b"".join(x for _, _, x in levels)


class Segment:
    """Random access to the ids of a segment."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1":
            raise ValueError("not a segment of directly addressable codes")
        count, at, self.levels = data[4], 5, []
        heads = [(data[at + 9 * k], int.from_bytes(data[at + 9 * k + 1 : at + 9 * k + 9], "little")) for k in range(count)]
        at += 9 * count
        for k, (width, n) in enumerate(heads):
            chunks = np.frombuffer(data, "<u1" if width <= 8 else "<u2", n, at)
            at += chunks.nbytes
            bits = ranks = None
            if k + 1 < count:
                words = (n + 511) // 512
                bits, ranks = np.frombuffer(data, np.uint8, 64 * words, at), np.frombuffer(data, "<u4", words, at + 64 * words)
                at += 68 * words
            self.levels.append((width, chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][1])

    def at(self, i: int) -> int:
        """The id at one place: a look at each level, with a rank from the directory and one word's bits."""
        value = shift = 0
        for width, chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            shift += width
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                return value
            word = int.from_bytes(bits[i >> 9 << 6 : (i >> 9 << 6) + 64].tobytes(), "little")
            i = int(ranks[i >> 9]) + (word & ((1 << (i & 511)) - 1)).bit_count()
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids of a run of places; reads only the chunks of that run in each level."""
        out, places, shift = np.zeros(end - start, np.uint32), None, 0
        for width, chunks, bits, ranks in self.levels:
            got = chunks[start:end].astype(np.uint32) << np.uint32(shift)
            if places is None:
                out |= got
            else:
                out[places] |= got
            shift += width
            if bits is None or end == start:
                break
            run = np.unpackbits(bits[start >> 3 : (end + 7) >> 3], bitorder="little")[start & 7 :][: end - start]
            word = start >> 9
            before = int(ranks[word]) + int(np.bitwise_count(bits[word << 6 : start >> 3]).sum())
            if start & 7:
                before += (int(bits[start >> 3]) & ((1 << (start & 7)) - 1)).bit_count()
            on = np.flatnonzero(run)
            places = on if places is None else places[on]
            start, end = before, before + len(on)
        return out


def write_segments(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """The ids of all documents and end_id after each, in ascending doc_id order, as segments of a stored table.

    A null text is an empty one (its only id is end_id). Rows with equal doc_id follow each other in any order,
    null doc_ids come first; other columns aren't read; an empty table gives no segments. A document never
    spans segments, so a very long one makes a long segment. ``inner``: ids in earlier segments of its part."""
    spark = docs.sparkSession
    common.bounded_batches(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, part, made = pretokens.unit_cache(tokenizer), TaskContext.get().partitionId(), 0  # ids in segments made
        ids, doc_ids, ends, n = [], [], [], 0

        def segment():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([made]), pa.array([n]), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([compress(np.concatenate(ids))], pa.binary())], schema=_SCHEMA)

        for b in batches:
            flat, begins = cache.encode(b.column("text"))
            sizes = np.diff(begins) + 1
            with_end = np.full(int(sizes.sum()), end_id, np.uint32)
            closing = np.cumsum(sizes)
            keep = np.ones(len(with_end), bool)
            keep[closing - 1] = False
            with_end[keep] = flat
            at = 0
            for i, d in enumerate(b.column("doc_id").to_pylist()):
                doc_ids.append(d)
                n += int(sizes[i])
                ends.append(n)
                if n >= SEGMENT_IDS:
                    ids.append(with_end[at : closing[i]])
                    yield segment()
                    at, made, ids, doc_ids, ends, n = closing[i], made + n, [], [], [], 0
            if at < len(with_end):
                ids.append(with_end[at:])
        if doc_ids:
            yield segment()

    ordered = common.id_text(docs).repartitionByRange(common.parallelism(spark), "doc_id").sortWithinPartitions("doc_id")
    return common.stored(ordered.mapInArrow(rows, SEGMENTS))


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the segments alone."""
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("ids"))  # a row for each task that wrote
    before_part = sums.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("part_start"))
    placed = segments.join(F.broadcast(before_part), "part").withColumn("first", F.col("part_start") + F.col("inner"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, doc_ids, ends, data in zip(b.column("first").to_pylist(), b.column("doc_ids"), b.column("ends"), b.column("data")):
                ends = np.asarray(ends.values, np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                segment = Segment(data.as_py())
                all_ids = segment.slice(0, len(segment)).astype("<u4")
                crc = [zlib.crc32(all_ids[a:e]) for a, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(starts + first), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("first", "doc_ids", "ends", "data").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_direct_codes(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return read_documents(write_segments(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
