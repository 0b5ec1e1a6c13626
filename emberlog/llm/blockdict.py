"""Block dictionaries: texts as numbers into a dictionary for each block of documents.

A block holds some tens of MB of text. Its distinct pre-tokens leave it in buckets by hash, meet those
of the other blocks there, are valued once each over the whole corpus, and come back to their block,
whose documents wait there as arrays of numbers. A pre-token thus moves once for each block, not for
each occurrence, and a frequent one is no hot key: every block sends it once.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, pretokens

#: Bytes of text after which a block is closed; a longer single text is a block of its own. Bytes of input for each bucket, and buckets at most.
BLOCK_BYTES, BUCKET_BYTES, BUCKETS = 32 << 20, 32 << 20, 1 << 16
ENCODED = "block long, bucket int, entries binary, body binary"
_ENCODED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("entries", pa.binary()), ("body", pa.binary())])


def pack(level: int = 3, **arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes: the lowest bytes of an array's numbers first, then the next ones, as these are more alike."""
    head = "\n".join(f"{k} {a.dtype.str} {len(a)}" for k, a in arrays.items()).encode()
    return zstandard.compress(len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays.values()), level)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    raw, out = zstandard.decompress(data), {}
    at = 4 + int.from_bytes(raw[:4], "little")
    for line in raw[4:at].decode().split("\n"):
        name, dtype, n = line.split(" ")
        kind, n = np.dtype(dtype), int(n)
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out[name] = np.ascontiguousarray(planes.T).view(kind).reshape(n)
        at += out[name].nbytes
    return out


def smallest(a: np.ndarray) -> np.ndarray:
    """The array in as few bytes a number as its largest needs."""
    most = int(a.max()) if len(a) else 0
    return a.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4")


def split_ranks(ranks: np.ndarray) -> dict[str, np.ndarray]:
    """Numbers of which most are small: a byte each, and what exceeds it of those that need more."""
    low = np.minimum(ranks, 255).astype(np.uint8)
    return {"low": low, "rest": smallest(ranks[low == 255] - 255)}


def whole_ranks(low: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The numbers that split_ranks() had."""
    out = low.astype(np.uint32)
    out[low == 255] += rest
    return out


def number_pretokens(texts: pa.Array, find: Callable[[str], list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pre-tokens, the more frequent first; numbers of those of all texts; where each text begins."""
    units, codes, offsets = pretokens.numbered_units(texts)
    used = np.flatnonzero(np.bincount(codes, minlength=len(units)))
    numbers = pretokens.Numbering()
    get, lengths, flat = numbers.__getitem__, np.zeros(len(units), np.int64), []
    for i in used.tolist():
        found = find(pretokens.surface(units[i]))
        lengths[i] = len(found)
        flat += map(get, found)
    places, begins = pretokens.expanded(lengths, codes, offsets)
    tokens = np.asarray(flat, np.int32)[places]
    order = np.argsort(-np.bincount(tokens, minlength=len(numbers)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    keys = list(numbers)
    return [keys[i] for i in order.tolist()], rank[tokens], begins


def _as_bytes(items: list[bytes]) -> dict[str, np.ndarray]:
    return {"sizes": smallest(np.fromiter(map(len, items), np.int64, len(items))), "bytes": np.frombuffer(b"".join(items), np.uint8)}


def as_list(arrays: dict[str, np.ndarray]) -> list[bytes]:
    raw, ends = arrays["bytes"].tobytes(), np.cumsum(arrays["sizes"], dtype=np.int64).tolist()
    return [raw[a:e] for a, e in zip([0, *ends], ends)]


def _buckets(keys: list[str], count: int) -> Iterator[tuple[int, bytes]]:
    """The keys in buckets by hash, and their numbers as steps from one to the next, which compress well."""
    raw = [k.encode() for k in keys]
    of = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) % count
    order = np.argsort(of, kind="stable")
    of = of[order]
    for part in np.split(order, np.flatnonzero(np.diff(of)) + 1) if len(order) else ():
        yield zlib.crc32(raw[part[0]]) % count, pack(9, steps=smallest(np.diff(part, prepend=0)), **_as_bytes([raw[i] for i in part.tolist()]))


def numbers_of(entries: dict[str, np.ndarray]) -> list[int]:
    """The numbers of a bucket's keys, or of their values, in their block."""
    return np.cumsum(entries["steps"], dtype=np.int64).tolist()


def encode_blocks(docs: DataFrame, find: Callable[[], Callable[[str], list[str]]], body: Callable[..., bytes]) -> DataFrame:
    """Rows of dictionaries (block, bucket, entries) and one row (block, body) for each block, stored in the shared folder.

    find() gives, on a worker, the function that finds the pre-tokens of a text; body(doc_ids, texts, tokens, begins) what stays of a block."""
    common.bounded_batches(docs.sparkSession)
    # more input, more buckets: what a task of theirs gets doesn't grow
    count = max(4 * common.parallelism(docs.sparkSession), min(BUCKETS, common.input_bytes(docs) // BUCKET_BYTES))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        finder, part, made, held, size = find(), TaskContext.get().partitionId(), 0, [], 0

        def block(held):
            t = pa.Table.from_batches(held).combine_chunks()
            ids, texts = t.column("doc_id").combine_chunks(), t.column("text").combine_chunks()
            keys, tokens, begins = number_pretokens(texts, finder)
            no = part << 24 | made
            yield pa.RecordBatch.from_arrays([pa.array([no]), pa.array([-1], pa.int32()), pa.nulls(1, pa.binary()), pa.array([body(ids, texts, tokens, begins)], pa.binary())], schema=_ENCODED)
            for bucket, entries in _buckets(keys, count):
                yield pa.RecordBatch.from_arrays([pa.array([no]), pa.array([bucket], pa.int32()), pa.array([entries], pa.binary()), pa.nulls(1, pa.binary())], schema=_ENCODED)

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size >= BLOCK_BYTES:
                yield from block(held)
                made, held, size = made + 1, [], 0
        if held:
            yield from block(held)

    return common.stored(common.id_text(docs).mapInArrow(rows, ENCODED))


def valued(encoded: DataFrame, value: Callable[[], Callable[[list[str]], list[bytes]]]) -> DataFrame:
    """(block, entries) with the values of a bucket's keys for each block; each distinct key is valued once."""

    def one(table: pa.Table) -> pa.Table:
        numbers, each = pretokens.Numbering(), []
        for data in table.column("entries").to_pylist():
            arrays = unpack(data)
            each.append((arrays["steps"], [numbers[k] for k in as_list(arrays)]))
        values = value()([k.decode() for k in numbers])
        packed = [pack(9, steps=steps, **_as_bytes([values[i] for i in of])) for steps, of in each]
        return pa.table({"block": table.column("block"), "entries": pa.array(packed, pa.binary())})

    return encoded.where("bucket >= 0").select("bucket", "block", "entries").groupBy("bucket").applyInArrow(one, "block long, entries binary")


def joined(encoded: DataFrame, values: DataFrame, finish: Callable[[dict, list], pa.Table], schema: str) -> DataFrame:
    """finish(body, values by number) of every block, as rows of ``schema``."""

    def one(table: pa.Table) -> pa.Table:
        body, parts = None, []
        for data, entries in zip(table.column("body").to_pylist(), table.column("entries").to_pylist()):
            if data is not None:
                body = unpack(data)
            else:
                parts.append(unpack(entries))
        by_number: list = [b""] * sum(len(p["steps"]) for p in parts)
        for p in parts:
            for no, v in zip(numbers_of(p), as_list(p)):
                by_number[no] = v
        return finish(body, by_number)

    blocks = encoded.where("bucket < 0").select("block", "entries", "body")
    return values.withColumn("body", F.lit(None).cast("binary")).unionByName(blocks).groupBy("block").applyInArrow(one, schema)
