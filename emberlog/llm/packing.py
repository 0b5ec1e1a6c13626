"""Hierarchical residual packing of documents into sequences.

Every partition packs its pieces by best fit, longest first, and closes the bins that are nearly full.
The others become items, as long as what they hold, of the next round, in which the bins of several partitions
meet in one of the same number of items. Rounds go on until one partition is left, or until a round closes
or merges hardly any: what stays then has no partners, such as pieces of more than half a sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, pretokens

#: Items that a partition has about; share of a round's items that may stay open for there to be another round.
PART_ITEMS, WORTH = 40_000, 0.9
#: Bits of a partition, and of a bin within it, in the number of a bin; the round stands before them.
GROUP_BITS, BIN_BITS = 32, 25
PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, items in the given order, and how full each bin is then.

    An item goes to the fullest bin that has room for it. Free rooms are bits of one integer, so the
    smallest that suffices is found in a few steps."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used, bins, offsets = 0, [], np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        left = room - n
        if left:
            if not free[left]:
                mask |= 1 << left
            free[left].append(b)
    return bins, offsets, np.asarray(used, np.int64)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, lean: bool = False) -> DataFrame:
    """The documents' ids with end_id, cut at ``capacity`` where longer: a stored row for each piece."""
    common.bounded_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, part, made = pretokens.unit_cache(tokenizer, lean=lean), TaskContext.get().partitionId(), 0
        for b in batches:
            flat, begins = cache.encode(b.column("text"))
            out = []
            for doc_id, a, e in zip(b.column("doc_id").to_pylist(), begins.tolist(), begins[1:].tolist()):
                ids = np.empty(e - a + 1, "<u4")
                ids[:-1], ids[-1] = flat[a:e], end_id
                for k, at in enumerate(range(0, len(ids), capacity)):
                    some = ids[at : at + capacity]
                    out.append((part << 36 | made, doc_id, k, at, len(some), zlib.crc32(some)))
                    made += 1
            columns = list(zip(*out)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])
            del flat, begins, out, columns
            if lean:
                common.trim()

    return common.stored(common.id_text(docs).mapInArrow(rows, PIECES))


def _round(items: DataFrame, capacity: int, level: int, groups: int, enough: int) -> DataFrame:
    """(uid, length) -> (uid, bin, offset, used, open): one round of best fit within each of ``groups`` partitions."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "uid"], ascending=[False, True], kind="stable")
        bins, offsets, used = best_fit(pdf["length"].to_numpy(), capacity)
        if len(used) >> BIN_BITS:
            raise OverflowError("a partition has too many bins to number")
        number = (level << GROUP_BITS | int(key[0])) << BIN_BITS
        return pd.DataFrame({"uid": pdf["uid"].to_numpy(), "bin": number + bins, "offset": offsets, "used": used[bins], "open": used[bins] < enough})

    grouped = items.withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(groups)).cast("long"))
    return grouped.groupBy("grp").applyInPandas(one, "uid long, bin long, offset long, used long, open boolean")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, nearly_full: float = 0.998, lean: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    A null or empty text is a piece of the end id alone; rows with equal or null doc_id are packed each by
    itself; other columns aren't read; an empty table gives no rows. Sequences are numbered, not hashed: no two share an
    id. Results of equal runs may number the sequences differently, but never put two pieces at one place.
    ``lean`` takes less memory of the workers and more time, for the same pieces."""
    pieces = token_pieces(docs, tokenizer, capacity, end_id, lean)
    enough = max(1, int(capacity * nearly_full))
    full, rest = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    items, rounds = rest.select("uid", "length"), []
    n = rest.count()
    while True:
        groups = max(1, -(-n // PART_ITEMS))
        done = common.stored(_round(items, capacity, len(rounds), groups, enough))
        rounds.append(done)
        if groups == 1:
            break
        items = done.where("open").groupBy(F.col("bin").alias("uid")).agg(F.max("used").alias("length"))
        before, n = n, items.count()
        if not n or n > WORTH * before:
            break
    # where the bins of each round went in the next: from the last round back
    placed = rounds[-1].select("uid", "bin", "offset")
    for done in reversed(rounds[:-1]):
        moved = placed.select(F.col("uid").alias("bin"), F.col("bin").alias("to_bin"), F.col("offset").alias("by"))
        placed = done.join(moved, "bin", "left").select("uid", F.coalesce("to_bin", "bin").alias("bin"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    alone = full.select(*columns, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))  # below those of bins
    return rest.join(placed, "uid").select(*columns, F.col("bin").alias("sequence_id"), "offset").unionByName(alone)


def op5_packing(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
