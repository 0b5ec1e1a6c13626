"""Line dedup by log templates: a fixed-depth tree over token count and leading tokens.

A line's leaf is its token count and its first DEPTH tokens, those with digits masked. Within a leaf a
token at a place is constant if enough documents have it there, and else a variable field. Lines whose template
(its constants and fields) recurs in enough documents are dropped, but for those of the first document.
Long lines that are equal but for masked tokens recur from two documents on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Leading tokens of a leaf, documents that make a template recur, tokens that a line needs, share of them that must be constant.
DEPTH, MIN_DOCS, MIN_TOKENS, CONSTANT = 3, 4, 3, 0.6
#: Tokens of a long line, documents that make an equal long line recur.
LONG_TOKENS, LONG_DOCS = 20, 2
#: Bits of the filter that lets lines of rare leaves through only by chance; its size never changes.
FILTER_BITS = 1 << 22
FIELD = "<*>"
_DIGITS = re.compile(r"\d")


def masked(line: str) -> list[str]:
    """Tokens of a line; those with digits are variable fields."""
    tokens = line.split()
    if _DIGITS.search(line):
        tokens = [FIELD if any(map(str.isdigit, t)) else t for t in tokens]
    return tokens


def leaf_of(tokens: list[str]) -> int:
    """A signed 64-bit code of the leaf."""
    return xxhash.xxh3_64_intdigest(f"{len(tokens)} {' '.join(tokens[:DEPTH])}".encode()) - (1 << 63)


def line_of(tokens: list[str]) -> int:
    """A signed 64-bit code of the whole masked line."""
    return xxhash.xxh3_64_intdigest(" ".join(tokens).encode(), seed=1) - (1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _rare_filter(docs: DataFrame, min_docs: int, long_docs: int) -> np.ndarray:
    """Two rows of bits, one for each hash of a leaf, and of a long line, that enough documents may have."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes: tuple = ([], [])
            for x in b.column("text").to_pylist():
                lines = [t for t in map(masked, set(x.split("\n"))) if len(t) >= MIN_TOKENS]
                codes[0].append(np.unique(np.asarray([leaf_of(t) for t in lines], np.int64)))
                codes[1].append(np.unique(np.asarray([line_of(t) for t in lines if len(t) >= LONG_TOKENS], np.int64)))
            for kind, found in enumerate(codes):
                hashes, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.full(len(n), kind, np.int32)), pa.array(n)], names=["code", "kind", "n"])
            del codes
            common.trim()

    bit = F.pmod(F.col("code"), F.lit(FILTER_BITS))
    enough = docs.select("text").mapInArrow(rows, "code long, kind int, n long").groupBy("code", "kind").agg(F.sum("n").alias("n")).where(F.col("n") >= F.when(F.col("kind") == 0, min_docs).otherwise(long_docs))
    words = enough.groupBy("kind", (bit / 64).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(code, {FILTER_BITS}) % 64 as int))")).alias("bits"))
    out = np.zeros((2, FILTER_BITS // 64), np.int64)
    for r in words.collect():  # at most FILTER_BITS / 32 rows
        out[r.kind, r.word] = r.bits
    return out.view(np.uint64)


def _lines(docs: DataFrame, common_codes: np.ndarray) -> DataFrame:
    """doc_id, text_hash, leaf, line (a digest), tokens, equal and places of each distinct masked line of a document that may recur.

    tokens is null if the leaf is rare; equal tells whether the line is long enough, and says enough, to recur as itself."""
    shared = docs.sparkSession.sparkContext.broadcast(common_codes)
    kinds = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("leaf", pa.int64()), ("line", pa.binary()), ("tokens", pa.string()), ("equal", pa.bool_()), ("places", pa.list_(pa.int32()))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_leaves, of_lines = shared.value

        def may(bits, code):
            at = code % FILTER_BITS
            return int(bits[at >> 6]) >> (at & 63) & 1 == 1

        for b in batches:
            out = []
            for doc_id, key, text in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), b.column("text").to_pylist()):
                mine: dict = {}
                for place, line in enumerate(text.split("\n")):
                    tokens = masked(line)
                    if len(tokens) >= MIN_TOKENS:
                        leaf = leaf_of(tokens)
                        whole, long = may(of_leaves, leaf), len(tokens) >= LONG_TOKENS and len(tokens) - tokens.count(FIELD) >= CONSTANT * len(tokens)
                        equal = long and may(of_lines, line_of(tokens))
                        if whole or equal:
                            mine.setdefault((leaf, " ".join(tokens), whole, equal), []).append(place)
                out += [(doc_id, key, leaf, xxhash.xxh3_128_digest(tokens.encode()), tokens if whole else None, equal, places) for (leaf, tokens, whole, equal), places in mine.items()]
            columns = list(zip(*out)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds])
            del out, columns
            common.trim()

    return common.stored(docs.mapInArrow(rows, "doc_id long, text_hash long, leaf long, line binary, tokens string, equal boolean, places array<int>"))


def dropped_lines(docs: DataFrame, min_docs: int | None = None) -> DataFrame:
    """(doc_id, text_hash, drop): places of the lines of each document that go; other documents have no row."""
    min_docs = min_docs or MIN_DOCS
    long_docs = min(LONG_DOCS, min_docs)
    common.bounded_batches(docs.sparkSession)
    keyed = _keyed(docs)
    lines = _lines(keyed, _rare_filter(keyed, min_docs, long_docs))
    distinct = common.stored(lines.groupBy("leaf", "line").agg(F.min("tokens").alias("tokens"), F.first("equal").alias("equal"), F.count(F.lit(1)).alias("docs")))
    tokens = distinct.where("tokens is not null").select("leaf", "line", "docs", F.posexplode(F.split("tokens", " ")).alias("place", "token"))
    support = tokens.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("n"), F.count(F.lit(1)).alias("rows")).where(F.col("n") >= min_docs).drop("n").withColumn("constant", F.lit(True))
    marked = common.spread_join(tokens, common.stored(support), ["leaf", "place", "token"], "rows", ["line"], "left")
    shown = F.struct("place", F.when(F.col("constant"), F.col("token")).otherwise(FIELD).alias("token"))
    template = F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["token"]), " ")
    enough = F.avg(F.when(F.col("constant") & (F.col("token") != FIELD), 1.0).otherwise(0.0)) >= CONSTANT
    templates = marked.groupBy("leaf", "line").agg(template.alias("template"), enough.alias("enough"), F.max("docs").alias("docs")).where("enough").select("line", F.xxhash64("leaf", "template").alias("template"), "docs")
    equal = distinct.where(F.col("equal") & (F.col("docs") >= long_docs)).select("line", F.xxhash64("leaf", "line").alias("template"), "docs")
    # a line may recur as part of a template and as itself
    kinds = templates.withColumn("need", F.lit(min_docs)).unionByName(equal.withColumn("need", F.lit(long_docs)))
    templates = common.stored(kinds.groupBy("line").agg(F.collect_list(F.struct("template", "need")).alias("of"), F.max("docs").alias("docs")))
    document = ["doc_id", "text_hash"]
    found = common.stored(common.spread_join(lines.select(*document, "line", "places"), templates, ["line"], "docs", document).select(*document, F.explode("of").alias("of"), "places").select(*document, "of.template", "of.need", "places"))
    each = found.groupBy("template", "need", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("lines"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    recurring = each.groupBy("template", "need").agg(F.count(F.lit(1)).alias("docs"), F.sum("lines").alias("lines"), F.min(key).alias("first")).where(F.col("docs") >= F.col("need")).drop("docs", "need")
    gone = common.spread_join(found, common.stored(recurring), ["template"], "lines", [*document, "places"]).where(key != F.col("first"))
    return gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("drop"))


def without_recurring(docs: DataFrame, min_docs: int | None = None) -> DataFrame:
    """docs with text less its recurring lines, and n_lines, n_dropped and emptied added (columns of those names are replaced).

    Lines end with a line feed. Those of fewer than MIN_TOKENS tokens, empty ones too, always stay. A null text
    stays null, with no lines. Rows equal in doc_id and text count as one document in the choice of what recurs
    first; every row is returned. emptied: the text had words and has none left. Other columns, whatever their names,
    stay as they are; an empty table gives no rows."""
    docs = docs.drop("n_lines", "n_dropped", "emptied")
    gone = dropped_lines(docs, min_docs).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), F.col("drop").alias("_drop"))
    # the columns of docs stand aside in a struct, so their names can't clash
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))
    text = F.col("_row.text")
    key = F.xxhash64(F.coalesce(text, F.lit("")))
    joined = own.join(gone, F.col("_row.doc_id").cast("long").eqNullSafe(F.col("gone_id")) & (key == F.col("gone_hash")), "left")
    drop, lines = F.col("_drop"), F.split(text, "\n", -1)
    left = F.when(drop.isNull(), text).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(drop, i)), "\n"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_dropped = F.when(drop.isNull(), 0).otherwise(F.size(drop)).cast("long")
    emptied = F.coalesce(drop.isNotNull() & ~left.rlike(r"\S"), F.lit(False))
    return joined.select(*[left.alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns], n_lines.alias("n_lines"), n_dropped.alias("n_dropped"), emptied.alias("emptied"))


def op1_line_templates(spark, sf_dir) -> DataFrame:
    out = without_recurring(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", "emptied", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_sha256"))
