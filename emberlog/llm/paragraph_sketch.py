"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, by DataFrame functions only.

A sketch has three parts of equally many cells. A paragraph's digest goes to one cell of each, which keeps a count, the
xor of the digests and the xor of their check sums. The sketch of another version is subtracted cell by
cell; what both have cancels out. A cell then left with one digest gives it away, and taking that
out of its other cells frees more (peeling). Where cells stay that can't be peeled, the digests are
dealt to strata and sketched again with more cells, until all differences are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Cells of a fingerprint and of a stratum's first sketch, digests of both sides that a stratum has at most, or about, rounds of peeling.
CELLS, STRATUM_CELLS, STRATUM, ROUNDS = 24, 96, 32, 10
#: Ways a stratum is split each time, as a power of two, and times: far more than a text has paragraphs for.
SPLIT_BITS, SPLITS = 3, 8
#: Code points beyond which a line is cut, and of a piece at least: pieces end with a sentence, so they come again after an edit.
LONG_LINE, PIECE = 400, 200


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs of a text: lines that aren't empty, of long ones pieces at the ends of sentences."""
    lines = F.filter(F.split(text, "\n", -1), lambda p: p != "")
    cut = lambda p: F.regexp_extract_all(p, F.lit(f"(?s).{{{PIECE}}}[^.!?]*[.!?]+|.+$"), F.lit(0))
    parts = F.transform(lines, lambda p: F.when(F.char_length(p) > LONG_LINE, cut(p)).otherwise(F.array(p)))
    return F.array_distinct(F.transform(F.flatten(parts), lambda p: F.xxhash64(p)))


def _places(digest: Column, cells: int, seed: int) -> Column:
    part = cells // 3
    place = lambda t: (F.pmod(F.xxhash64(digest, F.lit(3 * seed + t)), F.lit(part)) + t * part).cast("int")
    return F.struct(digest.alias("k"), F.xxhash64(digest, F.lit(-1 - seed)).alias("h"), place(0).alias("x"), place(1).alias("y"), place(2).alias("z"))


def _in(item: Column, j: Column) -> Column:
    return (item["x"] == j) | (item["y"] == j) | (item["z"] == j)


def _cell(c: Column, k: Column, h: Column) -> Column:
    return F.struct(c.cast("long").alias("c"), k.alias("k"), h.alias("h"))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once and not wherever it is used."""
    return F.transform(F.array(value), use)[0]


def sketch(of: Column, cells: int = CELLS, seed: int = 0) -> Column:
    """The cells of an array of digests."""
    zero = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))
    add = lambda j: lambda cell, x: F.when(_in(x, j), _cell(cell["c"] + 1, cell["k"].bitwiseXOR(x["k"]), cell["h"].bitwiseXOR(x["h"]))).otherwise(cell)
    filled = lambda items: F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda j: F.aggregate(items, zero, add(j)))
    return _let(F.transform(of, lambda d: _places(d, cells, seed)), filled)


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["c"] - y["c"], x["k"].bitwiseXOR(y["k"]), x["h"].bitwiseXOR(y["h"])))


def peeled(cells: Column, count: int, seed: int = 0) -> Column:
    """A struct of the digests that only the first (plus) and only the second (minus) version has, and whether these are all."""

    one = lambda x: (F.abs(x["c"]) == 1) & (x["h"] == F.xxhash64(x["k"], F.lit(-1 - seed)))
    pure = lambda cells: F.array_distinct(F.transform(F.filter(cells, one), lambda x: F.struct(x["k"].alias("k"), x["c"].alias("c"))))
    place = lambda p: F.struct(p["c"].alias("c"), _places(p["k"], count, seed).alias("at"))

    def without(items):
        def each(x, j):
            out = lambda cell, p: F.when(_in(p["at"], j), _cell(cell["c"] - p["c"], cell["k"].bitwiseXOR(p["at"]["k"]), cell["h"].bitwiseXOR(p["at"]["h"]))).otherwise(cell)
            return F.aggregate(items, x, out)

        return each

    def round_(state, _):
        def taken(found):
            left = _let(F.transform(found, place), lambda items: F.transform(state["cells"], without(items)))
            return F.when(F.size(found) == 0, state).otherwise(F.struct(left.alias("cells"), F.concat(state["found"], found).alias("found")))

        return _let(pure(state["cells"]), taken)

    start = F.struct(cells.alias("cells"), F.array().cast("array<struct<k: bigint, c: bigint>>").alias("found"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_)
    whole = lambda s: F.forall(s["cells"], lambda x: (x["c"] == 0) & (x["k"] == 0) & (x["h"] == 0))
    side = lambda s, sign: F.transform(F.filter(s["found"], lambda p: p["c"] == sign), lambda p: p["k"])
    return _let(end, lambda s: F.struct(side(s, 1).alias("plus"), side(s, -1).alias("minus"), whole(s).alias("whole")))


def as_string(cells: Column) -> Column:
    """Cells as text: of each the count, the digests' xor and the check sums' xor, in hexadecimal."""
    return F.array_join(F.transform(cells, lambda x: F.when(x["c"] == 0, "").otherwise(F.concat_ws(":", F.hex(x["c"]), F.hex(x["k"]), F.hex(x["h"])))), "|")


def differences(pairs: DataFrame) -> DataFrame:
    """(pair, plus, minus) for rows (pair, a, b): the digests that only a, and only b, has, as recovered from sketches alone.

    Arrays must not be null; a pair without digests has none that differ; repeated rows of a pair count as one pair's
    strata; no rows give none. Pairs whose fingerprints can't be peeled are sketched again in strata, with more cells each time."""
    got = peeled(subtracted(sketch(F.col("a")), sketch(F.col("b"))), CELLS).alias("d")
    # more differences than cells can't be peeled: the lengths tell that many differ at least
    first = common.stored(pairs.select("pair", "a", "b", F.when(F.abs(F.size("a") - F.size("b")) < CELLS, got).alias("d")))
    done = first.where("d.whole").select("pair", "d.plus", "d.minus")
    left = first.where("d.whole is null or not d.whole").select("pair", "a", "b")
    # strata by the digests' bits, split again and again while large, so each digest is looked at a few times whatever the size
    for k in range(SPLITS):
        ways = 1 << SPLIT_BITS
        large = F.size("a") + F.size("b") > STRATUM
        mine = lambda c: F.when(large, F.filter(F.col(c), lambda d: F.shiftrightunsigned(d, SPLIT_BITS * k).bitwiseAND(F.lit(ways - 1)) == F.col("stratum"))).otherwise(F.col(c))  # noqa: B023, E731
        left = left.select("pair", "a", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.when(large, F.lit(ways - 1)).otherwise(F.lit(0)).cast("long"))).alias("stratum")).select("pair", mine("a").alias("a"), mine("b").alias("b"))
    parts, cells, seed = [], STRATUM_CELLS, 1
    while True:
        got = peeled(subtracted(sketch(F.col("a"), cells, seed), sketch(F.col("b"), cells, seed)), cells, seed).alias("d")
        now = common.stored(left.select("pair", "a", "b", got))
        parts.append(now.where("d.whole").select("pair", "d.plus", "d.minus"))
        left = now.where("not d.whole").select("pair", "a", "b")
        if left.isEmpty():
            break
        cells, seed = 2 * cells, seed + 1
    for p in parts:
        done = done.unionByName(p)
    join = lambda c: F.flatten(F.collect_list(c)).alias(c)
    return done.groupBy("pair").agg(join("plus"), join("minus"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text of the next document in descending doc_id, after the last that of the first.

    Rows of equal doc_id follow by a hash of their text; null doc_ids come last. Documents are dealt out by ranges of
    doc_id, and each range also gets the first document of the next, so no order over all rows is made."""
    docs = common.id_text(docs)
    parts = common.parallelism(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 10_000)).first()[0] or []  # fewer than parts numbers
    cuts = sorted(set(cuts))
    # number 0 is the range of the largest ids; null ids are the last one
    number = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>"), lambda c: c < F.col("doc_id"))))
    dealt = docs.withColumn("part", number.cast("int")).withColumn("hash", F.xxhash64("text"))
    order = F.struct(F.coalesce(-F.col("doc_id"), F.lit(0).cast("long")).alias("o"), "hash")
    firsts = dealt.groupBy("part").agg(F.min(order).alias("at"))  # a row for each range
    # each range's follower: the next range that has documents, after the last the first
    around = firsts.select("part", "at", F.lead("part").over(Window.orderBy("part")).alias("follows"), F.min("part").over(Window.partitionBy()).alias("least"))
    follower = around.select(F.col("part").alias("goes_to"), F.coalesce("follows", "least").alias("part")).join(firsts, "part")
    guests = dealt.join(F.broadcast(follower), "part").where(order == F.col("at")).dropDuplicates(["goes_to"]).select("doc_id", "text", F.col("goes_to").alias("part"), "hash", F.lit(True).alias("guest"))
    ordered = Window.partitionBy("part").orderBy("guest", order)
    both = dealt.withColumn("guest", F.lit(False)).unionByName(guests)
    return both.select("doc_id", "text", "guest", F.lead("text").over(ordered).alias("next_text")).where("not guest").select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    The edited text has the last third of code points replaced by the first ones of the next document. near_* is the share of
    all distinct paragraphs of two texts that both have, from the sketches' differences; 1 if neither has any.
    A null text is an empty one; rows with equal or null doc_id give a row each; a single document is its own next."""
    n = F.char_length("text")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.expr("substring(next_text, 1, cast(floor(char_length(text) / 3) as int))"))
    base = with_next(docs).withColumn("edited", edited)
    base = base.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("changed"), digests(F.col("next_text")).alias("following"))
    base = common.stored(base.withColumn("row", F.monotonically_increasing_id()))
    # few bytes, much work: as many tasks as shuffles have, not as files are large
    pairs = base.repartition(common.parallelism(base.sparkSession), "row").select(F.explode(F.array(F.struct((F.col("row") * 2).alias("pair"), F.col("own").alias("a"), F.col("changed").alias("b")), F.struct((F.col("row") * 2 + 1).alias("pair"), F.col("own").alias("a"), F.col("following").alias("b")))).alias("p")).select("p.*")
    counts = differences(pairs).select(F.expr("pair div 2").alias("row"), (F.col("pair") % 2).alias("which"), (F.size("plus") + F.size("minus")).alias("n"))
    of = lambda k: F.max(F.when(F.col("which") == k, F.col("n")))
    counts = counts.groupBy("row").agg(of(0).alias("n_edited"), of(1).alias("n_next"))

    def near(other: str, differ: str) -> Column:
        both = F.size("own") + F.size(other)
        return F.when(both == 0, 1.0).otherwise((both - F.col(differ)) / (both + F.col(differ)))

    text = lambda c: as_string(sketch(F.col(c)))
    return base.join(counts, "row").select("doc_id", "n_chars", "edited_sha256", text("own").alias("fingerprint"), text("changed").alias("edited_fingerprint"), near("changed", "n_edited").alias("near_edited"), near("following", "n_next").alias("near_next"))


def op7_paragraph_sketch(spark, sf_dir) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))
