"""Near-duplicate documents by an LSH forest over MinHash signatures.

A signature is sorted in several orders, each beginning at another of its values: the trees. In a
tree's sorted order, documents that share a long prefix are neighbours. The depth at which
they count as candidates adapts to the region: where few share the first DEPTH values, all of
those pair up; where many do, the region is split by the next value, and so on, and only neighbours
pair up in what stays crowded to the full depth. So no region gives more than a few pairs for each
of its documents, whatever its size. Candidates are confirmed on whole shingle sets. Regions of more
documents that aren't all connected by then are compared in full, in blocks: every document with every other.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

#: Values of a signature, trees, values by which the next tree begins later, least and full depth of a tree.
VALUES, TREES, STRIDE, DEPTH, FULL = 60, 20, 3, 3, 12
#: Documents of a region that all pair up.
SMALL = 8
#: Documents of a block of a larger region; blocks are compared two by two.
BLOCK = 256
#: Parts of a sorted order whose ends meet in a part of the next level.
FAN_IN = 64
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed permutation of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its shingles of ``width`` words.

    Words are runs of other than ASCII white space, A-Z in lower case. A text of fewer words is one
    shingle; one without words has none."""
    known: dict[bytes, int] = {}
    out = []
    with np.errstate(over="ignore"):
        for t in texts:
            words = t.encode().lower().split()  # of bytes: ASCII letters and white space alone
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            n = max(1, len(h) - width + 1) if len(h) else 0
            rolled = np.full(n, min(len(h), width), np.uint64)
            for k in range(min(width, len(h))):
                rolled = _mix(rolled * _GOLD + h[k : k + n])
            out.append(np.unique(rolled))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of a set that isn't empty, 16 bits of each."""
    seeds = _mix(np.arange(1, VALUES + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
    out = np.empty(VALUES, np.uint64)
    with np.errstate(over="ignore"):
        for k, s in enumerate(seeds):
            out[k] = ((shingles ^ (s >> np.uint64(7))) * s).min()
        return (_mix(out) >> np.uint64(48)).astype(">u2")


def pairs_of_run(labels: list[bytes], begin: int, end: int, depth: int) -> Iterator[tuple[int, int]]:
    """Candidate pairs of places [begin, end) of a sorted order, whose labels agree in ``depth`` values."""
    if end - begin > SMALL:
        yield from zip(range(begin, end - 1), range(begin + 1, end))
    stack = [(begin, end, depth)]
    while stack:
        a, e, d = stack.pop()
        if e - a <= SMALL:
            yield from itertools.combinations(range(a, e), 2)
        elif d < FULL:
            stack += [(b, f, d + 1) for b, f in runs(labels, a, e, d + 1) if f - b > 2]


def runs(labels: list[bytes], begin: int, end: int, depth: int) -> list[tuple[int, int]]:
    """Runs of places whose labels agree in ``depth`` values (of two bytes each)."""
    cuts = [begin, *(i for i in range(begin + 1, end) if labels[i][: 2 * depth] != labels[i - 1][: 2 * depth]), end]
    return list(zip(cuts, cuts[1:]))


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """uid, doc_id, n_shingles, set (a 128-bit digest of the whole set) and signature of each document, stored."""
    common.bounded_batches(docs.sparkSession)

    def rows(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        for b in batches:
            sets = shingle_sets(b.column("text").to_pylist(), width)
            n = len(sets)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("text_hash"), pa.array(np.arange(made, made + n) + (part << 33)), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            ], names=["doc_id", "text_hash", "uid", "n_shingles", "digest", "signature"])
            made += n
            del sets
            common.trim()

    keyed = common.id_text(docs).withColumn("text_hash", F.xxhash64("text"))
    return common.stored(keyed.mapInArrow(rows, "doc_id long, text_hash long, uid long, n_shingles long, digest binary, signature binary"))


def _candidates(classes: DataFrame) -> DataFrame:
    """(a, b, trees): pairs of classes that are candidates, and in how many trees; classes: rep, signature."""
    spark = classes.sparkSession
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    label = F.expr(f"substring(concat(signature, signature), tree * {2 * STRIDE} + 1, {2 * FULL})").alias("label")
    ordered = classes.select("rep", "signature", tree).select("tree", label, "rep")
    out = "a long, b long, tree int, label binary, rep long"
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tree", pa.int32()), ("label", pa.binary()), ("rep", pa.int64())])

    def batch(a, b, edge=()):
        n, m = len(a), len(edge)
        cols = list(zip(*edge)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array([*a, *[None] * m], pa.int64()), pa.array([*b, *[None] * m], pa.int64()), *(pa.array([*[None] * n, *c], k) for c, k in zip(cols, (pa.int32(), pa.binary(), pa.int64())))], schema=schema)

    def paired(trees, labels, reps):
        begin, a, b = 0, [], []
        for i in range(1, len(labels) + 1):
            if i == len(labels) or trees[i] != trees[begin] or labels[i][: 2 * DEPTH] != labels[begin][: 2 * DEPTH]:
                if i - begin > 1:
                    for x, y in pairs_of_run(labels, begin, i, DEPTH):
                        a.append(min(reps[x], reps[y]))
                        b.append(max(reps[x], reps[y]))
                begin = i
        return a, b

    def along(batches):
        """Pairs of a part of a sorted order. Its first and last rows go out too, as a run may go on in the parts around it."""
        trees, labels, reps, head, tail = [], [], [], [], []
        for b in batches:
            trees += b.column("tree").to_pylist()
            labels += b.column("label").to_pylist()
            reps += b.column("rep").to_pylist()
            ends = list(zip(trees, labels, reps))
            head += ends[len(ends) - b.num_rows :][: SMALL - len(head)]
            tail = [*tail, *ends[len(ends) - b.num_rows :]][-SMALL:]
            # what comes before the last run is whole; a crowded run is cut, keeping neighbours
            end = len(labels) - 1
            while end > 0 and trees[end - 1] == trees[-1] and labels[end - 1][: 2 * DEPTH] == labels[-1][: 2 * DEPTH]:
                end -= 1
            if len(labels) - end > 50_000:
                end = len(labels) - SMALL
                yield batch(*paired(trees, labels, reps))
            else:
                yield batch(*paired(trees[:end], labels[:end], reps[:end]))
            trees, labels, reps = trees[end:], labels[end:], reps[end:]
        yield batch(*paired(trees, labels, reps), sorted({*head, *tail}))

    keys = ["tree", "label", "rep"]
    n, pairs = common.parallelism(spark), None
    while True:
        # the representative is the last key, so that equal labels spread over parts; the last part has a few rows of each of at most FAN_IN parts
        parts = ordered.repartitionByRange(n, *keys) if n > 1 else ordered.coalesce(1)
        found = common.stored(parts.sortWithinPartitions(*keys).mapInArrow(along, out))
        some = found.where("a is not null").select("a", "b", F.lit(pairs is None).alias("within"))
        pairs = some if pairs is None else pairs.unionByName(some)
        if n == 1:
            break
        # runs that parts cut: the ends of all parts are an order of their own, which has few rows however long the first one
        n, ordered = -(-n // FAN_IN), found.where("a is null").select(*keys)
    # trees of the first level alone are counted, as an end meets its own part's rows again
    return common.stored(pairs.groupBy("a", "b").agg(F.greatest(F.sum(F.col("within").cast("long")), F.lit(1)).alias("trees")))


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= similarity * union of their whole sets."""

    def rows(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b")):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(100 * both >= similarity * (len(p) + len(q) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])
            common.trim()

    side = lambda c: sets.select(F.col("rep").alias(c), F.col("set").alias(f"set_{c}"))
    return common.stored(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(rows, "a long, b long"))


def links_between(a: list[np.ndarray], b: list[np.ndarray], similarity: int) -> np.ndarray:
    """A row for each of the sets a: which of the sets b have 100 * intersection >= similarity * union. No set is empty."""
    sizes = np.fromiter(map(len, b), np.int64, len(b))
    known, codes = np.unique(np.concatenate(b), return_inverse=True)
    starts, out = np.cumsum(sizes) - sizes, np.zeros((len(a), len(b)), bool)
    for i, x in enumerate(a):
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        mark = np.zeros(len(known), np.int32)
        mark[at[known[at] == x]] = 1
        both = np.add.reduceat(mark[codes], starts)
        out[i] = 100 * both >= similarity * (len(x) + sizes - both)
    return out


def _within_regions(classes: DataFrame, joined: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) between the components ``joined`` within regions of more than SMALL classes, each compared in full."""
    at = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    prefix = F.expr(f"substring(concat(signature, signature), tree * {2 * STRIDE} + 1, {2 * DEPTH})").alias("prefix")
    of = joined.select(F.col("node").alias("rep"), "component")
    members = classes.select("rep", "signature", at).select("rep", "tree", prefix).join(of, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sized = members.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("least"), F.max("component").alias("most"))
    crowded = common.stored(sized.where((F.col("size") > SMALL) & (F.col("least") != F.col("most"))).select("tree", "prefix", "size", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    dealt = common.spread_join(members, crowded, ["tree", "prefix"], "size", ["rep"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = other.select("tree", "prefix", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "rep", "component").join(sets, "rep")

    def compared(table: pa.Table) -> pa.Table:
        reps, components_, block = (table.column(c).to_numpy() for c in ("rep", "component", "block"))
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        found = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        # what is connected already needs no link
        apart = components_[left][:, None] != components_[right][None, :]
        left, right = left[apart.any(1)], right[apart.any(0)]
        a = b = np.zeros(0, np.int64)
        if len(left):
            linked = links_between([found[i] for i in left], [found[i] for i in right], similarity) & (components_[left][:, None] != components_[right][None, :])
            x, y = np.nonzero(linked)
            a, b = np.minimum(reps[left[x]], reps[right[y]]), np.maximum(reps[left[x]], reps[right[y]])
        return pa.table({"a": a, "b": b})

    return common.stored(paired.groupBy("tree", "prefix", "p", "q").applyInArrow(compared, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 80) -> DataFrame:
    """doc_id, text_hash (xxhash64), n_shingles, component_id and kept of each document.

    Documents with 100 * intersection >= similarity * union of their sets of ``width``-word shingles are linked;
    component_id is the least doc_id reachable. A null, empty or wordless text has no shingles and is linked with nothing.
    A null doc_id gives null component_id (its own links still hold); rows with equal doc_id and text give a row each,
    all kept. Other columns aren't read; an empty table gives no rows."""
    signed = _signed(docs, width)
    # documents with equal sets form a class; its representative is the row of the least doc_id. Salted: a class can be most rows.
    salted = signed.where("digest is not null").withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(64)))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid", "signature")).alias("least")
    by_salt = salted.groupBy("digest", "salt").agg(least)
    classes = common.stored(by_salt.groupBy("digest").agg(F.min("least").alias("least")).select("digest", F.col("least.uid").alias("rep"), F.col("least.doc_id").alias("rep_id"), F.col("least.signature").alias("signature")))
    found = _candidates(classes)
    # first the partners that share most trees, then whatever isn't connected by then
    ends = found.select("a", "b", "trees", F.explode(F.array("a", "b")).alias("of"))
    rank = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("trees"), "a", "b"))
    first = common.stored(ends.withColumn("rank", rank).where("rank <= 2").select("a", "b").distinct())

    needed = found.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    sets = _sets(docs, signed, needed, width)
    linked = _confirmed(first, sets, similarity)
    joined = components(linked)
    of = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    rest = found.join(first, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = common.stored(rest.where("coalesce(a_part, a) <> coalesce(b_part, b)").select("a", "b"))
    if not rest.isEmpty():
        more = _confirmed(rest, sets, similarity)
        if not more.isEmpty():
            linked = linked.unionByName(more)
            joined = components(linked)
    # last the regions that are crowded: their candidates were only some of their pairs
    more = _within_regions(classes, joined, sets, similarity)
    if not more.isEmpty():
        joined = components(linked.unionByName(more))
    # the least doc_id of a component of classes, back to the classes and their documents
    named = classes.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").select("digest", "rep_id", F.coalesce("component", "rep").alias("component"))
    least_id = named.groupBy("component").agg(F.min("rep_id").alias("component_id"))
    of_class = common.stored(named.join(least_id, "component").select("digest", "component_id"))
    spread = by_salt.select("digest", "salt").join(of_class, "digest")
    keyed = signed.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(64)))
    out = keyed.join(spread, ["digest", "salt"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _sets(docs: DataFrame, signed: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """(rep, set) for the representatives that have candidates: their texts are read again and hashed whole."""

    # a doc_id, or none, may be that of many rows: the text's hash and the set's digest tell which one is meant
    key = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.col("text_hash").alias("hash")]
    alike = signed.where("digest is not null").groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
    wanted = signed.join(needed, "uid").select(*key, F.col("uid").alias("rep"), F.col("digest").alias("want")).dropDuplicates(["id", "no_id", "hash"])
    wanted = common.stored(wanted.join(alike, ["id", "no_id", "hash"]))

    def rows(batches):
        for b in batches:
            sets = [s.tobytes() for s in shingle_sets(b.column("text").to_pylist(), width)]
            same = [xxhash.xxh3_128_digest(s) == w for s, w in zip(sets, b.column("want").to_pylist())]
            keep = pa.array(same, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("rep").filter(keep), pa.array(sets, pa.binary()).filter(keep)], names=["rep", "set"])

    texts = common.id_text(docs).withColumn("text_hash", F.xxhash64("text")).select(*key, "text", F.monotonically_increasing_id().alias("_any"))
    # a join by shuffle would move every text, most of which have no candidate
    got = common.spread_join(common.sieved(texts, wanted, "hash"), wanted, ["id", "no_id", "hash"], "rows", ["_any"]).select("rep", "want", "text").mapInArrow(rows, "rep long, set binary")
    return common.stored(got.groupBy("rep").agg(F.first("set").alias("set")))


def keep_one(docs: DataFrame, width: int = 5, similarity: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with their columns, whatever these are called: of each component,
    those of the least doc_id. Rows without a doc_id or shingles stay; an empty table gives no rows."""
    gone = near_duplicates(docs, width, similarity).where("not kept").select("doc_id", "text_hash")
    return common.without(docs, gone, ["text_hash"], lambda text: [F.xxhash64(F.coalesce(text, F.lit("")))])


def op6_near_duplicates(spark, sf_dir) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), width=4).drop("text_hash")
