"""Every operator against brute force on a small table of awkward rows: nulls, empty and long texts, ties, clashing columns."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberlog.llm import byte_bpe, common, components, direct_codes, line_templates, lsh_forest, packing, paragraph_sketch, pretokens, progressive_jpeg, quality, token_counts, toxicity

BYTE, RANKS, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
WORDS = "the of and river stone green walks quietly under seven old bridges while nobody counts its long slow turns again".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) + f" tail{seed}"


LONG = "\n".join(prose(100 + k, 60) for k in range(120))
TEXTS = [
    None, "", " ", "\n\n", "a", "two words", "  lead  and\ttrail \n", "<|endoftext|> in <|endoftext|>text", "I'll it's 12345 $$$ !!! é́ 日本語 Σ", prose(1, 80), prose(1, 80), prose(1, 80).upper(),
    prose(1, 79) + " edit", prose(2, 300), prose(2, 300) + "\nmore lines\nhere", LONG, LONG + " x", "x" * 5000, "\u0085a   b\x1c c",
]
ROWS = [(i if i != 6 else None, t, "en" if i % 3 else None, "src0", i, 0.5, 3) for i, t in enumerate(TEXTS)] + [(9, TEXTS[9], "en", "src0", 1, 0.5, 3), (3, "other text of a repeated id", "fr", "src1", 1, 0.5, 3)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(15)] + [(None, 1, 1), (16, None, None)], "doc_id long, quality int, toxic int")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def expected(f):
    return sorted((f(d, t or "") for d, t, *_ in ROWS), key=str)


def test_units_give_the_library_s_ids():
    rng, alphabet = np.random.default_rng(3), list("ab1 '$\n\t é́　日x")
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet, rng.integers(0, 25))) for _ in range(3000)]
    for path in (BYTE, WORD):
        ids, begins = pretokens.unit_cache(path).encode(pa.array(texts))
        whole = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
        assert [ids[a:e].tolist() for a, e in zip(begins, begins[1:])] == [w.ids for w in whole]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_units_forgotten_and_cut_in_slices(path):
    rng = np.random.default_rng(5)
    texts = [""] + [" ".join(f"w{n}" for n in rng.zipf(1.3, rng.integers(0, 40)) % 500) for _ in range(400)] + ["long " * 500, ""]
    cache = pretokens.UnitCache(Tokenizer.from_file(path), "<u4", most=60, cut=300)
    whole = [w.ids for w in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        ids, begins = cache.encode(pa.array(texts))
        assert [ids[a:e].tolist() for a, e in zip(begins, begins[1:])] == whole
        assert len(cache.known) + len(cache.old) < 500
    ids, begins = cache.encode(pa.array([], pa.string()))
    assert len(ids) == 0 and begins.tolist() == [0]


def test_token_counts(docs, none):
    tok = Tokenizer.from_file(BYTE)

    def one(d, t):
        n = len(tok.encode(t, add_special_tokens=False).ids)
        return d, len(t.encode()), n, n > 1024

    assert rows(token_counts.token_counts(docs, BYTE), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected(one)
    assert token_counts.token_counts(none, BYTE).isEmpty()


def test_byte_bpe(docs, none):
    bpe = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    ids = lambda t: np.asarray(bpe.encode_ordinary(t), "<u4").tobytes()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = rows(byte_bpe.digests(docs, RANKS), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == expected(lambda d, t: (d, len(ids(t)) // 4, sha(ids(t)), sha(t.encode())))
    encoded = byte_bpe.encode(docs, RANKS)
    assert sorted(((r.doc_id, bytes(r.bytes).decode()) for r in byte_bpe.decode(encoded, RANKS).collect()), key=str) == expected(lambda d, t: (d, t))
    assert byte_bpe.encode(none, RANKS).isEmpty()


def test_direct_codes(docs, none):
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 1 << 20, 3000)
    ids[::3] %= 256
    segment = direct_codes.Segment(direct_codes.compress(ids))
    assert [segment.at(i) for i in range(3000)] == ids.tolist() and len(segment) == 3000
    for a, e in ((0, 3000), (5, 5), (511, 514), (1023, 2999), (7, 8)):
        assert segment.slice(a, e).tolist() == ids[a:e].tolist()
    assert len(direct_codes.Segment(direct_codes.compress(np.zeros(0)))) == 0
    with pytest.raises(ValueError):
        direct_codes.Segment(b"nothing")
    tok = Tokenizer.from_file(BYTE)
    full = lambda t: np.asarray([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
    got = direct_codes.read_documents(direct_codes.write_segments(docs, BYTE))
    assert rows(got, "doc_id", "n_tokens", "ids_crc32") == expected(lambda d, t: (d, len(full(t)), zlib.crc32(full(t))))
    placed = sorted((r.start, r.n_tokens, -1 if r.doc_id is None else r.doc_id) for r in got.collect())
    assert [p[0] for p in placed] == [0, *itertools.accumulate(p[1] for p in placed)][:-1] and [p[2] for p in placed] == sorted(p[2] for p in placed)
    assert direct_codes.read_documents(direct_codes.write_segments(none, BYTE)).isEmpty()


def test_packing(docs, none, monkeypatch):
    tok = Tokenizer.from_file(WORD)
    pieces = []
    for d, t, *_ in ROWS:
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces += [(d, k, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256])) for k, a in enumerate(range(0, len(ids), 256))]
    for part in (40_000, 5):  # one round, and a tree of rounds
        monkeypatch.setattr(packing, "PART_ITEMS", part)
        got = packing.pack(docs, WORD, 256).collect()
        assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(pieces, key=str)
        bins = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for b in bins.values():
            b.sort()
            assert [o for o, _ in b] == [0, *itertools.accumulate(n for _, n in b)][:-1] and sum(n for _, n in b) <= 256
        assert len(bins) <= -(-sum(p[3] for p in pieces) // 256) + 2
    assert packing.pack(none, WORD).isEmpty()


def test_best_fit():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 100, 500))[::-1]
    bins, offsets, used = packing.best_fit(lengths, 100)
    rooms: list[int] = []
    for n in lengths.tolist():  # plain best fit
        fits = [(r, k) for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(100 - n)
    assert len(rooms) == len(used) and sorted(rooms) == sorted((100 - used).tolist())


def brute_links(texts, width):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set())
    return sets, [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, spark, none, width):
    rng = np.random.default_rng(width)
    near = []
    for g in range(25):  # groups of near copies, about and above the bound
        base = rng.choice([f"w{i}" for i in range(400)], 60 + 5 * g).tolist()
        for _ in range(1 + g % 6):
            copy = list(base)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(0, len(copy))] = f"e{rng.integers(0, 99)}"
            near.append(" ".join(copy))
    table = [(1000 + i, t) for i, t in enumerate(near)] + [(d, t) for d, t, *_ in ROWS if d is not None and d not in (3, 9)]
    got = {r.doc_id: r for r in lsh_forest.near_duplicates(spark.createDataFrame(table, "doc_id long, text string"), width).collect()}
    sets, links = brute_links([t for _, t in table], width)
    parent = {d: d for d, _ in table}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(table[a][0]), root(table[b][0])
        parent[max(x, y)] = min(x, y)
    assert {d: (got[d].n_shingles, got[d].component_id, got[d].kept) for d in got} == {d: (len(sets[i]), root(d), root(d) == d) for i, (d, _) in enumerate(table)}
    odd = lsh_forest.near_duplicates(docs, width)
    assert odd.count() == len(ROWS) and lsh_forest.near_duplicates(none, width).isEmpty()
    assert lsh_forest.keep_one(docs, width).columns == docs.columns


def test_near_duplicates_in_a_crowd(spark, monkeypatch):
    """Pairs at 0.81 among documents that have 0.78 in common with each other."""
    shared = [f"c{i}" for i in range(178)]
    texts = [" ".join([*shared, *(f"p{k // 2}x{i}" for i in range(4)), *(f"u{k}x{i}" for i in range(21))]) for k in range(400)]
    _, links = brute_links(texts, 4)
    assert links == [(k, k + 1) for k in range(0, 400, 2)]
    monkeypatch.setattr(lsh_forest, "BLOCK", 64)  # several blocks
    got = lsh_forest.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k - k % 2 for k in range(400)}


def test_near_duplicates_whatever_the_partitions(spark, docs, monkeypatch):
    """Runs of equal prefixes across many short and empty parts; null and repeated ids without a join of all pairs."""
    base = prose(3, 60).split()
    table = [(i, " ".join([*base[: i % 7], f"x{i % 5}", *base[i % 7 :]])) for i in range(70)] + [(None, prose(9, 40))] * 300 + [(5, prose(9, 40))] * 40
    df, seen = spark.createDataFrame(table, "doc_id long, text string"), []
    for n in (2, 40):
        monkeypatch.setattr(common, "parallelism", lambda _, n=n: n)
        monkeypatch.setattr(lsh_forest, "FAN_IN", 8)
        got = lsh_forest.near_duplicates(df, 4)
        seen.append(sorted(map(str, got.collect())))
    assert seen[0] == seen[1] and len(seen[0]) == len(table)
    assert lsh_forest.keep_one(df, 4).where("doc_id is null").count() == 300


def test_near_duplicates_move_few_texts(spark, monkeypatch):
    """Only texts that have candidates are joined with these, not all of the table."""
    rng, moved = np.random.default_rng(6), []
    texts = [" ".join(rng.choice([f"w{i}" for i in range(5000)], 60)) for _ in range(600)]
    table = list(enumerate([*texts, *(f"{t} more" for t in texts[:20])])) + [(None, texts[3]), (None, None), (700, texts[20]), (700, texts[20])]
    plain = common.spread_join
    monkeypatch.setattr(common, "spread_join", lambda big, *a: (moved.append(big.count()) if "text" in big.columns else None) or plain(big, *a))
    got = lsh_forest.near_duplicates(spark.createDataFrame(table, "doc_id long, text string"), 4).collect()
    assert len(got) == len(table) and {r.doc_id: r.component_id for r in got} == {d: d - 600 if d and 600 <= d < 620 else 20 if d == 700 else d for d, _ in table}
    assert moved and 40 <= moved[0] <= 100


def test_sieve(spark, monkeypatch):
    """No row of a key is lost, whatever its size; few others pass where it isn't full."""
    big = spark.range(-3000, 3000).select(F.xxhash64("id").alias("hash"), "id").unionByName(spark.sql("select cast(null as long) hash, 9999L id"))
    keys = big.where("id >= 0 and id < 2000 or id = 9999").select("hash")
    for bits, parts, most in ((16, 1024, 200), (16, 1, 200), (1 << 20, 1024, 20), (1, 1, 4000)):
        monkeypatch.setattr(common, "SIEVE_BITS", bits)
        monkeypatch.setattr(common, "SIEVE_PARTS", parts)
        monkeypatch.setattr(common, "SIEVE_WORDS", 1024 if bits > 1 else 2)
        got = {r.id for r in common.sieved(big, keys, "hash").collect()}
        assert set(range(2000)) <= got and 9999 not in got and len(got) - 2000 <= most
    assert common.sieved(big, keys.limit(0), "hash").isEmpty()


def test_columns_of_any_name(spark):
    """Stages keep columns whose names are those of their own."""
    names = ["drop", "gone_id", "gone_hash", "gone_crc", "gone_text_hash", "_id", "_hot", "rows", "score", "bin", "a.b"]
    table = [(i, prose(i, 30), "en", *(f"{n}{i}" for n in names)) for i in range(8)]
    df = spark.createDataFrame(table, ["doc_id", "text", "lang", *names])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    for got in (quality.keep_good(df, labels), lsh_forest.keep_one(df), toxicity.keep_clean(df, labels), line_templates.without_recurring(df).drop("n_lines", "n_dropped", "emptied")):
        assert got.columns == df.columns and {tuple(r) for r in got.collect()} <= set(map(tuple, table))


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(400, 460)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(a != b and x in (a, b) for a, b in links)}


def test_line_templates(spark, docs, none):
    line = "this exact line of text comes again in all of these documents"
    table = [(i, f"{prose(i, 30)}\n{line}\norder {i * 37} shipped to customer number {i}\n{prose(50 + i, 20)}") for i in range(6)] + [(90, f"{line}"), (91, f"{line}\nshort"), (92, None)]
    got = {r.doc_id: r for r in line_templates.without_recurring(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got[0].text == table[0][1] and got[0].n_dropped == 0
    for i in range(1, 6):
        assert got[i].text == f"{prose(i, 30)}\n{prose(50 + i, 20)}" and got[i].n_dropped == 2
    assert got[90].emptied and got[91].text == "short" and got[92].text is None and got[92].n_lines == 0
    out = line_templates.without_recurring(docs)
    assert out.count() == len(ROWS) and out.columns[: len(docs.columns)] == docs.columns
    assert line_templates.without_recurring(none).isEmpty()


def test_long_lines_recur_from_two_documents_on(spark):
    passage, other, sums = prose(1, 55), prose(2, 60), " ".join(f"row {i} {i}" for i in range(12))
    table = [
        (1, f"{prose(11, 30)}\n{passage} on 12 May"), (2, f"{passage} on 13 May\n{prose(12, 30)}"), (3, f"{prose(13, 25)}\n{other}\n{prose(3, 8)}"), (4, f"{other}\n{prose(14, 25)}"),
        (5, f"{other}\n{other}\nend"), (6, f"{prose(3, 8)}\n{sums}"), (7, f"{prose(15, 25)}\n{sums}"),
    ]
    got = {r.doc_id: r for r in line_templates.without_recurring(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()}
    gone = {2: prose(12, 30), 4: prose(14, 25), 5: "end"}  # short lines and lines of numbers don't recur in two documents
    assert {d: r.text for d, r in got.items()} == {d: gone.get(d, t) for d, t in table} and got[5].n_dropped == 2


def test_quality(spark, docs, none, labels):
    clean = [(i, prose(i, 120), "en" if i % 2 else "de") for i in range(60)]
    junk = [(100 + i, prose(i, 60).upper().replace(" ", "### "), "en") for i in range(5)]
    marked = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame([*clean, *junk, (200, "", "en"), (201, None, None)], "doc_id long, text string, lang string"), marked).collect()}
    assert not any(got[i].kept for i in range(100, 105)) and sum(got[i].kept for i in range(60)) >= 58 and got[200].kept and got[201].kept
    assert quality.quality(docs, labels).count() == len(ROWS) and quality.keep_good(docs, labels).columns == docs.columns
    assert quality.quality(none, labels).isEmpty()
    nothing = labels.where("false")
    assert quality.quality(docs, nothing).where("not kept").isEmpty()


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney over bytes, by dictionaries: the log probability of each byte of a text."""
    pad = b"\n" * (order - 1)
    raw = Counter(w for t in texts for p in [pad + t] for w in (p[i : i + order] for i in range(len(t))))
    counts = {order: raw}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(w[1:] for w in counts[n + 1])
    discount, contexts = {}, {}
    for n in range(2, order + 1):
        n1, n2, n3, n4 = (sum(c == k for c in counts[n].values()) for k in range(1, 5))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        discount[n] = [0] + [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]
        contexts[n] = {}
        for w, c in counts[n].items():
            contexts[n].setdefault(w[:-1], []).append(c)

    def probability(gram):
        n = len(gram)
        if n == 1:
            return (counts[1][gram] + 0.5) / (sum(counts[1].values()) + 128)
        lower, seen = probability(gram[1:]), contexts[n].get(gram[:-1])
        if not seen:
            return lower
        c, d = counts[n][gram], discount[n]
        return max(c - d[min(c, 3)], 0) / sum(seen) + sum(d[min(x, 3)] for x in seen) / sum(seen) * lower

    return lambda t: sum(math.log(probability((pad + t)[i : i + order])) for i in range(len(t)))


def test_perplexities_are_those_of_a_plain_model(spark, docs, none, monkeypatch):
    table = [(i, prose(i, 20 + i), "en") for i in range(12)] + [(20, "", "en"), (None, "Ünique  text\n\nof no id \x02\x03", None), (3, prose(77, 5), "de"), (21, None, "de"), (22, "zq " * 400, "en")]
    counted = [0, 1, 2, 3, 4, 5]
    expect = plain_model([(t or "").encode() for d, t, _ in table if d in counted], quality.ORDER)
    df, ids = spark.createDataFrame(table, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame([(c,) for c in counted], "doc_id long")
    monkeypatch.setattr(quality, "SLICE", 700)  # texts longer and shorter than a slice
    got = sorted(((r.doc_id, r.n_bytes, r.lang, r.log_p) for r in quality.perplexities(df, ids).collect()), key=str)
    want = sorted(((d, len((t or "").encode()), lang, expect((t or "").encode())) for d, t, lang in table), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-4 * max(1, abs(w[3])) for g, w in zip(got, want))
    assert quality.perplexities(none, ids).isEmpty() and quality.perplexities(docs, ids.where("false")).count() == len(ROWS)


def test_thresholds_come_from_texts_that_are_not_counted(spark):
    table = [(i, prose(i, 20 + i % 90), "en" if i % 3 else "de") for i in range(300)] + [(400 + i, prose(i, 50)[::-1], "fr") for i in range(5)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(250)], "doc_id long, quality int")
    held = {r.doc_id for r in labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(quality.HELD)) == 0).collect()}
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    expect = plain_model([t.encode() for d, t, _ in table if d < 250 and d not in held], quality.ORDER)
    surprise = {d: -expect(t.encode()) / len(t.encode()) for d, t, _ in table}
    root = {d: min(len(t.encode()), quality.STEADY) ** 0.5 for d, t, _ in table}

    def above(ids):
        middle = sorted(surprise[d] for d in ids)[-(-len(ids) // 2) - 1]
        over = sorted((surprise[d] - middle) * root[d] for d in ids)
        return middle, over[-(-round(quality.HIGH * len(over) * 1000) // 1000) - 1]

    of = {k: above([d for d in held if k is None or table[d][2] == k]) for k in ("en", "de", None)}
    for d, _, lang in table:
        middle, over = of.get(lang, of[None])
        assert abs(math.log(got[d].threshold) - middle - over / root[d]) < 1e-3
        if abs(surprise[d] - middle - over / root[d]) > 1e-3:
            assert got[d].kept == (surprise[d] < middle + over / root[d])
    assert not any(got[400 + i].kept for i in range(5))


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abc "), 600)).encode()
    codes, counts = quality.distinct_grams(np.frombuffer(text, np.uint8), np.asarray([len(text)]))
    shards = {s: quality.Shard(codes[part], counts[part]) for s, part in quality.by_shard(codes, 8)}
    numbers = Counter()
    for shard in shards.values():
        for k, n in zip(*(x.tolist() for x in shard.statistics())):
            numbers[k] += n
    base = quality.Base(numbers)
    for code in codes[:40]:
        all_next = (code & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
        assert abs(np.exp(shards[int(quality.shard_of(code[None], 8)[0])].score(all_next, base)).sum() - 1) < 1e-6


def test_toxicity(spark, docs, none, labels):
    bad = ["vile", "grobian", "nasty"]
    table = [(i, prose(i, 90) + (f" {bad[i % 3]} {prose(i + 1, 20)}" if i % 4 == 0 else "")) for i in range(400)]
    marked = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(table, "doc_id long, text string"), marked).collect()}
    wrong = sum(got[i].predicted != (i % 4 == 0) for i in range(400) if i >= 300 or got[i].held_out)
    assert wrong <= 3 and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    out = toxicity.toxicity(docs, labels)
    assert out.count() == len(ROWS) and out.where("score is null or score < 0 or score > 1").isEmpty()
    assert toxicity.keep_clean(docs, labels).columns == docs.columns and toxicity.toxicity(none, labels).isEmpty()
    assert toxicity.toxicity(docs, labels.where("false")).where("predicted = 1").isEmpty()


def test_gradients():
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, mask = rng.standard_normal((6, 4, toxicity.INPUTS)), np.arange(6)[:, None] < np.array([6, 3, 1, 5])
    project = lambda: {d: x @ net.p["W" + d] + net.p["c" + d] for d in "fb"}
    cache: dict = {}
    weights = rng.standard_normal(4)
    net.forward(project(), mask, cache)
    grads = net.gradients(x, mask, cache, weights)
    shown = {**net.p, "x": x}
    for k in set(shown) - {"words", "runs"}:
        at = tuple(rng.integers(0, s) for s in shown[k].shape)
        old, sides = shown[k][at], []
        for step in (1e-3, -1e-3):
            shown[k][at] = old + step
            sides.append(float(net.forward(project(), mask) @ weights))
        shown[k][at] = old
        assert abs((sides[0] - sides[1]) / 2e-3 - grads[k][at]) < 5e-3 * max(1, abs(grads[k][at]))


def test_scores_are_those_of_a_plain_forward_pass():
    """Every window of every text, unit by unit and step by step; the worst one gives the score."""
    rng = np.random.default_rng(6)
    words = {w: (float(rng.normal()), float(rng.random())) for w in WORDS[:9]}
    runs = np.unique(toxicity.byte_runs(WORDS)[0])[::2]
    model = toxicity.Model(words, runs, rng.normal(size=len(runs)).astype(np.float32), toxicity.Network(5), 0.2)
    p, m = model.network.p, toxicity.HIDDEN
    sigmoid = lambda v: 1 / (1 + math.exp(-v))

    def inputs(word):
        codes = [int.from_bytes(("^" + word + "$").encode()[i : i + 5], "big") for i in range(len(word) - 2)]
        odds = [float(model.run_odds[list(runs).index(c)]) if c in runs else 0.0 for c in codes]
        chars = np.mean([p["runs"][toxicity.run_rows(np.asarray([c]))[0]] for c in codes], 0) if codes else np.zeros(toxicity.VECTOR)
        own = [*words.get(word, (0.0, 0.0)), 1.0, *((max(odds), sum(odds) / len(odds), min(odds), min(len(odds), 10) / 10) if odds else (0, 0, 0, 0))]
        return np.concatenate([own, p["words"][zlib.crc32(word.encode()) % toxicity.ROWS], chars])

    def states(d, x):
        h, out = np.zeros(m), []
        for v in x if d == "f" else x[::-1]:
            a, g = v @ p["W" + d] + p["c" + d], h @ p["U" + d]
            z, r = ([sigmoid(a[k + i] + g[k + i]) for i in range(m)] for k in (0, m))
            new = [math.tanh(a[2 * m + i] + r[i] * g[2 * m + i]) for i in range(m)]
            h = np.asarray([z[i] * h[i] + (1 - z[i]) * new[i] for i in range(m)])
            out.append(h)
        return out if d == "f" else out[::-1]

    def window(of):
        x = [inputs(w) for w in of]
        hidden = [np.concatenate(pair) for pair in zip(states("f", x), states("b", x))]
        e = np.exp([np.tanh(h @ p["A"] + p["a"]) @ p["v"] for h in hidden])
        return sigmoid(float(sum(w * h for w, h in zip(e / e.sum(), hidden)) @ p["o"] + p["b"][0]))

    texts = ["Seven, old", prose(4, 30).upper(), prose(5, 64), prose(6, 150), ""]
    for text, got in zip(texts, model.scores(pa.array(texts))):
        of = [w.lower().strip(",") for w in text.split()]
        begins = [0, *range(toxicity.STRIDE, len(of) - toxicity.WINDOW + toxicity.STRIDE, toxicity.STRIDE)]
        assert abs(got - (max(window(of[i : i + toxicity.WINDOW]) for i in begins) if of else 0.2)) < 1e-4


def test_training_takes_one_row_of_a_doc_id(spark):
    """Repeated rows of a doc_id, and rows without one, leave the model as it is."""
    ids = [i for i in range(80) if zlib.crc32(str(i).encode()) % 5]
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(None, 1)], "doc_id long, toxic int")
    table = [(i, prose(i, 20) + " vile" * (i % 2)) for i in ids]
    models = [toxicity.train(spark.createDataFrame(t, "doc_id long, text string"), labels) for t in (table, [*table, *table[:1] * 30, (None, "no id")])]
    assert models[0].base == models[1].base == sum(i % 2 for i in ids) / len(ids) and models[0].words == models[1].words


def test_progressive_jpeg(docs, none):
    def one(d, t):
        p = t.encode() + b" " * (-len(t.encode()) % 192 or (192 if not t else 0))
        return d, len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])

    stored = progressive_jpeg.media(docs)
    assert rows(progressive_jpeg.digests(stored), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == expected(one)
    tensor = next(r for r in progressive_jpeg.tensors(stored).collect() if r.doc_id == 0)
    assert len(tensor.rgb) == 3 * tensor.height * tensor.width
    assert progressive_jpeg.digests(progressive_jpeg.media(none)).isEmpty()
    with pytest.raises(ValueError):
        list(progressive_jpeg.decode(b"no image"))


def test_scans_bit_by_bit(monkeypatch):
    """The general decoder gives what the one for runs of equal codes gives."""
    data = progressive_jpeg.write_payload(bytes(np.random.default_rng(4).integers(0, 256, 192 * 7, dtype=np.uint8)))
    (fast, quants), = progressive_jpeg.decode(data)
    slow_huffman = progressive_jpeg._huffman
    monkeypatch.setattr(progressive_jpeg, "_huffman", lambda body: ((k, {**t, (16, 65534): 0}) for k, t in slow_huffman(body)))
    (slow, _), = progressive_jpeg.decode(data)
    assert all((a.coefficients == b.coefficients).all() for a, b in zip(fast.components, slow.components))
    x = np.zeros((1, 64), np.float32)
    x[0, 0] = 80
    assert np.allclose(x @ progressive_jpeg.INVERSE, 10)


def test_paragraph_sketch(docs, spark, none):
    table = [(i, "\n".join(prose(k, 12) for k in range(i, i + 1 + i * 3))) for i in range(1, 40)] + [(50, None), (51, ""), (52, LONG), (53, LONG + "\nend"), (54, LONG), (55, "\n".join(f"p{i}" for i in range(3000)))]
    table += [(60, ". ".join(prose(i, 15) for i in range(30)) + "."), (61, "no end of sentence " * 60), (62, "é!" * 900)]
    got = {r.doc_id: r for r in paragraph_sketch.fingerprints(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    order = sorted(((d, t or "") for d, t in table), reverse=True)
    cut = lambda p: re.findall(r"(?s).{200}[^.!?]*[.!?]+|.+\Z", p) if len(p) > 400 else [p]
    parts = lambda t: {x for p in t.split("\n") if p for x in cut(p)}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (d, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(got[d].near_edited - like(parts(t), parts(edited))) < 1e-9 and abs(got[d].near_next - like(parts(t), parts(after))) < 1e-9
    assert got[60].near_edited > 0  # one long line, of which two thirds stay
    assert got[52].fingerprint == got[54].fingerprint != got[53].fingerprint
    assert paragraph_sketch.fingerprints(docs).count() == len(ROWS) and paragraph_sketch.fingerprints(none).isEmpty()
