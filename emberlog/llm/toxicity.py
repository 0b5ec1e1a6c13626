"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as a word input (a learned vector; its log odds in the labelled sample, how often it was seen there) and
a character input (the mean of learned vectors of its runs of five bytes; their log odds). In training, a text's log odds
come from the other folds of the sample, as an unseen text's will. All overlapping windows of a text are scored;
its score is that of its worst window, and that window alone is trained on.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, pretokens

#: Words of a window and from one window to the next; hidden units of each direction and of the attention.
WINDOW, STRIDE, HIDDEN, ATTENTION = 64, 48, 8, 8
#: The labelled sample: at most so many rows of each label, those of the least hash of doc_id, and code points from either end of their texts. Words and runs of bytes kept.
SAMPLE_OF_LABEL, SAMPLE_CHARS, WORDS, RUNS, LEAST_SEEN = 1500, 100_000, 20_000, 60_000, 4
RUN, EPOCHS, UPDATES, RATE, FOLDS = 5, 5, 200, 0.02, 5
#: Log odds inputs of a word; rows (words and runs share one by their hash) and length of the learned vectors, and how much slower these learn.
ODDS, ROWS, VECTOR, SLOWER = 7, 8192, 4, 0.25
INPUTS = ODDS + 2 * VECTOR
_EDGE = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F), 0xA1, 0xAB, 0xBB, 0xBF, 0x2018, 0x2019, 0x201C, 0x201D, 0x2026]))


def distinct_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words in lower case without punctuation at their edges, the numbers of all texts' words, where each text begins."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    offsets = np.asarray(split.offsets).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    raw, codes = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)
    # white space at the edges of a text, and an empty text, leave empty strings
    real = np.asarray([bool(w) for w in raw], bool)[codes] if raw else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(real)])
    return [w.strip(_EDGE) for w in raw], codes[real], before[offsets - offsets[0]]


def byte_runs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the runs of RUN bytes of each word, with a mark at its edges, and how many each has."""
    raw = [b"^" + w.encode() + b"$" if w else b"" for w in words]
    counts = np.asarray([max(0, len(r) - RUN + 1) for r in raw], np.int64)
    flat = np.frombuffer(b"".join(raw) + bytes(RUN), np.uint8).astype(np.int64)
    codes = np.zeros(len(flat) - RUN + 1, np.int64)
    for k in range(RUN):
        codes = codes << 8 | flat[k : k + len(codes)]
    sizes = np.asarray([len(r) for r in raw], np.int64)
    starts = np.cumsum(sizes) - sizes
    ends = np.cumsum(counts)
    at = np.arange(int(counts.sum())) + np.repeat(starts - (ends - counts), counts)
    return codes[at], counts


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and size of every window; a text without words has none."""
    of, first, size = [], [], []
    for i, (a, e) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        at = a
        while at < e:
            of.append(i)
            first.append(at)
            size.append(min(WINDOW, e - at))
            if at + WINDOW >= e:
                break
            at += STRIDE
    return np.asarray(of, np.int64), np.asarray(first, np.int64), np.asarray(size, np.int64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """The weights, and forward and backward passes over windows."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        w = lambda *s: (rng.standard_normal(s) * 0.4 / np.sqrt(s[0])).astype(np.float32)
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("W", w(INPUTS, 3 * HIDDEN)), ("U", w(HIDDEN, 3 * HIDDEN)), ("c", np.zeros(3 * HIDDEN, np.float32)))}
        self.p |= {k: (rng.standard_normal((ROWS, VECTOR)) * 0.05).astype(np.float32) for k in ("words", "runs")}
        self.p |= {"A": w(2 * HIDDEN, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": w(ATTENTION), "o": w(2 * HIDDEN), "b": np.full(1, -1, np.float32)}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states of one direction; x: (steps, windows, 3 * HIDDEN), already projected."""
        steps, n, _ = x.shape
        out, h, u, m = np.zeros((steps, n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), self.p["U" + d], HIDDEN
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = h @ u
            zr = _sigmoid(x[t, :, : 2 * m] + g[:, : 2 * m])
            z, r = zr[:, :m], zr[:, m:]
            new = np.tanh(x[t, :, 2 * m :] + r * g[:, 2 * m :])
            if keep is not None:
                keep.append((t, h, z, r, new, g[:, 2 * m :]))
            h = np.where(mask[t][:, None], new + z * (h - new), h)
            out[t] = h
        return out

    def with_vectors(self, odds: np.ndarray, words: np.ndarray, runs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """All inputs of words: their odds inputs, the learned vectors at rows ``words``, and the mean of those at the rows of their runs."""
        return np.concatenate([odds, self.p["words"][words], _joined(self.p["runs"][runs], counts)], 1)

    def forward(self, projected: dict[str, np.ndarray], mask: np.ndarray, cache: dict | None = None) -> np.ndarray:
        """A logit for each window; projected: inputs times W plus c of each direction; mask: (steps, windows)."""
        kept: dict[str, list | None] = {d: None if cache is None else [] for d in "fb"}
        hidden = np.concatenate([self._run(d, projected[d], mask, kept[d]) for d in "fb"], 2)
        u = np.tanh(hidden @ self.p["A"] + self.p["a"])
        e = np.where(mask, u @ self.p["v"], -1e9)
        w = np.exp(e - e.max(0))
        w = w / w.sum(0)
        pooled = (w[:, :, None] * hidden).sum(0)
        if cache is not None:
            cache |= {"kept": kept, "hidden": hidden, "u": u, "w": w, "pooled": pooled}
        return pooled @ self.p["o"] + self.p["b"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, cache: dict, d_logit: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of all weights but the learned vectors, and of the inputs x (steps, windows, INPUTS), given those of the logits."""
        p, m, g = self.p, HIDDEN, {"x": np.zeros(x.shape, x.dtype)}
        hidden, u, w = cache["hidden"], cache["u"], cache["w"]
        g["o"], g["b"] = cache["pooled"].T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["o"]
        d_hidden = w[:, :, None] * d_pooled
        d_w = (hidden * d_pooled).sum(2)
        d_e = w * (d_w - (w * d_w).sum(0))
        g["v"] = np.einsum("tba,tb->a", u, d_e)
        d_u = d_e[:, :, None] * p["v"] * (1 - u * u)
        g["A"], g["a"] = np.einsum("tbh,tba->ha", hidden, d_u), d_u.sum((0, 1))
        d_hidden = d_hidden + d_u @ p["A"].T
        for k, d in enumerate("fb"):
            of, dh = d_hidden[:, :, k * m : (k + 1) * m], 0
            dw, du, dc = np.zeros_like(p["W" + d]), np.zeros_like(p["U" + d]), np.zeros_like(p["c" + d])
            for t, h, z, r, new, gn in reversed(cache["kept"][d]):
                dh = dh + of[t]
                on = mask[t][:, None]
                d_out = np.where(on, dh, 0)
                d_new = d_out * (1 - z) * (1 - new * new)
                d_z = d_out * (h - new) * z * (1 - z)
                d_r = d_new * gn * r * (1 - r)
                d_x = np.concatenate([d_z, d_r, d_new], 1)
                d_g = np.concatenate([d_z, d_r, d_new * r], 1)
                dw += x[t].T @ d_x
                g["x"][t] += d_x @ p["W" + d].T
                du += h.T @ d_g
                dc += d_x.sum(0)
                dh = np.where(on, d_out * z + d_g @ p["U" + d].T, dh)
            g |= {"W" + d: dw, "U" + d: du, "c" + d: dc}
        return g


def _joined(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The mean of each word's rows of ``values``, of which ``counts`` are a word's; zeros for none."""
    out = np.zeros((len(counts), *values.shape[1:]), np.float32)
    some = np.flatnonzero(counts)
    if len(some):
        begin = (np.cumsum(counts) - counts)[some]
        out[some] = np.add.reduceat(values, begin, 0) / counts[some].reshape(-1, *[1] * (values.ndim - 1))
    return out


def odds_inputs(word_odds: np.ndarray, seen: np.ndarray, run_odds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ODDS inputs of words from their log odds, how often each was seen, and the log odds of their runs."""
    x = np.zeros((len(counts), ODDS), np.float32)
    x[:, 0], x[:, 1], x[:, 2] = word_odds, seen, 1
    some = np.flatnonzero(counts)
    if len(some):
        begin = (np.cumsum(counts) - counts)[some]
        x[some, 3], x[some, 5] = np.maximum.reduceat(run_odds, begin), np.minimum.reduceat(run_odds, begin)
        x[some, 6] = np.minimum(counts[some], 10) / 10
    x[:, 4] = _joined(run_odds, counts)
    return x


def word_rows(words: list[str]) -> np.ndarray:
    """The row of the learned vectors of each word."""
    return np.fromiter((zlib.crc32(w.encode()) % ROWS for w in words), np.int64, len(words))


def run_rows(codes: np.ndarray) -> np.ndarray:
    """The row of the learned vectors of each run of bytes."""
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % ROWS


class Model:
    """Log odds of words and runs of bytes, and the network over them."""

    def __init__(self, words: dict[str, tuple[float, float]], runs: np.ndarray, run_odds: np.ndarray, network: Network, base: float):
        self.words, self.runs, self.run_odds, self.network, self.base = words, runs, run_odds, network, base

    def inputs(self, words: list[str]) -> np.ndarray:
        """The inputs of each distinct word."""
        none = (0.0, 0.0)
        seen = np.asarray([self.words.get(w, none) for w in words], np.float32).reshape(len(words), 2)
        codes, counts = byte_runs(words)
        odds = np.zeros(len(codes), np.float32)
        if len(codes) and len(self.runs):
            at = np.minimum(np.searchsorted(self.runs, codes), len(self.runs) - 1)
            odds = np.where(self.runs[at] == codes, self.run_odds[at], 0).astype(np.float32)
        return self.network.with_vectors(odds_inputs(seen[:, 0], seen[:, 1], odds, counts), word_rows(words), run_rows(codes), counts)

    def window_logits(self, inputs: np.ndarray, codes: np.ndarray, first: np.ndarray, size: np.ndarray, at_once: int = 1024) -> np.ndarray:
        net, out = self.network, np.zeros(len(first), np.float32)
        projected = {d: inputs @ net.p["W" + d] + net.p["c" + d] for d in "fb"}
        order = np.argsort(size, kind="stable")
        for i in range(0, len(order), at_once):
            some = order[i : i + at_once]
            steps = np.arange(int(size[some].max()))[:, None]
            mask = steps < size[some]
            at = codes[np.minimum(first[some] + steps, len(codes) - 1)]
            out[some] = net.forward({d: projected[d][at] for d in "fb"}, mask)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The score of each text: of its worst window; one without words gets the base rate of the sample."""
        words, codes, offsets = distinct_words(texts)
        of, first, size = windows(offsets)
        out = np.full(len(texts), -np.inf)
        if len(of):
            np.maximum.at(out, of, self.window_logits(self.inputs(words), codes, first, size))
        return np.where(np.isfinite(out), _sigmoid(out), min(self.base, 0.49))


def fit(texts: list[str], labels: list[int]) -> Model:
    """A model from labelled texts; if one label is missing, its scores are the base rate alone."""
    base = float(np.mean(labels)) if labels else 0.0
    if len(set(labels)) < 2:
        return Model({}, np.zeros(0, np.int64), np.zeros(0), Network(), base) if not labels or base < 0.5 else Model({}, np.zeros(0, np.int64), np.zeros(0), Network(), 0.49)
    y = np.asarray(labels, np.float32)
    words, codes, offsets = distinct_words(pa.array(texts, pa.string()))
    flat, counts = byte_runs(words)
    codes = codes.astype(np.int32)
    names, word_of = np.unique(np.asarray(words, object).astype(str), return_inverse=True) if words else (np.zeros(0, str), np.zeros(0, np.int64))
    runs, run_of = np.unique(flat, return_inverse=True)
    run_of = run_of.astype(np.int32)
    begin = np.cumsum(counts) - counts
    # (text, word) and (text, run), each once
    of_text = [np.unique(codes[a:e]) for a, e in zip(offsets, offsets[1:])]
    in_words = (np.unique(word_of[w]) for w in of_text)
    in_runs = (np.unique(run_of[pretokens.flat_gather(begin, counts, w)]) if len(w) else w for w in of_text)
    fold = np.arange(len(texts)) % FOLDS

    def seen(parts: Iterator[np.ndarray], n: int) -> np.ndarray:
        """How many texts of each fold and label have each of n."""
        out = np.zeros((FOLDS, 2, n), np.int32)
        for f, k, p in zip(fold.tolist(), labels, parts):
            out[f, k, p] += 1
        return out

    words_seen, runs_seen = seen(in_words, len(names)), seen(in_runs, len(runs))

    def odds(seen_: np.ndarray, texts_: np.ndarray, most: int) -> np.ndarray:
        """Log odds of label 1 from numbers of texts by label; zero but for the ``most`` telling ones seen LEAST_SEEN times."""
        n0, n1 = (seen_[k].astype(np.float64) for k in (0, 1))
        value = np.log((n1 + 0.5) / (texts_[1] + 1)) - np.log((n0 + 0.5) / (texts_[0] + 1))
        telling = np.where(n0 + n1 >= LEAST_SEEN, np.abs(value) * np.minimum(n0 + n1, 20), -1)
        kept = np.argsort(-telling, kind="stable")[:most]
        kept = kept[telling[kept] >= 0]
        out = np.zeros(len(value), np.float32)
        out[kept] = np.clip(value[kept], -4, 4)
        return out

    texts_seen = np.stack([[np.sum((fold == f) & (y == k)) for k in (0, 1)] for f in range(FOLDS)])
    often = lambda n: np.minimum(np.log1p(n.sum(0)), 6) / 6

    def features(without: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Odds inputs of all words, and the log odds of names and runs, from all folds but one."""
        use = [f for f in range(FOLDS) if f != without]
        own, of_run = odds(words_seen[use].sum(0), texts_seen[use].sum(0), WORDS), odds(runs_seen[use].sum(0), texts_seen[use].sum(0), RUNS)
        shown = np.where(own != 0, often(words_seen[use].sum(0)), 0)
        own[names == ""] = 0
        return odds_inputs(own[word_of], shown[word_of], of_run[run_of], counts), own, of_run

    by_fold = np.empty((FOLDS, len(words), ODDS), np.float16)
    for f in range(FOLDS):
        by_fold[f] = features(f)[0]
    _, own, of_run = features(None)
    shown, kept = often(words_seen.sum(0)), np.flatnonzero(of_run)
    model = Model({str(names[i]): (float(own[i]), float(shown[i])) for i in np.flatnonzero(own)}, runs[kept], of_run[kept], Network(), base)
    net, rows, of_runs = model.network, word_rows(words).astype(np.int32), run_rows(flat).astype(np.int32)
    del flat, run_of, words_seen, runs_seen
    of, first, size = windows(offsets)
    by_text = [np.flatnonzero(of == i) for i in range(len(texts))]
    rng, moment, second, step = np.random.default_rng(11), {}, {}, 0
    with_words = np.asarray([i for i, w in enumerate(by_text) if len(w)])
    batches = max(1, len(with_words) // 64)
    epochs = max(EPOCHS, -(-UPDATES // batches))  # a small sample needs more rounds for as many updates
    n1, n0 = int(y.sum()), len(y) - int(y.sum())
    for epoch in range(epochs):
        # the worst window of each text, as the network is now
        worst_of = {}
        for f in range(FOLDS):
            mine = [i for i in with_words.tolist() if fold[i] == f]
            if mine:
                own_windows = np.concatenate([by_text[i] for i in mine])
                logits = model.window_logits(net.with_vectors(by_fold[f].astype(np.float32), rows, of_runs, counts), codes, first[own_windows], size[own_windows])
                at = 0
                for i in mine:
                    n = len(by_text[i])
                    worst_of[i] = own_windows[at + int(np.argmax(logits[at : at + n]))]
                    at += n
        for batch in np.array_split(rng.permutation(with_words), batches):
            worst = np.asarray([worst_of[i] for i in batch.tolist()])
            steps = np.arange(int(size[worst].max()))[:, None]
            mask = steps < size[worst]
            used, at = np.unique(codes[np.minimum(first[worst] + steps, len(codes) - 1)], return_inverse=True)
            at = at.reshape(len(steps), len(worst))
            mine, n_runs = pretokens.flat_gather(begin, counts, used), counts[used]
            vectors = net.with_vectors(np.zeros((len(used), ODDS), np.float32), rows[used], of_runs[mine], n_runs)[:, ODDS:]
            inputs = np.concatenate([by_fold[fold[batch][None, :], used[at]].astype(np.float32), vectors[at]], 2)
            cache: dict = {}
            logit = net.forward({d: inputs @ net.p["W" + d] + net.p["c" + d] for d in "fb"}, mask, cache)
            target = y[batch]
            weight = np.where(target == 1, min(4.0, n0 / max(n1, 1)), 1.0) / len(batch)
            grads = net.gradients(inputs, mask, cache, ((_sigmoid(logit) - target) * weight).astype(np.float32))
            of_vectors = np.zeros((len(used), 2 * VECTOR), np.float32)
            np.add.at(of_vectors, at.reshape(-1), grads.pop("x")[:, :, ODDS:].reshape(-1, 2 * VECTOR))
            grads["words"], grads["runs"] = np.zeros((ROWS, VECTOR), np.float32), np.zeros((ROWS, VECTOR), np.float32)
            np.add.at(grads["words"], rows[used], of_vectors[:, :VECTOR])
            np.add.at(grads["runs"], of_runs[mine], np.repeat(of_vectors[:, VECTOR:] / np.maximum(n_runs, 1)[:, None], n_runs, 0))
            step += 1
            rate = RATE * (1 - 0.8 * epoch / epochs)
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                moment[k] = 0.9 * moment.get(k, 0) + 0.1 * g
                second[k] = 0.99 * second.get(k, 0) + 0.01 * g * g
                slower = SLOWER if k in ("words", "runs") else 1
                net.p[k] = (net.p[k] - slower * rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def held_out(doc_id) -> F.Column:
    """Whether a row is kept from training: crc32 of doc_id as text is divisible by 5."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labelled rows that aren't held out: SAMPLE_OF_LABEL doc_ids of each label at most, of each one
    row, and of that SAMPLE_CHARS code points from either end where it is longer. Labels other than 0 and 1, null doc_ids and doc_ids
    without a row aren't learned from; of repeated rows one is taken by the hash of its text; an empty sample gives scores of 0."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = [marked.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_OF_LABEL) for k in (0, 1)]
    text = F.when(F.char_length("text") > 2 * SAMPLE_CHARS, F.concat(F.substring("text", 1, SAMPLE_CHARS), F.lit("\n"), F.expr(f"right(text, {SAMPLE_CHARS})"))).otherwise(F.col("text"))
    found = common.id_text(docs).join(F.broadcast(by_hash[0].unionByName(by_hash[1])), "doc_id").select("doc_id", "toxic", text.alias("text"))
    sample = found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # at most 2 * SAMPLE_OF_LABEL rows of bounded texts

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "toxic"))))
        model = fit([t for _, t, _ in rows], [k for _, _, k in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
        del rows, model
        common.trim()

    # one task of an executor fits it: the driver gets the weights alone
    row = sample.coalesce(1).mapInArrow(fitted, "model binary").first()
    return fit([], []) if row is None else pickle.loads(row.model)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, with score added; a null text is an empty one. A column named score is replaced."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by WORDS and RUNS
    plain = docs.drop("score")
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pretokens.forget()
        for b in batches:
            texts = pc.fill_null(b.column(b.schema.get_field_index("text")), "")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.scores(texts), pa.float64())], names=[*b.schema.names, "score"])
            common.trim()

    return plain.mapInArrow(rows, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null or empty texts, or those without words, get the sample's base rate (below 0.5). Rows with equal or
    null doc_id give a row each; labels other than 0 and 1 aren't learned from; without labels all scores are 0."""
    out = scored(common.id_text(docs), train(docs, labels))
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with their columns, whatever these are called; nulls and repeats as in toxicity()."""
    plain = docs.toDF(*[c if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)])
    return scored(plain, train(docs, labels)).where("score < 0.5").drop("score").toDF(*docs.columns)


def op10_toxicity(spark, sf_dir) -> DataFrame:
    return toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
