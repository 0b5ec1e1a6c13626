"""Cutting texts into units that a tokenizer treats alone, and numbering the distinct ones.

A space between two characters that aren't white space always starts a new pre-token in the
patterns used here, so a text cut there can be tokenised unit by unit, and equal units once.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Marks the first unit of a text, which has no space before it; a lone surrogate is in no valid text.
FIRST = "\ud800"
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def safe_cut(text: str) -> list[str]:
    """Units of a text without the space before each; the first is marked. Cuts only at single spaces between words."""
    units = _SAFE.split(text)
    units[0] = FIRST + units[0]
    return units


def unsafe(unit: str) -> bool:
    """Whether white space at the edge of a unit ties it to its neighbours."""
    if unit.startswith(FIRST):
        return len(unit) > 1 and unit[-1].isspace()
    return not unit or unit[0].isspace() or unit[-1].isspace()


_SPACES = [chr(c).encode() for c in range(0x3001) if chr(c).isspace()]
_EDGES = np.zeros((2, 256), bool)
_EDGES[0, [c[0] for c in _SPACES]] = _EDGES[1, [c[-1] for c in _SPACES]] = True


def all_unsafe(units: pa.StringArray) -> np.ndarray:
    """unsafe() of each of many units; bytes at the edges tell of most that they aren't."""
    kind = np.int64 if pa.types.is_large_string(units.type) else np.int32
    _, at, data = units.buffers()
    at, data = np.frombuffer(at, kind)[units.offset : units.offset + len(units) + 1], np.frombuffer(data or b"", np.uint8)
    bad = at[1:] == at[:-1]
    some = np.flatnonzero(~bad)
    doubt = some[_EDGES[0, data[at[some]]] | _EDGES[1, data[at[some + 1] - 1]]]
    bad[doubt] = [unsafe(u) for u in units.take(pa.array(doubt)).to_pylist()]
    return bad


def surface(unit: str) -> str:
    return unit[1:] if unit.startswith(FIRST) else " " + unit


class Numbering(dict):
    """Numbers keys in the order in which they come."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def numbered_units(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct units, the numbers of the units of all texts, and where each text begins among these."""
    split = pc.split_pattern(texts, " ")
    offsets = np.asarray(split.offsets).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    offsets -= offsets[0]
    codes, units = np.asarray(coded.indices).astype(np.int32), coded.dictionary.to_pylist()
    firsts = Numbering()
    at = offsets[:-1]
    codes[at] = [len(units) + firsts[FIRST + units[c]] for c in codes[at].tolist()]
    units += firsts
    bad = np.concatenate([all_unsafe(coded.dictionary), np.fromiter(map(unsafe, firsts), bool, len(firsts))])
    touched = np.unique(np.searchsorted(offsets, np.flatnonzero(bad[codes]), "right") - 1) if bad.any() else ()
    if len(touched):
        more, pieces, sizes, done = Numbering(), [], np.diff(offsets), 0
        for i in touched.tolist():
            again = [len(units) + more[u] for u in safe_cut(texts[i].as_py())]
            pieces += [codes[offsets[done] : offsets[i]], np.asarray(again, np.int32)]
            sizes[i], done = len(again), i + 1
        codes = np.concatenate([*pieces, codes[offsets[done] :]])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        units += more
    return units, codes, offsets


def flat_gather(starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places of the items of each code, one code after the other, in a flat array of items."""
    n = lengths[codes]
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(n)
    kind = np.int32 if max(total, int(starts[-1] + lengths[-1])) < 1 << 31 else np.int64
    return np.arange(total, dtype=kind) + np.repeat((starts[codes] - (ends - n)).astype(kind), n)


def expanded(lengths: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the items of all codes in a flat array of items, and where each text then begins."""
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    ends = np.concatenate([[0], np.cumsum(lengths[codes])])
    return flat_gather(starts, lengths, codes), ends[offsets]


def numbered_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """As numbered_units, cut at ASCII white space: for tokenizers that drop white space."""
    split = pc.ascii_split_whitespace(texts)
    offsets = np.asarray(split.offsets).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int32), offsets - offsets[0]


class UnitCache:
    """Ids of texts by a tokenizer that sees each distinct unit once, but for a bounded memory.

    Known units are in two generations: when the young one is full it becomes the old one, whose units that
    come up again are young again, and those that don't are forgotten with it.

    New units go to the tokenizer JOINED at a time. Where it keeps white space, a unit's ids begin at the one
    token that begins with a space; where it drops it, a mark stands between units. A joined text whose
    beginnings or marks aren't as many as its units is encoded unit by unit."""

    #: Units in a joined text; joined texts in a call; the mark between units, which must give one id.
    JOINED, TEXTS, MARK = 256, 80, "~"
    #: Units that both generations hold about, and bytes of text cut at a time; so too for a lean cache, which takes less memory and more time.
    MOST, SLICE, LEAN = 1_500_000, 16 << 20, (600_000, 2 << 20)

    def __init__(self, tokenizer, dtype, most: int | None = None, cut: int | None = None):
        self.tokenizer, self.dtype, self.known, self.old = tokenizer, np.dtype(dtype), {}, {}
        self.most, self.cut = most or self.MOST, cut or self.SLICE
        self.drops = not self._encode([" \n\t"])[0]
        self.mark = self._encode([self.MARK])[0]
        self.opens = np.zeros(tokenizer.get_vocab_size(), bool)
        if not self.drops:
            self.opens[[n for t, n in tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joinable(self, unit: str) -> bool:
        return len(self.mark) == 1 if self.drops else bool(unit) and " " not in unit and unit[0] != FIRST and unit.strip() == unit

    def _bounds(self, ids: np.ndarray, n: int) -> tuple[list[int], list[int]] | None:
        """Where each of n joined units begins and ends, if that shows."""
        if self.drops:
            at = np.flatnonzero(ids == self.mark[0])
            return ([0, *(at + 1).tolist()], [*at.tolist(), len(ids)]) if len(at) == n - 1 else None
        at = np.flatnonzero(self.opens[ids])
        return (at.tolist(), [*at[1:].tolist(), len(ids)]) if len(at) == n and at[0] == 0 else None

    def _learn(self, fresh: list[str]) -> None:
        width, between = self.dtype.itemsize, f" {self.MARK} " if self.drops else " "
        joinable = [*map(self._joinable, fresh)]
        alone = [u for u, j in zip(fresh, joinable) if not j]
        units = [u for u, j in zip(fresh, joinable) if j]
        groups = [units[i : i + self.JOINED] for i in range(0, len(units), self.JOINED)]
        for i in range(0, len(groups), self.TEXTS):
            some = groups[i : i + self.TEXTS]
            for group, ids in zip(some, self._encode([" " + between.join(g) for g in some])):
                ids = np.array(ids, self.dtype)
                bounds = self._bounds(ids, len(group))
                if bounds is None:
                    alone += group
                    continue
                raw = ids.tobytes()
                self.known.update((u, raw[a * width : e * width]) for u, a, e in zip(group, *bounds))
        for i in range(0, len(alone), 20_000):
            part = alone[i : i + 20_000]
            self.known.update((u, np.asarray(ids, self.dtype).tobytes()) for u, ids in zip(part, self._encode([*map(surface, part)])))

    def _ids(self, units: list[str]) -> list[bytes]:
        if len(self.known) > self.most // 2:
            self.known, self.old = {}, self.known
        ids = [*map(self.known.get, units)]
        if self.old:
            again = {u: x for u in (units[k] for k, x in enumerate(ids) if x is None) if (x := self.old.get(u)) is not None}
            self.known.update(again)
            ids = [again.get(u) if x is None else x for u, x in zip(units, ids)]
        fresh = [k for k, x in enumerate(ids) if x is None]
        self._learn([units[k] for k in fresh])
        for k in fresh:
            ids[k] = self.known[units[k]]
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text begins among these."""
        ends = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)
        # some MB of texts are cut at a time (a text isn't split): what stands beside the ids stays small
        cuts = [0, *(np.flatnonzero(np.diff(ends // self.cut)) + 1).tolist(), len(texts)]
        parts = [self._encoded(texts.slice(a, e - a)) for a, e in zip(cuts, cuts[1:])]
        if len(parts) == 1:
            return parts[0]
        before = np.cumsum([0, *(len(ids) for ids, _ in parts)])
        begins = [b[:-1] + n for (_, b), n in zip(parts, before.tolist())]
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([*begins, before[-1:]])

    def _encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        units, codes, offsets = (numbered_words if self.drops else numbered_units)(texts)
        # numbers that only texts cut anew had are not used any more
        used = np.flatnonzero(np.bincount(codes, minlength=len(units)))
        if len(used) < len(units):
            renumber = np.zeros(len(units), np.int32)
            renumber[used] = np.arange(len(used))
            units, codes = [units[i] for i in used.tolist()], renumber[codes]
        ids = self._ids(units)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        places, begins = expanded(lengths, codes, offsets)
        return np.frombuffer(b"".join(ids), self.dtype)[places], begins


_LOADED: dict = {}


def unit_cache(path: str, dtype="<u4", lean: bool = False) -> UnitCache:
    """The cache over tokenizers' tokenizer at ``path``; one for each worker process."""
    if (path, dtype, lean) not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _LOADED[path, dtype, lean] = UnitCache(Tokenizer.from_file(path), dtype, *(UnitCache.LEAN if lean else ()))
    return _LOADED[path, dtype, lean]


def forget() -> None:
    """Drop the units that this worker's caches hold; stages that don't use them call this."""
    for cache in _LOADED.values():
        cache.known, cache.old = {}, {}
