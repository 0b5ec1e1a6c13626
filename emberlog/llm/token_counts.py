"""Token counts without ids: pieces once per distinct pre-token, joined to per-document frequencies, summed."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blockdict, common


_LOADED: dict = {}


def _tokenizer(path: str):
    """The tokenizer at ``path``, loaded once by a worker process."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def _finder(special: tuple[str, ...]):
    """Pre-tokens of a text for byte-level BPE; the tokenizer's special strings are pre-tokens of their own."""
    import public_tokenizers
    import regex

    find = regex.compile(public_tokenizers.PATTERN).findall
    if not special:
        return find
    cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split

    def found(text: str) -> list[str]:
        if not any(s in text for s in special):
            return find(text)
        return [t for i, part in enumerate(cut(text)) for t in ([part] if i % 2 else find(part))]

    return found


def frequencies(ids, texts, tokens, begins) -> bytes:
    each = [np.unique(tokens[a:b], return_counts=True) for a, b in zip(begins, begins[1:])]
    join = lambda k: np.concatenate([x[k] for x in each]) if each else np.zeros(0, np.int64)
    raw = [t.encode() for t in texts.to_pylist()]
    return blockdict.pack(
        null=np.asarray(ids.is_null()).astype(np.uint8), ids=np.asarray(ids.fill_null(0)), n_bytes=np.asarray([*map(len, raw)], np.int64), crc32=np.asarray([*map(zlib.crc32, raw)], np.int64),
        distinct=np.asarray([len(x[0]) for x in each], np.int64), tokens=blockdict.smallest(join(0)), n=blockdict.smallest(join(1)),
    )


def _sums(limit: int):
    def finish(body: dict, values: list) -> pa.Table:
        pieces = np.frombuffer(b"".join(values), "<u4").astype(np.int64)
        each = pieces[body["tokens"]] * body["n"].astype(np.int64) if len(body["tokens"]) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(each)])
        ends = np.cumsum(body["distinct"])
        n = total[ends] - total[ends - body["distinct"]]
        return pa.table({"doc_id": pa.array(body["ids"], mask=body["null"].astype(bool)), "n_bytes": body["n_bytes"], "n_tokens": n, "over_limit": n > limit})

    return finish


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, special: tuple[str, ...] = ("<|endoftext|>",)) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; ``tokenizer``: path of a byte-level BPE of the tokenizers library.

    A null or empty text has 0 tokens and 0 bytes; rows with equal or null doc_id give a row each; other columns
    are not read; an empty table gives no rows. A very long text is a block of its own."""

    def value():
        tok = _tokenizer(tokenizer)

        def pieces(keys: list[str]) -> list[bytes]:
            out: list[bytes] = []
            for i in range(0, len(keys), 20_000):
                out += [len(e).to_bytes(4, "little") for e in tok.encode_batch_fast(keys[i : i + 20_000], add_special_tokens=False)]
            return out

        return pieces

    encoded = blockdict.encode_blocks(docs, lambda: _finder(special), frequencies)
    return blockdict.joined(encoded, blockdict.valued(encoded, value), _sums(limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
