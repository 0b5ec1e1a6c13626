"""Byte-level BPE by a global shuffle of distinct words, and decoding by the table of token bytes."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blockdict, common
from .token_counts import _finder

_BPE: dict = {}
ENCODING = "doc_id long, ids binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _bpe(path: str):
    """The merges of the ranks at ``path``, loaded once by a worker process."""
    if path not in _BPE:
        import public_tokenizers
        import tiktoken

        _BPE[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    return _BPE[path]


def _positions(ids, texts, tokens, begins) -> bytes:
    return blockdict.pack(9, null=np.asarray(ids.is_null()).astype(np.uint8), ids=np.asarray(ids.fill_null(0)), n=np.diff(begins).astype(np.int64), **blockdict.split_ranks(tokens))


def _reassembled(body: dict, values: list, kind: str) -> tuple[pa.Array, list[bytes]]:
    """doc_id and the ids, as bytes, of each document of a block."""
    get, tokens = values.__getitem__, blockdict.whole_ranks(body["low"], body["rest"])
    ends = np.cumsum(body["n"])
    each = [np.frombuffer(b"".join(map(get, tokens[e - n : e].tolist())), kind).astype("<u4").tobytes() for e, n in zip(ends.tolist(), body["n"].tolist())]
    return pa.array(body["ids"], mask=body["null"].astype(bool)), each


def _encoded(docs: DataFrame, ranks_path: str):
    """The blocks, the ids of each word of their dictionaries, and these ids' type; every distinct word is encoded once."""
    kind = "<u2" if max(read_ranks(ranks_path).values(), default=0) < 1 << 16 else "<u4"

    def value():
        bpe = _bpe(ranks_path)
        return lambda words: [np.asarray(bpe._encode_single_piece(w.encode()), kind).tobytes() for w in words]

    encoded = blockdict.encode_blocks(docs, lambda: _finder(()), _positions)
    return encoded, blockdict.valued(encoded, value), kind


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every document.

    A null or empty text has no ids; rows with equal or null doc_id give a row each; other columns are not read."""

    blocks, words, kind = _encoded(docs, ranks_path)

    def finish(body, values):
        ids, each = _reassembled(body, values, kind)
        return pa.table({"doc_id": ids, "ids": pa.array(each, pa.binary())})

    return blockdict.joined(blocks, words, finish, ENCODING)


class TokenBytes:
    """The token-byte table: as many rows as the vocabulary, so every worker holds it whole."""

    def __init__(self, ranks_path: str):
        self.table = {rank: token for token, rank in read_ranks(ranks_path).items()}

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_TABLES: dict[str, TokenBytes] = {}


def token_bytes(ranks_path: str) -> TokenBytes:
    if ranks_path not in _TABLES:
        _TABLES[ranks_path] = TokenBytes(ranks_path)
    return _TABLES[ranks_path]


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and the decoded bytes of rows as encode() gives them; null ids decode to null."""

    def rows(batches):
        table = token_bytes(ranks_path)
        for b in batches:
            texts = [None if i is None else table.decode(i) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, bytes binary")


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, and sha256 of the ids and of the bytes that they decode to."""

    blocks, words, kind = _encoded(docs, ranks_path)

    def finish(body, values):
        ids, each = _reassembled(body, values, kind)
        table = token_bytes(ranks_path)
        return pa.table({
            "doc_id": ids, "n_tokens": pa.array([len(i) // 4 for i in each], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i in each], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(table.decode(i)).hexdigest() for i in each], pa.string()),
        })

    return blockdict.joined(blocks, words, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
