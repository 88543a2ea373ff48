"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding.

A piece of n bytes is a row of live positions.  A segment tree holds, for each span of
positions, the least (rank, position) of the pairs that start there; its root is the leftmost
pair of the least rank.  A merge changes the pair at the place, its left neighbour's pair and
the pair that went: three point updates of logarithmic cost, so a piece of n bytes costs
O(n log n) however long it is.  Pieces are remembered per worker up to a fixed number.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Memo, held, small_batches

CACHE_PIECES = 400_000


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    """Token bytes -> rank of a file of base64 tokens; the default is the public 50k vocabulary."""
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece; merges the leftmost pair of least rank until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 1).bit_length()
    bits = n.bit_length()
    none = 1 << 62
    rank = ranks.get
    tree = [none] * (2 * size)
    for i in range(n - 1):
        if (r := rank(piece[i : i + 2])) is not None:
            tree[size + i] = r << bits | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            a, b = tree[k], tree[k ^ 1]
            k >>= 1
            least = a if a < b else b
            if tree[k] == least:
                break
            tree[k] = least

    after = list(range(1, n + 1))  # the next live position, and so the end of the token here
    before = list(range(-1, n - 1))
    mask = (1 << bits) - 1
    while (root := tree[1]) != none:
        i = root & mask
        j = after[i]
        k = after[i] = after[j]
        put(j, none)
        if k < n:
            before[k] = i
            r = rank(piece[i : after[k]])
            put(i, none if r is None else r << bits | i)
        else:
            put(i, none)
        if (h := before[i]) >= 0:
            r = rank(piece[h:k])
            put(h, none if r is None else r << bits | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder(Memo):
    """Text -> ids as little-endian unsigned 32-bit bytes, piece by piece."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN) -> None:
        super().__init__(self._piece, CACHE_PIECES)
        self.ranks, self.pieces = ranks, regex.compile(pattern).findall

    def _piece(self, piece: str) -> bytes:
        ids = encode_piece(piece.encode(), self.ranks)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text)))


def held_encoder(path: str | None, ranks: dict[bytes, int]) -> Encoder:
    """The worker's encoder for that vocabulary; its memory outlives a task."""
    return held(("bpe", path), lambda: Encoder(ranks))


def decoder(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def decode(ids: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_table(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """docs with a column of token ids (array<int>); a null text counts as empty. Other columns stay, one of the new name is replaced."""
    small_batches(docs.sparkSession)
    if ids_col == text_col:
        raise ValueError("the ids need a column of their own")
    docs = docs.drop(ids_col)
    given = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    names = [*docs.columns, ids_col]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held_encoder(path, given.value)
        for batch in batches:
            found = [np.frombuffer(encoder.encode(x or ""), "<u4").astype(np.int32) for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=names)

    return docs.mapInArrow(fn, T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode_table(df: DataFrame, ids_col: str = "ids", bytes_col: str = "bytes", path: str | None = None) -> DataFrame:
    """df with the bytes that the ids stand for, in place of a column of that name; null ids give null. An id outside the vocabulary is an error."""
    if ids_col == bytes_col:
        raise ValueError("the bytes need a column of their own")
    small_batches(df.sparkSession)
    df = df.drop(bytes_col)
    given = df.sparkSession.sparkContext.broadcast(load_ranks(path))
    names = [*df.columns, bytes_col]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = decoder(given.value)
        for batch in batches:
            out = [None if ids is None else b"".join(tokens[i] for i in ids) for ids in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=names)

    return df.mapInArrow(fn, T.StructType([*df.schema.fields, T.StructField(bytes_col, T.BinaryType())]))


def encoding_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, and SHA-256 of the ids and of the bytes they decode to. Null text: empty."""
    small_batches(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = held_encoder(path, given.value), decoder(given.value)
        for batch in batches:
            n, sha, back = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encoder.encode(text or "")
                n.append(len(ids) // 4)
                sha.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(decode(ids, tokens)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(fn, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
