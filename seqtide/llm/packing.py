"""Packing by powers of two: each document falls into pieces of binary lengths, and equal lengths share a bucket.

A document of n tokens gives n // 1024 pieces of 1024 and one piece for each binary digit of
the rest.  Every piece is a sequence of its own, of a power-of-two length, so no sequence
holds two documents and none needs padding; sequences of one length are numbered in one
stretch, from which batches of equal shape are read.

One pass tokenizes and cuts; its rows are written once and numbered from the counts of each
(task, length), a table of 11 rows for each task that is summed length by length.  No text or
id is shuffled.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import held, small_batches, written

LONGEST = 1024
END = b"\0\0\0\0"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>, part int, nth long"


def vocabulary_ranks(vocabulary: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes -> id of a byte-level vocabulary file of the tokenizers library, ids in the order of its merges, and its added tokens."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    data = json.loads(vocabulary)
    added = {x["content"]: x["id"] for x in data["added_tokens"]}
    return {bytes(byte[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in added}, added


def held_encoding(vocabulary: str) -> tiktoken.Encoding:
    """The worker's encoder for that vocabulary: the ids that the tokenizers library gives, made several times faster."""

    def make() -> tiktoken.Encoding:
        ranks, added = vocabulary_ranks(vocabulary)
        return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    return held(("packing", zlib.crc32(vocabulary.encode())), make)


def cuts(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of n tokens, long ones first."""
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if n % longest >> k & 1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, keep_ids: bool = False, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A document is its ids by the byte-level vocabulary, then id 0; a null or empty text is that
    id alone.  As in the tokenizers library, an added token's string in a text is that token.  Null or repeated ids of documents are packed row by row like others; an empty
    table gives an empty result.  sequence_id counts from 0 without gaps, longest pieces first.
    """
    if longest < 2 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    small_batches(docs.sparkSession)
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        given = docs.sparkSession.sparkContext.broadcast(f.read())

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = held_encoding(given.value).encode_to_numpy
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            doc, start, length, crc, total, held, nth = [], [], [], [], [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, at = encode(text or "", allowed_special="all").astype("<u4").tobytes() + END, 0
                n = len(ids) // 4
                view = memoryview(ids)
                for k in cuts(n, longest):
                    piece = view[4 * at : 4 * (at + k)]
                    doc.append(name)
                    start.append(at)
                    length.append(k)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    held.append(piece.cast("I").tolist() if keep_ids else None)
                    nth.append(seen.get(k, 0))
                    seen[k] = nth[-1] + 1
                    at += k
            longs = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)]
            yield pa.RecordBatch.from_arrays(
                [*longs, pa.array(held, pa.list_(pa.int32())), pa.array([part] * len(doc), pa.int32()), pa.array(nth, pa.int64())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "part", "nth"],
            )

    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(fn, PIECES)
    pieces = written(pieces if keep_ids else pieces.drop("ids"))
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each length
    base = counts.groupBy("length").agg(F.sum("n").alias("all")).select("length", F.coalesce(F.sum("all").over(longer), F.lit(0)).alias("base"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stretch = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(base, "length").select("length", "part", (F.col("base") + F.col("before")).alias("first"))
    out = pieces.join(stretch, ["length", "part"]).withColumn("sequence_id", F.col("first") + F.col("nth"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), *(["ids"] if keep_ids else []))
