"""Substring dedup: seed and extend over winnowed word anchors.

Seeds: of the 5-word grams of every ``min_words`` window the smallest hash is the window's
anchor, so equal windows have equal anchors wherever they stand.  One anchor owns a run of
neighbouring windows; the run's words (the anchor, extended both ways as far as it is owned)
are its context.  Occurrences with equal anchor and context are matched whole; where an
anchor has different contexts, the ends of a maximal repeat lie inside the run and the
windows themselves are compared.

Data flow: one narrow shuffle of runs by anchor (about one row for nine words), one of the
few windows left open, and two of the texts by id, to extend and to cut.  Each map task
removes its own repeats of a run first, so a passage that stands in a third of all documents
costs one row for each BLOCK runs, and an anchor with many contexts in a block is dealt out
by context.  Nothing is collected; no pairs are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sequences import ordered_ids
from ._common import Powers, WordHash, i64, mix, release, small_batches, texts, word_hashes, written

GRAM = 5
BLOCK = 150_000
#: An anchor with more contexts than this in one block is dealt out by context.
MANY = 16
SALTS = 251
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
RUNS = "akey long, salt int, ctx long, doc_id long, run long, kind int"
WINS = "w1 long, w2 long, doc_id long, start long, kind int"


def _runs(h: np.ndarray, size: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """Anchor, context, first and last window of each run of windows that share their anchor."""
    n = len(h) - size + 1
    g = h[: len(h) - GRAM + 1].copy()
    for k in range(1, GRAM):
        g = g * np.uint64(_BASES[0]) + h[k : len(h) - GRAM + 1 + k]
    g = mix(g)
    v, at, width, span = g, np.arange(len(g)), size - GRAM + 1, 1
    while span < width:  # rightmost place of the least of the next `width` grams
        s = min(span, width - span)
        right = v[s:] <= v[:-s]
        v, at = np.where(right, v[s:], v[:-s]), np.where(right, at[s:], at[:-s])
        span += s
    own = at[:n]
    first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return g[own[first]], powers.spans(powers.prefix(h), first, last + size), first, last


def _first_of(keys: list[np.ndarray], rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys then rows, and for each place whether a smaller row has its keys; equal rows count as one."""
    order = np.lexsort([*rows[::-1], *keys[::-1]])
    new = np.ones(len(order), bool)
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    new[1:] = ~same
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = np.zeros(len(order), bool)
    for r in rows:
        later |= r[order] != r[order][head]
    return order, later


def _seed_rows(size: int, block: int, many: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        cache, powers, parts, held = WordHash(), Powers(_BASES[1]), [], 0

        def flush() -> pa.RecordBatch:
            anchor, ctx, doc, run = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, later = _first_of([anchor, ctx], [doc, run])
            anchor, ctx, doc, run = anchor[order], ctx[order], doc[order], run[order]
            names, inverse, count = np.unique(anchor[~later], return_inverse=True, return_counts=True)
            hot = np.zeros(len(anchor), bool)
            hot[~later] = count[inverse] > many
            salt = np.where(later, -1, np.where(hot, 1 + (ctx % np.uint64(SALTS)).astype(np.int64), 0))
            anchor = np.where(later, mix(doc.view(np.uint64) * np.uint64(_BASES[0]) + run.view(np.uint64)), anchor)
            marks = names[count > many]
            m = len(marks)
            return pa.RecordBatch.from_arrays(
                [
                    i64(np.concatenate([anchor, marks])),
                    pa.array(np.concatenate([salt, np.zeros(m, np.int64)]).astype(np.int32)),
                    i64(np.concatenate([ctx, ~marks])),
                    pa.concat_arrays([i64(doc), pa.nulls(m, pa.int64())]),
                    i64(np.concatenate([run, np.zeros(m, np.int64)])),
                    pa.array(np.concatenate([later.astype(np.int32), np.full(m, 2, np.int32)])),
                ],
                names=["akey", "salt", "ctx", "doc_id", "run", "kind"],
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                if doc is None or text is None or len(words := text.split()) < size:
                    continue
                anchor, ctx, first, last = _runs(word_hashes(words, cache), size, powers)
                parts.append((anchor, ctx, np.full(len(anchor), doc, np.int64), first * size + (last - first)))
                held += len(anchor)
                if held >= block:
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()

    return fn


def _window_rows(size: int, block: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        cache, one, two, parts, held = WordHash(), Powers(_BASES[0]), Powers(_BASES[1]), [], 0

        def flush() -> pa.RecordBatch:
            w1, w2, doc, start = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, later = _first_of([w1, w2], [doc, start])
            w1, w2, doc, start = w1[order], w2[order], doc[order], start[order]
            w1 = np.where(later, mix(doc.view(np.uint64) * np.uint64(_BASES[0]) + start.view(np.uint64)), w1)
            return pa.RecordBatch.from_arrays([i64(w1), i64(w2), i64(doc), i64(start), pa.array(later.astype(np.int32))], names=["w1", "w2", "doc_id", "start", "kind"])

        for batch in batches:
            for doc, text, runs in zip(batch.column(0).to_pylist(), texts(batch), batch.column(2).to_pylist(), strict=True):
                h = word_hashes((text or b"").split(), cache)
                run = np.unique(np.array(runs, np.int64))
                first, more = run // size, run % size
                start = np.repeat(first, more + 1) + np.concatenate([np.arange(k + 1) for k in more])
                start = start[start + size <= len(h)]
                parts.append((one.spans(one.prefix(h), start, start + size), two.spans(two.prefix(h), start, start + size), np.full(len(start), doc, np.int64), start))
                held += len(start)
                if held >= block:
                    yield flush()
                    parts, held = [], 0
        if parts and held:
            yield flush()

    return fn


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, block: int = BLOCK, many: int = MANY) -> DataFrame:
    """Word spans (doc_id, spans array<struct<s,e>>) covered by windows of min_words words that also start earlier.

    Earlier: in a document of a smaller id, or in the same one before.  Null texts, null ids
    and texts shorter than a window give no span; rows that share an id must share their text
    (see _with_spans).  An empty table gives an empty result.
    """
    if min_words < GRAM + 1:
        raise ValueError(f"min_words must be over {GRAM}")
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    runs = base.mapInArrow(_seed_rows(min_words, block, many), RUNS).repartition("akey", "salt")
    alike, same = Window.partitionBy("akey", "salt"), Window.partitionBy("akey", "salt", "ctx").orderBy("doc_id", "run")
    found = (
        runs.withColumn("open", (F.min("ctx").over(alike) != F.max("ctx").over(alike)) | (F.col("salt") > 0))
        .withColumn("later", (F.rank().over(same) > 1) | (F.col("kind") == 1))
        .filter((F.col("kind") < 2) & (F.col("later") | F.col("open")))
        .select("doc_id", "run", "later")
    )
    found = written(found)
    to_compare = found.filter(~F.col("later")).groupBy("doc_id").agg(F.collect_list("run").alias("runs"))
    wins = base.join(to_compare, "doc_id").select("doc_id", "text", "runs").mapInArrow(_window_rows(min_words, block), WINS)
    again = wins.withColumn("nth", F.rank().over(Window.partitionBy("w1", "w2").orderBy("doc_id", "start"))).filter((F.col("nth") > 1) | (F.col("kind") == 1))
    first = F.floor(F.col("run") / min_words)
    whole = found.filter("later").select("doc_id", first.alias("s"), (first + F.col("run") % min_words + min_words).alias("e"))
    parts = again.select("doc_id", F.col("start").alias("s"), (F.col("start") + min_words).alias("e"))
    return whole.unionByName(parts).groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def covered(n: int, spans: list[dict] | None) -> np.ndarray:
    """Which of n words the spans cover."""
    step = np.zeros(n + 1, np.int64)
    for x in spans or ():
        step[min(x["s"], n)] += 1
        step[min(x["e"], n)] -= 1
    return np.cumsum(step[:n]) > 0


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with __id: the id, or where ids have several texts a number in the order of id and the text's hash, for each of them."""
    keyed = docs.withColumn("__id", F.col(id_col).cast("long"))
    names = keyed.filter(F.col("__id").isNotNull()).select("__id", F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("__hash"))
    if names.groupBy("__id").agg(F.min("__hash").alias("a"), F.max("__hash").alias("b")).filter("a <> b").isEmpty():
        return keyed
    order = ordered_ids(names.distinct(), "__id", "__hash").withColumnRenamed("sid", "__nth")
    return keyed.withColumn("__hash", F.xxhash64(F.coalesce(text_col, F.lit("")))).join(order, ["__id", "__hash"], "left").drop("__id", "__hash").withColumnRenamed("__nth", "__id")


def _with_spans(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """docs with __spans. Rows with one id and one text are one document; different texts under one id are several, in the order of their hashes."""
    docs = _numbered(docs, id_col, text_col)
    spans = repeated_spans(docs, "__id", text_col, min_words).select(F.col("doc_id").alias("__id"), F.col("spans").alias("__spans"))
    return docs.join(spans, "__id", "left").drop("__id")


def removal_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space. Null text: no words."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            n, gone, sha = [], [], []
            for text, spans in zip(texts(batch), batch.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                out = covered(len(words), spans) if spans else None
                kept = words if out is None else [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                n.append(len(words))
                gone.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _with_spans(base, "doc_id", "text", min_words).select("doc_id", "text", "__spans").mapInArrow(fn, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """All rows and columns of docs, with repeated passages cut out of the text.

    A text without repeats stays byte for byte; elsewhere the covered words go with the white
    space after them.  Null texts stay null; a text that is one repeat becomes empty.
    """
    joined = _with_spans(docs, id_col, text_col, min_words)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            out = []
            for text, spans in zip(texts(batch, text_col), batch.column(batch.schema.get_field_index("__spans")).to_pylist(), strict=True):
                out.append(text if not spans or text is None else cut(text, spans))
            k = batch.schema.get_field_index(text_col)
            new = batch.set_column(k, pa.field(text_col, pa.string()), pa.array(out, pa.binary()).cast(pa.string()))
            yield new.select(names)

    names = docs.columns
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType, True) for f in docs.schema])
    return joined.mapInArrow(fn, schema)


def cut(text: bytes, spans: list[dict]) -> bytes:
    words = text.split()
    gone = covered(len(words), spans).tolist()
    out, at, pending = [], 0, 0
    for word, drop in zip(words, gone, strict=True):
        begin = text.index(word, at)
        if drop:
            out.append(text[pending:begin])
            pending = begin + len(word)
            while pending < len(text) and text[pending] in b" \t\n\x0b\x0c\r":
                pending += 1
        at = begin + len(word)
    out.append(text[pending:])
    return b"".join(out)
