"""Language identification by prediction by partial matching over byte context trees.

For each language a tree holds, for every context of up to ORDER bytes, the counts of the
bytes that followed; white space is coded like any other byte and contexts run across words.
A byte's code length is that of its longest known context; where the byte did not follow
there, an escape (distinct successors over total plus distinct) passes to the next shorter
context with the seen bytes excluded, down to all 256 bytes.  Statistics are frozen after
fitting, so a byte's length depends on the ORDER bytes before it alone: the exact code length
of a text is a sum over its windows of ORDER + 1 bytes.

A window is one number: the number of context bytes, those bytes with the nearest first, and
the byte coded.  All counts and lengths are found for whole arrays of windows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import crc_mod, held, i64, mix, release, small_batches, texts

ORDER = 4
#: Labelled rows to fit on for each language, in expectation; the sample is by hash of the id.
SAMPLE = 600
#: Labels that are learned at most; a column with more is refused, as trees and tables grow with them.
LANGUAGES = 64
FOLDS = 5
#: Windows coded in one step, and cells of the table that remembers them.
STEP, CELLS = 1 << 17, 1 << 22
UNKNOWN = "und"
_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    return text is not None and (bool(_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace"))))


def joined(own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the place in its text of each."""
    size = np.array([len(t) for t in own], np.int64)
    return np.frombuffer(b"".join(own), np.uint8), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def contexts(data: np.ndarray, place: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of context bytes (at most ORDER) of data[first:last], and these bytes, the nearest in the highest place."""
    have = np.minimum(place[first:last], ORDER)
    packed = np.zeros(last - first, np.uint64)
    for j in range(1, min(ORDER, last - 1) + 1):
        before = np.zeros(last - first, np.uint64)
        at = max(first, j)
        before[at - first :] = data[at - j : last - j]
        packed |= np.where(have >= j, before, np.uint64(0)) << np.uint64(8 * (ORDER - j))
    return have, packed


def key(order: int, packed: np.ndarray) -> np.ndarray:
    """The context of the nearest `order` bytes as one number."""
    return np.uint64(order << 8 * ORDER) | packed >> np.uint64(8 * (ORDER - order))


def counts(own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all orders in the texts, sorted, and how often each stands there."""
    data, place = joined(own)
    found = []
    for at in range(0, len(data), STEP):
        end = min(len(data), at + STEP)
        have, packed = contexts(data, place, at, end)
        for k in range(ORDER + 1):
            ok = have >= k
            found.append(np.unique(key(k, packed[ok]) << np.uint64(8) | data[at:end][ok], return_counts=True))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    names, inverse = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    n = np.zeros(len(names), np.int64)
    np.add.at(n, inverse, np.concatenate([x for _, x in found]))
    return names, n


def _find(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted number in a sorted table, -1 where it is missing."""
    if not len(table):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return np.where(table[at] == wanted, at, -1)


class Tree:
    """Frozen statistics of one language.

    A context's successors are among those of its suffix, so what exclusion leaves at the
    suffix depends on the two nodes alone, and so does the cost of each escape on the way down.
    """

    def __init__(self, windows: np.ndarray, n: np.ndarray) -> None:
        self.windows, self.n = windows, n.astype(np.float32)
        context = windows >> np.uint64(8)
        self.nodes, first = np.unique(context, return_index=True)
        self.distinct = 256 - (int(np.searchsorted(context, np.uint64(1))) if len(context) else 0)
        if not len(windows):
            return
        kinds, total = np.diff(np.append(first, len(windows))), np.add.reduceat(n, first)
        order = (self.nodes >> np.uint64(8 * ORDER)).astype(np.int64)
        bits = self.nodes & np.uint64((1 << 8 * ORDER) - 1)
        suffix = np.where(order > 0, np.where(order > 0, order - 1, 0).astype(np.uint64) << np.uint64(8 * ORDER) | bits >> np.uint64(8), 0).astype(np.uint64)
        below = _find(self.nodes, suffix)
        # Of the suffix, what is left once this node's successors are excluded.
        same = _find(windows, np.repeat(suffix, kinds) << np.uint64(8) | windows & np.uint64(255))
        left = total[below] - np.add.reduceat(n[same], first)
        kinds_left = kinds[below] - kinds
        self.weight = (left + kinds_left).astype(np.float32)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where((kinds_left > 0) & (order > 0), np.log2((left + kinds_left) / np.maximum(kinds_left, 1)), 0.0)
        path = np.zeros(len(order))
        for k in range(1, ORDER + 1):
            own = order == k
            path[own] = escape[own] + path[below[own]]
        self.own, self.escape, self.path = (total + kinds).astype(np.float32), np.log2((total + kinds) / kinds).astype(np.float32), path.astype(np.float32)

    def bits(self, have: np.ndarray, packed: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Code length of each byte after its context."""
        if not len(self.windows):
            return np.full(len(byte), 8.0)
        out, open_ = np.full(len(byte), np.nan), np.ones(len(byte), bool)
        top, above = np.full(len(byte), -1), np.full(len(byte), -1)
        for k in range(ORDER, -1, -1):
            at = np.flatnonzero(open_ & (have >= k))
            context = key(k, packed[at])
            node = _find(self.nodes, context)
            known = node >= 0
            at, node, context = at[known], node[known], context[known]
            pair = _find(self.windows, context << np.uint64(8) | byte[at])
            hit, first = pair >= 0, top[at] < 0
            direct, down = hit & first, hit & ~first
            out[at[direct]] = np.log2(self.own[node[direct]] / self.n[pair[direct]])
            up, start = above[at[down]], top[at[down]]
            out[at[down]] = self.escape[start] + self.path[start] - self.path[up] + np.log2(self.weight[up] / self.n[pair[down]])
            open_[at[hit]] = False
            top[at[first]] = node[first]
            above[at] = node
        rest = np.flatnonzero(open_)
        out[rest] = self.escape[top[rest]] + self.path[top[rest]] + np.log2(max(1, self.distinct))
        return out


class Scorer:
    """Code lengths of texts under each tree. Windows of late are remembered in a table of fixed size, which changes no value."""

    def __init__(self, trees: dict[str, Tree], cells: int = CELLS) -> None:
        self.langs, self.trees = list(trees), list(trees.values())
        slots = 1 << max(8, (cells // max(1, len(trees))).bit_length() - 1)
        self.shift = np.uint64(64 - (slots.bit_length() - 1))
        self.names, self.known = np.full(slots, np.iinfo(np.uint64).max, np.uint64), np.zeros((slots, len(trees)), np.float32)

    def _code(self, have: np.ndarray, packed: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Bits of each window by language."""
        window = have.astype(np.uint64) << np.uint64(8 * ORDER + 8) | packed << np.uint64(8) | byte
        slot = (mix(window) >> self.shift).astype(np.int64)
        out = self.known[slot]
        new = np.flatnonzero(self.names[slot] != window)
        if len(new):
            names, first, inverse = np.unique(window[new], return_index=True, return_inverse=True)
            at = new[first]
            bits = np.stack([t.bits(have[at], packed[at], byte[at]) for t in self.trees], 1).astype(np.float32)
            out[new] = bits[inverse]
            # Where several windows meet in a slot, the last one written owns the name and the bits.
            self.names[slot[at]] = names
            self.known[slot[at]] = bits
        return out

    def bits(self, own: list[bytes]) -> np.ndarray:
        """Bits of each whole text by language."""
        data, place = joined(own)
        text, out = np.repeat(np.arange(len(own)), [len(t) for t in own]), np.zeros((len(own), len(self.trees)))
        for at in range(0, len(data), STEP):
            end = min(len(data), at + STEP)
            have, packed = contexts(data, place, at, end)
            found, whose = self._code(have, packed, data[at:end]), text[at:end]
            for k in range(len(self.trees)):
                out[whose[0] : whose[-1] + 1, k] += np.bincount(whose - whose[0], found[:, k], whose[-1] - whose[0] + 1)
        return out

    def best(self, own: list[bytes | None]) -> list[tuple[str, float, float | None]]:
        """Language, its posterior probability, and its bits a byte, of each text."""
        out: list[tuple[str, float, float | None]] = [(UNKNOWN, 0.0, None)] * len(own)
        lettered = [k for k, t in enumerate(own) if self.trees and has_letter(t)]
        for k, bits in zip(lettered, self.bits([own[k] for k in lettered]), strict=True):
            b = int(bits.argmin())
            out[k] = (self.langs[b], float(1 / np.exp2(np.maximum(bits[b] - bits, -1000)).sum()), float(bits[b] / len(own[k])))
        return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample: int = SAMPLE, most: int = LANGUAGES) -> dict[str, Tree]:
    """Trees by language, from about `sample` labelled rows of each, whole texts; rows without text or label are passed over.

    The counts are summed on the executors; what comes to the driver is bounded by the sample
    and by `most` languages: more labels than that are an error.
    """
    small_batches(docs.sparkSession)
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(key_col).alias("key")).filter("text IS NOT NULL AND lang IS NOT NULL")
    rows = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()}
    if len(rows) > most:
        raise ValueError(f"more than {most} languages")
    if not rows:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in rows.items() for x in (k, min(1.0, sample / n))])
    place = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = labelled.filter(place < share[F.col("lang")]).select("text", "lang")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            own: dict[str, list[bytes]] = {}
            for text, lang in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
                own.setdefault(lang, []).append(text)
            for lang, found in own.items():
                names, n = counts(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(names), np.int32))), i64(names), pa.array(n)], names=["lang", "window", "n"])

    seen = picked.mapInArrow(fn, "lang string, window long, n long").groupBy("lang", "window").agg(F.sum("n").alias("n")).toArrow()
    lang, windows, n = seen["lang"].to_numpy(zero_copy_only=False), seen["window"].to_numpy().astype(np.uint64), seen["n"].to_numpy()
    out = {}
    for name in sorted(rows):
        own = np.flatnonzero(lang == name)
        own = own[np.argsort(windows[own])]
        out[name] = Tree(windows[own], n[own])
    return out


def predict(docs: DataFrame, trees: dict[str, Tree], text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and bits_per_byte (null if und), in place of columns of those names.

    Null texts and texts without a letter are und with score 0.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "bits_per_byte")
    given = docs.sparkSession.sparkContext.broadcast(trees)
    own = uuid.uuid4().hex
    names = [*docs.columns, "lang_pred", "score", "bits_per_byte"]
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("langid", own), lambda: Scorer(given.value))
        for batch in batches:
            lang, score, rate = zip(*scorer.best(texts(batch, text_col)), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=names)

    return docs.mapInArrow(fn, schema)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit on the labelled rows outside fold 0 of the id's crc32 and predict every row: doc_id, held_out, lang_pred, score, bits_per_byte."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", crc_mod(F.col("doc_id"), FOLDS).alias("fold"))
    trees = fit(base.filter("fold <> 0"), sample=sample)
    seen = base.select("doc_id", F.coalesce(F.col("fold") == 0, F.lit(False)).alias("held_out"), "text")
    return predict(seen, trees).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")
