"""Language-model scoring by a subword lattice.

The pieces of an existing vocabulary weight all segmentations of a word: a forward recursion
in log space sums over every path, so a word's probability is marginal over its
segmentations.  Pieces do not cross white space.  The vocabulary's scores are ranks; the piece
of rank r weighs 1 / (r + OFFSET), and these weights, with one for the end, sum to one.

``lattice_score`` is the marginal probability of the document under the vocabulary alone: the
product over its words and one end.  ``score`` is that of the model which also knows the
corpus: a word seen c times in N training tokens of V kinds has (c + V q) / (N + V), where q is
its marginal probability in the lattice (the share V of Witten and Bell is what all training
documents say of unseen words).  The probabilities of all words and the end sum to one.

A word is scored once for the whole corpus.  The FREQUENT commonest words (a fixed number,
so a bounded broadcast) are looked up where the documents are read; only the rest is joined
by word, summed by document before the shuffle.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LONG, crc_mod, i64, release, small_batches, texts, written

FOLDS = 10
FREQUENT = 65_536
#: Words, and bytes of words over LONG, that a task counts before it passes them on.
HELD_WORDS, HELD_BYTES = 500_000, 16 << 20
#: Cells of the table in which words of like length are scored together.
GROUP_CELLS = 500_000
ALPHA = 0.1
OFFSET = 2.7
MARK = "▁"
LN10 = math.log(10)


class Lattice:
    """Log weights of pieces and of bytes, which stand for characters that no piece has.

    Words are taken in groups of like length: edges are found by dictionary, and the forward
    and backward recursions run over a whole group, place by place.
    """

    def __init__(self, pieces: list[str], weights: np.ndarray, bytes_: np.ndarray) -> None:
        self.pieces, self.weights, self.bytes = pieces, weights, bytes_
        #: Place of each piece, and -1 for what only begins one.
        self.index = {p[:k]: -1 for p in pieces for k in range(1, len(p))} | {p: k for k, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)

    def _groups(self, words: list[str]) -> Iterator[np.ndarray]:
        """Places of the words, by length, so that a group's table has at most GROUP_CELLS cells."""
        sizes = np.array([len(w) + 1 for w in words])
        order, at = np.argsort(sizes, kind="stable"), 0
        while at < len(order):
            n = 1
            while at + n < len(order) and (n + 1) * sizes[order[at + n]] * self.longest <= GROUP_CELLS:
                n += 1
            yield order[at : at + n]
            at += n

    def _edges(self, words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, bytes]]]:
        """Cells (word, place, length) of the pieces in the words, the pieces, and the cells of characters left to bytes."""
        get, longest, cells, found, rest = self.index.get, self.longest, [], [], []
        for k, word in enumerate(words):
            n = len(word)
            for i in range(n):
                cell = (k * width + i) * longest
                p = get(word[i])
                if p is None or p < 0:
                    rest.append((cell, word[i].encode()))
                else:
                    cells.append(cell)
                    found.append(p)
                j = i + 2
                while p is not None and j <= n:
                    p = get(word[i:j])
                    if p is not None and p >= 0:
                        cells.append(cell + j - i - 1)
                        found.append(p)
                    j += 1
        return np.array(cells, np.int64), np.array(found, np.int64), rest

    @staticmethod
    def _sum(terms: np.ndarray) -> np.ndarray:
        """Log of the sum of the exponentials of each row; -inf for none."""
        top = terms.max(1)
        top = np.where(np.isneginf(top), 0.0, top)
        with np.errstate(divide="ignore"):
            return np.log(np.exp(terms - top[:, None]).sum(1)) + top

    def run(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word over all its segmentations."""
        out = np.zeros(len(words))
        for places in self._groups(words):
            own = [MARK + words[k] for k in places]
            size = np.array([len(w) for w in own])
            n, width = len(own), int(size.max())
            cells, found, rest = self._edges(own, width)
            table = np.full(n * width * self.longest, -np.inf)
            table[cells] = self.weights[found]
            for cell, data in rest:
                table[cell] = sum(self.bytes[b] for b in data)
            w = table.reshape(n, width, self.longest)
            alpha = np.full((n, width + 1), -np.inf)
            alpha[:, 0] = 0.0
            for j in range(1, width + 1):
                back = np.arange(1, min(self.longest, j) + 1)
                alpha[:, j] = self._sum(alpha[:, j - back] + w[:, j - back, back - 1])
            out[places] = alpha[np.arange(n), size]
        return out


def vocabulary(model: bytes) -> tuple[Lattice, float, float]:
    """The lattice of a vocabulary by its own order of scores, the log weight of the end, and the end's log share of all tokens.

    Bytes and the end weigh as much as a piece one rank below the last.  A word is a piece that
    begins one and others until the next begins, so words and the end share the tokens as the
    pieces that begin words and the end share their weights.
    """
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    order = sorted(ids, key=lambda i: (-sp.get_score(i), i))
    pieces = [sp.id_to_piece(i) for i in order]
    weight, low = 1 / (np.arange(len(order)) + OFFSET), 1 / (len(order) + OFFSET)
    total = weight.sum() + 257 * low
    begins = sum(w for p, w in zip(pieces, weight, strict=True) if p.startswith(MARK))
    return Lattice(pieces, np.log(weight / total), np.full(256, math.log(low / total))), math.log(low / total), math.log(low / (begins + low))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of the task with their counts in training rows and in others."""
    release()
    seen: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())

    long = 0

    def rows() -> pa.RecordBatch:
        train, rest = seen
        words = list(train.keys() | rest.keys())
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([train[w] for w in words], pa.int64()), pa.array([rest[w] for w in words], pa.int64())], names=["word", "train", "rest"])
        train.clear()
        rest.clear()
        return out

    for batch in batches:
        for text, learn in zip(texts(batch), batch.column(2).to_pylist(), strict=True):
            words = (text or b"").lower().split()
            seen[0 if learn else 1].update(words)
            if words and max(map(len, words)) > LONG:
                long += sum(len(w) for w in words if len(w) > LONG)
            if len(seen[0]) + len(seen[1]) > HELD_WORDS or long > HELD_BYTES:
                yield rows()
                long = 0
    yield rows()


def mixed(count: np.ndarray, lattice: np.ndarray, tokens: int, kinds: int) -> np.ndarray:
    """Log10 probabilities of tokens seen so often, given those in the lattice; without training the latter."""
    if not tokens:
        return lattice
    with np.errstate(divide="ignore"):
        unseen = math.log10(kinds) + lattice
        return np.where(count > 0, np.log10(np.maximum(count, 1) + 10.0**unseen), unseen) - math.log10(tokens + kinds)


def _commonest(scored: DataFrame) -> DataFrame:
    """The commonest words of at most LONG bytes, FREQUENT at most: those above a count that a histogram of eighths of octaves gives."""
    scored = scored.filter(F.length("word") <= LONG)
    eighth = F.floor(F.log2(F.col("train") + F.col("rest")) * 8)
    least, held = 1 << 20, 0
    for r in sorted(scored.groupBy(eighth.alias("e")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["e"]):
        held += r["n"]
        if held > FREQUENT:
            break
        least = r["e"]
    return scored.filter(eighth >= least)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score.

    Learns from rows whose id's crc32 modulo 10 is not 0; a row with a null id is neither
    learned from nor held out.  A null or empty text is its end alone.  Repeated rows count and
    are scored as often as they stand.  Without training rows the vocabulary alone scores.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    fold = crc_mod(F.col(id_col), FOLDS)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(fold != 0, F.lit(False)).alias("learn"), F.coalesce(fold == 0, F.lit(False)).alias("held_out"))
    words = written(base.select("doc_id", "text", "learn").mapInArrow(_count, "word binary, train long, rest long").groupBy("word").agg(F.sum("train").alias("train"), F.sum("rest").alias("rest")))
    ends = base.filter("learn").count()
    known = words.agg(F.coalesce(F.sum("train"), F.lit(0)).alias("n"), F.count(F.when(F.col("train") > 0, 1)).alias("v")).first()
    n_train, distinct = known["n"] + ends, known["v"] + (ends > 0)
    below = n_train + ALPHA * (distinct + 1)
    _, end_weight, end_share = vocabulary(model)
    given = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own, _, _ = vocabulary(given.value)
        for batch in batches:
            found = batch.column(0).to_pylist()
            value = own.run([w.decode() for w in found]) / LN10
            both = mixed(batch.column(1).to_numpy(), value, n_train, distinct)
            yield pa.RecordBatch.from_arrays([batch.column(0), i64(np.array([xxhash.xxh3_64_intdigest(w) for w in found], np.uint64)), batch.column(1), batch.column(2), pa.array(value, pa.float64()), pa.array(both, pa.float64())], names=["word", "h", "train", "rest", "lp", "mix"])

    scored = written(words.mapInArrow(weigh, "word binary, h long, train long, rest long, lp double, mix double"))
    common = _commonest(scored).select("word", "train", "lp", "mix").toArrow()
    train = common["train"].to_pylist()
    by_word = dict(zip(common["word"].to_pylist(), zip([int(c > 0) for c in train], [math.log10((c + ALPHA) / below) for c in train], common["lp"].to_pylist(), common["mix"].to_pylist(), strict=True), strict=True))
    frequent = spark.sparkContext.broadcast(by_word)
    end = (int(ends > 0), math.log10((ends + ALPHA) / below), end_weight / LN10, float(mixed(np.array([ends]), np.array([end_share / LN10]), n_train, distinct)[0]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        get = frequent.value.get
        for batch in batches:
            cols: tuple[list, ...] = tuple([] for _ in range(9))
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                text = text or b""
                row = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)
                tokens, (n_known, base_, lp, both) = 1, end
                for word, n in Counter(text.lower().split()).items():
                    tokens += n
                    if (v := get(word)) is None:
                        for c, x in zip(cols, (doc, row, xxhash.xxh3_64_intdigest(word), n, 0, 0.0, 0.0, 0.0, 0), strict=True):
                            c.append(x)
                    else:
                        n_known += n * v[0]
                        base_ += n * v[1]
                        lp += n * v[2]
                        both += n * v[3]
                for c, x in zip(cols, (doc, row, row & (1 << 64) - 1, tokens, n_known, base_, lp, both, 1), strict=True):
                    c.append(x)
            doc, row, h, *rest = cols
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(row, pa.int64()), i64(np.array(h, np.uint64)), *(pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()), strict=True))], names=["doc_id", "row", "h", "n", "known", "base", "lp", "mix", "whole"])

    # One pass gives, per document, a row of what the frequent words sum to and a row for each other word.  Both go
    # through one join: only the latter meet their word, the former only travel with them, dealt by a hash of the text.
    seen = base.select("doc_id", "text").mapInArrow(read, "doc_id long, row long, h long, n long, known long, base double, lp double, mix double, whole int")
    word = scored.select(F.col("h").alias("wh"), "train", F.col("lp").alias("w"), F.col("mix").alias("m"), F.lit(0).alias("of"))
    met = seen.join(word, (F.col("h") == F.col("wh")) & (F.col("whole") == F.col("of")), "left")
    rare = F.col("whole") == 0
    whole = met.select(
        "doc_id", "row", F.when(rare, 0).otherwise(F.col("n")).alias("n"), F.when(~rare, F.col("known")).when(F.col("train") > 0, F.col("n")).otherwise(0).alias("known"),
        F.when(rare, F.col("n") * F.log10((F.col("train") + ALPHA) / below)).otherwise(F.col("base")).alias("base"), F.when(rare, F.col("n") * F.col("w")).otherwise(F.col("lp")).alias("lp"), F.when(rare, F.col("n") * F.col("m")).otherwise(F.col("mix")).alias("mix"), F.col("whole"),
    )
    sums = whole.groupBy("doc_id", "row").agg(*[F.sum(c).alias(c) for c in ("n", "known", "base", "lp", "mix", "whole")])
    fold = crc_mod(F.col("doc_id"), FOLDS)
    # Repeated rows were summed together; each gets its share and its row back.
    each = lambda c, kind: (F.col(c) / F.col("whole")).cast(kind)
    return sums.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole")))).select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), each("n", "long").alias("n_tokens"), each("known", "long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), each("base", "double").alias("base_score"), each("mix", "double").alias("score"), each("lp", "double").alias("lattice_score"),
    )
