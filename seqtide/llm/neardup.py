"""MinHash near-dedup: a multi-index Hamming join over b-bit signatures, confirmed on full shingle sets.

A document's set of word shingles gives LANES minhashes of 16 bits.  The signature is split
into CHUNKS of WIDE lanes; two signatures that differ in at most 2 * CHUNKS - 1 lanes have,
by the pigeonhole principle, a chunk with at most one differing lane, so each chunk is indexed
once for each lane left out, and every pair under that distance meets in a bucket.  (A pair of
similarity s meets with probability 1 - (1 - s**6 - 6 s**5 (1 - s))**10, which misses fewer than
one in a million at 0.85.)  Below 0.80 the chunks are narrower and more, and more lanes may
differ, so that a pair at the similarity asked for is missed with probability below 5e-5.

Equal sets become one class first.  A bucket gives one edge from each member to its smallest,
never its pairs; the components of these edges are the groups within which links can lie.  A
group is compared in cells of two blocks, so no task holds more than two blocks and a large
group is spread; a cell confirms pairs on the full sets, passing over those already joined,
and returns only the links that join.  Texts are not sent to all cells of a large group at
once: its cells first compare signatures alone, which leaves smaller groups of documents that
are near by lanes; each of their documents is then confirmed against the group's smallest, and
only what has no link with that one is compared, cell by cell, with all others of its group.
The components of the confirmed links are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WordHash, i64, mix, release, small_batches, texts, word_hashes, written
from .components import connected_components

SHINGLE = 5
CHUNKS, WIDE = 10, 6
LANES = CHUNKS * WIDE
#: Lanes that may differ between two documents that are compared on their sets, at least: over 5 standard deviations above the mean at 0.85.
FAR = 26
#: Share of pairs at the similarity asked for that the buckets may miss, and that the lanes may.
MISS_BUCKETS, MISS_LANES = 3e-5, 2e-5
BLOCK_LEAST, BLOCK_MOST, BLOCK_SHINGLES = 64, 1024, 2_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.Generator(np.random.PCG64(20250101))
_FACTORS = _RNG.integers(1, 1 << 63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, cache: WordHash, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; a shorter text is one shingle, none without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words, cache)
    k = min(size, len(h))
    g = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        g = g * _STEP + h[i : len(h) - k + 1 + i]
    return np.unique(mix(g + np.uint64(k)))


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(LANES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[at : at + 2048, None] * _FACTORS).min(0), out=least)
    return (least & np.uint64(0xFFFF)).astype("<u2")


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest1, digest2, sig of every row of docs(doc_id, text)."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        cache = WordHash()
        for batch in batches:
            n, one, two, sig = [], [], [], []
            for text in texts(batch):
                s = shingle_set(text, cache)
                n.append(len(s))
                one.append(s.sum(dtype=np.uint64))
                two.append(mix(s * _STEP).sum(dtype=np.uint64))
                sig.append(signature(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), i64(np.array(one, np.uint64)), i64(np.array(two, np.uint64)), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "digest1", "digest2", "sig"])

    return docs.select("doc_id", "text").mapInArrow(fn, "doc_id long, n_shingles long, digest1 long, digest2 long, sig binary")


def width(percent: int) -> int:
    """Lanes of a chunk: the most, up to WIDE, at which buckets miss few enough pairs of the similarity."""
    s = percent / 100
    return next(w for w in range(WIDE, 0, -1) if LANES % w == 0 and (1 - s**w - w * s ** (w - 1) * (1 - s)) ** (LANES // w) < MISS_BUCKETS)


def far(percent: int) -> int:
    """Lanes that may differ: FAR, or more where more of the pairs of the similarity differ in more."""
    s = percent / 100
    return next(k for k in range(FAR, LANES + 1) if sum(comb(LANES, i) * (1 - s) ** i * s ** (LANES - i) for i in range(k + 1, LANES + 1)) < MISS_LANES)


def keys(sig: Column, wide: int = WIDE) -> Column:
    """The buckets of a signature: each chunk with each one of its lanes left out."""
    out = []
    for c in range(LANES // wide):
        for j in range(wide):
            at = 2 * wide * c + 1
            out.append(F.xxhash64(F.lit(c * wide + j), F.substring(sig, at, 2 * j), F.substring(sig, at + 2 * j + 2, 2 * (wide - 1 - j))))
    return F.array(*out)


def _cells(percent: int, confirm: bool):
    """Links of each cell that join: rows come sorted by cell, with block and label of each document; equal labels are joined already.

    Without confirm documents are linked that are near by lanes and size.
    """
    most = far(percent)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        cache, cell, held = WordHash(), None, []

        def compare() -> list[tuple[int, int]]:
            one_block = cell[1] == cell[2]
            ids, sets = [x[0] for x in held], [x[5] for x in held]
            size, block = np.array([x[4] for x in held]), np.array([x[1] for x in held])
            sig = np.stack([np.frombuffer(x[3], "<u2") for x in held])
            root, out = np.unique([x[2] for x in held], return_inverse=True)[1], []
            for i in range(len(ids) - 1):
                rest = slice(i + 1, None)
                ok = (root[rest] != root[i]) & (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))
                if not one_block:
                    ok &= block[rest] != block[i]
                near = np.flatnonzero(ok) + i + 1
                for k in near[(sig[near] != sig[i]).sum(1) <= most]:
                    if root[k] == root[i] or confirm and not _linked(sets[i], sets[k], percent):
                        continue
                    root[root == root[k]] = root[i]
                    if ids[i] != ids[k]:
                        out.append((ids[i], ids[k]))
            return out

        found: list[tuple[int, int]] = []
        for batch in batches:
            sets = (shingle_set(t, cache) for t in texts(batch)) if confirm else (None for _ in range(batch.num_rows))
            for group, low, high, block, label, doc, n, sig, own in zip(*(batch.column(k).to_pylist() for k in range(8)), sets, strict=True):
                if (group, low, high) != cell:
                    if len(held) > 1:
                        found += compare()
                    cell, held = (group, low, high), []
                held.append((doc, block, label, sig, n if own is None else len(own), own))
            yield _edges(found)
            found = []
        if len(held) > 1:
            yield _edges(compare())

    return fn


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["u", "v"])


def _stars(percent: int):
    """Links of documents with the first of their group: rows come sorted by group and salt, that one first."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        cache, first, of = WordHash(), [], None
        for batch in batches:
            found = []
            for group, salt, other, doc, text in zip(*(batch.column(k).to_pylist() for k in range(4)), texts(batch), strict=True):
                own = shingle_set(text, cache)
                if (group, salt) != of:
                    first, of = [], (group, salt)
                if not other:
                    first.append(own)
                elif any(_linked(x, own, percent) for x in first):
                    found.append((doc, group))
            yield _edges(found)

    return fn


def _blocked(member: DataFrame) -> DataFrame:
    """member(component, node, n, ...) with s, the number of blocks of its group.

    The sizes of groups are written first: the join then has an exchange of its own on each side, and Spark can split a large group.
    """
    docs, least = F.col("docs"), F.least(F.lit(BLOCK_MOST), F.greatest(F.lit(BLOCK_LEAST), F.floor(F.col("docs") / 32)))
    s = F.greatest(F.ceil(docs / least), F.ceil(F.col("all_n") / BLOCK_SHINGLES)).cast("int")
    return member.join(written(member.groupBy("component").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("all_n")).select("component", s.alias("s"))), "component")


def _dealt(placed: DataFrame) -> DataFrame:
    """Rows of cells(component, low, high, block, label, doc_id, n, sig) of placed(..., label, open, opened, closed).

    Open documents meet all blocks of their group, the others only the blocks of open ones;
    opened and closed are the numbers of these blocks.
    """
    block = F.when(F.col("open"), F.pmod(F.xxhash64("node"), F.greatest("opened", F.lit(1)))).otherwise(F.col("opened") + F.pmod(F.xxhash64("node"), F.greatest("closed", F.lit(1)))).cast("int")
    others = F.when(F.col("open"), F.col("opened") + F.col("closed")).otherwise(F.col("opened"))
    spread = placed.withColumn("block", block).filter(others > 0).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    return spread.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "label", F.col("node").alias("doc_id"), "n", "sig")


def _compared(cells: DataFrame, percent: int, confirm: bool) -> DataFrame:
    rows = cells.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high", "block", "doc_id")
    return rows.mapInArrow(_cells(percent, confirm), "u long, v long")


def _with_text(base: DataFrame, rows: DataFrame) -> DataFrame:
    """rows(doc_id, ...) with every text that the id has."""
    texts_ = base.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rows.join(texts_, "doc_id")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest id reachable.  Null texts and texts without words have no
    shingles and no links.  Rows that share an id are one document for linking.  A row with a
    null id is linked with nothing, has a null component and is kept.
    """
    if percent < 50:
        raise ValueError("the signature is made for a similarity of 0.5 or more")
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    all_ = written(signatures(base))
    linkable = all_.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = written(linkable.groupBy("digest1", "digest2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")))
    buckets = classes.select("rep", F.explode(keys(F.col("sig"), width(percent))).alias("key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("hub")).filter("c > 1").select("key", "hub")
    edges = buckets.join(shared, "key").filter("rep <> hub").select(F.col("rep").alias("u"), F.col("hub").alias("v")).distinct()
    groups = written(connected_components(edges))

    grouped = written(groups.join(classes, F.col("node") == F.col("rep")).select("component", "node", "n", "sig"))
    member = written(_blocked(grouped))
    stars, small, large = None, member.filter("s = 1"), member.filter("s > 1")
    apart = small.withColumn("label", F.col("node")).withColumn("open", F.lit(True)).withColumn("opened", F.col("s")).withColumn("closed", F.lit(0))
    if not large.isEmpty():
        plain = large.withColumn("label", F.col("node")).withColumn("open", F.lit(True)).withColumn("opened", F.col("s")).withColumn("closed", F.lit(0))
        near = connected_components(_compared(_dealt(plain), percent, confirm=False))
        member = written(_blocked(written(near.join(large.select("node", "n", "sig"), "node"))))
        salted = member.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("s")).cast("int"))
        rest = salted.filter("node <> component").select("component", "salt", F.lit(1).alias("other"), F.col("node").alias("doc_id"))
        first = rest.select("component", "salt").distinct().select("component", "salt", F.lit(0).alias("other"), F.col("component").alias("doc_id"))
        starred = _with_text(base, rest.unionByName(first)).repartition("component", "salt").sortWithinPartitions("component", "salt", "other")
        stars = written(starred.select("component", "salt", "other", "doc_id", "text").mapInArrow(_stars(percent), "u long, v long").distinct())
        known = member.join(stars.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left")
        known = known.withColumn("open", F.col("label").isNull() & (F.col("node") != F.col("component")))
        shares = written(known.groupBy("component").agg(F.count_if("open").alias("o"), F.count(F.lit(1)).alias("all")))
        opened = F.ceil(F.col("s") * F.col("o") / F.col("all")).cast("int")
        known = known.join(shares, "component").filter("o > 0").withColumn("opened", opened).withColumn("closed", F.ceil(F.col("s") * (F.col("all") - F.col("o")) / F.col("all")).cast("int"))
        apart = apart.unionByName(known.withColumn("label", F.coalesce("label", "node")).select(*apart.columns))
    links = _compared(_with_text(base, _dealt(apart)).select("component", "low", "high", "block", "label", "doc_id", "n", "sig", "text"), percent, confirm=True)
    joined = connected_components(links if stars is None else links.unionByName(stars))

    of_class = classes.join(joined, F.col("rep") == F.col("node"), "left").select("digest1", "digest2", F.coalesce("component", "rep").alias("component_id"))
    placed_all = all_.join(of_class, ["digest1", "digest2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    out = placed_all.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of docs whose document stands for its component; rows with a null id stay.

    Of rows with one id and one text one stays; different texts under one id stay all, or go all.
    """
    found = written(components(docs, id_col, text_col, percent).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    stay = found.filter("kept").select(F.col("doc_id").alias("__keep"))
    known = docs.filter(F.col(id_col).isNotNull()).join(stay, F.col(id_col).cast("long") == F.col("__keep"), "left_semi")
    if not found.filter("n > 1").isEmpty():
        known = known.dropDuplicates([id_col, text_col])
    return known.unionByName(docs.filter(F.col(id_col).isNull()))
