"""Substring and near-duplicate operators against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from seqtide.llm import neardup, substring
from seqtide.llm.components import connected_components


def brute_substring(rows, size=20):
    """doc_id -> (n_words, n_removed, sha) for rows with ids, windows judged in order of (id, start)."""
    first, out = {}, {}
    keyed = sorted((r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None)
    for doc, text in keyed:
        w = text.encode().split()
        for p in range(len(w) - size + 1):
            first.setdefault(tuple(w[p : p + size]), (doc, p))
    for r in rows:
        w = (r[1] or "").encode().split()
        gone = [False] * len(w)
        if r[0] is not None:
            for p in range(len(w) - size + 1):
                if first[tuple(w[p : p + size])] < (r[0], p):
                    gone[p : p + size] = [True] * size
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[r[0]] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("block,many", [(substring.BLOCK, substring.MANY), (300, 1)])
def test_substring_matches_brute_force(docs, rows, block, many, monkeypatch):
    monkeypatch.setattr(substring.repeated_spans, "__defaults__", ("doc_id", "text", 20, block, many))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.removal_digest(docs).collect()}
    assert got == brute_substring(rows)
    assert sum(v[1] for v in got.values()) > 500


def test_substring_repeated_rows_and_empty_table(crowded, rows, none):
    got = substring.removal_digest(crowded).collect()
    assert len(got) == 2 * len(rows)
    want = brute_substring(rows)
    assert all((r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]] for r in got)
    assert substring.removal_digest(none).collect() == []


def test_substring_texts_that_share_an_id(spark):
    """Different texts under one id are documents of their own: no passage leaves the corpus."""
    passage, other = " ".join(f"p{i}" for i in range(30)), " ".join(f"q{i}" for i in range(30))
    rows = [(1, "one"), (2, passage), (2, other), (3, passage + " end"), (3, passage + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r["doc_id"], r["text"]) for r in substring.remove_repeats(docs).collect())
    assert out == [(1, "one"), (2, passage), (2, other), (3, "end"), (3, "end")]


def test_remove_repeats_keeps_columns_and_clean_texts(crowded, rows):
    out = substring.remove_repeats(crowded)
    assert out.columns == crowded.columns
    want, texts = brute_substring(rows), {r[0]: r[1] for r in rows}
    for r in out.collect():
        if want[r["doc_id"]][1] == 0:
            assert r["text"] == texts[r["doc_id"]]
        else:
            assert len(r["text"].encode().split()) == want[r["doc_id"]][0] - want[r["doc_id"]][1]


def test_cut_keeps_the_rest_of_the_text():
    assert substring.cut(b"a  b\nc d ", [{"s": 1, "e": 3}]) == b"a  d "
    assert substring.cut(b" a b", [{"s": 0, "e": 2}]) == b" "


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}


def test_near_duplicates_match_brute_force(docs, rows, none):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.components(docs).collect()}
    lone = got.pop(None)
    assert lone[1] is None and lone[2]
    assert got == brute_components(rows)
    assert Counter(v[1] for v in got.values()).most_common(1)[0][1] > 1
    assert neardup.components(none).collect() == []


def test_large_groups_are_compared_in_cells(spark, monkeypatch):
    """A chain of near copies over many blocks is one component; unlike texts of one family stay apart."""
    monkeypatch.setattr(neardup, "BLOCK_LEAST", 2)
    monkeypatch.setattr(neardup, "BLOCK_MOST", 3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(12):
        base = base[:10 * k] + [f"v{k}"] + base[10 * k + 1 :]
        rows.append((k, " ".join(base)))
    other = [f"w{i}" if i % 9 else f"z{i}" for i in range(200)]
    rows.append((50, " ".join(other)))
    got = {r["doc_id"]: r["component_id"] for r in neardup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: v[1] for i, v in brute_components(rows).items()}
    assert len({got[k] for k in range(12)}) == 1 and got[50] == 50


@pytest.mark.parametrize("seed", [1, 2])
def test_families_of_one_template(spark, monkeypatch, seed):
    """Documents that share half of a template and lie at any distance from one another, in many blocks."""
    monkeypatch.setattr(neardup, "BLOCK_LEAST", 4)
    monkeypatch.setattr(neardup, "BLOCK_MOST", 7)
    rng, rows = random.Random(seed), []
    template = [f"t{i}" for i in range(60)]
    for _ in range(12):
        own = [f"o{rng.random()}" for _ in range(60)]
        for _ in range(rng.randint(1, 9)):
            words = template + own
            for at in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4, 9])):
                words[at] = f"c{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    sent = []
    real = neardup._with_text
    monkeypatch.setattr(neardup, "_with_text", lambda base, r: sent.append(r) or real(base, r))
    got = {r["doc_id"]: r["component_id"] for r in neardup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: v[1] for i, v in brute_components(rows).items()}
    assert got == want and len(set(want.values())) < len(rows)
    assert sum(r.count() for r in sent) < 6 * len(rows)


def test_keep_one(crowded, rows):
    out = neardup.keep_one(crowded, percent=85)
    assert out.columns == crowded.columns
    want = brute_components(rows)
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == sorted(i for i, v in want.items() if v[2])


def test_keep_one_of_texts_that_share_an_id(spark):
    texts = [" ".join(f"{k}w{i}" for i in range(30)) for k in range(3)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[2]), (3, texts[2])]
    out = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect())) == sorted([(1, texts[0]), (1, texts[1]), (2, texts[2])])


def test_signatures_within_the_distance_share_a_key():
    import random

    rng = random.Random(3)
    lanes = [rng.randrange(1 << 16) for _ in range(neardup.LANES)]

    def of(sig):
        out = set()
        for c in range(neardup.CHUNKS):
            chunk = sig[c * neardup.WIDE : (c + 1) * neardup.WIDE]
            out |= {(c, j, tuple(chunk[:j] + chunk[j + 1 :])) for j in range(neardup.WIDE)}
        return out

    for _ in range(300):
        near = list(lanes)
        for k in rng.sample(range(neardup.LANES), 2 * neardup.CHUNKS - 1):
            near[k] ^= 1
        assert of(lanes) & of(near)


def test_lower_similarities_find_their_pairs(spark):
    """Pairs that share 96 of 180 shingles (0.53) are linked at 50 percent, and none at 85."""
    assert [neardup.width(p) for p in (100, 85, 80, 75, 70, 50)] == [6, 6, 6, 5, 4, 3]
    assert [neardup.far(p) for p in (85, 80)] == [26, 26] and neardup.far(50) > 40
    rows = []
    for k in range(60):
        words = [f"w{k}x{i}" for i in range(142)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:100] + [f"z{k}x{i}" for i in range(42)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.components(docs, percent=50).collect()}
    assert got == {i: i - i % 2 for i in range(120)}
    assert all(r["kept"] for r in neardup.components(docs, percent=85).collect())


def test_connected_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (10, 11), (12, 11), (5, 5), (None, 7), (4, 3)], "u long, v long")
    assert dict(map(tuple, connected_components(edges).collect())) == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10}
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {r["component"] for r in connected_components(path).collect()} == {0}
    assert connected_components(edges.limit(0)).collect() == []
