"""The pipeline against a plain version of its stages."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from seqtide.llm import langid, pii, substring
from tests.llm.test_dedup import brute_components, brute_substring

import zlib


def test_pipeline_matches_plain_stages(spark, rows, tmp_path):
    own = [r for r in rows if r[0] is not None]
    spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in own], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    trained = {}
    for doc, text, lang in own:
        if text is not None and lang is not None and zlib.crc32(str(doc).encode()) % 5:
            trained.setdefault(lang, []).append(text.encode())
    scorer = langid.Scorer({k: langid.Tree(*langid.counts(v)) for k, v in sorted(trained.items())})
    found = list(zip(own, scorer.best([None if r[1] is None else r[1].encode() for r in own]), strict=True))
    one = [r for r, (lang, _, _) in found if lang != "und"]
    stay = brute_components(one)
    two = [r for r in one if stay[r[0]][2]]
    first, three = {}, []
    for doc, text, _ in two:
        w = text.encode().split()
        for p in range(len(w) - 19):
            first.setdefault(tuple(w[p : p + 20]), (doc, p))
    for doc, text, _ in two:
        w = text.encode().split()
        spans = [{"s": p, "e": p + 20} for p in range(len(w) - 19) if first[tuple(w[p : p + 20])] < (doc, p)]
        three.append((doc, substring.cut(text.encode(), spans).decode() if spans else text))
    assert any(brute_substring(two)[d][1] for d, _ in three)
    hide = pii.Pseudonyms(pii.session_key(spark))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {doc: [*tokenizer.encode(hide.replace(text)[0], add_special_tokens=False).ids, 0] for doc, text in three}
    assert {r["doc_id"] for r in out} == set(want)
    for r in out:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


def test_stages_return_the_columns_of_documents(spark, rows, tmp_path):
    docs = spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_near_copies_from_a_similarity_of_80_percent_go(spark, tmp_path):
    rows = []
    for k in range(6):
        own = [f"w{k}x{i}" for i in range(100)]
        for j, changes in enumerate(([], [20, 60], [10, 40, 70, 90])):  # 86 of 106 shingles shared, and 76 of 116
            rows.append((10 * k + j, " ".join(f"c{j}" if i in changes else w for i, w in enumerate(own))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert kept == {10 * k + j for k in range(6) for j in (0, 2)}


def test_short_upper_case_and_private_texts_stay(spark, rows, tmp_path):
    odd = ["A.", "Re.", "HE!! IN!! ED, ON!! " * 40, 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" on he', "8316107434564120 the of 4761598977407687", None, "12 34 --"]
    own = [r for r in rows if r[0] is not None] + [(1000 + k, text, "en") for k, text in enumerate(odd)]
    docs = spark.createDataFrame(own, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()}
    assert kept == {doc for doc, text, _ in own if langid.has_letter(None if text is None else text.encode())}
    assert {i for i in kept if i >= 1000} == set(range(1000, 1005))
