"""The contract queries: each reads its whole table, applies one operator and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, html_text, langid, lattice, matroska, neardup, packing, pii, quality, substring
from ._common import documents


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digest(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.round_trip(documents(spark, sf_dir))


def op7_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(documents(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digest(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_html_extraction": op3_html_extraction,
    "op4_pii_pseudonyms": op4_pii_pseudonyms,
    "op5_language_id": op5_language_id,
    "op6_matroska": op6_matroska,
    "op7_lattice_score": op7_lattice_score,
    "op8_packing": op8_packing,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_byte_bpe": op10_byte_bpe,
}

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The operators that SQL can express; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op1_substring_dedup": f"""WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS p, ws FROM d WHERE len(ws) >= 20),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS win FROM g) QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS pos FROM later),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.pos) AS kept FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.pos = gone.pos WHERE gone.pos IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op9_minhash_near_dedup": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i + 4], ' ') for i IN range(1, len(ws) - 3)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 85 * (nx.n + ny.n - shared)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN c ON c.x = d.doc_id""",
}
