"""The training-data pipeline over ``documents``: five stages, each written and read again by run().

Language ID drops texts without letters, near-dedup keeps one document of each group,
substring dedup cuts passages that stand earlier, private values get pseudonyms, and the rest
is packed.  All but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtide.llm import langid, neardup, packing, pii, substring
from seqtide.llm._common import crc_mod, written

#: Percent of shared shingles from which documents are near copies; op9's contract has its own.
NEAR_PERCENT = 80


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    """out with the columns of docs, and n_chars (if there) that of the new text."""
    length = F.length("text").cast(dict(docs.dtypes).get("n_chars", "bigint"))
    return out.select(*[length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without text or letters go."""
    trees = langid.fit(docs.filter(crc_mod(F.col("doc_id"), langid.FOLDS) != 0))
    found = langid.predict(docs, trees)
    return found.filter(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id."""
    return neardup.keep_one(docs, percent=NEAR_PERCENT).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 20 words or more that start earlier."""
    return _like(docs, substring.remove_repeats(docs))


def private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with private values replaced by pseudonyms."""
    return _like(docs, pii.pseudonymise(docs, pii.session_key(spark)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and the sequences they make."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("pii", private_values),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs


#: The stages fit models and permute values, which SQL does not express; tests/llm compares with a plain version.
ORACLE_SQL = None
