"""A training corpus from raw documents: five stages, each from a table of documents to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvastack.llm import language, mixing, neardup, packing, pii
from sylvastack.llm.workspace import cleaned, drop

#: A document goes if no language is found, or if none has this share of its words.
LEADING_SHARE = 0.5

#: No SQL: trained models, fingerprints and tokenizers are not SQL expressions. tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a leading language; ``lang`` becomes the language found. The model learns from all labelled documents."""
    found = docs.withColumn("_found", language.identify(docs, language.train(docs)))
    kept = found.where((F.col("_found.lang") != language.UNDETERMINED) & (F.col("_found.score") >= LEADING_SHARE))
    return kept.withColumn("lang", F.col("_found.lang")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal or similar texts: that with the smallest id, ids that are null last. Rows that repeat an id are told apart by their texts."""
    found = neardup.near_duplicates(docs)
    keys = ["_id_key", "_text_key"]
    rows = docs.withColumns({"_id_key": F.xxhash64("doc_id"), "_text_key": F.xxhash64("text")})
    named = found.select(F.col("id_key").alias("_id_key"), F.col("text_key").alias("_text_key"), "lead", "copies")
    kept = rows.join(named.where("not lead").select(*keys), keys, "left_anti")
    twice = named.where("lead and copies > 1").select(*keys)
    if not twice.isEmpty():
        kept = kept.join(twice, keys, "left_anti").unionByName(kept.join(twice, keys, "left_semi").dropDuplicates(keys))
    return kept.select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind; ``n_chars`` follows. No document goes."""
    covered = docs.withColumn("text", pii.redacted(docs, pii.fit(docs)))
    return covered.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights under a budget that covers each at least once: no document goes, those of small sources repeat."""
    counted = docs.withColumn("_tokens", mixing.token_count())
    return mixing.mix(counted, tokens_col="_tokens", budget="cover").select(*(F.col(f"row.{c}").alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens; row tells the repeats of a document apart. Their ids, with a checksum here, take ``with_ids``."""
    return packing.packed_documents(docs, with_row=True)


STAGES = [
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


@cleaned
def _after(docs: DataFrame, stage, sf_dir: str) -> DataFrame:
    """A stage's result, written; its work tables go."""
    return stage(docs.sparkSession, docs, sf_dir)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``; each stage's result is written to the shared folder, read again, and dropped after the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, _after(docs, stage, sf_dir)
        drop(before)
    return docs
