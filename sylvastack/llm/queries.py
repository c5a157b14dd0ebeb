"""Queries of the training-corpus operators, and SQL for those that DuckDB can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license, mixing, repair


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    found = simhash_groups(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed_documents

    return packed_documents(_read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out, identify, train

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    found = docs.select("doc_id", held_out().alias("held_out"), identify(docs, model).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.array_join("found.languages", ",").alias("languages"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, token_count

    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", token_count().alias("n_tokens"))
    return mix(docs).select("row.doc_id", "row.source", "repeat", "block", "position", "row.n_tokens", "source_weight")


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license import license_digest

    return license_digest(_read(spark, sf_dir, "documents"))


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .classlm import fit_and_score
    from .language import held_out

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model, out = fit_and_score(docs, ~held_out(folds=10))
    out = out.withColumn("held_out", held_out(folds=10)).withColumn("train_tokens", F.lit(model.train_tokens).cast("long"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op8_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .telephony import text_media

    return text_media(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("pcm")


def op7_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .postings import nearest

    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_spans, fit, in_order

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", find_spans(docs, fit(docs)).alias("s"))
    counts = [F.expr(f"cast(size(filter(s.base, x -> x.kind = '{k}')) as bigint) as n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(in_order(F.col("s.base")), 256).alias("base_sha256"), in_order(F.concat("s.base", "s.added")).alias("spans"), F.size("s.added").cast("long").alias("n_added"))


def op6_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cotraining import fit_and_classify

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    scores = fit_and_classify(docs, _read(spark, sf_dir, "labels"))
    return scores.withColumn("keep", (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    found = whiten(_read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained", "identity_error")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damaged, report

    return report(damaged(_read(spark, sf_dir, "conversations")), "id", absent_col="absent").withColumnRenamed("id", "conv_id")


def op13_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .setsketch import set_groups

    found = set_groups(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_simhash": op4_simhash, "op5_packing": op5_packing, "op9_language_id": op9_language_id, "op1_mixing": op1_mixing, "op3_license": op3_license, "op2_class_lm": op2_class_lm, "op8_telephony": op8_telephony, "op7_postings": op7_postings, "op10_pii": op10_pii, "op6_cotraining": op6_cotraining, "op11_whitening": op11_whitening, "op12_repair": op12_repair, "op13_setsketch": op13_setsketch}
ORACLE_SQL: dict[str, str] = {"op1_mixing": mixing.oracle(), "op3_license": license.oracle(), "op12_repair": repair.oracle()}
