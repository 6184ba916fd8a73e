"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm import best_fit, decontaminate, fingerprints, languages, lines, near_duplicates, packing, quality, ranked, secrets, spelling, substrings, token_counts
from pressloom.llm.common import shared_dir, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents, then the toxic ones deleted and the poor ones stripped of symbols; each batch is sent twice."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), table(spark, sf_dir, "labels")
    stripped = F.regexp_replace("text", r"[^\p{L}\p{N}\s.,]+", "")
    batches = {
        "1-insert": docs.withColumn("op", F.lit("insert")),
        "2-delete": labels.where("toxic = 1").select("doc_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("text"), F.lit("delete").alias("op")),
        "3-revise": docs.join(labels.where("quality = 0 and toxic = 0").hint("merge"), "doc_id", "left_semi").withColumn("text", stripped).withColumn("op", F.lit("revise")),
    }
    totals = token_counts.TokenTotals(spark, shared_dir(spark))
    for batch, changes in batches.items():
        totals.commit(batch, changes)
        totals.commit(batch, changes)
    return totals.totals()


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents")).drop("text_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.predict(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.digest(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.digest(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.digest(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_token_counts,
        op3_decontamination,
        op4_packing,
        op5_quality,
        op6_language_id,
        op7_secret_scan,
        op8_near_duplicates,
        op9_fingerprints,
        op10_substring_dedup,
        op11_best_fit,
        op12_spelling,
        op13_ranked_search,
    )
}
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": lines.SQL, "op3_decontamination": decontaminate.SQL, "op8_near_duplicates": near_duplicates.SQL, "op10_substring_dedup": substrings.SQL, "op13_ranked_search": ranked.SQL}
