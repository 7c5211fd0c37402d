"""The queries of this subpackage's operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, langid, lines, mixing, pii, quality, substrings, toxicity, urls
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source")


#: Key of the pseudonyms in the query; a user passes a secret of their own.
PII_KEY = "example key"


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", "emptied", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.rules_table(spark))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_quality(table(spark, sf_dir, "documents")).drop("n_gone", "text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    named = {"docs": "documents", "pages": "pages", "benchmark": "benchmark"}
    fill = lambda sql: sql.format(**named)
    return {
        "op1_mix_sources": fill(mixing.SQL).replace("select doc_id, source, size, source_size", "select doc_id, size, source_size"),
        "op4_line_dedup": fill(lines.SQL),
        "op6_decontaminate": fill(decontaminate.SQL),
        "op7_url_filter": fill(urls.SQL),
        "op8_quality_rules": fill(quality.SQL),
    }
