"""The registered corpus queries: thin wrappers of the operators, with production parameters and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordframe.llm import sql
from fjordframe.llm.alignment import aligned
from fjordframe.llm.common import id_fold
from fjordframe.llm.ctw import language_scores
from fjordframe.llm.decontaminate import decontaminate
from fjordframe.llm.huffman import document_digests, read_ids, write_ids
from fjordframe.llm.langid import identify, language_profiles
from fjordframe.llm.lengths import length_histogram
from fjordframe.llm.neardup import near_duplicates
from fjordframe.llm.packing import packed, piece_digests
from fjordframe.llm.pivotsearch import top_k
from fjordframe.llm.repair import damaged, repair_report
from fjordframe.llm.toxicity import toxicity_scores, trained
from fjordframe.llm.urlfilter import Rule, filtered
from fjordframe.llm.warc import archived

# The rules of the URL query.
URL_RULES = [Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_profiles(docs, id_fold("doc_id", 3) != 1)
    held_out = F.coalesce(id_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", held_out, "text"), profiles).drop("text")


def op5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"), id_fold("doc_id", 10) == 0)


def op6_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(table(spark, sf_dir, "documents"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = trained(docs, table(spark, sf_dir, "labels"), id_fold("doc_id", 5) != 0)
    held_out = F.coalesce(id_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    scored = toxicity_scores(docs.select("doc_id", held_out, "text"), model).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(packed(table(spark, sf_dir, "documents")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


def op11_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_digests(read_ids(spark, write_ids(table(spark, sf_dir, "documents"))))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair_report(damaged(rows), rows)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))


QUERIES = (op1_urls, op2_topk, op3_decontaminate, op4_language, op5_scores, op6_lengths, op7_neardup, op8_toxicity, op9_packing, op10_warc, op11_huffman, op12_repair, op13_alignment)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_urls": sql.urls(URL_RULES),
        "op2_topk": sql.TOP_K,
        "op3_decontaminate": sql.DECONTAMINATE,
        "op7_neardup": sql.NEARDUP,
        "op10_warc": sql.WARC,
        "op12_repair": sql.REPAIR,
    }
