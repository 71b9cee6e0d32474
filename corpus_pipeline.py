"""The corpus pipeline: documents are filtered, deduplicated, decontaminated and packed, stage by stage.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), where docs is what the stage before kept.
Every stage but the last returns rows of docs with all their columns. run() writes each result as Parquet into the
shared folder and reads it again, so a lost executor costs one stage's work at most; a stage's own intermediate tables, and
the table it read, are deleted once its result is written.

Null or empty texts, repeated rows and null ids pass as their operators have it; extra columns travel with their rows, and
columns that begin with `_fjordframe` are the only names a table must not use. Of an empty table every stage is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordframe.llm.common import discard, id_fold, kept, scratch, written
from fjordframe.llm.decontaminate import clean
from fjordframe.llm.langid import UNKNOWN, identify, language_profiles
from fjordframe.llm.neardup import deduplicated
from fjordframe.llm.packing import packed, piece_digests
from fjordframe.llm.toxicity import toxicity_scores, trained


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 for toxicity; labels of the training folds teach the model."""
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), id_fold("doc_id", 5) != 0)
    return toxicity_scores(docs, model, "_fjordframe_toxicity").where("_fjordframe_toxicity < 0.5").drop("_fjordframe_toxicity")


#: Score by which another language must lead over the declared one for a document to go.
LEAD = 0.05


def check_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter go, and those clearly in another language than the one they declare.

    A declared language that was not learned says nothing, nor does one that the found language leads by LEAD at most.
    """
    profiles = written(language_profiles(docs, id_fold("doc_id", 3) != 1), "profiles")
    found, score, own = "_fjordframe_language", "_fjordframe_score", "_fjordframe_declared"
    judged = identify(docs, profiles, (found, score), ("lang", own))
    # Where nothing was learned every text is unknown, and none goes for it.
    known = judged if not profiles.isEmpty() else judged.withColumn(found, F.lit("unlearned"))
    return known.where((F.col(found) != UNKNOWN) & (F.coalesce(own, score) >= F.col(score) - LEAD)).drop(found, score, own)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark passages."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return piece_digests(packed(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", check_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Tokenizing, training and hashing have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            out = kept(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = out
    return docs
