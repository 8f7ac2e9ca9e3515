"""From raw documents to training tokens: language ID, exact and near dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the
columns of documents. A row is known by its id and its text, null-safe: a null id is an id like any other, and of rows
that repeat an id each is judged by its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.bpe import default_ranks, encode
from loam.llm.common import table, written
from loam.llm.decontaminate import decontaminate
from loam.llm.exact_dedup import exact_dedup
from loam.llm.jaccard import jaccard_join
from loam.llm.language_id import identify, learn

#: A text goes if no language has this share of its n-grams; the shares of prose are above a half.
LEAST_SCORE = 0.15


def whole(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def without(docs: DataFrame, dropped: DataFrame, key: Column) -> DataFrame:
    """docs less the rows that are equal in id and key to one of dropped (dropped_id, dropped_key)."""
    return docs.join(dropped, docs["doc_id"].cast("long").eqNullSafe(dropped["dropped_id"]) & (key == dropped["dropped_key"]), "left_anti")


def one_each(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """docs with one of the rows that repeat id and text, given the keys of all its rows; where none repeats, nothing moves."""
    if kept.groupBy(*kept.columns).agg(F.count("*").alias("times")).where("times > 1").isEmpty():
        return docs
    return docs.withColumn("repeated_text", whole(docs)).dropDuplicates(["doc_id", "repeated_text"]).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters (null and empty ones too) go, and those in which no learnt language is found."""
    columns = tuple(docs.columns)
    found = identify(docs, learn(docs), carry=columns)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col(f"carried_{k}").alias(c) for k, c in enumerate(columns)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays (one without an id if none has one); of rows equal in id and text, one."""
    found = exact_dedup(docs)
    dropped = found.where("NOT kept").select(F.col("doc_id").alias("dropped_id"), F.col("text_sha256").alias("dropped_key"))
    return one_each(without(docs, dropped, F.sha2(whole(docs).cast("binary"), 256)), found.where("kept").select("doc_id", "text_sha256"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by similarity 0.8 or more, the one with the least id stays (null ids come last); of rows equal in id and text, one."""
    found = written(jaccard_join(docs).select("doc_id", "text_key", "kept"), "near_keys")
    dropped = found.where("NOT kept").select(F.col("doc_id").alias("dropped_id"), F.col("text_key").alias("dropped_key"))
    return one_each(without(docs, dropped, F.xxhash64(whole(docs))), found.where("kept").select("doc_id", "text_key"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    dropped = found.where(F.size("hits") > 0).select(F.col("doc_id").alias("dropped_id"), F.col("text_key").alias("dropped_key"))
    return without(docs, dropped, F.xxhash64(whole(docs)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token ids of what is left."""
    return encode(docs, default_ranks()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminate", clean), ("tokens", tokens)]

#: The stages are not expressible in SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; every stage is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
