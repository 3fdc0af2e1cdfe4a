"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Each stage works on all rows that the one before kept. All but the last return the columns of documents; the last one
returns doc_id and the token ids. Nulls in any column, empty and very long texts, ties and repeated rows have the results
that the operators' docstrings state; an empty table stays one; columns with names used here are carried along as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from evigraph.llm.common import written


def _key(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts. Null and empty texts score by the bias; a score at the threshold is toxic; repeated rows fare alike."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row that exact deduplication keeps; null and empty texts are equal, so one of them stays.

    Slim keys decide. A key that several rows have (a doc_id again with an equal text) keeps its longest row.
    """
    kept = exact_dedup.exact_dedup(docs).where("kept").select(F.concat_ws(":", _key("doc_id"), "text_sha256").alias("_evigraph_key"))
    sha = exact_dedup.text_sha256(F.col("text"))
    own = docs.withColumn("_evigraph_key", F.concat_ws(":", _key("doc_id"), sha)).join(kept, "_evigraph_key", "left_semi")
    return _one_each(own, docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more. Texts without words stay.

    Of a doc_id on several equal texts one row stays.
    """
    kept = near_dedup.near_dedup(docs, n=5, percent=80).where("kept").select(_key("doc_id").alias("_evigraph_id")).distinct()
    own = docs.withColumn("_evigraph_id", _key("doc_id")).join(kept, "_evigraph_id", "left_semi")
    return _one_each(own.withColumn("_evigraph_key", F.concat_ws(":", "_evigraph_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))), docs.columns)


def _one_each(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The longest row of each key, equal ones by all their columns. Rows of a key of their own, which most are, are not moved again."""
    rows = written(rows, "pipeline-rows")
    again = written(rows.groupBy("_evigraph_key").agg(F.count("*").alias("_evigraph_n")).where("_evigraph_n > 1").select("_evigraph_key"), "pipeline-again")
    if again.isEmpty():
        return rows.select(*columns)
    row = F.struct(*columns)
    best = rows.join(again, "_evigraph_key", "left_semi").groupBy("_evigraph_key").agg(F.max(F.struct(F.length("text").alias("n"), F.xxhash64(*columns).alias("h"), row.alias("row"))).alias("best"))
    return rows.join(again, "_evigraph_key", "left_anti").select(*columns).unionByName(best.select("best.row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; texts without words count 0 and follow their source's rate."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every document; a null text has none."""
    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The toxicity stage learns a model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
