"""Phenotype annotation files: tab-separated rows after `#key: value` lines and a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def annotation_metadata(spark: SparkSession, path: str) -> DataFrame:
    """key, value of the leading comment lines."""
    pair = F.split(F.regexp_replace("value", "^#", ""), ":", 2)
    return spark.read.text(path).where("value like '#%:%'").select(F.trim(pair[0]).alias("key"), F.trim(pair[1]).alias("value"))


def annotations(spark: SparkSession, path: str, diseases: DataFrame | None = None) -> DataFrame:
    """disease, phenotype, stance, reference, evidence of the phenotype rows (aspect P), for the stated diseases (column disease) if given.

    A NOT qualifier contradicts, none supports; any other is an error, raised when the row is read.
    """
    rows = spark.read.csv(path, sep="\t", comment="#", header=True, quote="", inferSchema=False)
    qualifier = F.upper(F.trim(F.coalesce("qualifier", F.lit(""))))
    wrong = F.raise_error(F.concat(F.lit("unknown qualifier: "), qualifier)).cast("string")
    stance = F.when(qualifier == "NOT", "contradicts").when(qualifier == "", "supports").otherwise(wrong)
    out = rows.where("aspect = 'P'").select(
        F.col("database_id").alias("disease"), F.col("hpo_id").alias("phenotype"), stance.alias("stance"), "reference", "evidence"
    )
    return out if diseases is None else out.join(diseases.select("disease").distinct(), "disease", "left_semi")
