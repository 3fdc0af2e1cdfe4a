"""Labelled claims as JSON lines, one record a line: line numbers, lines that cannot be read, keys that come twice, and what is wrong with each claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import quoted
from .schema import EDGE_TYPES, STANCES
from .scratch import written

CLAIM_FIELDS = ("subject_type", "subject", "relation", "object_type", "object", "effect", "stance", "quote")
EFFECTS = ("loss_of_function", "gain_of_function", "dominant_negative", "unknown", "not_applicable")
RECORD = "pmid string, draft boolean, claims array<struct<" + ",".join(f"{c}:string" for c in CLAIM_FIELDS) + ">>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of the text files under a path, blank lines included; a written table.

    A file is read in splits by many tasks. Rows are numbered within their split, where they have the file's order, and the
    sums of the splits before are added: a row for each split is all that is put in order across splits.
    """
    own = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    own = written(own, "lines")
    split = Window.partitionBy("file", "block").orderBy("id")  # a split's rows
    counts = own.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = own.withColumn("at", F.row_number().over(split)).join(counts.select("file", "block", before.alias("before")), ["file", "block"])
    return rows.select("file", (F.col("at") + F.col("before")).alias("line"), "value")


def gold_records(spark: SparkSession, path: str, schema: str = RECORD, key: str = "pmid") -> DataFrame:
    """file, line, record, error of every line that is not blank. record: null where the line is no JSON object of the schema.

    error: unreadable; no key; or a key that an earlier line has ('line n of file'), for all lines but the first.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    readable = F.col("r").isNotNull() & F.col("r._bad").isNull()
    rows = written(parsed.select("file", "line", F.when(readable, F.col("r").dropFields("_bad")).alias("record"), F.when(readable, F.trim(F.col(f"r.{key}"))).alias("key")), "gold")
    first = rows.where("key != ''").groupBy("key").agg(F.min(F.struct("file", "line")).alias("first"))  # partial sums: a key of many lines is one row a task
    rows = rows.join(first, "key", "left")
    again = F.struct("file", "line") != F.col("first")
    error = (
        F.when(F.col("record").isNull(), "not a valid record").when(F.coalesce("key", F.lit("")) == "", f"missing {key}")
        .when(again, F.concat(F.lit("same as line "), F.col("first.line").cast("string"), F.lit(" of "), F.regexp_extract("first.file", "([^/]*)$", 1)))
    )
    return rows.select("file", "line", "record", error.alias("error"))


def claim_errors(records: DataFrame, texts: DataFrame, relations: tuple[str, ...] = tuple(EDGE_TYPES)) -> DataFrame:
    """file, line, claim (from 1; null: the record), error: everything that keeps the records from being used. texts: pmid, text (once).

    A claim with an empty field is not looked at further; where a text is missing, quotes cannot be checked, which is an
    error of the record. A record with an error of gold_records() has that one; one that comes again is still looked into.
    """
    read = records.where("error IS NOT NULL").select("file", "line", F.lit(None).cast("int").alias("claim"), "error")
    rows = records.where("record IS NOT NULL AND trim(record.pmid) != ''").select("file", "line", "record.*").withColumn("pmid", F.trim("pmid"))
    rows = rows.join(texts.select("pmid", "text"), "pmid", "left")
    whole = F.array(
        F.when(F.coalesce("draft", F.lit(False)), "still a draft"), F.when(F.col("claims").isNull(), "claims must be a list"), F.when(F.col("text").isNull(), "no text to check quotes against")
    )
    of_record = rows.select("file", "line", F.lit(None).cast("int").alias("claim"), F.explode(F.array_compact(whole)).alias("error"))
    c = rows.select("file", "line", "text", F.posexplode("claims").alias("at", "c")).select("file", "line", "text", (F.col("at") + 1).alias("claim"), "c.*")
    empty = lambda f: F.trim(F.coalesce(f, F.lit(""))) == ""
    lacking = F.array_join(F.array_compact(F.array(*[F.when(empty(f), F.lit(f)) for f in CLAIM_FIELDS])), ", ")

    def not_in(field: str, known: tuple[str, ...]) -> Column:
        return F.when(~F.col(field).isin(*known), F.concat(F.lit(f"unknown {field}: "), field))

    quote = F.trim("quote")
    rules = F.array(
        not_in("relation", relations), not_in("effect", EFFECTS), not_in("stance", STANCES),
        F.when((F.col("relation") == "disease_mechanism") & (F.col("effect") == "not_applicable"), "a mechanism has an effect, unknown if the text does not say"),
        F.when((F.col("relation") != "disease_mechanism") & (F.col("effect") != "not_applicable"), "only a mechanism has an effect"),
        F.when(quote.startswith("<") & quote.endswith(">"), "the quote is a placeholder").when(~quoted(F.col("quote"), F.col("text")), "the quote is not in the text"),
    )
    found = F.when(lacking != "", F.array(F.concat(F.lit("missing or empty: "), lacking))).otherwise(F.array_compact(rules))
    of_claim = c.select("file", "line", "claim", F.explode(found).alias("error"))
    return read.unionByName(of_record).unionByName(of_claim)
