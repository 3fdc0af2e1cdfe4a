"""Interaction audit of filters (operator 13): what each filter removes, keeps and repeats in every order of filters.

Five filters: A too few words, B too few distinct words, C too many capitals, D special characters, E a text that a
smaller doc_id has too.

Method: a relational word pipeline.

1. Texts are dealt by a key of their row, words are exploded and aggregated by (row, word), then by row for totals and
   distinct words; both aggregations use the one partitioning by row.
2. Flags that need no words come from a slim pass. A copy is a row that is not the smallest doc_id of its text: smallest
   ids are aggregated with partial sums and joined by (doc_id, text), so a text of many copies is no hot key.
3. The flags are outer-joined; one aggregation by part has 32 conditional counts, one for each set of failing filters,
   of all documents and of those with each label.
4. The report for every order of filters follows from the 32 counts alone, by sums of bit masks.

Null texts are empty: no words, A fails, B and C don't (0 is not below 0). A null lang is the empty part. A null doc_id
is no copy and makes none; it has no labels. Rows of one doc_id and text count as often as they come. A doc_id with
several labels is good or toxic if one of them says so. Very long texts are read whole. Ties don't occur. An empty table
gives no rows. Other columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, discard, written

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT = 200, 50, 3
SPECIAL = r"[#$%&*|]"
SETS = 1 << len(FILTERS)


def _row_key() -> Column:
    """16 bytes that only rows of the same doc_id and text share."""
    text = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return F.substring(F.unhex(F.sha2(F.concat_ws(":", text, F.col("doc_id").cast("string")).cast("binary"), 256)), 1, 16)


def word_totals(docs: DataFrame) -> DataFrame:
    """_row, n_words, n_distinct of each row with words; docs: _row, text, a row for each key."""
    dealt = docs.repartition("_row")
    words = dealt.select("_row", F.explode(F.split("text", f"{SPACE_CLASS}+")).alias("word")).where("word != ''")
    counted = words.groupBy("_row", "word").agg(F.count("*").alias("n"))
    return counted.groupBy("_row").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, mask (bit i: the i-th filter fails), n: rows of docs; a written table stays behind until discard()."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        F.col("doc_id").alias("_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), _row_key().alias("_row"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("_text"),
        (100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MAX_CAPITALS_PERCENT * F.length(text).cast("long")).alias("c"), text.rlike(SPECIAL).alias("d"),
    )
    slim = written(slim.groupBy("_id", "part", "_row", "_text", "c", "d").agg(F.count("*").alias("n")), "audit-rows")
    first = slim.where("_id IS NOT NULL").groupBy("_text").agg(F.min("_id").alias("_id")).withColumn("first", F.lit(True))
    # a row that comes twice has its words twice: both counts are halved alike by the number of rows
    totals = word_totals(docs.select(_row_key().alias("_row"), text.alias("text")))
    copies = slim.groupBy("_row").agg(F.sum("n").alias("_copies"))
    good = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    all_ = slim.join(totals, "_row", "left").join(copies, "_row").join(first, ["_text", "_id"], "left").join(good, "_id", "left")
    words = F.coalesce(F.expr("n_words div _copies"), F.lit(0))
    fails = [words < MIN_WORDS, 100 * F.coalesce("n_distinct", F.lit(0)) < MIN_DISTINCT_PERCENT * words, F.col("c"), F.col("d"), F.col("_id").isNotNull() & F.col("first").isNull()]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    out = all_.select("part", (F.coalesce("good", F.lit(0)) == 1).alias("good"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"), mask.alias("mask"), "n")
    out.scratch_path = slim.scratch_path
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    rows = flags(docs, labels)

    def count(m: int, wanted: Column | None = None) -> Column:
        here = F.col("mask") == m
        return F.coalesce(F.sum(F.when(here if wanted is None else here & wanted, F.col("n"))), F.lit(0))

    columns = [count(m, w).alias(f"{k}{m}") for k, w in (("n", None), ("g", F.col("good")), ("t", F.col("toxic"))) for m in range(SETS)]
    counts = written(rows.groupBy("part").agg(*columns), "audit-counts")
    discard(rows)
    pack = lambda k: F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"{k}{m}").alias("n")) for m in range(SETS)]).alias(k)
    parts = counts.select("part", pack("n"), pack("g"), pack("t"))
    return _report(parts)


def _report(parts: DataFrame) -> DataFrame:
    """A row for each part, order and step, from each part's counts by set of failing filters."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    bit = lambda place: f"shiftleft(1, instr('{FILTERS}', substring(filter_order, {place}, 1)) - 1)"
    rows = (
        parts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ",")))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumn("own", F.expr(bit("step")))
        .withColumn("before", F.expr(f"aggregate(filter(sequence(1, {len(FILTERS)}), i -> i < step), 0, (s, i) -> s + {bit('i')})"))
    )

    def total(of: str, test: str, value: str = "x.n") -> Column:
        return F.expr(f"aggregate(filter({of}, x -> {test}), 0L, (s, x) -> s + {value})")

    removed = "(x.m & before) = 0 AND (x.m & own) != 0"
    return rows.select(
        "part", "filter_order", "step",
        total("n", "(x.m & (before | own)) = 0").alias("kept"),
        total("n", removed).alias("removed"),
        total("n", "(x.m & before) != 0 AND (x.m & own) != 0").alias("redundant"),
        total("n", "x.m = own").alias("unique_fails"),
        total("g", removed).alias("good_lost"),
        total("t", removed).alias("toxic_lost"),
        # a document is removed by one of its failing filters, by each in an equal share of the orders
        total("n", "(x.m & own) != 0", f"x.n * ({len(orders)} div bit_count(x.m))").alias("shapley"),
    )


ORACLE = r"""
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, bits FROM orders),
docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM docs GROUP BY text),
judged AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN docs.doc_id > first_id THEN 16 ELSE 0 END) AS mask
  FROM docs JOIN firsts USING (text) LEFT JOIN judged ON judged.doc_id = docs.doc_id),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, mask),
places AS (SELECT filter_order, step, bits[step] AS own, list_sum(bits[:step - 1]) AS before FROM steps),
sums AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (own | coalesce(before, 0)::INT) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(before, 0)::INT = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(before, 0)::INT <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(before, 0)::INT = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(before, 0)::INT = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, places GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM sums
"""
