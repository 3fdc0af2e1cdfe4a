"""Mixing sources to target weights (operator 4), with DataFrame operations only.

Method: systematic sampling. Within a source every document's expected copies are target / source size; they are
prefix-summed, one random offset is added for the source, and a document is emitted once for each integer boundary
that its interval crosses.

The prefix sum has three levels, so that no source has to fit one task: documents are dealt to buckets of bounded size
(by size class, then by a hash of the doc_id), BUCKETS buckets make a block, and blocks are summed up within the source.
Rows alike in doc_id, source and size are one row with their number while sums are made, so repeated rows fill no bucket.
As documents come in the order of their size classes, the words taken stay near the target.

Size is the number of words (null text: 0), of the whole text however long. Targets: weights 5, 2, 1, repeating over
sources by code point (null last), stop at ``most`` times the source's size, the excess shared again by weight. A source
of size 0 has target 0 and takes nothing. Empty documents take 0 words. Repeated rows are documents of their own; equal
doc_ids are ordered by size, a null doc_id comes last, and mix() orders what is equal in both by a digest of the row, so
reruns agree. An empty table gives no rows; columns of docs with names used here change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, written

WEIGHTS = (5, 2, 1)
BUCKET_ROWS, BUCKETS = 1024, 1024
#: Rows alike that one task spreads out again.
SPREAD = 1 << 16


def sizes(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size: number of words of the whole text."""
    return docs.select("doc_id", "source", *more, F.coalesce(F.regexp_count("text", F.lit(WORD_CLASS)), F.lit(0)).cast("long").alias("size"))


def groups(docs: DataFrame, *more: Column) -> DataFrame:
    """Rows alike in doc_id, source, size (and more), with their number n."""
    sized = sizes(docs, *more)
    return sized.groupBy(*sized.columns).agg(F.count("*").alias("n"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size, target, rate: one row for each source. sized: groups.

    Sharing the excess until no target is above its cap ends where capped sources are those with the smallest
    cap / weight; with sources in that order, the share of a unit of weight follows from running sums.
    """
    totals = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # rows are sources, one each
    cases = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        cases = F.when(F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) == i, w).otherwise(cases)
    weighed = totals.withColumn("weight", cases.cast("long")).withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy((F.col("cap").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, every = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    run = weighed.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
        F.sum("source_size").over(every).alias("all_size"),
        F.sum("weight").over(every).alias("all_weight"),
    )
    share = (F.col("all_size") - F.col("cap_before")).cast("double") / (F.col("all_weight") - F.col("weight_before")).cast("double")
    fits = F.col("share") * F.col("weight") <= F.col("cap")
    run = run.withColumn("share", share).withColumn("place", F.row_number().over(by_cap))
    # from the first source whose share fits, none is above its cap
    run = run.withColumn("first", F.min(F.when(fits, F.struct("place", "share"))).over(every))
    target = F.when(F.col("place") >= F.col("first.place"), F.col("first.share") * F.col("weight")).otherwise(F.col("cap").cast("double"))
    out = run.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    return out.select("source", "source_size", "target", rate.alias("rate"))


def _offset(seed: int) -> Column:
    """A number in [0, 1) for each source, the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _hash(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def _placed(sized: DataFrame, weights: tuple[int, ...], most: int, digest: list[str]) -> DataFrame:
    """The groups, a written table, with source_size, target, rate, and before: how many rows of the source come first."""
    sized = sized.withColumn("class", F.length(F.bin("size")))
    per_source = F.broadcast(targets(sized, weights, most).withColumnRenamed("source", "t_source"))  # a row for each source
    classes = sized.groupBy("source", "class").agg(F.ceil(F.count("*") / BUCKET_ROWS).alias("parts"))
    classes = F.broadcast(classes.select(F.col("source").alias("c_source"), F.col("class").alias("c_class"), "parts"))  # 64 for each source at most
    turn = F.col(digest[0]) if digest else _hash(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    dealt = sized.join(classes, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("class") == F.col("c_class")))
    dealt = dealt.withColumn("part", F.pmod(turn, F.col("parts"))).withColumn("block", F.floor(F.col("part") / BUCKETS)).drop("c_source", "c_class", "parts")

    bucket, block = ["source", "class", "block", "part"], ["source", "class", "block"]
    counts = dealt.groupBy(*bucket).agg(F.sum("n").alias("rows"))
    first = (Window.unboundedPreceding, -1)
    in_block = counts.withColumn("s2", F.coalesce(F.sum("rows").over(Window.partitionBy(*block).orderBy("part").rowsBetween(*first)), F.lit(0)))
    blocks = counts.groupBy(*block).agg(F.sum("rows").alias("rows"))
    blocks = blocks.withColumn("s1", F.coalesce(F.sum("rows").over(Window.partitionBy("source").orderBy("class", "block").rowsBetween(*first)), F.lit(0)))
    starts = _joined(in_block.drop("rows"), blocks.drop("rows"), block).select(*bucket, (F.col("s1") + F.col("s2")).alias("start"))

    inside = Window.partitionBy(*bucket).orderBy("size", F.col("doc_id").asc_nulls_last(), *digest).rowsBetween(*first)
    ranked = _joined(dealt.withColumn("s3", F.coalesce(F.sum("n").over(inside), F.lit(0))), starts, bucket)
    ranked = ranked.withColumn("before", F.col("start") + F.col("s3")).drop("class", "block", "part", "s3", "start")
    return ranked.join(per_source, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join by keys, of which the first may be null."""
    right = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.col(keys[0]).eqNullSafe(F.col(f"_{keys[0]}"))
    for k in keys[1:]:
        on &= F.col(k) == F.col(f"_{k}")
    return left.join(right, on).drop(*[f"_{k}" for k in keys])


def _copies(at: Column, n: Column, offset: Column) -> Column:
    """Integer boundaries that the expected copies of rows at + 1 to at + n cross."""
    return (F.floor((at + n) * F.col("rate") + offset) - F.floor(at * F.col("rate") + offset)).cast("long")


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: one row for each row of docs."""
    placed = written(_placed(written(groups(docs), "mix-groups"), weights, most, []), "mix-placed")
    one, offset = F.lit(1), _offset(seed)
    # rows alike become rows again, in pieces that are dealt anew if there are many
    pieces = placed.where(F.col("n") > 1).withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / SPREAD))))
    pieces = pieces.repartition("doc_id", "size", "piece")
    last = F.least(F.col("n"), (F.col("piece") + 1) * SPREAD) - 1
    spread = pieces.withColumn("i", F.explode(F.sequence(F.col("piece") * SPREAD, last)))
    rows = placed.where(F.col("n") == 1).withColumn("at", F.col("before")).unionByName(spread.withColumn("at", F.col("before") + F.col("i")).drop("piece", "i"))
    return rows.select("doc_id", "source", "size", "source_size", "target", _copies(F.col("at"), one, offset).alias("copies"))


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Whole rows are shuffled once, to what slim keys decided."""
    mark = F.xxhash64(*docs.columns).alias("_digest")
    placed = _placed(written(groups(docs, mark), "mix-groups"), weights, most, ["_digest"])
    taken = placed.select(F.col("doc_id").alias("_id"), "_digest", "n", _copies(F.col("before"), F.col("n"), _offset(seed)).alias("_copies")).where("_copies > 0")
    taken = written(taken, "mix-taken")
    rows = docs.select(F.struct(*docs.columns).alias("row"), mark)
    alone = rows.join(taken.where("n = 1"), F.col("row.doc_id").eqNullSafe(F.col("_id")) & (rows["_digest"] == taken["_digest"])).select("row", "_copies")
    # equal rows are interchangeable: one of them stands for all copies that they take together
    repeated = rows.join(taken.where("n > 1"), F.col("row.doc_id").eqNullSafe(F.col("_id")) & (rows["_digest"] == taken["_digest"]))
    repeated = repeated.groupBy(taken["_id"], taken["_digest"]).agg(F.first("row").alias("row"), F.first("_copies").alias("_copies"))
    every = alone.unionByName(repeated.select("row", "_copies"))
    pieces = every.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / SPREAD))))
    copies = F.sequence(F.lit(1), F.least(F.lit(SPREAD), F.col("_copies") - F.col("_piece") * SPREAD))
    return pieces.select("row", F.explode(copies)).select("row.*")


ORACLE = rf"""
with s as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD_CLASS}')), 0)::bigint as size from documents
), totals as (
  select source, count(*) as n_docs, sum(size)::bigint as source_size from s group by source
), weighed as (
  select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from totals
), run as (
  select *, source_size * 3 as cap,
    coalesce(sum(source_size * 3) over w, 0)::bigint as cap_before, coalesce(sum(weight) over w, 0)::bigint as weight_before,
    (sum(source_size) over ())::bigint as all_size, (sum(weight) over ())::bigint as all_weight
  from weighed
  window w as (order by (source_size * 3)::double / weight, source nulls last rows between unbounded preceding and 1 preceding)
), shared as (
  select *, (all_size - cap_before)::double / (all_weight - weight_before)::double as share from run
), placed as (
  select *, row_number() over (order by cap::double / weight, source nulls last) as place from shared
), unit as (
  select *, min(case when share * weight <= cap then {{'place': place, 'share': share}} end) over () as first from placed
), targets as (
  select source, source_size, case when place >= first.place then first.share * weight else cap::double end as target from unit
), rates as (
  select *, case when source_size > 0 then target / source_size::double else 0.0 end as rate,
    ('0x' || substr(md5('7:' || coalesce('=' || source, 'null')), 1, 13))::bigint::double / 4503599627370496.0 as off
  from targets
), g as (
  select doc_id, source, size, length(bin(size)) as class, count(*) as n from s group by all
), parts as (
  select *, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint % ceil(count(*) over (partition by source, class) / 1024.0)::bigint as part from g
), ranked as (
  select *, sum(n) over (partition by source order by class, part, size, doc_id nulls last rows unbounded preceding)::bigint as up_to from parts
), single as (
  select *, up_to - unnest(range(n)) as rank from ranked
)
select doc_id, size, source_size, target,
  (size * (floor(rank * rate + off) - floor((rank - 1) * rate + off)))::bigint as taken
from single join rates on single.source is not distinct from rates.source
"""
