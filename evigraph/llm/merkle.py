"""Merkle manifest of a table of documents (operator 12).

Each row is a leaf. The leaves of a source, in the order of their doc_id, are reduced ``fanout`` at a time to the source's
subroot, the subroots, in the order of their sources, to the root. A row's proof are the digests beside its path.

Method: superblock reduction.

1. Rows are numbered within their source without any group in one task: ranges of (source, doc_id, leaf) are sorted and
   numbered apart; sums of the ranges' sizes give what to add. Only digests and ids are moved, never texts.
2. Rows with the same number // fanout^levels are a bucket. applyInPandas collapses `levels` levels of a bucket in one
   task of fanout^levels rows at most, and gives each row its lower proof and the bucket's root.
3. Buckets' roots are the rows of the next round, until a source has one node; the sources are reduced alike.
4. Lower and upper proofs are concatenated, by one join on (source, bucket).

A null column is the leaf's `-`; a null source is a source of its own and comes first; null ids come first in their
source. Rows with the same id are ordered by their leaves; equal rows have equal leaves, and each has its own place and
proof. Very long texts are hashed by the JVM and not moved. A lone leaf is its source's subroot, a lone subroot the root;
their proofs are empty. An empty table gives no rows. Columns other than doc_id, source, lang, n_chars and text are not
read, whatever their names.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Batches, discard, written

FANOUT, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(text: Column | None = None) -> Column:
    """The digest of a row, with another text if given."""
    parts = []
    for c in FIELDS:
        value = (text if c == "text" and text is not None else F.col(c)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")).cast("binary"))
    return F.sha2(F.concat(*parts), 256)


def _number(batches: Batches) -> Batches:
    """_part, _at: the range, and the row's place in its group within the range. Rows come sorted."""
    part, last, count = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        group = b.column("_group").to_pylist()
        at = np.empty(len(group), np.int64)
        for i, g in enumerate(group):
            if g != last:
                last, count = g, 0
            at[i] = count
            count += 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(group), part, np.int32)), pa.array(at)], names=[*b.schema.names, "_part", "_at"])


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with _index, the place in _group by the columns of order, and _total, the group's rows; a written table of ranges stays behind."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(tasks, "_group", *order).sortWithinPartitions("_group", *order)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    ranged = written(ranged.mapInArrow(_number, f"{fields}, _part int, _at long"), "merkle-ranges")
    sizes = ranged.groupBy("_group", "_part").agg(F.count("*").alias("n"))  # groups and ranges, a row each
    group = Window.partitionBy("_group")
    before = F.coalesce(F.sum("n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_group", "_part", before.alias("_before"), F.sum("n").over(group).alias("_total"))
    out = ranged.join(sizes, ["_group", "_part"]).withColumn("_index", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")
    out.scratch_path = ranged.scratch_path
    return out


def parent(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def collapse(digests: list[str], fanout: int, levels: int) -> tuple[str, list[list[str]], list[list[str]]]:
    """The root over `levels` levels, and for each digest the siblings and the steps (place/run) level by level."""
    siblings: list[list[str]] = [[] for _ in digests]
    steps: list[list[str]] = [[] for _ in digests]
    nodes = digests
    for level in range(levels):
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        width = fanout**level
        for i in range(len(digests)):
            run, at = divmod(i // width, fanout)
            siblings[i] += runs[run][:at] + runs[run][at + 1 :]
            steps[i].append(f"{at}/{len(runs[run])}")
        nodes = [parent(r) for r in runs]
    assert len(nodes) == 1
    return nodes[0], siblings, steps


def levels_of(total: int, fanout: int) -> int:
    """Levels above so many leaves."""
    levels = 0
    while fanout**levels < total:
        levels += 1
    return levels


def _reduced(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """nodes (_group, _index, _total, _digest, ...) with _siblings, _path and _root, their group's; tables of it stay behind."""
    size = fanout**levels
    nodes = nodes.withColumn("_bucket", F.floor(F.col("_index") / size).cast("long"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)

    def bucket(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_index")
        root, siblings, steps = collapse(p["_digest"].tolist(), fanout, min(levels, levels_of(int(p["_total"].iloc[0]), fanout)))
        return p.assign(_siblings=["".join(s) for s in siblings], _path=[",".join(s) for s in steps], _root=root)

    low = written(nodes.groupBy("_group", "_bucket").applyInPandas(bucket, f"{fields}, _siblings string, _path string, _root string"), "merkle-nodes")
    if (low.agg(F.max("_total")).first()[0] or 0) <= size:
        return low
    roots = low.where(F.col("_index") % size == 0).select(
        "_group", F.col("_bucket").alias("_index"), F.ceil(F.col("_total") / size).cast("long").alias("_total"), F.col("_root").alias("_digest")
    )
    high = _reduced(roots, fanout, levels).select(
        "_group", F.col("_index").alias("_bucket"), F.col("_siblings").alias("_more"), F.col("_path").alias("_on"), F.col("_root").alias("_top")
    )
    return _joined(low.drop("_root"), high.withColumnRenamed("_top", "_root"), ["_group", "_bucket"])


def _joined(low: DataFrame, high: DataFrame, on: list[str]) -> DataFrame:
    """Lower and upper proofs one after the other."""
    both = low.join(high, on)
    steps = F.concat_ws(",", F.when(F.col("_path") != "", F.col("_path")), F.when(F.col("_on") != "", F.col("_on")))
    return both.withColumn("_siblings", F.concat("_siblings", "_more")).withColumn("_path", steps).drop("_more", "_on")


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS, **more: Column) -> DataFrame:
    """doc_id, leaf, siblings (digests, one after the other), path (place/run by level), subroot, root for each row.

    more: further columns, made from the row before its text is left behind.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    group = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))  # null comes before all others
    rows = docs.select(group.alias("_group"), F.col("doc_id").alias("_id"), leaf().alias("_digest"), *[v.alias(k) for k, v in more.items()])
    # ids travel as text, for pandas has no whole numbers beside nulls
    ranges = numbered(rows, "_id", "_digest", *more)
    low = _reduced(ranges.withColumn("_id", F.col("_id").cast("string")), fanout, levels)
    subroots = low.where("_index = 0").select(F.lit("").alias("_group"), F.col("_group").alias("_source"), F.col("_root").alias("_digest"))
    high = _reduced(numbered(subroots, "_source"), fanout, levels)
    high = high.select(F.col("_source").alias("_group"), F.col("_siblings").alias("_more"), F.col("_path").alias("_on"), F.col("_root").alias("_top"))
    discard(ranges)
    return _joined(low, high, ["_group"]).select(
        F.col("_id").cast(kind).alias("doc_id"), F.col("_digest").alias("leaf"), F.col("_siblings").alias("siblings"), F.col("_path").alias("path"),
        F.col("_root").alias("subroot"), F.col("_top").alias("root"), *more,
    )


def fold(digest: str, siblings: str, path: str) -> str:
    """The root that a leaf's digest leads to along its proof."""
    at = 0
    for step in path.split(",") if path else ():
        place, run = map(int, step.split("/"))
        left, right = siblings[at : at + 64 * place], siblings[at + 64 * place : at + 64 * (run - 1)]
        digest = sha256((left + digest + right).encode()).hexdigest()
        at += 64 * (run - 1)
    return digest


def verified(proofs: DataFrame, digest: str = "leaf") -> DataFrame:
    """proofs with folded_root, recomputed from the column `digest` and the siblings, and verified: it is the root."""

    @F.pandas_udf("string")
    def folded(d: pd.Series, s: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([fold(*x) for x in zip(d, s, p, strict=True)], dtype=object)

    return proofs.withColumn("folded_root", folded(digest, "siblings", "path")).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered() -> Column:
    """A row's leaf after its text has lost its line ends, where 2 divides crc32 of the id as text (null: empty text)."""
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    return F.when(even, leaf(F.translate(F.col("text"), "\n", ""))).otherwise(leaf())


def digest(docs: DataFrame) -> DataFrame:
    """Proofs of the rows as they are, verified against the tampered ones."""
    out = verified(manifest(docs, seen=tampered()), "seen")
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified")


def _sql_leaf(text: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in (*FIELDS[:-1], text)]
    return f"sha256({' || '.join(parts)})"


ORACLE = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, {_sql_leaf("text")} AS leaf, {_sql_leaf("replace(text, chr(10), '')")} AS cut,
    list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) AS inverted_crc
  FROM documents),
leaves AS (
  SELECT *, CASE WHEN inverted_crc % 2 = 1 THEN cut ELSE leaf END AS seen,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM rows),
nodes AS (
  SELECT source, 0 AS level, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT source, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY source, level, i // 3, n),
subroots AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, i, n, h FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 3, n),
runs AS (SELECT source, level, i // 3 AS run, list(h ORDER BY i) AS hs FROM nodes WHERE n > 1 GROUP BY ALL),
top_runs AS (SELECT level, i // 3 AS run, list(h ORDER BY i) AS hs FROM tops WHERE n > 1 GROUP BY ALL),
lower AS (
  SELECT doc_id, source, leaf, 0 AS level, i, n, seen AS folded, '' AS proof FROM leaves
  UNION ALL
  SELECT doc_id, l.source, leaf, l.level + 1, i // 3, (n + 2) // 3,
    sha256(array_to_string(list_concat(hs[:i % 3], [folded], hs[i % 3 + 2:]), '')), proof || array_to_string(list_concat(hs[:i % 3], hs[i % 3 + 2:]), '')
  FROM lower l JOIN runs r ON r.source IS NOT DISTINCT FROM l.source AND r.level = l.level AND r.run = l.i // 3 WHERE l.n > 1),
upper_steps AS (
  SELECT doc_id, leaf, s.h AS subroot, 0 AS level, s.i, s.n, folded, proof FROM lower l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source WHERE l.n = 1
  UNION ALL
  SELECT doc_id, leaf, subroot, u.level + 1, i // 3, (n + 2) // 3,
    sha256(array_to_string(list_concat(hs[:i % 3], [folded], hs[i % 3 + 2:]), '')), proof || array_to_string(list_concat(hs[:i % 3], hs[i % 3 + 2:]), '')
  FROM upper_steps u JOIN top_runs r ON r.level = u.level AND r.run = u.i // 3 WHERE u.n > 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
  folded = (SELECT h FROM tops WHERE n = 1) AS verified
FROM upper_steps WHERE n = 1
"""
