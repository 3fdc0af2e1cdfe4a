"""Checks of a graph against its contract, and comparisons of snapshots. An empty result means valid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..sources.schema import EDGE_TYPES, NODE_TYPES, STANCES, STATUSES, TIERS


def _found(rows: DataFrame, rule: str, key: str = "id") -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edge id, end: ends that are no node."""
    ends = edges.select("id", F.explode(F.array(F.struct(F.lit("src").alias("end"), F.col("src").alias("node")), F.struct(F.lit("dst").alias("end"), F.col("dst").alias("node")))).alias("e")).select("id", "e.*")
    return ends.join(nodes.select(F.col("id").alias("node")), "node", "left_anti").select("id", "end", "node")


def without_evidence(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    return edges.join(evidence.select(F.col("edge_id").alias("id")), "id", "left_anti")


def violations(nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """rule, key: one row for each violation. Tables need the contract's columns; others are ignored."""
    out = [
        _found(nodes.where(~F.coalesce(F.col("id").rlike("^[A-Za-z0-9_#. |-]+$"), F.lit(False))), "node_id"),
        _found(nodes.where(~F.coalesce(F.col("type").isin(*NODE_TYPES), F.lit(False))), "node_type"),
        _found(nodes.where(F.coalesce(F.trim("name"), F.lit("")) == ""), "node_name"),
        _found(duplicate_keys(nodes, ["id"]), "duplicate_node"),
        _found(duplicate_keys(edges, ["id"]), "duplicate_edge"),
        _found(edges.where(~F.coalesce(F.col("type").isin(*EDGE_TYPES), F.lit(False))), "edge_type"),
        _found(edges.where(~F.coalesce(F.col("tier").isin(*TIERS), F.lit(False))), "edge_tier"),
        _found(edges.where(~F.coalesce(F.col("stance").isin(*STANCES), F.lit(False))), "edge_stance"),
        _found(edges.where(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))), "edge_status"),
        _found(edges.where("tier = 'C' and status = 'verified'"), "inferred_verified"),
        _found(dangling(edges, nodes), "dangling_end"),
        _found(without_evidence(edges, evidence), "edge_without_evidence"),
        _found(evidence.join(edges.select(F.col("id").alias("edge_id")), "edge_id", "left_anti"), "evidence_edge", "edge_id"),
        _found(evidence.where(F.col("retrieved_at").isNull() | (F.col("retrieved_at") > F.current_date())), "evidence_date", "edge_id"),
        _found(endpoint_types(edges, nodes), "endpoint_types"),
    ]
    if "confidence" in edges.columns:
        out.append(_found(edges.where(F.isnan("confidence") | (F.col("confidence") < 0) | (F.col("confidence") > 1)), "edge_confidence"))
    return reduce(DataFrame.unionByName, out)


def endpoint_types(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends have other types than the edge type asks for, or are one node."""
    kinds = nodes.select("id", "type").distinct()
    typed = edges.join(kinds.select(F.col("id").alias("src"), F.col("type").alias("src_type")), "src")
    typed = typed.join(kinds.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst")
    right = reduce(lambda a, b: a | b, [(F.col("type") == k) & (F.col("src_type") == s) & (F.col("dst_type") == d) for k, (s, d) in EDGE_TYPES.items()])
    return typed.where(F.col("type").isin(*EDGE_TYPES) & (~right | (F.col("src") == F.col("dst"))))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change: added, removed or modified."""
    joined = before.select(F.col(key), F.col(digest).alias("x")).join(after.select(F.col(key), F.col(digest).alias("y")), key, "full_outer")
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "modified")
    return joined.select(key, change.alias("change")).where("change is not null")


def not_additive(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Rows of the baseline that the candidate has changed or lost, as often as they were there."""
    return baseline.exceptAll(candidate)


def match_levels(gold: DataFrame, found: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """level, n_gold, n_found, n_match, precision, recall, f1 over multisets of keys."""
    out = []
    for level, keys in levels.items():
        g, f = (x.groupBy(*keys).agg(F.count("*").alias(n)) for x, n in ((gold, "g"), (found, "p")))
        joined = g.join(f, keys, "full_outer").na.fill(0, ["g", "p"])
        out.append(joined.agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_found"), F.sum(F.least("g", "p")).alias("n_match")).withColumn("level", F.lit(level)))
    all_levels = reduce(DataFrame.unionByName, out)
    ratio = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    scored = all_levels.withColumn("precision", ratio("n_match", "n_found")).withColumn("recall", ratio("n_match", "n_gold"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return scored.withColumn("f1", f1)


def record_violations(nodes: DataFrame, evidence: DataFrame, memberships: DataFrame, clusters: DataFrame, today: Column | None = None) -> DataFrame:
    """rule, key: rules on values of the contract's rows, each table read once.

    nodes: id, synonyms, ext_ids, props (map); evidence: id, source_type, source_url, pmid, snippet, retrieved_at (text);
    memberships: node_id, cluster_id; clusters: id, label.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    some = lambda c: F.coalesce(c, F.lit(False))
    node_rules = {
        "node_slug": ~checks.valid_id(F.col("id"), "slug"),
        "node_synonyms": F.col("synonyms").isNull() | some(F.exists("synonyms", lambda x: x.isNull())),
        "node_ext_ids": F.col("ext_ids").isNull() | some(F.exists(F.map_values("ext_ids"), lambda x: x.isNull())),
        "node_placeholder": some(F.col("props")["placeholder"] == "true"),
    }
    evidence_rules = {
        "evidence_url": ~checks.valid_url(F.col("source_url")),
        "evidence_source": blank("source_type") | (F.col("source_type") == "placeholder"),
        "evidence_snippet": blank("snippet"),
        "evidence_pmid": F.col("pmid").isNotNull() & ~checks.valid_id(F.col("pmid"), "pmid"),
        "evidence_day": ~checks.iso_date(F.col("retrieved_at"), today),
    }
    broken = lambda rules: F.filter(F.array(*[F.when(c, k) for k, c in rules.items()]), lambda x: x.isNotNull())
    out = [rows.select(F.explode(broken(rules)).alias("rule"), F.col("id").alias("key")) for rows, rules in ((nodes, node_rules), (evidence, evidence_rules))]
    lost = memberships.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").unionByName(memberships.join(clusters.select(F.col("id").alias("cluster_id")), "cluster_id", "left_anti").select("node_id", "cluster_id"))
    out.append(lost.distinct().select(F.lit("membership").alias("rule"), F.concat_ws("|", "node_id", "cluster_id").alias("key")))
    out.append(clusters.where(F.col("label").isNull()).select(F.lit("cluster_label").alias("rule"), F.col("id").alias("key")))
    return reduce(DataFrame.unionByName, out)


def reference_errors(references: DataFrame, inventory: DataFrame) -> DataFrame:
    """at, path, error: references to files that may not be named, are missing or have changed. references: at, path, sha256; inventory: path, sha256."""
    own = inventory.select("path", F.col("sha256").alias("_sha"))
    joined = references.join(own, "path", "left")
    error = F.when(~checks.safe_path(F.col("path")), "unsafe").when(F.col("_sha").isNull(), "missing").when(F.col("sha256").isNotNull() & (F.col("sha256") != F.col("_sha")), "changed")
    return joined.select("at", "path", error.alias("error")).where("error is not null")


def field_differences(columns: DataFrame, expected: dict[str, list[str]]) -> DataFrame:
    """table, field, side: fields that a table lacks or has besides the contract's. columns: table, field."""
    spark = columns.sparkSession
    want = spark.createDataFrame([(t, f) for t, fs in expected.items() for f in fs], "table string, field string")  # the contract's fields
    own = columns.where(F.col("table").isin(*expected))
    return own.exceptAll(want).withColumn("side", F.lit("unexpected")).unionByName(want.exceptAll(own).withColumn("side", F.lit("missing")))


def provenance_errors(evidence: DataFrame, audit: DataFrame) -> DataFrame:
    """id, error: evidence (id, source_url, record: JSON text) against what was reviewed (id, evidence_sha256, source_url, curation_file, source_record, record_sha256)."""
    joined = evidence.join(audit.withColumnRenamed("source_url", "_url").withColumn("_known", F.lit(True)), "id", "left")
    known = F.col("_known").isNotNull()
    rules = {
        "missing provenance": ~known,
        "changed after review": known & ~F.coalesce(F.col("evidence_sha256") == checks.json_digest("record"), F.lit(False)),
        "source or curation inconsistent": known & ((F.coalesce("curation_file", F.lit("")) == "") | ~F.coalesce(F.col("_url") == F.col("source_url"), F.lit(False))),
        "source record changed": known & F.col("source_record").isNotNull() & ~F.coalesce(F.col("record_sha256") == checks.json_digest("source_record"), F.lit(False)),
    }
    found = F.filter(F.array(*[F.when(c, k) for k, c in rules.items()]), lambda x: x.isNotNull())
    return joined.select("id", F.explode(found).alias("error"))


def not_subset(claimed: DataFrame, supporting: DataFrame, keys: list[str]) -> DataFrame:
    """Claimed rows that nothing supports."""
    return claimed.select(*keys).distinct().join(supporting.select(*keys), keys, "left_anti")
