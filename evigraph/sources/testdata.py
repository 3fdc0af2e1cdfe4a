"""The driver's star-schema tables seen as an evidence graph.

Parts are diseases, suppliers mechanisms, customers investigators, orders awards, brands genes, part types phenotypes,
nations patient groups, regions clusters. Line items are the source records, all of them: those of the same (source,
target, stance) become one edge, and each stays as evidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import stored, version


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source records: disease, mechanism, order, stance, status, tier, and the evidence columns."""
    rows = table(spark, sf_dir, "lineitem")
    stance = F.when(F.col("l_returnflag") == "A", "supports").when(F.col("l_returnflag") == "R", "contradicts").otherwise("neutral")
    tier = F.when(F.col("l_linenumber") <= 3, "A").when(F.col("l_linenumber") <= 5, "B").when(F.col("l_linenumber") == 6, "C").otherwise("D")
    return rows.select(
        _id("d", "l_partkey").alias("disease"),
        _id("m", "l_suppkey").alias("mechanism"),
        F.col("l_orderkey").alias("order_key"),
        stance.alias("stance"),
        F.when(F.col("l_linestatus") == "F", "verified").otherwise("unverified").alias("status"),
        tier.alias("tier"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("quantity"),
        F.to_date("l_shipdate").alias("retrieved_at"),
    )


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], key: str) -> DataFrame:
    """A table that all queries of an application read, clustered by key: written at its first use, anew if the files of sf_dir change."""
    return stored(spark, f"{name} of {sf_dir} {version(spark, sf_dir)}", build, key)


def _merged(spark: SparkSession, sf_dir: str, kind: str, src: str, dst: str, rows: Callable[[], DataFrame]) -> DataFrame:
    """Parallel records as one edge each, a table that all queries of an application read: written at its first use."""
    return kept(spark, sf_dir, kind, lambda: _merge(rows(), kind, src, dst), "src")


def _merge(rows: DataFrame, kind: str, src: str, dst: str) -> DataFrame:
    """Verified if any record is, with the best tier."""
    grouped = rows.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst"), "stance").agg(
        F.max("status").alias("status"), F.min("tier").alias("tier"), F.count("*").alias("n_records")
    )
    return _edges(grouped, kind)


def _edges(rows: DataFrame, kind: str) -> DataFrame:
    key = F.concat_ws("|", F.lit(kind), "src", "dst", "stance")
    return rows.select(key.alias("id"), "src", "dst", F.lit(kind).alias("type"), "tier", "stance", "status", F.col("n_records").cast("long").alias("n_records"))


def _stated(rows: DataFrame, kind: str, tier: str) -> DataFrame:
    return _edges(rows.withColumns({"stance": F.lit("supports"), "status": F.lit("verified"), "tier": F.lit(tier), "n_records": F.lit(1)}), kind)


def mechanism_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "disease_mechanism", "disease", "mechanism", lambda: records(spark, sf_dir))


def investigator_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), _id("c", "o_custkey").alias("person"))
    return _merged(spark, sf_dir, "investigator_disease", "person", "disease", lambda: records(spark, sf_dir).join(orders, "order_key"))


def asset_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "asset_disease", "asset", "disease", lambda: records(spark, sf_dir).withColumn("asset", _id("o", "order_key")))


def gene_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stated(table(spark, sf_dir, "part").select(_id("d", "p_partkey").alias("src"), _id("g", "p_brand").alias("dst")), "disease_gene", "A")


def phenotype_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    typed = part.select(_id("d", "p_partkey").alias("src"), _id("t", "p_type").alias("dst"))
    broad = part.where("p_size >= 10").select(_id("d", "p_partkey").alias("src"), F.lit("tBROAD").alias("dst"))
    return _stated(typed.unionByName(broad), "disease_phenotype", "B")


def group_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "group_disease", lambda: _group_edges(spark, sf_dir), "dst")


def _group_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select(_id("m", "s_suppkey").alias("mechanism"), _id("n", "s_nationkey").alias("src"))
    rows = records(spark, sf_dir).where("stance = 'supports'").join(supplier, "mechanism").select("src", F.col("disease").alias("dst")).distinct()
    return _stated(rows, "group_disease", "A")


def parent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_partkey % 10 = 3")
    return _stated(part.select(_id("d", "p_partkey").alias("src"), F.concat(F.lit("d"), (F.col("p_partkey") - 3).cast("string")).alias("dst")), "subgroup_of", "A")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = (mechanism_edges, investigator_edges, asset_edges, gene_edges, phenotype_edges, group_edges, parent_edges)
    out = kinds[0](spark, sf_dir)
    for kind in kinds[1:]:
        out = out.unionByName(kind(spark, sf_dir))
    return out


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, name: a union of eight scans, written at its first use and read by id from then on."""
    return kept(spark, sf_dir, "nodes", lambda: _nodes(spark, sf_dir), "id")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: table(spark, sf_dir, name)
    node = lambda rows, key, kind, name: rows.select(key.alias("id"), F.lit(kind).alias("type"), name.cast("string").alias("name"))
    part = read("part")
    out = node(part, _id("d", "p_partkey"), "disease", F.col("p_name"))
    for more in (
        node(read("supplier"), _id("m", "s_suppkey"), "mechanism", F.col("s_name")),
        node(read("customer"), _id("c", "c_custkey"), "person", F.col("c_name")),
        node(read("orders"), _id("o", "o_orderkey"), "asset", F.col("o_orderpriority")),
        node(part.select("p_brand").distinct(), _id("g", "p_brand"), "gene", F.col("p_brand")),
        node(part.select("p_type").distinct(), _id("t", "p_type"), "phenotype", F.col("p_type")),
        node(spark.range(1), F.lit("tBROAD"), "phenotype", F.lit("BROAD")),
        node(read("nation"), _id("n", "n_nationkey"), "patient_group", F.col("n_name")),
    ):
        out = out.unionByName(more)
    return out


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, source_type, retrieved_at: a row for each record of a mechanism edge."""
    rows = records(spark, sf_dir)
    edge = F.concat_ws("|", F.lit("disease_mechanism"), "disease", "mechanism", "stance")
    return rows.select(edge.alias("edge_id"), F.concat(F.lit("line"), F.col("line").cast("string")).alias("source_type"), "order_key", "quantity", "retrieved_at")


def mechanism_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, cluster_id: a mechanism belongs to the cluster of its supplier's region."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    joined = supplier.join(F.broadcast(nation), supplier["s_nationkey"] == nation["n_nationkey"])  # nations: 25 rows
    return joined.select(_id("m", "s_suppkey").alias("node_id"), _id("r", "n_regionkey").alias("cluster_id"))


def awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        _id("o", "o_orderkey").alias("asset"), _id("c", "o_custkey").alias("person"), F.col("o_orderkey").alias("application"), F.col("o_custkey").alias("project"),
        F.year("o_orderdate").alias("fiscal_year"), F.col("o_orderpriority").alias("institute"), F.col("o_totalprice").alias("total_cost"),
    )
