"""Registered queries on the build of the tables, on access and on answers to questions. SQL is in oracle_build.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import access
from ..operators import answers, build
from ..sources import testdata
from ..sources.schema import EVIDENCE, Graph
from ..sources.testdata import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _props(**values: Column) -> Column:
    """Properties without the null ones."""
    if not values:
        return F.expr("cast(map() as map<string, string>)")
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _sections(s: SparkSession, d: str) -> DataFrame:
    """Nodes of two sections, ontology and research; brands and types are in the ontology once for each part that names them."""
    part = table(s, d, "part")
    node = lambda rows, i, kind, name, props, origin: rows.select(i.alias("id"), F.lit(kind).alias("type"), name.alias("name"), props.alias("props"), F.lit(origin).alias("source_file"))
    key = F.col("p_partkey")
    sub = key % 10 == 3
    disease = _props(
        gene_symbol=F.when(key % 7 != 0, F.col("p_brand")), curated_subgroup=F.when(sub, "true"), subgroup_definition=F.when(sub, F.col("p_type")), functional_scope=F.when(sub, F.col("p_name"))
    )
    supplier = F.col("s_suppkey")
    out = node(part, F.concat(F.lit("d"), _text("p_partkey")), "disease", F.col("p_name"), disease, "ontology")
    for more in (
        node(part, F.concat(F.lit("g"), "p_brand"), "gene", F.col("p_brand"), _props(), "ontology"),
        node(part, F.concat(F.lit("t"), "p_type"), "phenotype", F.col("p_type"), _props(), "ontology"),
        node(part.where("p_partkey % 2 = 0"), F.concat(F.lit("g"), "p_brand"), "gene", F.col("p_brand"), _props(), "research"),
        node(table(s, d, "supplier"), F.concat(F.lit("m"), _text("s_suppkey")), "mechanism", F.col("s_name"), _props(scope=F.when(supplier % 2 == 0, F.concat(F.lit("Scope of "), "s_name"))), "research"),
        node(
            table(s, d, "orders"), F.concat(F.lit("o"), _text("o_orderkey")), "asset", F.col("o_orderpriority"),
            _props(asset_type=F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")), url=F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("https://x.org/"), _text("o_orderkey")))), "research",
        ),
    ):
        out = out.unionByName(more)
    return out


@query
def built_nodes(s: SparkSession, d: str) -> DataFrame:
    """One node for each id of all sections, with its plain text, kind, source and first section."""
    nodes, _ = build.one_each(_sections(s, d))
    done = build.with_defaults(nodes)
    said = F.col("props")
    return done.select("id", "type", "name", "source_file", said["plain"].alias("plain"), said["kind"].alias("kind"), said["source_url"].alias("source_url"))


def _annotations(s: SparkSession, d: str) -> DataFrame:
    """Line items as source rows: those of even orders say that a disease has a gene (a supplier), others a phenotype."""
    even = F.col("l_orderkey") % 2 == 0
    return table(s, d, "lineitem").select(
        F.concat(F.lit("d"), _text("l_partkey")).alias("src"), F.concat(F.when(even, "g").otherwise("t"), _text("l_suppkey")).alias("dst"), F.when(even, "disease_gene").otherwise("disease_phenotype").alias("type"),
        F.when(F.col("l_returnflag") == "R", "contradicts").otherwise("supports").alias("stance"), F.lit("mondo").alias("source_type"), F.concat(F.lit("https://x.org/"), _text("l_orderkey")).alias("source_url"),
        F.col("l_linestatus").alias("snippet"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("retrieved_at"), F.concat(F.lit("order "), _text("l_orderkey")).alias("source_id"),
        F.concat(F.lit("line "), _text("l_linenumber")).alias("source_record_locator"), F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")).alias("record_sha256"),
    )


@query
def merged_annotations(s: SparkSession, d: str) -> DataFrame:
    """Edges of all source rows, with the number, the first id and the last day of their evidence."""
    edges, said = build.merge_annotations(_annotations(s, d))
    counts = said.groupBy(F.col("edge_id").alias("id")).agg(F.count("*").alias("n_evidence"), F.min("id").alias("first_evidence"), F.max("retrieved_at").cast("string").alias("last_day"))
    return edges.join(counts, "id").select("id", "src", "dst", "stance", "note", "n_evidence", "first_evidence", "last_day")


@query
def graph_digests(s: SparkSession, d: str) -> DataFrame:
    """The digest of each table of the graph, whole, and of the graph."""
    edges = testdata.edges(s, d).select("id", "src", "dst", "type", "tier", "stance", "status", "n_records")
    evidence = testdata.evidence(s, d).select("edge_id", "source_type", "order_key", "retrieved_at")
    return build.graph_digests({"nodes": testdata.nodes(s, d), "edges": edges, "evidence": evidence, "node_cluster": testdata.mechanism_clusters(s, d)})


def _expansion(s: SparkSession, d: str) -> build.Expansion:
    """Line items shipped before 1996 as the graph, the later ones as the section that is added, under its own ids."""
    rows = table(s, d, "lineitem").select(
        F.concat(F.lit("d"), _text("l_partkey")).alias("src"), F.concat(F.lit("m"), _text("l_suppkey")).alias("dst"),
        F.when(F.col("l_returnflag") == "R", "contradicts").otherwise("supports").alias("stance"), (F.year("l_shipdate") >= 1996).alias("later"),
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.to_date("l_shipdate").alias("day"),
    )
    rows = rows.withColumn("edge_id", F.concat_ws("_", F.when(F.col("later"), "x").otherwise("e"), "src", "dst", "stance")).where("later is not null")
    edges = rows.select(F.col("edge_id").alias("id"), "src", "dst", F.lit("disease_mechanism").alias("type"), "stance", "later").distinct()
    said = rows.select(F.concat_ws("_", F.lit("ev"), F.substring("edge_id", 3, 1 << 20), F.concat_ws("-", "o", "n")).alias("id"), "edge_id", F.concat_ws("-", "o", "n").alias("suffix"), "day", "later")
    part = table(s, d, "part")
    node = part.select(F.concat(F.lit("d"), _text("p_partkey")).alias("id"), F.lit("disease").alias("type"), "p_name", F.create_map(F.lit("BRAND"), F.col("p_brand")).alias("ext_ids"), "p_partkey")
    known = node.where("p_partkey % 5 != 0").drop("p_partkey")
    other = node.withColumn("ext_ids", F.when(F.col("p_partkey") % 20 == 1, F.create_map(F.lit("BRAND"), F.lit("other"))).otherwise(F.col("ext_ids"))).drop("p_partkey")
    none = s.createDataFrame([], EVIDENCE)
    base = Graph(known, edges.where("not later").drop("later"), said.where("not later").select("id", "edge_id", "day"), none, none)
    return build.expand(base, other, edges.where("later").drop("later"), said.where("later").drop("later"))


@query
def expanded_edges(s: SparkSession, d: str) -> DataFrame:
    """Edges that get evidence from the added section: new or there before, and how much."""
    out = _expansion(s, d)
    counts = out.evidence.groupBy(F.col("edge_id").alias("id")).agg(F.count("*").alias("n_evidence"), F.max("day").cast("string").alias("last_day"))
    new = out.edges.select("id", F.lit(True).alias("_new"))
    return counts.join(new, "id", "left").select("id", "n_evidence", "last_day", F.coalesce("_new", F.lit(False)).cast("int").alias("is_new"))


@query
def expansion_refused(s: SparkSession, d: str) -> DataFrame:
    """Nodes that the section adds, and its nodes and evidence that are refused, with the reason; known and equal nodes do not appear."""
    out = _expansion(s, d)
    added = out.nodes.select(F.lit("nodes").alias("table"), F.col("id").alias("key"), F.lit("added").alias("reason"))
    return added.unionByName(out.refused.select("table", "key", "reason"))


@query
def source_dates(s: SparkSession, d: str) -> DataFrame:
    """Every order's last retrieval: the latest of all line items, as manifests, that hold it; null where none does."""
    manifests = table(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.to_date("l_shipdate").cast("string").alias("retrieved_at"))
    dated, missing = build.retrieval_dates(table(s, d, "orders").select(F.col("o_orderkey").alias("key")), manifests)
    return dated.unionByName(missing.withColumn("retrieved_at", F.lit(None).cast("string")))


@query
def panel_access(s: SparkSession, d: str) -> DataFrame:
    """Orders as requests of their customers for panels: open, reduced, and which role has the whole of it. By SQL functions."""
    access.register(s, assigned=None, members=None)
    roles = F.element_at(F.array(*[F.lit(r) for r in (*access.ROLES, "guest")]), (F.col("c_custkey") % 6 + 1).cast("int"))
    panels = F.element_at(F.array(*[F.lit(p) for p in access.PANELS]), (F.col("o_orderkey") % len(access.PANELS) + 1).cast("int"))
    users = table(s, d, "customer").select("c_custkey", roles.alias("role"))
    asked = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), panels.alias("panel")).join(users, "c_custkey")
    yes = lambda call: F.expr(f"cast({call} as int)")
    return asked.select(
        F.col("o_orderkey").alias("request"), "role", "panel", yes("may_open(role, panel)").alias("opens"), yes("is_reduced(role, panel)").alias("reduced"),
        F.expr("role_with_full(panel)").alias("full_role"), F.expr("stored_role(role)").alias("stored"),
    )


#: Questions about each stated disease.
ASKED = (
    "Who works on d{}?", "Which grants cover d{}?", "Is there a registry for d{}", "What contradicts d{}?", "How is d{} linked to d{}?",
    "Which conditions are similar to d{}", "Tell me about d{}", "Mechanism of d{}", "What about QX{}?",
)


def _answers(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nine questions about each disease whose number is divisible by 100, against the whole graph; diseases and mechanisms are named by their ids."""
    key = F.col("p_partkey")

    def asked(k: int) -> Column:
        parts = ASKED[k].split("{}")
        values = [(key % 900 + 100).cast("string") if k == len(ASKED) - 1 else (key + i).cast("string") for i in range(len(parts) - 1)]
        return F.concat(F.lit(parts[0]), *[x for v, rest in zip(values, parts[1:], strict=True) for x in (v, F.lit(rest))])

    rows = F.explode(F.array(*[F.struct(F.concat(_text("p_partkey"), F.lit(f"-{k + 1}")).alias("id"), asked(k).alias("text")) for k in range(len(ASKED))]))
    questions = table(s, d, "part").where("p_partkey % 100 = 0").select(rows.alias("q")).select("q.*")
    nodes = testdata.nodes(s, d)
    terms = nodes.where("type in ('disease', 'mechanism')").select(F.col("id").alias("term"), F.col("id").alias("node_id"), "type")
    funded = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("o"), _text("o_orderkey")).alias("asset"))
    return answers.answer(questions, terms, nodes, testdata.edges(s, d), funded)


@query
def answer_leads(s: SparkSession, d: str) -> DataFrame:
    return _answers(s, d)[0]


@query
def answer_items(s: SparkSession, d: str) -> DataFrame:
    return _answers(s, d)[1]
