"""Registered queries on the read model, values of single records, governance and provenance. SQL is in oracle_model.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks
from ..operators import actions, claims, connections, governance, links, quality, readmodel, reports
from ..sources import testdata
from ..sources.testdata import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _d(c: str = "p_partkey", prefix: str = "d") -> Column:
    return F.concat(F.lit(prefix), _text(c))


def _decisions(s: SparkSession, d: str) -> DataFrame:
    """Stated decisions over mechanism edges: neutral ones rejected, contradicting tier-D ones approved."""
    e = testdata.mechanism_edges(s, d)
    return e.where("stance = 'neutral' and tier = 'D' or stance = 'contradicts' and tier = 'D'").select(F.col("id").alias("edge_id"), F.when(F.col("stance") == "neutral", "rejected").otherwise("approved").alias("decision"))


def _view(s: SparkSession, d: str) -> DataFrame:
    return readmodel.edge_view(testdata.mechanism_edges(s, d).unionByName(testdata.parent_edges(s, d)), testdata.nodes(s, d), testdata.mechanism_clusters(s, d), _decisions(s, d))


def _sources(s: SparkSession, d: str) -> DataFrame:
    """Line items as records of several kinds of source."""
    kinds = ("pubmed", "hpo", "clinicaltrials", "nih_reporter", "orphadata", "mondo", "patient_organization", "placeholder", "blog")
    line = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(len(kinds))) + 1).cast("int"))
    key = _text("l_orderkey")
    url = (
        F.when(kind == "clinicaltrials", F.concat(F.lit("https://clinicaltrials.gov/study/NCT"), F.lpad(key, 8, "0")))
        .when(kind == "mondo", F.concat(F.lit("https://example.org/MONDO:"), key))
        .when(kind == "orphadata", F.concat(F.lit("https://api.example.org/orphacodes/"), key))
        .when(kind == "nih_reporter", F.concat(F.lit("https://reporter.nih.gov/project-details/"), key))
        .when(kind == "patient_organization", F.concat(F.lit("https://www.Group-"), key, F.lit(".org/page")))
        .when(kind == "blog", F.concat(F.lit("http://user@blog"), key, F.lit(".net/x?y")))
        .when(kind == "pubmed", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), key))
    )
    return line.select(
        F.concat_ws("-", key, _text("l_linenumber")).alias("id"), F.concat_ws("|", _d("l_partkey"), _d("l_suppkey", "m")).alias("edge_id"), kind.alias("source_type"), url.alias("source_url"),
        F.when(kind == "pubmed", key).alias("pmid"), F.when(F.col("l_linenumber") < 7, F.col("l_returnflag")).alias("snippet"),
        F.concat(F.lit("2021-"), F.lpad(F.pmod("l_orderkey", F.lit(14)).cast("string"), 2, "0"), F.lit("-"), F.lpad(F.pmod("l_partkey", F.lit(32)).cast("string"), 2, "0")).alias("retrieved_at"),
    )


@query
def read_model_edges(s: SparkSession, d: str) -> DataFrame:
    return _view(s, d)


@query
def read_model_evidence(s: SparkSession, d: str) -> DataFrame:
    titles = table(s, d, "orders").where("o_orderkey % 2 = 0").select(_text("o_orderkey").alias("pmid"), F.concat(F.lit("Order of "), "o_orderpriority").alias("title"))
    return readmodel.evidence_view(_sources(s, d), titles)


@query
def read_model_nodes(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part")
    own = part.select(
        _d().alias("id"), F.array("p_brand").alias("synonyms"), F.create_map(F.lit("OMIM"), _text("p_partkey"), F.lit("HPO"), F.lit(""), F.lit("LOCAL"), F.col("p_brand")).alias("ext_ids"),
        F.array(F.col("p_type"), F.lit(None), F.col("p_brand")).alias("terms"), F.lit(None).cast("string").alias("kind"),
    )
    nodes = testdata.nodes(s, d).where("type = 'disease'").join(own, "id")
    assets = table(s, d, "orders").select(
        _d("o_orderkey", "o").alias("id"), F.lit("asset").alias("type"), F.col("o_orderpriority").alias("name"), F.array().cast("array<string>").alias("synonyms"), F.create_map().cast("map<string,string>").alias("ext_ids"),
        F.array().cast("array<string>").alias("terms"), F.when(F.col("o_orderstatus") == "F", "funded_research_project").alias("kind"),
    )
    added = part.where("p_partkey % 3 = 0").select(_d().alias("node_id"), F.explode(F.array(F.col("p_brand"), F.lit("Added"))).alias("synonym"))
    view = readmodel.node_view(nodes.unionByName(assets), testdata.mechanism_clusters(s, d), testdata.edges(s, d), added)
    flat = lambda c, f: F.array_join(F.transform(c, f), ";")
    return view.select(
        "id", "type", "name", flat("synonyms", lambda x: x).alias("synonyms"), flat("related", lambda x: x).alias("related"),
        flat("ids", lambda x: F.concat_ws("=", x["namespace"], x["value"], x["url"])).alias("ids"), F.size("clusters").alias("n_clusters"), "centrality",
    )


@query
def nested_evidence(s: SparkSession, d: str) -> DataFrame:
    own = testdata.evidence(s, d).select("edge_id", F.concat_ws("-", _text("order_key"), "source_type").alias("id"), "source_type")
    nested = readmodel.nested_evidence(testdata.mechanism_edges(s, d).select("id"), own)
    return nested.select("id", F.size("evidence").alias("n"), F.array_join(F.transform("evidence", lambda x: x["id"]), ",").alias("evidence_ids"))


@query
def node_page(s: SparkSession, d: str) -> DataFrame:
    focus = table(s, d, "part").where("p_partkey % 100 = 0").select(_d().alias("id"))
    return readmodel.incident(_view(s, d), focus)


@query
def first_gene(s: SparkSession, d: str) -> DataFrame:
    return readmodel.first_gene(testdata.edges(s, d))


@query
def diseases_of_genes(s: SparkSession, d: str) -> DataFrame:
    e = testdata.edges(s, d)
    return readmodel.diseases_of_genes(e, links.centrality(e), testdata.nodes(s, d))


@query
def path_citations(s: SparkSession, d: str) -> DataFrame:
    """All edges of a disease as one path, in the order of their ids."""
    e = _view(s, d)
    paths = e.groupBy(F.col("src").alias("path_id")).agg(F.array_sort(F.collect_list("id")).alias("edge_ids"))  # a disease's edges
    cited = testdata.evidence(s, d).groupBy("edge_id").agg(F.min("source_type").alias("url"))
    out = readmodel.citations(e, cited, paths)
    return out.select("path_id", F.array_join("edge_ids", ",").alias("edge_ids"), "n_more")


@query
def keep_last_event(s: SparkSession, d: str) -> DataFrame:
    return readmodel.keep_last(table(s, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", "event_id", "event_type", "place")


@query
def money_by_funder(s: SparkSession, d: str) -> DataFrame:
    return reports.money_by(testdata.awards(s, d).withColumn("total_cost", F.round(F.col("total_cost") * 100).cast("long")), "institute")


@query
def money_by_project(s: SparkSession, d: str) -> DataFrame:
    return reports.money_by(testdata.awards(s, d).withColumn("total_cost", F.round(F.col("total_cost") * 100).cast("long")), "project")


def _disease_clusters(s: SparkSession, d: str) -> DataFrame:
    """Diseases by brand and size as clusters."""
    return table(s, d, "part").select(F.concat_ws("/", "p_brand", _text("p_size")).alias("cluster_id"), _d().alias("disease"))


@query
def cluster_mechanisms(s: SparkSession, d: str) -> DataFrame:
    return reports.cluster_mechanisms(_disease_clusters(s, d), links.links(testdata.mechanism_edges(s, d), "src", "dst", "usable"))


@query
def cluster_members(s: SparkSession, d: str) -> DataFrame:
    return reports.cluster_members(_disease_clusters(s, d).withColumnRenamed("disease", "node_id"), testdata.nodes(s, d))


def _inventory_queries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_type").alias("source"), F.concat_ws(" ", "p_name", "p_type").alias("query"), F.col("p_size").cast("long").alias("retrieved"), (F.col("p_size") * 3).cast("long").alias("total"))


@query
def source_chart(s: SparkSession, d: str) -> DataFrame:
    q = _inventory_queries(s, d)
    views = {v: reports.source_chart(q, ["tin", "Steel", "copper"], v).withColumn("view", F.lit(v)) for v in ("kept", "all", "gene")}
    return views["kept"].unionByName(views["all"]).unionByName(views["gene"])


@query
def builder_status(s: SparkSession, d: str) -> DataFrame:
    e = testdata.mechanism_edges(s, d)
    queue = e.where("tier in ('C', 'D')").select("id", F.when(F.col("tier") == "C", "inferred").otherwise("contributed").alias("origin"))
    queue = queue.join(_decisions(s, d).select(F.col("edge_id").alias("id"), "decision"), "id", "left")
    return reports.builder_status(queue, e.withColumn("confidence", F.when(F.col("n_records") > 1, 0.5)))


@query
def inventory_rollup(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "O", "housekeeping").otherwise("data")
    path = F.concat(F.lit("raw/"), F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.concat(F.substring("o_orderpriority", 3, 20), F.lit("/"))), _text("o_orderkey"))
    return reports.inventory_rollup(table(s, d, "orders").select(path.alias("path"), kind.alias("kind"), F.col("o_custkey").cast("long").alias("size")))


@query
def investigators_in_order(s: SparkSession, d: str) -> DataFrame:
    """A top-k report: the first 100."""
    people = reports.investigators(testdata.investigator_edges(s, d), testdata.awards(s, d), _clusters_of_diseases(s, d))
    return reports.investigators_in_order(people, testdata.nodes(s, d)).select("person", "name", "shared", "n_diseases", "rank")


def _clusters_of_diseases(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(_d().alias("node_id"), F.col("p_type").alias("cluster_id"))


@query
def mechanisms_in_order(s: SparkSession, d: str) -> DataFrame:
    """A top-k report: the first 100 mechanisms by their supporting diseases, then by name."""
    index = reports.mechanism_index(testdata.mechanism_edges(s, d)).join(testdata.nodes(s, d).select(F.col("id").alias("mechanism"), "name"), "mechanism")
    return reports.top_by(index.select("mechanism", "name", "n_supports"), [F.desc("n_supports"), "name", "mechanism"])


@query
def diseases_in_order(s: SparkSession, d: str) -> DataFrame:
    """A top-k report: the first 100 diseases by name."""
    return reports.top_by(testdata.nodes(s, d).where("type = 'disease'").select("id", "name"), ["name", "id"])


@query
def value_checks(s: SparkSession, d: str) -> DataFrame:
    rows = _sources(s, d)
    return rows.select(
        "id", checks.valid_url(F.col("source_url")).alias("url_ok"), checks.host(F.col("source_url")).alias("host"), checks.url_id(F.col("source_url"), "nct").alias("nct"), checks.url_id(F.col("source_url"), "mondo").alias("mondo"),
        checks.valid_id(F.col("pmid"), "pmid").alias("pmid_ok"), checks.valid_id(F.col("id"), "slug").alias("slug_ok"), checks.iso_date(F.col("retrieved_at"), F.lit("2021-06-30").cast("date")).alias("date_ok"),
    )


@query
def value_formats(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "RECRUITING").when(F.col("o_orderstatus") == "O", "ACTIVE_NOT_RECRUITING")
    return o.select(
        "o_orderkey", checks.day_text(F.col("o_orderdate")).alias("day"), checks.money_text(F.col("o_totalprice")).alias("money"), checks.plural(F.col("o_custkey") % 3, "study", "studies").alias("studies"),
        checks.study_status(status).alias("status"), checks.open_study(status).alias("open"), checks.effect(F.when(F.col("o_orderkey") % 2 == 0, "gain_of_function").otherwise(F.col("o_orderpriority"))).alias("effect"),
        checks.claim_effect(F.when(F.col("o_orderkey") % 2 == 0, "disease_mechanism").otherwise("disease_gene"), F.when(F.col("o_orderkey") % 3 == 0, "not_applicable").otherwise("gain_of_function")).alias("claim_effect"),
        checks.safe_path(F.concat(F.when(F.col("o_orderkey") % 4 == 0, "raw/../").when(F.col("o_orderkey") % 4 == 1, "c:/raw/").otherwise("raw/"), "o_orderpriority")).alias("safe"),
        checks.redact(F.concat(F.lit("http://x.org/?a=1&api_key="), _text("o_orderkey"), F.lit("&b=2 Authorization: Bearer z"), _text("o_custkey"))).alias("redacted"),
        checks.short_name(F.col("o_orderpriority"), F.array(F.col("o_orderpriority"), F.concat(F.lit("O-"), _text("o_orderkey")))).alias("short"),
    )


def _json(s: SparkSession, d: str) -> DataFrame:
    """Parts as JSON records."""
    one = F.to_json(F.struct(F.col("p_size").alias("size"), F.struct(F.col("p_name").alias("name"), F.array("p_brand", F.concat(F.lit("raw/"), "p_type")).alias("files")).alias("inner")))
    return table(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", one.alias("record"))


@query
def json_records(s: SparkSession, d: str) -> DataFrame:
    rows = _json(s, d)
    part_of = F.to_json(F.struct(F.struct(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("x").alias("name")).alias("inner")))
    return rows.select(
        "p_partkey", checks.json_digest("record").alias("digest"), F.size(checks.json_leaves("record")).alias("n_leaves"), checks.json_at("record", F.lit("inner.name")).alias("inner_name"),
        checks.holds(F.col("record"), F.col("p_brand")).alias("has_brand"), checks.holds(F.col("record"), F.lit("no such text")).alias("has_other"), F.get(checks.raw_references(F.col("record")), 0)["at"].alias("raw_at"),
        checks.json_subset(part_of, "record").alias("subset"),
    )


@query
def record_violations(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part")
    nodes = part.select(
        F.when(F.col("p_partkey") % 50 == 0, F.lit("Bad Id")).otherwise(_d()).alias("id"), F.when(F.col("p_partkey") % 60 != 0, F.array("p_brand")).alias("synonyms"),
        F.create_map(F.lit("A"), F.when(F.col("p_partkey") % 70 != 0, F.col("p_brand"))).alias("ext_ids"), F.create_map(F.lit("placeholder"), (F.col("p_partkey") % 80 == 0).cast("string")).alias("props"),
    )
    member = part.select(F.when(F.col("p_partkey") % 90 == 0, F.lit("gone")).otherwise(_d()).alias("node_id"), F.col("p_type").alias("cluster_id")).where("node_id not like '%00' and node_id not like '%50'")
    clusters = part.select(F.col("p_type").alias("id")).distinct().where("id not like 'E%'").select("id", F.when(~F.col("id").like("S%"), F.col("id")).alias("label"))
    return quality.record_violations(nodes, _sources(s, d), member, clusters, F.lit("2021-06-30").cast("date"))


@query
def reference_errors(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    path = F.concat(F.when(F.col("o_orderkey") % 10 == 0, "raw/../").otherwise("raw/"), _text("o_orderkey"))
    references = o.select(_text("o_orderkey").alias("at"), path.alias("path"), F.sha2(F.when(F.col("o_orderkey") % 7 == 0, F.lit("other")).otherwise(F.col("o_orderpriority")), 256).alias("sha256"))
    inventory = o.where("o_orderkey % 11 != 0").select(F.concat(F.lit("raw/"), _text("o_orderkey")).alias("path"), F.sha2("o_orderpriority", 256).alias("sha256"))
    return quality.reference_errors(references, inventory)


@query
def provenance_errors(s: SparkSession, d: str) -> DataFrame:
    rows = _json(s, d)
    evidence = rows.select(_text("p_partkey").alias("id"), F.concat(F.lit("https://x.org/"), _text("p_size")).alias("source_url"), F.concat(F.lit('{"a":"'), "p_brand", F.lit('"}')).alias("record"))
    seen = F.concat(F.lit('{"a":"'), F.when(F.col("p_partkey") % 9 == 0, F.lit("old")).otherwise(F.col("p_brand")), F.lit('"}'))
    audit = rows.where("p_partkey % 13 != 0").select(
        _text("p_partkey").alias("id"), F.sha2(seen, 256).alias("evidence_sha256"), F.concat(F.lit("https://x.org/"), F.when(F.col("p_partkey") % 8 == 0, F.lit("y")).otherwise(_text("p_size"))).alias("source_url"),
        F.when(F.col("p_partkey") % 17 != 0, F.lit("curation.json")).alias("curation_file"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"b":'), _text("p_size"), F.lit("}"))).alias("source_record"),
        F.sha2(F.concat(F.lit('{"b":'), F.when(F.col("p_partkey") % 6 == 0, F.lit("0")).otherwise(_text("p_size")), F.lit("}")), 256).alias("record_sha256"),
    )
    return quality.provenance_errors(evidence, audit)


@query
def roles_of_users(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    role = F.element_at(F.array(*map(F.lit, ("family", "group_leader", "scout", "researcher", "admin"))), (F.pmod("c_custkey", F.lit(5)) + 1).cast("int"))
    return governance.roles_of(table(s, d, "orders").select(F.col("o_custkey").alias("user_id")).unionByName(c.select(F.col("c_custkey").alias("user_id"))), c.where("c_custkey % 7 != 0").select(F.col("c_custkey").alias("user_id"), role.alias("role")))


@query
def visible_contacts(s: SparkSession, d: str) -> DataFrame:
    contacts = table(s, d, "orders").select(F.concat(F.when(F.col("o_orderkey") % 5 == 0, "m").otherwise("c"), _text("o_custkey")).alias("person_node_id"), _text("o_orderkey").alias("contact"))
    seen = [governance.visible_contacts(contacts, testdata.nodes(s, d), r).groupBy("person_node_id").agg(F.count("*").alias("n")).withColumn("role", F.lit(r)) for r in ("scout", "family", "admin")]
    return seen[0].unionByName(seen[1]).unionByName(seen[2])


@query
def visible_contributions(s: SparkSession, d: str) -> DataFrame:
    sent = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("created_by"), F.pmod("o_orderkey", F.lit(40)).alias("org_id"))
    viewers = s.createDataFrame([(1, "admin"), (2, "group_leader"), (4, "researcher"), (5, "family"), (7, "group_leader")], "user_id long, role string")
    members = table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.pmod("c_custkey", F.lit(40)).alias("org_id"))
    return governance.visible_contributions(sent, viewers, members)


@query
def cache_keys(s: SparkSession, d: str) -> DataFrame:
    """Cached paths of diseases: keys, rows replaced by fresh ones, and those that are still valid."""
    paths = testdata.mechanism_edges(s, d).groupBy("src").agg(F.array_sort(F.collect_list("id")).alias("edge_ids"), F.sum("n_records").cast("string").alias("payload"))
    keyed = lambda rows, graph: rows.select(governance.cache_key("v1", F.lit("family"), F.col("edge_ids"), graph).alias("cache_key"), F.lit("family").alias("audience"), "edge_ids", "payload", "src")
    old = keyed(paths, F.lit("old"))
    fresh = keyed(paths.where("src like '%3'").withColumn("payload", F.concat(F.lit("new "), "payload")), F.lit("new"))
    now = governance.replace_cached(old, fresh)
    valid = governance.still_valid(now, old.select("cache_key", "payload"))
    counted = now.join(valid.select("cache_key", F.lit(True).alias("valid")), "cache_key", "left")
    return counted.select(F.size("edge_ids").alias("n_edges"), "payload", F.coalesce("valid", F.lit(False)).alias("valid"), F.length("cache_key").alias("key_length")).groupBy("n_edges", "payload", "valid", "key_length").agg(F.count("*").alias("n"))


@query
def fresh_snapshots(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select("event_id", F.col("ts").alias("fetched_at"))
    return governance.fresh_snapshots(rows, "2024-01-20 00:00:00", 48.0).select("event_id")


@query
def request_errors(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    ids = F.transform(F.sequence(F.lit(1), (F.pmod("o_orderkey", F.lit(15)) + 1).cast("int")), lambda i: F.concat(F.lit("e"), F.when(i == F.pmod("o_custkey", F.lit(9)).cast("int"), F.lit(1)).otherwise(i).cast("string"), F.when(F.col("o_orderkey") % 6 == 0, F.lit("?")).otherwise("")))
    return governance.request_errors(o.select(F.col("o_orderkey").alias("id"), F.repeat(F.col("o_orderstatus"), (F.pmod("o_custkey", F.lit(4)) * 101).cast("int")).alias("query"), ids.alias("edge_ids")))


def _focus(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").where("p_partkey % 100 = 0").select(_d().alias("id"))


def _linked(s: SparkSession, d: str) -> DataFrame:
    """The connections of the stated diseases by a mechanism or an investigator, a table from its first use on."""
    return testdata.kept(s, d, "linked", lambda: connections.linked(_focus(s, d), testdata.mechanism_edges(s, d), testdata.investigator_edges(s, d), testdata.phenotype_edges(s, d), testdata.parent_edges(s, d), testdata.group_edges(s, d), testdata.nodes(s, d)), "focus")


def _found(s: SparkSession, d: str) -> DataFrame:
    """All connections of the stated diseases; those by a phenotype, pairs of diseases, are made for each query that reads them."""
    more = connections.by_phenotype(_focus(s, d), _linked(s, d), testdata.mechanism_edges(s, d), testdata.phenotype_edges(s, d), testdata.parent_edges(s, d), testdata.group_edges(s, d), testdata.nodes(s, d))
    return connections.with_reasons(_linked(s, d), testdata.nodes(s, d)).unionByName(more)


def _best(s: SparkSession, d: str) -> DataFrame:
    return connections.ranked(_linked(s, d).where("kind = 'mechanism' and supported"), 1)


@query
def plan_sections(s: SparkSession, d: str) -> DataFrame:
    m = testdata.mechanism_edges(s, d)
    return actions.plan_sections(_found(s, d), connections.qualifiers(_focus(s, d), m, testdata.parent_edges(s, d)), m)


@query
def plan_tasks(s: SparkSession, d: str) -> DataFrame:
    best, groups = _best(s, d), testdata.group_edges(s, d)
    route = connections.routes(best, testdata.parent_edges(s, d), groups, testdata.asset_edges(s, d).limit(0))
    return actions.plan_steps(best, route, groups, testdata.nodes(s, d), _focus(s, d))


@query
def outreach_drafts(s: SparkSession, d: str) -> DataFrame:
    return actions.outreach(_best(s, d), testdata.nodes(s, d))


@query
def bridge_proposals(s: SparkSession, d: str) -> DataFrame:
    e = testdata.mechanism_edges(s, d)
    ev = testdata.evidence(s, d).select(F.split("edge_id", r"\|")[1].alias("disease"), F.split("edge_id", r"\|")[2].alias("target"), F.col("source_type").alias("url"))
    out = actions.bridge_proposals(links.links(e, "src", "dst"), testdata.parent_edges(s, d), ev)
    return out.withColumn("evidence_ids", F.array_join("evidence_ids", ","))


@query
def chain_counts(s: SparkSession, d: str) -> DataFrame:
    e = testdata.mechanism_edges(s, d)
    paths = e.groupBy(F.col("src").alias("path_id")).agg(F.collect_list("id").alias("edge_ids"))  # a disease's edges
    return actions.chain_counts(paths, e, testdata.evidence(s, d).where("quantity >= 25"))


@query
def neighbourhood_edges(s: SparkSession, d: str) -> DataFrame:
    e = testdata.parent_edges(s, d).unionByName(testdata.gene_edges(s, d))
    return actions.induced(e, links.two_hop(e, _focus(s, d), testdata.nodes(s, d), ["disease", "gene"]))


@query
def proposed_new_edges(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select(_d("l_partkey").alias("src"), _d("l_suppkey", "m").alias("dst"), F.lit("disease_mechanism").alias("type"), F.concat(F.lit("https://x.org/"), _text("l_linenumber")).alias("url"))
    return actions.new_edges(rows, testdata.mechanism_edges(s, d).where("stance = 'supports'"))


@query
def contract_fields(s: SparkSession, d: str) -> DataFrame:
    own = s.createDataFrame([("part", f) for f in table(s, d, "part").columns], "table string, field string")
    return quality.field_differences(own, {"part": ["p_partkey", "p_name", "p_comment"]})


@query
def unsupported_claims(s: SparkSession, d: str) -> DataFrame:
    e = testdata.mechanism_edges(s, d)
    return quality.not_subset(e.where("stance = 'contradicts'").select("src", "dst"), e.where(links.supported()), ["src", "dst"])


@query
def reconciled_claims(s: SparkSession, d: str) -> DataFrame:
    """Claims of part names and brands, some misspelt, against diseases and genes."""
    part = table(s, d, "part")
    nodes = part.select(F.col("p_name").alias("name")).distinct().select(F.lit("disease").alias("type"), F.col("name").alias("id"), "name", F.array().cast("array<string>").alias("synonyms"))
    nodes = nodes.unionByName(part.select(F.col("p_brand").alias("name")).distinct().select(F.lit("gene").alias("type"), F.col("name").alias("id"), "name", F.array().cast("array<string>").alias("synonyms")))
    edges = part.where("p_partkey % 2 = 0").select(F.col("p_name").alias("src"), F.lit("disease_gene").alias("type"), F.col("p_brand").alias("dst"))
    claim = part.select(F.col("p_partkey").alias("claim_id"), F.when(F.col("p_partkey") % 5 == 0, F.lit("zzz unknown")).otherwise(F.upper("p_name")).alias("subject"), F.lit("disease_gene").alias("relation"), F.when(F.col("p_partkey") % 3 == 0, F.lit("qqq")).otherwise(F.col("p_brand")).alias("object"))
    return claims.reconciled(claim, nodes, edges, {"disease_gene": "gene"})


def _assets(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "funded_research_project").when(F.col("o_orderstatus") == "O", "biobank")
    return o.select(
        _d("o_orderkey", "o").alias("id"), kind.alias("kind"), F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise("https://x.org/a").alias("url"), F.lit("https://x.org/b").alias("source_url"),
        F.lit(None).cast("string").alias("status"), F.when(F.col("o_custkey") % 2 == 0, "RECRUITING").alias("recruitment_status"),
    )


@query
def assets_of_diseases(s: SparkSession, d: str) -> DataFrame:
    out = reports.assets_of(testdata.asset_edges(s, d), _assets(s, d), testdata.nodes(s, d))
    return out.withColumn("diseases", F.array_join("diseases", ","))


@query
def curated_links(s: SparkSession, d: str) -> DataFrame:
    part, o = table(s, d, "part"), table(s, d, "orders")
    none, no_ids = F.lit(None).cast("string"), F.array().cast("array<string>")
    rows = part.select(_d().alias("id"), F.lit("disease").alias("type"), none.alias("gene_id"), no_ids.alias("investigator_ids"), F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("d"), (F.col("p_partkey") - 3).cast("string"))).alias("parent_disease"))
    rows = rows.unionByName(part.select(_d(prefix="v").alias("id"), F.lit("variant").alias("type"), F.when(F.col("p_partkey") % 2 == 0, _d("p_brand", "g")).otherwise("gX").alias("gene_id"), no_ids.alias("investigator_ids"), none.alias("parent_disease")))
    rows = rows.unionByName(o.select(_d("o_orderkey", "o").alias("id"), F.lit("funding").alias("type"), none.alias("gene_id"), F.array(_d("o_custkey", "c"), F.lit("c-")).alias("investigator_ids"), none.alias("parent_disease")))
    rows = rows.unionByName(testdata.nodes(s, d).where("type in ('gene', 'person')").select("id", "type", none.alias("gene_id"), no_ids.alias("investigator_ids"), none.alias("parent_disease")))
    return reports.curated_links(rows)


@query
def funding_projection(s: SparkSession, d: str) -> DataFrame:
    awards = testdata.awards(s, d).withColumn("agency", F.when(F.col("application") % 3 == 0, "NSF").otherwise("NIH")).withColumnRenamed("institute", "code")
    out = reports.funding_projection(awards)
    return out.withColumn("members", F.md5(F.array_join("members", ",").cast("binary")))


@query
def funding_errors(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    key = _text("o_orderkey")
    awards = o.select(
        _d("o_orderkey", "o").alias("asset"), F.when(F.col("o_orderkey") % 31 == 0, F.lit("x")).otherwise(key).alias("application"), F.col("o_orderpriority").alias("name"), _text("o_custkey").alias("project"), F.year("o_orderdate").alias("fiscal_year"),
        F.concat(F.lit("https://reporter.nih.gov/project-details/"), F.when(F.col("o_orderkey") % 29 == 0, F.lit("0")).otherwise(key)).alias("url"), F.lit('[{"code":"A"}]').alias("funder"),
    )
    sources = o.where("o_orderkey % 23 != 0").select(
        key.alias("application"), F.when(F.col("o_orderkey") % 19 == 0, F.lit("other")).otherwise(F.col("o_orderpriority")).alias("title"), _text("o_custkey").alias("project"), (F.year("o_orderdate") + (F.col("o_orderkey") % 17 == 0).cast("int")).alias("fiscal_year"),
        F.when(F.col("o_orderkey") % 13 == 0, "NSF").otherwise("NIH").alias("agency"), F.when(F.col("o_orderkey") % 11 == 0, "[]").otherwise('[{"code":"A"}]').alias("funder"),
    )
    return reports.funding_errors(awards, sources)


@query
def clusters_in_order(s: SparkSession, d: str) -> DataFrame:
    members = testdata.mechanism_clusters(s, d).select("cluster_id", F.col("node_id").alias("mechanism"))
    labels = table(s, d, "region").select(_d("r_regionkey", "r").alias("cluster_id"), F.col("r_name").alias("label"))
    groups = connections.communities(testdata.group_edges(s, d), testdata.parent_edges(s, d))
    held = reports.assets_of(testdata.asset_edges(s, d), _assets(s, d), testdata.nodes(s, d)).select(F.explode("diseases").alias("disease"), "category")
    people = links.links(testdata.investigator_edges(s, d), "dst", "src", "usable").withColumnRenamed("target", "person")
    return reports.clusters_in_order(members, testdata.mechanism_edges(s, d), groups, held, people, labels)


@query
def needs_of_diseases(s: SparkSession, d: str) -> DataFrame:
    diseases = testdata.nodes(s, d).where("type = 'disease'").select(F.col("id").alias("disease"), "name")
    groups = testdata.group_edges(s, d).where("src != 'n3' and src < 'n2'").select(F.col("dst").alias("disease"))
    held = reports.assets_of(testdata.asset_edges(s, d), _assets(s, d), testdata.nodes(s, d)).select(F.explode("diseases").alias("disease"), "category", "status")
    return reports.needs(diseases, groups, held)
