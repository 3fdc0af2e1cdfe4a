"""The registered queries: each applies an operator to whole tables. SQL for the same rows is in oracle.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import claims, connections, governance, links, quality, reports, search
from ..sources import files, testdata
from ..sources.scratch import written
from ..sources.testdata import table
from ..streaming import limits
from . import catalogue_build, catalogue_graph, catalogue_model, catalogue_plan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
VISIBLE = ["disease", "mechanism", "gene", "patient_group"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def shared_mechanism_pairs(s: SparkSession, d: str) -> DataFrame:
    return links.pair_counts(links.links(testdata.mechanism_edges(s, d), "src", "dst"))


@query
def live_edges(s: SparkSession, d: str) -> DataFrame:
    return testdata.edges(s, d).where(links.live())


@query
def supported_edges(s: SparkSession, d: str) -> DataFrame:
    return testdata.edges(s, d).where(links.supported()).select("id", "src", "dst", "type", "tier")


@query
def graph_view_types(s: SparkSession, d: str) -> DataFrame:
    return links.view(testdata.edges(s, d), testdata.nodes(s, d), VISIBLE).select("id", "src", "dst")


@query
def semantic_edge_merge(s: SparkSession, d: str) -> DataFrame:
    return testdata.mechanism_edges(s, d)


@query
def edge_evidence_nested_counts(s: SparkSession, d: str) -> DataFrame:
    own = testdata.evidence(s, d).groupBy(F.col("edge_id").alias("id")).agg(F.count("*").alias("n_evidence"), F.max("retrieved_at").cast("string").alias("newest"))
    return testdata.edges(s, d).select("id").join(own, "id", "left").na.fill(0, ["n_evidence"])


@query
def edges_without_evidence(s: SparkSession, d: str) -> DataFrame:
    return quality.without_evidence(testdata.edges(s, d), testdata.evidence(s, d)).select("id", "type")


@query
def node_degree_centrality(s: SparkSession, d: str) -> DataFrame:
    return links.centrality(testdata.edges(s, d))


@query
def link_sets(s: SparkSession, d: str) -> DataFrame:
    mech = links.links(testdata.mechanism_edges(s, d), "src", "dst").withColumn("kind", F.lit("mechanism"))
    people = links.links(testdata.investigator_edges(s, d), "dst", "src").withColumn("kind", F.lit("person"))
    sets = mech.unionByName(people).groupBy("disease", "kind").agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("targets"), F.count("*").alias("n"))
    return sets  # a disease's own links


@query
def shared_investigator_pairs(s: SparkSession, d: str) -> DataFrame:
    return links.pair_counts(links.links(testdata.investigator_edges(s, d), "dst", "src"))


@query
def bridge_jaccard(s: SparkSession, d: str) -> DataFrame:
    return links.jaccard(links.links(testdata.mechanism_edges(s, d), "src", "dst"), testdata.parent_edges(s, d))


@query
def inferred_links_per_mechanism(s: SparkSession, d: str) -> DataFrame:
    return links.inferred(testdata.mechanism_edges(s, d), testdata.parent_edges(s, d), "src", "dst")


@query
def inferred_links_per_person(s: SparkSession, d: str) -> DataFrame:
    return links.inferred(testdata.investigator_edges(s, d), testdata.parent_edges(s, d), "dst", "src")


@query
def cluster_weights(s: SparkSession, d: str) -> DataFrame:
    return links.weights(links.links(testdata.mechanism_edges(s, d), "src", "dst"), links.links(testdata.phenotype_edges(s, d), "src", "dst"))


def _memberships(s: SparkSession, d: str) -> DataFrame:
    targets = [(testdata.gene_edges(s, d), "src", "dst"), (testdata.phenotype_edges(s, d), "src", "dst"), (testdata.group_edges(s, d), "dst", "src"), (testdata.asset_edges(s, d), "dst", "src"), (testdata.investigator_edges(s, d), "dst", "src")]
    return links.memberships(testdata.mechanism_clusters(s, d), testdata.mechanism_edges(s, d), testdata.parent_edges(s, d), targets)


@query
def membership_propagation(s: SparkSession, d: str) -> DataFrame:
    return _memberships(s, d)


@query
def bridge_flag_edges(s: SparkSession, d: str) -> DataFrame:
    return links.bridge_flags(testdata.mechanism_edges(s, d), _memberships(s, d)).select("id", "bridge")


@query
def shared_phenotypes_informative(s: SparkSession, d: str) -> DataFrame:
    return connections.informative(testdata.phenotype_edges(s, d))


def _focus(s: SparkSession, d: str) -> DataFrame:
    """The stated query set: diseases whose number is divisible by 100, against all."""
    return table(s, d, "part").where("p_partkey % 100 = 0").select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("id"))


def _tables(s: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return testdata.mechanism_edges(s, d), testdata.investigator_edges(s, d), testdata.phenotype_edges(s, d), testdata.parent_edges(s, d), testdata.group_edges(s, d), testdata.nodes(s, d)


_linked = catalogue_model._linked


def _connections(s: SparkSession, d: str) -> DataFrame:
    return catalogue_model._found(s, d)


@query
def qualifiers_per_focus(s: SparkSession, d: str) -> DataFrame:
    return connections.qualifiers(_focus(s, d), testdata.mechanism_edges(s, d), testdata.parent_edges(s, d))


@query
def shared_phenotypes_of_focus(s: SparkSession, d: str) -> DataFrame:
    return connections.shared_phenotypes(_focus(s, d), testdata.phenotype_edges(s, d))


@query
def communities_with_parent(s: SparkSession, d: str) -> DataFrame:
    return connections.communities(testdata.group_edges(s, d), testdata.parent_edges(s, d))


@query
def connections_all(s: SparkSession, d: str) -> DataFrame:
    return _connections(s, d).drop("member", "edge_a", "edge_b")


@query
def connections_ranked(s: SparkSession, d: str) -> DataFrame:
    """A top-k report: the first 40 connections of each focus."""
    m, _, p, up, groups, nodes = _tables(s, d)
    way = _linked(s, d)
    found = way.unionByName(connections.by_phenotype(connections.lacking(_focus(s, d), way, 40), way, m, p, up, groups, nodes).drop("reason"))
    return connections.ranked(found, 40).select("focus", "candidate", "kind", "supported", "n_qualifiers", "n_phenotypes", "rank")


@query
def route_edges(s: SparkSession, d: str) -> DataFrame:
    held = testdata.asset_edges(s, d).join(testdata.awards(s, d).where("institute like '1-%'").select(F.col("asset").alias("src")), "src", "left_semi")
    return connections.routes(_linked(s, d), testdata.parent_edges(s, d), testdata.group_edges(s, d), held)


@query
def no_route_reasons(s: SparkSession, d: str) -> DataFrame:
    """Over verified mechanisms of tier A and no investigators, so that some focuses have no route."""
    m, people, p, up, groups, nodes = _tables(s, d)
    few, focus = m.where("tier = 'A' and n_records > 1 and src like '%5'"), _focus(s, d)
    way = written(connections.linked(focus, few, people.limit(0), p, up, groups, nodes).select("focus", "candidate", "kind", "n_phenotypes"), "few-linked")
    broad = connections.phenotype_counts(focus, way, p, up, nodes).select("focus", F.lit("phenotype").alias("kind"))
    return connections.no_route(focus, way.select("focus", "kind").unionByName(broad), few, p, nodes)


@query
def two_hop_neighbourhood(s: SparkSession, d: str) -> DataFrame:
    return links.two_hop(testdata.mechanism_edges(s, d).unionByName(testdata.parent_edges(s, d)), _focus(s, d), testdata.nodes(s, d), VISIBLE)


@query
def explain_path(s: SparkSession, d: str) -> DataFrame:
    """Paths of two edges from the stated diseases over each supported mechanism to every other disease."""
    use = testdata.mechanism_edges(s, d).where(links.supported("usable"))
    mine = use.join(_focus(s, d).withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("a"), "dst", F.col("id").alias("edge_a"))
    pairs = mine.join(use.select(F.col("src").alias("b"), "dst", F.col("id").alias("edge_b")), "dst").where("a != b")
    paths = pairs.select(F.concat_ws("~", "edge_a", "edge_b").alias("path_id"), F.array("edge_a", "edge_b").alias("edge_ids"))
    cited = testdata.evidence(s, d).where("quantity >= 5")
    return connections.explain_paths(paths, testdata.mechanism_edges(s, d), cited)


@query
def assets_for_disease(s: SparkSession, d: str) -> DataFrame:
    own = testdata.asset_edges(s, d).where(links.supported("usable"))
    return own.groupBy(F.col("src").alias("asset")).agg(F.min("id").alias("first_edge"), F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("diseases"))  # an asset's few diseases


@query
def funding_groups(s: SparkSession, d: str) -> DataFrame:
    return reports.funding_groups(testdata.awards(s, d))


@query
def funding_money_by_condition(s: SparkSession, d: str) -> DataFrame:
    return reports.money_by_condition(testdata.awards(s, d), testdata.asset_edges(s, d))


@query
def funding_top_other(s: SparkSession, d: str) -> DataFrame:
    totals = testdata.awards(s, d).groupBy("fiscal_year", "institute").agg(F.count("*").alias("n"))
    totals = totals.select(F.concat_ws(" ", "institute", F.col("fiscal_year").cast("string")).alias("funder"), "n")
    return reports.top_with_other(totals, "funder", "n")


@query
def funding_gaps(s: SparkSession, d: str) -> DataFrame:
    return reports.funding_gaps(testdata.nodes(s, d).where("type = 'disease'").select("id"), testdata.asset_edges(s, d))


@query
def duplicate_signals(s: SparkSession, d: str) -> DataFrame:
    own = testdata.asset_edges(s, d).where(links.supported("usable")).select(F.col("src").alias("asset"), F.col("dst").alias("disease"))
    kinds = testdata.awards(s, d).select("asset", F.col("institute").alias("category"))
    member = _memberships(s, d).select(F.col("node_id").alias("disease"), "cluster_id")
    genes = testdata.gene_edges(s, d).select(F.col("src").alias("disease"), F.col("dst").alias("gene"))
    return reports.duplicate_signals(own.join(kinds, "asset").join(member, "disease"), genes)


@query
def ranked_clusters(s: SparkSession, d: str) -> DataFrame:
    return reports.ranked_clusters(_memberships(s, d), testdata.nodes(s, d))


@query
def mechanism_index(s: SparkSession, d: str) -> DataFrame:
    return reports.mechanism_index(testdata.mechanism_edges(s, d))


@query
def investigators_ranked(s: SparkSession, d: str) -> DataFrame:
    return reports.investigators(testdata.investigator_edges(s, d), testdata.awards(s, d), _memberships(s, d))


@query
def evidence_by_source(s: SparkSession, d: str) -> DataFrame:
    return testdata.evidence(s, d).groupBy("source_type").agg(F.count("*").alias("n"), F.count_distinct("edge_id").alias("n_edges"))


@query
def coverage_counts(s: SparkSession, d: str) -> DataFrame:
    return reports.coverage_counts(testdata.nodes(s, d), testdata.edges(s, d), testdata.evidence(s, d))


@query
def coverage_report(s: SparkSession, d: str) -> DataFrame:
    asked = s.createDataFrame([("GERMANY",), ("Supplier#000000001",), ("  economy ",), ("no such thing",), ("BRAND#1",)], "query string")
    return reports.coverage_report(asked, testdata.nodes(s, d), testdata.edges(s, d), testdata.evidence(s, d))


def _searchable(s: SparkSession, d: str) -> DataFrame:
    own = table(s, d, "part").select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("id"), F.array("p_brand").alias("synonyms"), F.array("p_type").alias("related"), F.array(F.struct(F.lit("PART").alias("namespace"), F.col("p_partkey").cast("string").alias("value"))).alias("ids"))
    none = F.array().cast("array<string>")
    nodes = testdata.nodes(s, d).join(own, "id", "left").join(links.centrality(testdata.edges(s, d)).select(F.col("node_id").alias("id"), "centrality"), "id", "left")
    return nodes.select("id", "type", "name", F.coalesce("synonyms", none).alias("synonyms"), F.coalesce("related", none).alias("related"), F.coalesce("ids", F.array().cast("array<struct<namespace:string,value:string>>")).alias("ids"), F.coalesce("centrality", F.lit(0.0)).alias("centrality"))


def _questions(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("Brand#13",), ("blue",), ("ECONOMY",), ("17",), ("part:23",), ("Part 24",), ("  ",), ("no such thing",), ("br",)], "q string")


@query
def search_scored(s: SparkSession, d: str) -> DataFrame:
    """A top-k report: the first 20 nodes of each question."""
    return search.search(_questions(s), _searchable(s, d)).drop("resolved_from")


@query
def search_genes_resolved(s: SparkSession, d: str) -> DataFrame:
    return search.search(_questions(s), _searchable(s, d), testdata.gene_edges(s, d), ["disease"]).drop("score")


@query
def search_no_match(s: SparkSession, d: str) -> DataFrame:
    return search.no_match(_questions(s), search.search(_questions(s), _searchable(s, d)))


@query
def quote_containment(s: SparkSession, d: str) -> DataFrame:
    asked = table(s, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    short = table(s, d, "benchmark").where("item_id % 10 = 0").select((-F.col("item_id")).alias("item_id"), F.substring(text.spaced(F.col("text")), 3, 14).alias("quote"))
    return claims.contained_quotes(asked.unionByName(short), table(s, d, "documents").select("doc_id", F.col("text").alias("body")))


@query
def prf_levels(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "lang", "source", (F.col("n_chars") > 400).cast("int").alias("quality"))
    gold = table(s, d, "labels").select("doc_id", "quality").join(docs.drop("quality"), "doc_id")
    found = docs.join(table(s, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return quality.match_levels(gold, found, {"exact": ["doc_id", "quality"], "source": ["source", "quality"], "label": ["quality"]})


@query
def contract_violations(s: SparkSession, d: str) -> DataFrame:
    edges = testdata.mechanism_edges(s, d).unionByName(testdata.parent_edges(s, d))
    return quality.violations(testdata.nodes(s, d), edges, testdata.evidence(s, d))


@query
def duplicate_keys(s: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_keys(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def dangling_endpoints(s: SparkSession, d: str) -> DataFrame:
    return quality.dangling(testdata.edges(s, d), testdata.nodes(s, d).where("type != 'mechanism' or id < 'm5'"))


@query
def visible_edges_by_role(s: SparkSession, d: str) -> DataFrame:
    edges = testdata.edges(s, d)
    of = lambda role: governance.visible_edges(edges, role).groupBy("type").agg(F.count("*").alias("n")).withColumn("role", F.lit(role))
    return of("admin").unionByName(of("family"))


@query
def visible_evidence_counts(s: SparkSession, d: str) -> DataFrame:
    seen = governance.visible_evidence(testdata.evidence(s, d), testdata.mechanism_edges(s, d), "researcher")
    return seen.groupBy("source_type").agg(F.count("*").alias("n"))


@query
def cache_rows_visible(s: SparkSession, d: str) -> DataFrame:
    edges = testdata.mechanism_edges(s, d)
    cache = edges.groupBy(F.col("src").alias("cache_key")).agg(F.collect_set("id").alias("edge_ids")).withColumn("audience", F.lit("family"))  # a disease's edges
    return governance.visible_cache(cache, edges, "family").select("cache_key", F.size("edge_ids").alias("n_edges"))


@query
def contribution_review_view(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    sent = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.lit("d1").alias("dst"))
    decision = F.when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected")
    note = F.when(F.col("o_orderstatus") == "O", " ").otherwise("no source")
    return governance.contributions(sent, o.where("o_orderkey % 3 != 0").select(F.col("o_orderkey").alias("id"), decision.alias("decision"), note.alias("note"), F.col("o_orderdate").alias("at")))


@query
def review_queue(s: SparkSession, d: str) -> DataFrame:
    edges = testdata.mechanism_edges(s, d)
    decisions = edges.where("tier = 'D'").select(F.col("id").alias("edge_id"), F.when(F.col("stance") == "supports", "approved").otherwise("rejected").alias("decision"))
    return governance.review_queue(edges, decisions).select("id", "tier", "decision")


@query
def snapshot_diff(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderkey", "o_orderpriority")
    before = o.where("o_orderkey % 5 != 0")
    after = o.where("o_orderkey % 7 != 0").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 11 == 0, "changed").otherwise(F.col("o_orderpriority")))
    return quality.snapshot_diff(before, after, "o_orderkey", "o_orderpriority")


@query
def additive_only(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber")
    return quality.not_additive(rows, rows.where("l_linenumber != 7").unionByName(rows.where("l_linenumber = 1")))


@query
def upsert_antijoin(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    new = c.where("c_custkey % 4 = 0").select((F.col("c_custkey") + 100).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"))
    return files.upsert(c, new, ["c_custkey"])


@query
def sha256_records(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("sha256"), F.length("html").alias("n_chars"))


@query
def intent_classification(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").select("conv_id", "turn", text.intent(F.col("text")).alias("intent"))


@query
def gene_like_tokens(s: SparkSession, d: str) -> DataFrame:
    found = table(s, d, "documents").select("doc_id", F.explode(text.gene_like(F.col("text"))).alias("token"))
    return found.distinct()


@query
def session_valid(s: SparkSession, d: str) -> DataFrame:
    last = table(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("started_at"))
    newest = last.agg(F.max("started_at").alias("newest"))
    alive = F.col("started_at") + F.expr("interval 1 day") > F.col("newest")
    return last.crossJoin(F.broadcast(newest)).where(alive).select("user_id")  # one row


@query
def rate_limit_accept(s: SparkSession, d: str) -> DataFrame:
    done = limits.rate_limit(table(s, d, "events"), seconds=3600.0)
    return done.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("accepted").alias("n_accepted"))


@query
def attempt_window(s: SparkSession, d: str) -> DataFrame:
    return limits.attempt_window(table(s, d, "events"), seconds=86_400.0, most=3).where("not accepted").select("event_id", "user_id")


@query
def visible_text_lengths(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", F.length(text.visible_text("html")).alias("n_chars"))


@query
def nfkd_search(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", text.fold("p_name").alias("folded"))


@query
def difflib_topk(s: SparkSession, d: str) -> DataFrame:
    """For each stated phrase the five names most like it; equal names count once."""
    names = table(s, d, "part").select(F.col("p_name").alias("name")).distinct()
    best = lambda phrase: names.select(F.lit(phrase).alias("phrase"), "name", text.similarity(F.lit(phrase), "name").alias("ratio")).orderBy(F.desc("ratio"), "name").limit(5)
    return best("blue green metal").unionByName(best("small plated brass"))


@query
def routes(s: SparkSession, d: str) -> DataFrame:
    """For each pair of diseases that share a mechanism, the first one (verified support on both sides)."""
    shared = links.shared_pairs(links.links(testdata.mechanism_edges(s, d), "src", "dst"))
    return shared.groupBy("a", "b").agg(F.min("target").alias("mechanism"))


@query
def name_matches(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part")
    nodes = part.select(F.col("p_partkey").alias("id"), F.lit("disease").alias("type"), F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("synonyms"))
    mentions = part.select(F.lit("disease").alias("type"), F.col("p_type").alias("text")).distinct()
    return claims.match_names(mentions, nodes)


@query
def candidates_in_context(s: SparkSession, d: str) -> DataFrame:
    claimed = testdata.nodes(s, d).where("type = 'disease'").select(F.col("id").alias("subject"), F.lit("disease_mechanism").alias("relation"))
    return claims.candidates_in_context(claimed, testdata.mechanism_edges(s, d).where(links.supported()))


@query
def spotted_terms(s: SparkSession, d: str) -> DataFrame:
    """The first word and the first two words of benchmark passages, as terms in conversations' turns."""
    first = F.split("text", " ")
    terms = table(s, d, "benchmark").select(F.explode(F.array(first[0], F.array_join(F.slice(first, 1, 2), " "))).alias("term"))
    turns = table(s, d, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text")
    return claims.spot_terms(turns, terms, "key").select("key.*", "term", "at")


@query
def quote_locators(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select("doc_id", F.array_join(F.slice(F.split("text", " "), 6, 10), " ").alias("quote"), "text")
    return claims.quote_locators(rows).select("doc_id", "valid", "start", "end", "sha256")


@query
def quote_word_budget(s: SparkSession, d: str) -> DataFrame:
    return claims.quote_budget(table(s, d, "conversations"), "conv_id", "text")


@query
def funding_shares(s: SparkSession, d: str) -> DataFrame:
    cents = F.sum(F.round(F.col("total_cost") * 100).cast("long")).alias("cents")
    return claims.shares(testdata.awards(s, d).groupBy("institute").agg(cents), "institute", "cents")


QUERIES |= catalogue_model.QUERIES | catalogue_graph.QUERIES | catalogue_build.QUERIES | catalogue_plan.QUERIES
