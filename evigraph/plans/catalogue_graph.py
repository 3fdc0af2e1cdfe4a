"""Registered queries on communities, explained paths, contradictions, routes' shortest paths and names in claims. SQL is in oracle_graph.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import communities, links, paths, reconcile
from ..sources import ontology, testdata
from ..sources.testdata import table
from ..streaming import limits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _d(number: Column) -> Column:
    return F.concat(F.lit("d"), number.cast("string"))


def _stated(s: SparkSession, d: str) -> DataFrame:
    """The stated query set: parts whose number is divisible by 100, against all."""
    return table(s, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("number"), _d(F.col("p_partkey")).alias("disease"))


@query
def disease_communities(s: SparkSession, d: str) -> DataFrame:
    """The community of every disease, by shared mechanisms and phenotypes, with its label and the mechanisms that all its diseases share."""
    mech = links.links(testdata.mechanism_edges(s, d), "src", "dst")
    weights = links.weights(mech, links.links(testdata.phenotype_edges(s, d), "src", "dst"))
    nodes = testdata.nodes(s, d)
    members = communities.louvain(weights.select("a", "b", "weight"), nodes.where("type = 'disease'").select(F.col("id").alias("node_id")))
    said = communities.clusters(members, mech, nodes.where("type IN ('disease', 'mechanism')").select("id", "name"))
    said = said.withColumn("shared_mechanisms", F.array_join("shared_mechanisms", ", "))
    return members.join(said, members["community"] == said["cluster_id"]).select("node_id", "cluster_id", "n_diseases", "label", "shared_mechanisms")


def _cited_records(s: SparkSession, d: str) -> DataFrame:
    """id, edge_id, snippet, source_url of all source records; some have no snippet, some no web address."""
    r = testdata.records(s, d)
    edge = F.concat_ws("|", F.lit("disease_mechanism"), "disease", "mechanism", "stance")
    snippet = F.when(F.col("quantity").cast("int") % 7 == 0, " ").otherwise(F.concat(F.lit("Quantity "), F.col("quantity").cast("int").cast("string")))
    url = F.when(F.col("order_key") % 5 == 0, "ftp://x.org").otherwise(F.concat(F.lit("https://x.org/"), F.col("order_key").cast("string")))
    return r.select(F.concat_ws("-", F.col("order_key").cast("string"), F.col("line").cast("string")).alias("id"), edge.alias("edge_id"), snippet.alias("snippet"), url.alias("source_url"))


def _edges(s: SparkSession, d: str) -> DataFrame:
    return testdata.mechanism_edges(s, d).withColumn("note", F.lit(None).cast("string"))


def _paths(s: SparkSession, d: str) -> DataFrame:
    """From each stated disease over each of its edges, whatever their stance, to the first other disease of the mechanism; beside the next disease's first edge; and nowhere."""
    e = testdata.mechanism_edges(s, d)
    stated = _stated(s, d)
    mine = e.join(stated.select(F.col("disease").alias("src")), "src", "left_semi").select(F.col("src").alias("a"), "dst", F.col("id").alias("x"))
    there = e.where("stance = 'supports'").select(F.col("src").alias("b"), "dst", F.col("id").alias("y"))
    across = mine.join(there, "dst").where("a != b").groupBy("x").agg(F.min("y").alias("y"))
    sound = e.where("stance = 'supports' AND status = 'verified' AND tier = 'A'").groupBy("src").agg(F.min("id").alias("first"))
    after = stated.select("disease", _d(F.col("number") + 1).alias("next"))
    beside = after.join(sound.select(F.col("src").alias("disease"), F.col("first").alias("x")), "disease").join(sound.select(F.col("src").alias("next"), F.col("first").alias("y")), "next").select("x", "y")
    both = across.unionByName(beside).distinct().select(F.concat_ws("~", "x", "y").alias("path_id"), F.array("x", "y").alias("edge_ids"))
    return both.unionByName(stated.select(F.concat(F.lit("empty "), "disease").alias("path_id"), F.array().cast("array<string>").alias("edge_ids")))


def _explained(s: SparkSession, d: str) -> DataFrame:
    return paths.explained(_paths(s, d), _edges(s, d), testdata.nodes(s, d).where("type IN ('disease', 'mechanism')"), _cited_records(s, d))


@query
def explained_paths(s: SparkSession, d: str) -> DataFrame:
    out = _explained(s, d)
    ids = F.array_join(F.flatten("sentences.evidence_ids"), ",")
    return out.select("path_id", "status", "reason", F.array_join("sentences.text", " ").alias("text"), F.array_join("sentences.kind", ",").alias("kinds"), ids.alias("evidence_ids"))


@query
def contradicted_paths(s: SparkSession, d: str) -> DataFrame:
    out = paths.path_contradictions(_explained(s, d), _edges(s, d), _cited_records(s, d))
    return out.select("path_id", "edge_id", F.array_join("evidence_ids", ",").alias("evidence_ids"))


@query
def path_steps(s: SparkSession, d: str) -> DataFrame:
    cited = _cited_records(s, d).where("snippet != ' '")
    return paths.step_sentences(_paths(s, d), _edges(s, d), testdata.nodes(s, d).where("type IN ('disease', 'mechanism')"), cited)


@query
def contradiction_context(s: SparkSession, d: str) -> DataFrame:
    """For the edges of the stated diseases, and the links inferred between these, the contradicting edges beside them among all edges."""
    e = testdata.mechanism_edges(s, d)
    mine = e.join(_stated(s, d).select(F.col("disease").alias("src")), "src", "left_semi")
    made = links.inferred(mine, testdata.parent_edges(s, d), "src", "dst")
    made = made.select(
        F.concat_ws("|", F.lit("shares_mechanism_with"), "a", "b", "via_id").alias("id"), F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("shares_mechanism_with").alias("type"), F.lit("supports").alias("stance"), F.array("edge_a", "edge_b").alias("derived_from")
    )
    every = e.select("id", "src", "dst", "type", "stance", F.lit(None).cast("array<string>").alias("derived_from")).unionByName(made)
    return paths.contradictions_beside(mine.select("id").unionByName(made.select("id")), every)


@query
def shortest_routes(s: SparkSession, d: str) -> DataFrame:
    """From each stated disease to the next one, along the sound edges of both and of two diseases between them."""
    stated = _stated(s, d)
    sound = testdata.mechanism_edges(s, d).where("stance = 'supports' AND status = 'verified' AND tier = 'A'").select("id", "src", "dst")
    routes = stated.select(F.col("number").alias("route_id"), F.col("disease").alias("start"), _d(F.col("number") + 100).alias("goal"))
    own = routes.select("route_id", F.explode(F.array("start", "goal", _d(F.col("route_id") + 1), _d(F.col("route_id") + 2))).alias("src")).join(sound, "src")
    place = F.row_number().over(Window.partitionBy("route_id").orderBy("id"))  # a route's few edges
    out = paths.shortest_routes(routes, own.select("route_id", place.cast("long").alias("step"), F.col("src").alias("subject"), F.col("dst").alias("object")))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ">").alias(c)
    return out.select("route_id", join("nodes"), join("steps"), join("reversed"))


@query
def reconciled_names(s: SparkSession, d: str) -> DataFrame:
    """Claims of each part's name and brand, some misspelt from their first letter on, against all diseases and genes."""
    part = table(s, d, "part")
    named = lambda kind, c: part.groupBy(F.col(c).alias("name")).agg(F.min("p_partkey").alias("n")).select(F.concat(F.lit(kind[0]), F.col("n").cast("string")).alias("id"), F.lit(kind).alias("type"), "name")
    nodes = named("disease", "p_name").unionByName(named("gene", "p_brand")).withColumn("synonyms", F.array(F.concat(F.lit("old "), "name")))
    ids = nodes.select("id", "type", "name")
    of = lambda kind, end: ids.where(F.col("type") == kind).select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
    edges = part.where("p_partkey % 2 = 0").select(F.col("p_name").alias("src_name"), F.col("p_brand").alias("dst_name")).distinct()
    edges = edges.join(of("disease", "src"), "src_name").join(of("gene", "dst"), "dst_name").select("src", "dst", F.lit("disease_gene").alias("type"))
    wrong = lambda c: F.concat(F.lit("x"), F.substring(c, 2, 100))
    claim = part.select(
        F.col("p_partkey").alias("claim_id"), F.when(F.col("p_partkey") % 3 == 0, wrong("p_name")).when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("zz "), F.reverse("p_name"))).otherwise(F.upper("p_name")).alias("subject"),
        F.lit("disease_gene").alias("relation"), F.when(F.col("p_partkey") % 5 == 0, wrong("p_brand")).otherwise(F.col("p_brand")).alias("object"),
    )
    out = reconcile.reconciled(claim, nodes, edges, {"disease_gene": "gene"})
    said = F.transform("candidates", lambda c: F.concat_ws(":", c["node_id"], F.round(c["ratio"], 4).cast("string")))
    return out.withColumn("candidates", F.array_join(said, ","))


def _responses(s: SparkSession, d: str) -> DataFrame:
    """A response for each part: some with another term, an obsolete one, or two; names of several scopes, statements of identity and others."""
    p = F.col("p_partkey")
    id_ = F.concat(F.lit("M:"), p.cast("string"))
    scoped = lambda name, scope: F.struct(name.alias("name"), F.lit(scope).alias("scope"))
    xref = lambda db, value, told: F.struct(F.lit(db).alias("database"), value.cast("string").alias("id"), told.alias("description"))
    told = F.when(p % 2 == 0, ontology.EQUIVALENT).otherwise("MONDO:relatedTo")
    term = F.struct(
        F.when(p % 11 == 0, "M:other").otherwise(id_).alias("obo_id"), F.col("p_name").alias("label"), (p % 13 == 0).alias("is_obsolete"), F.when(p % 26 == 0, "M:1").alias("term_replaced_by"),
        F.array(F.col("p_type"), F.col("p_name")).alias("description"), F.array("p_name", "p_brand", "p_type").alias("synonyms"), F.array(xref("OMIM", F.col("p_size"), told), xref("ICD", p, F.lit(ontology.EQUIVALENT)), xref("Orphanet", p, F.lit(ontology.EQUIVALENT))).alias("obo_xref"),
        F.array(scoped(F.col("p_name"), ontology.EXACT), scoped(F.concat(F.lit("x "), "p_name"), ontology.EXACT), scoped(F.col("p_brand"), "hasRelatedSynonym")).alias("obo_synonym"),
    )
    return table(s, d, "part").select(_d(p).alias("node_id"), id_.alias("id"), F.when(p % 17 == 0, F.array(term, term)).otherwise(F.array(term)).alias("terms"))


@query
def ontology_diseases(s: SparkSession, d: str) -> DataFrame:
    r = _responses(s, d)
    out = ontology.disease_nodes(r.select("node_id", "id"), r.select("id", "terms"))
    others = F.array_join(F.transform("other_names", lambda o: F.concat_ws("/", o["name"], o["scope"])), ",")
    ids = F.array_join(F.transform(F.array_sort(F.map_entries("ext_ids")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.select("node_id", "name", F.array_join("synonyms", ",").alias("synonyms"), others.alias("other_names"), ids.alias("ext_ids"), "description", "error")


@query
def ontology_lookup(s: SparkSession, d: str) -> DataFrame:
    r = _responses(s, d)
    return ontology.annotation_lookup(ontology.disease_nodes(r.select("node_id", "id"), r.select("id", "terms")))


@query
def cache_hits(s: SparkSession, d: str) -> DataFrame:
    """Each user's events as requests to a cache of three entries that are good for a day."""
    e = table(s, d, "events").select("event_id", F.col("user_id").alias("cache"), F.col("event_type").alias("key"), "ts")
    return limits.ttl_cache(e, 86_400.0, 3)
