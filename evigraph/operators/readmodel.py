"""The read model: typed nodes and edges with their evidence, clusters and ids, and the views of one node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import host, id_url, url_id
from .links import centrality, supported

# The names that source types have for readers.
SOURCES = {
    "pubmed": "PubMed", "hpo": "HPO", "clinicaltrials": "ClinicalTrials", "clinicaltrials_gov": "ClinicalTrials", "nih_reporter": "RePORTER", "reporter": "RePORTER",
    "nord": "NORD", "orphadata": "Orphanet", "orphanet": "Orphanet", "mondo": "MONDO", "patient_organization": "PatientOrg",
}


def source_name(c: Column) -> Column:
    out = F.lit("other")
    for k, v in SOURCES.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def evidence_title(kind: Column, url: Column, pmid: Column, title: Column) -> Column:
    """What a source is called, by its kind; url ids and hosts where there is nothing better."""
    named = lambda text, id_: F.concat(F.lit(text), id_)
    by = {
        "PubMed": F.coalesce(title, F.trim(F.concat(F.lit("PubMed record "), F.coalesce(pmid, F.lit(""))))),
        "HPO": F.lit("HPO phenotype annotations (phenotype.hpoa)"),
        "MONDO": F.coalesce(named("MONDO term ", url_id(url, "mondo")), F.lit("MONDO disease ontology")),
        "Orphanet": F.coalesce(named("Orphadata gene associations, ORPHA:", url_id(url, "orpha")), F.lit("Orphadata")),
        "ClinicalTrials": F.coalesce(named("ClinicalTrials.gov ", url_id(url, "nct")), F.lit("ClinicalTrials.gov record")),
        "RePORTER": F.coalesce(named("NIH RePORTER project ", url_id(url, "project")), F.lit("NIH RePORTER")),
        "PatientOrg": F.concat(F.lit("Patient organization page, "), host(url)),
    }  # fixed values
    out = F.when(F.coalesce(url, F.lit("")) != "", host(url)).otherwise("Source not yet attached")
    for k, v in by.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def evidence_view(evidence: DataFrame, titles: DataFrame) -> DataFrame:
    """edge_id, id, source, title, url, pmid, sample. evidence: id, edge_id, source_type, source_url, pmid; titles: pmid, title."""
    return _evidence(evidence, titles.select("pmid", "title"), [])


def _evidence(evidence: DataFrame, titles: DataFrame, more: list[Column]) -> DataFrame:
    sample = (F.col("source_type") == "placeholder") | (F.coalesce("source_url", F.lit("")) == "")
    kind = source_name(F.col("source_type"))
    joined = evidence.join(titles.withColumnRenamed("title", "_title"), "pmid", "left")
    title = F.when(sample, "Placeholder: no real source yet").otherwise(evidence_title(kind, F.col("source_url"), F.col("pmid"), F.col("_title")))
    return joined.select("edge_id", "id", kind.alias("source"), title.alias("title"), F.when(sample, "").otherwise(F.col("source_url")).alias("url"), "pmid", sample.alias("sample"), *more)


def evidence_records(evidence: DataFrame, titles: DataFrame, edges: DataFrame) -> DataFrame:
    """evidence_view() with date, snippet, authors and stance. evidence: also retrieved_at, snippet; titles: also authors; edges: id, stance.

    A record stands where its edge does: it contradicts, or else supports. Records without an edge are left out; a missing
    date is empty, and no authors are null.
    """
    authors = titles.select("pmid", "title", F.when(F.size("authors") > 0, F.col("authors")).alias("_authors"))
    stance = F.when(F.col("_stance") == "contradicts", "contradicts").otherwise("supports")
    of = evidence.join(edges.select(F.col("id").alias("edge_id"), F.col("stance").alias("_stance")), "edge_id")
    return _evidence(of, authors, [F.coalesce("retrieved_at", F.lit("")).alias("date"), F.col("snippet"), F.col("_authors").alias("authors"), stance.alias("stance")])


def edge_view(edges: DataFrame, nodes: DataFrame, memberships: DataFrame, decisions: DataFrame) -> DataFrame:
    """id, src, dst, relation, basis, tier, stance, status, bridge: edges of two known nodes, with decisions laid over.

    A decision gives the status; else tier D waits for one. Tier C is inferred, all others are observed.
    """
    return _edges(edges, nodes, memberships, decisions, [])


def _edges(edges: DataFrame, nodes: DataFrame, memberships: DataFrame, decisions: DataFrame, more: list[Column]) -> DataFrame:
    """Each end is looked up once, for the node and for its clusters: bridge, as of links.bridge_flags()."""
    sets = memberships.groupBy(F.col("node_id").alias("id")).agg(F.collect_set("cluster_id").alias("own"))  # a node's clusters
    ends = nodes.select("id").distinct().join(sets, "id", "left")
    known = edges.join(ends.select(F.col("id").alias("src"), F.col("own").alias("_x")), "src").join(ends.select(F.col("id").alias("dst"), F.col("own").alias("_y")), "dst")
    known = known.withColumn("_bridge", F.coalesce(~F.arrays_overlap("_x", "_y"), F.lit(False))).drop("_x", "_y")
    decided = known.join(decisions.select(F.col("edge_id").alias("id"), "decision"), "id", "left")
    status = F.when(F.col("decision") == "rejected", "rejected").when(F.col("decision") == "approved", "verified").when(F.col("tier") == "D", "pending").otherwise(F.col("status"))
    return decided.select("id", "src", "dst", F.col("type").alias("relation"), F.when(F.col("tier") == "C", "inferred").otherwise("observed").alias("basis"), "tier", "stance", status.alias("status"), *more, F.col("_bridge").alias("bridge"))


def edge_records(edges: DataFrame, nodes: DataFrame, memberships: DataFrame, decisions: DataFrame) -> DataFrame:
    """edge_view() with confidence, scope (the edge's note), derived_from (an empty array without any) and sample (by the id). edges: also confidence, note, derived_from."""
    derived = F.coalesce("derived_from", F.array().cast("array<string>")).alias("derived_from")
    more = [F.col("confidence"), F.col("note").alias("scope"), derived, F.col("id").startswith("sample_").alias("sample")]
    return _edges(edges, nodes, memberships, decisions, more)


def nested_evidence(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Edges with their evidence as an array in id order; without any, an empty one. evidence: edge_id, id and more. An edge has few records."""
    own = evidence.groupBy(F.col("edge_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in evidence.columns if c not in ("id", "edge_id")]))).alias("evidence"))
    return edges.join(own, "id", "left").withColumn("evidence", F.coalesce("evidence", F.array()))


def node_view(nodes: DataFrame, memberships: DataFrame, edges: DataFrame, added: DataFrame) -> DataFrame:
    """id, type, name, synonyms, related, ids, clusters, centrality. nodes: with kind, synonyms, ext_ids (map), terms; added: node_id, synonym.

    An asset that is a funded project is funding. Added synonyms follow those that a node has; related terms are what is
    no synonym. Empty external ids are left out; others get the URL of their namespace.
    """
    kind = F.when((F.col("type") == "asset") & (F.col("kind") == "funded_research_project"), "funding").otherwise(F.col("type"))
    more = added.groupBy(F.col("node_id").alias("id")).agg(F.array_sort(F.collect_set("synonym")).alias("more"))
    sets = memberships.groupBy(F.col("node_id").alias("id")).agg(F.array_sort(F.collect_set("cluster_id")).alias("clusters"))
    own = nodes.join(more, "id", "left").join(sets, "id", "left").join(centrality(edges).select(F.col("node_id").alias("id"), "centrality"), "id", "left")
    none = F.array().cast("array<string>")
    extra = F.array_except(F.coalesce("more", none), F.col("synonyms"))
    ids = F.transform(F.filter(F.map_entries("ext_ids"), lambda e: F.coalesce(e["value"], F.lit("")) != ""), lambda e: F.struct(e["key"].alias("namespace"), e["value"].alias("value"), id_url(e["key"], e["value"]).alias("url")))
    return own.select(
        "id", kind.alias("type"), "name", F.concat("synonyms", extra).alias("synonyms"), F.filter("terms", lambda t: t.isNotNull() & ~F.array_contains("synonyms", t)).alias("related"),
        ids.alias("ids"), F.coalesce("clusters", none).alias("clusters"), F.coalesce("centrality", F.lit(0.0)).alias("centrality"),
    )


def incident(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """node_id, relation, n, n_observed, n_inferred, n_contradicting: edges at each focus node by relation."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node_id"), "relation", "basis", "stance", "status").where("status != 'rejected'")
    return ends.join(focus.select(F.col("id").alias("node_id")), "node_id", "left_semi").groupBy("node_id", "relation").agg(
        F.count("*").alias("n"), F.count_if(F.col("basis") == "observed").alias("n_observed"), F.count_if(F.col("basis") == "inferred").alias("n_inferred"), F.count_if(F.col("stance") == "contradicts").alias("n_contradicting")
    )


def first_gene(edges: DataFrame) -> DataFrame:
    """disease, gene: each disease's first supported gene, by the edge's id."""
    own = edges.where((F.col("type") == "disease_gene") & supported("usable"))
    return own.groupBy(F.col("src").alias("disease")).agg(F.min_by("dst", "id").alias("gene"))


def diseases_of_genes(edges: DataFrame, degree: DataFrame, names: DataFrame) -> DataFrame:
    """gene, disease, degree, name: the diseases of each gene, to be ordered by degree and name. degree: node_id, degree; names: id, name."""
    own = edges.where((F.col("type") == "disease_gene") & supported("usable")).select(F.col("dst").alias("gene"), F.col("src").alias("disease")).distinct()
    own = own.join(degree.select(F.col("node_id").alias("disease"), "degree"), "disease", "left").join(names.select(F.col("id").alias("disease"), "name"), "disease")
    return own.select("gene", "disease", F.coalesce("degree", F.lit(0)).alias("degree"), "name")


def citations(edges: DataFrame, cited: DataFrame, paths: DataFrame, most: int = 4) -> DataFrame:
    """path_id, edge_ids, n_more: the first `most` edges of each path that rest on different sources, and how many follow.

    paths: path_id, edge_ids in order; cited: edge_id, url (an edge's first source). An inferred edge is a source itself.
    """
    own = edges.join(cited.select(F.col("edge_id").alias("id"), "url"), "id", "left")
    key = F.when(F.col("basis") == "inferred", F.col("id")).otherwise(F.coalesce("url", "id"))
    steps = paths.select("path_id", F.posexplode("edge_ids").alias("k", "id")).join(own.select("id", key.alias("key")), "id")
    first = steps.groupBy("path_id", "key").agg(F.min_by("id", "k").alias("id"), F.min("k").alias("k"))
    listed = first.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("k", "id"))).alias("l"))  # a path's few edges
    ids = F.transform("l", lambda x: x["id"])
    return listed.select("path_id", F.slice(ids, 1, most).alias("edge_ids"), F.greatest(F.size("l") - most, F.lit(0)).alias("n_more"))


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last by order, in the place of the first."""
    columns = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r"), F.min(order).alias("place"))
    return last.select(key, "r.*", "place")
