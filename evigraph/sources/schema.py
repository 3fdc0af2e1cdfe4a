"""The five tables of an evidence graph, and the contract's closed vocabularies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

NODES = "id string, type string, name string, synonyms array<string>, ext_ids map<string,string>, props map<string,string>"
EDGES = "id string, src string, dst string, type string, tier string, confidence float, stance string, status string, note string"
EVIDENCE = "id string, edge_id string, source_type string, source_url string, pmid string, snippet string, retrieved_at date"
CLUSTERS = "id string, label string, mechanism struct<effect:string,mechanism_ids:array<string>,method:string,scope:string>"
NODE_CLUSTER = "node_id string, cluster_id string"

# The contract's vocabularies.
NODE_TYPES = ("disease", "gene", "variant", "mechanism", "phenotype", "patient_group", "paper", "study", "asset", "person")
#: Edge type -> endpoint types.
EDGE_TYPES = {
    "disease_gene": ("disease", "gene"),
    "gene_variant_mechanism": ("variant", "mechanism"),
    "disease_mechanism": ("disease", "mechanism"),
    "disease_phenotype": ("disease", "phenotype"),
    "group_disease": ("patient_group", "disease"),
    "asset_disease": ("asset", "disease"),
    "study_disease": ("study", "disease"),
    "investigator_disease": ("person", "disease"),
    "shares_mechanism_with": ("disease", "disease"),
    "shares_investigator": ("disease", "disease"),
    "subgroup_of": ("disease", "disease"),
}
TIERS = ("A", "B", "C", "D")
STANCES = ("supports", "contradicts", "neutral")
STATUSES = ("verified", "unverified", "rejected")
ROLES = ("family", "group_leader", "scout", "researcher", "admin")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame
    clusters: DataFrame
    node_cluster: DataFrame
