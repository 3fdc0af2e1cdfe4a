"""Questions to suggest: three for each asker, by role and by the node in focus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The questions of a researcher, and of every other role.
RESEARCHER = ("Who else works on %s?", "Which findings contradict a shared mechanism?", "Which NIH awards fund %s research?")
OTHERS = ("Which communities share a mechanism with %s?", "What should we do this week about %s?", "Who is researching %s?")
SHORT, LONGEST = "^[A-Z0-9-]+$", 12


def short_name(name: Column, synonyms: Column) -> Column:
    """The first synonym that people would type (capitals, digits, hyphens, 12 at most), else the name."""
    return F.coalesce(F.get(F.filter(synonyms, lambda s: (F.length(s) <= LONGEST) & s.rlike(SHORT)), F.lit(0)), name)


def _small(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def broadest(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """gene, disease: the disease of each gene with the most edges, then by name and id. A loop counts once."""
    own = edges.where("type = 'disease_gene' and stance = 'supports'").select(F.col("dst").alias("gene"), F.col("src").alias("disease")).distinct()
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("disease")).join(own.select("disease").distinct(), "disease", "left_semi")
    degree = ends.groupBy("disease").agg(F.count("*").alias("n"))
    named = own.join(degree, "disease").join(nodes.select(F.col("id").alias("disease"), "name"), "disease")
    return named.groupBy("gene").agg(F.min(F.struct((-F.col("n")).alias("less"), "name", "disease")).alias("b")).select("gene", "b.disease")


def suggested(asked: DataFrame, nodes: DataFrame, edges: DataFrame, memberships: DataFrame, clusters: DataFrame, default_disease: str, default_gene: str) -> DataFrame:
    """asker, place, question. asked: asker, role, focus (null or unknown: none); nodes: id, type, name, synonyms; memberships: node_id, cluster_id; clusters: id, label.

    The disease is the focus, or the broadest one of a gene in focus, else the default, else the first by id. A researcher is
    asked about the mechanism in focus, else the label of the disease's first cluster (without one: of the first cluster),
    and about the gene in focus, else the disease's first by edge id. Null names read as the id; a null role is another role.
    """
    diseases = nodes.where("type = 'disease'")
    default = diseases.agg(F.min(F.struct((F.col("id") != default_disease).alias("other"), "id")).alias("d")).select(F.col("d.id").alias("default_id"))
    first = clusters.agg(F.min(F.struct("id", "label")).alias("c")).select(F.col("c.label").alias("first_label"))
    name = F.coalesce("name", "id")
    focus = nodes.select(F.col("id").alias("focus"), F.col("type").alias("focus_type"), name.alias("focus_name"))
    held = memberships.groupBy(F.col("node_id").alias("disease")).agg(F.min("cluster_id").alias("cluster_id"))
    label = held.join(clusters.select(F.col("id").alias("cluster_id"), "label"), "cluster_id").select("disease", "label")
    gene = edges.where("type = 'disease_gene'").groupBy(F.col("src").alias("disease")).agg(F.min_by("dst", "id").alias("id"))
    gene = gene.join(nodes.select("id", name.alias("gene_name")), "id").select("disease", "gene_name")
    facts = diseases.select(F.col("id").alias("disease"), short_name(name, F.col("synonyms")).alias("short")).join(label, "disease", "left").join(gene, "disease", "left")

    rows = asked.select("asker", "role", "focus").join(focus, "focus", "left").join(broadest(edges, nodes).select(F.col("gene").alias("focus"), F.col("disease").alias("of_gene")), "focus", "left")
    rows = rows.crossJoin(F.broadcast(default)).crossJoin(F.broadcast(first))  # one row each
    is_a = lambda kind: F.coalesce(F.col("focus_type") == kind, F.lit(False))
    rows = rows.withColumn("disease", F.when(is_a("disease"), F.col("focus")).otherwise(F.coalesce(F.when(is_a("gene"), F.col("of_gene")), "default_id"))).join(facts, "disease", "left")
    cluster = F.coalesce("label", "first_label")
    without_colon = F.concat(F.substring_index(cluster, ":", 1), F.when(F.instr(cluster, ":") > 0, F.substr(cluster, F.instr(cluster, ":") + 1)).otherwise(""))
    mechanism = F.when(is_a("mechanism"), _small(F.col("focus_name"))).otherwise(F.coalesce(_small(without_colon), F.lit("this mechanism")))
    about = F.when(is_a("gene"), F.col("focus_name")).otherwise(F.coalesce("gene_name", F.lit(default_gene)))
    short = F.coalesce("short", F.lit("our condition"))
    says = lambda texts, *names: F.array(*[F.format_string(q, n) if "%s" in q else F.lit(q) for q, n in zip(texts, names, strict=True)])
    questions = F.when(F.col("role") == "researcher", says(RESEARCHER, mechanism, mechanism, about)).otherwise(says(OTHERS, short, short, short))
    return rows.select("asker", F.posexplode(questions).alias("place", "question"))
