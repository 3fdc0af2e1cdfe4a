"""Funding, duplicate effort, ranked clusters, mechanism and investigator indexes, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .links import links, supported


def funding_groups(awards: DataFrame) -> DataFrame:
    """By institute and fiscal year: annual applications and distinct core projects. Costs are not added up here."""
    return awards.groupBy("institute", "fiscal_year").agg(F.count_distinct("application").alias("n_applications"), F.count_distinct("project").alias("n_projects"))


def money_by_condition(awards: DataFrame, asset_edges: DataFrame) -> DataFrame:
    """disease, money, n_awards: an award's cost in equal parts over its conditions, each to a millionth; none or not positive: left out."""
    pairs = asset_edges.where(supported("usable")).select(F.col("src").alias("asset"), F.col("dst").alias("disease")).distinct()
    shares = pairs.groupBy("asset").agg(F.count("*").alias("n"))
    rows = awards.where("total_cost > 0").select("asset", "total_cost").join(shares, "asset").join(pairs, "asset")
    return rows.groupBy("disease").agg((F.sum(F.round(F.col("total_cost") * 1e6 / F.col("n")).cast("long")) / 1e6).alias("money"), F.count("*").alias("n_awards"))


def top_with_other(totals: DataFrame, key: str, value: str, most: int = 8) -> DataFrame:
    """The largest most - 1 keys, and all others as one row where there are more than most."""
    top = totals.orderBy(F.desc(value), key).limit(most)  # ordered on the executors: most rows each
    ranked = top.select(key, value, F.row_number().over(Window.orderBy(F.desc(value), key)).alias("place"))  # most rows
    every = totals.agg(F.sum(value).alias("_all"), F.count("*").alias("_keys"))
    joined = ranked.crossJoin(F.broadcast(every))  # one row
    head = joined.where((F.col("_keys") <= most) | (F.col("place") < most)).select(key, value, "place")
    rest = joined.where((F.col("_keys") > most) & (F.col("place") < most)).groupBy("_keys", "_all").agg(F.sum(value).alias("_head"))
    rest = rest.select(F.concat(F.lit("Other ("), (F.col("_keys") - most + 1).cast("string"), F.lit(")")).alias(key), (F.col("_all") - F.col("_head")).alias(value), F.lit(most).alias("place"))
    return head.unionByName(rest)


def funding_gaps(diseases: DataFrame, asset_edges: DataFrame) -> DataFrame:
    return diseases.join(asset_edges.where(supported("usable")).select(F.col("dst").alias("id")), "id", "left_anti")


def duplicate_signals(members: DataFrame, genes: DataFrame) -> DataFrame:
    """cluster_id, category, n_assets, n_genes where two or more assets for two or more genes do the same in a cluster.

    members: asset, disease, category, cluster_id; genes: disease, gene.
    """
    joined = members.join(genes, "disease", "left")
    out = joined.groupBy("cluster_id", "category").agg(F.count_distinct("asset").alias("n_assets"), F.count_distinct("gene").alias("n_genes"))
    return out.where("n_assets >= 2 and n_genes >= 2")


def ranked_clusters(memberships: DataFrame, nodes: DataFrame) -> DataFrame:
    """cluster_id, n_diseases, n_groups, n_people, n_assets, rank: most diseases first, then groups, people, id."""
    typed = memberships.join(nodes.select(F.col("id").alias("node_id"), "type"), "node_id")
    of = lambda kind: F.count_if(F.col("type") == kind)
    facts = typed.groupBy("cluster_id").agg(of("disease").alias("n_diseases"), of("patient_group").alias("n_groups"), of("person").alias("n_people"), of("asset").alias("n_assets"))
    order = Window.orderBy(F.desc("n_diseases"), F.desc("n_groups"), F.desc("n_people"), "cluster_id")  # rows are clusters
    return facts.withColumn("rank", F.row_number().over(order))


def mechanism_index(mechanism_edges: DataFrame) -> DataFrame:
    """mechanism, n_supports, n_against, n_neutral, n_verified: distinct diseases by stance."""
    use = mechanism_edges.where("status != 'rejected'")
    n = lambda stance: F.count_distinct(F.when(F.col("stance") == stance, F.col("src")))
    return use.groupBy(F.col("dst").alias("mechanism")).agg(
        n("supports").alias("n_supports"), n("contradicts").alias("n_against"), n("neutral").alias("n_neutral"), F.count_if(F.col("status") == "verified").alias("n_verified")
    )


def investigators(investigator_edges: DataFrame, awards: DataFrame, memberships: DataFrame) -> DataFrame:
    """person, n_diseases, n_clusters, n_awards, shared: people with a supported disease; shared: in two or more clusters."""
    link = links(investigator_edges, "dst", "src", "usable").select("disease", F.col("target").alias("person"))
    diseases = link.groupBy("person").agg(F.count("*").alias("n_diseases"))
    clusters = link.join(memberships.select(F.col("node_id").alias("disease"), "cluster_id"), "disease").groupBy("person").agg(F.count_distinct("cluster_id").alias("n_clusters"))
    paid = awards.groupBy("person").agg(F.count("*").alias("n_awards"))
    out = diseases.join(clusters, "person", "left").join(paid, "person", "left").na.fill(0, ["n_clusters", "n_awards"])
    return out.withColumn("shared", F.col("n_clusters") > 1)


def coverage_counts(nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row of counts."""
    a = nodes.agg(F.count("*").alias("n_nodes"), F.count_if(F.col("type") == "disease").alias("n_diseases"))
    b = edges.agg(F.count_if(F.col("status") != "rejected").alias("n_edges"), F.count_if(F.col("status") == "verified").alias("n_verified"), F.count_if(F.col("stance") == "contradicts").alias("n_contradicting"))
    c = evidence.agg(F.count("*").alias("n_evidence"), F.max("retrieved_at").cast("string").alias("newest"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each


def coverage_report(queries: DataFrame, nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """query, n_nodes, n_edges: nodes that a query names exactly, else those whose name contains it, and their eligible edges.

    queries: query (a bounded list that users state).
    """
    clean = F.lower(F.trim(F.regexp_replace("query", r"\s+", " ")))
    q = F.broadcast(queries.select("query", clean.alias("q")))  # the stated list
    named = nodes.select("id", F.lower("name").alias("label"))
    hits = named.join(q, F.contains(F.col("label"), F.col("q"))).select("query", "id", (F.col("label") == F.col("q")).alias("exact"))
    any_exact = hits.groupBy("query").agg(F.max("exact").alias("any_exact"))
    hits = hits.join(F.broadcast(any_exact), "query").where("exact or not any_exact")  # rows are queries
    good = edges.where(supported() & F.col("tier").isin("A", "B")).join(evidence.select(F.col("edge_id").alias("id")), "id", "left_semi")
    ends = good.select(F.col("id").alias("edge_id"), F.explode(F.array("src", "dst")).alias("id"))
    found = hits.join(ends, "id").groupBy("query").agg(F.count_distinct("edge_id").alias("n_edges"))
    counts = hits.groupBy("query").agg(F.count("*").alias("n_nodes"))
    return queries.join(counts, "query", "left").join(found, "query", "left").na.fill(0)


def money_by(awards: DataFrame, key: str) -> DataFrame:
    """key, money, n_awards: costs added up by funder or project; none or not positive: left out."""
    return awards.where("total_cost > 0").groupBy(key).agg(F.sum("total_cost").alias("money"), F.count("*").alias("n_awards"))


def cluster_mechanisms(members: DataFrame, link: DataFrame) -> DataFrame:
    """cluster_id, mechanism that every disease of the cluster has. members: cluster_id, disease; link: disease, target."""
    sizes = members.groupBy("cluster_id").agg(F.count_distinct("disease").alias("size"))
    held = members.distinct().join(link.distinct(), "disease").groupBy("cluster_id", F.col("target").alias("mechanism")).agg(F.count("*").alias("n"))
    return held.join(sizes, "cluster_id").where("n = size").select("cluster_id", "mechanism")


def cluster_members(memberships: DataFrame, nodes: DataFrame) -> DataFrame:
    """cluster_id, disease, name: clusters' diseases."""
    own = nodes.where("type = 'disease'").select(F.col("id").alias("node_id"), "name")
    return memberships.join(own, "node_id").select("cluster_id", F.col("node_id").alias("disease"), "name")


def source_chart(queries: DataFrame, genes: list[str], view: str) -> DataFrame:
    """key, n: records by source (view kept: retrieved; all: total), or retrieved ones by the first gene that the query names (view gene)."""
    if view == "gene":
        key = F.lit("other")
        for g in reversed(genes):
            key = F.when(F.contains(F.upper("query"), F.lit(g.upper())), g).otherwise(key)
        value = F.col("retrieved")
    else:
        key, value = F.col("source"), F.col("retrieved" if view == "kept" else "total")
    return queries.groupBy(key.alias("key")).agg(F.sum(value).alias("n")).where("n > 0")


def builder_status(queue: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: inferred links built, links that await a decision, scored links. queue: origin, decision; edges: confidence."""
    a = queue.agg(F.count_if(F.col("origin") == "inferred").alias("n_inferred"), F.count_if(F.col("decision").isNull()).alias("n_open"))
    b = edges.agg(F.count("confidence").alias("n_scored"), F.count("*").alias("n_edges"))
    return a.crossJoin(F.broadcast(b))  # one row each


def inventory_rollup(files: DataFrame) -> DataFrame:
    """folder, n_files, n_data, n_housekeeping, bytes by the folder below the root. files: path, kind, size."""
    parts = F.split("path", "/")
    folder = F.when(F.size(parts) > 2, F.get(parts, 1)).otherwise("root")
    return files.groupBy(folder.alias("folder")).agg(
        F.count("*").alias("n_files"), F.count_if(F.col("kind") == "data").alias("n_data"), F.count_if(F.col("kind") == "housekeeping").alias("n_housekeeping"), F.sum("size").alias("bytes")
    )


def investigators_in_order(people: DataFrame, names: DataFrame, most: int = 100) -> DataFrame:
    """A top-k report: people of investigators() with their rank: those of several clusters, most diseases, name."""
    order = Window.orderBy(F.desc("shared"), F.desc("n_diseases"), "name", "person")
    named = people.join(names.select(F.col("id").alias("person"), "name"), "person")
    top = named.orderBy(F.desc("shared"), F.desc("n_diseases"), "name", "person").limit(most)  # ordered on the executors: most rows each
    return top.withColumn("rank", F.row_number().over(order))


def top_by(rows: DataFrame, keys: list, most: int = 100) -> DataFrame:
    """A top-k report: the first rows by keys with their rank."""
    return rows.orderBy(*keys).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*keys)))  # most rows


def assets_of(edges: DataFrame, assets: DataFrame, nodes: DataFrame) -> DataFrame:
    """asset, category, first_edge, diseases, url, status: assets and studies with all their live diseases, by the first edge's id.

    assets: id, kind, url, source_url, status, recruitment_status. A study is one; else the kind tells the category, else an
    asset holds patient data. The url and the status fall back to their second names.
    """
    category = {"registry": "patient_data", "natural_history": "patient_data", "biobank": "biosamples", "funded_research_project": "funded_research"}  # fixed values
    by_kind = F.lit("patient_data")
    for k, v in category.items():
        by_kind = F.when(F.col("kind") == k, v).otherwise(by_kind)
    use = edges.where((F.col("status") != "rejected") & F.col("type").isin("asset_disease", "study_disease"))
    own = use.groupBy(F.col("src").alias("id")).agg(F.min("id").alias("first_edge"), F.array_sort(F.collect_set("dst")).alias("diseases"))  # an asset's diseases
    typed = own.join(nodes.select("id", "type"), "id").join(assets, "id", "left")
    text = lambda c: F.when(F.trim(c) != "", F.col(c))
    return typed.select(
        F.col("id").alias("asset"), F.when(F.col("type") == "study", "study").otherwise(by_kind).alias("category"), "first_edge", "diseases",
        F.coalesce(text("url"), text("source_url")).alias("url"), F.coalesce(text("status"), text("recruitment_status")).alias("status"),
    )


def curated_links(nodes: DataFrame) -> DataFrame:
    """id, src, dst, type: links that nodes' own properties state, if both ends are known.

    nodes: id, type, gene_id, investigator_ids, parent_disease. A variant belongs to its gene, an award to its investigators
    (a link from each), a subgroup to its parent.
    """
    ids = nodes.select(F.col("id").alias("_id"))
    rows = {
        "variant_of": nodes.where("type = 'variant'").select(F.col("id").alias("src"), F.col("gene_id").alias("dst"), F.concat_ws("_", F.lit("cur_variant_of"), "id").alias("id"), F.col("gene_id").alias("_id")),
        "investigator_award": nodes.where("type = 'funding'").select(F.explode("investigator_ids").alias("src"), F.col("id").alias("dst")).select("src", "dst", F.concat_ws("_", F.lit("cur_award"), "src", "dst").alias("id"), F.col("src").alias("_id")),
        "subgroup_of": nodes.where("type = 'disease'").select(F.col("id").alias("src"), F.col("parent_disease").alias("dst"), F.concat_ws("_", F.lit("cur_subgroup"), "id").alias("id"), F.col("parent_disease").alias("_id")),
    }
    out = None
    for kind, links_ in rows.items():
        found = links_.join(ids, "_id", "left_semi").select("id", "src", "dst", F.lit(kind).alias("type"))
        out = found if out is None else out.unionByName(found)
    return out


def funding_projection(awards: DataFrame) -> DataFrame:
    """agency, code, fiscal_year, members, n_applications, n_projects: which awards an agency's institute paid in a year.

    awards: asset, agency, code, fiscal_year, application, project. Members are listed in order; costs are not added up.
    """
    return awards.groupBy("agency", "code", "fiscal_year").agg(
        F.array_sort(F.collect_set("asset")).alias("members"), F.count_distinct("application").alias("n_applications"), F.count_distinct("project").alias("n_projects")
    )


def funding_errors(awards: DataFrame, sources: DataFrame) -> DataFrame:
    """asset, error: awards that differ from their original records. awards: asset, application, name, project, fiscal_year, url, funder; sources: application, title, project, fiscal_year, agency, funder (both funder: JSON text)."""
    own = sources.select("application", *[F.col(c).alias(f"s_{c}") for c in ("title", "project", "fiscal_year", "agency", "funder")], F.lit(True).alias("s_known"))
    joined = awards.join(own, "application", "left")
    known = F.col("s_known").isNotNull()
    differ = lambda a, b: known & ~F.coalesce(F.col(a) == F.col(b), F.lit(False))
    rules = {
        "no application identity": ~F.coalesce(F.col("application").rlike("^[1-9][0-9]*$"), F.lit(False)),
        "no source record": ~known,
        "another agency": known & ~F.coalesce(F.col("s_agency") == "NIH", F.lit(False)),
        "title differs": differ("name", "s_title"),
        "project differs": differ("project", "s_project") | (known & (F.coalesce(F.trim("project"), F.lit("")) == "")),
        "year differs": differ("fiscal_year", "s_fiscal_year"),
        "url differs": known & ~F.coalesce(F.col("url") == F.concat(F.lit("https://reporter.nih.gov/project-details/"), "application"), F.lit(False)),
        "funders differ": differ("funder", "s_funder"),
    }
    found = F.filter(F.array(*[F.when(c, k) for k, c in rules.items()]), lambda x: x.isNotNull())
    return joined.select("asset", F.explode(found).alias("error"))


def clusters_in_order(members: DataFrame, mechanisms: DataFrame, groups: DataFrame, assets: DataFrame, people: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster_id, label, n_diseases, has_data, n_groups, n_people, n_qualifiers, rank of clusters of mechanisms.

    members: cluster_id, mechanism; mechanisms: edges; groups: disease, patient_group (a parent's among them); assets: disease,
    category; people: disease, person; labels: cluster_id, label. Most diseases first, then those with patient data, most
    groups, most people, label.
    """
    use = mechanisms.where("status != 'rejected'").join(members.withColumnRenamed("mechanism", "dst"), "dst")
    diseases = use.where("stance = 'supports'").select("cluster_id", F.col("src").alias("disease")).distinct()
    n = lambda rows, key, out: diseases.join(rows, "disease").groupBy("cluster_id").agg(F.count_distinct(key).alias(out))
    data = diseases.join(assets.where("category = 'patient_data'").select("disease").distinct(), "disease").select("cluster_id", F.lit(True).alias("has_data")).distinct()
    facts = labels.join(diseases.groupBy("cluster_id").agg(F.count("*").alias("n_diseases")), "cluster_id", "left").join(data, "cluster_id", "left")
    facts = facts.join(n(groups, "patient_group", "n_groups"), "cluster_id", "left").join(n(people, "person", "n_people"), "cluster_id", "left")
    facts = facts.join(use.where("stance = 'contradicts'").groupBy("cluster_id").agg(F.count("*").alias("n_qualifiers")), "cluster_id", "left")
    facts = facts.na.fill(0, ["n_diseases", "n_groups", "n_people", "n_qualifiers"]).na.fill(False, ["has_data"])
    order = Window.orderBy(F.desc("n_diseases"), F.desc("has_data"), F.desc("n_groups"), F.desc("n_people"), "label", "cluster_id")  # rows are clusters
    return facts.withColumn("rank", F.row_number().over(order))


def needs(diseases: DataFrame, groups: DataFrame, assets: DataFrame) -> DataFrame:
    """disease, need: diseases (disease, name) without a patient organization, patient data, or a study that recruits. assets: disease, category, status."""
    has = {
        "group": groups.select("disease").distinct(),
        "data": assets.where("category = 'patient_data'").select("disease").distinct(),
        "study": assets.where("category = 'study' and status = 'RECRUITING'").select("disease").distinct(),
    }
    text = {
        "group": F.concat(F.lit("No patient organization linked to "), "name", F.lit(" in this atlas.")),
        "data": F.lit("No registry or natural history study linked."),
        "study": F.lit("No recruiting interventional or observational study linked."),
    }  # fixed values
    out = None
    for k, rows in has.items():
        found = diseases.join(rows, "disease", "left_anti").select("disease", text[k].alias("need"))
        out = found if out is None else out.unionByName(found)
    return out


def overlap_free_union(baseline: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """Both tables' distinct rows; keys that both have are an error, named by one of them."""
    both = baseline.select(key).join(more.select(key), key, "left_semi").limit(1).collect()
    if both:
        raise ValueError(f"{key} {both[0][0]} is in both")
    return baseline.unionByName(more).distinct()
