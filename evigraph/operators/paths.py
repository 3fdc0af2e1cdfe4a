"""Paths of edges: which may be explained, in what sentences, against what evidence; and the shortest way along a route's own steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import EDGE_TYPES
from ..sources.scratch import discard, written

# The sentences that users see, by relation; subgroup_of has none and explains nothing.
PHRASES = {
    "disease_gene": "has a documented gene association with",
    "gene_variant_mechanism": "has a source-scoped functional relationship with",
    "disease_mechanism": "has a source-scoped mechanism relationship with",
    "disease_phenotype": "has a documented phenotype association with",
    "group_disease": "is a patient organization linked to",
    "asset_disease": "is a research resource linked to",
    "study_disease": "is a registered study linked to",
    "investigator_disease": "is an investigator linked to",
    "shares_mechanism_with": "has a documented shared-mechanism relationship with",
    "shares_investigator": "has a shared-investigator relationship with",
}
# The sentences of a step by relation, and those of an inferred one.
STEP_SENTENCES = {
    "disease_gene": ("{src} is associated with variants in {dst}.", "{src} may be associated with variants in {dst}."),
    "gene_variant_mechanism": ("The {src} variant acts through {dst}.", "The {src} variant may act through {dst}."),
    "disease_mechanism": ("{src} is understood to arise through {dst}.", "{src} may arise through {dst}."),
    "disease_phenotype": ("{src} is associated with {dst}.", "{src} may be associated with {dst}."),
    "group_disease": ("{src} supports people with {dst}.", "{src} may support people with {dst}."),
    "asset_disease": ("{src} is a resource relevant to {dst}.", "{src} may be a resource relevant to {dst}."),
    "study_disease": ("{src} is studying {dst}.", "{src} may be studying {dst}."),
    "investigator_disease": ("{src} is an investigator working on {dst}.", "{src} may be an investigator working on {dst}."),
    "shares_mechanism_with": ("{src} shares a mechanism with {dst}.", "{src} may share a mechanism with {dst}."),
    "shares_investigator": ("{src} shares an investigator with {dst}.", "{src} may share an investigator with {dst}."),
}
# Relations whose edges are read beside the evidence against them.
MECHANISM_RELATIONS = ("disease_mechanism", "gene_variant_mechanism", "shares_mechanism_with", "subgroup_of")


def usable_evidence(snippet: Column, url: Column) -> Column:
    """A snippet with a sign in it, and a web address."""
    return F.coalesce((F.trim(snippet) != "") & url.rlike(r"(?i)^https?://[^/?#\s]"), F.lit(False))


def _by_relation(texts: dict[str, str], relation: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in texts.items():
        out = F.when(relation == k, F.lit(v)).otherwise(out)
    return out


def _named(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with src_type, src_name, dst_type, dst_name; null where the node is missing."""
    of = lambda end: nodes.select(F.col("id").alias(end), F.col("type").alias(f"{end}_type"), F.col("name").alias(f"{end}_name"))
    return edges.join(of("src"), "src", "left").join(of("dst"), "dst", "left")


def _allowed() -> Column:
    """The ends have the types that the relation asks for."""
    pairs = [(F.col("type") == k) & (F.col("src_type") == a) & (F.col("dst_type") == b) for k, (a, b) in EDGE_TYPES.items() if k in PHRASES]
    out = pairs[0]
    for p in pairs[1:]:
        out = out | p
    return F.coalesce(out, F.lit(False))


def _cited(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """id, evidence_ids in order: the usable evidence of the edges."""
    own = evidence.where(usable_evidence(F.col("snippet"), F.col("source_url"))).join(edges.select(F.col("id").alias("edge_id")).distinct(), "edge_id", "left_semi")
    return own.groupBy(F.col("edge_id").alias("id")).agg(F.array_sort(F.collect_list(F.col("id"))).alias("evidence_ids"))


def explained(paths: DataFrame, edges: DataFrame, nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """path_id, status, reason, sentences: whether each path may be explained, and its cited sentences in order.

    paths: path_id, edge_ids (in order; a path_id once); edges: id, src, dst, type, tier, stance, status, note; nodes: id,
    type, name; evidence: id, edge_id, snippet, source_url. reason, the first that holds: empty_path; unsupported_path, if
    an edge is unknown, doesn't support, is not verified, is tier D, has an end that is missing or of another type than
    the relation asks, or no usable evidence; disconnected_path, if the edges do not lead on from each other. sentences:
    structs of step, text, edge_id, evidence_ids, tier, kind, note; null for a path that isn't explained.

    Edges, names and evidence are looked up once for each distinct edge of all paths, not once for each path.
    """
    step = paths.select("path_id", F.posexplode("edge_ids").alias("step", "id"))
    asked = edges.join(step.select("id").distinct(), "id", "left_semi")
    sound = _named(asked.where("stance = 'supports' AND status = 'verified' AND tier != 'D'"), nodes)
    sound = sound.where(_allowed()).join(_cited(evidence, asked), "id")
    inferred = F.col("tier") == "C"
    text = F.when(
        inferred, F.concat(F.lit("Hypothesis (inferred): "), "src_name", F.lit(" may have a "), F.replace("type", F.lit("_"), F.lit(" ")), F.lit(" relationship with "), "dst_name", F.lit("; this requires expert review."))
    ).otherwise(F.concat("src_name", F.lit(" "), _by_relation(PHRASES, F.col("type")), F.lit(" "), "dst_name", F.lit(".")))
    said = sound.select("id", "src", "dst", F.struct(text.alias("text"), F.col("id").alias("edge_id"), "evidence_ids", "tier", F.when(inferred, "hypothesis").otherwise("supported").alias("kind"), "note").alias("said"))
    whole = step.join(said, "id", "left").groupBy("path_id").agg(
        F.count("*").alias("n"), F.count("said").alias("n_sound"), F.array_sort(F.collect_list(F.struct("step", "src", "dst", "said"))).alias("steps")
    )  # a path's few edges
    out = paths.select("path_id").join(whole, "path_id", "left")
    none = F.array().cast("array<string>")
    other = lambda ends, e: F.concat(F.when(F.array_contains(ends, e["src"]), F.array(e["dst"])).otherwise(none), F.when(F.array_contains(ends, e["dst"]), F.array(e["src"])).otherwise(none))
    ends = F.aggregate("steps", none, lambda ends, e: F.when(e["step"] == 0, F.array(e["src"], e["dst"])).otherwise(other(ends, e)))
    reason = F.when(F.col("n").isNull(), "empty_path").when(F.col("n_sound") < F.col("n"), "unsupported_path").when(F.size(ends) == 0, "disconnected_path")
    sentences = F.transform("steps", lambda s: F.struct(s["step"].alias("step"), s["said"]["text"].alias("text"), s["said"]["edge_id"].alias("edge_id"), s["said"]["evidence_ids"].alias("evidence_ids"), s["said"]["tier"].alias("tier"), s["said"]["kind"].alias("kind"), s["said"]["note"].alias("note")))
    out = out.withColumn("reason", reason)
    return out.select("path_id", F.when(F.col("reason").isNull(), "explained").otherwise("no_supported_route").alias("status"), "reason", F.when(F.col("reason").isNull(), sentences).alias("sentences"))


def path_contradictions(found: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """path_id, edge_id, evidence_ids, note: the contradicting edges, not rejected, that touch a node of an explained path; no sentence counts them as support.

    found: of explained(). Nodes meet contradicting edges by an equality join, a node once for each path.
    """
    ids = found.where("status = 'explained'").select("path_id", F.explode("sentences.edge_id").alias("id"))
    ends = lambda e: F.explode(F.array_distinct(F.array(e["src"], e["dst"]))).alias("node")
    at = ids.join(edges.select("id", "src", "dst"), "id")
    at = at.select("path_id", ends(at)).distinct()
    against = edges.where("stance = 'contradicts' AND status != 'rejected'")
    near = against.select(F.col("id").alias("edge_id"), ends(against)).join(at, "node").select("path_id", "edge_id").distinct()
    cited = _cited(evidence, against).withColumnRenamed("id", "edge_id")
    out = near.join(against.select(F.col("id").alias("edge_id"), "note"), "edge_id").join(cited, "edge_id", "left")
    return out.select("path_id", "edge_id", F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"), "note")


def step_sentences(paths: DataFrame, edges: DataFrame, nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """path_id, step, edge_id, dropped, text, inferred, stance, tier, n_evidence: a sentence for each edge that exists, is not rejected and has evidence.

    dropped: why an edge has none ('edge not found', 'edge rejected', 'no evidence'); steps are numbered before dropping.
    A contradicting edge is put as a contradiction, never as support; a node without a name goes by its id.
    """
    step = paths.select("path_id", F.posexplode("edge_ids").alias("step", "edge_id"))
    asked = edges.join(step.select(F.col("edge_id").alias("id")).distinct(), "id", "left_semi")
    n = evidence.groupBy(F.col("edge_id").alias("id")).agg(F.count("*").alias("n_evidence"))
    known = _named(asked, nodes).join(n, "id", "left")
    src, dst = F.coalesce("src_name", "src"), F.coalesce("dst_name", "dst")
    inferred = F.col("tier") == "C"
    fill = lambda t: F.replace(F.replace(t, F.lit("{src}"), src), F.lit("{dst}"), dst)
    plain = [_by_relation({k: v[i] for k, v in STEP_SENTENCES.items()}, F.col("type")) for i in (0, 1)]
    relation = F.replace("type", F.lit("_"), F.lit(" "))
    said = F.coalesce(fill(F.when(inferred, plain[1]).otherwise(plain[0])), F.concat(src, F.lit(" connects to "), dst, F.lit(" ("), relation, F.lit(").")))
    said = F.concat(said, F.when(inferred, " This is inferred by the graph, not yet directly confirmed.").otherwise(""))
    against = F.concat(F.lit("Evidence contradicts a "), relation, F.lit(" connection between "), src, F.lit(" and "), dst, F.lit("."))
    known = known.select(F.col("id").alias("edge_id"), F.when(F.col("stance") == "contradicts", against).otherwise(said).alias("text"), inferred.alias("inferred"), "stance", "tier", "status", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))
    out = step.join(known, "edge_id", "left")
    dropped = F.when(F.col("status").isNull(), "edge not found").when(F.col("status") == "rejected", "edge rejected").when(F.col("n_evidence") == 0, "no evidence")
    keep = lambda c: F.when(F.col("dropped").isNull(), F.col(c)).alias(c)
    return out.withColumn("dropped", dropped).select("path_id", "step", "edge_id", "dropped", keep("text"), keep("inferred"), keep("stance"), keep("tier"), keep("n_evidence"))


def contradictions_beside(focus: DataFrame, edges: DataFrame) -> DataFrame:
    """edge_id, other_id: the contradicting edges beside each edge about a mechanism, none for one that contradicts itself.

    focus: id, of edges. edges: id, src, dst, type, stance, and derived_from (ids of the edges that an inferred one rests
    on; null: none). Beside an edge is what touches one of its ends or of those edges' ends.
    """
    mine = edges.join(focus.select("id").distinct(), "id", "left_semi").where(F.col("type").isin(*MECHANISM_RELATIONS) & F.coalesce(F.col("stance") != "contradicts", F.lit(True)))
    ends = lambda e: F.explode(F.array("src", "dst")).alias("node")
    below = mine.select(F.col("id").alias("edge_id"), F.explode("derived_from").alias("id")).join(edges.select("id", "src", "dst"), "id")
    touched = mine.select(F.col("id").alias("edge_id"), ends(mine)).unionByName(below.select("edge_id", ends(below))).distinct()
    against = edges.where("stance = 'contradicts'")
    met = touched.join(against.select(F.col("id").alias("other_id"), ends(against)).distinct(), "node")
    return met.where("edge_id != other_id").select("edge_id", "other_id").distinct()


def shortest_routes(routes: DataFrame, steps: DataFrame, most_hops: int = 32) -> DataFrame:
    """route_id, nodes, steps, reversed: the shortest path of each route along its own steps in either direction; null where there is none.

    routes: route_id (once), start, goal; steps: route_id, step (its place in the route), subject, object. Of paths as
    short, the one with the earlier first step, then the earlier second one, and so on. nodes: start to goal; reversed: is
    a step taken from its object to its subject? A route from a node to itself has no path, as in a walk that never comes
    back. Breadth first for all routes at once: a round joins the frontier with the steps at its nodes, keeps the first
    way to each node that no round has reached, and ends a route at its goal. A route longer than most_hops is an error.
    """
    steps = steps.where("subject IS NOT NULL AND object IS NOT NULL AND subject != object")
    there = steps.select("route_id", F.col("subject").alias("at"), F.col("object").alias("to"), "step", F.lit(False).alias("back"))
    back = steps.select("route_id", F.col("object").alias("at"), F.col("subject").alias("to"), "step", F.lit(True).alias("back"))
    ways = written(there.unionByName(back), "route-ways")
    hop = "array<struct<step:long,back:boolean,to:string>>"
    front = routes.select("route_id", "goal", F.col("start").alias("at"), F.array().cast(hop).alias("way"))
    seen = [written(front.select("route_id", "at"), "route-seen")]
    done: list[DataFrame] = []
    fronts: list[DataFrame] = []
    for _ in range(most_hops):
        onward = front.join(ways, ["route_id", "at"])
        onward = onward.withColumn("way", F.concat("way", F.array(F.struct(F.col("step").cast("long").alias("step"), "back", F.col("to").cast("string").alias("to")))))
        for s in seen:
            onward = onward.join(s.withColumnRenamed("at", "to"), ["route_id", "to"], "left_anti")
        # ways of one length are ordered by their steps, then by direction
        front = written(onward.groupBy("route_id", F.col("to").alias("at")).agg(F.min(F.struct("way", "goal")).alias("w")).select("route_id", "at", "w.goal", "w.way"), "route-front")
        fronts.append(front)
        if front.isEmpty():
            break
        seen.append(front.select("route_id", "at"))
        done.append(front.where("at = goal"))
        # a route that has arrived goes no further
        front = front.join(done[-1].select("route_id"), "route_id", "left_anti")
    else:
        if not front.isEmpty():
            raise ValueError(f"a route goes on beyond {most_hops} steps")
    found = ways.sparkSession.createDataFrame([], fronts[0].schema) if not done else done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    out = written(
        routes.select("route_id", "start").join(found.select("route_id", "way"), "route_id", "left").select(
            "route_id", F.when(F.col("way").isNotNull(), F.concat(F.array("start"), F.col("way.to"))).alias("nodes"), F.col("way.step").alias("steps"), F.col("way.back").alias("reversed")
        ), "routes-found",
    )
    discard(ways, seen[0], *fronts)
    return out
