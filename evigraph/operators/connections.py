"""Connections between diseases: why, how sure, what limits them, and who is there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .links import live, supported


def informative(phenotypes: DataFrame) -> DataFrame:
    """phenotype, n_diseases, total, informative: few enough diseases have it to say something."""
    phenotypes = phenotypes.where(live())
    total = phenotypes.select("src").distinct().agg(F.count("*").alias("total"))
    counts = phenotypes.where("stance = 'supports'").groupBy(F.col("dst").alias("phenotype")).agg(F.countDistinct("src").alias("n_diseases"))
    most = F.greatest(F.lit(1), F.floor(F.col("total") / 3))
    return counts.crossJoin(F.broadcast(total)).select("phenotype", "n_diseases", "total", (F.col("n_diseases") <= most).alias("informative"))  # one row


def members(focus: DataFrame, parents: DataFrame) -> DataFrame:
    """focus, member: each focus (id) and its children."""
    up = parents.where(supported("usable"))
    own = focus.select(F.col("id").alias("focus"), F.col("id").alias("member"))
    return own.unionByName(up.join(focus.withColumnRenamed("id", "dst"), "dst").select(F.col("dst").alias("focus"), F.col("src").alias("member"))).distinct()


@dataclass(frozen=True)
class Kin:
    """The members and families of a set of focuses, each a written table: what connections ask for again and again."""

    members: DataFrame
    family: DataFrame


def kin(focus: DataFrame, parents: DataFrame) -> Kin:
    return Kin(written(members(focus, parents), "members"), written(family(focus, parents), "family"))


def family(focus: DataFrame, parents: DataFrame) -> DataFrame:
    """focus, candidate: each focus itself, its children and its parents."""
    up = parents.where(supported("usable"))
    above = up.join(focus.withColumnRenamed("id", "src"), "src").select(F.col("src").alias("focus"), F.col("dst").alias("candidate"))
    return members(focus, parents).withColumnRenamed("member", "candidate").unionByName(above).distinct()


def qualifiers(focus: DataFrame, mechanisms: DataFrame, parents: DataFrame, own: Kin | None = None) -> DataFrame:
    """focus, candidate, edge_id, side: contradicting edges that limit a link between the two.

    side target: the candidate, or its parent, contradicts a mechanism that the focus or its children support. side own:
    the focus or its children contradict one that the candidate supports. Rejected edges say nothing. An edge limits a pair
    once for each side: edges, kin and parents are told apart first, so pairs need no further comparison.
    """
    kin_ = own or Kin(members(focus, parents), family(focus, parents))
    mine = kin_.members
    support = mechanisms.where(supported("usable")).select(F.col("src").alias("disease"), F.col("dst").alias("mechanism")).distinct()
    against = mechanisms.where((F.col("stance") == "contradicts") & live()).select(F.col("src").alias("disease"), F.col("dst").alias("mechanism"), F.col("id").alias("edge_id")).distinct()
    held = mine.join(support.withColumnRenamed("disease", "member"), "member").select("focus", "mechanism").distinct()
    facing = held.join(against, "mechanism").select("focus", "disease", "edge_id")
    up = parents.where(supported("usable")).select(F.col("src").alias("candidate"), F.col("dst").alias("disease")).where("candidate != disease").distinct()
    target = facing.withColumnRenamed("disease", "candidate").unionByName(facing.join(up, "disease").select("focus", "candidate", "edge_id"))
    mine_against = mine.join(against.withColumnRenamed("disease", "member"), "member").join(support, "mechanism").select("focus", F.col("disease").alias("candidate"), "edge_id")
    out = target.withColumn("side", F.lit("target")).unionByName(mine_against.withColumn("side", F.lit("own")))
    return out.join(kin_.family, ["focus", "candidate"], "left_anti")


#: Into how many parts the focuses are dealt, and the diseases of a phenotype.
CHUNKS, SALTS = 16, 64


def _part(column: str, of: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(of)).cast("int")


def shared_phenotypes(focus: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """focus, candidate, phenotype, n_diseases, informative: what each focus and another disease both have. Linear in the diseases for each focus.

    A phenotype's focuses are lists, of a CHUNKS-th of them at most, which its diseases meet in SALTS parts; pairs are made last.
    """
    has = phenotypes.where(supported("usable")).select(F.col("src").alias("candidate"), F.col("dst").alias("phenotype")).distinct()
    mine = has.join(focus.select(F.col("id").alias("candidate")), "candidate", "left_semi").withColumnRenamed("candidate", "focus")
    lists = mine.groupBy("phenotype", _part("focus", CHUNKS).alias("chunk")).agg(F.collect_list("focus").alias("focuses"))
    said = lists.join(informative(phenotypes).drop("total"), "phenotype").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = has.withColumn("part", _part("candidate", SALTS)).join(said, ["phenotype", "part"])
    return pairs.select(F.explode("focuses").alias("focus"), "candidate", "phenotype", "n_diseases", "informative").where("focus != candidate")


def communities(group_edges: DataFrame, parents: DataFrame) -> DataFrame:
    """disease, patient_group, via_parent: a disease's own groups, and its parent's that it does not have itself."""
    own = group_edges.where(supported("usable")).select(F.col("dst").alias("disease"), F.col("src").alias("patient_group")).distinct()
    up = parents.select(F.col("src").alias("disease"), F.col("dst").alias("parent"))
    via = up.join(own.select(F.col("disease").alias("parent"), "patient_group"), "parent").select("disease", "patient_group")
    via = via.join(own, ["disease", "patient_group"], "left_anti").distinct()
    return own.withColumn("via_parent", F.lit(False)).unionByName(via.withColumn("via_parent", F.lit(True)))


def _ways(own: Kin, edges: DataFrame, parents: DataFrame, disease: str, target: str) -> DataFrame:
    """focus, candidate, best (via, member, supported, edge_a, edge_b): the inferred links of a focus or its children with each disease outside its family."""
    use = edges.where(supported("usable")).select(F.col(disease).alias("candidate"), F.col(target).alias("via"), F.col("id").alias("edge"), (F.col("tier") != "C").alias("observed"))
    mine = own.members.join(use.withColumnRenamed("candidate", "member"), "member")
    mine = mine.select("focus", "member", "via", F.col("edge").alias("edge_a"), F.col("observed").alias("observed_a"))
    pairs = mine.join(use, "via").where("member != candidate").select("focus", "member", "candidate", "via", "edge_a", F.col("edge").alias("edge_b"), (F.col("observed_a") & F.col("observed")).alias("supported"))
    known = parents.select(F.col("src").alias("member"), F.col("dst").alias("candidate"))
    known = known.unionByName(parents.select(F.col("dst").alias("member"), F.col("src").alias("candidate"))).join(own.members.select("member").distinct(), "member", "left_semi")  # few
    pairs = pairs.join(known, ["member", "candidate"], "left_anti").join(own.family, ["focus", "candidate"], "left_anti")
    return pairs.select("focus", "candidate", F.struct("via", "member", "supported", "edge_a", "edge_b").alias("best"))


def _profiles(phenotypes: DataFrame) -> DataFrame:
    """disease, profile: the phenotypes that a disease has, in order."""
    has = phenotypes.where(supported("usable")).select(F.col("src").alias("disease"), F.col("dst").alias("phenotype"))
    return has.groupBy("disease").agg(F.array_sort(F.collect_set("phenotype")).alias("profile"))  # a disease's phenotypes


def _overlaps(focus: DataFrame, profiles: DataFrame) -> DataFrame:
    """focus, profile, n: each focus and each distinct profile that has some of its phenotypes, and how many.

    Diseases with the same phenotypes are compared once, so a phenotype of very many diseases makes no pairs of them.
    """
    mine = focus.select(F.col("id").alias("disease")).distinct().join(profiles, "disease").select(F.col("disease").alias("focus"), F.col("profile").alias("own"))
    some = lambda rows, c: rows.select(c).distinct().select(c, F.explode(c).alias("phenotype"))
    both = some(mine, "own").join(some(profiles, "profile"), "phenotype").groupBy("own", "profile").agg(F.count("*").alias("n"))
    return mine.join(both, "own").select("focus", "profile", "n")


def _described(groups: DataFrame, parents: DataFrame, phenotypes: DataFrame, nodes: DataFrame) -> DataFrame:
    """candidate, name, n_communities, profile (null for none) of every disease that is a node."""
    there = communities(groups, parents).groupBy("disease").agg(F.count("*").alias("n_communities"))
    known = _profiles(phenotypes).join(there, "disease", "full_outer").withColumnRenamed("disease", "candidate")
    return nodes.select(F.col("id").alias("candidate"), "name").join(known, "candidate", "left").withColumn("n_communities", F.coalesce("n_communities", F.lit(0)))


def linked(focus: DataFrame, mechanisms: DataFrame, investigators: DataFrame, phenotypes: DataFrame, parents: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """The connections() by a mechanism or an investigator, without their reason. They grow with the edges, those by a phenotype with the pairs of diseases."""
    own_kin = kin(focus, parents)
    mech = _ways(own_kin, mechanisms, parents, "src", "dst").select("focus", "candidate", F.struct(F.lit(0).alias("order"), F.lit("mechanism").alias("kind"), "best.*").alias("w"))
    inv = _ways(own_kin, investigators, parents, "dst", "src").withColumn("best", F.col("best").withField("supported", F.lit(False)))
    inv = inv.select("focus", "candidate", F.struct(F.lit(1).alias("order"), F.lit("investigator").alias("kind"), "best.*").alias("w"))
    first = mech.unionByName(inv).repartition("focus", "candidate").groupBy("focus", "candidate").agg(F.min("w").alias("w"))
    limits = qualifiers(focus, mechanisms, parents, own_kin).groupBy("focus", "candidate").agg(F.count("*").alias("n_qualifiers"))
    out = first.join(limits, ["focus", "candidate"], "left").join(_described(groups, parents, phenotypes, nodes), "candidate")
    mine = _profiles(phenotypes).join(focus.select(F.col("id").alias("disease")), "disease", "left_semi").select(F.col("disease").alias("focus"), F.col("profile").alias("own"))
    n = F.when(F.col("own").isNull() | F.col("profile").isNull(), F.lit(0)).otherwise(F.size(F.array_intersect("own", "profile"))).cast("long")
    return out.join(mine, "focus", "left").select(
        "focus", "candidate", "name", "w.kind", "w.via", "w.member", "w.supported", n.alias("n_phenotypes"), F.coalesce("n_qualifiers", F.lit(0)).alias("n_qualifiers"), "n_communities", "w.edge_a", "w.edge_b"
    )


def with_reasons(way: DataFrame, nodes: DataFrame) -> DataFrame:
    """linked() and why: a sentence on the mechanism or the investigator of each."""
    out = way.join(nodes.select(F.col("id").alias("_via"), F.col("name").alias("via_name")), F.col("via") == F.col("_via"), "left")
    reason = F.when(F.col("kind") == "mechanism", F.concat(F.lit("Both have cited evidence for "), F.lower("via_name"), F.lit("."))).otherwise(
        F.concat("via_name", F.lit(" is listed on NIH awards for both. Shared expertise, not shared biology."))
    )  # fixed values: the two sentences
    return out.withColumn("reason", reason).drop("_via", "via_name")


def by_phenotype(focus: DataFrame, way: DataFrame, mechanisms: DataFrame, phenotypes: DataFrame, parents: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """The connections() by a phenotype alone: a row for each focus and each disease outside its family that shares one and is not in way, which is linked().

    Only diseases and lists of focuses are shuffled, each disease CHUNKS times; pairs are made last, beside what is said of
    the disease, and no join or aggregation follows. A row holds a CHUNKS-th of the focuses at most.
    """
    chunk = _part("focus", CHUNKS).alias("chunk")
    profiles = _profiles(phenotypes)
    lists = _overlaps(focus, profiles).groupBy("profile", chunk).agg(F.collect_list(F.struct("focus", "n")).alias("focuses"))
    taken = way.select("focus", "candidate").unionByName(family(focus, parents)).groupBy("candidate", chunk).agg(F.collect_list("focus").alias("taken"))
    limits = qualifiers(focus, mechanisms, parents).groupBy("focus", "candidate").agg(F.count("*").alias("n"))
    limits = limits.groupBy("candidate", chunk).agg(F.map_from_entries(F.collect_list(F.struct("focus", "n"))).alias("limits"))
    every = _described(groups, parents, phenotypes, nodes).where("profile is not null")
    every = every.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1)))).join(taken, ["candidate", "chunk"], "left").join(limits, ["candidate", "chunk"], "left")
    pairs = every.join(lists, ["profile", "chunk"]).select("candidate", "name", "n_communities", F.coalesce("taken", F.array().cast("array<string>")).alias("taken"), "limits", F.explode("focuses").alias("f"))
    pairs = pairs.where(~F.array_contains("taken", F.col("f.focus")))
    none, n = F.lit(None).cast("string"), F.col("f.n")
    reason = F.concat(F.lit("Shares "), n.cast("string"), F.lit(" symptom annotation"), F.when(n == 1, "").otherwise("s"), F.lit(", none specific enough to suggest shared biology."))
    return pairs.select(
        "f.focus", "candidate", "name", F.lit("phenotype").alias("kind"), none.alias("via"), none.alias("member"), F.lit(False).alias("supported"), n.alias("n_phenotypes"), F.coalesce(F.col("limits")[F.col("f.focus")], F.lit(0)).alias("n_qualifiers"),
        "n_communities", reason.alias("reason"), none.alias("edge_a"), none.alias("edge_b"),
    )


def phenotype_counts(focus: DataFrame, way: DataFrame, phenotypes: DataFrame, parents: DataFrame, nodes: DataFrame) -> DataFrame:
    """focus, n: how many rows by_phenotype() has, counted without making them; focuses without any are left out. way: focus, candidate, n_phenotypes."""
    profiles = _profiles(phenotypes).join(nodes.select(F.col("id").alias("disease")), "disease", "left_semi")
    sizes = profiles.groupBy("profile").agg(F.count("*").alias("k"))
    every = _overlaps(focus, _profiles(phenotypes)).join(sizes, "profile").select("focus", F.col("k").alias("n"))
    near = family(focus, parents).join(profiles.withColumnRenamed("disease", "candidate"), "candidate")
    near = near.join(_profiles(phenotypes).select(F.col("disease").alias("focus"), F.col("profile").alias("own")), "focus").where(F.arrays_overlap("own", "profile"))
    less = way.where("n_phenotypes > 0").select("focus", F.lit(-1).cast("long").alias("n")).unionByName(near.select("focus", F.lit(-1).cast("long").alias("n")))
    return every.unionByName(less.join(focus.select(F.col("id").alias("focus")), "focus", "left_semi")).groupBy("focus").agg(F.sum("n").alias("n")).where("n > 0")


def connections(focus: DataFrame, mechanisms: DataFrame, investigators: DataFrame, phenotypes: DataFrame, parents: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """focus, candidate, name, kind, via, supported, n_phenotypes, n_qualifiers, n_communities, reason, edge_a, edge_b: each focus against all diseases.

    kind: mechanism if the focus or its children share one with the candidate, else investigator, else phenotype (the
    focus's own). supported: both edges of a shared mechanism are observed; an investigator or a phenotype supports nothing.
    """
    way = written(linked(focus, mechanisms, investigators, phenotypes, parents, groups, nodes), "linked")
    return with_reasons(way, nodes).unionByName(by_phenotype(focus, way, mechanisms, phenotypes, parents, groups, nodes))


def lacking(focus: DataFrame, way: DataFrame, most: int = 40) -> DataFrame:
    """id of the focuses with fewer than `most` connections in way: the first `most` of the others need none by a phenotype, which rank last."""
    full = way.groupBy(F.col("focus").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= most)
    return focus.join(full, "id", "left_anti")


def ranked(found: DataFrame, most: int = 40) -> DataFrame:
    """The first connections of each focus with their rank: by kind, supported first, fewest qualifiers, most shared phenotypes, name. Spark keeps `most` of each task's rows before it shuffles."""
    kind = F.when(F.col("kind") == "mechanism", 0).when(F.col("kind") == "investigator", 1).otherwise(2)
    order = Window.partitionBy("focus").orderBy(kind, F.desc("supported"), "n_qualifiers", F.desc("n_phenotypes"), "name", "candidate")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def routes(found: DataFrame, parents: DataFrame, groups: DataFrame, assets: DataFrame) -> DataFrame:
    """focus, candidate, part, step, edge_id: the way of each connection by a mechanism or an investigator.

    part route: the child's edge to the focus if the link is a child's, then the focus's side, then the candidate's. part
    community: the candidate's edge to its parent, then the groups of both, then their assets (src asset, dst disease) that
    hold patient data or samples; each by edge id. A phenotype makes no route.
    """
    way = found.where("kind != 'phenotype'")
    up = parents.where(supported("usable")).select(F.col("src").alias("child"), F.col("dst").alias("parent"), F.col("id").alias("up"))
    child = up.select(F.col("child").alias("member"), F.col("parent").alias("focus"), "up")
    with_child = way.join(child, ["member", "focus"], "left")
    steps = F.filter(F.array("up", "edge_a", "edge_b"), lambda e: e.isNotNull())
    route = with_child.select("focus", "candidate", F.lit("route").alias("part"), F.posexplode(steps).alias("step", "edge_id"))
    # what follows depends on the candidate alone: its edges are placed once, whatever the number of focuses
    there = way.select("candidate").distinct()
    to = there.join(up.withColumnRenamed("child", "candidate"), "candidate")
    of = there.select("candidate", F.lit(0).alias("via"), F.col("candidate").alias("disease")).unionByName(to.select("candidate", F.lit(1).alias("via"), F.col("parent").alias("disease")))
    edge = lambda e, kind: e.where(supported("usable")).select(F.col("dst").alias("disease"), F.lit(kind).alias("order"), F.col("id").alias("edge_id"))
    there = of.join(edge(groups, 1).unionByName(edge(assets, 2)), "disease")
    tail = to.select("candidate", F.lit(0).alias("order"), F.lit(0).alias("via"), F.col("up").alias("edge_id"))
    tail = tail.unionByName(there.select("candidate", "order", "via", "edge_id"))
    place = Window.partitionBy("candidate").orderBy("order", "via", "edge_id")  # the edges of two diseases
    tail = tail.select("candidate", (F.row_number().over(place) - 1).alias("step"), "edge_id")
    tail = way.select("focus", "candidate").join(tail, "candidate").select("focus", "candidate", F.lit("community").alias("part"), "step", "edge_id")
    return route.unionByName(tail)


def no_route(focus: DataFrame, found: DataFrame, mechanisms: DataFrame, phenotypes: DataFrame, nodes: DataFrame) -> DataFrame:
    """focus, reason, missing, n_mechanisms: focuses without a connection by a mechanism or an investigator, and why."""
    some = found.where("kind != 'phenotype'").select(F.col("focus").alias("id")).distinct()
    alone = focus.join(some, "id", "left_anti").join(nodes.select("id", "name"), "id")
    broad = found.where("kind = 'phenotype'").select(F.col("focus").alias("id"), F.lit(True).alias("broad")).distinct()
    names = nodes.select(F.col("id").alias("mechanism"), F.lower("name").alias("mechanism_name"))
    own = mechanisms.where(supported("usable")).select(F.col("src").alias("id"), F.col("dst").alias("mechanism")).distinct().join(names, "mechanism")
    own = own.groupBy("id").agg(F.array_sort(F.collect_set("mechanism_name")).alias("held"))  # a disease's mechanisms
    out = alone.join(broad, "id", "left").join(own, "id", "left")
    held = F.concat(F.lit("No other condition in this atlas has cited evidence for "), F.array_join("held", " or "), F.lit("."))
    missing = F.when(F.size("held") > 0, held).otherwise(F.concat(F.lit("No cited mechanism is recorded for "), "name", F.lit(" yet.")))
    reason = F.when(F.coalesce("broad", F.lit(False)), "only_broad_phenotypes").otherwise("no_shared_mechanism")
    return out.select(F.col("id").alias("focus"), reason.alias("reason"), missing.alias("missing"), F.coalesce(F.size("held"), F.lit(0)).alias("n_mechanisms"))


def explain_paths(paths: DataFrame, edges: DataFrame, cited: DataFrame) -> DataFrame:
    """path_id, n_edges, eligible, connected, verdict: a path is explained only if each of its edges may be used.

    paths: path_id, edge_ids in order. An edge may be used if it supports, is verified, isn't tier D and is cited. The ends
    reached so far are folded along the path.
    """
    step = paths.select("path_id", F.posexplode("edge_ids").alias("k", "id"))
    known = edges.join(cited.select(F.col("edge_id").alias("id")).distinct(), "id", "left_semi").where("stance = 'supports' and status = 'verified' and tier != 'D'")
    joined = step.join(known.select("id", "src", "dst"), "id", "left")
    whole = joined.groupBy("path_id").agg(F.count("*").alias("n_edges"), F.count("src").alias("n_ok"), F.array_sort(F.collect_list(F.struct("k", "src", "dst"))).alias("steps"))  # a path's few edges
    none = F.array().cast("array<string>")
    # from the ends reached so far, the edge leads to its other end
    onward = lambda acc, e: F.concat(F.when(F.array_contains(acc, e["src"]), F.array(e["dst"])).otherwise(none), F.when(F.array_contains(acc, e["dst"]), F.array(e["src"])).otherwise(none))
    ends = F.aggregate("steps", none, lambda acc, e: F.when(e["k"] == 0, F.array(e["src"], e["dst"])).otherwise(onward(acc, e)))
    ok = F.col("n_ok") == F.col("n_edges")
    linked = ok & (F.size(ends) > 0)
    verdict = F.when(~ok, "ineligible_edge").when(~linked, "not_connected").otherwise("explained")
    return whole.select("path_id", "n_edges", ok.alias("eligible"), linked.alias("connected"), verdict.alias("verdict"))
