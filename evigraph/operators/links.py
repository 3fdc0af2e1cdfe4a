"""Predicates on edges, link sets, shared-target pairs, bridges and inferred links.

Pairs come from an equality join on the shared target, never from all pairs of diseases; contradicting edges never
count as support.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live() -> Column:
    return F.col("status") != "rejected"


def supported(mode: str = "verified") -> Column:
    """Support that counts: 'verified' edges, or every 'usable' one (not rejected)."""
    if mode not in ("verified", "usable"):
        raise ValueError(mode)
    return (F.col("stance") == "supports") & ((F.col("status") == "verified") if mode == "verified" else live())


def view(edges: DataFrame, nodes: DataFrame, types: list[str]) -> DataFrame:
    """Edges whose two ends are of the enabled node types."""
    ids = nodes.where(F.col("type").isin(types)).select("id")
    out = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return out.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def links(edges: DataFrame, disease: str, target: str, mode: str = "verified") -> DataFrame:
    """disease, target: distinct supported links of one edge type."""
    return edges.where(supported(mode)).select(F.col(disease).alias("disease"), F.col(target).alias("target")).distinct()


def shared_pairs(link: DataFrame) -> DataFrame:
    """a, b, target with a < b: diseases that share the target."""
    x = link.select(F.col("disease").alias("a"), "target")
    y = link.select(F.col("disease").alias("b"), "target")
    return x.join(y, "target").where("a < b")


#: About how many diseases a list of those that a target has.
LIST = 1000


def gathered(rows: DataFrame, key: str) -> DataFrame:
    """rows beside each other by key: what is unfolded of their lists and grouped by the key and more is not shuffled again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def met(link: DataFrame, own: DataFrame, about: Callable[[Column, Column], Column], existing: DataFrame | None = None) -> DataFrame:
    """a, target, x, others (b, v): each link of a with the diseases after it that share the target, gathered by a.

    own: disease, target, x of each link; v is about(x of a, x of b); pairs that an existing edge links, whatever its direction,
    are left out. A pair costs what v and the name of b take in a list, and is shuffled once.
    """
    rows = link.join(own, ["disease", "target"])
    parts = F.ceil(F.count("*").over(Window.partitionBy("target")) / LIST)
    lists = rows.withColumn("part", F.pmod(F.xxhash64("disease"), parts)).groupBy("target", "part").agg(F.collect_list(F.struct("disease", "x")).alias("others")).drop("part")
    mine, after = rows.withColumnRenamed("disease", "a"), lambda o: o["disease"] > F.col("a")
    if existing is not None:
        known = existing.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a").agg(F.collect_set("b").alias("known"))  # what a disease is linked with
        mine = mine.join(known, "a", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
        after = lambda o: (o["disease"] > F.col("a")) & ~F.array_contains("known", o["disease"])
    pairs = mine.join(lists, "target").select("a", "target", "x", F.transform(F.filter("others", after), lambda o: F.struct(o["disease"].alias("b"), about(F.col("x"), o["x"]).alias("v"))).alias("others"))
    return gathered(pairs.where(F.size("others") > 0), "a")


def _counted(link: DataFrame, own: DataFrame, about: Callable[[Column, Column], Column], existing: DataFrame | None = None) -> DataFrame:
    """a, b, n_shared, v of pairs that share a target; v, a number, is the same for each target. own: disease, x."""
    pairs = met(link, link.join(own, "disease"), about, existing).select("a", F.explode("others").alias("o"))
    return pairs.groupBy("a", F.col("o.b").alias("b")).agg(F.count("*").alias("n_shared"), F.max("o.v").alias("v"))


def pair_counts(link: DataFrame) -> DataFrame:
    return _counted(link, link.select("disease", F.lit(1).alias("x")).distinct(), lambda mine, theirs: F.lit(1)).drop("v")


def without_existing(pairs: DataFrame, existing: DataFrame) -> DataFrame:
    """Pairs that no existing edge links, whatever its direction."""
    known = existing.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.join(known, ["a", "b"], "left_anti")


def jaccard(link: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """a, b, n_shared, jaccard, strength (clamped to 0.05..0.95, half-even on the double to 2 places) for pairs with a shared target."""
    sizes = link.groupBy("disease").agg(F.count("*").alias("x"))
    pairs = _counted(link, sizes, lambda mine, theirs: mine + theirs, existing)
    raw = F.col("n_shared").cast("double") / (F.col("v") - F.col("n_shared"))
    return pairs.select("a", "b", "n_shared", raw.alias("jaccard"), strength(raw).alias("strength"))


def strength(jaccard_: Column) -> Column:
    return two_places(F.least(F.greatest(jaccard_, F.lit(0.05)), F.lit(0.95)))


def two_places(x: Column) -> Column:
    """A double of 0.05 to 1 rounded half-even to two places, as its exact binary value asks: 0.125 to 0.12, 0.285 to 0.28."""
    n = (x * float(1 << 57)).cast("long") * 25  # such doubles are whole multiples of 2**-57, so n / 2**55 is the exact percentage
    whole, rest = F.shiftright(n, 55), n.bitwiseAND(F.lit((1 << 55) - 1))
    up = (rest > (1 << 54)) | ((rest == (1 << 54)) & (whole % 2 == 1))
    return (whole + up.cast("long")) / 100.0


def inferred(edges: DataFrame, existing: DataFrame, disease: str, target: str, mode: str = "usable") -> DataFrame:
    """One link for each pair and shared target, with the two edges that it is derived from."""
    use = edges.where(supported(mode))
    x = use.select(F.col(disease).alias("a"), F.col(target).alias("via_id"), F.col("id").alias("edge_a"), F.col("n_records").alias("ev_a"))
    y = use.select(F.col(disease).alias("b"), F.col(target).alias("via_id"), F.col("id").alias("edge_b"), F.col("n_records").alias("ev_b"))
    pairs = without_existing(x.join(y, "via_id").where("a < b"), existing)
    return pairs.select("a", "b", "via_id", "edge_a", "edge_b", (F.col("ev_a") + F.col("ev_b")).alias("n_evidence"))


def weights(mechanisms: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """Pair weight: 3 for each shared mechanism and 1 for each shared phenotype, for pairs that share a mechanism.

    Phenotypes are counted for those pairs only, so a phenotype of very many diseases makes no further pairs.
    """
    has = phenotypes.groupBy("disease").agg(F.collect_set("target").alias("x"))  # a disease's phenotypes
    own = mechanisms.select("disease").distinct().join(has, "disease", "left").withColumn("x", F.coalesce("x", F.array().cast("array<string>")))
    out = _counted(mechanisms, own, lambda mine, theirs: F.size(F.array_intersect(mine, theirs)))
    out = out.select("a", "b", F.col("n_shared").alias("n_mechanisms"), F.col("v").cast("long").alias("n_phenotypes"))
    return out.withColumn("weight", 3 * F.col("n_mechanisms") + F.col("n_phenotypes"))


def memberships(mechanism_cluster: DataFrame, disease_mechanism: DataFrame, parents: DataFrame, disease_targets: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """node_id, cluster_id, spread in three passes: mechanism to disease, child to parent, disease to its other nodes."""
    own = links(disease_mechanism, "src", "dst").join(mechanism_cluster.withColumnRenamed("node_id", "target"), "target").select(F.col("disease").alias("node_id"), "cluster_id")
    up = parents.select(F.col("src").alias("node_id"), "dst").join(own, "node_id").select(F.col("dst").alias("node_id"), "cluster_id")
    diseases = own.unionByName(up).distinct()
    out = mechanism_cluster.unionByName(diseases)
    for edges, disease, other in disease_targets:
        found = edges.where("stance = 'supports'").select(F.col(disease).alias("node_id"), F.col(other).alias("other"))
        out = out.unionByName(found.join(diseases, "node_id").select(F.col("other").alias("node_id"), "cluster_id"))
    return out.distinct()


def bridge_flags(edges: DataFrame, memberships: DataFrame) -> DataFrame:
    """Edges with a flag: both ends have clusters, and share none."""
    sets = memberships.groupBy("node_id").agg(F.collect_set("cluster_id").alias("own"))  # a node's clusters
    out = edges.join(sets.select(F.col("node_id").alias("src"), F.col("own").alias("x")), "src", "left")
    out = out.join(sets.select(F.col("node_id").alias("dst"), F.col("own").alias("y")), "dst", "left")
    return out.withColumn("bridge", F.coalesce(~F.arrays_overlap("x", "y"), F.lit(False))).drop("x", "y")


def centrality(edges: DataFrame) -> DataFrame:
    """node_id, degree, centrality (degree over the largest), over observed edges: an inferred one (tier C) adds nothing."""
    ends = edges.where(live() & (F.col("tier") != "C")).select(F.explode(F.array("src", "dst")).alias("node_id"))
    degree = ends.groupBy("node_id").agg(F.count("*").alias("degree"))
    top = degree.agg(F.greatest(F.max("degree"), F.lit(1)).alias("top"))
    return degree.crossJoin(F.broadcast(top)).select("node_id", "degree", (F.col("degree") / F.col("top")).alias("centrality"))  # one row


def two_hop(edges: DataFrame, start: DataFrame, nodes: DataFrame, types: list[str]) -> DataFrame:
    """start, node_id, hops: nodes of the visible types within two steps of each start (its smallest distance)."""
    seen = view(edges, nodes, types)
    both = seen.select(F.col("src").alias("x"), F.col("dst").alias("y")).unionByName(seen.select(F.col("dst").alias("x"), F.col("src").alias("y"))).distinct()
    zero = start.select(F.col("id").alias("start"), F.col("id").alias("node_id"), F.lit(0).alias("hops"))
    one = zero.join(both, F.col("node_id") == F.col("x")).select("start", F.col("y").alias("node_id"), F.lit(1).alias("hops"))
    two = one.select("start", "node_id").distinct().join(both, F.col("node_id") == F.col("x")).select("start", F.col("y").alias("node_id"), F.lit(2).alias("hops"))
    return zero.unionByName(one).unionByName(two).groupBy("start", "node_id").agg(F.min("hops").alias("hops"))
