"""Who sees what, contributions and their review, and overlays of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible_edges(edges: DataFrame, role: str) -> DataFrame:
    """Verified edges; administrators see all."""
    return edges if role == "admin" else edges.where("status = 'verified'")


def visible_evidence(evidence: DataFrame, edges: DataFrame, role: str) -> DataFrame:
    return evidence.join(visible_edges(edges, role).select(F.col("id").alias("edge_id")), "edge_id", "left_semi")


def visible_cache(cache: DataFrame, edges: DataFrame, role: str) -> DataFrame:
    """Cached paths of the audience all of whose edges the role may see. cache: cache_key, audience, edge_ids."""
    steps = cache.select("cache_key", F.explode("edge_ids").alias("id"))
    hidden = steps.join(visible_edges(edges, role).select("id"), "id", "left_anti").select("cache_key").distinct()
    return cache.where(F.col("audience") == role).join(hidden, "cache_key", "left_anti")


def contributions(submitted: DataFrame, reviews: DataFrame) -> DataFrame:
    """Submissions with their state: the first review counts; a rejection needs a note, else it is no review.

    submitted: id, src, dst; reviews: id, decision, note, at.
    """
    valid = reviews.where("decision = 'approved' or (decision = 'rejected' and trim(note) != '')")
    first = valid.groupBy("id").agg(F.min(F.struct("at", "decision")).alias("r"))
    state = F.when(F.col("r.decision") == "approved", "verified").when(F.col("r.decision") == "rejected", "rejected").otherwise("unverified")
    return submitted.join(first, "id", "left").select("id", "src", "dst", state.alias("status"))


def with_contributions(edges: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Edges, and those of approved contributions: tier D, verified."""
    new = reviewed.where("status = 'verified'").select(
        F.concat_ws("|", F.lit("contributed"), "id").alias("id"), "src", "dst", F.lit("contributed").alias("type"), F.lit("D").alias("tier"), F.lit("supports").alias("stance"), "status"
    )
    return edges.select(new.columns).unionByName(new)


def decided(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Edges with the overlay of decisions (edge_id, decision) applied."""
    d = decisions.select(F.col("edge_id").alias("id"), "decision")
    status = F.when(F.col("decision") == "approved", "verified").when(F.col("decision") == "rejected", "rejected").otherwise(F.col("status"))
    return edges.join(d, "id", "left").withColumn("status", status).drop("decision")


def review_queue(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Inferred and contributed edges with their decision, the undecided ones first."""
    d = decisions.select(F.col("edge_id").alias("id"), "decision")
    rows = edges.where("tier in ('C', 'D')").join(d, "id", "left")
    return rows.orderBy(F.col("decision").isNotNull(), "type", "id")


def sessions(sessions: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Sessions that have not expired: user_id, started_at."""
    return sessions.where(F.col("started_at") + F.expr(f"interval {days} days") > F.lit(now).cast("timestamp"))


#: Roles that may see professional contacts.
CONTACT_ROLES = ("group_leader", "scout", "researcher", "admin")


def roles_of(users: DataFrame, assigned: DataFrame) -> DataFrame:
    """user_id, role: the stored assignment alone counts; without one there is no role. users: user_id; assigned: user_id, role."""
    return users.select("user_id").distinct().join(assigned.groupBy("user_id").agg(F.min("role").alias("role")), "user_id", "left")


def visible_contacts(contacts: DataFrame, nodes: DataFrame, role: str | None) -> DataFrame:
    """Contacts of nodes that are persons, for the four roles; others see none. contacts: person_node_id and more."""
    if role not in CONTACT_ROLES:
        return contacts.limit(0)
    people = nodes.where("type = 'person'").select(F.col("id").alias("person_node_id"))
    return contacts.join(people, "person_node_id", "left_semi")


def visible_contributions(sent: DataFrame, viewers: DataFrame, members: DataFrame) -> DataFrame:
    """user_id, id: administrators see all, leaders and researchers their own, leaders also those of their organisations.

    sent: id, created_by, org_id; viewers: user_id, role, a stated few; members: user_id, org_id.
    """
    admin = sent.select("id").crossJoin(F.broadcast(viewers.where("role = 'admin'").select("user_id")))  # the stated viewers
    own = sent.join(viewers.where("role in ('group_leader', 'researcher')").select(F.col("user_id").alias("created_by")), "created_by").select("id", F.col("created_by").alias("user_id"))
    of = viewers.where("role = 'group_leader'").join(members, "user_id").select("user_id", "org_id")
    theirs = sent.join(of, "org_id").select("id", "user_id")
    return admin.unionByName(own).unionByName(theirs).select("user_id", "id").distinct()


def cache_key(version: str, role: Column, edge_ids: Column, graph: Column) -> Column:
    """SHA-256 over version, role, the ordered path and the digest of the graph slice that it was explained from."""
    body = F.to_json(F.struct(F.lit(version).alias("version"), role.alias("role"), edge_ids.alias("edge_ids"), graph.alias("graph")))
    return F.sha2(body, 256)


def replace_cached(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with fresh rows; rows of the same audience and ordered path under another key go. Both: cache_key, audience, edge_ids, payload."""
    columns = ["cache_key", "audience", "edge_ids", "payload"]
    path = ["audience", "edge_ids"]
    kept = cache.join(fresh.select(*path).distinct(), path, "left_anti").join(fresh.select("cache_key"), "cache_key", "left_anti")
    return kept.select(columns).unionByName(fresh.select(columns))


def still_valid(cache: DataFrame, expected: DataFrame) -> DataFrame:
    """Cached rows whose payload equals what the current graph gives. expected: cache_key, payload."""
    return cache.join(expected.select("cache_key", F.col("payload").alias("_now")), "cache_key").where(F.col("payload") == F.col("_now")).drop("_now")


def fresh_snapshots(snapshots: DataFrame, now: str, max_age_hours: float, offline: bool = False) -> DataFrame:
    """Snapshots (fetched_at) young enough to be used; offline all are."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("fetched_at")
    return snapshots.where(F.lit(offline) | (age <= max_age_hours * 3600))


def request_errors(requests: DataFrame) -> DataFrame:
    """id, error: the first bound that a request breaks. requests: id, query, edge_ids."""
    ids = F.coalesce("edge_ids", F.array().cast("array<string>"))
    error = (
        F.when(F.length(F.trim(F.coalesce("query", F.lit("")))) > 300, "query_too_long")
        .when(F.size(ids) > 12, "too_many_edges")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated_edge")
        .when(F.exists(ids, lambda i: ~i.rlike("^[A-Za-z0-9_|.# -]{1,200}$")), "invalid_edge_id")
    )
    return requests.select("id", error.alias("error")).where("error is not null")
