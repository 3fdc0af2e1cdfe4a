"""Who may open what: a role-by-panel matrix, and its rules and those of rows as SQL functions of a session.

    access.register(spark)
    spark.sql("select may_open(role, panel), is_reduced(role, panel) from requests")
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Roles in their order, panels, and what each role may open; 'reduced' panels are a subset of a role's own.
ROLES = ("leader", "patient", "scout", "researcher", "admin")
PANELS = (
    "search", "clusters", "graph", "explain", "evidence", "contradictions", "noRoute", "community",
    "action", "assets", "mechanismRanking", "people", "funding", "nextStep", "admin",
)
OPEN = {
    "leader": ("search", "clusters", "graph", "explain", "evidence", "contradictions", "noRoute", "community", "action", "assets", "people", "funding", "nextStep"),
    "patient": ("search", "explain", "evidence", "noRoute", "community", "action", "nextStep"),
    "scout": ("search", "clusters", "graph", "explain", "evidence", "contradictions", "noRoute", "community", "assets", "mechanismRanking", "people", "funding", "nextStep"),
    "researcher": ("search", "clusters", "graph", "explain", "evidence", "contradictions", "noRoute", "community", "assets", "people", "funding", "nextStep"),
    "admin": PANELS,
}
REDUCED = {
    "leader": ("people", "funding"),
    "patient": ("search", "evidence", "action", "nextStep"),
    "scout": ("graph", "explain", "community"),
    "researcher": ("explain", "community"),
    "admin": (),
}
#: Stored role of each role of the matrix.
STORED = {"leader": "group_leader", "patient": "family", "scout": "scout", "researcher": "researcher", "admin": "admin"}


def check_matrix(opened: dict[str, tuple[str, ...]], reduced: dict[str, tuple[str, ...]]) -> list[str]:
    """What is wrong with a matrix: unknown panels, and reduced panels that the role can't open."""
    out = [f"{role}: unknown panel {p}" for role, panels in opened.items() for p in panels if p not in PANELS]
    return out + [f"{role}: reduced but not open: {p}" for role, panels in reduced.items() for p in panels if p not in opened.get(role, ())]


def _pairs(matrix: dict[str, tuple[str, ...]]) -> list[str]:
    return [f"{role}/{panel}" for role in ROLES for panel in matrix[role]]


def may_open(role: Column, panel: Column) -> Column:
    """False for unknown roles and panels, and for nulls."""
    return F.coalesce(F.concat_ws("/", role, panel).isin(_pairs(OPEN)) & role.isNotNull() & panel.isNotNull(), F.lit(False))


def is_reduced(role: Column, panel: Column) -> Column:
    return F.coalesce(F.concat_ws("/", role, panel).isin(_pairs(REDUCED)) & role.isNotNull() & panel.isNotNull(), F.lit(False))


def role_with_full(panel: Column) -> Column:
    """The first role that has the whole of a panel; the administrator for one that nobody else has."""
    full = {p: next((r for r in ROLES if p in OPEN[r] and p not in REDUCED[r]), "admin") for p in PANELS}
    out = F.when(F.lit(False), F.lit(""))
    for p, r in full.items():
        out = out.when(panel == p, r)
    return out.otherwise("admin")


def _in(pairs: list[str]) -> str:
    return ", ".join(f"'{p}'" for p in pairs)


def register(spark: SparkSession, assigned: str | None = "assigned_roles", members: str | None = "organization_members") -> None:
    """Temporary SQL functions of the session, each a Catalyst expression: no Python runs for them.

    may_open(role, panel), is_reduced(role, panel), role_with_full(panel), stored_role(role); sees_edge(role, status): a
    row-level rule for stored roles; sees_contacts(role). Where the tables or views `assigned` (user_id, role) and
    `members` (user_id, org_id) exist: role_of(user_id), the stored assignment alone, and in_org(user_id, org_id).
    """
    wrong = check_matrix(OPEN, REDUCED)
    if wrong:
        raise ValueError(wrong)
    full = " ".join(f"when '{p}' then '{next((r for r in ROLES if p in OPEN[r] and p not in REDUCED[r]), 'admin')}'" for p in PANELS)
    kept = " ".join(f"when '{r}' then '{s}'" for r, s in STORED.items())
    contacts = _in([s for s in STORED.values() if s != "family"])
    bodies = {
        "may_open(role string, panel string) returns boolean": f"coalesce(role || '/' || panel in ({_in(_pairs(OPEN))}), false)",
        "is_reduced(role string, panel string) returns boolean": f"coalesce(role || '/' || panel in ({_in(_pairs(REDUCED))}), false)",
        "role_with_full(panel string) returns string": f"case panel {full} else 'admin' end",
        "stored_role(role string) returns string": f"case role {kept} end",
        "sees_edge(role string, status string) returns boolean": "coalesce(role = 'admin', false) or coalesce(status = 'verified', false)",
        "sees_contacts(role string) returns boolean": f"coalesce(role in ({contacts}), false)",
    }
    if assigned and spark.catalog.tableExists(assigned):
        bodies["role_of(user string) returns string"] = f"(select min(a.role) from {assigned} a where a.user_id = role_of.user)"
    if members and spark.catalog.tableExists(members):
        bodies["in_org(user string, org string) returns boolean"] = f"exists (select 1 from {members} m where m.user_id = in_org.user and m.org_id = in_org.org)"
    for head, body in bodies.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
