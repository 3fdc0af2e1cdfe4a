"""The matrix as columns and as SQL functions, against plain Python."""

from pyspark.sql import functions as F

from evigraph.functions import access


def test_matrix_rules():
    assert access.check_matrix(access.OPEN, access.REDUCED) == []
    assert access.check_matrix({"scout": ("graph", "what")}, {"scout": ("people",)}) == ["scout: unknown panel what", "scout: reduced but not open: people"]


def test_sql_functions_equal_columns_and_python(spark):
    rows = [(r, p) for r in (*access.ROLES, "nobody", None) for p in (*access.PANELS, "nothing", None)]
    access.register(spark, assigned="no_such_table", members=None)
    spark.createDataFrame(rows, "role string, panel string").createOrReplaceTempView("asked")
    got = spark.sql("select role, panel, may_open(role, panel) o, is_reduced(role, panel) r, role_with_full(panel) f, stored_role(role) s, sees_contacts(stored_role(role)) c from asked").collect()
    cols = spark.table("asked").select("role", "panel", access.may_open(F.col("role"), F.col("panel")), access.is_reduced(F.col("role"), F.col("panel")), access.role_with_full(F.col("panel"))).collect()
    full = {p: next((r for r in access.ROLES if p in access.OPEN[r] and p not in access.REDUCED[r]), "admin") for p in access.PANELS}
    assert len(got) == len(rows)
    for x, y in zip(got, cols, strict=True):
        assert (x["o"], x["r"], x["f"]) == (y[2], y[3], y[4])
        assert x["o"] == (x["panel"] in access.OPEN.get(x["role"], ())) and x["r"] == (x["panel"] in access.REDUCED.get(x["role"], ()))
        assert x["f"] == full.get(x["panel"], "admin") and x["s"] == access.STORED.get(x["role"])
        assert x["c"] == (x["role"] in ("leader", "scout", "researcher", "admin"))
    assert full["people"] == "scout" and full["search"] == "leader" and full["mechanismRanking"] == "scout" and full["admin"] == "admin"


def test_functions_over_tables(spark):
    spark.createDataFrame([("u1", "scout"), ("u2", "family")], "user_id string, role string").createOrReplaceTempView("assigned_roles")
    spark.createDataFrame([("u1", "o1")], "user_id string, org_id string").createOrReplaceTempView("organization_members")
    access.register(spark)
    spark.createDataFrame([("u1", "o1"), ("u1", "o2"), ("u2", "o1"), ("u3", None)], "u string, org string").createOrReplaceTempView("asked_orgs")
    got = spark.sql("select u, org, role_of(u) r, in_org(u, org) i, sees_contacts(role_of(u)) c, sees_edge(role_of(u), 'unverified') e from asked_orgs").collect()
    assert {tuple(r) for r in got} == {("u1", "o1", "scout", True, True, False), ("u1", "o2", "scout", False, True, False), ("u2", "o1", "family", False, False, False), ("u3", None, None, False, False, False)}
