"""Every registered query of the graph against its SQL, over whole tables."""

import duckdb
import pytest

from evigraph.plans import catalogue, oracle

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{tiny}/{t}.parquet')")
    return con


def plain(rows, columns):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    cell = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else float(v) if isinstance(v, (int, bool)) else v
    return order, sorted((tuple(cell(r[i]) for i in at) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query_equals_sql(spark, tiny, db, name):
    got = catalogue.QUERIES[name](spark, tiny)
    want = db.sql(oracle.ORACLE_SQL[name])
    a, b = plain([tuple(r) for r in got.collect()], got.columns), plain(want.fetchall(), want.columns)
    assert a[0] == b[0] and len(a[1]) == len(b[1])
    for x, y in zip(a[1], b[1], strict=True):
        assert all(p == q or (isinstance(p, float) and abs(p - q) <= 1e-6 * max(1, abs(p))) for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(oracle.ORACLE_SQL)))
def test_other_queries_run(spark, tiny, name):
    assert catalogue.QUERIES[name](spark, tiny).collect()


def test_all_rows_are_evidence(spark, tiny, db):
    got = catalogue.QUERIES["evidence_by_source"](spark, tiny).agg({"n": "sum"}).first()[0]
    assert got == db.sql("select count(*) from lineitem").fetchall()[0][0]


def test_pairs_over_all_rows(spark, tiny, db):
    """Against pairs made here, one mechanism after the other."""
    links = {(m, d) for m, d in db.sql("select distinct l_suppkey, 'd' || l_partkey from lineitem where l_returnflag = 'A' and l_linestatus = 'F'").fetchall()}
    of = {}
    for m, d in links:
        of.setdefault(m, set()).add(d)
    want = {}
    for ds in of.values():
        for a in ds:
            for b in ds:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    got = catalogue.QUERIES["shared_mechanism_pairs"](spark, tiny).collect()
    assert {(r["a"], r["b"]): r["n_shared"] for r in got} == want
