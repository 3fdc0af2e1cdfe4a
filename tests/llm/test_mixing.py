import re
from collections import Counter
from fractions import Fraction

import pytest

from evigraph.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Water filling by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, free = {}, set(names)
    while free:
        left = sum(sizes.values()) - sum(out.values())
        total = sum(weight[s] for s in free)
        over = {s for s in free if Fraction(left * weight[s], total) > 3 * sizes[s]}
        if not over:
            return out | {s: Fraction(left * weight[s], total) for s in free}
        out |= {s: 3 * sizes[s] for s in over}
        free -= over
    return out


def check(rows, got):
    sizes = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    by = Counter()
    for i, t, s in rows:
        by[s] += sizes[i]
    want, taken = targets(by), Counter()
    source = {i: s for i, _, s in rows}
    assert len(got) == len(rows)
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (sizes[r["doc_id"]], by[s])
        assert r["target"] == pytest.approx(float(want[s]), rel=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    return want, taken


def test_query_on_whole_table(spark, small):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = queries.op4_mixing(spark, small).collect()
    want, taken = check(rows, got)
    for s in want:
        largest = max(r["size"] for r in got if r["doc_id"] in {i for i, _, x in rows if x == s})
        assert abs(taken[s] - float(want[s])) <= largest
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op4_mixing(spark, small).collect()))


def test_odd_texts(odd):
    frame = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = [(r["doc_id"], r["text"], r["source"]) for r in frame.collect()]
    check(rows, mixing.digest(mixing.mix_counts(frame)).collect())
    assert mixing.mix_counts(odd).count() == odd.count()


def test_caps_and_empty_sources(spark):
    rows = [(1, "a " * 10, "a"), (2, "b " * 1000, "b"), (3, "c " * 50, None), (4, None, "d"), (5, "", "d"), (6, "e " * 3, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, _ = check(rows, mixing.digest(mixing.mix_counts(docs)).collect())
    assert want["a"] == 30 and want["d"] == 0


def test_systematic_sampling_emits_whole_rows(spark):
    rows = [(i, "w " * (1 + i % 40), "hot" if i % 3 else "cold", i) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_counts(docs).collect()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({i: n for i, n in copies.items() if n})
    for s in ("hot", "cold"):  # copies differ by one at most within a source
        assert len({copies[r[0]] for r in rows if r[2] == s}) <= 2


def test_repeated_rows_and_ids_fill_no_bucket(spark):
    """Many equal rows, one id on many texts, null ids: all are rows of their own, and reruns agree."""
    rows = [(1, "a b c", "hot", 0)] * 70_000 + [(None, "w " * (i % 90), "hot", i) for i in range(3000)] + [(5, "w " * (i % 9), "cold", i) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(4)
    out = mixing.mix_counts(docs).groupBy("source").agg({"*": "count", "copies": "sum"}).collect()
    assert {r["source"]: r["count(1)"] for r in out} == {"hot": 73_000, "cold": 2000}
    copies = {r["source"]: r["sum(copies)"] for r in out}
    for s, n in {"hot": 73_000, "cold": 2000}.items():
        target = mixing.mix_counts(docs).where(f"source = '{s}'").selectExpr("max(target / source_size) r").first()["r"]
        assert abs(copies[s] - target * n) <= 1
    a, b = (Counter(map(tuple, mixing.mix(d).collect())) for d in (docs, docs.repartition(7)))
    assert a == b and sum(a.values()) == sum(copies.values())
    assert set(a) <= set(rows)


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "a " * 1_000_000, "x"), (2, "b" * 2_000_000, "x"), (3, " " * 2_000_000, "y")], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["size"] for r in mixing.mix_counts(docs).collect()} == {1: 1_000_000, 2: 1, 3: 0}


def test_empty_table(none):
    assert mixing.mix_counts(none).collect() == [] and mixing.mix(none).collect() == []
