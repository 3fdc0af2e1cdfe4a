import re
from itertools import permutations

from evigraph.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    smallest = {}
    for d in docs:
        if d["doc_id"] is not None:
            smallest[d["text"] or ""] = min(smallest.get(d["text"] or "", d["doc_id"]), d["doc_id"])
    good = {r["doc_id"] for r in labels if r["doc_id"] is not None and r["quality"] == 1}
    toxic = {r["doc_id"] for r in labels if r["doc_id"] is not None and r["toxic"] == 1}
    parts = {}
    for d in docs:
        t = d["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)}
        fails |= {"D": bool(re.search(r"[#$%&*|]", t)), "E": d["doc_id"] is not None and d["doc_id"] > smallest[t]}
        parts.setdefault(d["lang"] or "", []).append(({f for f, x in fails.items() if x}, d["doc_id"] in good, d["doc_id"] in toxic))
    out = []
    for part, own in parts.items():
        rows, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                redundant = sum(f in x[0] for x in own) - len(gone)
                left = [x for x in left if f not in x[0]]
                total[f] += len(gone)
                rows.append((part, "".join(order), k + 1, len(left), len(gone), redundant, sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        out += [(*r, total[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def result(docs, labels):
    return sorted(map(tuple, filter_audit.audit(docs, labels).collect()))


def test_whole_table(spark, tiny):
    docs, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    got = filter_audit.audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert [t for _, t in got.dtypes] == ["string", "string", "int"] + ["bigint"] * 7
    assert sorted(map(tuple, got.collect())) == brute(docs.collect(), labels.collect())


def test_odd_rows(spark, odd):
    """Nulls in every column, repeated rows and ids, labels twice, columns with clashing names; limits met exactly."""
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (7, None, 1), (None, 1, 1), (99, 1, 1), (5, 1, None)], LABELS)
    assert result(odd, labels) == brute(odd.collect(), labels.collect())
    words = " ".join(f"w{i}" for i in range(100))
    rows = [(1, f"{words} {words}", "en"), (2, f"{words} {words}", "en"), (3, f"{words} {words} w1", "en"), (4, "A" * 3 + "b" * 97, None), (5, "A" * 4 + "b" * 96, ""), (6, "x|", "en"), (6, "x|", "en"), (6, "x|", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"mask": filter_audit.F.lit(1), "n": filter_audit.F.lit(2), "_row": filter_audit.F.lit("r"), "word": filter_audit.F.lit("w")})
    assert result(docs, labels) == brute(docs.collect(), labels.collect())


def test_many_copies_and_long_texts(spark):
    rows = [(i, "the same text again", "en") for i in range(3000)] + [(5000, "lorem ipsum " * 300_000, "en"), (5001, "y" * 1_000_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(0, 3000, 3)], LABELS)
    assert result(docs, labels) == brute(docs.collect(), labels.collect())


def test_no_rows(spark, none):
    assert result(none, spark.createDataFrame([], LABELS)) == []


def test_no_labels(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert result(docs, spark.createDataFrame([], LABELS)) == brute(docs.collect(), [])
