from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from evigraph.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def tree(level, fanout):
    """All levels, from the leaves to one node."""
    out = [level]
    while len(level) > 1:
        level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        out.append(level)
    return out


def walk(levels, i, fanout, own):
    """The siblings of leaf i, and what `own` folds to."""
    siblings = []
    for level in levels[:-1]:
        run, at = level[i // fanout * fanout :][:fanout], i % fanout
        siblings += run[:at] + run[at + 1 :]
        own = h(*run[:at], own, *run[at + 1 :])
        i //= fanout
    return siblings, own


def brute(rows, fanout=3):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r, leaf(r, r["text"])))
    trees = {}
    for s, own in by.items():
        own.sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"], x[1]))
        trees[s] = tree([x[1] for x in own], fanout)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = tree([trees[s][-1][0] for s in order], fanout)
    out = []
    for k, s in enumerate(order):
        for i, (r, own) in enumerate(by[s]):
            cut = crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 2 == 0
            seen = leaf(r, r["text"].replace("\n", "")) if cut and r["text"] is not None else own
            low, folded = walk(trees[s], i, fanout, seen)
            high, folded = walk(top, k, fanout, folded)
            out.append((r["doc_id"], own, trees[s][-1][0], top[-1][0], h(*low, *high), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def test_whole_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = merkle.digest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == brute(docs.collect())
    assert 0 < sum(not r[-1] for r in rows) < len(rows)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_buckets_of_every_size_give_one_tree(spark, levels):
    """A source of 100 leaves, others of 1, 3 and 10, one without a name: superblocks of 3, 9 and 2,187 leaves."""
    rows = [(i, f"{'x' * (i % 5)}\n{i}", "en", s, i) for s, n in (("hot", 100), (None, 4), ("a", 1), ("b", 3), ("ä", 10)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    proofs = merkle.verified(merkle.manifest(docs, levels=levels, seen=merkle.tampered()), "seen")
    got = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256), "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs.collect())


def test_other_fanout_and_untouched_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % 3}", i) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    proofs = merkle.verified(merkle.manifest(docs, fanout=4, levels=2))
    assert proofs.where("not verified").isEmpty() and proofs.select("root").distinct().count() == 1


def test_odd_rows(odd):
    """Nulls in every column, repeated rows, an id again, very long texts, columns with clashing names."""
    got = merkle.digest(odd.withColumn("leaf", F.lit("x")).withColumn("_group", F.lit("y")).withColumn("seen", F.lit("z")))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(odd.collect())


def test_one_row_and_none(spark, odd, none):
    assert merkle.digest(none).collect() == []
    one = odd.where("doc_id = 9")
    row = merkle.digest(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof_sha256"] == h() and row["verified"]


def test_numbers_do_not_depend_on_partitions(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    roots = {merkle.manifest(d).first()["root"] for d in (docs, docs.repartition(5), docs.orderBy(F.desc("doc_id")))}
    assert len(roots) == 1


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "a\n" * 2_000_000, "en", "s", 1), (2, None, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, merkle.digest(docs).collect()), key=repr) == brute(docs.collect())
