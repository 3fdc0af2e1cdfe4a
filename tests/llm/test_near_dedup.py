import random
import re

import numpy as np

from evigraph.llm import near_dedup, queries

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows, n, percent):
    """doc_id -> (set size, smallest reachable doc_id)."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    of = {}
    for i, s in sets:
        for x in s:
            of.setdefault(x, set()).add(i)
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = dict(sets)
    for i, s in sets:
        for j in {j for x in s for j in of[x] if j < i}:
            both = len(s & by[j])
            if 100 * both >= percent * (len(s) + len(by[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query_on_whole_table(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    out = queries.op10_near_dedup(spark, small)
    assert got(out) == brute(rows, 2, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.collect())


def test_odd_texts(odd):
    rows = {}
    for r in odd.collect():
        if r["doc_id"] is not None and r["doc_id"] != 7:
            rows[r["doc_id"]] = r["text"]
    out = near_dedup.near_dedup(odd.where("doc_id is null or doc_id != 7"), n=2).collect()
    want = brute(list(rows.items()), 2, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in out if r["doc_id"] is None] == [None, None]
    assert len(out) == odd.where("doc_id is null or doc_id != 7").count()


def test_groups_chains_and_pairs_at_the_threshold(spark):
    rng = random.Random(3)
    rows, i = [], 0
    for group in range(30):
        words = [f"g{group}w{k}" for k in range(101)]  # 100 shingles of two words
        for _ in range(12):
            out = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                out[rng.randrange(len(out))] = f"n{rng.random()}"
            rows.append((i, " ".join(out)))
            i += 1
    # a chain of texts, each near to the next only
    words = [f"c{k}" for k in range(400)]
    for k in range(0, 200, 10):
        rows.append((i, " ".join(words[k : k + 120])))
        i += 1
    # exactly at the threshold and just below: 80 of 100, 79 of 100
    a = [f"t{k}" for k in range(91)]
    rows += [(i, " ".join(a)), (i + 1, " ".join(a[10:] + [f"u{k}" for k in range(10)])), (i + 2, " ".join(a[11:] + [f"v{k}" for k in range(11)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_dedup.near_dedup(docs, n=2)) == brute(rows, 2, 80)


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    for share in (0.95, 0.9, 0.8):
        m = int(1000 * (1 - share) / (1 + share))
        other = np.concatenate([base[m:], rng.integers(0, 1 << 63, m, dtype=np.uint64)])
        x, y = (near_dedup.odd_sketch(near_dedup.minhash(np.unique(s))) for s in (base, other))
        bits = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
        assert bits <= near_dedup.most_different_bits(0.8)


def test_components(spark):
    from evigraph.llm.components import connected_components

    chain = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(2001, 2000)]
    edges = spark.createDataFrame(chain, "u long, v long")
    labels = {r["vertex"]: r["component"] for r in connected_components(edges).collect()}
    assert labels == {**{k: 0 for k in range(301)}, **{k: 1000 for k in range(1000, 1400)}, 2000: 2000, 2001: 2000}


def test_empty_table(none):
    assert near_dedup.near_dedup(none).collect() == []
