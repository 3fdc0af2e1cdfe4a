import re
from difflib import SequenceMatcher
from random import Random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evigraph.operators import reconcile

NODES = "id string, type string, name string, synonyms array<string>"


def norm(s):
    return re.sub(r"[^a-z0-9]+", " ", (s or "").lower()).strip()


WORDS = "congenital hereditary infantile epileptic ataxia myopathy dystrophy syndrome disorder type deficiency 1 2 xii".split()


def misspelt(rng, text):
    """Another first letter, a letter left out, two letters changed places, a word doubled."""
    how = rng.randrange(4)
    at = 0 if how == 0 else rng.randrange(max(1, len(text) - 1))
    if how == 0:
        return rng.choice("xyz") + text[1:]
    if how == 1:
        return text[:at] + text[at + 1 :]
    if how == 2:
        return text[:at] + text[at + 1 : at + 2] + text[at : at + 1] + text[at + 2 :]
    return text + " " + text.split()[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("ab c1", min_size=1, max_size=14), st.text("ab c1", min_size=1, max_size=14), st.sampled_from([0.7, 0.8, 0.9]))
def test_texts_alike_share_a_key(a, b, ratio):
    a, b = norm(a), norm(b)
    if a and b and SequenceMatcher(None, a, b).ratio() >= ratio:
        rare = {p: i for i, p in enumerate(sorted({t[i : i + 2] for t in (b,) for i in range(len(t) - 1)}))}
        assert set(reconcile.keys_of(a, rare, ratio)) & set(reconcile.keys_of(b, rare, ratio))


def test_similarity_join_loses_no_pair(spark):
    """All pairs of some hundred names with misspelt beginnings, of every length."""
    rng = Random(3)
    names = sorted({norm(" ".join(rng.choices(WORDS, k=rng.randint(1, 5)))) for _ in range(250)} | set("a b ab ba abc abd abcd abce x1 x2 abcde abcdf".split()))
    texts = sorted({norm(misspelt(rng, n)) for n in names} | {"abc", "xbcd", "b"})
    frame = lambda keys: spark.createDataFrame([("disease", k) for k in keys if k] + [("gene", "abc")], "type string, key string")
    got = {(r["type"], r["text_key"], r["name_key"]): r["ratio"] for r in reconcile.similar(frame(texts).repartition(3), frame(names)).collect()}
    want = {("disease", t, n): r for t in texts if t for n in names if (r := SequenceMatcher(None, t, n).ratio()) >= 0.8} | {("gene", "abc", "abc"): 1.0}
    assert got == want and sum(t[0] != n[0] for _, t, n in want) > 50


def similarity(text, node):
    return max((SequenceMatcher(None, norm(text), norm(n)).ratio() for n in [node[2], *(node[3] or [])] if norm(n)), default=0.0)


def brute(claims, nodes, edges, type_of, most=5):
    index = {}
    for i, t, name, syn in sorted(nodes):
        for text in [name, *(syn or [])]:
            if norm(text):
                index.setdefault((t, norm(text)), i)
    out = []
    for claim, subject, relation, object_ in claims:
        known = None
        for side, t, text in (("subject", "disease", subject or ""), ("object", type_of[relation], object_ or "")):
            hit = index.get((t, norm(text)))
            if side == "subject":
                known = hit
            if hit:
                out.append((claim, side, t, text, "exact", hit, [], None))
                continue
            of = {d for s, d, r in edges if side == "object" and s == known and r == relation}
            pool = [(similarity(text, n), n[0]) for n in nodes if n[1] == t and n[0] in of and any(norm(x) for x in [n[2], *(n[3] or [])])]
            if not pool:
                pool = [(s, n[0]) for n in nodes if n[1] == t and norm(text) and (s := similarity(text, n)) >= 0.8]
            best = [(i, s) for s, i in sorted(pool, key=lambda x: (-x[0], x[1]))[:most]]
            slug = re.sub(r"[^a-z0-9]+", "_", f"{t}_{text}".lower()).strip("_")[:40].strip("_") or "x"
            out.append((claim, side, t, text, "review" if best else "new", None, best, None if best else slug))
    return sorted(out)


def test_claims_against_all_pairs(spark):
    rng = Random(8)
    names = sorted({" ".join(rng.choices(WORDS, k=3)) for _ in range(60)})
    nodes = [(f"d{i}", "disease", n.title(), [f"{n} (old name)", None] if i % 3 else None) for i, n in enumerate(names)]
    nodes += [(f"g{i}", "gene", g, [f"{g}-alpha"]) for i, g in enumerate(["SCN1A", "SCN2A", "SCN8A", "KCNQ2", "KCNQ3", "SCN9A", "SCN3A"])] + [("g9", "gene", "!!", None), ("d99", "disease", names[0].upper(), [])]
    edges = [(f"d{i}", f"g{j % 7}", "disease_gene") for i in range(0, 60, 2) for j in range(i % 8 + 2)] + [("d2", "d3", "disease_gene")]
    claims = [(i, n if i % 4 == 0 else misspelt(rng, n), "disease_gene", ["scn1a", "SCN2B", "KCNQ-2", "zzz", "", None, "TP53"][i % 7]) for i, n in enumerate(names)]
    claims += [(100, None, "disease_gene", None), (101, "nothing like it at all " * 4, "disease_gene", "scn1a alpha")]
    got = reconcile.reconciled(spark.createDataFrame(claims, "claim_id long, subject string, relation string, object string").repartition(3), spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, "src string, dst string, type string"), {"disease_gene": "gene"})
    rows = sorted((r["claim_id"], r["side"], r["type"], r["text"], r["outcome"], r["node_id"], [tuple(c) for c in r["candidates"]], r["proposed_id"]) for r in got.collect())
    want = brute(claims, nodes, edges, {"disease_gene": "gene"})
    assert rows == want
    assert {r[4] for r in rows} == {"exact", "review", "new"} and any(len(r[6]) == 5 for r in rows)
    new = {r["id"]: r["name"] for r in reconcile.proposed_nodes(got).collect()}
    assert new == {r[7]: min(x[3] for x in want if x[7] == r[7]) for r in want if r[7]}


def test_no_rows(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    got = reconcile.reconciled(none("claim_id long, subject string, relation string, object string"), none(NODES), none("src string, dst string, type string"), {"disease_gene": "gene"})
    assert got.collect() == []
    with pytest.raises(ValueError, match="ratio"):
        reconcile.similar(none("type string, key string"), none("type string, key string"), 0.5)
