"""Small graphs by hand: contradictions never count as support, rules of the contract, visibility, paths, limits."""

import json

import pytest
from pyspark.sql import functions as F

from evigraph.functions import text
from evigraph.operators import actions, claims, connections, governance, links, quality, reports, search
from evigraph.sources import files
from evigraph.streaming import limits

E = "id string, src string, dst string, type string, tier string, stance string, status string, n_records long"


def mech(spark, rows):
    return spark.createDataFrame([(f"{s}|{m}|{st}", s, m, "disease_mechanism", t, st, status, 1) for s, m, st, status, t in rows], E)


@pytest.fixture(scope="module")
def edges(spark):
    ok = ("supports", "verified", "A")
    return mech(spark, [("D1", "gof", *ok), ("D2a", "gof", *ok), ("D2", "gof", "contradicts", "verified", "A"), ("D3", "other", *ok), ("D4", "gof", "supports", "unverified", "B")])


@pytest.fixture(scope="module")
def parents(spark):
    return spark.createDataFrame([("p", "D2a", "D2", "subgroup_of", "A", "supports", "verified", 1)], E)


def test_contradictions_make_no_pairs(edges):
    assert [(r.a, r.b) for r in links.shared_pairs(links.links(edges, "src", "dst")).collect()] == [("D1", "D2a")]
    assert {(r.a, r.b) for r in links.shared_pairs(links.links(edges, "src", "dst", "usable")).collect()} == {("D1", "D2a"), ("D1", "D4"), ("D2a", "D4")}


def test_jaccard_is_clamped_and_existing_pairs_are_skipped(spark, edges):
    rows = links.jaccard(links.links(edges, "src", "dst")).collect()
    assert [(r.jaccard, r.strength) for r in rows] == [(1.0, 0.95)]
    known = spark.createDataFrame([("x", "D2a", "D1", "t", "A", "supports", "verified", 1)], E)
    assert links.jaccard(links.links(edges, "src", "dst"), known).collect() == []


def test_connections_qualifiers_and_family(spark, edges, parents):
    """D1 and the subgroup D2a share a mechanism that D2 as a whole is known not to have; D2a's parent D2 limits the link."""
    focus = spark.createDataFrame([("D1",)], "id string")
    q = connections.qualifiers(focus, edges, parents)
    assert sorted((r.candidate, r.edge_id, r.side) for r in q.collect()) == [("D2", "D2|gof|contradicts", "target"), ("D2a", "D2|gof|contradicts", "target")]
    none = edges.where("false")
    phen = spark.createDataFrame([(f"p{d}{t}", d, t, "disease_phenotype", "B", "supports", st, 1) for d, t, st in [("D1", "t", "verified"), ("D3", "t", "verified"), ("D4", "t", "rejected")]], E)
    nodes = spark.createDataFrame([(i, "disease", f"Name {i}") for i in ("D1", "D2", "D2a", "D3", "D4")] + [("gof", "mechanism", "Gain")], "id string, type string, name string")
    found = connections.connections(focus, edges, none, phen, parents, none, nodes)
    rows = {r.candidate: r for r in found.collect()}
    assert {c: (r.kind, r.supported, r.n_qualifiers, r.n_phenotypes) for c, r in rows.items()} == {"D2a": ("mechanism", True, 1, 0), "D4": ("mechanism", True, 0, 0), "D3": ("phenotype", False, 0, 1)}
    assert rows["D4"].reason == "Both have cited evidence for gain." and rows["D3"].reason.startswith("Shares 1 symptom annotation, ")
    assert [r.candidate for r in connections.ranked(found).orderBy("rank").collect()] == ["D4", "D2a", "D3"]
    assert connections.ranked(found, 1).count() == 1
    steps = {(r.candidate, r.part, r.step): r.edge_id for r in connections.routes(found, parents, none, none).collect()}
    assert steps[("D2a", "route", 0)] == "D1|gof|supports" and steps[("D2a", "route", 1)] == "D2a|gof|supports" and ("D2a", "community", 0) in steps
    assert not any(c == "D3" for c, _, _ in steps)
    alone = spark.createDataFrame([("D3",)], "id string")
    mine = connections.connections(alone, edges, none, phen, parents, none, nodes)
    why = connections.no_route(alone, mine, edges.where("src != 'D3'"), phen, nodes).first()
    assert (why.reason, why.missing) == ("only_broad_phenotypes", "No cited mechanism is recorded for Name D3 yet.")


def test_rounding_of_doubles(spark):
    values = [0.05, 0.125, 0.375, 0.285, 0.145, 0.675, 0.95, 2 / 3, 1 / 3, 0.505, 0.115, 7 / 8, 1.0, 0.5]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(links.two_places(F.col("x"))).collect()
    assert [r[0] for r in got] == [round(v, 2) for v in values]


def test_search_rules_and_genes(spark):
    none = []
    nodes = [
        ("g1", "gene", "ABC1", ["Alpha"], none, [("HGNC", "7")], 0.5), ("d1", "disease", "Alpha-disease", ["AD"], ["wide term"], [("OMIM", "12")], 0.1),
        ("d2", "disease", "Béta alpha", none, none, none, 0.2), ("d3", "disease", "Gamma", none, none, none, 0.0),
    ]
    frame = spark.createDataFrame(nodes, "id string, type string, name string, synonyms array<string>, related array<string>, ids array<struct<namespace:string,value:string>>, centrality double")
    genes = spark.createDataFrame([("e1", "d3", "g1", "disease_gene", "A", "supports", "verified", 1), ("e0", "d1", "g1", "disease_gene", "A", "contradicts", "verified", 1)], E)
    asked = spark.createDataFrame([("ALPHA",), ("omim:12",), ("hgnc 7",), ("beta_alpha",), ("al",), ("wide",), ("zzz",), (" ",)], "q string")
    got = {}
    for r in search.search(asked, frame, genes).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.node_id, r.via, r.score))
    assert got["ALPHA"] == [("g1", "synonym", 90.5), ("d1", "name", 70.1), ("d2", "name", 50.2), ("d3", "gene", None)]
    assert got["omim:12"] == [("d1", "id", 95.1)] and got["hgnc 7"][0] == ("g1", "id", 95.5) and got["beta_alpha"] == [("d2", "name", 100.2)]
    assert [x[0] for x in got["al"]] == ["d1", "g1", "d3"] and got["wide"] == [("d1", "related", 30.1)]
    assert sorted(r.q for r in search.no_match(asked, search.search(asked, frame)).collect()) == [" ", "zzz"]


def test_visible_text_of_pages(spark):
    pages = {
        "<p>a<!-- x --> b</p>c": "a b c", "in<!--y-->side": "inside", "a<b>b</b>c": "a b c", "<head><title>t</title></head>x": "x", "<script>if (a<b) {}</script>y&amp;z": "y&z",
        "<style>p{}": "", "<template>q<p>r</p></template>s": "s", "<noscript>n</noscript >m": "m", "1 < 2": "1 < 2", "<img alt='a>b'>k": "k", "x&nbsp;y": "x y", None: None,
    }
    got = spark.createDataFrame([(p,) for p in pages], "p string").select(text.visible_text("p").alias("t")).collect()
    assert [r.t for r in got] == list(pages.values())


def test_short_quotes_are_found(spark):
    texts = spark.createDataFrame([(1, "The  quick\nbrown fox jumps over the lazy dog"), (2, "brownish"), (3, None)], "doc_id long, body string")
    quotes = spark.createDataFrame([(1, "quick brown"), (2, "uick BROWN fox jumps over th"), (3, "brown"), (4, ""), (5, None), (6, "fox over")], "item_id long, quote string")
    assert sorted(map(tuple, claims.contained_quotes(quotes, texts).collect())) == [(1, 1), (1, 2), (1, 3), (2, 3)]


def test_each_quote_of_a_repeated_id_counts(spark):
    quotes = spark.createDataFrame([(0, "a quick brown fox jumps over"), (0, "brown"), (0, "nowhere")], "item_id long, quote string")
    texts = spark.createDataFrame([(1, "See a quick  brown fox jumps over it"), (2, "Brown"), (2, "brown bread")], "doc_id long, body string")
    assert sorted(map(tuple, claims.contained_quotes(quotes, texts).collect())) == [(1, 0), (1, 0), (2, 0), (2, 0)]


def test_explain_paths(spark, edges):
    cited = edges.select(F.col("id").alias("edge_id")).where("edge_id != 'D3|other|supports'")
    a, b, c, d = "D1|gof|supports", "D2a|gof|supports", "D2|gof|contradicts", "D3|other|supports"
    paths = spark.createDataFrame([("ok", [a, b]), ("against", [a, c]), ("uncited", [d]), ("missing", ["x"]), ("one", [a]), ("twice", [a, a])], "path_id string, edge_ids array<string>")
    got = {r.path_id: r.verdict for r in connections.explain_paths(paths, edges, cited).collect()}
    assert got == {"ok": "explained", "against": "ineligible_edge", "uncited": "ineligible_edge", "missing": "ineligible_edge", "one": "explained", "twice": "explained"}
    far = mech(spark, [("A", "x", "supports", "verified", "A"), ("B", "y", "supports", "verified", "A")])
    pair = spark.createDataFrame([("far", ["A|x|supports", "B|y|supports"])], "path_id string, edge_ids array<string>")
    assert connections.explain_paths(pair, far, far.select(F.col("id").alias("edge_id"))).first().verdict == "not_connected"


def test_memberships_spread_to_parents(spark, edges, parents):
    clusters = spark.createDataFrame([("gof", "c1"), ("other", "c2")], "node_id string, cluster_id string")
    got = {tuple(r) for r in links.memberships(clusters, edges, parents, []).collect()}
    assert got == {("gof", "c1"), ("other", "c2"), ("D1", "c1"), ("D2a", "c1"), ("D2", "c1"), ("D3", "c2")}


def test_contract_rules_by_mutation(spark, edges):
    nodes = spark.createDataFrame([(i, "disease", i) for i in ("D1", "D2", "D2a", "D3", "D4")] + [(i, "mechanism", i) for i in ("gof", "other")], "id string, type string, name string")
    evidence = edges.select(F.col("id").alias("edge_id"), F.to_date(F.lit("2020-01-01")).alias("retrieved_at"))
    assert quality.violations(nodes, edges, evidence).collect() == []
    cases = {
        "node_type": (nodes.withColumn("type", F.when(F.col("id") == "D3", "planet").otherwise(F.col("type"))), edges, evidence),
        "node_name": (nodes.withColumn("name", F.when(F.col("id") == "D3", " ").otherwise(F.col("name"))), edges, evidence),
        "duplicate_node": (nodes.unionByName(nodes.limit(1)), edges, evidence),
        "edge_tier": (nodes, edges.withColumn("tier", F.lit(None).cast("string")), evidence),
        "edge_stance": (nodes, edges.withColumn("stance", F.lit("maybe")), evidence),
        "inferred_verified": (nodes, edges.withColumn("tier", F.lit("C")), evidence),
        "dangling_end": (nodes.where("id != 'D3'"), edges, evidence),
        "edge_without_evidence": (nodes, edges, evidence.where("edge_id not like 'D3%'")),
        "evidence_edge": (nodes, edges.where("src != 'D3'"), evidence),
        "evidence_date": (nodes, edges, evidence.withColumn("retrieved_at", F.to_date(F.lit("9999-01-01")))),
        "endpoint_types": (nodes.withColumn("type", F.when(F.col("id") == "D3", "gene").otherwise(F.col("type"))), edges, evidence),
    }
    for rule, tables in cases.items():
        assert rule in {r.rule for r in quality.violations(*tables).collect()}, rule


def test_match_levels_are_multisets(spark):
    gold = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    found = spark.createDataFrame([("a",), ("c",), ("a",), ("a",)], "k string")
    r = quality.match_levels(gold, found, {"k": ["k"]}).first()
    assert (r.n_gold, r.n_found, r.n_match, r.precision) == (3, 4, 2, 0.5)


def test_contributions_and_overlays(spark, edges):
    sent = spark.createDataFrame([(1, "u", "D1"), (2, "u", "D2"), (3, "u", "D3"), (4, "u", "D4")], "id long, src string, dst string")
    reviews = spark.createDataFrame([(1, "approved", None, 2), (1, "rejected", "late", 3), (2, "rejected", " ", 1), (3, "rejected", "no source", 1)], "id long, decision string, note string, at long")
    state = governance.contributions(sent, reviews)
    assert {r.id: r.status for r in state.collect()} == {1: "verified", 2: "unverified", 3: "rejected", 4: "unverified"}
    assert governance.with_contributions(edges, state).count() == edges.count() + 1
    decisions = spark.createDataFrame([("D1|gof|supports", "rejected")], "edge_id string, decision string")
    assert links.shared_pairs(links.links(governance.decided(edges, decisions), "src", "dst")).collect() == []


def test_visibility(spark, edges):
    assert governance.visible_edges(edges, "family").count() == 4 and governance.visible_edges(edges, "admin").count() == 5
    cache = spark.createDataFrame([("k1", "family", ["D1|gof|supports"]), ("k2", "family", ["D1|gof|supports", "D4|gof|supports"]), ("k3", "admin", ["D1|gof|supports"])], "cache_key string, audience string, edge_ids array<string>")
    assert [r.cache_key for r in governance.visible_cache(cache, edges, "family").collect()] == ["k1"]


def test_top_with_other(spark):
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(1, 11)], "k string, v long")
    got = {r.k: r.v for r in reports.top_with_other(rows, "k", "v", 4).collect()}
    assert got == {"k10": 10, "k9": 9, "k8": 8, "Other (7)": 28}
    assert reports.top_with_other(rows, "k", "v", 10).count() == 10 and reports.top_with_other(rows.limit(0), "k", "v").count() == 0


def test_text_functions(spark):
    rows = spark.createDataFrame([("  Été_-Nord  A ", "<head>x</head><p>Hi <b>you</b><script>no()</script>&amp;</p>")], "t string, h string")
    r = rows.select(text.fold("t").alias("f"), text.ascii_words(F.col("t")).alias("w"), text.spaced(F.col("t")).alias("s"), text.visible_text("h").alias("h"), text.slug(F.lit("a b" * 40)).alias("slug")).first()
    assert (r.f, r.w, r.s, r.h) == ("ete nord a", "t nord a", "été_-nord a", "Hi you &") and len(r.slug) == 48
    q = spark.createDataFrame([("How are A and B connected?", "route"), ("Who works on it", "people"), ("hello", "overview"), ("is there NIH money", "funding")], "q string, i string")
    assert all(r.x == r.i for r in q.select(text.intent(F.col("q")).alias("x"), "i").collect())
    g = spark.createDataFrame([("SCN2A and HPO1 not NIH but KCNQ2",)], "t string").select(text.gene_like(F.col("t")).alias("g")).first().g
    assert g == ["SCN2A", "HPO1", "KCNQ2"]


def test_json_graph_and_tables(spark, tmp_path):
    doc = {"nodes": [{"id": "a", "type": "gene", "name": "A", "synonyms": ["x"], "ext_ids": {"HGNC": "1"}, "props": {}}], "edges": [], "evidence": [], "clusters": [{"id": "c", "label": "l", "mechanism": {"effect": "e", "mechanism_ids": ["m"], "method": "m", "scope": "s"}}], "node_cluster": [{"node_id": "a", "cluster_id": "c"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    g = files.read_json(spark, str(tmp_path / "g.json"))
    assert g.nodes.first().ext_ids == {"HGNC": "1"} and g.clusters.first().mechanism.mechanism_ids == ["m"] and g.edges.count() == 0
    files.write_tables(g, str(tmp_path / "t"))
    again = files.read_tables(spark, str(tmp_path / "t"))
    assert again.nodes.collect() == g.nodes.collect() and again.node_cluster.count() == 1
    assert files.inventory(spark, str(tmp_path)).where("kind = 'json'").count() == 1


def test_gold_lines(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"pmid": "1"}\nnot json\n\n')
    rows = files.gold_lines(spark, str(tmp_path / "g.jsonl"), "pmid string").collect()
    assert [(r.pmid, r._bad) for r in rows] == [("1", None), (None, "not json")]


def test_limits_depend_on_accepted_events(spark):
    rows = spark.createDataFrame([(i, 1, t) for i, t in enumerate([0, 6, 12, 18, 22, 23])] + [(9, 2, 3)], "event_id long, user_id long, s long")
    events = rows.select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
    assert {r.event_id for r in limits.rate_limit(events, 10).where("accepted").collect()} == {0, 2, 4, 9}
    assert {r.event_id for r in limits.attempt_window(events, 15, 2).where("not accepted").collect()} == {2, 5}
    assert limits.rate_limit(events.limit(0)).collect() == []


def test_phenotype_pairs_are_made_last_and_counted_without_being_made(spark):
    ok = ("disease_phenotype", "B", "supports", "verified", 1)
    has = {f"d{i}": {"broad"} | ({f"t{i % 3}"} if i % 2 else set()) for i in range(12)} | {"d12": {"t1"}, "d13": set(), "d14": {"lost"}}
    phen = spark.createDataFrame([(f"{d}{t}", d, t, *ok) for d, ts in has.items() for t in ts] * 2, E)
    e = mech(spark, [(d, "m", "supports", "verified", "A") for d in ("d0", "d1", "d3")] + [("d2", "m", "contradicts", "verified", "A")])
    up = spark.createDataFrame([("u", "d5", "d1", "subgroup_of", "A", "supports", "verified", 1)], E)
    nodes = spark.createDataFrame([(d, "disease", d.upper()) for d in has if d != "d11"] + [("m", "mechanism", "Gain")], "id string, type string, name string")
    focus = spark.createDataFrame([("d0",), ("d1",), ("d13",), ("d14",)], "id string")
    none = e.where("false")
    way = connections.linked(focus, e, none, phen, up, none, nodes)
    assert sorted((r.focus, r.candidate, r.n_phenotypes) for r in way.collect()) == [("d0", "d1", 1), ("d0", "d3", 1), ("d1", "d0", 1), ("d1", "d3", 1)]
    rest = connections.by_phenotype(focus, way, e, phen, up, none, nodes)
    family = {"d0": {"d0"}, "d1": {"d1", "d5"}}
    gone = {(f, c) for f, cs in family.items() for c in cs} | {("d0", "d1"), ("d0", "d3"), ("d1", "d0"), ("d1", "d3")}
    want = {(f, c, len(has[f] & has[c])) for f in family for c in has if c != "d11" and has[f] & has[c] and (f, c) not in gone}
    got = rest.collect()
    assert {(r.focus, r.candidate, r.n_phenotypes) for r in got} == want and len(got) == len(want)
    assert {(r.focus, r.candidate): r.n_qualifiers for r in got if r.n_qualifiers} == {("d0", "d2"): 1, ("d1", "d2"): 1}
    counts = {r.focus: r.n for r in connections.phenotype_counts(focus, way, phen, up, nodes).collect()}
    assert counts == {f: sum(w[0] == f for w in want) for f in family}
    assert sorted(r.id for r in connections.lacking(focus, way, 2).collect()) == ["d13", "d14"]
    shared = connections.shared_phenotypes(focus, phen)
    assert sorted((r.focus, r.candidate, r.phenotype) for r in shared.collect()) == sorted((f, c, t) for f in ("d0", "d1", "d13", "d14") for c in has for t in has[f] & has[c] if f != c)
    for df in (shared, rest):  # no pair is shuffled
        top, _ = df._jdf.queryExecution().executedPlan().toString().split("Generate explode(focuses", 1)
        assert "Exchange" not in top


def test_routes_place_the_edges_of_a_candidate_once(spark, edges, parents):
    """Two focuses share a candidate with two parents: each has all of its edges, in the same places."""
    up = spark.createDataFrame([(f"u{p}", "c", p, "subgroup_of", "A", "supports", "verified", 1) for p in ("p1", "p2")], E)
    groups = spark.createDataFrame([(f"g{d}", "g", d, "group_disease", "A", "supports", "verified", 1) for d in ("c", "p1", "p2")], E)
    found = spark.createDataFrame([(f, "c", "mechanism", "m", f, True, f"{f}m", "cm") for f in ("f1", "f2")], "focus string, candidate string, kind string, via string, member string, supported boolean, edge_a string, edge_b string")
    got = sorted(map(tuple, connections.routes(found, up, groups, groups.where("false")).where("part = 'community'").collect()))
    assert got == [(f, "c", "community", i, e) for f in ("f1", "f2") for i, e in enumerate(["up1", "up2", "gc", "gp1", "gp2"])]


def test_pairs_from_lists_against_all_pairs(spark, monkeypatch):
    """A target's diseases in several lists; pairs are shuffled once, as lists."""
    monkeypatch.setattr(links, "LIST", 3)
    link = sorted({(f"d{i * i * 7 % 23}", f"m{i % 5}") for i in range(80)})
    phen = sorted({(f"d{i}", f"t{i * k % 4}") for i in range(20) for k in (1, 2)})
    has = lambda rows, d: {t for x, t in rows if x == d}
    ds = sorted({d for d, _ in link})
    want = {(a, b): has(link, a) & has(link, b) for a in ds for b in ds if a < b and has(link, a) & has(link, b)}
    x, y = min(want)
    known = spark.createDataFrame([("x", y, x, "t", "A", "supports", "verified", 1)], E)
    frame = spark.createDataFrame(link, "disease string, target string")
    assert {(r.a, r.b): r.n_shared for r in links.pair_counts(frame).collect()} == {p: len(s) for p, s in want.items()}
    got = links.weights(frame, spark.createDataFrame(phen, "disease string, target string"))
    assert {(r.a, r.b): (r.n_phenotypes, r.weight) for r in got.collect()} == {(a, b): (n := len(has(phen, a) & has(phen, b)), 3 * len(s) + n) for (a, b), s in want.items()}
    near = links.jaccard(frame, known)
    assert {(r.a, r.b): r.jaccard for r in near.collect()} == {(a, b): len(s) / len(has(link, a) | has(link, b)) for (a, b), s in want.items() if (a, b) != (x, y)}
    urls = {k: {f"u{(i * 3 + j) % 7}" for j in range(i % 7)} for i, k in enumerate(link)}
    told = spark.createDataFrame([(*k, u) for k, us in urls.items() for u in us] * 2, "disease string, target string, url string")
    made = actions.bridge_proposals(frame, known, told)
    count = lambda a, b: min(4, len(set().union(*[urls[d, t] for t in want[a, b] for d in (a, b)])))
    assert {(r.src, r.dst): (r.note, len(r.evidence_ids)) for r in made.collect()} == {(a, b): ("Shared: " + ", ".join(sorted(s)), count(a, b)) for (a, b), s in want.items() if (a, b) != (x, y)}
    for df in (near, got, made):
        top, _ = df._jdf.queryExecution().executedPlan().toString().split("Generate ", 1)
        assert "Exchange" not in top
