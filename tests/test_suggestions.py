import pytest

from evigraph.operators import readmodel, suggestions

NODES = "id string, type string, name string, synonyms array<string>"
EDGES = "id string, src string, dst string, type string, stance string"


@pytest.fixture(scope="module")
def world(spark):
    nodes = [("d1", "disease", "Long Name Disease", ["lower", "DEE13", "DEE14"]), ("d2", "disease", "Second", None), ("d3", "disease", None, ["TOO-LONG-A-NAME"]), ("m1", "mechanism", "Gain Of Function", []), ("g1", "gene", "GENE1", []), ("g2", "gene", None, []), ("g9", "gene", "ALONE", [])]
    edges = [("e1", "d1", "g1", "disease_gene", "supports"), ("e0", "d1", "g2", "disease_gene", "contradicts"), ("e3", "d2", "g1", "disease_gene", "supports"), ("e4", "d2", "m1", "disease_mechanism", "supports"), ("e5", "d2", "d2", "subgroup_of", "supports"), ("e6", "d1", "m1", "disease_mechanism", "neutral")]
    frame = spark.createDataFrame
    return frame(nodes, NODES), frame(edges, EDGES), frame([("d2", "c2"), ("d2", "c2"), ("d2", "c1"), ("m1", "c2")], "node_id string, cluster_id string"), frame([("c1", "Loss: Of: x"), ("c2", "Gain"), ("c0", "Early")], "id string, label string")


def ask(spark, world, asked, default="d3", gene="GENE0"):
    rows = suggestions.suggested(spark.createDataFrame(asked, "asker string, role string, focus string, name string"), *world, default, gene).collect()
    out = {}
    for r in sorted(rows):
        out.setdefault(r["asker"], []).append(r["question"])
    return out


def others(name):
    return [f"Which communities share a mechanism with {name}?", f"What should we do this week about {name}?", f"Who is researching {name}?"]


def researcher(mechanism, gene):
    return [f"Who else works on {mechanism}?", "Which findings contradict a shared mechanism?", f"Which NIH awards fund {gene} research?"]


def test_questions_by_role_and_focus(spark, world):
    asked = [("a", "family", "d1"), ("b", "family", "g1"), ("c", None, None), ("d", "scout", "nowhere"), ("e", "family", "d2"), ("f", "family", "g9"), ("g", "researcher", "m1"), ("h", "researcher", "d2"), ("i", "researcher", "d1"), ("j", "researcher", "g9"), ("k", "researcher", "g1"), ("l", "researcher", None), ("m", "family", "d3")]
    got = ask(spark, world, [(*a, "clash") for a in asked])
    assert got == {
        "a": others("DEE13"), "b": others("DEE13"), "c": others("d3"), "d": others("d3"), "e": others("Second"), "f": others("d3"), "m": others("d3"),
        # the default has no cluster and no gene: the first cluster's label, the default gene; d1's first gene by edge id has no name
        "g": researcher("gain Of Function", "GENE0"), "h": researcher("loss Of: x", "GENE1"), "i": researcher("early", "g2"), "j": researcher("early", "ALONE"), "k": researcher("early", "GENE1"), "l": researcher("early", "GENE0"),
    }


def test_unknown_default_and_empty_graph(spark, world):
    assert ask(spark, world, [("a", "family", None, "x")], default="gone")["a"] == others("DEE13")  # the first disease by id
    empty = [t.limit(0) for t in world]
    got = ask(spark, empty, [("a", "family", "d1", "x"), ("b", "researcher", "d1", "x")])
    assert got == {"a": others("our condition"), "b": researcher("this mechanism", "GENE0")}
    assert ask(spark, world, [("a", "family", "d1", "x")] * 2)["a"] == sorted(others("DEE13") * 2, key=others("DEE13").index)


def test_the_disease_with_most_edges_then_by_name(world):
    nodes, edges, *_ = world
    pairs = lambda e: [tuple(r) for r in suggestions.broadest(e, nodes).collect()]
    # d1 has three edges, and so has d2, whose loop counts once: the name decides
    assert pairs(edges) == [("g1", "d1")]
    assert pairs(edges.where("id != 'e6'")) == [("g1", "d2")]
    assert pairs(edges.limit(0)) == []


def test_whole_records(spark):
    frame = spark.createDataFrame
    edges = frame([("e1", "a", "b", "t", "C", "contradicts", "verified", 0.5, "note", ["x", "y"]), ("sample_2", "b", "a", "t", "D", "neutral", "verified", None, None, None), ("e3", "a", "gone", "t", "A", "supports", "verified", 1.0, None, None)], "id string, src string, dst string, type string, tier string, stance string, status string, confidence double, note string, derived_from array<string>")
    nodes, none = frame([("a",), ("b",)], "id string"), frame([], "node_id string, cluster_id string")
    got = readmodel.edge_records(edges, nodes, none, frame([("sample_2", "approved")], "edge_id string, decision string")).orderBy("id").select("id", "src", "dst", "relation", "basis", "tier", "stance", "status", "confidence", "scope", "derived_from", "sample").collect()
    assert [tuple(r) for r in got] == [("e1", "a", "b", "t", "inferred", "C", "contradicts", "verified", 0.5, "note", ["x", "y"], False), ("sample_2", "b", "a", "t", "observed", "D", "neutral", "verified", None, None, [], True)]
    evidence = frame([("v1", "e1", "pubmed", "https://p", "7", "2020-01-02", "s"), ("v2", "sample_2", "placeholder", None, None, None, None), ("v3", "nowhere", "hpo", "https://h", None, None, None)], "id string, edge_id string, source_type string, source_url string, pmid string, retrieved_at string, snippet string")
    titles = frame([("7", "Title", ["A", "B"]), ("8", "Other", [])], "pmid string, title string, authors array<string>")
    rows = readmodel.evidence_records(evidence, titles, edges).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [
        ("e1", "v1", "PubMed", "Title", "https://p", "7", False, "2020-01-02", "s", ["A", "B"], "contradicts"),
        ("sample_2", "v2", "other", "Placeholder: no real source yet", "", None, True, "", None, None, "supports"),
    ]


def test_each_end_of_an_edge_is_looked_up_once(spark):
    """A repeated node repeats no edge; an edge whose ends share no cluster is a bridge, one of an end without clusters is none."""
    frame = spark.createDataFrame
    rows = [(f"{s}{d}", s, d, "disease_mechanism", "A", "supports", "verified") for s, d in (("a", "b"), ("a", "c"), ("a", "n"), ("a", "gone"))]
    edges = frame(rows, "id string, src string, dst string, type string, tier string, stance string, status string")
    nodes, members = frame([("a",), ("a",), ("b",), ("c",), ("n",)], "id string"), frame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "3"), ("gone", "1")], "node_id string, cluster_id string")
    view = readmodel.edge_view(edges, nodes, members, frame([], "edge_id string, decision string"))
    assert sorted((r.id, r.bridge) for r in view.collect()) == [("ab", False), ("ac", True), ("an", False)]
    lines = view._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    leaf = next(i for i, line in enumerate(lines) if "LogicalRDD" in line and "stance" in line)
    above, joins = depth(lines[leaf]), 0
    for line in reversed(lines[:leaf]):
        if depth(line) < above:
            above, joins = depth(line), joins + ("Join " in line)
    assert joins == 3  # the source, the target, the decision
