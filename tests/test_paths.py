from collections import deque
from random import Random

import pytest

from evigraph.operators import paths
from evigraph.sources.schema import EDGE_TYPES

EDGES = "id string, src string, dst string, type string, tier string, stance string, status string, note string, derived_from array<string>"
PATHS, EVIDENCE, NODES = "path_id long, edge_ids array<string>", "id string, edge_id string, snippet string, source_url string", "id string, type string, name string"


def usable(v):
    return bool((v[2] or "").strip()) and (v[3] or "").lower().startswith(("http://x", "https://x"))


@pytest.fixture(scope="module")
def world():
    rng = Random(4)
    nodes = [(f"{t[0]}{i}", t, f"{t} {i}") for t in ("disease", "mechanism", "gene", "person") for i in range(6)]
    edges = []
    for i in range(120):
        kind = rng.choice(["disease_mechanism", "disease_gene", "investigator_disease", "shares_mechanism_with", "subgroup_of"])
        a, b = EDGE_TYPES[kind] if rng.random() < 0.9 else ("gene", "gene")
        src, dst = (f"{t[0]}{rng.randrange(6 if rng.random() < 0.97 else 9)}" for t in (a, b))
        derived = [f"e{rng.randrange(120)}", f"e{rng.randrange(130)}"] if kind == "shares_mechanism_with" else None
        edges.append((f"e{i}", src, dst, kind, rng.choice("AABCD"), rng.choice(["supports"] * 4 + ["contradicts", "neutral"]), rng.choice(["verified"] * 4 + ["unverified", "rejected"]), rng.choice([None, "note"]), derived))
    evidence = [(f"v{i}", f"e{rng.randrange(125)}", rng.choice(["a b", "a b", " ", None, "x"]), rng.choice(["https://x.org", "HTTP://x", "ftp://x", None, "https://x/?q"])) for i in range(400)]
    ways = [[]] + [[f"e{rng.randrange(122)}" for _ in range(rng.randint(1, 3))] for _ in range(300)]
    good = [e for e in edges if e[5] == "supports" and e[6] == "verified" and e[4] != "D"]
    ways += [[a[0], b[0]] for a in good for b in good if {a[1], a[2]} & {b[1], b[2]}][:200]
    return nodes, edges, evidence, list(enumerate(ways))


@pytest.fixture(scope="module")
def frames(spark, world):
    nodes, edges, evidence, ways = world
    return spark.createDataFrame(ways, PATHS), spark.createDataFrame(edges, EDGES).repartition(3), spark.createDataFrame(nodes, NODES), spark.createDataFrame(evidence, EVIDENCE)


def verdict(way, world):
    nodes, edges, evidence, _ = world
    kind, by, ok = {n[0]: n[1] for n in nodes}, {e[0]: e for e in edges}, {v[1] for v in evidence if usable(v)}
    if not way:
        return "empty_path"
    for i in way:
        e = by.get(i)
        if not e or e[5] != "supports" or e[6] != "verified" or e[4] == "D" or e[3] not in paths.PHRASES or (kind.get(e[1]), kind.get(e[2])) != EDGE_TYPES[e[3]] or i not in ok:
            return "unsupported_path"
    ends = {by[way[0]][1], by[way[0]][2]}
    for i in way[1:]:
        ends = {b for a, b in ((by[i][1], by[i][2]), (by[i][2], by[i][1])) if a in ends}
    return None if ends else "disconnected_path"


def test_explained_paths_and_what_contradicts_them(frames, world):
    nodes, edges, evidence, ways = world
    found = paths.explained(*frames)
    rows = {r["path_id"]: r for r in found.collect()}
    want = {i: verdict(w, world) for i, w in ways}
    assert {i: r["reason"] for i, r in rows.items()} == want
    assert {*want.values()} == {None, "empty_path", "unsupported_path", "disconnected_path"}
    by, name = {e[0]: e for e in edges}, {n[0]: n[2] for n in nodes}
    cited = lambda i: sorted(v[0] for v in evidence if v[1] == i and usable(v))
    for i, w in ways:
        assert rows[i]["status"] == ("explained" if want[i] is None else "no_supported_route")
        if want[i]:
            assert rows[i]["sentences"] is None
            continue
        said = rows[i]["sentences"]
        assert [s["edge_id"] for s in said] == w and all(s["evidence_ids"] == cited(s["edge_id"]) for s in said)
        for s in said:
            e = by[s["edge_id"]]
            text = f"{name[e[1]]} {paths.PHRASES[e[3]]} {name[e[2]]}."
            if e[4] == "C":
                text = f"Hypothesis (inferred): {name[e[1]]} may have a {e[3].replace('_', ' ')} relationship with {name[e[2]]}; this requires expert review."
            assert (s["text"], s["kind"], s["tier"], s["note"]) == (text, "hypothesis" if e[4] == "C" else "supported", e[4], e[7])
    got = {(r["path_id"], r["edge_id"]): (r["evidence_ids"], r["note"]) for r in paths.path_contradictions(found, frames[1], frames[3]).collect()}
    against = {}
    for i, w in ways:
        if want[i] is None:
            at = {x for k in w for x in by[k][1:3]}
            against |= {(i, e[0]): (cited(e[0]), e[7]) for e in edges if e[5] == "contradicts" and e[6] != "rejected" and at & {e[1], e[2]}}
    assert got == against and against


def test_steps_and_dropped_edges(frames, world):
    nodes, edges, evidence, ways = world
    by, name, cited = {e[0]: e for e in edges}, {n[0]: n[2] for n in nodes}, {v[1] for v in evidence}
    want = {}
    for i, w in ways:
        for k, eid in enumerate(w):
            e = by.get(eid)
            why = "edge not found" if not e else "edge rejected" if e[6] == "rejected" else "no evidence" if eid not in cited else None
            text = None
            if not why:
                a, b, kind = name.get(e[1], e[1]), name.get(e[2], e[2]), e[3].replace("_", " ")
                may = e[4] == "C"
                text = paths.STEP_SENTENCES[e[3]][may].format(src=a, dst=b) if e[3] in paths.STEP_SENTENCES else f"{a} connects to {b} ({kind})."
                text += " This is inferred by the graph, not yet directly confirmed." if may else ""
                text = f"Evidence contradicts a {kind} connection between {a} and {b}." if e[5] == "contradicts" else text
            want[i, k] = (eid, why, text)
    got = {(r["path_id"], r["step"]): (r["edge_id"], r["dropped"], r["text"]) for r in paths.step_sentences(*frames).collect()}
    assert got == want and {w[1] for w in want.values()} == {None, "edge not found", "edge rejected", "no evidence"}


def test_contradictions_beside_an_edge(frames, world):
    edges = world[1]
    by = {e[0]: e for e in edges}
    want = set()
    for e in edges:
        if e[5] == "contradicts" or e[3] not in paths.MECHANISM_RELATIONS:
            continue
        touch = {e[1], e[2]} | {x for d in e[8] or [] if d in by for x in by[d][1:3]}
        want |= {(e[0], o[0]) for o in edges if o[5] == "contradicts" and o[0] != e[0] and touch & {o[1], o[2]}}
    got = {tuple(r) for r in paths.contradictions_beside(frames[1].select("id"), frames[1]).collect()}
    assert got == want and want


def walk(start, goal, steps):
    """Breadth first over (step, subject, object)."""
    near = {}
    for k, a, b in sorted(steps):
        near.setdefault(a, []).append((b, k, False))
        near.setdefault(b, []).append((a, k, True))
    before, seen, queue = {}, {start}, deque([start])
    while queue:
        x = queue.popleft()
        if x == goal:
            break
        for y, k, back in near.get(x, []):
            if y not in seen:
                seen.add(y)
                before[y] = (x, k, back)
                queue.append(y)
    if goal not in before:
        return None, None, None
    nodes, ks, backs = [goal], [], []
    while nodes[-1] != start:
        x, k, back = before[nodes[-1]]
        nodes.append(x)
        ks.append(k)
        backs.append(back)
    return nodes[::-1], ks[::-1], backs[::-1]


def test_shortest_routes(spark):
    rng = Random(6)
    routes, steps = [], []
    for r in range(60):
        n = rng.randint(2, 9)
        own = [(k, f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for k in range(rng.randint(0, 2 * n))]
        steps += [(r, *s) for s in own]
        routes.append((r, "n0", f"n{rng.randrange(n)}"))
    routes.append((60, "n0", "n9"))
    steps += [(60, 9 - i, f"n{i + 1}", f"n{i}") for i in range(9)] + [(60, 20, None, "n9"), (60, 21, "n0", None)]
    got = paths.shortest_routes(spark.createDataFrame(routes, "route_id long, start string, goal string"), spark.createDataFrame(steps, "route_id long, step long, subject string, object string").repartition(4))
    rows = {r["route_id"]: (r["nodes"], r["steps"], r["reversed"]) for r in got.collect()}
    want = {r: walk(a, b, [s[1:] for s in steps if s[0] == r and s[2] and s[3] and s[2] != s[3]]) for r, a, b in routes}
    assert rows == want
    assert max(len(w[0] or []) for w in want.values()) == 10 and any(w[0] is None for w in want.values())
    with pytest.raises(ValueError, match="beyond"):
        paths.shortest_routes(spark.createDataFrame(routes, "route_id long, start string, goal string"), spark.createDataFrame(steps, "route_id long, step long, subject string, object string"), 3)


def test_no_rows(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    found = paths.explained(none(PATHS), none(EDGES), none(NODES), none(EVIDENCE))
    assert found.collect() == paths.path_contradictions(found, none(EDGES), none(EVIDENCE)).collect() == []
    assert paths.shortest_routes(none("route_id long, start string, goal string"), none("route_id long, step long, subject string, object string")).collect() == []
