"""Graph, retrieval and vector operators on small fixtures."""

import pytest

from specloom.functions.vectors import HashingEncoder
from specloom.operators import graph as G
from specloom.operators import retrieval as R

NODES = "id string, kind string, layer string, domain string, source_file string, aliases array<string>, indexed_fields map<string,string>"
EDGES = "from_node string, to_node string, edge_type string, source_file string, ordinal bigint, edge_id bigint, layer_violation boolean"


def node(i, kind="entity", layer="01-domain", **fields):
    return (i, kind, layer, None, f"specs/{i}.md", None, fields or None)


def edge(a, b, t="WIKI_LINK", k=0, bad=False):
    return (a, b, t, "s.md", k, k, bad)


def make(spark, nodes, edges):
    return G.build(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize(
    "edges, loaded, reasons",
    [
        ([("A", "B"), ("B", "C")], 2, []),
        ([("A", "MISSING")], 0, ["missing_target"]),
        ([("MISSING", "B")], 0, ["missing_source"]),
        ([("GONE_A", "GONE_B")], 0, ["both_missing"]),
        ([("A", "B"), ("A", "B"), ("A", "X"), ("A", "X")], 1, ["missing_target", "missing_target"]),
        ([("A", None), (None, None)], 0, ["both_missing", "missing_target"]),
        ([], 0, []),
    ],
)
def test_build_and_orphans(spark, edges, loaded, reasons):
    g = make(spark, [node(x) for x in "ABC"], [edge(*e, k=i) for i, e in enumerate(edges)])
    assert g.edges.count() == loaded
    assert sorted(r["reason"] for r in R.orphan_edges(g).collect()) == reasons


def test_orphan_rate_and_types(spark):
    g = make(spark, [node("A"), node("B")], [edge("A", "B"), edge("A", "X", "EMITS"), edge("A", "Y"), edge("Z", "B")])
    assert R.orphan_edges(g, ["EMITS"]).count() == 1 and R.orphan_edges(g, []).count() == 3
    r = R.rate(g.orphans, g.edges.select("edge_type").unionByName(g.orphans.select("edge_type")), "orphans").first()
    assert (r["orphans"], r["edges"], r["rate"]) == (3, 4, 75.0)
    assert R.rate(g.orphans.limit(0), g.orphans.limit(0), "orphans").first()["rate"] == 0.0


def test_first_edge_wins(spark):
    g = make(spark, [node("A"), node("B")], [edge("A", "B", k=5), edge("A", "B", k=2), edge("A", "B", None, k=1), edge("A", "B", None, k=3)])
    assert rows(g.edges, "edge_id") == [(1,), (2,)]


@pytest.fixture(scope="module")
def impact_graph(spark):
    nodes = [node("Entity:KDoc", title="Doc"), node("BR:BR-1", "business-rule", declaration="Every doc has a kind " * 20), node("UC:UC-1", "use-case", "02-behavior", description="main"), node("CMD:CMD-1", "command", "02-behavior", preconditions="p", postconditions="q"), node("Event:E", "event"), node("F:1", "scenario", title="Story"), node("Lone:1", "glossary")]
    edges = [edge("BR:BR-1", "Entity:KDoc", "ENTITY_RULE", 1), edge("UC:UC-1", "BR:BR-1", "UC_APPLIES_RULE", 2), edge("UC:UC-1", "CMD:CMD-1", "UC_EXECUTES_CMD", 3), edge("CMD:CMD-1", "Entity:KDoc", "WIKI_LINK", 4), edge("Entity:KDoc", "Entity:KDoc", "WIKI_LINK", 5), edge("F:1", "UC:UC-1", "VALIDATES", 6), edge("Event:E", "UC:UC-1", "WIKI_LINK", 7, True)]
    return make(spark, nodes, edges)


def test_impact(spark, impact_graph):
    i = R.impact(impact_graph, "Entity:KDoc", depth=3)
    assert rows(i.direct, "node_id") == [("BR:BR-1",), ("CMD:CMD-1",), ("Entity:KDoc",)]
    assert "change type: modify_attribute" in i.direct.first()["impact_description"]
    far = {r["node_id"]: (r["path"], r["edge_types"]) for r in i.transitive.collect()}
    assert far["UC:UC-1"] == (["Entity:KDoc", "BR:BR-1", "UC:UC-1"], ["ENTITY_RULE", "UC_APPLIES_RULE"])
    assert rows(i.scenarios, "node_id", "scenario_name") == [("F:1", "Story")]
    assert R.impact(impact_graph, "Lone:1").direct.count() == 0
    for bad in (lambda: R.impact(impact_graph, "nobody"), lambda: R.impact(impact_graph, "Lone:1", depth=9), lambda: R.impact(impact_graph, "Lone:1", "explode")):
        with pytest.raises(R.QueryError):
            bad()


def test_search_respects_layers_types_and_depth(spark, impact_graph):
    near = lambda *a, **k: rows(R.related(impact_graph, *a, **k).nodes, "node_id", "distance")
    assert near("Entity:KDoc", 1) == [("BR:BR-1", 1), ("CMD:CMD-1", 1)]
    assert near("Entity:KDoc", 3) == [("BR:BR-1", 1), ("CMD:CMD-1", 1), ("F:1", 3), ("UC:UC-1", 2)]
    assert ("Event:E", 3) in near("Entity:KDoc", 3, respect_layers=False)
    assert near("Entity:KDoc", 2, ["ENTITY_RULE"]) == [("BR:BR-1", 1)] and near("Entity:KDoc", 2, []) == []
    assert near("Entity:KDoc", 3, kinds=["use-case"]) == [("UC:UC-1", 2)] and near("Lone:1", 2) == []
    r = R.related(impact_graph, "Entity:KDoc", 1)
    assert r.edges.count() == 3 and {x["score"] for x in r.nodes.collect()} == {0.5}


def test_search_against_brute_force(spark):
    import random

    rng = random.Random(5)
    names = [f"n{i}" for i in range(40)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(70)}
    g = make(spark, [node(n) for n in names], [edge(a, b, k=i) for i, (a, b) in enumerate(sorted(pairs))])
    near = {n: {b for a, b in pairs if a == n} | {a for a, b in pairs if b == n} for n in names}
    want = {"n0": 0}
    front = ["n0"]
    for d in (1, 2, 3):
        front = sorted({m for n in front for m in near[n]} - want.keys())
        want |= {m: d for m in front}
    assert dict(rows(G.search(g, spark.createDataFrame([("n0",)], "id string"), 3), "id", "distance")) == want
    seeds = ["n0", "n1", "n2"]
    state = G.reaching(g, spark.createDataFrame([(s, s) for s in seeds], "id string, value string"), 2)[-1]
    hit = {r["id"] for r in state.filter("id <> lo or id <> hi").collect()}
    reach = {s: {s} | near[s] | {m for n in near[s] for m in near[n]} for s in seeds}
    assert hit == {n for n in names if any(n in reach[s] and n != s for s in seeds)}


def test_coverage(spark, impact_graph):
    c = {r["category"]: r["status"] for r in R.coverage(impact_graph, "BR:BR-1").collect()}
    assert c == {"entity": "covered", "use_cases": "covered"}
    p = {r["node_id"]: r["coverage_percent"] for r in R.coverage_percent(R.coverage(impact_graph)).collect()}
    assert p["Entity:KDoc"] == 66.7 and p["UC:UC-1"] == 66.7
    for bad in ("Lone:1", "nobody"):
        with pytest.raises(R.QueryError):
            R.coverage(impact_graph, bad)


def test_violations(spark, impact_graph):
    assert rows(R.layer_violations(impact_graph), "from_node", "to_layer") == [("Event:E", "02-behavior")]
    assert R.layer_violations(impact_graph, kinds=["glossary"]).count() == 0 and R.layer_violations(impact_graph, layers=["02-behavior"]).count() == 1


@pytest.fixture(scope="module")
def chunks(spark):
    v = [("KDoc:chunk-0", [1.0, 0.0, 0.0, 0.0]), ("UC-1:chunk-0", [0.0, 1.0, 0.0, 0.0]), ("BR-1:chunk-3", [0.9, 0.1, 0.0, 0.0]), ("zero:chunk-0", [0.0] * 4), ("none:chunk-0", None), ("short:chunk-0", [1.0]), ("nan:chunk-0", [float("nan"), 0.0, 0.0, 0.0])]
    return spark.createDataFrame(v, "id string, vector array<float>")


def test_cosine_order(spark, chunks):
    got = [(r["id"], round(r["score"], 3)) for r in R.nearest_chunks(chunks, [1, 0, 0, 0], 10, 0).collect()]
    assert got == [("KDoc:chunk-0", 1.0), ("BR-1:chunk-3", 0.994), ("UC-1:chunk-0", 0.0)]
    assert R.nearest_chunks(chunks, [0, 0, 0, 0], 10, 0).count() == 0 and R.nearest_chunks(chunks.limit(0), [1, 0, 0, 0], 10, 0).count() == 0


def test_semantic_and_hybrid(spark, impact_graph, chunks):
    s = R.semantic(impact_graph, chunks, "", None, 0.5, vector=[1, 0, 0, 0])
    assert [r["node_id"] for r in s.collect()] == ["Entity:KDoc", "BR:BR-1"]
    h = R.hybrid(impact_graph, chunks, "main", min_score=0.04, vector=[1, 0, 0, 0], depth=1)
    got = {r["node_id"]: (round(r["score"], 4), r["match_source"]) for r in h.scored.collect()}
    assert got["Entity:KDoc"] == (round(0.5 + 0.2083333, 4), "fusion")
    assert got["UC:UC-1"] == (0.25, "graph") and got["CMD:CMD-1"] == (0.125, "graph")
    few = R.hybrid(impact_graph, None, "main", min_score=0.01, max_tokens=1, expand=False)
    assert few.warnings and [r["node_id"] for r in few.results.collect()] == ["UC:UC-1"]  # the first row stays in any case
    with pytest.raises(R.QueryError):
        R.hybrid(impact_graph, None, " x ")


def test_lexical_ignores_case_and_nulls(spark):
    n = spark.createDataFrame([("Entity:Ábaco", None, None), ("E:2", ["el ÁBACO"], {"a": None}), ("E:3", [None], {"a": "sin ábaco"}), ("E:4", None, {"t": "x"})], "id string, aliases array<string>, indexed_fields map<string,string>")
    assert rows(R.lexical(n, "ábaco"), "id") == [("E:2",), ("E:3",), ("Entity:Ábaco",)]
    assert rows(R.lexical(n, "ábaco", ["a"]), "id") == [("E:2",), ("E:3",), ("Entity:Ábaco",)]


def test_context(spark, impact_graph):
    c = R.context(impact_graph, ["docs/KDoc.md", "main", "zzz"], depth=1)
    assert rows(c.hints, "node_id", "method") == [("Entity:KDoc", "basename"), ("UC:UC-1", "text_search")]
    assert c.warnings == ["No match found for hint: 'zzz'"]
    first = c.constraints.orderBy("rank").first()
    assert first["node_id"] == "BR:BR-1" and len(first["content"]) == 300 and first["content"].endswith("...")
    assert R.context(impact_graph, ["Entity:KDoc"], max_tokens=1).constraints.count() == 0
    with pytest.raises(R.QueryError):
        R.context(impact_graph, [])


def test_encoder_is_deterministic():
    a, b = HashingEncoder(16)(["one two", "one two"])
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-6 and sum(HashingEncoder(16)([""])[0]) == 0


def test_insert_checks_new_edges_only(spark):
    g = make(spark, [node(x) for x in "ABC"], [edge("A", "B", k=1)])
    more = G.insert(g, spark.createDataFrame([edge("A", "B", k=2), edge("B", "C", k=3), edge("B", "C", k=4), edge("A", "X", k=5), edge("A", "B", None, 6)], EDGES))
    assert rows(more.edges.select("from_node", "to_node", "edge_id"), "from_node", "to_node", "edge_id") == [("A", "B", 1), ("A", "B", 6), ("B", "C", 3)]
    assert rows(more.orphans, "to_node", "reason") == [("X", "missing_target")] and rows(g.edges, "edge_id") == [(1,)]
    again = G.insert(more, spark.createDataFrame([edge("A", "B", None, 7)], EDGES))
    assert again.edges.count() == 3


def test_results_report_violations_and_truncation(spark, impact_graph):
    assert rows(R.related(impact_graph, "Entity:KDoc", 3, respect_layers=False).layer_violations, "from_node") == [("Event:E",)]
    assert R.related(impact_graph, "Entity:KDoc", 1).layer_violations.count() == 0
    assert R.impact(impact_graph, "Entity:KDoc", depth=1).truncated and not R.impact(impact_graph, "Entity:KDoc", depth=3).truncated
    far = {r["node_id"]: r["impact_description"] for r in R.impact(impact_graph, "Entity:KDoc").transitive.collect()}
    assert far["UC:UC-1"] == "Use case applies this rule — via BR:BR-1"
    assert {r["category"] for r in R.coverage(impact_graph, "Entity:KDoc", also=True).collect()} == {"events", "business_rules", "use_cases", "requirements"}


def test_large_sides_are_salted(spark, impact_graph, monkeypatch):
    from specloom import runtime

    want = {k: rows(f(), *c) for k, (f, c) in _asked(spark, impact_graph).items()}
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", -1)
    assert {k: rows(f(), *c) for k, (f, c) in _asked(spark, impact_graph).items()} == want
    g = make(spark, [node(x) for x in "AB"], [edge("A", "B", k=1), edge("A", "X", k=2), edge(None, "B", k=3)])
    assert g.edges.count() == 1 and rows(g.orphans, "edge_id", "reason") == [(2, "missing_target"), (3, "missing_source")]


def _asked(spark, g):
    one = spark.createDataFrame([("Entity:KDoc", "x"), ("UC:UC-1", "y")], "id string, value string")
    return {
        "search": (lambda: G.search(g, one.select("id"), 2), ("root", "id", "distance")), "dependents": (lambda: G.dependents(g, one.select("id"), 3), ("root", "id", "distance")), "reaching": (lambda: G.reaching(g, one, 2)[-1], ("id", "lo", "hi")),
        "traversed": (lambda: G.traversed(g, one.select("id")), ("from_node", "to_node", "edge_type")), "scenarios": (lambda: R.impact(g, "Entity:KDoc").scenarios, ("node_id",)), "context": (lambda: R.context(g, ["KDoc"], depth=2).items, ("id", "via", "distance")),
    }
