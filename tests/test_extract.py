"""Parsing, extraction, chunking, the store, upkeep of indices and streaming."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from specloom.functions import text as X
from specloom.operators import extract as E
from specloom.operators import maintain as M
from specloom.operators.retrieval import QueryError
from specloom.sources import store

ENTITY = """---
id: Pedido
kind: " Entity "
aliases: [orden, compra]
title: El pedido
---
preamble [[Ignored]]

# Pedido

## Descripción

Un pedido de [[Usuario|la persona]] y [[core::Cuenta]], ver [[UC-001]] y otra vez [[Usuario]].

## Atributos

| `Campo` | Tipo |
|---|---|
| id | texto |
| total | número |
| corto |

## Relaciones

| Relación | Entidad | Cardinalidad |
|---|---|---|
| pertenece a | [[Usuario]] | N:1 |

## Invariantes

- uno
* dos

## Eventos del Ciclo de Vida

[[EVT-Pedido-Creado]] y [[Otro]]
"""
USE_CASE = "---\nid: UC-001\nkind: use-case\n---\n## Description\nAn [[OBJ-1]] story.\n## Applied Rules\n[[BR-1]] [[CMD-9]]\n## Commands Executed\n[[CMD-9]]\n## Exceptions\n### One\nx\n### Two\ny\n## Postconditions\nz"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def files(spark):
    data = [("01-domain/entities/Pedido.md", ENTITY), ("01-domain/x/UC-001.md", USE_CASE), ("notes/none.md", "no head"), ("notes/bad.md", "---\n: [\n---\nbody"), ("00-requirements/prd.md", "---\nkind: prd\n---\n# Top\n[[CMD-9]]"), ("z/empty.md", ""), ("z/null.md", None)]
    return spark.createDataFrame(data, "path string, content string")


def test_documents_and_routing(spark, files):
    d = {r["source_path"]: r for r in E.documents(files).collect()}
    e = d["01-domain/entities/Pedido.md"]
    assert (e["id"], e["kind"], e["layer"], e["warning"], e["aliases"]) == ("Pedido", "entity", "01-domain", None, ["orden", "compra"])
    assert d["01-domain/x/UC-001.md"]["warning"] and d["00-requirements/prd.md"]["id"] == "prd" and d["00-requirements/prd.md"]["layer"] == "00-requirements"
    assert [d[p]["kind"] for p in ("notes/none.md", "notes/bad.md", "z/empty.md", "z/null.md")] == [None] * 4


def test_nodes(spark, files):
    n = {r["id"]: r for r in E.index(files).nodes.collect()}
    f = n["Entity:Pedido"]["indexed_fields"]
    assert f["invariants"] == "uno; dos" and f["description"].startswith("Un pedido") and "attributes" not in f
    assert json.loads(n["Entity:Pedido"]["tables"]["attributes"]) == [{"Campo": "id", "Tipo": "texto"}, {"Campo": "total", "Tipo": "número"}]
    assert n["UC:UC-001"]["indexed_fields"]["exceptions"] == "### One\n\nx\n\n### Two\n\ny" and n["UC:UC-001"]["status"] == "draft"


def test_edges(spark, files):
    e = E.edges(E.documents(files))
    assert rows(e, "from_node", "to_node", "edge_type", "layer_violation") == sorted([
        ("Entity:Pedido", "Entity:Usuario", "WIKI_LINK", False), ("Entity:Pedido", "Entity:Cuenta", "WIKI_LINK", False), ("Entity:Pedido", "UC:UC-001", "WIKI_LINK", True), ("Entity:Pedido", "Event:EVT-Pedido-Creado", "WIKI_LINK", False),
        ("Entity:Pedido", "Entity:Otro", "WIKI_LINK", False), ("Entity:Pedido", "Entity:Usuario", "DOMAIN_RELATION", False), ("Entity:Pedido", "Event:EVT-Pedido-Creado", "EMITS", False), ("UC:UC-001", "OBJ:OBJ-1", "WIKI_LINK", False),
        ("UC:UC-001", "BR:BR-1", "WIKI_LINK", False), ("UC:UC-001", "CMD:CMD-9", "WIKI_LINK", True), ("UC:UC-001", "BR:BR-1", "UC_APPLIES_RULE", False), ("UC:UC-001", "CMD:CMD-9", "UC_EXECUTES_CMD", False), ("UC:UC-001", "OBJ:OBJ-1", "UC_STORY", False),
        ("PRD:prd", "CMD:CMD-9", "WIKI_LINK", False),
    ])
    meta = {(r["to_node"], r["edge_type"]): r["metadata"] for r in e.filter("from_node = 'Entity:Pedido'").collect()}
    assert meta["Entity:Usuario", "WIKI_LINK"] == {"display_alias": "la persona"} and meta["Entity:Cuenta", "WIKI_LINK"] == {"domain": "core"}
    assert meta["Entity:Usuario", "DOMAIN_RELATION"] == {"relation": "pertenece a", "cardinality": "N:1"}
    more = E.edges(E.documents(files, "auth"), spec_edges=True, relation_types=True, docs_domain=True)
    got = set(rows(more, "from_node", "to_node", "edge_type"))
    assert ("auth:Entity:Pedido", "core:Entity:Cuenta", "CROSS_DOMAIN_REF") in got and ("auth:Entity:Pedido", "Entity:Usuario", "pertenece a") in got


def test_chunks(spark, files):
    c = E.chunks(E.documents(files))
    got = {r["id"]: r for r in c.collect()}
    assert set(got) == {"Pedido:chunk-0", "UC-001:chunk-0"}
    assert got["Pedido:chunk-0"]["context_text"].startswith("Document: Pedido\nKind: entity\nLayer: 01-domain\nTitle: El pedido\nSection: Descripción\n\nUn pedido")
    assert E.chunks(E.documents(files.limit(0))).count() == 0


S800 = "s" * 799 + "."


@pytest.mark.parametrize(
    "paragraphs, want",
    [
        (["x", "y"], [(0, 4)]),
        (["a" * 900, "b" * 700], [(0, 900), (902, 700)]),
        (["a" * 900, "c" * 100, "b" * 700], [(0, 1002), (902, 802)]),
        ([" ".join([S800] * 3)], [(0, 800)] * 3),
        ([" ".join([S800] * 3), "tail"], [(0, 800), (0, 800), (0, 806)]),
        (["a" * 900, "c" * 100, "z" * 1600], [(0, 1002), (902, 1702)]),
        ([""], []),
    ],
)
def test_packing_of_paragraphs(paragraphs, want):
    assert [(o, len(t)) for o, t in E.pack_paragraphs("\n\n".join(paragraphs))] == want


def test_short_paragraphs_merge():
    assert E.merge_short("a b\n\nc d\n\n| t |\n\n" + "w " * 25) == "a b\nc d\n\n| t |\n\n" + ("w " * 25).strip()


def test_sections_and_anchors():
    s = X.sections_of("lost\n# A b\none\n### Ç_d!\ntwo\n\n## E\n#tag\nthree")
    assert [(x["heading"], x["level"], x["content"], x["path"]) for x in s] == [("A b", 1, "one", "a-b"), ("Ç_d!", 3, "two", "a-b.c_d"), ("E", 2, "", "a-b.e"), ("tag", 1, "three", "tag")]
    assert X.anchor_of("Descripción  larga ") == "descripcion-larga" and X.sections_of("") == []


def test_links_in_odd_forms(spark):
    t = "[[ a ]] [[]] [[ ]] [[d::t|x]] [[a|b|c]] [[d::e::f]] [[x\ny]] [not] [[open"
    got = spark.createDataFrame([(t,), (None,)], "t string").select(X.wiki_links(F.col("t")).alias("l")).collect()
    assert [(x["target"], x["domain"], x["alias"]) for x in got[0]["l"]] == [("a", None, None), ("t", "d", "x"), ("a", None, "b"), ("e", "d", None), ("x\ny", None, None)]
    assert got[1]["l"] is None


def test_excerpt(spark):
    texts = ["# H\n**b** *i* [l](u)", "w. " * 100, "x" * 300, "word " * 60, None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.excerpt(F.col("t"))).collect()]
    assert got[0] == "H b i l" and got[1].endswith("w.") and len(got[1]) <= 200 and got[2] == "x" * 200 + "..." and got[3].endswith("word...") and got[4] is None


def test_sql_functions(spark):
    X.register(spark)
    r = spark.sql("select heading_anchor('Qué Tal') as a, cosine_similarity(array(1f, 0f), array(1f, 0f)) as c, cosine_similarity(array(0f), array(0f)) as z").first()
    assert (r["a"], r["c"], r["z"]) == ("que-tal", 1.0, None)


def test_store_round_trips(spark, files, tmp_path):
    from specloom.functions.vectors import HashingEncoder

    made = E.index(files, "L2", HashingEncoder(4), "hashing", 4)
    man = store.manifest_of(made, "L2", "hashing", 4, ["core"])
    at = str(tmp_path / "files")
    store.export(made.nodes.drop("tables"), made.edges, made.chunks, at, man)
    assert os.path.getsize(f"{at}/embeddings/entity/Pedido.f32") == 16
    assert "vector" not in json.load(open(f"{at}/embeddings/entity/Pedido.json"))[0]
    legacy = [{"id": "L:chunk-0", "document_id": "L", "document_kind": "entity", "section_path": "s", "chunk_index": 0, "vector": [1, -1, 0.5, 0], "model": "m", "dimensions": 4}]
    with open(f"{at}/embeddings/entity/L.json", "w") as f:
        json.dump(legacy, f)
    o = store.open_index(spark, at)
    assert o.manifest["stats"]["nodes"] == 3 and o.nodes.count() == 3 and o.edges.count() == made.edges.count()
    want = {r["id"]: r["vector"] for r in made.chunks.collect()} | {"L:chunk-0": [1, -1, 0.5, 0]}
    got = {r["id"]: r["vector"] for r in o.embeddings.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
    store.append_edges(made.edges.limit(2), at)
    assert store.load_edges(spark, at).count() == made.edges.count() + 2
    store.clear_edges(spark, at)
    assert store.load_edges(spark, at).count() == 0
    parquet = str(tmp_path / "tables")
    store.save(made, parquet, man)
    p = store.open_index(spark, parquet, skip_embeddings=True)
    assert p.nodes.count() == 3 and p.embeddings is None
    assert store.load_nodes(spark, str(tmp_path / "nowhere")).count() == 0


def test_malformed_edges_fail(spark, tmp_path):
    os.makedirs(tmp_path / "edges")
    (tmp_path / "edges" / "e.jsonl").write_text('{"from_node": "a"}\n\nnot json\n')
    with pytest.raises(Exception):
        store.load_edges(spark, str(tmp_path)).collect()


def test_spec_files_and_sections(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x.md").write_text("# One\ntext\n## Two\nmore\n# Three\nend")
    (tmp_path / "y.txt").write_text("no")
    assert rows(store.spec_files(spark, str(tmp_path)), "path") == [("a b/x.md",)]
    assert store.read_section(spark, str(tmp_path), "a b/x.md", "one") == "# One\ntext\n## Two\nmore"
    assert store.read_section(spark, str(tmp_path), "a b/x.md", "nope").endswith("end")
    for bad in ("../x.md", "/etc/passwd", "a b/none.md"):
        with pytest.raises(QueryError):
            store.read_section(spark, str(tmp_path), bad)


def test_diff_and_update(spark):
    f = "source_file string, source_hash string"
    d = M.diff(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", "1")], f), spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("e", "1"), ("e", "1")], f))
    assert rows(d, "source_file", "change") == [("a", "="), ("b", "M"), ("c", "="), ("d", "D"), ("e", "A")]
    n, e, c = "id string, source_file string", "from_node string, to_node string, source_file string", "id string, document_id string"
    old = M.Tables(spark.createDataFrame([("X:a", "a"), ("X:b", "b"), ("X:d", "d")], n), spark.createDataFrame([("X:a", "X:b", "a"), ("X:b", "X:a", "b")], e), spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "d")], c))
    new = M.Tables(spark.createDataFrame([("X:b2", "b"), ("X:e", "e"), ("X:a", "a")], n), spark.createDataFrame([("X:b2", "X:a", "b")], e), spark.createDataFrame([("4", "b2"), ("5", "e"), ("6", "a")], c))
    u = M.update(old, new, d)
    assert rows(u.nodes, "id") == [("X:a",), ("X:b2",), ("X:e",)] and rows(u.edges, "from_node") == [("X:a",), ("X:b2",)] and rows(u.embeddings, "id") == [("1",), ("4",), ("5",)]


def test_merge(spark):
    n, e, c = "id string, source_hash string, indexed_at string", "from_node string, to_node string, edge_type string", "id string, document_id string"
    a = M.Tables(spark.createDataFrame([("E:1", "h1", "10:00"), ("E:2", "h2", "10:00"), ("E:3", "x", "10:00")], n), spark.createDataFrame([("E:1", "E:2", "T"), ("E:1", "E:3", "T")], e), spark.createDataFrame([("a1", "1")], c))
    b = M.Tables(spark.createDataFrame([("E:1", "h9", "10:15"), ("E:2", "h2", "10:00")], n), spark.createDataFrame([("E:1", "E:2", "T")], e), spark.createDataFrame([("b1", "1"), ("b2", "2")], c))
    gone = spark.createDataFrame([("E:3", "11:00"), ("E:1", "09:00")], "id string, removed_at string")
    m = M.merge([a, b], gone)
    assert rows(m.nodes, "id", "source_hash") == [("E:1", "h9"), ("E:2", "h2")] and rows(m.edges, "from_node", "to_node") == [("E:1", "E:2")] and rows(m.embeddings, "id") == [("b1",), ("b2",)]
    with pytest.raises(QueryError):
        M.merge([a, b], fail_on_conflict=True)
    ok = {"version": "1.0", "structure": "flat", "index_level": "L2", "embedding_model": "m"}
    M.compatible([ok, ok | {"version": "1.9"}])
    for bad in ([ok], [ok, ok | {"version": "2.0"}], [ok, ok | {"structure": "multi"}], [ok, ok | {"embedding_model": "k"}]):
        with pytest.raises(QueryError):
            M.compatible(bad)
    g = M.cascade(a, spark.createDataFrame([("E:2",), ("E:1",)], "id string"))
    assert rows(g.nodes, "id") == [("E:3",)] and g.edges.count() == 0 and g.embeddings.count() == 0


def test_streams(spark, sf, tmp_path):
    from specloom.streaming import reindex as S

    (tmp_path / "specs").mkdir()
    (tmp_path / "specs" / "P.md").write_text(ENTITY)
    run = lambda: S.reindex(S.watch(spark, str(tmp_path / "specs")), str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "specs" / "U.md").write_text(USE_CASE)
    run()
    run()  # nothing new
    n, e = S.current(spark, str(tmp_path / "ix"))
    assert rows(n, "id") == [("Entity:Pedido",), ("UC:UC-001",)] and e.count() == 13
    ev = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(ev.schema).format("parquet").option("pathGlobFilter", "events.parquet").load(sf)
    for name, df, mode in (("tele", S.telemetry(stream), "complete"), ("late", S.latency(stream), "complete"), ("held", S.states(stream, "user_id", "event_type", "ts"), "update")):
        S_q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        S_q.awaitTermination()
    assert spark.table("tele").agg(F.sum("events")).first()[0] == ev.count() and spark.table("late").count() > 0
    assert spark.table("held").count() == ev.select("user_id").distinct().count()


def test_command_line(spark, tmp_path, capsys):
    from specloom import cli

    (tmp_path / "01-domain" / "entities").mkdir(parents=True)
    (tmp_path / "01-domain" / "entities" / "P.md").write_text(ENTITY)
    (tmp_path / "uc.md").write_text(USE_CASE)
    ix = ["--index-path", str(tmp_path / "ix")]
    say = lambda *a: (cli.main([*a]), capsys.readouterr().out)
    assert say("index", str(tmp_path), *ix)[0] == 0
    assert say("graph", "Entity:Pedido", *ix)[0] == 0
    assert "Entity:Pedido" in say("search", "pedido", "--min-score", "0.04", *ix)[1]
    for a in (["impact", "UC:UC-001"], ["coverage", "Entity:Pedido"], ["violations"], ["orphan-edges"], ["context", "Pedido", "nobody"], ["list"], ["stats"], ["semantic", "pedido", "--min-score", "0"], ["find-spec", "pedido"]):
        code, out = say(*a, *ix)
        assert code == 0 and out, a
    assert say("graph", "nobody", *ix)[0] == 1
    assert say("section", str(tmp_path), "uc.md", "--anchor", "description")[1].startswith("## Description")


FEATURE = "@Pedido\nFeature: Pedidos\n\n  Background:\n    Given x\n\n  @UC-001 @smoke\n  Scenario: crear uno\n    When y\n\n  @BR-1\n  Escenario: otro más\n  Scenario Outline: sin nada\n"


def test_feature_files_validate(spark):
    assert E.scenarios_of(FEATURE) == [("Pedidos", "crear uno", ["Pedido", "UC-001"]), ("Pedidos", "otro más", ["Pedido", "BR-1"]), ("Pedidos", "sin nada", ["Pedido"])]
    assert E.scenarios_of(None) == [] and E.scenarios_of("") == []
    files = spark.createDataFrame([("specs/04-verification/examples/a.feature", FEATURE), ("b.feature", None), ("c.feature", "nothing"), ("01-domain/entities/Pedido.md", ENTITY)], "path string, content string")
    made = E.index(files)
    assert rows(made.nodes.filter("kind = 'scenario'"), "id", "layer") == [(f"Scenario:a-{k}", "04-verification") for k in (1, 2, 3)]
    assert ("Scenario:a-1", "UC:UC-001", "VALIDATES") in rows(made.edges, "from_node", "to_node", "edge_type")
    assert made.log.count() == 1
    assert E.features(files.limit(0))[0].count() == 0


def test_registered_kinds_yaml_and_unread_files(spark, tmp_path):
    reg = E.Registry().register("risk", "RISK", "05-risks/", ("Causa",), fields=(("cause", ("Causa",), "text"), ("size", lambda: F.upper(F.col("front")["size"]))), links=(("THREATENS", ("Causa",), ("BR-",), False),))
    files = spark.createDataFrame([("05-risks/r.md", "---\nid: R-1\nkind: risk\nsize: big\n---\n# R\n## Causa\nver [[BR-7]] y [[Otro]]"), ("x/e.yaml", "id: E-1\nkind: entity\ntitle: Uno"), ("x/f.yml", "---\nid: E-2\nkind: entity"), ("lost.md", None)], "path string, content string")
    made = E.index(files, "L2", registry=reg)
    assert rows(made.nodes, "id", "kind") == [("Entity:E-1", "entity"), ("Entity:E-2", "entity"), ("RISK:R-1", "risk")]
    assert made.nodes.filter("id = 'RISK:R-1'").first()["indexed_fields"] == {"cause": "ver [[BR-7]] y [[Otro]]", "size": "BIG"}
    assert ("RISK:R-1", "BR:BR-7", "THREATENS") in rows(made.edges, "from_node", "to_node", "edge_type") and made.chunks.count() == 1
    assert rows(made.log.filter("skipped_reason is not null"), "source_path", "skipped_reason") == [("lost.md", "File can't be read")]
    assert E.index(files).nodes.count() == 2 and not E.DEFAULT.has("risk")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("x")
    assert rows(store.spec_files(spark, str(tmp_path), unread=True), "path", "content") == [("a/x.md", "x")]


def test_delete_a_stored_document(spark, files, tmp_path):
    made = E.index(files, "L2", lambda t: [[1.0, 2.0] for _ in t], "m", 2)
    at = str(tmp_path / "index")
    store.export(made.nodes, made.edges, made.chunks, at, store.manifest_of(made, "L2", "m", 2, []))
    nodes, edges = store.load_nodes(spark, at).count(), store.load_edges(spark, at).count()
    mine = made.edges.filter("from_node = 'Entity:Pedido'").count()
    assert store.delete_document(spark, at, "entity", "Pedido") == {"files": 3, "edges": mine} and mine > 0
    assert store.load_nodes(spark, at).count() == nodes - 1 and store.load_edges(spark, at).count() == edges - mine
    assert store.load_embeddings(spark, at).filter("document_id = 'Pedido'").count() == 0
    assert store.delete_document(spark, at, "entity", "Pedido") == {"files": 0, "edges": 0}


def test_runs_and_events(spark):
    c = spark.createDataFrame([("a", "A"), ("m", "M"), ("d", "D"), ("s", "="), ("k", "A")], "source_file string, change string")
    log = spark.createDataFrame([("a", "E:a", None), ("m", "E:m", None), ("k", None, "no kind")], "source_path string, node_id string, skipped_reason string")
    got = [(r["source_file"], r["event_type"], r["state"]) for r in M.document_events(c, log, "2024-01-01").orderBy("source_file", "step").collect()]
    assert [g for g in got if g[0] == "m"] == [("m", "Document-Stale", "stale"), ("m", "Document-Parsed", "parsing"), ("m", "Document-Indexed", "indexed")]
    assert [g[1] for g in got if g[0] == "k"] == ["Document-Detected"] and [g[1] for g in got if g[0] == "d"] == ["Document-Deleted"] and not [g for g in got if g[0] == "s"]
    m = {"git_commit": "abc"}
    assert M.run_kind(None, "x", True, c) == "full" == M.run_kind(m, "x", False, c) == M.run_kind(m, "x", True, c, True)
    assert M.run_kind(m, "x", True, c) == "incremental" and M.run_kind(m, "abc", True, c) == "none" == M.run_kind(m, "x", True, c.filter("change = '='"))


def test_encoder_models():
    from specloom.functions import vectors as V

    assert len(V.ModelEncoder()(["uno"])[0]) == 384
    V.register_model("own", 2, lambda: lambda texts: (np.array([[[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]]] * len(texts)), np.array([[1, 1, 0]] * len(texts))))
    assert np.allclose(V.ModelEncoder("own")(["x", "y"]), [[0.6, 0.8]] * 2) and V.pooled(np.ones((1, 2, 3)), np.zeros((1, 2))).tolist() == [[0, 0, 0]]
    with pytest.raises(ValueError):
        V.ModelEncoder("unheard of")


def test_tools(spark, files, tmp_path):
    import io
    import threading
    import urllib.request

    from specloom import tools
    from specloom.functions.vectors import HashingEncoder

    specs, at = tmp_path / "specs", str(tmp_path / "index")
    (specs / "d").mkdir(parents=True)
    (specs / "d" / "x.md").write_text("# Uno\na\n## Dos\nb\n")
    made = E.index(files, "L2", HashingEncoder(8), "hashing", 8)
    store.save(made, at, store.manifest_of(made, "L2", "hashing", 8, []))
    o = tools.Opened(spark, at, str(specs))
    text = lambda tool, /, **k: tools.call(o, tool, k)["content"][0]["text"]
    assert "UC:UC-001" in text("search", query="story", min_score=0.01) and "Entity:Pedido" in text("find_spec", name="Pedido")
    assert json.loads(text("related", node_id="Entity:Pedido"))["nodes"] == {"rows": [], "cut": False} and "truncated" in json.loads(text("impact", node_id="UC:UC-001"))
    assert text("read_section", file="d/x.md", anchor="dos") == "## Dos\nb" and json.loads(text("list", kind="entity"))["rows"][0]["id"] == "Entity:Pedido"
    assert json.loads(text("stats"))["manifest"]["index_level"] == "L2" and json.loads(text("context", hints=["Pedido"]))["constraints"]["rows"]
    assert json.loads(text("coverage", node_id="Entity:Pedido"))["percent"]["rows"] and "violations" in text("violations") and "rows" in text("semantic", query="pedido", min_score=0)
    for name, args in (("related", {"node_id": "nobody"}), ("search", {}), ("search", {"query": "abc", "odd": 1}), ("nothing", {}), ("read_section", {"file": "../x"})):
        assert tools.call(o, name, args)["isError"]
    out = io.StringIO()
    lines = ['{"jsonrpc": "2.0", "id": 1, "method": "initialize"}', "", '{"method": "notifications/initialized"}', '{"id": 2, "method": "tools/list"}', '{"id": 3, "method": "tools/call", "params": {"name": "list"}}', '{"id": 4, "method": "odd"}', "no json"]
    tools.serve(o, io.StringIO("\n".join(lines)), out)
    got = [json.loads(x) for x in out.getvalue().split("\n") if x]
    assert [g["id"] for g in got] == [1, 2, 3, 4, None] and len(got[1]["result"]["tools"]) == len(tools.TOOLS) and "error" in got[3] and "error" in got[4]
    server = tools.http(o, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/v1/retrieve/"
    assert json.load(urllib.request.urlopen(base + "list?kind=entity"))["rows"]
    assert json.load(urllib.request.urlopen(urllib.request.Request(base + "impact", b'{"node_id": "UC:UC-001"}')))["direct"]
    for bad, status in (("related?node_id=nobody", 400), ("odd", 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(base + bad)
        assert e.value.code == status
    server.shutdown()
