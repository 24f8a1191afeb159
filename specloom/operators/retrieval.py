"""Read queries over a graph and its chunk embeddings. Every ranked result ends with the id as its last key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import snippet
from ..functions.vectors import cosine_to
from ..runtime import cut, measured, near_join, together
from . import graph as G


class QueryError(ValueError):
    """A query that can't be answered: ``code`` is NODE_NOT_FOUND, QUERY_TOO_SHORT, UNKNOWN_KIND, EMPTY_HINTS or BAD_PARAMETER."""

    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


# Weights of the sources and what each further source adds.
SEMANTIC, GRAPH, LEXICAL, BONUS = 0.6, 0.3, 0.1, 0.1
FLAT = 0.5
CHANGE_TYPES = ("modify_attribute", "add_attribute", "remove", "rename")
# What an incoming edge of a type says; other types read "Connected via {type}".
IMPACT = {
    "ENTITY_RULE": "Business rule validates this entity",
    "UC_APPLIES_RULE": "Use case applies this rule",
    "UC_EXECUTES_CMD": "Use case executes this command",
    "EMITS": "Emits this event",
    "CONSUMES": "Consumes this event",
    "WIKI_LINK": "References this artifact",
    "DOMAIN_RELATION": "Has a domain relationship",
    "REQ_TRACES_TO": "Requirement traces to this artifact",
    "VALIDATES": "Validates this artifact via BDD scenarios",
}


def check(depth: int | None = None, limit: int | None = None, min_score: float | None = None, change_type: str | None = None, most_depth: int = 5) -> None:
    """Refuse parameters out of their range before any plan is made."""
    for name, value, low, high in (("depth", depth, 1, most_depth), ("limit", limit, 1, 100), ("min_score", min_score, 0, 1)):
        if value is not None and not low <= value <= high:
            raise QueryError("BAD_PARAMETER", f"{name} must lie between {low} and {high}")
    if change_type is not None and change_type not in CHANGE_TYPES:
        raise QueryError("BAD_PARAMETER", f"unknown change type {change_type}")


def _need_node(graph: G.Graph, node_id: str) -> None:
    if graph.nodes.filter(F.col("id") == node_id).isEmpty():
        raise QueryError("NODE_NOT_FOUND", node_id)


def _need_text(text: str) -> str:
    if len((text or "").strip()) < 3:
        raise QueryError("QUERY_TOO_SHORT", "a query needs three characters at least")
    return text


def _one(spark, node_id: str) -> DataFrame:
    return spark.createDataFrame([(node_id,)], "id string")


def _of(nodes: DataFrame, kinds: list[str] | None, layers: list[str] | None) -> DataFrame:
    """Nodes of the kinds and layers: no list takes all, an empty list none."""
    if kinds is not None:
        nodes = nodes.filter(F.col("kind").isin(list(kinds)))
    return nodes if layers is None else nodes.filter(F.col("layer").isin(list(layers)))


def _label() -> Column:
    return snippet(F.col("kind"), F.col("indexed_fields")["title"], F.col("id")).alias("snippet")


# Graph ---------------------------------------------------------------------------------------------------------------


class _Lazy:
    """Results that are planned when they are first asked for; each part is a function without arguments."""

    def __init__(self, **parts: Callable[[], DataFrame]):
        self._parts = parts

    def _part(self, name: str) -> DataFrame:
        return self._parts[name]()


class Related(_Lazy):
    @cached_property
    def nodes(self) -> DataFrame:
        """node_id, score, snippet, match_source, distance"""
        return self._part("nodes")

    @cached_property
    def edges(self) -> DataFrame:
        """The edges that the search took."""
        return self._part("edges")

    @cached_property
    def layer_violations(self) -> DataFrame:
        """The violations among the nodes found, which the search did not take if layers are respected."""
        return self._part("layer_violations")


def related(graph: G.Graph, root: str, depth: int = 2, edge_types: list[str] | None = None, kinds: list[str] | None = None, respect_layers: bool = True, checked: bool = True) -> Related:
    """What a node is related to: score 1 / (1 + distance). The kinds restrict nodes, not the edges they were reached over."""
    check(depth=depth)
    if checked:
        _need_node(graph, root)
    one = _one(graph.nodes.sparkSession, root)
    reach = lambda hops: G.search(graph, one, hops, edge_types, respect_layers, checked)

    def nodes() -> DataFrame:
        near = reach(depth).filter("distance > 0").join(_of(graph.nodes, kinds, None), "id")
        return near.select(F.col("id").alias("node_id"), (1.0 / (1.0 + F.col("distance"))).alias("score"), _label(), F.lit("graph").alias("match_source"), "distance")

    return Related(
        nodes=nodes,
        edges=lambda: G.traversed(graph, reach(depth - 1) if depth > 1 else one, edge_types, respect_layers),
        layer_violations=lambda: _violations_among(graph, reach(depth).select("id")),
    )


def _violations_among(graph: G.Graph, ids: DataFrame) -> DataFrame:
    """Violations both of whose ends are among the ids."""
    ids, small = measured(ids.distinct())
    side = F.broadcast(ids) if small else ids
    v = G.violations(graph).select("from_node", "to_node", "from_layer", "to_layer", "edge_type")
    return v.join(side.withColumnRenamed("id", "from_node"), "from_node", "left_semi").join(side.withColumnRenamed("id", "to_node"), "to_node", "left_semi").select(*v.columns)


class Impact(_Lazy):
    @cached_property
    def direct(self) -> DataFrame:
        """node_id, kind, edge_type, impact_description: a row an incoming edge"""
        return self._part("direct")

    @cached_property
    def transitive(self) -> DataFrame:
        """node_id, kind, path, edge_types, impact_description"""
        return self._part("transitive")

    @cached_property
    def scenarios(self) -> DataFrame:
        """node_id, scenario_name, reason"""
        return self._part("scenarios")

    @cached_property
    def truncated(self) -> bool:
        """Whether more nodes depend on the node than the depth lets see."""
        return not self._part("beyond").isEmpty()


def impact(graph: G.Graph, node_id: str, change_type: str = "modify_attribute", depth: int = 3, checked: bool = True) -> Impact:
    """Who depends on a node: directly, over further hops (without those that do directly), and the scenarios that validate any of these."""
    check(depth=depth, change_type=change_type)
    if checked:
        _need_node(graph, node_id)
    one, kinds = _one(graph.nodes.sparkSession, node_id), graph.nodes.select("id", "kind")
    said = lambda t: F.coalesce(F.create_map(*[F.lit(x) for kv in IMPACT.items() for x in kv])[t], F.concat(F.lit("Connected via "), F.coalesce(t, F.lit(""))))
    cache: dict[str, DataFrame] = {}

    def ways() -> DataFrame:
        if "ways" not in cache:
            cache["ways"] = G.dependents(graph, one, depth, checked)
        return cache["ways"]

    def direct() -> DataFrame:
        what = F.concat(said(F.col("edge_type")), F.lit(f" — change type: {change_type}"))
        return graph.edges.filter(F.col("to_node") == node_id).join(kinds.withColumnRenamed("id", "from_node"), "from_node").select(F.col("from_node").alias("node_id"), "kind", "edge_type", what.alias("impact_description"))

    def transitive() -> DataFrame:
        far = ways().filter((F.col("distance") > 1) & (F.col("id") != node_id)).join(kinds, "id")
        via = F.concat(said(F.try_element_at("edge_types", F.lit(-1))), F.lit(" — via "), F.try_element_at("path", F.lit(-2)))
        return far.select(F.col("id").alias("node_id"), "kind", "path", "edge_types", via.alias("impact_description"))

    def scenarios() -> DataFrame:
        hit, small = measured(ways().select(F.col("id").alias("to_node")).union(one).distinct())
        checks = graph.edges.filter("edge_type = 'VALIDATES'").join(F.broadcast(hit) if small else hit, "to_node", "left_semi")
        return checks.join(graph.nodes.select(F.col("id").alias("from_node"), F.col("indexed_fields")["title"].alias("title")), "from_node").select(
            F.col("from_node").alias("node_id"), F.coalesce("title", "from_node").alias("scenario_name"), F.concat(F.lit("Validates "), "to_node", F.lit(" which is affected")).alias("reason")
        )

    def beyond() -> DataFrame:
        inner = ways().select("id").union(one)
        last, small = measured(ways().filter(F.col("distance") == depth).select(F.col("id").alias("to_node")))
        return graph.edges.join(F.broadcast(last) if small else last, "to_node", "left_semi").select(F.col("from_node").alias("id")).join(inner, "id", "left_anti")

    return Impact(direct=direct, transitive=transitive, scenarios=scenarios, beyond=beyond)


def coverage_links(graph: G.Graph, node_id: str | None = None, also: bool = False) -> DataFrame:
    """(node_id, category, other): what covers each category of a node, a row a node at the other end of an edge of the category's type."""
    ends = G.incident(graph.edges.filter(F.col("edge_type").isin(sorted({r[3] for r in dims.coverage_rules(also)})))).select("node_id", "edge_type", "other").distinct()
    return _wanted(graph, node_id, also).select("node_id", "category", "edge_type").join(ends, ["node_id", "edge_type"]).select("node_id", "category", "other")


def _wanted(graph: G.Graph, node_id: str | None, also: bool) -> DataFrame:
    nodes = graph.nodes.select(F.col("id").alias("node_id"), "kind")
    if node_id is not None:
        nodes = nodes.filter(F.col("node_id") == node_id)
    return nodes.join(F.broadcast(dims.coverage(graph.nodes.sparkSession, also)), "kind")


def coverage(graph: G.Graph, node_id: str | None = None, also: bool = False) -> DataFrame:
    """(node_id, category, category_rank, description, edge_type, status, links): per node of a kind with rules and category, how many distinct nodes cover it by an edge of its type.

    All nodes at once unless one is named. The rules are a fixed dozen of rows, ``also`` adds those that are only specified. Which nodes they are says ``coverage_links``, a row each: no
    list grows with a hub. Links are counted before they are joined."""
    if node_id is not None:
        _need_node(graph, node_id)
        kind = graph.nodes.filter(F.col("id") == node_id).filter(F.col("kind").isin([r[0] for r in dims.COVERAGE]))
        if kind.isEmpty():
            raise QueryError("UNKNOWN_KIND", f"no coverage rules for the kind of {node_id}")
    edges = graph.edges.filter(F.col("edge_type").isin(sorted({r[3] for r in dims.coverage_rules(also)})))
    links = G.incident(edges).select("node_id", "edge_type", "other").distinct().groupBy("node_id", "edge_type").agg(F.count("*").alias("links"))
    found = _wanted(graph, node_id, also).join(links, ["node_id", "edge_type"], "left").withColumn("links", F.coalesce("links", F.lit(0).cast("bigint")))
    return found.select("node_id", "category", "category_rank", "description", "edge_type", F.when(F.col("links") > 0, "covered").otherwise("missing").alias("status"), "links")


def coverage_percent(cover: DataFrame) -> DataFrame:
    present = F.sum(F.when(F.col("status") == "covered", 1).otherwise(0))
    return cover.groupBy("node_id").agg(present.alias("present"), (F.count("*") - present).alias("missing"), (F.round(present / F.count("*") * 1000) / 10).alias("coverage_percent"))


def layer_violations(graph: G.Graph, kinds: list[str] | None = None, layers: list[str] | None = None) -> DataFrame:
    """Violations of which either end is of the kinds and either end lies in the layers."""
    v = G.violations(graph)
    if kinds is not None:
        v = v.filter(F.col("from_kind").isin(list(kinds)) | F.col("to_kind").isin(list(kinds)))
    if layers is not None:
        v = v.filter(F.col("from_layer").isin(list(layers)) | F.col("to_layer").isin(list(layers)))
    return v.select("from_node", "to_node", "from_layer", "to_layer", "edge_type")


def rate(part: DataFrame, whole: DataFrame, name: str) -> DataFrame:
    """One row: how many, of how many, and the share in percent to two places (0 of nothing)."""
    a, b = part.agg(F.count("*").alias(name)), whole.agg(F.count("*").alias("edges"))
    return a.join(F.broadcast(b), F.lit(True)).withColumn("rate", F.coalesce(F.round(F.try_divide(F.col(name), F.col("edges")) * 10000) / 100, F.lit(0.0)))


def orphan_edges(graph: G.Graph, edge_types: list[str] | None = None) -> DataFrame:
    """Edges an end of which is missing; here an empty list of types is no restriction."""
    o = graph.orphans if not edge_types else graph.orphans.filter(F.col("edge_type").isin(list(edge_types)))
    return o.select("from_node", "to_node", "edge_type", "source_file", "from_exists", "to_exists", "reason")


# Text and vectors ------------------------------------------------------------------------------------------------------


def contains(text: str, fields: list[str] | None = None) -> Column:
    needle = text.lower()
    values = F.map_values("indexed_fields") if fields is None else F.array(*[F.col("indexed_fields")[f] for f in fields])
    everything = F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce(values, F.array().cast("array<string>")))
    return F.exists(everything, lambda v: F.coalesce(F.lower(v).contains(needle), F.lit(False)))


def lexical(nodes: DataFrame, text: str, fields: list[str] | None = None) -> DataFrame:
    """Nodes whose id, an alias or an indexed field (of the given ones) contains the text, without regard to case."""
    return nodes.filter(contains(text, fields))


def nearest_chunks(chunks: DataFrame, vector, limit: int, min_score: float, latest: str | None = None) -> DataFrame:
    """(id, score) of the best chunks with at least that cosine. Scores are rounded to nine places before they are compared.

    Chunks of other dimensions, null or zero vectors don't score; a zero query finds nothing. One scan, then a bounded heap per task. Where ``chunks`` holds several versions of an id,
    ``latest`` names the column that tells the last: versions are scored where they lie, so that scores are shuffled, not vectors."""
    scored = chunks.select("id", *([latest] if latest else []), F.round(cosine_to(list(vector), F.col("vector")), 9).alias("score"))
    if latest:
        scored = scored.groupBy("id").agg(F.max(F.struct(latest, "score")).alias("m")).select("id", "m.score")
    return scored.filter(F.col("score") >= min_score).orderBy(F.desc("score"), "id").limit(limit)


def nodes_of_documents(nodes: DataFrame) -> DataFrame:
    """(doc, node_id): the node a bare document id means, by the order of kinds; else a node of that very id."""
    has = F.col("id").contains(":")
    doc = F.when(has & dims.prefix_rank(F.col("id")).isNotNull(), F.expr("substr(id, instr(id, ':') + 1)")).otherwise(F.col("id"))
    keyed = nodes.select(doc.alias("doc"), F.col("id").alias("node_id"), F.coalesce(dims.prefix_rank(F.col("id")), F.lit(len(dims.KINDS))).alias("r"))
    return keyed.groupBy("doc").agg(F.min(F.struct("r", "node_id")).alias("m")).select("doc", "m.node_id")


def _document(chunk_id: Column) -> Column:
    return F.when(chunk_id.contains(":chunk-"), F.substring_index(chunk_id, ":chunk-", 1)).otherwise(F.substring_index(chunk_id, ":", 1))


def chunk_nodes(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, score): the best score of each node that the hits' documents are. ``hits`` is a limited result."""
    return hits.withColumn("doc", _document(F.col("id"))).join(nodes_of_documents(nodes), "doc").groupBy("node_id").agg(F.max("score").alias("score"))


def semantic(graph: G.Graph, chunks: DataFrame, text: str, encode, min_score: float = 0.7, limit: int = 10, kinds=None, layers=None, vector=None, latest: str | None = None) -> DataFrame:
    """(node_id, score, snippet, match_source): nodes by their best chunk. Three times the limit of chunks is taken before nodes are filtered."""
    check(limit=limit, min_score=min_score)
    vector = vector if vector is not None else encode([_need_text(text)])[0]
    best = chunk_nodes(nearest_chunks(chunks, vector, limit * 3, min_score, latest), graph.nodes)
    rows = _of(graph.nodes, kinds, layers).join(best.withColumnRenamed("node_id", "id"), "id")
    return rows.select(F.col("id").alias("node_id"), "score", _label(), F.lit("semantic").alias("match_source")).orderBy(F.desc("score"), "node_id").limit(limit)


@dataclass
class Hybrid:
    scored: DataFrame  # node_id, semantic, lexical, graph, score, match_source, snippet: every node at or over min_score
    results: DataFrame  # the best of these within limit and budget
    _expansion: Callable[[], DataFrame]
    _violations: Callable[[], DataFrame]
    warnings: list[str] = field(default_factory=list)

    @cached_property
    def expansion(self) -> DataFrame:
        """The edges taken from the seeds."""
        return self._expansion()

    @cached_property
    def layer_violations(self) -> DataFrame:
        """The violations among the results."""
        return self._violations()


def fusion_score(s: Column, g: Column, l: Column) -> Column:  # noqa: E741
    n = F.when(s > 0, 1).otherwise(0) + F.when(g > 0, 1).otherwise(0) + F.when(l > 0, 1).otherwise(0)
    extra = F.when(n > 1, BONUS * (n - 1)).otherwise(0.0)
    return F.least((s * SEMANTIC + g * GRAPH + l * LEXICAL + extra) / F.lit(SEMANTIC + GRAPH + LEXICAL + 0.2), F.lit(1.0))


def fuse(semantic_: DataFrame, lexical_: DataFrame, graph_: DataFrame) -> DataFrame:
    """(node_id, semantic, lexical, graph, score, match_source) of three branches of (node_id, score)."""
    rows = semantic_.select("node_id", "score", F.lit("s").alias("b")).unionByName(lexical_.select("node_id", "score", F.lit("l").alias("b"))).unionByName(graph_.select("node_id", "score", F.lit("g").alias("b")))
    take = lambda b: F.coalesce(F.max(F.when(F.col("b") == b, F.col("score"))), F.lit(0.0))
    p = rows.groupBy("node_id").agg(take("s").alias("semantic"), take("l").alias("lexical"), take("g").alias("graph"))
    source = F.when((F.col("semantic") > 0) & (F.col("graph") > 0), "fusion").when(F.col("semantic") > 0, "semantic").when(F.col("graph") > 0, "graph").otherwise("lexical")
    return p.withColumn("score", F.round(fusion_score(F.col("semantic"), F.col("graph"), F.col("lexical")), 9)).withColumn("match_source", source)


def within_budget(rows: DataFrame, order: list, tokens: Column, most: int, limit: int | None, keep_first: bool) -> DataFrame:
    """The leading rows whose tokens sum to no more than ``most``; the first in any case if ``keep_first``. ``rows`` is what a limit left, or one query's list.

    Each row has a token at least, so no more than ``most`` rows can fit: they are cut to that number first, by a bounded heap per task."""
    top = rows.orderBy(*order).limit(min(limit, most + 1) if limit is not None else most + 1)
    w = Window.orderBy(*order)
    t = top.withColumn("tokens", tokens).withColumn("rank", F.row_number().over(w)).withColumn("total", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("total") <= most
    return t.filter((fits | (F.col("rank") == 1)) if keep_first else fits)


def hybrid(graph: G.Graph, chunks: DataFrame | None, text: str, encode=None, expand: bool = True, depth: int = 2, kinds=None, layers=None, respect_layers: bool = True, min_score: float = 0.5, limit: int = 10, max_tokens: int = 8000, vector=None, latest: str | None = None) -> Hybrid:
    """Vectors, text and graph fused. Text alone scores 0.0417, text and graph 0.25, and so on: without vectors set ``min_score`` accordingly."""
    check(depth=depth, limit=limit, min_score=min_score)
    _need_text(text)
    spark, warnings = graph.nodes.sparkSession, []
    wanted = _of(graph.nodes, kinds, layers)
    none = spark.createDataFrame([], "node_id string, score double")
    words = lambda: measured(lexical(wanted, text).select(F.col("id").alias("node_id"), F.lit(FLAT).alias("score")))
    if chunks is not None and (encode or vector is not None):
        v = vector if vector is not None else encode([text])[0]
        (sem, few_sem), (lex, few_lex) = together(lambda: measured(chunk_nodes(nearest_chunks(chunks, v, limit * 3, min_score * 0.8, latest), graph.nodes)), words)
    else:
        (sem, few_sem), (lex, few_lex) = (none, True), words()
        warnings.append("NO_EMBEDDINGS: the index has no vectors, semantic search skipped")
    near, expansion = none, lambda: graph.edges.limit(0)
    if expand:
        seeds = sem.select(F.col("node_id").alias("id")).unionByName(lex.select(F.col("node_id").alias("id"))).withColumn("value", F.col("id"))
        hops = G.reaching(graph, seeds, depth, None, respect_layers, few_sem and few_lex)
        # a seed other than the node itself reaches it if the least or the greatest that does is another
        near = hops[-1].filter("lo <> id or hi <> id").select(F.col("id").alias("node_id"), F.lit(FLAT).alias("score"))
        expansion = lambda: G.traversed(graph, hops[-2], None, respect_layers)
    scored = fuse(sem, lex, near).filter(F.col("score") >= min_score).join(wanted.select(F.col("id").alias("node_id"), snippet(F.col("kind"), F.col("indexed_fields")["title"], F.col("id")).alias("snippet")), "node_id")
    best = within_budget(scored, [F.desc("score"), F.col("node_id")], F.greatest(F.lit(1), F.floor(F.length("snippet") / 4)), max_tokens, limit, True).select("node_id", "score", "snippet", "match_source", "tokens", "rank")
    return Hybrid(scored, best, expansion, lambda: _violations_among(graph, best.select(F.col("node_id").alias("id"))), warnings)


def find_spec(graph: G.Graph, chunks: DataFrame | None, text: str, encode=None, vector=None, latest: str | None = None) -> Hybrid:
    return hybrid(graph, chunks, text, encode, limit=5, min_score=0.1, vector=vector, latest=latest)


def listing(nodes: DataFrame, kinds: list[str] | None = None, domain: str | None = None) -> DataFrame:
    n = _of(nodes, kinds, None)
    if domain is not None:
        n = n.filter(F.col("domain") == domain)
    return n.select("id", "kind", "layer", "source_file", F.col("indexed_fields")["title"].alias("title"))


def stats(graph: G.Graph, chunks: DataFrame) -> DataFrame:
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return count(graph.nodes, "nodes").unionByName(count(graph.edges, "edges")).unionByName(count(graph.orphans, "orphan_edges")).unionByName(count(chunks, "embeddings"))


# Context -------------------------------------------------------------------------------------------------------------


@dataclass
class Context:
    hints: DataFrame  # node_id, hint, hint_pos, method
    items: DataFrame  # every discovered node with content, in order
    constraints: DataFrame
    behavior: DataFrame
    warnings: list[str]


def _basename(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    stem, dot, _ = name.rpartition(".")
    return stem if dot and stem else name


def resolve_hints(nodes: DataFrame, hints: list[str]) -> tuple[DataFrame, list[str]]:
    """((node_id, hint, place, method), warnings). A hint is an id, a path, or words; the first way that finds a node which no earlier hint has found decides.

    One scan tries all ways of all hints; what they find, one row a node and way, stays a frame. The driver only learns, hint by hint, which way was the first."""
    prefixes = [p for _, p, *_ in dims.KINDS]
    everything = F.lower(F.concat_ws(" ", "id", "aliases", F.map_values("indexed_fields")))

    def named(name: str) -> Column:
        return F.col("id").isin([f"{p}:{n}" for n in dict.fromkeys([name, name[:1].upper() + name[1:]]) for p in prefixes])

    def says(words: list[str]) -> Column:
        out = contains(words[0])
        for w in words[1:]:
            out = out & F.coalesce(everything.contains(w.lower()), F.lit(False))
        return out

    ways: list[tuple[int, int, str, Column]] = []  # place, order, method, which nodes
    for place, hint in enumerate(hints):
        path = "/" in hint or "." in hint
        if ":" in hint:
            ways.append((place, 0, "exact", F.col("id") == hint))
        if path:
            ways.append((place, 1, "basename", named(_basename(hint))))
            ways.append((place, 2, "text_search", says([_basename(hint)])))
        elif ":" not in hint:
            ways.append((place, 1, "exact", named(hint)))
        if hint.split():
            ways.append((place, 3, "text_search", says(hint.split())))
    kind = "struct<place: int, way: int, method: string>"
    tried = F.filter(F.array(*[F.when(cond, F.struct(F.lit(p), F.lit(w), F.lit(m)).cast(kind)) for p, w, m, cond in ways]), lambda x: x.isNotNull()) if ways else F.array().cast(f"array<{kind}>")
    found = cut(nodes.select("id", F.explode(tried).alias("w")).select("id", "w.*").distinct())
    picks, warnings = [], []
    taken = lambda: (F.col("place") * 4 + F.col("way")).isin([p * 4 + w for p, w in picks]) if picks else F.lit(False)
    for place, hint in enumerate(hints):
        mine = F.when(F.col("place") == place, F.col("way"))
        by_id = found.groupBy("id").agg(F.max(taken()).alias("old"), F.min(mine).alias("way"))
        r = by_id.filter("way is not null").agg(F.min("way").alias("any"), F.min(F.when(~F.col("old"), F.col("way"))).alias("new")).first()
        if r["any"] == 0:  # an id that is there, found before or not
            picks.append((place, 0))
        elif r["new"] is not None:
            picks.append((place, r["new"]))
        else:
            warnings.append(f"No match found for hint: '{hint}'")
    of = F.element_at(F.array(*map(F.lit, hints)), F.col("place") + 1)
    first = found.filter(taken()).groupBy("id").agg(F.min(F.struct("place", "method")).alias("f"))
    return first.select(F.col("id").alias("node_id"), F.col("f.place").alias("place"), F.col("f.method").alias("method")).select("node_id", of.alias("hint"), "place", "method"), warnings


def discover(graph: G.Graph, resolved: DataFrame, depth: int = 1) -> DataFrame:
    """(id, via, distance, place, step): the hinted nodes, their neighbours over any edge (violations too), and with ``depth`` over one what a search reaches.

    ``resolved`` has (node_id, place). The first discovery of a node counts: by place of the hint, then itself, outgoing, incoming, further."""
    roots = resolved.select(F.col("node_id").alias("root"), "place")
    arrow = F.concat("from_node", F.lit(" -> "), F.coalesce("edge_type", F.lit("")), F.lit(" -> "), "to_node").alias("via")
    key = F.concat_ws("\x01", "source_file", F.lpad(F.coalesce("ordinal", F.lit(0)).cast("string"), 20, "0"), F.coalesce("edge_type", F.lit(""))).alias("key")
    roots, small = measured(roots)
    first = roots.select(F.col("root").alias("id"), F.col("root").alias("via"), F.lit(0).alias("distance"), "place", F.lit(0).alias("step"), F.lit("").alias("key"))
    outgoing = near_join(graph.edges, roots.withColumnRenamed("root", "from_node"), small, "from_node", "to_node").select(F.col("to_node").alias("id"), arrow, F.lit(1).alias("distance"), "place", F.lit(1).alias("step"), key)
    incoming = near_join(graph.edges, roots.withColumnRenamed("root", "to_node"), small, "to_node", "from_node").select(F.col("from_node").alias("id"), arrow, F.lit(1).alias("distance"), "place", F.lit(2).alias("step"), key)
    rows = first.unionByName(outgoing).unionByName(incoming)
    if depth > 1:
        # the least (place, root) that reaches a node is enough: a root that is nearer than two hops has a row of an earlier step above
        reached = G.reaching(graph, roots.select(F.col("root").alias("id"), F.struct("place", "root").alias("value")), depth)[-1]
        via = F.concat("lo.root", F.lit(f" -> traverse({depth}) -> "), "id").alias("via")
        rows = rows.unionByName(reached.select("id", via, F.lit(2).alias("distance"), F.col("lo.place").alias("place"), F.lit(3).alias("step"), F.lit("").alias("key")))
    best = rows.groupBy("id").agg(F.min(F.struct("place", "step", "key", "via", "distance")).alias("b"))
    return best.select("id", "b.via", "b.distance", "b.place", "b.step", "b.key")


def content(nodes: DataFrame) -> DataFrame:
    """(id, kind, source_file, content, priority): what a node contributes to a context, cut to 300 characters; nodes without content are left out."""
    f = lambda name: F.coalesce(F.col("indexed_fields")[name], F.lit(""))
    first = lambda *xs: F.coalesce(*[F.when(x != "", x) for x in xs], F.lit(""))
    joined = lambda a, b: F.concat_ws(" | ", F.when(f(a) != "", f(a)), F.when(f(b) != "", f(b)))
    rule = F.col("kind").isin("business-rule", "business-policy", "cross-policy")
    body = (
        F.when(rule, f("declaration"))
        .when(F.col("kind") == "entity", first(f("invariants"), f("description")))
        .when(F.col("kind") == "command", joined("preconditions", "postconditions"))
        .when(F.col("kind") == "use-case", joined("description", "preconditions"))
        .when(F.col("kind") == "requirement", f("description"))
        .otherwise(first(f("description"), f("purpose"), F.col("id")))
    )
    priority = F.when(rule, 0).when(F.col("kind") == "entity", 1).when(F.col("kind").isin("command", "use-case", "requirement"), 2).otherwise(3)
    cut300 = F.when(F.length("content") > 300, F.concat(F.substring("content", 1, 297), F.lit("..."))).otherwise(F.col("content"))
    return nodes.select("id", "kind", "source_file", body.alias("content"), priority.alias("priority")).filter("content <> ''").withColumn("content", cut300)


def context(graph: G.Graph, hints: list[str], depth: int = 1, max_tokens: int = 4000) -> Context:
    """What bears on the hinted nodes, rules and entities first, within a budget of tokens that is never exceeded."""
    if not hints:
        raise QueryError("EMPTY_HINTS", "no hints")
    check(depth=depth, most_depth=3)
    resolved, warnings = resolve_hints(graph.nodes, hints)
    items = cut(content(graph.nodes).join(discover(graph, resolved, depth), "id"))
    tokens = F.ceil(F.length(F.concat_ws(" ", "id", "kind", "content", F.coalesce("source_file", F.lit("")), "via")) / 4)
    order = [F.col(c) for c in ("priority", "distance", "place", "step", "key", "id")]
    kept = within_budget(items, order, tokens, max_tokens, None, False).select("rank", F.col("id").alias("node_id"), "kind", "content", "source_file", "via", "priority", "tokens")
    return Context(resolved, items, kept.filter("priority <= 1"), kept.filter("priority > 1"), warnings)
