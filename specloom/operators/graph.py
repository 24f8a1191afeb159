"""The property graph: building it, its edges and neighbours, breadth-first search over it.

A graph is two DataFrames, nodes (id, kind, layer, ...) and edges (from_node, to_node, edge_type, source_file, ordinal, ...). Where the first of
several equal edges counts, first means by (source_file, ordinal, edge_id). Searches run hop by hop; each hop is one join of the frontier with the edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import DEFAULT_LAYER
from ..runtime import SALTS, measured, near_join

def current(rows: DataFrame, keys: list[str], *latest: str) -> DataFrame:
    """The last row of each key by the given columns; redelivered rows once. One shuffle, combined before it."""
    rest = [c for c in rows.columns if c not in keys and c not in latest and rows.schema[c].dataType.typeName() != "map"]
    maps = [c for c in rows.columns if rows.schema[c].dataType.typeName() == "map"]
    order = F.struct(*latest, *rest)
    picked = rows.groupBy(*keys).agg(F.max(order).alias("b"), *(F.max_by(c, order).alias(c) for c in maps))
    return picked.select(*keys, *(F.col(f"b.{c}").alias(c) for c in [*latest, *rest]), *maps).select(*rows.columns)


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    orphans: DataFrame


def _exists(edges: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges with from_exists and to_exists; ``rows`` are these edges or more, as cheap to read as there are.

    What is looked up are the distinct ends, combined before their shuffle, so a hub is one row a task. Those that are no nodes are few as a rule: measured, and if small
    broadcast to the edges, which then don't move; else joined by salted keys."""
    ends = rows.select(F.explode(F.array("from_node", "to_node")).alias("id")).filter("id is not null").distinct()
    missing, small = measured(ends.join(nodes.select("id").distinct(), "id", "left_anti"))
    for side, other in (("from", "to_node"), ("to", "from_node")):
        key = f"{side}_node"
        lost = missing.select(F.col("id").alias(key), F.lit(True).alias("_lost"))
        if small:
            edges = edges.join(F.broadcast(lost), key, "left")
        else:
            salt = F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")
            edges = edges.withColumn("_salt", salt).join(lost.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "_salt"], "left").drop("_salt")
        edges = edges.withColumn(f"{side}_exists", F.col(key).isNotNull() & F.col("_lost").isNull()).drop("_lost")
    return edges


def first_edges(edges: DataFrame) -> DataFrame:
    """One edge of each (from_node, to_node, edge_type), the first; a null type equals a null type. An aggregation, combined before its shuffle."""
    keys = ["from_node", "to_node", "edge_type"]
    known = [c for c in ("source_file", "ordinal", "edge_id") if c in edges.columns]
    maps = [c for c in edges.columns if edges.schema[c].dataType.typeName() == "map"]
    rest = [c for c in edges.columns if c not in [*keys, *maps, *known]]
    order = F.struct(*[x for c in known for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))], *rest) if known or rest else F.struct(F.lit(0))
    first = edges.groupBy(*keys).agg(F.min(order).alias("f"), *(F.min_by(c, order).alias(c) for c in maps))
    return first.select(*keys, *(F.col(f"f.{c}").alias(c) for c in [*known, *rest]), *maps).select(*edges.columns)


def reason(from_exists: Column, to_exists: Column) -> Column:
    return F.when(~from_exists & ~to_exists, "both_missing").when(~from_exists, "missing_source").otherwise("missing_target")


def build(nodes: DataFrame, edges: DataFrame, rows: DataFrame | None = None) -> Graph:
    """Edges with both ends become the graph's, one of each (from, to, type); all others are orphans, kept as they are.

    Blank or null ends never exist. An empty table gives an empty graph. Where ``edges`` were made from other rows at some cost, their ends are looked up in these ``rows``."""
    marked = _exists(edges, nodes, edges if rows is None else rows)
    both = F.col("from_exists") & F.col("to_exists")
    orphans = marked.filter(~both).withColumn("reason", reason(F.col("from_exists"), F.col("to_exists")))
    return Graph(nodes, first_edges(marked.filter(both).drop("from_exists", "to_exists")), orphans)


def insert(graph: Graph, edges: DataFrame) -> Graph:
    """The graph with further edges, one or many: those with both ends are added unless there is one of their (from, to, type) already, the others become orphans.

    Only the new edges are looked up; the graph's own are not built again."""
    marked = _exists(edges, graph.nodes, edges)
    both = F.col("from_exists") & F.col("to_exists")
    keys = ["from_node", "to_node", "edge_type"]
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
    fresh = first_edges(marked.filter(both).drop("from_exists", "to_exists")).alias("n").join(graph.edges.select(*keys).alias("o"), same, "left_anti")
    orphans = marked.filter(~both).withColumn("reason", reason(F.col("from_exists"), F.col("to_exists")))
    return Graph(graph.nodes, graph.edges.unionByName(fresh, True), graph.orphans.unionByName(orphans, True))


def usable(edges: DataFrame, edge_types: list[str] | None = None, respect_layers: bool = True) -> DataFrame:
    """Edges a search may take: no layer violations if layers are respected; of the given types (none given: all, an empty list: none)."""
    if respect_layers:
        edges = edges.filter(~F.coalesce("layer_violation", F.lit(False)))
    return edges if edge_types is None else edges.filter(F.col("edge_type").isin(list(edge_types)))


def incident(edges: DataFrame) -> DataFrame:
    """Each edge from both its ends: (node_id, other, direction, edge columns); a loop comes twice."""
    out = edges.withColumn("node_id", F.col("from_node")).withColumn("other", F.col("to_node")).withColumn("direction", F.lit("out"))
    return out.unionByName(edges.withColumn("node_id", F.col("to_node")).withColumn("other", F.col("from_node")).withColumn("direction", F.lit("in")))


def _both_ways(links: DataFrame) -> DataFrame:
    """(id, next) of each edge from either end."""
    return links.select(F.col("from_node").alias("id"), F.col("to_node").alias("next")).unionByName(links.select(F.col("to_node").alias("id"), F.col("from_node").alias("next")))


def _roots(graph: Graph, roots: DataFrame, known: bool) -> DataFrame:
    own = roots.select(F.col("id").alias("root")).distinct()
    return own if known else own.join(graph.nodes.select(F.col("id").alias("root")).distinct(), "root", "left_semi")


def search(graph: Graph, roots: DataFrame, depth: int, edge_types: list[str] | None = None, respect_layers: bool = True, known: bool = False) -> DataFrame:
    """(root, id, distance): what each root reaches over edges in either direction within ``depth`` hops, itself at 0.

    Roots that are no nodes reach nothing; ``known`` ones are not looked up. Each hop joins the frontier with the edges and takes off what was seen. A frontier is cut from its lineage and
    measured: a small one is broadcast, of a large one the keys are salted. The last hop is left to the caller's plan."""
    near = _both_ways(usable(graph.edges, edge_types, respect_layers))
    start, small = measured(_roots(graph, roots, known).select("root", F.col("root").alias("id"), F.lit(0).alias("distance")))
    seen = frontier = start
    for hop in range(1, depth + 1):
        found = near_join(near, frontier.select("root", "id"), small, "id", "next").select("root", F.col("next").alias("id")).distinct()
        frontier = found.join(seen.select("root", "id"), ["root", "id"], "left_anti").select("root", "id", F.lit(hop).alias("distance"))
        if hop < depth:
            frontier, small = measured(frontier)
        seen = seen.unionByName(frontier)
    return seen


def reaching(graph: Graph, seeds: DataFrame, depth: int, edge_types: list[str] | None = None, respect_layers: bool = True, few: bool | None = None) -> list[DataFrame]:
    """For 0 to ``depth`` hops, (id, lo, hi): the least and the greatest ``value`` of the seeds (id, value) that reach a node within so many hops.

    ``few`` says whether the seeds, computed already, were measured as small. The state is one row a node, however many seeds there are: least and greatest of a union are those of its parts, so each hop is one join and one aggregation."""
    near = _both_ways(usable(graph.edges, edge_types, respect_layers))
    state, small = seeds.groupBy("id").agg(F.min("value").alias("lo"), F.max("value").alias("hi")), few
    if few is None:
        state, small = measured(state)
    out = [state]
    for hop in range(1, depth + 1):
        came = near_join(near, state, small, "id", "next").select(F.col("next").alias("id"), "lo", "hi")
        state = state.unionByName(came).groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        if hop < depth:
            state, small = measured(state)
        out.append(state)
    return out


def traversed(graph: Graph, inner: DataFrame, edge_types: list[str] | None = None, respect_layers: bool = True) -> DataFrame:
    """The graph's edges that a search took: an end of each is one of ``inner`` (id), the nodes nearer than its depth."""
    inner, small = measured(inner.select("id").distinct())
    links = usable(graph.edges, edge_types, respect_layers)
    mark = lambda side, df: df.join(F.broadcast(inner.select(F.col("id").alias(f"{side}_node"), F.lit(True).alias(f"_{side}"))), f"{side}_node", "left")
    if small:
        return mark("to", mark("from", links)).filter("_from or _to").select(*links.columns)
    # either end may be the inner one: both joins are salted, an edge of both taken once
    by = lambda side, other: near_join(links, inner.select(F.col("id").alias(f"{side}_node")), False, f"{side}_node", other).select(*links.columns)
    return first_edges(by("from", "to_node").unionByName(by("to", "from_node")))


def dependents(graph: Graph, roots: DataFrame, depth: int, known: bool = False) -> DataFrame:
    """(root, id, distance, path, edge_types): nodes from which edges lead to the root, with the shortest way back from the root, over edges of any kind.

    Of several shortest ways the least by (path, edge types) counts. The root itself is left out."""
    back = graph.edges.select(F.col("to_node").alias("at"), F.col("from_node").alias("next"), F.coalesce("edge_type", F.lit("")).alias("edge_type"))
    start, small = measured(_roots(graph, roots, known).select("root", F.col("root").alias("id"), F.lit(0).alias("distance"), F.array("root").alias("path"), F.array().cast("array<string>").alias("edge_types")))
    seen = frontier = start
    for hop in range(1, depth + 1):
        way = F.struct(F.concat("path", F.array("next")).alias("path"), F.concat("edge_types", F.array("edge_type")).alias("edge_types"))
        came = near_join(back, frontier.select("root", F.col("id").alias("at"), "path", "edge_types"), small, "at", "next")
        found = came.groupBy("root", F.col("next").alias("id")).agg(F.min(way).alias("w"))
        frontier = found.join(seen.select("root", "id"), ["root", "id"], "left_anti").select("root", "id", F.lit(hop).alias("distance"), "w.path", "w.edge_types")
        if hop < depth:
            frontier, small = measured(frontier)
        seen = seen.unionByName(frontier)
    return seen.filter("distance > 0")


def violations(graph: Graph) -> DataFrame:
    """Layer violations with the layers and kinds of their ends (a null layer counts as the default one)."""
    side = lambda p: graph.nodes.select(F.col("id").alias(f"{p}_node"), F.coalesce("layer", F.lit(DEFAULT_LAYER)).alias(f"{p}_layer"), F.col("kind").alias(f"{p}_kind"))
    return graph.edges.filter("layer_violation").join(side("from"), "from_node").join(side("to"), "to_node")


def rank(keys: list[str], order: list) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
