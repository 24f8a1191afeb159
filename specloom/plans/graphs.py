"""Queries on the property graph and over its embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import extract as E
from ..operators import graph as G
from ..operators import retrieval as R
from ..runtime import cut, together
from .base import CHUNKS_SQL, GRAPH_SQL, HUB, NEAR_SQL, NODES_SQL, VECTOR, VECTOR_SQL, chunks, graph, nodes, versions

TYPES = ["EMITS", "ENTITY_RULE"]
TEXT = "marea"
AT = "generated_at"
HINTS = ["Entity:ZonaComun", "specs/01-domain/entities/CarpetaMaestra.md", "cmd-comun-05", "nothing of the kind"]
KEYS = ["from_node", "to_node", "edge_type"]


def edge_build_dedupe(spark, d):
    return graph(spark, d).edges.select(*KEYS, "edge_id", "source_file", "ordinal")


def orphan_edges(spark, d):
    return R.orphan_edges(graph(spark, d))


def orphan_edges_typed(spark, d):
    return R.orphan_edges(graph(spark, d), TYPES)


def orphan_rate(spark, d):
    g = graph(spark, d)
    return R.rate(g.orphans, g.orphans.select(*KEYS).unionByName(g.edges.select(*KEYS)), "orphans")


def layer_violations(spark, d):
    return R.layer_violations(graph(spark, d), kinds=["entity", "command"])


def violation_rate(spark, d):
    g = graph(spark, d)
    return R.rate(R.layer_violations(g), g.edges, "violations")


def violation_check(spark, d):
    """The rule for violations, from the layers that the ids of the ends stand for."""
    g = graph(spark, d)
    origin, target = dims.layer_of_node_id(F.col("from_node")), dims.layer_of_node_id(F.col("to_node"))
    return g.edges.groupBy(origin.alias("origin"), target.alias("target"), dims.is_violation(origin, target).alias("violation")).agg(F.count("*").alias("edges"))


def coverage_all(spark, d):
    c = R.coverage(graph(spark, d))
    return c.select("node_id", "category", "edge_type", "status", "links")


def coverage_links(spark, d):
    return R.coverage_links(graph(spark, d))


def coverage_percent(spark, d):
    return R.coverage_percent(R.coverage(graph(spark, d)))


def incident_edges(spark, d):
    """Incoming and outgoing edges of each node, counted by type."""
    return G.incident(graph(spark, d).edges).groupBy("node_id", "direction", "edge_type").agg(F.count("*").alias("edges"), F.countDistinct("other").alias("others"))


def node_lookup(spark, d):
    """Ids that edges name as their origin, and whether they are nodes."""
    g = graph(spark, d)
    return g.orphans.select("from_node", "from_exists").unionByName(g.edges.select("from_node", F.lit(True).alias("from_exists"))).distinct()


def node_list(spark, d):
    return R.listing(nodes(spark, d), ["entity", "command"], "taller")


def index_stats(spark, d):
    return R.stats(graph(spark, d), chunks(spark, d))


def _kept(g: G.Graph, nodes_too: bool = False) -> G.Graph:
    """The graph computed once for a search of several hops: narrow edges, cut from their lineage; the nodes as well where a query reads them more than twice."""
    edges = lambda: cut(g.edges.select(*KEYS, "source_file", "ordinal", "edge_id", "layer_violation"))
    if not nodes_too:
        return G.Graph(g.nodes, edges(), g.orphans)
    kept = lambda: cut(g.nodes.select("id", "kind", "layer", "domain", "source_file", "aliases", "indexed_fields"))
    return G.Graph(*together(kept, edges), g.orphans)


def bfs_depth1(spark, d):
    return R.related(_kept(graph(spark, d)), HUB, 1).nodes.select("node_id", "distance", F.round("score", 6).alias("score"), "snippet")


def bfs_depth2(spark, d):
    return R.related(_kept(graph(spark, d)), HUB, 2).nodes.select("node_id", "distance", F.round("score", 6).alias("score"), "snippet")


def bfs_typed(spark, d):
    return R.related(_kept(graph(spark, d)), "Entity:ZonaComun", 2, ["WIKI_LINK", "EMITS"], kinds=["event", "entity", "business-rule"]).nodes.select("node_id", "distance")


def bfs_edges(spark, d):
    return R.related(_kept(graph(spark, d)), HUB, 2).edges.select(*KEYS)


def impact_direct(spark, d):
    return R.impact(graph(spark, d), HUB).direct


def impact_transitive(spark, d):
    t = R.impact(_kept(graph(spark, d)), HUB).transitive
    return t.select("node_id", "kind", F.array_join("path", ">").alias("path"), F.array_join("edge_types", ">").alias("edge_types"))


def impact_scenarios(spark, d):
    """The scenarios to run again. The tables hold none: each requirement's traces are written as a feature file, which goes through the extraction and is added to the graph."""
    g = _kept(graph(spark, d), True)
    traces = g.edges.filter("edge_type = 'REQ_TRACES_TO'").groupBy("from_node").agg(F.array_sort(F.collect_set(F.concat(F.lit("@"), F.expr("substr(to_node, instr(to_node, ':') + 1)")))).alias("tags"))
    content = F.concat(F.lit("Feature: "), "from_node", F.lit("\n\n  "), F.array_join("tags", " "), F.lit("\n  Scenario: check "), "from_node", F.lit("\n    Given that\n"))
    files = traces.select(F.concat(F.lit("specs/04-verification/examples/"), F.translate("from_node", ":", "_"), F.lit(".feature")).alias("path"), content.alias("content"))
    said, checks = E.features(files)
    more = G.Graph(g.nodes.unionByName(said.select(*g.nodes.columns)), g.edges, g.orphans)
    return R.impact(_kept(G.insert(more, checks.withColumn("edge_id", F.lit(None).cast("bigint")).select(*g.edges.columns))), HUB).scenarios


def semantic_topk(spark, d):
    return R.nearest_chunks(versions(spark, d), VECTOR, 30, 0.1, AT).withColumn("score", F.round("score", 6))


def semantic_nodes(spark, d):
    g = graph(spark, d)
    return R.semantic(g, versions(spark, d), "", None, latest=AT, min_score=0.1, limit=10, kinds=["entity", "use-case", "command", "event"], vector=VECTOR).select("node_id", F.round("score", 6).alias("score"), "snippet", "match_source")


def lexical_search(spark, d):
    return R.lexical(nodes(spark, d), TEXT).select("id", "kind")


def lexical_fields(spark, d):
    return R.lexical(nodes(spark, d), TEXT, ["description", "declaration"]).select("id", "kind")


def _hybrid(spark, d, **options):
    g = _kept(graph(spark, d), True)
    return R.hybrid(g, versions(spark, d), TEXT, min_score=0.04, vector=VECTOR, latest=AT, **options)


def hybrid_fusion(spark, d):
    s = _hybrid(spark, d).scored
    return s.select("node_id", "match_source", "snippet", *(F.round(c, 6).alias(c) for c in ("semantic", "lexical", "graph", "score")))


def hybrid_search(spark, d):
    return _hybrid(spark, d, limit=20).results.select("node_id", F.round("score", 6).alias("score"), "snippet", "match_source", "rank")


def hybrid_budget(spark, d):
    return _hybrid(spark, d, limit=100, max_tokens=60).results.select("node_id", "tokens", "rank")


def hybrid_graph_expansion(spark, d):
    return _hybrid(spark, d, depth=1).expansion.select(*KEYS)


def hybrid_lexical_only(spark, d):
    g = _kept(graph(spark, d), True)
    return R.hybrid(g, None, TEXT, min_score=0.01, depth=1, kinds=["entity", "event"], limit=50).results.select("node_id", F.round("score", 6).alias("score"), "match_source")


def find_spec(spark, d):
    return R.find_spec(_kept(graph(spark, d), True), versions(spark, d), TEXT, vector=VECTOR, latest=AT).results.select("node_id", F.round("score", 6).alias("score"), "match_source")


def context_hints(spark, d):
    return R.context(_kept(graph(spark, d), True), HINTS).hints


def context_items(spark, d):
    c = R.context(_kept(graph(spark, d), True), ["Entity:ZonaComun"], depth=1)
    return c.items.select("id", "kind", "content", "priority", "distance")


def context_budget(spark, d):
    c = R.context(_kept(graph(spark, d), True), HINTS, depth=1, max_tokens=600)
    return c.constraints.unionByName(c.behavior)


def chunk_documents(spark, d):
    """The node that each chunk's document is."""
    c = chunks(spark, d).select(R._document(F.col("id")).alias("doc")).groupBy("doc").agg(F.count("*").alias("chunks"))
    return c.join(R.nodes_of_documents(nodes(spark, d)), "doc", "left")


_QUERIES = [
    edge_build_dedupe, orphan_edges, orphan_edges_typed, orphan_rate, layer_violations, violation_rate, violation_check, coverage_all, coverage_links, coverage_percent, incident_edges, node_lookup, node_list, index_stats,
    bfs_depth1, bfs_depth2, bfs_typed, bfs_edges, impact_direct, impact_transitive, impact_scenarios, semantic_topk, semantic_nodes, lexical_search, lexical_fields, hybrid_fusion, hybrid_search, hybrid_budget,
    hybrid_graph_expansion, hybrid_lexical_only, find_spec, context_hints, context_items, context_budget, chunk_documents,
]
QUERIES = {f.__name__: f for f in _QUERIES}

_LABEL = "'[' || {n}.kind || '] ' || coalesce(nullif({n}.indexed_fields['title'], ''), {n}.id)"
_PREFIXES = ", ".join(f"('{p}', {i}, '{layer}')" for i, (_, p, _p, _h, layer) in enumerate(dims.KINDS))
_LAYER = "case {0} " + " ".join(f"when '{x}' then {i}" for i, x in enumerate(dims.LAYERS)) + " end"
_COVER = ", ".join(f"('{k}', '{c}', '{t}')" for k, c, _, t in dims.COVERAGE)
_VIOLATIONS = f"with {GRAPH_SQL}, v as (select g.*, coalesce(a.layer, '01-domain') as from_layer, coalesce(b.layer, '01-domain') as to_layer, a.kind as from_kind, b.kind as to_kind from g join n a on a.id = from_node join n b on b.id = to_node where layer_violation)"
_COVERED = f"""with {GRAPH_SQL}, rules as (from (values {_COVER}) t(kind, category, edge_type)),
ends as (select from_node as id, edge_type, to_node as other from g union select to_node, edge_type, from_node from g),
cov as (select n.id as node_id, category, rules.edge_type, list(other order by other) filter (other is not null) as f from n join rules using (kind) left join ends on ends.id = n.id and ends.edge_type = rules.edge_type group by all)"""
_REACH = f"""with {GRAPH_SQL}, {NEAR_SQL},
r0 as (select '{HUB}' as id), r1 as (select distinct b as id from near where a in (from r0) and b not in (from r0)),
r2 as (select distinct b as id from near where a in (from r1) and b not in (from r0) and b not in (from r1))"""
_DOCS = f"""pre as (from (values {_PREFIXES}) t(prefix, r, layer)),
docs as (select doc, arg_min(id, (r, id)) as node_id from (
  select case when pre.prefix is not null then substr(id, instr(id, ':') + 1) else id end as doc, id, coalesce(r, 99) as r
  from n left join pre on contains(id, ':') and pre.prefix = split_part(id, ':', 1)) group by doc)"""
_HITS = f"""{CHUNKS_SQL}, h as (select id, round(s, 9) as score from (
  select id, list_cosine_similarity(vector::double[], list_transform({VECTOR_SQL}::float[], lambda x: x::double)) as s from c
  where len(vector) = 64 and len(list_filter(vector, lambda x: x is null)) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0) where isfinite(s))"""
_LEX = "exists (select 1 from unnest(list_concat([n.id], coalesce(n.aliases, []), coalesce(map_values(n.indexed_fields), []))) as t(v) where contains(lower(v), 'marea'))"


def _fused(limit: int, low: float, depth: int, kinds: str = "true", chunked: bool = True) -> str:
    sem = f"select node_id, max(score) as s from (select * from h where score >= {low} order by score desc, id limit {limit * 3}) t join docs on docs.doc = split_part(t.id, ':chunk-', 1) group by node_id" if chunked else "select null as node_id, null as s where false"
    hops = "".join(f", k{i} as (select distinct seed, b as id from k{i - 1} join near on near.a = k{i - 1}.id)" for i in range(1, depth + 1))
    every = " union ".join(f"select * from k{i}" for i in range(depth + 1))
    return f"""with {GRAPH_SQL}, {NEAR_SQL}, {_DOCS}, {_HITS}, sem as ({sem}), lex as (select id as node_id from n where {_LEX} and {kinds}),
k0 as (select node_id as seed, node_id as id from sem union select node_id, node_id from lex){hops}, reach as ({every}),
gr as (select distinct id as node_id from reach where seed <> id),
p as (select n.id as node_id, coalesce(sem.s, 0) as semantic, if(lex.node_id is null, 0, 0.5) as lexical, if(gr.node_id is null, 0, 0.5) as graph, {_LABEL.format(n="n")} as snippet
  from n left join sem on sem.node_id = n.id left join lex on lex.node_id = n.id left join gr on gr.node_id = n.id where {kinds} and (sem.node_id is not null or lex.node_id is not null or gr.node_id is not null)),
q as (select *, (semantic > 0)::int + (lexical > 0)::int + (graph > 0)::int as m from p),
fused as (select *, round(least((semantic * 0.6::double + graph * 0.3::double + lexical * 0.1::double + if(m > 1, 0.1::double * (m - 1), 0)) / 1.2::double, 1), 9) as score,
  case when semantic > 0 and graph > 0 then 'fusion' when semantic > 0 then 'semantic' when graph > 0 then 'graph' else 'lexical' end as match_source from q)"""


def _best(limit: int, most: int, low: float) -> str:
    return f""", b as (select *, row_number() over w as rank, sum(tokens) over w as total from (select *, greatest(1, length(snippet) // 4)::bigint as tokens from fused where score >= {low})
  window w as (order by score desc, node_id rows between unbounded preceding and current row)), best as (select * from b where (rank = 1 or total <= {most}) and rank <= {limit})"""


_CONTENT = """body as (select id, kind, source_file, case
  when kind in ('business-rule', 'business-policy', 'cross-policy', 'requirement') then coalesce(indexed_fields[if(kind = 'requirement', 'description', 'declaration')], '')
  when kind = 'entity' then coalesce(nullif(indexed_fields['invariants'], ''), indexed_fields['description'], '')
  when kind = 'command' then concat_ws(' | ', nullif(indexed_fields['preconditions'], ''), nullif(indexed_fields['postconditions'], ''))
  when kind = 'use-case' then concat_ws(' | ', nullif(indexed_fields['description'], ''), nullif(indexed_fields['preconditions'], ''))
  else coalesce(nullif(indexed_fields['description'], ''), nullif(indexed_fields['purpose'], ''), id) end as t,
  case when kind in ('business-rule', 'business-policy', 'cross-policy') then 0 when kind = 'entity' then 1 when kind in ('command', 'use-case', 'requirement') then 2 else 3 end as priority from n),
content as (select id, kind, source_file, if(length(t) > 300, substr(t, 1, 297) || '...', t) as content, priority from body where t <> '')"""

_ONE_HOP = "select 'Entity:ZonaComun' as id, 0 as distance union all select distinct case when from_node = 'Entity:ZonaComun' then to_node else from_node end, 1 from g where (from_node = 'Entity:ZonaComun') <> (to_node = 'Entity:ZonaComun')"

_BACK = f"""with {GRAPH_SQL}, b as (select to_node as a, from_node as b, coalesce(edge_type, '') as t from g),
d1 as (select b as id, min(t) as t from b where a = '{HUB}' and b <> '{HUB}' group by b),
d2 as (select b.b as id, min((d1.id, d1.t, b.t)) as w from d1 join b on b.a = d1.id where b.b <> '{HUB}' and b.b not in (select id from d1) group by b.b),
d3 as (select b.b as id, min((d2.w[1], d2.id, d2.w[2], d2.w[3], b.t)) as w from d2 join b on b.a = d2.id where b.b <> '{HUB}' and b.b not in (select id from d1) and b.b not in (select id from d2) group by b.b)"""
_TAGGED = "case " + " ".join(f"when starts_with(target, '{s}') then '{p}:' || target" for s, p in dims.LINK_PREFIXES) + " else 'Entity:' || target end"


def _hints(hints: list[str]) -> str:
    """Common tables up to ``hint`` (id, place, method): of each hint the first way that finds a node no earlier hint has found."""
    text = "lower(concat_ws(' ', n.id, array_to_string(n.aliases, ' '), array_to_string(map_values(n.indexed_fields), ' ')))"
    says = lambda words: " and ".join([_LEX.replace("'marea'", f"'{words[0].lower()}'"), *(f"contains({text}, '{w.lower()}')" for w in words[1:])])
    named = lambda x: "n.id in (" + ", ".join(f"'{p}:{y}'" for y in dict.fromkeys([x, x[:1].upper() + x[1:]]) for _, p, *_r in dims.KINDS) + ")"
    out, old = [], "select null as id where false"
    for k, h in enumerate(hints):
        path, base = "/" in h or "." in h, R._basename(h)
        ways = [(0, "exact", f"n.id = '{h}'")] if ":" in h else []
        ways += [(1, "basename", named(base)), (2, "text_search", says([base]))] if path else [(1, "exact", named(h))] if ":" not in h else []
        ways += [(3, "text_search", says(h.split()))] if h.split() else []
        rows = " union all ".join(f"select n.id, {w} as way, '{m}' as method from n where {c}" for w, m, c in ways)
        out.append(f"way{k} as ({rows}), old{k} as ({old}), pick{k} as (select case when bool_or(way = 0) then 0 else min(way) filter (id not in (select id from old{k})) end as way from way{k})")
        out.append(f"new{k} as (select id, {k} as place, method from way{k} where way = (select way from pick{k}) and id not in (select id from old{k}))")
        old = " union all ".join(f"select id from new{j}" for j in range(k + 1))
    return ", ".join(out) + ", hint as (" + " union all ".join(f"select * from new{j}" for j in range(len(hints))) + ")"


_ARROW = "from_node || ' -> ' || coalesce(edge_type, '') || ' -> ' || to_node"
_KEY = "concat_ws(chr(1), source_file, lpad(coalesce(ordinal, 0)::varchar, 20, '0'), coalesce(edge_type, ''))"
_DISCOVERED = f"""found as (
  select id, id as via, 0 as distance, place, 0 as step, '' as key from hint
  union all select to_node, {_ARROW}, 1, place, 1, {_KEY} from g join hint on hint.id = from_node
  union all select from_node, {_ARROW}, 1, place, 2, {_KEY} from g join hint on hint.id = to_node),
disc as (select id, unnest(min({{'place': place, 'step': step, 'key': key, 'via': via, 'distance': distance}})) from found group by id),
item as (select content.*, via, distance, place, step, key, ceil(length(concat_ws(' ', content.id, kind, content, coalesce(source_file, ''), via)) / 4.0)::bigint as tokens from content join disc using (id)),
kept as (select *, row_number() over w as rank, sum(tokens) over w as total from item window w as (order by priority, distance, place, step, key, id rows between unbounded preceding and current row))"""

ORACLE = {
    "context_hints": f"with {NODES_SQL}, {_hints(HINTS)}, said as (from (values " + ", ".join(f"({k}, '{h}')" for k, h in enumerate(HINTS)) + ") t(place, hint)) select id as node_id, hint, place, method from hint join said using (place)",
    "context_budget": f"with {GRAPH_SQL}, {_hints(HINTS)}, {_CONTENT}, {_DISCOVERED} select rank, id as node_id, kind, content, source_file, via, priority, tokens from kept where total <= 600",
    "edge_build_dedupe": f"with {GRAPH_SQL} select from_node, to_node, edge_type, edge_id, source_file, ordinal from g",
    "orphan_edges": f"with {GRAPH_SQL} select from_node, to_node, edge_type, source_file, from_exists, to_exists, case when not from_exists and not to_exists then 'both_missing' when not from_exists then 'missing_source' else 'missing_target' end as reason from x where not (from_exists and to_exists)",
    "orphan_edges_typed": f"with {GRAPH_SQL} select from_node, to_node, edge_type, source_file, from_exists, to_exists, case when not from_exists and not to_exists then 'both_missing' when not from_exists then 'missing_source' else 'missing_target' end as reason from x where not (from_exists and to_exists) and edge_type in ('EMITS', 'ENTITY_RULE')",
    "orphan_rate": f"with {GRAPH_SQL}, o as (select count(*) as orphans from x where not (from_exists and to_exists)), l as (select count(*) as loaded from g) select orphans, orphans + loaded as edges, round(orphans::double / (orphans + loaded) * 10000) / 100 as rate from o, l",
    "layer_violations": _VIOLATIONS + " select from_node, to_node, from_layer, to_layer, edge_type from v where from_kind in ('entity', 'command') or to_kind in ('entity', 'command')",
    "violation_rate": _VIOLATIONS + ", a as (select count(*) as violations from v), b as (select count(*) as edges from g) select violations, edges, round(violations::double / edges * 10000) / 100 as rate from a, b",
    "violation_check": f"with {GRAPH_SQL}, pre as (from (values {_PREFIXES}) t(prefix, r, layer)), y as (select a.layer as origin, b.layer as target from g left join pre a on a.prefix = split_part(from_node, ':', 1) and contains(from_node, ':') left join pre b on b.prefix = split_part(to_node, ':', 1) and contains(to_node, ':')) select origin, target, coalesce(origin <> '00-requirements' and {_LAYER.format('origin')} < {_LAYER.format('target')}, false) as violation, count(*) as edges from y group by all",
    "coverage_all": _COVERED + " select node_id, category, edge_type, if(len(f) > 0, 'covered', 'missing') as status, coalesce(len(f), 0)::bigint as links from cov",
    "coverage_links": _COVERED + " select node_id, category, unnest(f) as other from cov where len(f) > 0",
    "coverage_percent": _COVERED + ", k as (select node_id, count(*) filter (len(f) > 0) as present, count(*) as total from cov group by node_id) select node_id, present, total - present as missing, round(present::double / total * 1000) / 10 as coverage_percent from k",
    "incident_edges": f"with {GRAPH_SQL} select node_id, direction, edge_type, count(*) as edges, count(distinct other) as others from (select from_node as node_id, 'out' as direction, edge_type, to_node as other from g union all select to_node, 'in', edge_type, from_node from g) group by all",
    "node_lookup": f"with {GRAPH_SQL} select distinct from_node, from_exists from x",
    "node_list": f"with {NODES_SQL} select id, kind, layer, source_file, indexed_fields['title'] as title from n where kind in ('entity', 'command') and domain = 'taller'",
    "index_stats": f"with {GRAPH_SQL}, {CHUNKS_SQL} select 'nodes' as what, count(*) as n from n union all select 'edges', count(*) from g union all select 'orphan_edges', count(*) from x where not (from_exists and to_exists) union all select 'embeddings', count(*) from c",
    "bfs_depth1": _REACH + f" select id as node_id, 1 as distance, 0.5::double as score, {_LABEL.format(n='n')} as snippet from n where id in (from r1)",
    "bfs_depth2": _REACH + f", r as (select id, 1 as distance from r1 union all select id, 2 from r2) select id as node_id, distance, round(1.0::double / (1 + distance), 6) as score, {_LABEL.format(n='n')} as snippet from n join r using (id)",
    "bfs_typed": f"with {GRAPH_SQL}, {NEAR_SQL}".replace("not coalesce(layer_violation, false)", "not coalesce(layer_violation, false) and edge_type in ('WIKI_LINK', 'EMITS')") + """,
r0 as (select 'Entity:ZonaComun' as id), r1 as (select distinct b as id from near where a in (from r0) and b not in (from r0)), r2 as (select distinct b as id from near where a in (from r1) and b not in (from r0) and b not in (from r1)),
r as (select id, 1 as distance from r1 union all select id, 2 from r2) select id as node_id, distance from n join r using (id) where kind in ('event', 'entity', 'business-rule')""",
    "bfs_edges": _REACH + ", i as (from r0 union from r1) select from_node, to_node, edge_type from u where from_node in (from i) or to_node in (from i)",
    "impact_direct": f"with {GRAPH_SQL}, t as (from (values " + ", ".join(f"('{k}', '{v}')" for k, v in R.IMPACT.items()) + f") t(edge_type, w)) select n.id as node_id, n.kind, g.edge_type, coalesce(w, 'Connected via ' || coalesce(g.edge_type, '')) || ' — change type: modify_attribute' as impact_description from g join n on n.id = from_node left join t on t.edge_type = g.edge_type where to_node = '{HUB}'",
    "impact_transitive": f"""{_BACK}
select d2.id as node_id, n.kind, '{HUB}>' || w[1] || '>' || d2.id as path, w[2] || '>' || w[3] as edge_types from d2 join n using (id)
union all select d3.id, n.kind, '{HUB}>' || w[1] || '>' || w[2] || '>' || d3.id, w[3] || '>' || w[4] || '>' || w[5] from d3 join n using (id)""",
    "impact_scenarios": f"""{_BACK}, hit as (select '{HUB}' as id union select id from d1 union select id from d2 union select id from d3),
tag as (select distinct from_node, regexp_extract(substr(to_node, instr(to_node, ':') + 1), '^[A-ZÀ-Þ][\\p{{L}}\\p{{N}}_-]*') as target from g where edge_type = 'REQ_TRACES_TO'),
goal as (select from_node, {_TAGGED} as to_node from tag where target <> '')
select distinct 'Scenario:' || replace(from_node, ':', '_') || '-1' as node_id, 'check ' || from_node as scenario_name, 'Validates ' || to_node || ' which is affected' as reason from goal where to_node in (select id from hit) and to_node in (select id from n)""",
    "semantic_topk": f"with {_HITS} select id, round(score, 6) as score from h where score >= 0.1 order by score desc, id limit 30",
    "semantic_nodes": f"with {NODES_SQL}, {_DOCS}, {_HITS}, s as (select node_id, max(score) as score from (select * from h where score >= 0.1 order by score desc, id limit 30) t join docs on docs.doc = split_part(t.id, ':chunk-', 1) group by node_id) select node_id, round(score, 6) as score, {_LABEL.format(n='n')} as snippet, 'semantic' as match_source from s join n on n.id = node_id where kind in ('entity', 'use-case', 'command', 'event') order by s.score desc, node_id limit 10",
    "lexical_search": f"with {NODES_SQL} select id, kind from n where {_LEX}",
    "lexical_fields": f"with {NODES_SQL} select id, kind from n where contains(lower(id || chr(1) || coalesce(array_to_string(aliases, chr(1)), '') || chr(1) || coalesce(indexed_fields['description'], '') || chr(1) || coalesce(indexed_fields['declaration'], '')), 'marea')",
    "hybrid_fusion": _fused(10, 0.04 * 0.8, 2) + " select node_id, match_source, snippet, round(semantic, 6) as semantic, lexical::double as lexical, graph::double as graph, round(score, 6) as score from fused where score >= 0.04",
    "hybrid_search": _fused(20, 0.04 * 0.8, 2) + _best(20, 8000, 0.04) + " select node_id, round(score, 6) as score, snippet, match_source, rank from best",
    "hybrid_budget": _fused(100, 0.04 * 0.8, 2) + _best(100, 60, 0.04) + " select node_id, tokens, rank from best",
    "hybrid_graph_expansion": _fused(10, 0.04 * 0.8, 1) + " select from_node, to_node, edge_type from u where from_node in (select id from k0) or to_node in (select id from k0)",
    "hybrid_lexical_only": _fused(50, 0.01, 1, "n.kind in ('entity', 'event')", False) + _best(50, 8000, 0.01) + " select node_id, round(score, 6) as score, match_source from best",
    "find_spec": _fused(5, 0.1 * 0.8, 2) + _best(5, 8000, 0.1) + " select node_id, round(score, 6) as score, match_source from best",
    "context_items": f"with {GRAPH_SQL}, {_CONTENT}, hop as ({_ONE_HOP}) select content.id, kind, content, priority, distance from content join hop using (id)",
    "chunk_documents": f"with {NODES_SQL}, {_DOCS}, {CHUNKS_SQL}, k as (select split_part(id, ':chunk-', 1) as doc, count(*) as chunks from c group by all) select doc, chunks, node_id from k left join docs using (doc)",
}
