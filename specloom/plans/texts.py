"""Queries on the text and document operators, over whole documents and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import text as X
from ..functions.vectors import HashingEncoder
from ..operators import extract as E
from ..operators import maintain as M
from ..runtime import table
from . import documents
from .base import chunks, edges, nodes


def _texts(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def wiki_links(spark, d):
    """Links of every text: place, target, domain, alias, and the node they mean."""
    links = _texts(spark, d).select("doc_id", F.posexplode(X.wiki_links(F.col("text"))).alias("pos", "l"))
    return links.select("doc_id", "pos", "l.target", "l.domain", "l.alias", X.node_of_link(F.col("l.target")).alias("node_id"))


def link_resolve(spark, d):
    """Where the targets of links lead: node, the layer it stands for, whether it is an entity."""
    t = F.explode(F.transform(X.wiki_links(F.col("raw_text")), lambda x: x["target"])).alias("target")
    rows = table(spark, d, "chunk_embeddings").select(t).distinct()
    node = X.node_of_link(F.col("target"))
    return rows.select("target", node.alias("node_id"), dims.layer_of_node_id(node).alias("layer"), X.is_entity_target(F.col("target")).alias("is_entity"))


def kind_route(spark, d):
    """Every node row's kind as the router reads it, a warning where its file lies elsewhere, and the layer of the path."""
    kind, warning = E.route(F.col("kind"), F.col("source_file"))
    return table(spark, d, "graph_nodes").groupBy(kind.alias("routed"), warning.isNotNull().alias("warned"), dims.layer_of_path(F.col("source_file")).alias("layer")).agg(F.count("*").alias("files"))


def sections(spark, d):
    s = _texts(spark, d).select("doc_id", F.posexplode(X.sections("text")).alias("pos", "s"))
    return s.select("doc_id", "pos", "s.heading", "s.level", "s.path", "s.content")


def section_headings(spark, d):
    """Headings of every text as the section parser finds them, without their paths."""
    s = _texts(spark, d).select("doc_id", F.posexplode(X.sections("text")).alias("pos", "s"))
    return s.select("doc_id", "pos", "s.heading", "s.level")


def anchors(spark, d):
    s = _texts(spark, d).select(F.explode(X.sections("text")).alias("s")).select("s.heading").distinct()
    return s.select("heading", X.anchor("heading").alias("anchor"))


def sentences(spark, d):
    s = _texts(spark, d).select("doc_id", X.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("sentences"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).alias("longest"))


def bullet_items(spark, d):
    items = _texts(spark, d).select("doc_id", F.posexplode(X.list_items(F.col("text"))).alias("pos", "item"))
    return items


def tables(spark, d):
    """Cells of the pipe tables of every text, by the names of their columns."""
    rows = _texts(spark, d).select("doc_id", F.posexplode(E.tables("text")).alias("pos", "row"))
    return rows.select("doc_id", "pos", F.explode("row").alias("name", "value"))


def content_hash(spark, d):
    return _texts(spark, d).select("doc_id", F.sha2("text", 256).alias("hash"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("bigint").alias("tokens"))


def excerpts(spark, d):
    return _texts(spark, d).select("doc_id", X.excerpt(F.col("text")).alias("excerpt"))


def _files(spark, d):
    """Every document as a spec file: its kind and id as a head where the text has none."""
    docs = table(spark, d, "documents").filter("text is not null")
    head = F.concat(F.lit("---\nid: DOC-"), F.col("doc_id").cast("string"), F.lit("\nkind: "), F.coalesce("kind", F.lit("none")), F.lit("\n---\n"))
    return docs.select(F.concat(F.lit("02-behavior/specs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.when(F.col("text").startswith("---\n"), F.col("text")).otherwise(F.concat(head, "text")).alias("content"))


def extracted_nodes(spark, d):
    return E.nodes(E.documents(_files(spark, d))).select("id", "kind", "source_file", "source_hash", "layer", "status")


def extracted_fields(spark, d):
    """The text fields of every node, a row each."""
    return E.nodes(E.documents(_files(spark, d))).select("id", "source_file", F.explode("indexed_fields").alias("field", "value"))


def extracted_edges(spark, d):
    return E.edges(E.documents(_files(spark, d)), spec_edges=True).select("from_node", "to_node", "edge_type", "layer_violation", "bidirectional", "ordinal")


def extracted_chunks(spark, d):
    return E.chunks(E.documents(_files(spark, d))).select("id", "document_id", "document_kind", "section_path", "chunk_index", "char_offset", "raw_text", "context_text", "text_hash")


def encoded_chunks(spark, d):
    c = E.encode(E.chunks(E.documents(_files(spark, d))), HashingEncoder(32), "hashing", 32)
    return c.select("id", "model", "dimensions", F.size("vector").alias("size"))


def index_log(spark, d):
    log = E.index(_files(spark, d)).log
    return log.groupBy(F.col("node_id").isNotNull().alias("indexed"), "skipped_reason", F.col("warning").isNotNull().alias("warned")).agg(F.count("*").alias("files"))


def incremental_diff(spark, d):
    """What changed in each file between the first and the last version of the nodes, removals counted as deletions."""
    n = table(spark, d, "graph_nodes").filter("source_file is not null")
    by = lambda pick: n.groupBy("source_file").agg(pick(F.struct("indexed_at", "source_hash")).alias("v")).select("source_file", F.col("v.source_hash").alias("source_hash"))
    gone = table(spark, d, "node_removals").select("source_file").distinct()
    return M.diff(by(F.min), by(F.max).join(gone, "source_file", "left_anti"))


def _indices(spark, d):
    """The node versions as they came from three indices, by the day they were loaded."""
    return table(spark, d, "graph_nodes").withColumn("index_id", F.pmod(F.dayofyear("loaded_at"), F.lit(3)).cast("int"))


def merge_lww(spark, d):
    removals = table(spark, d, "node_removals").select(F.col("node_id").alias("id"), "removed_at")
    return M.merge_nodes(_indices(spark, d).select("index_id", "id", "source_hash", "indexed_at"), removals).select("id", "source_hash", "conflict")


def merge_edges(spark, d):
    """Edges of three indices united, without those of removed nodes."""
    e = edges(spark, d)
    n, c = nodes(spark, d), chunks(spark, d)
    part = lambda i: M.Tables(n.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == i), e.filter(F.pmod("edge_id", F.lit(3)) == i), c.filter(F.pmod(F.xxhash64("document_id"), F.lit(3)) == i))
    removals = table(spark, d, "node_removals").select(F.col("node_id").alias("id"), "removed_at")
    return M.merge([part(0), part(1), part(2)], removals).edges.select("from_node", "to_node", "edge_type")


def cascade_delete(spark, d):
    gone = table(spark, d, "node_removals").select(F.col("node_id").alias("id"))
    t = M.cascade(M.Tables(nodes(spark, d), edges(spark, d), chunks(spark, d)), gone)
    count = lambda df, name: df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("what"), "rows")
    return count(t.nodes, "nodes").unionByName(count(t.edges, "edges")).unionByName(count(t.embeddings, "embeddings"))


def latest_state(spark, d):
    return M.latest_state(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


def event_windows(spark, d):
    return M.windows(table(spark, d, "events"), "ts", "1 hour", None, "event_type")


def event_windows_sliding(spark, d):
    return M.windows(table(spark, d, "events"), "ts", "1 hour", "30 minutes")


_QUERIES = [
    wiki_links, link_resolve, kind_route, sections, section_headings, anchors, sentences, bullet_items, tables, content_hash, excerpts, extracted_nodes, extracted_fields, extracted_edges, extracted_chunks, encoded_chunks, index_log,
    incremental_diff, merge_lww, merge_edges, cascade_delete, latest_state, event_windows, event_windows_sliding,
]
QUERIES = {f.__name__: f for f in _QUERIES}

_NODE = "case " + " ".join(f"when starts_with(target, '{s}') then '{p}:' || target" for s, p in dims.LINK_PREFIXES) + " else 'Entity:' || target end"
_LINKS = r"""raw as (select {key}, unnest(list_filter(list_transform(regexp_extract_all({text}, '\[\[([^\]]+)\]\]', 1), lambda x: trim(x)), lambda x: x <> '')) as raw,
  generate_subscripts(list_filter(list_transform(regexp_extract_all({text}, '\[\[([^\]]+)\]\]', 1), lambda x: trim(x)), lambda x: x <> ''), 1) - 1 as pos from {rows}),
part as (select *, if(contains(raw, '::'), string_split(raw, '::')[2], raw) as rest from raw),
link as (select {key}, pos, trim(string_split(rest, '|')[1]) as target, case when contains(raw, '::') then trim(string_split(raw, '::')[1]) end as domain, case when contains(rest, '|') then trim(string_split(rest, '|')[2]) end as alias from part)"""
_KINDS = ", ".join(f"('{k}', '{path}')" for k, _, path, *_r in dims.KINDS)
_PATH = "case " + " ".join(f"when contains(source_file, '{x}/') then '{x}'" for x in dims.LAYERS) + f" else '{dims.DEFAULT_LAYER}' end"
_LAYER = ", ".join(f"('{p}', '{layer}')" for _, p, _p, _h, layer in dims.KINDS)
_WINDOW = "select {start} as start{keys}, count(*) as events, round(sum(value), 4) as value from {rows} group by all"

def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\t\n\x{{000B}}\f\r\p{{Z}}\x{{FEFF}}]+|[\t\n\x{{000B}}\f\r\p{{Z}}\x{{FEFF}}]+$', '', 'g')"


ORACLE = documents.ORACLE | {
    "wiki_links": "with " + _LINKS.format(key="doc_id", text="text", rows="documents") + f" select doc_id, pos, target, domain, alias, {_NODE} as node_id from link",
    "link_resolve": "with " + _LINKS.format(key="id", text="raw_text", rows="chunk_embeddings") + f", t as (select distinct target, {_NODE} as node_id from link), l as (from (values {_LAYER}) t(prefix, layer)) select target, node_id, layer, starts_with(node_id, 'Entity:' || target) as is_entity from t left join l on prefix = split_part(node_id, ':', 1)",
    "kind_route": f"with k as (from (values {_KINDS}) t(kind, path)) select k.kind as routed, coalesce(not contains(source_file, path), false) as warned, {_PATH} as layer, count(*) as files from graph_nodes g left join k on k.kind = lower(trim(g.kind)) group by all",
    "section_headings": r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents where text is not null),
h as (select *, row_number() over (partition by doc_id order by n) - 1 as pos from l where starts_with(line, '#'))
select doc_id, pos, regexp_replace(regexp_replace(line, '^#+', ''), '^[\s\x{000B}\x{001C}-\x{001F}\x{0085}\p{Z}]+', '') as heading, length(line) - length(regexp_replace(line, '^#+', '')) as level from h""",
    "sentences": (r"""with s as (select doc_id, case when text is not null then list_filter(list_transform(string_split(regexp_replace(text, '\.[\t\n\x{000B}\f\r\p{Z}\x{FEFF}]+', '.' || chr(1), 'g'), chr(1)), lambda x: @), lambda x: x <> '') end as s from documents)
select doc_id, case when s is null then null else len(s) end as sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) as longest from s""").replace("@", _strip("x")),
    "bullet_items": f"""with i as (select doc_id, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: starts_with(x, '- ') or starts_with(x, '* ')), lambda x: {_strip('substr(x, 3)')}) as i from documents where text is not null)
select doc_id, unnest(generate_series(0, len(i) - 1)) as pos, unnest(i) as item from i where len(i) > 0""",
    "content_hash": "select doc_id, sha256(text) as hash, greatest(1, coalesce(length(text) // 4, 1))::bigint as tokens from documents",
    "incremental_diff": """with v as (select source_file, arg_min(coalesce(source_hash, '#null'), (indexed_at, coalesce(source_hash, ''))) as o, arg_max(coalesce(source_hash, '#null'), (indexed_at, coalesce(source_hash, ''))) as n from graph_nodes where source_file is not null group by source_file)
select source_file, case when source_file in (select source_file from node_removals where source_file is not null) then 'D' when o = n then '=' else 'M' end as change from v""",
    "merge_lww": """with w as (select id, max(indexed_at) as t, arg_max(coalesce(source_hash, '#null'), (indexed_at, coalesce(source_hash, ''))) as h, min(source_hash) <> max(source_hash) as c from graph_nodes group by id),
r as (select node_id, max(removed_at) as gone_at from node_removals group by node_id)
select id, nullif(h, '#null') as source_hash, coalesce(c, false) as conflict from w left join r on node_id = id where gone_at is null or gone_at < t""",
    "merge_edges": """with n as (select id, max(indexed_at) as t from (select id, indexed_at from graph_nodes union all select id, indexed_at from core_nodes) group by id),
r as (select node_id, max(removed_at) as gone_at from node_removals group by node_id), gone as (select node_id from r left join n on id = node_id where t is null or gone_at >= t)
select distinct from_node, to_node, edge_type from graph_edges where coalesce(from_node not in (select node_id from gone where node_id is not null), true) and coalesce(to_node not in (select node_id from gone where node_id is not null), true)""",
    "cascade_delete": """with r as (select distinct node_id as id from node_removals where node_id is not null), d as (select distinct if(contains(id, ':'), substr(id, instr(id, ':') + 1), id) as doc from r),
n as (select distinct id from (select id from graph_nodes union all select id from core_nodes) where id not in (from r)),
e as (select distinct edge_id from graph_edges where coalesce(from_node not in (from r), true) and coalesce(to_node not in (from r), true)),
c as (select id from (select id, document_id, row_number() over (partition by id order by generated_at desc) as k from chunk_embeddings) where k = 1 and coalesce(document_id not in (from d), true))
select 'nodes' as what, count(*) as rows from n union all select 'edges', count(*) from e union all select 'embeddings', count(*) from c""",
    "latest_state": "select user_id, arg_max(event_type, (ts, event_id)) as event_type, max(ts) as ts from events group by user_id",
    "event_windows": _WINDOW.format(start="date_trunc('hour', ts)", keys=", event_type", rows="events"),
    "event_windows_sliding": _WINDOW.format(start="start", keys="", rows="(select value, unnest([time_bucket(interval 30 minutes, ts), time_bucket(interval 30 minutes, ts) - interval 30 minutes]) as start from events)"),
}
