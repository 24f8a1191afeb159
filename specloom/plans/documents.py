"""SQL for the check of the document operators: sections, tables, excerpts, and what is extracted from documents."""

from __future__ import annotations

from .. import dims
from ..operators import extract as E

_PY = r"[\t-\r\x{001C}-\x{001F}\x{0085}\p{Z}]"
_WIDE = r"[\t\n\x{000B}\f\r\p{Z}\x{FEFF}]"


def _strip(x: str, blank: str = _PY) -> str:
    return f"regexp_replace({x}, '^{blank}+|{blank}+$', '', 'g')"


def _pairs(rows) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


_ANCHOR = r"trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '[^\w\s-]', '', 'g'), '\s+', '-', 'g'), '-')"


def _sections(rows: str, text: str) -> str:
    """Common tables up to ``sec`` (doc_id, pos, heading, level, content, path)."""
    return rf"""lines as (select doc_id, string_split({text}, chr(10)) as a from {rows} where {text} is not null),
line as (select doc_id, a, unnest(a) as line, generate_subscripts(a, 1) as n from lines),
head as (select *, row_number() over (partition by doc_id order by n) - 1 as pos, lead(n) over (partition by doc_id order by n) as nxt, length(line) - length(regexp_replace(line, '^#+', '')) as level,
  regexp_replace(regexp_replace(line, '^#+', ''), '^{_PY}+', '') as heading from line where starts_with(line, '#')),
flat as (select doc_id, pos, level, heading, {_ANCHOR.format('heading')} as anchor, {_strip("array_to_string(a[n + 1 : coalesce(nxt - 1, len(a))], chr(10))")} as content from head),
up as (select f.doc_id, f.pos, f.level, f.heading, f.anchor, f.content, max(g.pos) as parent from flat f left join flat g on g.doc_id = f.doc_id and g.pos < f.pos and g.level < f.level group by all),
tree as (select doc_id, pos, level, heading, content, anchor as path from up where parent is null
  union all select u.doc_id, u.pos, u.level, u.heading, u.content, t.path || '.' || u.anchor from up u join tree t on t.doc_id = u.doc_id and t.pos = u.parent),
sec as (select * from tree)"""


def _table(rows: str, keys: str, text: str) -> str:
    """Common table ``cell`` (keys, pos, name, value) of the pipe table in a text."""
    cells = lambda x: f"list_transform(string_split(regexp_replace({x}, '^\\||\\|$', '', 'g'), '|'), lambda c: {_strip('c')})"
    bars = f"list_filter(list_transform(string_split({_strip(text)}, chr(10)), lambda x: {_strip('x')}), lambda x: starts_with(x, '|'))"
    return f"""bar as (select {keys}, {bars} as b from {rows} where {text} is not null),
named as (select {keys}, list_transform({cells('b[1]')}, lambda x: replace(x, '`', '')) as names, unnest(b[3:]) as r, generate_subscripts(b[3:], 1) as k from bar where len(b) >= 2),
whole as (select *, {cells('r')} as v from named),
fits as (select {keys}, names, v, row_number() over (partition by {keys} order by k) - 1 as pos from whole where len(v) >= len(names)),
pair as (select {keys}, pos, unnest(names) as name, unnest(v[1 : len(names)]) as value, generate_subscripts(names, 1) as i from fits),
cell as (select {keys}, pos, name, arg_max(value, i) as value from pair group by {keys}, pos, name)"""


_HEAD = r"^---[ \t]*\r?\n(?s:(.*?))(?:\n|^)---[ \t]*(?:\r?\n|$)"
_DOCS = rf"""raw as (select doc_id, kind as own, text, starts_with(text, '---' || chr(10)) as has from documents where text is not null),
file as (select doc_id, if(has, text, '---' || chr(10) || 'id: DOC-' || doc_id || chr(10) || 'kind: ' || coalesce(own, 'none') || chr(10) || '---' || chr(10) || text) as content from raw),
parsed as (select doc_id, content, regexp_extract(content, '{_HEAD}', 1) as front, regexp_replace(content, '{_HEAD}', '') as body from file),
prefix as (from (values {_pairs((k, p, i) for i, (k, p, *_r) in enumerate(dims.KINDS))}) t(kind, prefix, rank)),
doc as (select doc_id, body, '02-behavior/specs/' || doc_id || '.md' as source_file, sha256(content) as source_hash, coalesce(nullif(trim(regexp_extract(front, '(?m)^id:(.*)$', 1)), ''), doc_id::varchar) as bare,
  lower(trim(regexp_extract(front, '(?m)^kind:(.*)$', 1))) as kind, coalesce(nullif(trim(regexp_extract(front, '(?m)^status:(.*)$', 1)), ''), 'draft') as status, nullif(trim(regexp_extract(front, '(?m)^title:(.*)$', 1)), '') as title from parsed),
spec as (select doc.*, prefix || ':' || bare as id from doc join prefix using (kind))"""
_SPECS = f"with recursive {_DOCS}, {_sections('spec', 'body')}"
_FOUND = f"""wanted as (from (values {_pairs((k, f, h.lower(), m) for k, f, hs, m in E.FIELDS for h in hs)}) t(kind, field, heading, mode)),
hit as (select spec.doc_id, spec.id, spec.source_file, wanted.field, wanted.mode, min(sec.pos) as pos from spec join wanted using (kind) join sec on sec.doc_id = spec.doc_id and lower(sec.heading) = wanted.heading group by all),
own as (select hit.*, sec.content, sec.level from hit join sec on sec.doc_id = hit.doc_id and sec.pos = hit.pos)"""
_ITEMS = f"array_to_string(list_transform(list_filter(list_transform(string_split(content, chr(10)), lambda x: {_strip('x', _WIDE)}), lambda x: starts_with(x, '- ') or starts_with(x, '* ')), lambda x: {_strip('substr(x, 3)', _WIDE)}), '; ')"
_DEEP = """below as (select own.doc_id, own.field, s.pos, s.heading, s.content from own join sec s on s.doc_id = own.doc_id and s.pos > own.pos
  where mode = 'deep' and not exists (select 1 from sec z where z.doc_id = own.doc_id and z.pos > own.pos and z.pos <= s.pos and z.level <= own.level)),
parts as (select doc_id, field, -1 as pos, content as part from own where mode = 'deep' and trim(content) <> '' union all select doc_id, field, pos, '### ' || heading || chr(10) || chr(10) || content from below),
deep as (select doc_id, field, string_agg(part, chr(10) || chr(10) order by pos) as value from parts group by all)"""
_RULES = _pairs((i, k, t, h.lower(), ",".join(starts), int(every)) for i, (k, t, hs, starts, every) in enumerate([*E.LINK_EDGES, *E.SPEC_EDGES], 2) for h in (hs or ("",)))
_NODE = "case " + " ".join(f"when starts_with(target, '{s}') then '{p}:' || target" for s, p in dims.LINK_PREFIXES) + " else 'Entity:' || target end"
_ENTITY = "not (" + " or ".join(f"starts_with(target, '{s}')" for s, _ in dims.LINK_PREFIXES) + ")"
_RANK = "case {0} " + " ".join(f"when '{x}' then {i}" for i, x in enumerate(dims.LAYERS)) + " end"
_LAYER_OF = "case split_part({0}, ':', 1) " + " ".join(f"when '{p}' then '{layer}'" for _, p, _p, _h, layer in dims.KINDS) + " end"


def _links(rows: str, keys: str, text: str) -> str:
    """(keys, pos, target, domain, node) of the links of a text."""
    found = rf"list_filter(list_transform(regexp_extract_all({text}, '\[\[([^\]]+)\]\]', 1), lambda x: {_strip('x', _WIDE)}), lambda x: x <> '')"
    return f"""select *, {_NODE} as node from (
  select *, {_strip("string_split(rest, '|')[1]", _WIDE)} as target from (
    select *, if(contains(raw, '::'), string_split(raw, '::')[2], raw) as rest, case when contains(raw, '::') then {_strip("string_split(raw, '::')[1]", _WIDE)} end as domain from (
      select {keys}, unnest({found}) as raw, generate_subscripts({found}, 1) - 1 as pos from {rows})))"""


_EDGES = f"""all_text as (select spec.doc_id, spec.id, spec.kind, string_agg(sec.content, chr(10) order by sec.pos) as t from spec join sec using (doc_id) group by all),
rule as (from (values {_RULES}) t(step, kind, edge_type, heading, starts, every)),
said as (
  select a.id, a.kind, 0 as step, 'WIKI_LINK' as edge_type, '' as starts, a.t from all_text a
  union all select a.id, a.kind, r.step, r.edge_type, r.starts, a.t from all_text a join rule r on r.kind = a.kind and r.heading = ''
  union all select id, kind, step, edge_type, starts, string_agg(content, chr(10) order by pos) from (
    select distinct spec.id, spec.kind, r.step, r.edge_type, r.starts, r.every, sec.content, sec.pos, min(sec.pos) over (partition by spec.doc_id, r.step) as first from spec join rule r using (kind) join sec on sec.doc_id = spec.doc_id and lower(sec.heading) = r.heading where r.heading <> '')
  where every = 1 or pos = first group by all),
link as ({_links('said', 'id, kind, step, edge_type, starts', 't')}),
typed as (
  select id, node, edge_type, step * 1000000 + pos as ordinal from link where step = 0 or if(starts = '', {_ENTITY}, list_bool_or(list_transform(string_split(starts, ','), lambda s: starts_with(target, s))))
  union all select id, node, 'CROSS_DOMAIN_REF', pos from link where step = 0 and domain is not null
  union all select id, node, 'ENTITY_POLICY', pos from link where step = 0 and kind in ('business-policy', 'cross-policy') and {_ENTITY}
  union all select id, node, 'LAYER_DEPENDENCY', pos from link where step = 0 and coalesce({_RANK.format(chr(39) + '02-behavior' + chr(39))} < {_RANK.format('(' + _LAYER_OF.format('node') + ')')}, false))"""
_RELATED = f"""relation as (select spec.id, sec.content as t, row_number() over (partition by spec.doc_id order by sec.pos) as k from spec join sec on sec.doc_id = spec.doc_id where spec.kind = 'entity' and lower(sec.heading) in ('relaciones', 'relations', 'relationships'))"""
_FIRST = f"select id as from_node, node as to_node, edge_type, edge_type in ('WIKI_LINK', 'LAYER_DEPENDENCY') and coalesce({_RANK.format(chr(39) + '02-behavior' + chr(39))} < {_RANK.format('(' + _LAYER_OF.format('node') + ')')}, false) as layer_violation, edge_type = 'WIKI_LINK' as bidirectional, min(ordinal)::bigint as ordinal from {{0}} group by all"

_EMBEDDED = ", ".join(f"('{k}', '{h}')" for k, _, _, names, _ in dims.KINDS for h in names)
# Paragraphs go one by one into the buffer of their section: (written chunks, the buffer's text, size, last part, start).
_CHUNKS = f"""embedded as (from (values {_EMBEDDED}) t(kind, heading)),
part as (select spec.doc_id, spec.bare, spec.kind, spec.title, sec.pos, sec.heading, sec.content from spec join sec using (doc_id) join embedded e on e.kind = spec.kind and e.heading = lower(sec.heading) where trim(sec.content) <> ''),
piece as (select doc_id, pos, {_strip("unnest(string_split(content, chr(10) || chr(10)))")} as p, generate_subscripts(string_split(content, chr(10) || chr(10)), 1) as i from part),
para as (select doc_id, pos, p, off, row_number() over (partition by doc_id, pos order by i) as k from (select *, (sum(length(p) + 2) over (partition by doc_id, pos order by i) - length(p) - 2)::bigint as off from piece) where p <> ''),
step as (
  select doc_id, pos, k, []::struct(o bigint, t varchar)[] as done, p as buffer, length(p) + 2 as size, p as tail, off as start from para where k = 1
  union all
  select x.doc_id, x.pos, y.k, if(full_, list_append(x.done, {{'o': x.start, 't': x.buffer}}), x.done), case when not full_ then x.buffer || chr(10) || chr(10) || p when carry then x.tail || chr(10) || chr(10) || p else p end,
    case when not full_ then x.size + length(p) + 2 when carry then length(x.tail) + length(p) + 2 else length(p) + 2 end, p, case when not full_ then x.start when carry then y.off - length(x.tail) - 2 else y.off end
  from (select s.*, s.size + length(q.p) + 2 > 1500 as full_, length(s.tail) <= 200 as carry from step s join para q on q.doc_id = s.doc_id and q.pos = s.pos and q.k = s.k + 1) x join para y on y.doc_id = x.doc_id and y.pos = x.pos and y.k = x.k + 1),
ended as (select doc_id, pos, list_append(arg_max(done, k), {{'o': arg_max(start, k), 't': arg_max(buffer, k)}}) as done from step group by doc_id, pos),
cut as (select e.doc_id, e.pos, unnest(done) as c, generate_subscripts(done, 1) as j from ended e),
chunk as (select part.*, c.o as o, c.t as t, row_number() over (partition by part.doc_id order by part.pos, j) - 1 as n from cut join part using (doc_id, pos))"""

_J = r"[\t\n\x{000B}\f\r ]"
_EXCERPT = rf"""with a as (select doc_id, trim(text, ' ') as t from documents),
b as (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(^|[\n\r\x{{0085}}\x{{2028}}\x{{2029}}])#+{_J}+', '\1', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '{_J}+', ' ', 'g'), ' ') as t from a),
c as (select doc_id, t, substr(t, 1, 200) as s from b),
d as (select *, 200 - strpos(reverse(s), ' .') - 1 as stop, 200 - strpos(reverse(s), ' ') as blank from c)
select doc_id, case when t is null then null when length(t) <= 200 then t when contains(s, '. ') and stop > 100 then substr(s, 1, stop + 1) when contains(s, ' ') and blank > 100 then substr(s, 1, blank) || '...' else s || '...' end as excerpt from d"""

ORACLE = {
    "sections": f"with recursive {_sections('documents', 'text')} select doc_id, pos, heading, level, path, content from sec",
    "anchors": f"with recursive {_sections('documents', 'text')} select distinct heading, {_ANCHOR.format('heading')} as anchor from sec",
    "tables": f"with {_table('documents', 'doc_id', 'text')} select doc_id, pos, name, value from cell",
    "excerpts": _EXCERPT,
    "extracted_nodes": f"with {_DOCS} select id, kind, source_file, source_hash, '02-behavior' as layer, status from spec",
    "extracted_fields": f"{_SPECS}, {_FOUND}, {_DEEP} select id, source_file, field, if(mode = 'list', {_ITEMS}, content) as value from own where mode in ('text', 'list') union all select id, source_file, field, value from own join deep using (doc_id, field)",
    "extracted_edges": f"{_SPECS}, {_EDGES}, {_RELATED}, given as (select * from relation where k = 1), {_table('given', 'id', 't')}, rows_ as (select distinct id, pos from cell), at_ as ({_links('(select c.id, c.pos as row_, c.name, c.value, n.i from cell c join (select distinct id, name, i from pair) n using (id, name))', 'id, row_, i', 'value')}), one as (select id, row_, arg_min(node, (i, pos)) as node from at_ group by all), every_ as (select * from typed union all select id, node, 'DOMAIN_RELATION', 1000000 + row_ from one) {_FIRST.format('every_')}",
    "extracted_chunks": f"{_SPECS}, {_CHUNKS} select bare || ':chunk-' || n as id, bare as document_id, kind as document_kind, heading as section_path, n::int as chunk_index, o::int as char_offset, t as raw_text, 'Document: ' || bare || chr(10) || 'Kind: ' || kind || chr(10) || 'Layer: 02-behavior' || coalesce(chr(10) || 'Title: ' || title, '') || chr(10) || 'Section: ' || heading || chr(10) || chr(10) || t as context_text, sha256(t) as text_hash from chunk",
    "encoded_chunks": f"{_SPECS}, {_CHUNKS} select bare || ':chunk-' || n as id, 'hashing' as model, 32 as dimensions, 32 as size from chunk",
    "index_log": f"with {_DOCS} select prefix.kind is not null as indexed, if(prefix.kind is null, 'No valid kind in front-matter', null) as skipped_reason, prefix.kind is not null as warned, count(*) as files from doc left join prefix using (kind) group by all",
}
