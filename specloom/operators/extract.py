"""From spec documents to nodes, edges and chunks: one lineage of DataFrames for a whole corpus.

A configuration table says, per kind, which sections become which fields and which links become which edges; there is no code per kind."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..functions.text import SECTIONS_TYPE, is_entity_target, list_items, node_of_link, sections_of, table_rows, wiki_links

# Kind, field, headings, mode: text, rows of a table, list items, or text with the sections below it.
FIELDS = [
    ("entity", "description", ("Descripción", "Description"), "text"),
    ("entity", "attributes", ("Atributos", "Attributes"), "rows"),
    ("entity", "relations", ("Relaciones", "Relations", "Relationships"), "rows"),
    ("entity", "invariants", ("Invariantes", "Invariants", "Constraints"), "list"),
    ("entity", "state_machine", ("Ciclo de Vida", "Lifecycle", "State Machine"), "text"),
    ("event", "description", ("Descripción", "Description"), "text"),
    ("event", "payload", ("Payload",), "rows"),
    ("event", "producer", ("Productor", "Producer"), "text"),
    ("event", "consumers", ("Consumidores", "Consumers"), "text"),
    ("business-rule", "declaration", ("Declaración", "Declaration"), "text"),
    ("business-rule", "when_applies", ("Cuándo aplica", "When Applies"), "text"),
    ("business-rule", "why_exists", ("Por qué existe", "Why it exists"), "text"),
    ("business-rule", "violation", ("Qué pasa si se incumple", "Violation", "What happens if violated"), "text"),
    ("business-rule", "examples", ("Ejemplos", "Examples"), "text"),
    ("business-policy", "declaration", ("Declaración", "Declaration"), "text"),
    ("business-policy", "when_applies", ("Cuándo Aplica", "When Applies"), "text"),
    ("business-policy", "parameters", ("Parámetros", "Parameters"), "text"),
    ("business-policy", "violation", ("Qué pasa si se incumple", "Violation", "What Happens on Violation"), "text"),
    ("cross-policy", "purpose", ("Propósito", "Purpose"), "text"),
    ("cross-policy", "declaration", ("Declaración", "Declaration"), "text"),
    ("cross-policy", "formalization_ears", ("Formalización EARS", "EARS Formalization"), "text"),
    ("cross-policy", "standard_behavior", ("Comportamiento Estándar", "Standard Behavior"), "text"),
    ("command", "purpose", ("Purpose", "Propósito"), "text"),
    ("command", "input_params", ("Input", "Entrada"), "rows"),
    ("command", "preconditions", ("Preconditions", "Precondiciones"), "text"),
    ("command", "postconditions", ("Postconditions", "Postcondiciones"), "text"),
    ("command", "errors", ("Possible Errors", "Errores Posibles"), "rows"),
    ("query", "purpose", ("Purpose", "Propósito"), "text"),
    ("query", "input_params", ("Input", "Entrada"), "rows"),
    ("query", "output_structure", ("Output", "Salida"), "text"),
    ("query", "errors", ("Possible Errors", "Errores Posibles"), "rows"),
    ("process", "participants", ("Participantes", "Participants"), "text"),
    ("process", "steps", ("Pasos", "Steps"), "deep"),
    ("process", "mermaid_flow", ("Diagrama", "Diagram"), "text"),
    ("use-case", "description", ("Descripción", "Description"), "text"),
    ("use-case", "actors", ("Actores", "Actors"), "text"),
    ("use-case", "preconditions", ("Precondiciones", "Preconditions"), "text"),
    ("use-case", "main_flow", ("Flujo Principal", "Main Flow"), "text"),
    ("use-case", "alternatives", ("Flujos Alternativos", "Alternative Flows"), "deep"),
    ("use-case", "exceptions", ("Excepciones", "Exceptions"), "deep"),
    ("use-case", "postconditions", ("Postcondiciones", "Postconditions"), "text"),
    ("ui-view", "description", ("Descripción", "Description"), "text"),
    ("ui-view", "layout", ("Layout", "Diseño"), "text"),
    ("ui-view", "components", ("Componentes", "Components"), "text"),
    ("ui-view", "states", ("Estados", "States"), "text"),
    ("ui-view", "behavior", ("Comportamiento", "Behavior"), "text"),
    ("ui-component", "description", ("Descripción", "Description"), "text"),
    ("ui-component", "entities", ("Entidades", "Entities"), "text"),
    ("ui-component", "use_cases", ("Casos de Uso", "Use Cases"), "text"),
    ("requirement", "description", ("Descripción", "Description"), "text"),
    ("requirement", "acceptance_criteria", ("Criterios de Aceptación", "Acceptance Criteria"), "text"),
    ("requirement", "traceability", ("Trazabilidad", "Traceability"), "text"),
    ("objective", "actor", ("Actor", "Actors"), "text"),
    ("objective", "objective", ("Objetivo", "Objective"), "text"),
    ("objective", "success_criteria", ("Criterios de éxito", "Success Criteria"), "text"),
    ("prd", "problem", ("Problema / Oportunidad", "Problem / Opportunity", "Problema", "Problem"), "text"),
    ("prd", "scope", ("Alcance", "Scope"), "deep"),
    ("prd", "users", ("Usuarios y Jobs-to-be-done", "Users and Jobs-to-be-done"), "deep"),
    ("prd", "metrics", ("Métricas de éxito y telemetría", "Success Metrics"), "text"),
    ("prd", "dependencies", ("Dependencias", "Dependencies"), "text"),
    ("adr", "context", ("Contexto", "Context"), "text"),
    ("adr", "decision", ("Decisión", "Decision"), "text"),
    ("adr", "consequences", ("Consecuencias", "Consequences"), "text"),
    ("glossary", "definition", ("Definición", "Definition"), "text"),
    ("glossary", "context", ("Contexto", "Context"), "text"),
    ("glossary", "related_terms", ("Términos Relacionados", "Related Terms"), "text"),
]

# Kind, edge type, headings (none: the whole text), how targets start (none: entities), every such section or the first.
LINK_EDGES = [
    ("entity", "EMITS", ("eventos del ciclo de vida", "lifecycle events"), ("EVT-",), True),
    ("business-rule", "ENTITY_RULE", ("Declaración", "Declaration"), (), False),
    ("business-policy", "ENTITY_RULE", ("Declaración", "Declaration"), (), False),
    ("cross-policy", "ENTITY_RULE", ("Declaración", "Declaration"), (), False),
    ("command", "EMITS", ("Postconditions", "Postcondiciones"), ("EVT-",), False),
    ("use-case", "UC_APPLIES_RULE", ("Reglas Aplicadas", "Applied Rules", "Rules Applied"), ("BR-", "BP-", "XP-"), False),
    ("use-case", "UC_EXECUTES_CMD", ("Comandos Ejecutados", "Commands Executed"), ("CMD-",), False),
    ("use-case", "UC_STORY", (), ("OBJ-",), True),
]
# Edges that are specified, not produced by default.
SPEC_EDGES = [
    ("event", "CONSUMES", ("Consumidores", "Consumers"), ("PROC-", "CMD-", "UC-"), False),
    ("ui-view", "VIEW_TRIGGERS_UC", (), ("UC-",), True),
    ("ui-view", "VIEW_USES_COMPONENT", ("Componentes", "Components"), ("UI-",), False),
    ("ui-component", "COMPONENT_USES_ENTITY", ("Entidades", "Entities"), (), False),
    ("requirement", "REQ_TRACES_TO", ("Trazabilidad", "Traceability"), ("UC-", "CMD-", "BR-", "QRY-", "BP-", "XP-"), False),
    ("adr", "DECIDES_FOR", ("Decisión", "Decision"), (), False),
    ("glossary", "GLOSSARY_DEFINES", ("Definición", "Definition"), (), False),
]


@dataclass
class Registry:
    """What is known of kinds: (kind, prefix, path, embedded headings, layer), and the tables of fields and of edges from links.

    ``register`` adds a kind, or puts other rows in the place of a known one's. A field may also be a function of the documents' columns instead of headings."""

    kinds: list[tuple] = field(default_factory=lambda: list(dims.KINDS))
    fields: list[tuple] = field(default_factory=lambda: list(FIELDS))
    links: list[tuple] = field(default_factory=lambda: list(LINK_EDGES))

    def register(self, kind: str, prefix: str, path: str = "", embedded: tuple[str, ...] = (), layer: str = dims.DEFAULT_LAYER, fields: tuple[tuple, ...] = (), links: tuple[tuple, ...] = ()) -> "Registry":
        """``fields`` are (field, headings, mode) or (field, function); ``links`` are (edge type, headings, starts of targets, every section)."""
        self.kinds = [k for k in self.kinds if k[0] != kind] + [(kind, prefix, path, [h.lower() for h in embedded], layer)]
        self.fields = [f for f in self.fields if f[0] != kind] + [(kind, *f) if len(f) == 3 else (kind, f[0], f[1], "function") for f in fields]
        self.links = [x for x in self.links if x[0] != kind] + [(kind, *x) for x in links]
        return self

    def has(self, kind: str) -> bool:
        return any(k[0] == kind for k in self.kinds)


DEFAULT = Registry()
EDGES = "from_node string, to_node string, edge_type string, source_file string, extraction_method string, metadata map<string,string>, layer_violation boolean, bidirectional boolean, ordinal bigint"


def front_matter(content: str) -> tuple[dict, str]:
    """The YAML head between two lines of "---" and the rest; ({}, all of it) where there is none or it can't be read."""
    m = re.match(r"---[ \t]*\r?\n(.*?)(?:^|\n)---[ \t]*(?:\r?\n|\Z)", content, re.S)
    if not m:
        return {}, content
    try:
        import yaml

        head = yaml.safe_load(m[1])
    except ImportError:
        head = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in m[1].split("\n")) if k.strip()}
    except Exception:
        return {}, content
    return (head, content[m.end() :]) if isinstance(head, dict) else ({}, content if head is not None else content[m.end() :])


_PARSED = T.StructType([
    T.StructField("front", T.MapType(T.StringType(), T.StringType())),
    T.StructField("aliases", T.ArrayType(T.StringType())),
    T.StructField("sections", SECTIONS_TYPE),
    T.StructField("body", T.StringType()),
])


@F.pandas_udf(_PARSED)
def _parse(content: pd.Series) -> pd.DataFrame:
    rows = []
    for text in content:
        head, body = front_matter(text or "")
        aliases = head.get("aliases") or []
        rows.append(({str(k): str(v) for k, v in head.items() if v is not None}, [str(a) for a in (aliases if isinstance(aliases, list) else [aliases])], sections_of(body), body))
    return pd.DataFrame(rows, columns=["front", "aliases", "sections", "body"])


@F.pandas_udf(T.ArrayType(T.MapType(T.StringType(), T.StringType())))
def tables(text: pd.Series) -> pd.Series:
    """Rows of a section's pipe table as maps in the order of the columns; null for null."""
    return text.map(lambda t: None if t is None else table_rows(t))


def route(kind: Column, path: Column, registry: Registry | None = None) -> tuple[Column, Column]:
    """(kind, warning): the kind if it is a registered one, of sixteen by default (blanks and case aside), else null; a warning where the path doesn't fit it."""
    bare = F.lower(F.trim(kind))
    kinds = (registry or DEFAULT).kinds
    valid = F.when(bare.isin([k for k, *_ in kinds]), bare)
    expected = dims._case(bare, [(k, path_) for k, _, path_, *_r in kinds])
    return valid, F.when(~path.contains(expected), F.concat(F.lit("'"), bare, F.lit("' expected in "), expected, F.lit(", found in "), path))


def documents(files: DataFrame, domain: str | None = None, registry: Registry | None = None) -> DataFrame:
    """Parsed documents of files (path, content): id, kind, source_path, source_hash, layer, front, aliases, sections, body, warning, domain, unread. Files of no valid kind have a null kind.

    A YAML file is a head without a body."""
    head_only = F.col("path").rlike(r"\.ya?ml$")
    content = F.when(head_only & ~F.col("content").startswith("---"), F.concat(F.lit("---\n"), "content", F.lit("\n---\n"))).when(head_only, F.concat("content", F.lit("\n---\n"))).otherwise(F.col("content"))
    p = files.select("path", "content", _parse(content).alias("p"))
    kind, warning = route(F.col("p.front")["kind"], F.col("path"), registry)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.(md|ya?ml)$", "")
    return p.select(
        F.coalesce(F.col("p.front")["id"], stem).alias("id"), kind.alias("kind"), F.col("path").alias("source_path"), F.sha2("content", 256).alias("source_hash"), dims.layer_of_path(F.col("path")).alias("layer"),
        F.col("p.front").alias("front"), F.col("p.aliases").alias("aliases"), F.col("p.sections").alias("sections"), F.col("p.body").alias("body"), warning.alias("warning"), F.lit(domain).cast("string").alias("domain"), F.col("content").isNull().alias("unread"),
    )


def node_id(docs_domain: bool = False, registry: Registry | None = None) -> Column:
    plain = F.concat_ws(":", dims._case(F.col("kind"), [(k, p) for k, p, *_ in (registry or DEFAULT).kinds]), F.col("id"))
    return F.concat_ws(":", F.col("domain"), plain) if docs_domain else plain


def _named(names) -> Callable[[Column], Column]:
    low = [n.lower() for n in names]
    return lambda s: F.lower(s["heading"]).isin(low)


def section_text(names) -> Column:
    """Content of the first section with one of the headings; null without one."""
    return F.try_element_at(F.filter("sections", _named(names)), F.lit(1))["content"]


def section_deep(names) -> Column:
    """The first such section's content and all deeper sections right below it, under level-three headings; null if that is nothing."""
    at = F.array_position(F.transform("sections", _named(names)), True)
    parent = F.try_element_at("sections", at.cast("int"))
    rest = F.slice("sections", at.cast("int") + 1, F.greatest(F.size("sections"), F.lit(1)))
    stop = F.array_position(F.transform(rest, lambda s: s["level"] <= parent["level"]), True).cast("int")
    below = F.when(stop > 0, F.slice(rest, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(rest)
    parts = F.concat(F.filter(F.array(parent["content"]), lambda c: F.trim(c) != ""), F.transform(below, lambda s: F.concat(F.lit("### "), s["heading"], F.lit("\n\n"), s["content"])))
    return F.when((at > 0) & (F.size(parts) > 0), F.array_join(parts, "\n\n"))


def nodes(docs: DataFrame, docs_domain: bool = False, now: Column | None = None, registry: Registry | None = None) -> DataFrame:
    """Graph nodes of documents. Text fields are searchable; the rows of tables go as JSON into ``tables``."""
    text, rows = [], []
    for kind, field, names, mode in (registry or DEFAULT).fields:
        if mode == "function":
            text.append(F.struct(F.lit(field).alias("key"), F.when(F.col("kind") == kind, names()).alias("value")))
        elif mode == "rows":
            value = F.to_json(tables(F.when(F.col("kind") == kind, section_text(names))))
            rows.append(F.struct(F.lit(field).alias("key"), value.alias("value"), F.lit(kind).alias("kind")))
        else:
            value = section_text(names) if mode == "text" else section_deep(names) if mode == "deep" else F.array_join(list_items(section_text(names)), "; ")
            text.append(F.struct(F.lit(field).alias("key"), F.when(F.col("kind") == kind, value).alias("value")))
    as_map = lambda xs: F.map_from_entries(F.transform(F.filter(F.array(*xs), lambda e: e["value"].isNotNull()), lambda e: F.struct(e["key"], e["value"])))
    return docs.filter(F.col("kind").isNotNull()).select(
        node_id(docs_domain, registry).alias("id"), "kind", F.col("source_path").alias("source_file"), "source_hash", "layer", F.coalesce(F.col("front")["status"], F.lit("draft")).alias("status"), "aliases", "domain",
        as_map(text).alias("indexed_fields"), as_map(rows).alias("tables"), (F.current_timestamp() if now is None else now).cast("timestamp_ntz").alias("indexed_at"),
    )


def edges(docs: DataFrame, spec_edges: bool = False, relation_types: bool = False, docs_domain: bool = False, both_ways: bool = False, registry: Registry | None = None) -> DataFrame:
    """Graph edges of documents, one of each (from, to, type), the first in the text: links first, then what sections say.

    ``spec_edges`` adds the types that are specified only, and CROSS_DOMAIN_REF for links into another domain; ``relation_types`` adds an edge named by the text of each
    relation; ``both_ways`` also flags links whose reverse violates the layers."""
    d = docs.filter(F.col("kind").isNotNull()).select(node_id(docs_domain, registry).alias("from_node"), "kind", "layer", "sections", F.col("source_path").alias("source_file"), "domain")
    whole = F.array_join(F.transform("sections", lambda s: s["content"]), "\n")
    empty = F.create_map().cast("map<string,string>")

    def linked(rows: DataFrame, text: Column, step: int) -> DataFrame:
        return rows.select("from_node", "kind", "layer", "source_file", "domain", F.posexplode(wiki_links(text)).alias("pos", "link")).withColumn("to_node", node_of_link(F.col("link.target"))).withColumn("ordinal", F.lit(step * 1_000_000).cast("bigint") + F.col("pos"))

    target = dims.layer_of_node_id(F.col("to_node"))
    broken = dims.is_violation(F.col("layer"), target)
    if both_ways:
        broken = broken | dims.is_violation(target, F.col("layer"))
    meta = F.map_filter(F.create_map(F.lit("domain"), F.col("link.domain"), F.lit("display_alias"), F.col("link.alias")), lambda k, v: v.isNotNull())
    all_links = linked(d, whole, 0)
    same = ["from_node", "to_node", "source_file", "ordinal"]
    first = all_links.withColumn("_k", F.row_number().over(Window.partitionBy("from_node", "to_node").orderBy("ordinal"))).filter("_k = 1")
    out = first.select(*same, F.lit("WIKI_LINK").alias("edge_type"), F.lit("wiki_link").alias("extraction_method"), meta.alias("metadata"), broken.alias("layer_violation"), F.lit(True).alias("bidirectional"))
    plain = [F.lit("wiki_link").alias("extraction_method"), empty.alias("metadata"), F.lit(False).alias("layer_violation"), F.lit(False).alias("bidirectional")]
    for step, (kind, edge_type, names, starts, every) in enumerate([*(registry or DEFAULT).links, *(SPEC_EDGES if spec_edges else [])], 2):
        text = whole if not names else F.array_join(F.transform(F.filter("sections", _named(names)), lambda s: s["content"]), "\n") if every else section_text(names)
        want = is_entity_target(F.col("link.target")) if not starts else F.greatest(*[F.col("link.target").startswith(s) for s in starts], F.lit(False))
        out = out.unionByName(linked(d.filter(F.col("kind") == kind), text, step).filter(want).select(*same, F.lit(edge_type).alias("edge_type"), *plain))
    rel = d.filter("kind = 'entity'").select("*", F.posexplode(tables(section_text(FIELDS[2][2]))).alias("pos", "row"))
    rel = rel.withColumn("link", F.try_element_at(F.flatten(F.transform(F.map_values("row"), lambda v: F.slice(wiki_links(v), 1, 1))), F.lit(1))).filter("link is not null")
    name, many = F.try_element_at(F.map_values("row"), F.lit(1)), F.coalesce(F.col("row")["Cardinalidad"], F.col("row")["Cardinality"], F.lit(""))
    rel = rel.withColumn("to_node", node_of_link(F.col("link.target"))).withColumn("ordinal", F.lit(1_000_000).cast("bigint") + F.col("pos"))
    said = [F.lit("section_content").alias("extraction_method"), F.create_map(F.lit("relation"), name, F.lit("cardinality"), many).alias("metadata"), F.lit(False).alias("layer_violation"), F.lit(False).alias("bidirectional")]
    out = out.unionByName(rel.select(*same, F.lit("DOMAIN_RELATION").alias("edge_type"), *said))
    if relation_types:
        out = out.unionByName(rel.filter(F.trim(name) != "").select(*same, F.lower(F.trim(name)).alias("edge_type"), *said))
    if spec_edges:
        far = all_links.filter(F.col("link.domain").isNotNull() & ~F.col("link.domain").eqNullSafe(F.col("domain"))).withColumn("to_node", F.concat_ws(":", F.col("link.domain"), "to_node") if docs_domain else F.col("to_node"))
        out = out.unionByName(far.select(*same, F.lit("CROSS_DOMAIN_REF").alias("edge_type"), *plain))
        policy = first.filter(F.col("kind").isin("business-policy", "cross-policy") & is_entity_target(F.col("link.target")))
        out = out.unionByName(policy.select(*same, F.lit("ENTITY_POLICY").alias("edge_type"), *plain))
        out = out.unionByName(first.filter(broken).select(*same, F.lit("LAYER_DEPENDENCY").alias("edge_type"), *plain[:2], F.lit(True).alias("layer_violation"), plain[3]))
    w = Window.partitionBy("from_node", "to_node", "edge_type").orderBy("ordinal")
    return out.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select(*[c.split()[0] for c in EDGES.split(", ")])


# Scenarios -----------------------------------------------------------------------------------------------------------

_SCENARIOS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("feature", "name")] + [T.StructField("tags", T.ArrayType(T.StringType()))]))
_SCENARIO_LINE = re.compile(r"\s*(?:(Feature|Característica|Funcionalidad|Funcionalidade)|(?:Scenario|Escenario|Cenário)(?: Outline)?|Example|Ejemplo|Exemplo)\s*:\s*(.*?)\s*$")


def scenarios_of(content: str | None) -> list[tuple[str | None, str, list[str]]]:
    """(feature, scenario, tags) of a feature file: the tags above a scenario and those above its feature, in order, each once. Tags start with a capital, as ids do."""
    out, feature, shared, tags = [], None, [], []
    for line in (content or "").split("\n"):
        m = _SCENARIO_LINE.match(line)
        if line.strip().startswith("@"):
            tags += re.findall(r"@([A-ZÀ-Þ][\w-]*)", line)
        elif m and m[1]:
            feature, shared, tags = m[2], tags, []
        elif m:
            out.append((feature, m[2], list(dict.fromkeys([*shared, *tags]))))
            tags = []
        elif line.strip() and not line.strip().startswith("#"):
            tags = []
    return out


def features(files: DataFrame, domain: str | None = None, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of feature files (path, content): a node of kind ``scenario`` for each scenario, and a VALIDATES edge to each node that its tags name.

    An id is made of the file's name and the scenario's place in it. A file without scenarios gives nothing."""
    parse = F.pandas_udf(lambda c: c.map(scenarios_of), _SCENARIOS)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.feature$", "")
    rows = files.filter(F.col("path").endswith(".feature")).select("path", F.sha2("content", 256).alias("hash"), stem.alias("stem"), F.posexplode(parse("content")).alias("k", "s"))
    rows = rows.withColumn("id", F.concat(F.lit("Scenario:"), "stem", F.lit("-"), (F.col("k") + 1).cast("string")))
    text = F.map_filter(F.create_map(F.lit("title"), F.col("s.name"), F.lit("feature"), F.col("s.feature")), lambda k, v: v.isNotNull())
    nodes_ = rows.select(
        "id", F.lit("scenario").alias("kind"), F.col("path").alias("source_file"), F.col("hash").alias("source_hash"), dims.layer_of_path(F.col("path")).alias("layer"), F.lit("draft").alias("status"), F.array().cast("array<string>").alias("aliases"),
        F.lit(domain).cast("string").alias("domain"), text.alias("indexed_fields"), F.create_map().cast("map<string,string>").alias("tables"), (F.current_timestamp() if now is None else now).cast("timestamp_ntz").alias("indexed_at"),
    )
    tagged = rows.select("id", "path", F.posexplode("s.tags").alias("k", "tag"))
    edges_ = tagged.select(
        F.col("id").alias("from_node"), node_of_link(F.col("tag")).alias("to_node"), F.lit("VALIDATES").alias("edge_type"), F.col("path").alias("source_file"), F.lit("feature_tag").alias("extraction_method"),
        F.create_map().cast("map<string,string>").alias("metadata"), F.lit(False).alias("layer_violation"), F.lit(False).alias("bidirectional"), F.col("k").cast("bigint").alias("ordinal"),
    )
    return nodes_, edges_


# Chunks --------------------------------------------------------------------------------------------------------------


def _fill(sums: list[int], first: int, room: int) -> int:
    """How far from ``first`` on items fit into ``room``, by the prefix sums of their sizes: the place of the first that does not."""
    return max(first, bisect_right(sums, sums[first] + room, first) - 1)


def pack_paragraphs(content: str, most: int = 1500, overlap: int = 200) -> list[tuple[int, str]]:
    """(offset, text) of a section's chunks.

    A chunk takes as many paragraphs as fit into ``most``, each counted with two characters for the blank line behind it; the cut is searched in the prefix sums of these sizes. The last
    part of a chunk is repeated at the head of the next one if it is no longer than ``overlap``. A paragraph over ``most`` that starts a chunk is cut between sentences, each
    counted with one character; the sentences of its last run stay parts of their own. Offsets point at the paragraph, also for its sentences."""
    pieces = [p.strip() for p in content.split("\n\n")]
    places = list(accumulate((len(p) + 2 for p in pieces), initial=0))
    rows = [(at, p) for at, p in zip(places, pieces) if p]
    sums = list(accumulate((len(p) + 2 for _, p in rows), initial=0))
    out: list[tuple[int, str]] = []

    def begin(at: int, para: str) -> tuple[list[str], int]:
        """The parts that a chunk starts with, and their size."""
        if len(para) <= most:
            return [para], len(para) + 2
        said = [x for x in (y.strip() for y in re.split(r"(?<=\.)\s+", para)) if x]
        lengths = list(accumulate((len(x) + 1 for x in said), initial=0))
        low = 0
        while (high := max(_fill(lengths, low, most), low + 1)) < len(said):
            out.append((at, " ".join(said[low:high])))
            low = high
        return said[low:], lengths[-1] - lengths[low]

    parts, size, start, k = [], 0, 0, 0
    while k < len(rows):
        at, para = rows[k]
        if not parts:
            start = at
            parts, size = begin(at, para)
            k += 1
        end = _fill(sums, k, most - size) if k < len(rows) else k
        parts += [p for _, p in rows[k:end]]
        if end < len(rows):
            out.append((start, "\n\n".join(parts)))
            tail, (at, para) = parts[-1], rows[end]
            parts = []
            if 0 < len(tail) <= overlap:
                parts, size, start, end = [tail, para], len(tail) + len(para) + 2, at - len(tail) - 2, end + 1
        k = end
    return [*out, (start, "\n\n".join(parts))] if parts else out


def merge_short(content: str, least_words: int = 20) -> str:
    """Paragraphs of fewer words joined with the next one; a pipe table stays a paragraph of its own."""
    out: list[str] = []
    short = ""
    for para in filter(None, (p.strip() for p in content.split("\n\n"))):
        table = para.startswith("|")
        text = f"{short}\n{para}" if short and not table else para
        if short and table:
            out.append(short)
        short = ""
        if not table and len(text.split()) < least_words:
            short = text
        else:
            out.append(text)
    return "\n\n".join([*out, short] if short else out)


def chunks(docs: DataFrame, most: int = 1500, overlap: int = 200, merged: bool = False, registry: Registry | None = None) -> DataFrame:
    """(id, document_id, document_kind, section_path, chunk_index, raw_text, context_text, char_offset, text_hash) of the sections that are embedded for a document's kind."""
    kind = T.ArrayType(T.StructType([T.StructField("heading", T.StringType()), T.StructField("offset", T.IntegerType()), T.StructField("text", T.StringType())]))

    @F.pandas_udf(kind)
    def cut_up(sections: pd.Series) -> pd.Series:
        return sections.map(lambda xs: [(s["heading"], o, t) for s in xs for o, t in pack_paragraphs(merge_short(s["content"]) if merged else s["content"], most, overlap)])

    heads = F.create_map(*[x for k, _, _, names, _ in (registry or DEFAULT).kinds for x in (F.lit(k), F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"))])
    wanted = F.filter("sections", lambda s: F.array_contains(F.col("heads"), F.lower(s["heading"])) & (F.trim(s["content"]) != ""))
    title = F.when(F.col("front")["title"] != "", F.concat(F.lit("\nTitle: "), F.col("front")["title"]))
    identity = F.concat(F.lit("Document: "), "id", F.lit("\nKind: "), "kind", F.lit("\nLayer: "), "layer", F.coalesce(title, F.lit("")))
    d = docs.filter(F.col("kind").isNotNull()).withColumn("heads", heads[F.col("kind")]).select("id", "kind", identity.alias("identity"), F.posexplode(cut_up(wanted)).alias("k", "c"))
    return d.select(
        F.concat("id", F.lit(":chunk-"), F.col("k").cast("string")).alias("id"), F.col("id").alias("document_id"), F.col("kind").alias("document_kind"), F.col("c.heading").alias("section_path"), F.col("k").alias("chunk_index"),
        F.col("c.text").alias("raw_text"), F.concat("identity", F.lit("\nSection: "), F.col("c.heading"), F.lit("\n\n"), F.col("c.text")).alias("context_text"), F.col("c.offset").alias("char_offset"), F.sha2("c.text", 256).alias("text_hash"),
    )


def encode(rows: DataFrame, encoder, model: str, dimensions: int) -> DataFrame:
    """Chunks with their vectors. ``encoder`` maps a list of texts to a list of vectors; it is made once a worker and called by Arrow batches."""
    schema = T.StructType([*rows.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(frames):
        for f in frames:
            f["vector"] = list(encoder(f["context_text"].tolist())) if len(f) else []
            yield f

    return rows.mapInPandas(run, schema).withColumn("model", F.lit(model)).withColumn("dimensions", F.lit(dimensions)).withColumn("generated_at", F.current_timestamp().cast("timestamp_ntz"))


@dataclass
class Index:
    log: DataFrame  # path, node_id, skipped_reason, warning: a row a file
    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame | None


def index(files: DataFrame, level: str = "L1", encoder=None, model: str = "hashing", dimensions: int = 64, domain: str | None = None, enrich=None, registry: Registry | None = None, **options) -> Index:
    """Index files (path, content): documents, and feature files by their ending. A null content is a file that can't be read: it is logged and skipped. Of several documents of one id the last by path counts. ``enrich`` may turn an Index into a richer one (level L3)."""
    specs = files.filter(~F.col("path").endswith(".feature"))
    docs = documents(specs, domain, registry)
    by_domain = options.pop("docs_domain", False)
    said, checks = features(files, domain)
    now = nodes(docs, by_domain, registry=registry).unionByName(said)
    last = now.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("source_file")))).filter("_k = 1").drop("_k")
    why = F.when(F.col("unread"), "File can't be read").when(F.col("kind").isNull(), "No valid kind in front-matter")
    log = docs.select("source_path", F.when(F.col("kind").isNotNull(), node_id(by_domain, registry)).alias("node_id"), why.alias("skipped_reason"), "warning")
    parts = chunks(docs, registry=registry) if level != "L1" else None
    if parts is not None and encoder is not None:
        parts = encode(parts, encoder, model, dimensions)
    links = edges(docs, docs_domain=by_domain, registry=registry, **options).unionByName(checks)
    made = Index(log, last, links, parts)
    return enrich(made) if enrich and level == "L3" else made
