"""Constants of the data model and the small dimension tables made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kind, id prefix, path its specs are expected below, headings that are embedded, layer its prefix stands for.
# The order of the kinds decides which node a bare document id means.
KINDS = [
    ("entity", "Entity", "01-domain/entities/", ["descripción", "description"], "01-domain"),
    ("event", "Event", "01-domain/events/", [], "01-domain"),
    ("business-rule", "BR", "01-domain/rules/", ["declaración", "declaration", "cuándo aplica", "when applies"], "01-domain"),
    ("business-policy", "BP", "02-behavior/policies/", ["declaración", "declaration"], "02-behavior"),
    ("cross-policy", "XP", "02-behavior/policies/", ["propósito", "purpose", "declaración", "declaration"], "02-behavior"),
    ("command", "CMD", "02-behavior/commands/", ["purpose", "propósito"], "02-behavior"),
    ("query", "QRY", "02-behavior/queries/", ["purpose", "propósito"], "02-behavior"),
    ("process", "PROC", "02-behavior/processes/", ["participantes", "participants", "pasos", "steps"], "02-behavior"),
    ("use-case", "UC", "02-behavior/use-cases/", ["descripción", "description", "flujo principal", "main flow"], "02-behavior"),
    ("ui-view", "UIView", "03-experience/views/", ["descripción", "description", "comportamiento", "behavior"], "03-experience"),
    ("ui-component", "UIComp", "03-experience/views/", ["descripción", "description"], "03-experience"),
    ("requirement", "REQ", "04-verification/criteria/", ["descripción", "description"], "04-verification"),
    ("objective", "OBJ", "00-requirements/objectives/", ["objetivo", "objective"], "00-requirements"),
    ("prd", "PRD", "00-requirements/", ["problema / oportunidad", "problem / opportunity"], "00-requirements"),
    ("adr", "ADR", "00-requirements/decisions/", ["contexto", "context", "decisión", "decision"], "00-requirements"),
    ("glossary", "GLOSS", "01-domain/glossary/", ["definición", "definition"], "01-domain"),
]
LAYERS = ["00-requirements", "01-domain", "02-behavior", "03-experience", "04-verification"]
DEFAULT_LAYER = "01-domain"

# How a link's target starts, and the prefix of the node it means; any other target is an entity.
LINK_PREFIXES = [
    ("EVT-", "Event"), ("BR-", "BR"), ("BP-", "BP"), ("XP-", "XP"), ("CMD-", "CMD"), ("QRY-", "QRY"), ("UC-", "UC"),
    ("PROC-", "PROC"), ("REQ-", "REQ"), ("OBJ-", "OBJ"), ("ADR-", "ADR"), ("PRD-", "PRD"), ("UI-", "UIView"),
]

# Kind, category, what it means, edge type that covers it.
COVERAGE = [
    ("entity", "events", "Domain events emitted by this entity", "EMITS"),
    ("entity", "business_rules", "Business rules for this entity", "ENTITY_RULE"),
    ("entity", "use_cases", "Use cases involving this entity", "WIKI_LINK"),
    ("command", "events", "Events emitted by this command", "EMITS"),
    ("command", "use_cases", "Use cases that execute this command", "UC_EXECUTES_CMD"),
    ("use-case", "commands", "Commands executed by this use case", "UC_EXECUTES_CMD"),
    ("use-case", "rules", "Business rules applied", "UC_APPLIES_RULE"),
    ("use-case", "requirements", "Requirements tracing to this UC", "REQ_TRACES_TO"),
    ("business-rule", "entity", "Entity this rule validates", "ENTITY_RULE"),
    ("business-rule", "use_cases", "Use cases that apply this rule", "UC_APPLIES_RULE"),
    ("requirement", "traces", "Artifacts this requirement traces to", "REQ_TRACES_TO"),
]

# Rules that are only specified.
COVERAGE_ALSO = [("entity", "requirements", "Requirements tracing to this entity", "REQ_TRACES_TO")]


def coverage_rules(also: bool = False) -> list[tuple[str, str, str, str]]:
    return [*COVERAGE, *(COVERAGE_ALSO if also else [])]


def kinds(spark: SparkSession) -> DataFrame:
    rows = [(k, p, path, heads, layer, i) for i, (k, p, path, heads, layer) in enumerate(KINDS)]
    return spark.createDataFrame(rows, "kind string, prefix string, expected_path string, headings array<string>, guessed_layer string, prefix_rank int")


def coverage(spark: SparkSession, also: bool = False) -> DataFrame:
    return spark.createDataFrame([(*r, i) for i, r in enumerate(coverage_rules(also))], "kind string, category string, description string, edge_type string, category_rank int")


def _case(col: Column, pairs, default=None) -> Column:
    out = None
    for key, value in pairs:
        cond = col == key
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(F.lit(default)) if default is not None else out


def prefix_of_kind(kind: Column) -> Column:
    return _case(kind, [(k, p) for k, p, *_ in KINDS])


def prefix_rank(node_id: Column) -> Column:
    """Place of a node id's prefix in the order of kinds; null for none."""
    return _case(F.substring_index(node_id, ":", 1), [(p, i) for i, (_, p, *_r) in enumerate(KINDS)])


def layer_of_node_id(node_id: Column) -> Column:
    """The layer a node id's prefix stands for; null for an unknown prefix or none."""
    return F.when(node_id.contains(":"), _case(F.substring_index(node_id, ":", 1), [(p, layer) for _, p, _h, _e, layer in KINDS]))


def layer_number(layer: Column) -> Column:
    return _case(layer, [(x, i) for i, x in enumerate(LAYERS)])


def layer_of_path(path: Column) -> Column:
    """The first layer, in order, whose folder the path goes through; ``DEFAULT_LAYER`` for none."""
    out = F.when(path.contains(LAYERS[0] + "/"), F.lit(LAYERS[0]))
    for x in LAYERS[1:]:
        out = out.when(path.contains(x + "/"), F.lit(x))
    return out.otherwise(F.lit(DEFAULT_LAYER))


def is_violation(origin: Column, target: Column) -> Column:
    """Origin below its target, unless it lies in the first layer. False if either is unknown."""
    return F.coalesce((origin != LAYERS[0]) & (layer_number(origin) < layer_number(target)), F.lit(False))
