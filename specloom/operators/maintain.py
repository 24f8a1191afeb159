"""Upkeep of indices: what changed, cascading deletes, merging several indices, states from events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import QueryError


def diff(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """(source_file, change) of two sets of (source_file, source_hash): 'A' added, 'M' modified, 'D' deleted, '=' unchanged ('M' if forced).

    A renamed file is one deleted and one added. Equal nulls are unchanged. Of several rows of a file the greatest hash counts. One shuffle: a union folded by file."""
    side = lambda df, s: df.select("source_file", F.lit(s).alias("side"), F.struct(F.lit(1).alias("there"), F.col("source_hash").alias("h")).alias("v"))
    both = side(old, "old").unionByName(side(new, "new")).groupBy("source_file").agg(F.max(F.when(F.col("side") == "old", F.col("v"))).alias("o"), F.max(F.when(F.col("side") == "new", F.col("v"))).alias("n"))
    same = F.lit("M") if force else F.lit("=")
    return both.select("source_file", F.when(F.col("o").isNull(), "A").when(F.col("n").isNull(), "D").when(F.col("o.h").eqNullSafe(F.col("n.h")), same).otherwise("M").alias("change"))


def run_kind(manifest: dict | None, commit: str | None, known: bool, changes: DataFrame, force: bool = False) -> str:
    """What an index run does: 'full' without a manifest, without its commit, or where that commit is not ``known`` any more, or if forced; 'none' where no spec changed (the manifest
    then stays as it is); else 'incremental'."""
    if force or not manifest or not manifest.get("git_commit") or not known:
        return "full"
    if commit is not None and commit == manifest["git_commit"]:
        return "none"
    return "none" if changes.filter("change <> '='").isEmpty() else "incremental"


# The event types of documents, of queries and of merges, and the state that a document's event puts it in.
EVENT_TYPES = {
    "Document-Detected": "detected", "Document-Parsed": "parsing", "Document-Indexed": "indexed", "Document-Stale": "stale", "Document-Deleted": "deleted",
    "Query-Received": None, "Query-Completed": None, "Query-Failed": None, "Merge-Requested": None, "Merge-Completed": None,
}


def document_events(changes: DataFrame, log: DataFrame, at) -> DataFrame:
    """(source_file, step, event_type, state, at): the events of one run, by what changed (source_file, change) and what became of each file (source_path, node_id, skipped_reason).

    An added file is detected, parsed and indexed; a modified one stale first; a deleted one deleted. A skipped file is detected only. Unchanged files give none."""
    done = log.groupBy(F.col("source_path").alias("source_file")).agg(F.max(F.col("node_id").isNotNull()).alias("indexed"))
    steps = {"A": ["Document-Detected", "Document-Parsed", "Document-Indexed"], "M": ["Document-Stale", "Document-Parsed", "Document-Indexed"], "D": ["Document-Deleted"]}
    of = F.create_map(*[x for k, v in steps.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = changes.filter(F.col("change").isin(*steps)).join(done, "source_file", "left").select("source_file", F.col("change"), "indexed", F.posexplode(of[F.col("change")]).alias("step", "event_type"))
    rows = rows.filter((F.col("change") == "D") | (F.col("step") == 0) | F.coalesce("indexed", F.lit(False)))
    state = F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() if kv[1] for x in kv])[F.col("event_type")]
    return rows.select("source_file", "step", "event_type", state.alias("state"), F.lit(at).cast("timestamp_ntz").alias("at"))


@dataclass
class Tables:
    nodes: DataFrame
    edges: DataFrame
    embeddings: DataFrame


def _document(node_id: Column) -> Column:
    return F.when(node_id.contains(":"), F.expr("substr(id, instr(id, ':') + 1)")).otherwise(node_id)


def cascade(tables: Tables, gone: DataFrame) -> Tables:
    """The tables without the nodes of ``gone`` (id), the edges that touch them at either end, and the chunks of their documents."""
    ids = gone.select("id").filter(F.col("id").isNotNull()).distinct()
    docs = ids.select(_document(F.col("id")).alias("document_id")).distinct()
    return Tables(
        tables.nodes.join(ids, "id", "left_anti"),
        tables.edges.join(ids.withColumnRenamed("id", "from_node"), "from_node", "left_anti").join(ids.withColumnRenamed("id", "to_node"), "to_node", "left_anti"),
        tables.embeddings.join(docs, "document_id", "left_anti"),
    )


def update(old: Tables, new: Tables, changes: DataFrame) -> Tables:
    """An index brought up to date: what came of changed and deleted files goes, what the new run made of added and changed files comes in."""
    stale = changes.filter(F.col("change").isin("M", "D")).select("source_file")
    fresh = changes.filter(F.col("change").isin("M", "A")).select("source_file")
    gone = old.nodes.join(stale, "source_file", "left_semi").select("id")
    docs = gone.select(_document(F.col("id")).alias("document_id")).distinct()
    kept = Tables(old.nodes.join(gone.distinct(), "id", "left_anti"), old.edges.join(stale, "source_file", "left_anti"), old.embeddings.join(docs, "document_id", "left_anti"))
    came = new.nodes.join(fresh, "source_file", "left_semi")
    new_docs = came.select(_document(F.col("id")).alias("document_id")).distinct()
    return Tables(kept.nodes.unionByName(came), kept.edges.unionByName(new.edges.join(fresh, "source_file", "left_semi")), kept.embeddings.unionByName(new.embeddings.join(new_docs, "document_id", "left_semi")))


def compatible(manifests: list[dict]) -> None:
    """Refuse to merge indices of different major version, structure, or embedding model (from level L2 on)."""
    if len(manifests) < 2:
        raise QueryError("BAD_PARAMETER", "a merge takes two indices at least")
    majors = {str(m.get("version", "")).split(".")[0] for m in manifests}
    models = {m.get("embedding_model") for m in manifests if m.get("index_level", "L1") != "L1"}
    for name, values in (("major version", majors), ("structure", {m.get("structure") for m in manifests}), ("embedding model", models)):
        if len(values) > 1:
            raise QueryError("BAD_PARAMETER", f"indices differ in {name}: {sorted(map(str, values))}")


def merge_nodes(nodes: DataFrame, removals: DataFrame | None = None) -> DataFrame:
    """(id, index_id, source_hash, indexed_at, conflict) of the winners among (index_id, id, source_hash, indexed_at): the latest; ties by hash, then index.

    ``removals`` (id, removed_at): a removal not older than the winner wins. In conflict are ids with several hashes."""
    won = nodes.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("indexed_at", "source_hash", "index_id")).alias("w"), F.min("source_hash").alias("lo"), F.max("source_hash").alias("hi"))
    out = won.select("id", "w.index_id", "w.source_hash", "w.indexed_at", F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)).alias("conflict"))
    if removals is None:
        return out
    gone = removals.groupBy("id").agg(F.max("removed_at").alias("removed_at"))
    return out.join(gone, "id", "left").filter("removed_at is null or removed_at < indexed_at").drop("removed_at")


def merge(indices: list[Tables], removals: DataFrame | None = None, manifests: list[dict] | None = None, fail_on_conflict: bool = False) -> Tables:
    """One index of several: nodes by last write, edges united, those of nodes that lost to a removal taken off, chunks wholly from the index of the winning node."""
    if manifests is not None:
        compatible(manifests)
    together = lambda get: _union([get(t).withColumn("index_id", F.lit(i)) for i, t in enumerate(indices)])
    nodes, edges, chunks = together(lambda t: t.nodes), together(lambda t: t.edges), together(lambda t: t.embeddings)
    won = merge_nodes(nodes, removals)
    if fail_on_conflict and not won.filter("conflict").isEmpty():
        raise QueryError("BAD_PARAMETER", "indices are in conflict")
    key = won.select("id", "index_id")
    kept = nodes.join(key, ["id", "index_id"], "left_semi").dropDuplicates(["id"]).drop("index_id")
    distinct = edges.dropDuplicates(["from_node", "to_node", "edge_type"]).drop("index_id")
    if removals is not None:
        gone = removals.select("id").distinct().join(key, "id", "left_anti")
        distinct = distinct.join(gone.withColumnRenamed("id", "from_node"), "from_node", "left_anti").join(gone.withColumnRenamed("id", "to_node"), "to_node", "left_anti")
    docs = key.select(_document(F.col("id")).alias("document_id"), "index_id").distinct()
    return Tables(kept, distinct, chunks.join(docs, ["document_id", "index_id"], "left_semi").drop("index_id"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def latest_state(events: DataFrame, key: str, state: str, at: str, tie: str) -> DataFrame:
    """(key, state, at): the last state of each key."""
    return events.groupBy(key).agg(F.max(F.struct(at, tie, state)).alias("m")).select(key, F.col(f"m.{state}").alias(state), F.col(f"m.{at}").alias(at))


def windows(events: DataFrame, at: str, every: str, slide: str | None, *keys: str) -> DataFrame:
    """(start, keys, events, value) per tumbling or sliding window; works on a stream with a watermark as on a table."""
    w = F.window(at, every, slide) if slide else F.window(at, every)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), *keys, "events", "value")
