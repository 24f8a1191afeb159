"""Queries on index upkeep: what a run must take (p1), references that lead nowhere (p4)."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import orphans, worklist
from ..runtime import shared_dir, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given tables as events of the work ledger."""
    t = lambda n: table(spark, sf_dir, n)
    return (
        worklist.current_versions(t("graph_nodes"), "graph_nodes", "id", "source_hash", "indexed_at")
        .unionByName(worklist.current_versions(t("chunk_embeddings"), "chunk_embeddings", "id", "text_hash", "generated_at"))
        .unionByName(worklist.done_versions(t("process_ledger"), t("index_manifests")))
        .unionByName(worklist.removed_records(t("node_removals"), "graph_nodes", "node_id", "removed_at"))
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the next run takes: a ledger that goes on from the given tables leases all that is pending; the rows are read from that lease.

    Each call opens a ledger of its own in the shared folder, as the given tables, which it continues, are not written to."""
    ledger = worklist.WorkLedger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}", _events(spark, sf_dir))
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    return ledger.leased(ledger.lease("p1_found", now + timedelta(hours=1), now)).select("rec_table", "rec_id")


def p1_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of each table are new, changed, done, removed, or only known to the ledger."""
    w = worklist.fold(_events(spark, sf_dir))
    state = F.when((F.col("state") == "pending") & F.col("done_digest").isNull(), "new").when(F.col("state") == "pending", "changed").otherwise(F.col("state"))
    return w.groupBy("rec_table", state.alias("state")).agg(F.count("*").alias("records"))


def _p4(spark: SparkSession, sf_dir: str):
    return table(spark, sf_dir, "graph_edges"), [table(spark, sf_dir, "graph_nodes"), table(spark, sf_dir, "core_nodes")], table(spark, sf_dir, "node_removals")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.broken_ends(*_p4(spark, sf_dir)).select("edge_id", "end_side")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(*_p4(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_states": p1_states, "p4_found": p4_found, "p4_report": p4_report}

_DIGEST = r"nullif(regexp_replace(trim(lower({0}), chr(9) || chr(10) || chr(13) || ' ' || chr(160)), '^[a-z][a-z0-9_/-]*\s*[:=]\s*', ''), '')"

_P1 = f"""
with ok as (select run_id from (select run_id, arg_max(status, reported_at) as s from index_manifests group by run_id) where s = 'success'),
removed as (select node_id, max(removed_at) as at from node_removals group by node_id),
cur as (
  select 'graph_nodes' as rec_table, id as rec_id, {_DIGEST.format('h')} as d from (
    select id, indexed_at, source_hash as h, row_number() over (partition by id order by indexed_at desc) as k from graph_nodes) n
  left join removed r on r.node_id = n.id where k = 1 and (r.at is null or r.at <= n.indexed_at)
  union all
  select 'chunk_embeddings', id, {_DIGEST.format('h')} from (
    select id, text_hash as h, row_number() over (partition by id order by generated_at desc) as k from chunk_embeddings) where k = 1),
did as (
  select rec_table, rec_id, {_DIGEST.format('h')} as d from (
    select rec_table, rec_id, seen_hash as h, row_number() over (partition by rec_table, rec_id order by processed_at desc, ledger_id desc) as k
    from process_ledger where run_id in (select run_id from ok)) where k = 1)
"""

_P4 = """
with e as (
  select distinct edge_id, 'from_node' as end_side, from_node as k, edge_type, extracted_at from graph_edges
  union all select distinct edge_id, 'to_node', to_node, edge_type, extracted_at from graph_edges),
n as (select id, min(indexed_at) as f, max(indexed_at) as l from (
  select id, indexed_at from graph_nodes union all select id, indexed_at from core_nodes) group by id),
r as (select node_id, max(removed_at) as at from node_removals group by node_id),
b as (select e.*, case when r.at > n.l then 'gone' when n.id is null then 'missing' when n.f > e.extracted_at then 'late' end as reason
  from e left join n on n.id = e.k left join r on r.node_id = e.k where trim(e.k) <> '')
"""

ORACLE = {
    "p1_found": _P1 + "select c.rec_table, c.rec_id from cur c left join did using (rec_table, rec_id) where did.d is null or c.d is null or c.d <> did.d",
    "p1_states": _P1
    + f""", all_nodes as (select id as rec_id, max(indexed_at) as seen_at, arg_max(source_hash, indexed_at) as h from graph_nodes where id is not null group by id),
every as (
  select 'graph_nodes' as rec_table, rec_id, seen_at, {_DIGEST.format("h")} as d, true as there from all_nodes
  union all select 'chunk_embeddings', rec_id, null, d, true from cur where rec_table = 'chunk_embeddings'),
keys as (select rec_table, rec_id from every union select rec_table, rec_id from process_ledger where run_id in (select run_id from ok) and rec_id is not null union select 'graph_nodes', node_id from node_removals where node_id is not null)
select rec_table, case when there is null then 'unknown' when r.at > every.seen_at then 'removed' when every.d = did.d then 'done' when did.d is null then 'new' else 'changed' end as state, count(*) as records
from keys left join every using (rec_table, rec_id) left join did using (rec_table, rec_id) left join removed r on rec_table = 'graph_nodes' and r.node_id = rec_id group by all""",
    "p4_found": _P4 + "select edge_id, end_side from b where reason is not null group by all",
    "p4_report": _P4
    + """select edge_type, end_side, strftime(extracted_at, '%Y-%m') as month, count(*) as broken, count(*) filter (reason = 'missing') as missing,
  count(*) filter (reason = 'gone') as gone, count(*) filter (reason = 'late') as late
from (select edge_id, end_side, any_value(edge_type) as edge_type, any_value(extracted_at) as extracted_at, any_value(reason) as reason
  from b where reason is not null group by 1, 2) group by all""",
}
