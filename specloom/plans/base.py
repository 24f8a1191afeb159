"""The tables as a property graph, for the queries and as SQL for their check."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..runtime import table

#: A fixed query vector for the searches.
VECTOR = [round(math.sin(1.7 * i + 0.4), 4) for i in range(64)]
HUB = "Entity:CarpetaMaestra"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "graph_nodes").unionByName(table(spark, sf_dir, "core_nodes")).select("id", "kind", "layer", "domain", "source_file", "source_hash", "aliases", "indexed_fields", "indexed_at", "loaded_at")
    return G.current(rows, ["id"], "indexed_at", "loaded_at").withColumn("kind", F.lower(F.trim("kind")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "graph_edges").select("edge_id", "from_node", "to_node", "edge_type", "source_file", "ordinal", "layer_violation", "loaded_at")
    return G.current(rows, ["edge_id"], "loaded_at")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.current(table(spark, sf_dir, "chunk_embeddings").select("id", "generated_at", "document_id", "model", "vector"), ["id"], "generated_at")


def graph(spark: SparkSession, sf_dir: str) -> G.Graph:
    return G.build(nodes(spark, sf_dir), edges(spark, sf_dir), table(spark, sf_dir, "graph_edges").select("from_node", "to_node"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions of the chunks, for searches that find the last by generated_at themselves."""
    return table(spark, sf_dir, "chunk_embeddings").select("id", "generated_at", "vector").filter("id is not null")


NODES_SQL = """n as (select * exclude (k) replace (lower(trim(kind)) as kind) from (
  select *, row_number() over (partition by id order by indexed_at desc, loaded_at desc) as k from (select * from graph_nodes union all by name select * from core_nodes)) where k = 1)"""
GRAPH_SQL = f"""{NODES_SQL},
e as (select * exclude (k) from (select *, row_number() over (partition by edge_id order by loaded_at desc) as k from graph_edges) where k = 1),
x as (select e.*, f.id is not null as from_exists, t.id is not null as to_exists from e left join n f on f.id = e.from_node left join n t on t.id = e.to_node),
g as (select * exclude (k) from (select *, row_number() over (partition by from_node, to_node, edge_type order by source_file nulls last, ordinal nulls last, edge_id) as k
  from x where from_exists and to_exists) where k = 1)"""
NEAR_SQL = """u as (select * from g where not coalesce(layer_violation, false)),
near as (select from_node as a, to_node as b from u union select to_node, from_node from u)"""
CHUNKS_SQL = "c as (select * exclude (k) from (select *, row_number() over (partition by id order by generated_at desc) as k from chunk_embeddings) where k = 1)"
VECTOR_SQL = "[" + ", ".join(map(str, VECTOR)) + "]"
