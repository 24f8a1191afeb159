"""Structured Streaming: re-indexing as specs change, states of documents, and windowed query telemetry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import extract, graph, maintain


def watch(spark: SparkSession, root: str, patterns: str = "*.md", max_files: int = 1000) -> DataFrame:
    """A stream of (path, content) of spec files as they appear below a folder."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", patterns).option("maxFilesPerTrigger", max_files).load(root)
    return raw.select("path", F.col("content").cast("string").alias("content"), F.col("modificationTime").cast("timestamp_ntz").alias("changed_at"))


def reindex(files: DataFrame, target: str, checkpoint: str, then: Callable[[DataFrame], None] | None = None):
    """Keep a Parquet index of nodes and edges up to date: each batch is indexed and written under its number, so a batch run again replaces its own files."""

    def batch(df: DataFrame, number: int) -> None:
        made = extract.index(df.select("path", "content"))
        made.nodes.drop("tables").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/nodes/batch={number}")
        made.edges.withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{target}/edges/batch={number}")
        if then:
            then(made.nodes)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a streamed index: of each node the last batch's, of the edges those of their file's last batch."""
    nodes = spark.read.option("recursiveFileLookup", True).parquet(f"{target}/nodes")
    edges = spark.read.option("recursiveFileLookup", True).parquet(f"{target}/edges")
    last = nodes.groupBy("source_file").agg(F.max("batch").alias("batch_no"))
    return graph.current(nodes, ["id"], "batch").drop("batch"), edges.join(last, ["source_file", "batch_no"], "left_semi").drop("batch_no")


def telemetry(events: DataFrame, at: str = "ts", late: str = "10 minutes", every: str = "5 minutes", slide: str | None = None, *keys: str) -> DataFrame:
    """Counts and sums per window of a stream; rows later than ``late`` are dropped."""
    return maintain.windows(events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late), at, every, slide, *keys)


def latency(queries: DataFrame, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """95th percentile of ``value`` per minute."""
    return queries.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, "1 minute").alias("w")).agg(F.percentile_approx("value", 0.95).alias("p95"), F.count("*").alias("queries")).select(F.col("w.start").alias("start"), "p95", "queries")


def states(events: DataFrame, key: str, state: str, at: str) -> DataFrame:
    """(key, state, at, changes): the latest state of each key, kept in the stream's state store; an event older than the state is passed over."""
    kind = events.schema[key].dataType.simpleString()

    def fold(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now, when, n = held.get if held.exists else (None, None, 0)
        for f in frames:
            for s, t in f.sort_values(at)[[state, at]].itertuples(index=False):
                if when is None or t.value >= when:
                    n += s != now
                    now, when = s, t.value
        held.update((now, when, n))
        yield pd.DataFrame({key: [k[0]], state: [now], at: [pd.Timestamp(when)], "changes": [n]})

    out = f"`{key}` {kind}, `{state}` string, `{at}` {events.schema[at].dataType.simpleString()}, changes bigint"
    return events.groupBy(key).applyInPandasWithState(fold, out, "state string, at bigint, changes bigint", "update", GroupStateTimeout.NoTimeout)
