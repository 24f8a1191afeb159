"""Session, table and lineage helpers shared by all operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's ``spark.checkpoint.dir``; where it is unset, in local mode (tests), one of our own, elsewhere an error."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if at is None:
        at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if at is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            at = tempfile.mkdtemp(prefix="specloom-checkpoint-")
        sc.setCheckpointDir(at)
        at = sc.getCheckpointDir()
    return at


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage by a reliable checkpoint in the shared folder.

    The files outlive a lost executor; never a local checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes (of the rows written as JSON) up to which a computed frame is broadcast; beyond that joins shuffle.
BROADCAST_BYTES = 8 << 20


def measured(df: DataFrame) -> tuple[DataFrame, bool]:
    """``df`` cut, and whether its rows are small enough to be broadcast. They are measured while they are written: no job of its own."""
    seen = Observation()
    done = cut(df.observe(seen, F.sum(F.length(F.to_json(F.struct("*")))).alias("bytes")))
    return done, (seen.get["bytes"] or 0) <= BROADCAST_BYTES


def together(*parts: Callable):
    """Run independent jobs side by side; small ones leave most cores idle if they wait for each other. Gives their results in order."""
    with ThreadPoolExecutor(len(parts)) as pool:
        return [f.result() for f in [pool.submit(p) for p in parts]]


def near_join(links: DataFrame, side: DataFrame, small: bool, key: str, other: str) -> DataFrame:
    """The join of edges with ``side`` on ``key``. A small side is broadcast and no edge moves; else both shuffle, salted by the edges' column ``other``, so that a key that
    a tenth of all edges share lies in ``SALTS`` tasks."""
    if small:
        return links.join(F.broadcast(side), key)
    salted = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return links.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"]).drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, if it is read in fewer: one small file would keep one core busy. Larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 8) else df

