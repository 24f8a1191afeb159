"""The artifact store: Parquet tables for work, and the file layout that other tools read and write (JSON nodes, JSON-lines edges,
JSON chunk metadata with a float32 file beside it, a JSON manifest)."""

from __future__ import annotations

import json
import os
import posixpath
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..operators.extract import EDGES, Index
from ..operators.retrieval import QueryError
from ..runtime import cut

NODES = "id string, kind string, source_file string, source_hash string, layer string, status string, aliases array<string>, domain string, indexed_fields map<string,string>, indexed_at timestamp_ntz"
META = "id string, document_id string, document_kind string, section_path string, chunk_index int, raw_text string, context_text string, model string, dimensions int, text_hash string, generated_at timestamp_ntz"
EMBEDDINGS = META + ", vector array<float>"
MANIFEST = (
    "version string, kdd_version string, embedding_model string, embedding_dimensions int, embedding_format string, indexed_at timestamp_ntz, indexed_by string, structure string, index_level string, "
    "stats struct<nodes: bigint, edges: bigint, embeddings: bigint, enrichments: bigint>, domains array<string>, git_commit string"
)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _rows(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


# Reading -------------------------------------------------------------------------------------------------------------


def spec_files(spark: SparkSession, root: str, patterns: str = "*.{md,yaml,yml,feature}", unread: bool = False) -> DataFrame:
    """(path, content) of all files below a folder, paths relative to it, by a glob of names. Files that can't be read are left out, or have a null content if ``unread`` asks for them: the
    folder's listing is joined, which opens no file."""
    at = root.rstrip("/")
    found = lambda r: r.option("recursiveFileLookup", True).option("pathGlobFilter", patterns)
    name = lambda c: _relative(F.url_decode(F.regexp_replace(c, r"\+", "%2B")), at)
    texts = found(spark.read).option("ignoreCorruptFiles", True).text(at, wholetext=True).select(name(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("content"))
    if not unread:
        return texts
    return found(spark.read.format("binaryFile")).load(at).select(name(F.col("path")).alias("path")).join(texts, "path", "left")


def _relative(name, root: str):
    base = root.split(":", 1)[-1].replace("//", "/") if ":" in root else os.path.abspath(root)
    return F.substring_index(name, base.rstrip("/") + "/", -1)


def load_nodes(spark: SparkSession, path: str) -> DataFrame:
    """All node files; missing folder: none."""
    at = f"{path}/nodes"
    if not _exists(spark, at):
        return _rows(spark, NODES)
    return spark.read.schema(NODES).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(at)


def load_edges(spark: SparkSession, path: str) -> DataFrame:
    """All edges; blank lines are skipped, a malformed line fails the read."""
    at = f"{path}/edges"
    return spark.read.schema(EDGES).option("mode", "FAILFAST").json(at) if _exists(spark, at) else _rows(spark, EDGES)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of both layouts: with the vector in the JSON, or row by row in the float32 file of the same name."""
    at = f"{path}/embeddings"
    if not _exists(spark, at):
        return _rows(spark, EMBEDDINGS)
    read = spark.read.schema(EMBEDDINGS).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(at)
    stem = lambda c: F.regexp_replace(c, r"\.(json|f32)$", "")
    rows = read.select("*", stem(F.col("_metadata.file_path")).alias("stem"))
    inline = rows.filter("vector is not null").select(*[f.name for f in read.schema])
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.f32").load(at).select(stem(F.col("path")).alias("stem"), "content")
    unpack = F.pandas_udf(_unpack, T.ArrayType(T.FloatType()))
    key = lambda df: df.withColumn("stem", F.regexp_replace("stem", r"^file:/+", "/"))
    joined = key(rows.filter("vector is null")).join(key(raw), "stem")
    placed = joined.withColumn("vector", unpack("content", "chunk_index", "dimensions"))
    return inline.unionByName(placed.select(*[f.name for f in read.schema]))


def _unpack(content: pd.Series, index: pd.Series, dimensions: pd.Series) -> pd.Series:
    return pd.Series([np.frombuffer(c, "<f4", int(d), int(i) * int(d) * 4) for c, i, d in zip(content, index, dimensions)])


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(f"{path}/manifest.json")


@dataclass
class Opened:
    manifest: dict
    nodes: DataFrame
    edges: DataFrame
    embeddings: DataFrame | None


def open_index(spark: SparkSession, path: str, skip_embeddings: bool = False) -> Opened:
    """A stored index, Parquet or file layout. All frames are lazy; embeddings are left out if skipped or if the manifest says there are none."""
    manifest = load_manifest(spark, path).first().asDict(True)
    has = (manifest.get("stats") or {}).get("embeddings") or 0
    if _exists(spark, f"{path}/nodes.parquet"):
        get = lambda n: spark.read.parquet(f"{path}/{n}.parquet")
        return Opened(manifest, get("nodes"), get("edges"), get("embeddings") if has and not skip_embeddings else None)
    return Opened(manifest, load_nodes(spark, path), load_edges(spark, path), load_embeddings(spark, path) if has and not skip_embeddings else None)


def read_section(spark: SparkSession, root: str, file: str, anchor: str | None = None) -> str:
    """A spec's text, or the part from a heading's anchor to the next heading of its level or above; an unknown anchor gives all. Paths out of the root are refused."""
    from ..functions.text import anchor_of

    clean = posixpath.normpath(file)
    if clean.startswith(("/", "..")):
        raise QueryError("BAD_PARAMETER", f"{file} lies outside the specs")
    got = spec_files(spark, f"{root.rstrip('/')}/{posixpath.dirname(clean)}".rstrip("/"), posixpath.basename(clean)).filter(F.col("path") == posixpath.basename(clean)).first()
    if got is None:
        raise QueryError("NODE_NOT_FOUND", file)
    if not anchor:
        return got["content"]
    lines = got["content"].split("\n")
    heads = [(i, len(x) - len(x.lstrip("#")), anchor_of(x.lstrip("#").strip())) for i, x in enumerate(lines) if x.startswith("#")]
    for k, (i, level, a) in enumerate(heads):
        if a == anchor.lstrip("#"):
            end = next((j for j, lv, _ in heads[k + 1 :] if lv <= level), len(lines))
            return "\n".join(lines[i:end]).strip()
    return got["content"]


def delete_document(spark: SparkSession, path: str, kind: str, document_id: str) -> dict[str, int]:
    """Take a document out of the file layout: its node file, its chunk files, the edges that start at it. Gives how many files and edges went; deleting it again takes nothing."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    gone = 0
    for name in (f"nodes/{kind}/{document_id}.json", f"embeddings/{kind}/{document_id}.json", f"embeddings/{kind}/{document_id}.f32"):
        at = hadoop.Path(f"{path}/{name}")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        gone += bool(fs.exists(at) and fs.delete(at, False))
    edges = load_edges(spark, path)
    prefix = next((p for k, p, *_ in dims.KINDS if k == kind), kind)
    mine = edges.filter(F.col("from_node") == f"{prefix}:{document_id}").count()
    if mine:
        kept = cut(edges.filter(F.col("from_node").isNull() | (F.col("from_node") != f"{prefix}:{document_id}")))
        kept.write.mode("overwrite").json(f"{path}/edges")
    return {"files": gone, "edges": mine}


# Writing -------------------------------------------------------------------------------------------------------------


def manifest_of(index: Index, level: str, model: str | None, dimensions: int | None, domains: list[str], git_commit: str | None = None, by: str = "specloom") -> DataFrame:
    """The one-row manifest of an index, its counts taken from the frames."""
    spark = index.nodes.sparkSession
    count = lambda df, name: df.agg(F.count("*").alias(name))
    stats = count(index.nodes, "nodes").join(F.broadcast(count(index.edges, "edges")), F.lit(True))
    stats = stats.join(F.broadcast(count(index.chunks, "embeddings")), F.lit(True)) if index.chunks is not None else stats.withColumn("embeddings", F.lit(0).cast("bigint"))
    with_vectors = level != "L1"
    out = stats.select(
        F.lit("1.0.0").alias("version"), F.lit("1.0.0").alias("kdd_version"), F.lit(model if with_vectors else None).cast("string").alias("embedding_model"), F.lit(dimensions if with_vectors else None).cast("int").alias("embedding_dimensions"),
        F.lit("json+f32" if with_vectors else None).cast("string").alias("embedding_format"), F.current_timestamp().cast("timestamp_ntz").alias("indexed_at"), F.lit(by).alias("indexed_by"), F.lit("flat").alias("structure"), F.lit(level).alias("index_level"),
        F.struct("nodes", "edges", "embeddings", F.lit(0).cast("bigint").alias("enrichments")).alias("stats"), F.array(*map(F.lit, domains)).cast("array<string>").alias("domains"), F.lit(git_commit).cast("string").alias("git_commit"),
    )
    return spark.createDataFrame(out.collect(), out.schema)


def save(index: Index, path: str, manifest: DataFrame) -> None:
    """Overwrite a Parquet index: nodes by kind, edges, chunks, manifest last."""
    index.nodes.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/nodes.parquet")
    index.edges.write.mode("overwrite").parquet(f"{path}/edges.parquet")
    if index.chunks is not None:
        index.chunks.write.mode("overwrite").parquet(f"{path}/embeddings.parquet")
    write_manifest(manifest, path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    row = manifest.select(F.to_json(F.struct(*manifest.columns)).alias("j")).first()["j"]
    _put(manifest.sparkSession, f"{path}/manifest.json", (json.dumps(json.loads(row), indent=2, ensure_ascii=False) + "\n").encode())


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def append_edges(edges: DataFrame, path: str) -> None:
    edges.write.mode("append").json(f"{path}/edges")


def clear_edges(spark: SparkSession, path: str) -> None:
    _rows(spark, EDGES).write.mode("overwrite").json(f"{path}/edges")


def export(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame | None, path: str, manifest: DataFrame | None = None) -> None:
    """Write the file layout. Node and chunk files are written by the executors, to a folder they share; a file's rows are those of one document."""
    root = path.split(":", 1)[-1].replace("///", "/") if path.startswith("file:") else path
    columns = [c.split()[0] for c in NODES.split(", ")]
    shown = nodes.select("id", "kind", F.to_json(F.struct(*[c for c in columns if c in nodes.columns])).alias("j"))

    def put_nodes(frames):
        for f in frames:
            for i, kind, j in zip(f["id"], f["kind"], f["j"]):
                _write(f"{root}/nodes/{kind}/{i.split(':', 1)[-1]}.json", json.dumps(json.loads(j), indent=2, ensure_ascii=False).encode())
            yield f[["id"]]

    shown.mapInPandas(put_nodes, "id string").write.format("noop").mode("overwrite").save()
    edges.write.mode("overwrite").json(f"{path}/edges")
    if embeddings is not None:
        names = [c.split()[0] for c in META.split(", ")]

        def put_chunks(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values("chunk_index").reset_index(drop=True)
            stem = f"{root}/embeddings/{f['document_kind'][0]}/{f['document_id'][0]}"
            rows = [json.loads(j) | {"chunk_index": i} for i, j in enumerate(f["j"])]
            _write(stem + ".json", json.dumps(rows, ensure_ascii=False).encode())
            _write(stem + ".f32", np.stack(f["vector"].to_list()).astype("<f4").tobytes())
            return f[["document_id"]][:1]

        e = embeddings.select("document_kind", "document_id", "chunk_index", "vector", F.to_json(F.struct(*[c for c in names if c in embeddings.columns])).alias("j"))
        e.groupBy("document_kind", "document_id").applyInPandas(put_chunks, "document_id string").write.format("noop").mode("overwrite").save()
    if manifest is not None:
        write_manifest(manifest, path)


def _write(path: str, data: bytes) -> None:
    """Write by way of a temporary name, so that a retried task replaces its own file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.{os.getpid()}.part", "wb") as f:
        f.write(data)
    os.replace(f.name, path)
