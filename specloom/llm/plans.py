"""Queries of the training-data problems 2, 3, 5, 6, 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, spread, table
from . import bpe, markup, neighbours, packing, splitting, truncation


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "chunk_embeddings").select("id", "generated_at", "raw_text", "context_text"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split(splitting.oversized(table(spark, sf_dir, "chunk_embeddings"), table(spark, sf_dir, "encoder_models")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that the splitter cuts: each has a second piece, one only."""
    return _pieces(spark, sf_dir).filter("piece = 1").select("id")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


def p2_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, fits, shares): the pieces of each text put together again without what they share, whether all are within the limit, and whether each starts with what the piece before it ends with."""
    over = cut(splitting.oversized(table(spark, sf_dir, "chunk_embeddings"), table(spark, sf_dir, "encoder_models")))
    shared = F.least(F.greatest(F.coalesce("overlap_chars", F.lit(0)), F.lit(0)), F.floor((F.col("max_chars") - 1) / 2)).cast("int")
    p = splitting.split(over).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("piece", "start", "text"))).alias("p")).join(over.select("id", "max_chars", shared.alias("shared")), "id")
    rest = F.slice("p", 2, F.size("p"))
    behind = F.zip_with(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), rest, lambda a, b: (a["start"] + F.length(a["text"]) - F.col("shared") == b["start"]) & (F.right(a["text"], F.col("shared")) == F.left(b["text"], F.col("shared"))))
    text = F.concat(F.col("p")[0]["text"], F.array_join(F.transform(rest, lambda x: F.substring(x["text"], F.col("shared") + 1, F.length(x["text"]))), ""))
    return p.select("id", text.alias("text"), F.forall("p", lambda x: F.length(x["text"]) <= F.col("max_chars")).alias("fits"), F.forall(behind, lambda x: x).alias("shares"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.carried(_chunk_texts(spark, sf_dir))


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.cleaned(_chunk_texts(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The floor of the pairs wanted is the ball within which neighbours are looked for; what lies outside can't be among a point's ten with that cosine."""
    points = neighbours.current_points(table(spark, sf_dir, "chunk_embeddings"))
    return neighbours.mutual(neighbours.closed(neighbours.similar(points, 10, floor=0.95), 10)).select("id_a", "id_b")


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = neighbours.current_points(table(spark, sf_dir, "chunk_embeddings"))
    return neighbours.similar(points, 10)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(_texts(spark, sf_dir))


def _capacity(spark: SparkSession, sf_dir: str, window: str) -> int:
    return table(spark, sf_dir, "pack_windows").filter(F.col("window_name") == window).first()["capacity_tokens"]


def p7_windows(spark: SparkSession, sf_dir: str, window: str = "base") -> DataFrame:
    sizes = cut(bpe.count_tokens(_texts(spark, sf_dir)))
    return packing.pack(sizes, _capacity(spark, sf_dir, window))


def p7_fill(spark: SparkSession, sf_dir: str, window: str = "base") -> DataFrame:
    """Windows, texts, tokens and the share of the windows' room that is filled."""
    capacity = _capacity(spark, sf_dir, window)
    w = p7_windows(spark, sf_dir, window)
    return w.agg(F.countDistinct("window_id").alias("windows"), F.countDistinct("doc_id").alias("texts"), F.sum("tokens").alias("tokens")).withColumn("fill", F.try_divide(F.col("tokens").cast("double"), F.col("windows") * capacity))


def p7_faults(spark: SparkSession, sf_dir: str, window: str = "base") -> DataFrame:
    """One row: windows over their capacity, texts cut though they fit, texts with tokens that are in no window or not wholly."""
    capacity = _capacity(spark, sf_dir, window)
    sizes = cut(bpe.count_tokens(_texts(spark, sf_dir)))
    w = cut(packing.pack(sizes, capacity))
    over = w.groupBy("window_id").agg(F.sum("tokens").alias("n")).filter(F.col("n") > capacity).agg(F.count("*").alias("too_full"))
    got = w.groupBy("doc_id").agg(F.sum("tokens").alias("placed"), F.count("*").alias("pieces"))
    per = sizes.filter("tokens > 0").join(got, "doc_id", "left").agg(F.count_if((F.col("tokens") <= capacity) & (F.col("pieces") > 1)).alias("divided"), F.count_if(~F.col("tokens").eqNullSafe(F.col("placed"))).alias("lost"))
    return over.join(F.broadcast(per), F.lit(True))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_off(_texts(spark, sf_dir)).select("doc_id")


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return truncation.shares(docs, truncation.cut_off(_texts(spark, sf_dir)))


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_rejoined": p2_rejoined, "p3_found": p3_found, "p3_clean": p3_clean, "p5_found": p5_found, "p5_neighbours": p5_neighbours, "p6_ids": p6_ids, "p7_windows": p7_windows, "p7_fill": p7_fill, "p7_faults": p7_faults, "p8_found": p8_found, "p8_sources": p8_sources}

ORACLE = {
    "p5_found": """with u as (
  select id, coalesce(document_id, chr(1) || id) as doc, model, vector::double[] as v from (
    select *, row_number() over (partition by id order by generated_at desc) as k from chunk_embeddings) c
  where k = 1 and vector is not null and len(vector) = dimensions and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0),
s as (select a.id, b.id as other, list_cosine_similarity(a.v, b.v) as c from u a join u b on a.model = b.model and a.doc <> b.doc and len(a.v) = len(b.v)),
t as (select * from (select *, row_number() over (partition by id order by round(c, 9) desc, other) as k from s) r where k <= 10 and c >= 0.95)
select t.id as id_a, t.other as id_b from t join t r on r.id = t.other and r.other = t.id where t.id < t.other""",
    "p2_rejoined": """select id, raw_text as text, true as fits, true as shares from (select id, raw_text, model, row_number() over (partition by id order by generated_at desc) as k from chunk_embeddings) c
join encoder_models m using (model) where k = 1 and length(raw_text) > max_chars""",
    "p7_faults": "select 0 as too_full, 0 as divided, 0 as lost",
    "p2_found": """select id from (select id, raw_text, model, row_number() over (partition by id order by generated_at desc) as k from chunk_embeddings) c
join encoder_models m using (model) where k = 1 and length(raw_text) > max_chars""",
}
