"""References to records that do not exist, by compressed key bitmaps per key range and period.

Keys are dictionary-encoded as integers; a code's upper part is its key range, its next bits the word within the range's bitmap, the lowest six the bit within the word.
A bitmap is compressed by keeping its words that are not zero, in order. Per range and period there is a bitmap of the keys referenced in the
period and one of the parents that stood before it began, over the same words; reference AND-NOT parent leaves the suspects, whose bits are decoded back to keys.
A suspect that was first indexed within or after its period is then judged by exact time.

A key that is named by more than a thousandth of all ends is hot. There are fewer than a thousand such keys, so they are broadcast and their ends never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

RANGE_BITS = 15
WORD_BITS = 6
NO_PERIOD = 0
HOT = 1000


def period(col):
    """Months as integers; ``NO_PERIOD`` where there is no time."""
    return F.coalesce(F.year(col) * 12 + F.month(col), F.lit(NO_PERIOD))


def edge_ends(edges: DataFrame) -> DataFrame:
    """(edge_id, edge_type, extracted_at, end_side, key, period): an end a row, null and blank ends left out."""
    side = lambda c: F.struct(F.lit(c).alias("end_side"), F.col(c).alias("key"))
    ends = edges.select("edge_id", "edge_type", "extracted_at", F.explode(F.array(side("from_node"), side("to_node"))).alias("e"))
    return ends.select("edge_id", "edge_type", "extracted_at", "e.end_side", "e.key", period(F.col("extracted_at")).alias("period")).filter(F.col("key").rlike(r"(?U)[^\s\p{Z}]"))


def key_dictionary(ends: DataFrame, nodes: list[DataFrame], removals: DataFrame) -> DataFrame:
    """One row per key of either side: code, life span and the periods that refer to it.

    Everything about a key meets in one aggregation, combined before its shuffle; the codes number the rows of a partition and are made
    firm by a checkpoint. The number of periods a key can have is the number of months on record."""
    null = lambda t: F.lit(None).cast(t)
    parts = [ends.select("key", F.col("period"), null("boolean").alias("node"), null("timestamp_ntz").alias("indexed"), null("timestamp_ntz").alias("removed"))]
    parts += [n.select(F.col("id").alias("key"), null("int").alias("period"), F.lit(True).alias("node"), F.col("indexed_at").alias("indexed"), null("timestamp_ntz").alias("removed")) for n in nodes]
    parts += [removals.select(F.col("node_id").alias("key"), null("int").alias("period"), null("boolean").alias("node"), null("timestamp_ntz").alias("indexed"), F.col("removed_at").alias("removed"))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.filter(F.col("key").isNotNull())
    g = rows.groupBy("key").agg(
        F.collect_set("period").alias("periods"),
        F.count("period").alias("refs"),
        F.max("node").alias("known"),
        F.min("indexed").alias("first"),
        F.max("indexed").alias("last"),
        F.max("removed").alias("removed"),
    ).filter(F.size("periods") > 0)
    g = g.withColumn("gone", F.coalesce(F.col("removed") > F.col("last"), F.lit(False)))
    coded = g.select("key", F.monotonically_increasing_id().alias("code"), "periods", "refs", "known", "first", "gone")
    return cut(coded.withColumn("range", F.shiftright("code", RANGE_BITS)))


def bitmaps(dictionary: DataFrame) -> DataFrame:
    """(range, period, words): a row per key range and period; ``words`` has (word, refs, parents) for every word in which a bit of ``refs`` is set, in order.

    A parent of a period is a key that is not gone and whose first row is older than the period."""
    word = F.shiftright("code", WORD_BITS).bitwiseAND((1 << (RANGE_BITS - WORD_BITS)) - 1).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(code & {(1 << WORD_BITS) - 1} as int))")
    parent = F.col("known") & ~F.col("gone") & (period(F.col("first")) < F.col("period"))
    refs = dictionary.select("range", word.alias("word"), bit.alias("bit"), "known", "gone", "first", F.explode("periods").alias("period"))
    words = refs.groupBy("range", "period", "word").agg(F.bit_or("bit").alias("refs"), F.bit_or(F.when(parent, F.col("bit")).otherwise(F.lit(0).cast("bigint"))).alias("parents"))
    return words.groupBy("range", "period").agg(F.array_sort(F.collect_list(F.struct("word", "refs", "parents"))).alias("words"))


def suspects(dictionary: DataFrame) -> DataFrame:
    """(key, period, known, first, gone, hot) of reference AND-NOT parent, decoded."""
    left = F.filter(F.transform("words", lambda w: F.struct(w["word"].alias("word"), w["refs"].bitwiseAND(F.bitwise_not(w["parents"])).alias("bits"))), lambda w: w["bits"] != 0)
    bits = bitmaps(dictionary).select("range", "period", F.explode(left).alias("w")).select("range", "period", "w.word", "w.bits", F.explode(F.sequence(F.lit(0), F.lit((1 << WORD_BITS) - 1))).alias("bit"))
    code = F.shiftleft(F.col("range"), RANGE_BITS) + F.shiftleft(F.col("word"), WORD_BITS) + F.col("bit")
    codes = bits.filter(F.expr("bit_get(bits, bit) = 1")).select(code.alias("code"), "period")
    return codes.join(dictionary.select("code", "key", "known", "first", "gone"), "code").drop("code")


def broken_ends(edges: DataFrame, nodes: list[DataFrame], removals: DataFrame) -> DataFrame:
    """(edge_id, end_side, edge_type, extracted_at, key, reason), one row per edge and end; reason 'missing', 'gone' or 'late'.

    Null and blank ends are no references. Redelivered edges count once. Equal times are in order (an edge extracted as its node was indexed is
    whole). An edge without a time can be missing or gone, never late."""
    ends = edge_ends(edges)
    dictionary = key_dictionary(ends, nodes, removals)
    total = dictionary.agg(F.sum("refs")).first()[0] or 0
    hot = F.broadcast(dictionary.filter(F.col("refs") * HOT > total).select("key", F.lit(True).alias("hot")))  # fewer than HOT keys
    bad = cut(suspects(dictionary).join(hot, "key", "left"))
    marked = ends.join(hot, "key", "left")
    few = F.broadcast(bad.filter("hot").drop("hot"))  # fewer than HOT keys, times the months on record
    hit = marked.filter("hot").drop("hot").join(few, ["key", "period"]).unionByName(marked.filter("hot is null").drop("hot").join(bad.filter("hot is null").drop("hot"), ["key", "period"]))
    reason = F.when(F.col("gone"), "gone").when(F.col("known").isNull(), "missing").when(F.col("first") > F.col("extracted_at"), "late")
    hit = hit.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return hit.groupBy("edge_id", "end_side").agg(F.first("edge_type", True).alias("edge_type"), F.first("extracted_at", True).alias("extracted_at"), F.first("key").alias("key"), F.first("reason").alias("reason"))


def orphan_report(edges: DataFrame, nodes: list[DataFrame], removals: DataFrame) -> DataFrame:
    """Broken ends counted per edge_type, end and month of extracted_at (null where an edge has none), by reason."""
    b = broken_ends(edges, nodes, removals)
    count = lambda r: F.sum(F.when(F.col("reason") == r, 1).otherwise(0))
    return b.groupBy("edge_type", "end_side", F.date_format("extracted_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("broken"), count("missing").alias("missing"), count("gone").alias("gone"), count("late").alias("late"))
