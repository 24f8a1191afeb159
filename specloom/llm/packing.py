"""Filling fixed-capacity windows with texts: shortest-pack-first over the length histogram.

Only the histogram of lengths (at most ``capacity`` rows) and the packing patterns made from it reach the driver; both depend on the capacity,
not on the number of texts. Lengths are placed longest first, each time into the packs with the most room; what is kept is how many packs
have a pattern. Texts then get a rank within their length, and ranks map to the patterns' slots.

Texts of no tokens (null, empty) are left out. A text longer than the window is cut into full windows and a rest that is packed like any
text. Repeated rows are items of their own. An empty table gives no windows. A length that very many texts share is ranked in salted parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(number of windows, {length: how many of it in each})], every item of the histogram in exactly one window.

    Shortest pack first, with one refinement: where a length fits the room of some pack exactly, these packs are filled first."""
    room: dict[int, list[list]] = {}  # room left -> [count, pattern]; a pattern is a linked list (length, rest)
    for length in sorted((n for n in histogram if n > 0), reverse=True):
        left = histogram[length]

        def place(space: int, left: int) -> int:
            packs = room[space]
            while packs and left:
                count, pattern = packs[-1]
                take = min(count, left)
                room.setdefault(space - length, []).append([take, (length, pattern)])
                left -= take
                if take == count:
                    packs.pop()
                else:
                    packs[-1][0] -= take
            if not packs:
                del room[space]
            return left

        if length in room:
            left = place(length, left)
        while left:
            space = max(room, default=0)
            if space < length:
                each = capacity // length
                full, rest = divmod(left, each)
                for count, times in ((full, each), (1 if rest else 0, rest)):
                    if count:
                        pattern = None
                        for _ in range(times):
                            pattern = (length, pattern)
                        room.setdefault(capacity - times * length, []).append([count, pattern])
                break
            left = place(space, left)
    out = []
    for space in sorted(room):
        for count, pattern in room[space]:
            items: dict[int, int] = {}
            while pattern:
                items[pattern[0]] = items.get(pattern[0], 0) + 1
                pattern = pattern[1]
            out.append((count, items))
    return out


def slots(patterns: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Per length, runs of ranks that share a pattern slot: (length, first rank) sorted, first window, place within the window."""
    length, rank, window, place = [], [], [], []
    used: dict[int, int] = {}
    base = 0
    for count, items in patterns:
        at = 0
        for n in sorted(items, reverse=True):
            for _ in range(items[n]):
                length.append(n)
                rank.append(used.get(n, 0))
                window.append(base)
                place.append(at)
                used[n] = used.get(n, 0) + count
                at += 1
        base += count
    order = np.lexsort((rank, length)) if length else np.zeros(0, int)
    return {k: np.array(v, np.int64)[order] for k, v in (("length", length), ("rank", rank), ("window", window), ("place", place))}


def pieces(sizes: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """(id, piece, start, tokens): a row per text that fits, the full pieces and the rest of one that doesn't."""
    n = F.col("tokens")
    last = F.floor((n - 1) / capacity)
    return (
        sizes.filter(n > 0)
        .select(id_col, "tokens", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("piece"))
        .select(id_col, "piece", (F.col("piece").cast("bigint") * capacity).alias("start"), F.least(F.lit(capacity).cast("bigint"), n - F.col("piece").cast("bigint") * capacity).alias("tokens"))
    )


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """(window_id, place, id, piece, start, tokens) for texts measured as (id, tokens). ``sizes`` is read twice: cut its lineage first."""
    items = pieces(sizes, capacity, id_col)
    salt = F.pmod(F.xxhash64(id_col, "piece"), F.lit(SALTS)).cast("int")
    counts = items.groupBy("tokens", salt.alias("salt")).count()
    hist = {r["tokens"]: r["n"] for r in counts.groupBy("tokens").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    table = slots(pack_histogram(hist, capacity))
    offsets = counts.select("tokens", "salt", (F.sum("count").over(Window.partitionBy("tokens").orderBy("salt")) - F.col("count")).alias("before"))
    ranked = (
        items.withColumn("salt", salt)
        .withColumn("k", F.row_number().over(Window.partitionBy("tokens", "salt").orderBy(id_col, "piece")))
        .join(offsets, ["tokens", "salt"])
        .select(id_col, "piece", "start", "tokens", (F.col("before") + F.col("k") - 1).alias("rank"))
    )
    lengths, firsts = np.unique(table["length"], return_index=True)
    ends = np.append(firsts[1:], len(table["length"]))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n, r = f["tokens"].to_numpy(), f["rank"].to_numpy()
            at = np.zeros(len(f), np.int64)
            order = np.argsort(n, kind="stable")
            cuts = np.flatnonzero(np.diff(n[order])) + 1
            for part in np.split(order, cuts) if len(order) else []:
                i = np.searchsorted(lengths, n[part[0]])
                a, b = firsts[i], ends[i]
                at[part] = a + np.searchsorted(table["rank"][a:b], r[part], side="right") - 1
            f["window_id"] = table["window"][at] + r - table["rank"][at]
            f["place"] = table["place"][at]
            yield f[["window_id", "place", id_col, "piece", "start", "tokens"]]

    kind = sizes.schema[id_col].dataType.simpleString()
    return ranked.mapInPandas(assign, f"window_id bigint, place int, `{id_col}` {kind}, piece int, start bigint, tokens bigint")
