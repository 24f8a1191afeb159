"""Splitting oversized texts at natural boundaries, with a given overlap.

A text is cut into tokens (words, runs of white space, else grapheme clusters); prefix sums of their lengths give every token's offset in code
points. The offsets at which a text may be cut are kept as sorted arrays by quality: paragraph, line, sentence, word, token. A piece ends at the last
boundary under the limit, found by binary search, of the best quality that still fills half of the piece; where there is none, at the hard limit.
The next piece starts exactly ``overlap`` code points before the cut.

A null, empty or fitting text is one piece (none, if null); a limit that is null or less than 1 leaves a text whole; an overlap that is null or negative counts
as 0, one of half the limit or more is taken back to just under half, so that each piece brings new text. Redelivered rows of a chunk give its pieces once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}_]+|[ \t]+|\X")
_LEVELS = [regex.compile(p) for p in (r"\n[ \t]*(?:\n[ \t]*)+", r"\n", r"(?:[.!?…][\"'»”)\]]*[ \t]+|[。！？])", r"[ \t\p{Zs}]+")]


def boundaries(text: str) -> list[np.ndarray]:
    """Sorted cut offsets, best quality first; the last array holds the offsets of all tokens."""
    ends = np.cumsum(np.fromiter((len(t) for t in _TOKEN.findall(text)), np.int64))
    return [*(np.fromiter((m.end() for m in p.finditer(text)), np.int64) for p in _LEVELS), ends]


def spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text, in code points."""
    if limit is None or limit < 1 or len(text) <= limit:
        return [(0, len(text))]
    overlap = min(max(overlap or 0, 0), (limit - 1) // 2)
    levels, out, start = boundaries(text), [], 0
    while len(text) - start > limit:
        end = start + limit
        least = max(start + limit // 2, start + overlap)
        for cuts in levels:
            i = np.searchsorted(cuts, end, side="right") - 1
            if i >= 0 and cuts[i] > least:
                end = int(cuts[i])
                break
        out.append((start, end))
        start = end - overlap
    return [*out, (start, len(text))]


def oversized(chunks: DataFrame, models: DataFrame) -> DataFrame:
    """Current chunks that are longer than their encoder accepts, with their text and limits.

    One scan and one shuffle, in which only texts over the limit take part. ``models`` holds the encoders, a row each."""
    m = models.groupBy("model").agg(F.max(F.struct("max_chars", "overlap_chars")).alias("m")).select("model", "m.*")
    over = F.length("raw_text") > F.col("max_chars")
    rows = chunks.select("id", "generated_at", "section_path", "chunk_index", "raw_text", "model").join(m, "model", "left")
    body = F.struct("generated_at", F.when(over, F.col("raw_text")).alias("text"), "section_path", "chunk_index", "max_chars", "overlap_chars")
    return rows.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max(body).alias("b")).filter("b.text is not null").select("id", "b.*").drop("generated_at")


def split(rows: DataFrame) -> DataFrame:
    """(id, section_path, chunk_index, piece, start, text): pieces numbered from 0, ``start`` in code points."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, text, path, index, limit, overlap in zip(f["id"], f["text"], f["section_path"], f["chunk_index"], f["max_chars"], f["overlap_chars"]):
                for k, (a, b) in enumerate(spans(text, int(limit), 0 if pd.isna(overlap) else int(overlap))):
                    out.append((i, path, None if pd.isna(index) else int(index), k, a, text[a:b]))
            yield pd.DataFrame(out, columns=["id", "section_path", "chunk_index", "piece", "start", "text"]).astype({"chunk_index": "Int32"})

    return rows.mapInPandas(run, "id string, section_path string, chunk_index int, piece int, start bigint, text string")
