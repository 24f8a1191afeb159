"""Text functions on columns: wiki links, headings, anchors, sentences, tables, lists."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dims import LINK_PREFIXES

LINK = r"\[\[([^\]]+)\]\]"
#: White space in the wide sense: all separators and the byte order mark.
BLANK = r"[\t\n\x0B\f\r\p{Z}\x{FEFF}]"
LINKS_TYPE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("raw", "target", "domain", "alias")]))
SECTIONS_TYPE = T.ArrayType(T.StructType([T.StructField("heading", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("path", T.StringType())]))


def strip(text: Column) -> Column:
    """Without white space, in the wide sense, at either end."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def wiki_links(text: Column) -> Column:
    """Array of (raw, target, domain, alias) of the links ``[[domain::target|alias]]`` of a text, in order; blank ones are left out. Null for null."""
    raws = F.filter(F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)), lambda x: strip(x)), lambda x: x != "")

    def part(raw: Column) -> Column:
        scoped = raw.contains("::")
        rest = F.when(scoped, F.element_at(F.split(raw, "::"), 2)).otherwise(raw)
        names = F.split(rest, r"\|")
        return F.struct(
            raw.alias("raw"),
            strip(F.element_at(names, 1)).alias("target"),
            F.when(scoped, strip(F.element_at(F.split(raw, "::"), 1))).alias("domain"),
            F.when(F.size(names) > 1, strip(F.element_at(names, 2))).alias("alias"),
        )

    return F.transform(raws, part)


def node_of_link(target: Column) -> Column:
    """The node id a link's target means."""
    out = F.when(target.startswith(LINK_PREFIXES[0][0]), F.concat(F.lit(LINK_PREFIXES[0][1] + ":"), target))
    for start, prefix in LINK_PREFIXES[1:]:
        out = out.when(target.startswith(start), F.concat(F.lit(prefix + ":"), target))
    return out.when(target.isNotNull(), F.concat(F.lit("Entity:"), target))


def is_entity_target(target: Column) -> Column:
    out = F.lit(True)
    for start, _ in LINK_PREFIXES:
        out = out & ~target.startswith(start)
    return out


def sentences(text: Column) -> Column:
    """Sentences: cut at white space behind a full stop, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, rf"(?<=\.){BLANK}+"), lambda s: strip(s)), lambda s: s != "")


def list_items(text: Column) -> Column:
    """Trimmed items of the lines that start with "- " or "* "."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: strip(x)), lambda x: x.startswith("- ") | x.startswith("* "))
    return F.transform(lines, lambda x: strip(F.substr(x, F.lit(3))))


def snippet(kind: Column, title: Column, node_id: Column) -> Column:
    return F.concat(F.lit("["), kind, F.lit("] "), F.when(title != "", title).otherwise(node_id))


def excerpt(text: Column, most: int = 200) -> Column:
    """The text without heading, emphasis and link marks, in one line, cut at a sentence or a word in its second half if longer than ``most``."""
    plain = F.trim(text)
    for pattern, to in ((r"(?m)^#+\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"\s+", " ")):
        plain = F.regexp_replace(plain, pattern, to)
    plain = F.trim(plain)
    cut = F.substring(plain, 1, most)
    last = lambda mark: F.length(cut) - F.length(F.substring_index(cut, mark, -1)) - len(mark)  # noqa: E731  (offset of the last mark)
    stop, blank = last(". "), last(" ")
    short = F.when(cut.contains(". ") & (stop > most / 2), F.substr(cut, F.lit(1), stop + 1)).when(cut.contains(" ") & (blank > most / 2), F.concat(F.substr(cut, F.lit(1), blank), F.lit("..."))).otherwise(F.concat(cut, F.lit("...")))
    return F.when(F.length(plain) <= most, plain).otherwise(short)


def anchor_of(heading: str) -> str:
    text = unicodedata.normalize("NFKD", heading).lower()
    text = re.sub(r"[^\w\s-]", "", text, flags=re.ASCII)
    return re.sub(r"\s+", "-", text).strip("-")


@F.pandas_udf(T.StringType())
def anchor(heading: pd.Series) -> pd.Series:
    """A heading's anchor: decomposed, lower case, only ASCII word characters, white space as "-". Null for null."""
    known = {h: anchor_of(h) for h in heading.dropna().unique()}
    return heading.map(known)


def sections_of(body: str) -> list[dict]:
    """Sections in order. A line that starts with "#" opens one; its path joins the anchors of the open headings above it and its own."""
    out, trail, start = [], [], None
    lines = body.split("\n")

    def close(end: int) -> None:
        if trail:
            level, heading, _ = trail[-1]
            out.append({"heading": heading, "level": level, "content": "\n".join(lines[start:end]).strip(), "path": ".".join(a for *_, a in trail)})

    for i, line in enumerate(lines):
        if not line.startswith("#"):
            continue
        close(i)
        title = line.lstrip("#")
        level = len(line) - len(title)
        title = title.lstrip()
        while trail and trail[-1][0] >= level:
            trail.pop()
        trail.append((level, title, anchor_of(title)))
        start = i + 1
    close(len(lines))
    return out


@F.pandas_udf(SECTIONS_TYPE)
def sections(body: pd.Series) -> pd.Series:
    """Array of (heading, level, content, path). Text before the first heading is dropped. Null for null."""
    return body.map(lambda b: None if b is None else sections_of(b))


def table_rows(text: str | None) -> list[dict[str, str]]:
    """Rows of the pipe table in a text by its header's names; the line under the header is skipped, rows that are too short are left out."""
    cells = lambda line: [c.strip() for c in re.sub(r"^\||\|$", "", line).split("|")]
    lines = [x.strip() for x in (text or "").strip().split("\n") if x.strip().startswith("|")]
    if len(lines) < 2:
        return []
    names = [h.replace("`", "") for h in cells(lines[0])]
    return [dict(zip(names, row)) for row in map(cells, lines[2:]) if len(row) >= len(names)]


def register(spark: SparkSession) -> None:
    """Make the functions callable from SQL: heading_anchor, markdown_sections, cosine_similarity."""
    spark.udf.register("heading_anchor", anchor)
    spark.udf.register("markdown_sections", sections)
    spark.sql(
        "create or replace temporary function cosine_similarity(a array<float>, b array<float>) returns double return "
        "try_divide(aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0d, (s, v) -> s + v), "
        "sqrt(aggregate(a, 0d, (s, v) -> s + double(v) * double(v))) * sqrt(aggregate(b, 0d, (s, v) -> s + double(v) * double(v))))"
    )
