"""Texts that lost their end, found by word trigrams that are frequent inside texts but almost never end one. All of it is SQL.

Every line of every text is cut into tokens: words, numbers, signs; names in humps, codes, numbers and addresses stand for their class. For each trigram the whole
corpus says how often something follows on the same line, how often a sentence mark does, how often the line ends, and how often it ends in an ellipsis.

A text's final trigram (a, b, c) is judged together with the trigrams (a, b, x) of which c begins the word x: a text that stops within a word stops inside all of these.
If the trigram was seen at least ``SEEN`` times elsewhere, it decides: the text is cut off if at most ``SHARE`` of these were ends. A trigram that is too rare to tell
gives way to its last two tokens, and these to the last alone (``WORD_SEEN``, ``WORD_SHARE``), judged in the same way. Only where these show no cut, two more signs count: the mark
of a cut that a text carries (a sign of continuation, a broken character, half an entity; the trigram is the one before it), and an open block (code fence, front matter). ``how`` says
which sign it was.

An ellipsis is a mark too, unless at least half of what follows the trigram elsewhere (of those seen ``FEW`` times) are ellipses at a line's end: then it is style. Texts with fewer than four words,
blank and null texts are never judged. Where a text has no sentence mark at all, the missing one at its end is no evidence. A text does not count as evidence for its own end; copies
of a text count as one. Repeated rows of an id give one row. Headings end no text: a line's end there counts as inside.

The corpus is tokenized once. What is shuffled are distinct trigrams with their counts, combined before the shuffle; pairs and finals that very many rows share are salted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

SEEN = 30
SHARE = 0.05
WORD_SEEN = 100
WORD_SHARE = 0.005
FEW = 5
STYLE = 0.5
SALTS = 16

# Signs that say a text goes on elsewhere, and those that may also be style.
HARD_MARK = r"(?:\[(?:\.{3}|…|\+|sigue|continúa|continua|cont\.?|more|truncated|cortado)\]|\((?:sigue|continúa|continua|cont\.|truncated|more)\)|\x{FFFD}+|&\#?[A-Za-z0-9]{0,31})$"
SOFT_MARK = r"\s*(?:\.{3}|…)$"

# White space other than the line feed (the carriage return goes altogether), as code points.
_BLANKS = [0x09, 0x0B, 0x0C, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]

#: Tokens of a line whose digits are all 0: addresses, numbers, words with their hyphens, runs of one sign.
_TOKEN = r"https?://\S+|0++(?:[.,/:]0++)*+(?![\p{L}\p{M}\p{N}_])|[\p{L}\p{M}\p{N}_]++(?:-0++)*+-?|([^\s\p{L}\p{M}\p{N}_])\1*+"
#: The class of a token x, in capitals, or its lower case.
_CLASS = r"""case when contains(x, '0') then case when translate(x, '0.,/:', '') = '' then '0' when startswith(x, 'http') then 'URL' else 'CC' end
  when x = lower(x) then if(startswith(x, 'http') and contains(x, '://'), 'URL', x) when substr(x, 2) <> lower(substr(x, 2)) then 'NN' else lower(x) end"""

_WORDS = r"{text} rlike r'^[^\p{L}\p{N}]*+(?:[\p{L}\p{N}]++[^\p{L}\p{N}]++){3}[\p{L}\p{N}]'"
_EVEN = r"'{blanks}123456789\r', '{spaces}000000000'"

# A closed block of code is a matter of several lines; lines are exploded as if there might be none, or the optimizer would compute them again.
_GRAMS = r"""
with t as (select rtrim(' \n', translate({text}, {even})) as body from {docs} where {words}),
l as (select split(if(contains(body, '```') or contains(body, '~~~'), regexp_replace(body, r'(?ms)^(```|~~~).*?^\1', '```'), body), '\n') as lines from t),
x as (select line from l lateral view outer explode(lines) y as line),
w as (select startswith(line, '#') as head, transform(regexp_extract_all(line, r'{token}', 0), x -> {class}) as w from x where line is not null and line <> ''),
g as (
  select xxhash64(if(i > 1, w[i - 2], '^'), if(i > 0, w[i - 1], '^')) as ab, xxhash64(if(i > 0, w[i - 1], '^')) as b, c,
    case when i = size(w) - 1 then if(head, 0, 2) when w[i + 1] in ('.', '?', '!') then 1 when i = size(w) - 2 and w[i + 1] in ('...', '…') then 3 else 0 end as nxt
  from w lateral view outer posexplode(w) y as i, c where c is not null)
select ab, b, c, count(*) as n, count_if(nxt = 1) as stops, count_if(nxt = 2) as ends, count_if(nxt = 3) as softs from g group by ab, b, c
"""

_FINALS = r"""
with t as (select {id} as id, {text} as text, rtrim('{blanks} \r\n', {text}) as body from {docs} where {words}),
m as (select id, text, body, regexp_extract(substring_index(body, '\n', -1), r'{hard}', 0) as hard from t),
n as (select id, text, hard <> '' as marked, if(hard = '', body, rtrim('{blanks} \r\n', left(body, length(body) - length(hard)))) as body from m),
o as (select id, text, marked, body, regexp_extract(substring_index(body, '\n', -1), r'{soft}', 0) as soft from n),
b as (select id, text, marked, soft <> '' as soft, if(soft = '', body, rtrim('{blanks} \r\n', left(body, length(body) - length(soft)))) as body from o),
f as (
  select id, xxhash64(text) as h, marked, soft, body rlike r'[.?!](?:[\s{blanks}]|$)' as pointed,
    (contains(body, '```') or contains(body, '~~~')) and size(split(body, r'(?m)^(?:```|~~~)')) % 2 = 0 or body rlike r'^---\r?\n' and locate('\n---', body, 4) = 0 as inside,
    slice(concat(array('^', '^'), regexp_extract_all(translate(substring_index(body, '\n', -1), {even}), r'{token}', 0)), -3, 3) as r from b),
k as (select *, transform(r, x -> {class}) as w from f)
select id, h, marked, soft, pointed, inside, xxhash64(w[0], w[1]) as ab, xxhash64(w[1]) as b, if(r[2] <> lower(r[2]), array_distinct(array(w[2], lower(r[2]), 'NN', 'CC')), array(w[2])) as cs from k
"""

#: What is counted by: the two tokens before the last, the one before, none. All of them with the last token.
_LEVELS = "array(struct(3 as level, ab as pair), struct(2 as level, b as pair), struct(1 as level, 0L as pair))"
# What a final may stand for: its own word or its beginning; with a capital also a name or a code. The counts of these are added up.
_VERDICT = r"""
with u as (
  select ab, b, cs, count_if(not marked) - count(distinct if(marked, null, h)) + 1 as less, count_if(soft and not marked) - count(distinct if(soft and not marked, h, null)) + 1 as soft_less, count_if(not marked) > 0 as own, count_if(soft and not marked) > 0 as own_soft
  from {finals} group by ab, b, cs),
y as (select *, explode(cs) as c from (select ab, b, cs, inline({levels}) from u)),
need as (select level, pair, array_distinct(collect_list(length(c))) as sizes from (select distinct level, pair, c from y) group by level, pair),
p as (select level, pair, sizes, salt from need lateral view explode(sequence(0, {salts} - 1)) z as salt),
g as (select level, pair, c, sum(n) as n, sum(stops) as stops, sum(ends) as ends, sum(softs) as softs from (select inline({levels}), c, n, stops, ends, softs from {grams}) group by level, pair, c),
x as (
  select g.level, g.pair, g.c, n, stops, ends, softs, explode(filter(sizes, s -> s <= length(g.c))) as s
  from (select *, pmod(xxhash64(c), {salts}) as salt from g) g join p on p.level = g.level and p.pair = g.pair and p.salt = g.salt),
e as (select level, pair, left(c, s) as c, sum(n) as n, sum(if(s = length(c), stops, 0)) as stops, sum(if(s = length(c), ends, 0)) as ends, sum(if(s = length(c), softs, 0)) as softs from x group by 1, 2, 3),
a as (
  select y.ab, y.b, y.cs, y.level, sum(n) as n, sum(stops) as stops, sum(ends) as ends, sum(softs) as softs
  from y join e on e.level = y.level and e.pair = y.pair and e.c = y.c group by y.ab, y.b, y.cs, y.level),
o as (
  select a.ab, a.b, a.cs, a.level, n - if(own, less, 0) as n, stops, greatest(ends + softs - if(own, less, 0), 0) as ends, greatest(softs - if(own_soft, soft_less, 0), 0) as softs
  from a join u on u.ab = a.ab and u.b = a.b and u.cs = a.cs),
v as (
  select u.ab, u.b, u.cs, max(if(o.n >= least, struct(o.level, o.ends <= share * o.n as bare, o.ends + o.stops <= share * o.n as open), null)) as r, max(if(o.n >= {few}, struct(o.level, o.softs >= {style} * o.n as styled), null)) as s
  from u left join (select *, if(level = 1, {word_seen}, {seen}) as least, if(level = 1, {word_share}, {share}) as share from o) o on o.ab = u.ab and o.b = u.b and o.cs = u.cs group by u.ab, u.b, u.cs),
r as (select ab, b, cs, r.level as level, coalesce(r.bare, false) as bare, coalesce(r.open, false) as open, coalesce(s.styled, false) as styled, explode(sequence(0, {salts} - 1)) as salt from v),
w as (
  select f.id, case when if(f.pointed, r.bare, r.open) then element_at(array('word', 'bigram', 'trigram'), r.level) when f.marked or f.soft and not r.styled then 'mark' when f.inside then 'block' end as how
  from (select *, pmod(xxhash64(id), {salts}) as salt from {finals}) f join r on r.ab = f.ab and r.b = f.b and r.cs = f.cs and r.salt = f.salt)
select id, max(how) as how from w where how is not null group by id
"""


def cut_off(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, how): the documents whose text lost its end; ``how`` says what shows it: 'trigram', 'bigram', 'word', 'mark' or 'block'."""
    spark = docs.sparkSession
    values = {
        "words": _WORDS, "even": _EVEN, "id": f"`{id_col}`", "text": f"`{text_col}`", "hard": HARD_MARK, "soft": SOFT_MARK, "token": _TOKEN, "class": _CLASS, "blanks": "".join(map(chr, _BLANKS)), "spaces": " " * len(_BLANKS),
        "seen": str(SEEN), "share": str(SHARE), "word_seen": str(WORD_SEEN), "word_share": str(WORD_SHARE), "few": str(FEW), "style": str(STYLE), "levels": _LEVELS, "salts": str(SALTS),
    }

    def run(query: str, **tables: DataFrame) -> DataFrame:
        for name, value in values.items():
            query = query.replace("{" + name + "}", value)
        query = query.replace("{", "{{").replace("}", "}}")
        for name in tables:
            query = query.replace("{{" + name + "}}", "{" + name + "}")
        return spark.sql(query, **tables)

    rows = docs.select(id_col, text_col)
    finals = cut(run(_FINALS, docs=rows))
    grams = run(_GRAMS, docs=rows)
    return run(_VERDICT, finals=finals, grams=grams).withColumnRenamed("id", id_col)


def shares(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(source, texts, cut, share): per source, its spelling evened out (blanks, case), how many texts and how many are cut off."""
    source = F.lower(F.trim(F.regexp_replace(source_col, r"(?U)\s+", " ")))
    rows = docs.filter(F.col("text").isNotNull()).select(id_col, source.alias("source")).join(found.select(id_col, F.lit(1).alias("hit")), id_col, "left")
    return rows.groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.coalesce("hit", F.lit(0))).alias("cut")).withColumn("share", F.col("cut") / F.col("texts"))
