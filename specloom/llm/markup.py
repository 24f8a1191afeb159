"""Markup residue in texts: which languages a text carries, and its clean form.

A text is parsed into a document tree. Its blocks are headings, rows, fences, environments, HTML elements and the like, its inline elements emphasis, links and commands;
both may hold others. The leaf blocks are the marks: delimiters, tags, commands, references, each of which could be markup or plain text. A linear-chain
conditional random field labels the leaves of a text in order as plain, html, markdown, wiki or latex. Its features are the leaf's form, the
text around it, the line it stands in, and the tags of its ancestors in the tree. It is trained (log-likelihood, stochastic gradient) on labelled pages that
``pages`` composes from constructs of each language and from look-alikes in plain text, ``PAGES`` in number; it is decoded by Viterbi's algorithm.
The clean text is put together from the tree, innermost elements first; elements whose leaves are plain stay as they are.

A null or blank text has no marks. A text of any length and any depth is read whole.
"""

from __future__ import annotations

import html
import itertools
import random
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("plain", "html", "markdown", "wiki", "latex")
PAGES = 4000

# The forms of marks, tried in this order.
_FORMS = {
    "comment": r"<!--[\s\S]*?(?:-->|\Z)",
    "doctype": r"<!\[?[A-Za-z][^>\n]*>?",
    "autolink": r"<(?:https?|mailto|ftp):[^>\s]+>",
    "tag": r"</?[A-Za-z][A-Za-z0-9:]*(?=[\s/>]|\Z)(?:\s+[\w:-]+(?:\s*=\s*(?:\"[^\"]*\"?|'[^']*'?|[^\s\"'<>]+))?)*\s*/?>?",
    "entity": r"&(?:\#\d{1,7}|\#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});",
    "entitycut": r"&(?:\#[xX]?[0-9A-Fa-f]*|[A-Za-z][A-Za-z0-9]{0,7})\Z",
    "texrow": r"\\\\(?=\s|\Z|\[)",
    "share": r"\\\\\w+(?:\\[\w.]+)*",
    "path": r"(?<!\w)[A-Za-z]:\\[\w\\.]*",
    "group": r"\{(?=\\[A-Za-z])",
    "texenv": r"\\(?:begin|end)(?:\{[^}\n]*\}?)?",
    "texmath": r"\\[\[\]()]",
    "texaccent": r"\\['`^\"~=.]\{?\\?[A-Za-z]\}?",
    "texcommand": r"\\[A-Za-z]+\*?",
    "texescape": r"\\[^\w\s]",
    "display": r"\$\$",
    # both ends of a long one are alike, without blanks or, around signs of mathematics, with: a price and the start of a later formula are no pair
    "inline": r"\$[^$\n]{1,160}?\$|\$(?=\S)[^$\n]{161,}+(?<![\s(\[¿¡«])\$(?!\d)|\$(?=\s)(?=[^$\n]*?(?:[\\^{}]|_\w))[^$\n]{161,}+(?<=\s)\$(?!\w)",
    "dollar": r"\$",
    "url": r"(?:https?|ftp)://[^\s\])>\"'|}]+",
    "wikilink": r"\[\[[^\[\]\n]*(?:\]\]?|(?=\n|\Z))",
    "template": r"\{\{\{?|\}\}\}?",
    "wikitable": r"^[ \t]*(?:\{\|[^\n]*|\|\}|\|-+[ \t]*$|\|\+[^\n]*)",
    "macro": r"\{/?(?:code|color|noformat|quote|panel|info|note|warning|tip|expand|anchor|toc|section|column)(?::[^}\n]*)?\}",
    "braces": r"\{[^{}\n\\]*\}",
    "image": r"!\[[^\]\n]*\](?:\([^)\n]*\)?|\[[^\]\n]*\]?)?",
    "definition": r"^[ ]{0,3}\[[^\]\n]+\]:[ \t]+\S+",
    "footnote": r"\[\^[^\]\n]+\]:?",
    "link": r"\[[^\[\]\n]+\]\((?:<[^>\n]*>|[^()\s]*)(?:\s+\"[^\"\n]*\")?\)",
    "reference": r"\[[^\[\]\n]+\]\[[^\[\]\n]*\]",
    "external": r"\[(?:https?|ftp|mailto):\S+(?:[ ][^\]\n]*)?\]",
    "bracket": r"\[[^\[\]\n]*[\])]",
    "fence": r"^[ \t]*(?:>[ \t]*)?(?:`{3,}|~{3,})[^`\n]*$",
    "codespan": r"(?<!`)`[^`\n]+`(?!`)",
    "rule": r"^[ ]{0,3}(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:-[ \t]*){3,}|={3,}[ \t]*)$",
    "switch": r"__[A-Z]{2,}__",
    "star": r"(?<![\w*\\])\*{1,3}(?=[\w¿¡\"«(\[<&\\])[^*\n]++(?<=\S)\*{1,3}(?![\w*])",
    "underline": r"(?<![\w_\\])_{1,3}(?=[^\W_]|[¿¡\"«(])(?:[^_\n]++|(?<=\w)_(?=[^\W_]))+?(?<=[^\s_])_{1,3}(?!\w)",
    "strike": r"(?<!~)~~(?=\S)[^~\n]+~~(?!~)",
    "quotes": r"'{2,5}",
    "redirect": r"^\#(?:REDIRECT|REDIRECCIÓN|REDIRECIONAMENTO)\b",
    "hashes": r"^[ ]{0,3}(?:>[ \t]*)?\#{1,6}[ \t]+(?=\S)",
    "equals": r"^[ \t]*(?P<eq>={1,6})[ \t]*[^=\s][^=\n]*?(?P=eq)[ \t]*$",
    "heading": r"^(?:h[1-6]|bq)\.[ \t]+(?=\S)",
    "bullet": r"^[ \t]*(?:>[ \t]*)?[-*+][ \t]+(?:\[[ xX]\][ \t])?(?=\S)",
    "number": r"^[ \t]*(?:>[ \t]*)?\d{1,3}[.)][ \t]+(?=\S)",
    "quotation": r"^[ \t]*>+[ \t]?(?=\S)",
    "separator": r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$",
    "row": r"^[ \t]*(?:\|{1,2}|!{1,2})(?=[^\n]*[|!])",
    "cell": r"\|{1,2}|!!",
    "pipe": r"(?<=[ ])\|(?=[ ])",
    "ampersand": r"(?<=\s)&=?(?=\s)",
}
#: Where a mark may start: at a special character, or after the blanks of a line's start.
_MAY_START = re.compile(r"^[ \t]*(?=[-+*>#|!:=\dhb_`~\[{])|[<&\\$\[{`*]|\||!!|\}\}|''|(?<!\w)_|~~|!\[|(?<!\w)(?:[A-Za-z]:\\|https?://|ftp://)", re.M)
_AT_LINE = ("separator", "wikitable", "rule", "definition", "fence", "redirect", "hashes", "equals", "heading", "bullet", "number", "quotation", "row")
_BY_FIRST = {
    "<": ("comment", "doctype", "autolink", "tag"),
    "&": ("entity", "entitycut", "ampersand"),
    "\\": ("texrow", "share", "texenv", "texmath", "texaccent", "texcommand", "texescape"),
    "$": ("display", "inline", "dollar"),
    "[": ("wikilink", "footnote", "link", "reference", "external", "bracket"),
    "{": ("template", "group", "macro", "braces"),
    "}": ("template",),
    "`": ("codespan",),
    "*": ("star",),
    "_": ("switch", "underline"),
    "~": ("strike",),
    "'": ("quotes",),
    "!": ("image",),
    "|": ("pipe",),
}
#: A line starts at its very start, or behind a quotation's "> ".
_START = r"(?:^|(?<=\n> )|(?<=\A> ))"
_alternation = lambda kinds: re.compile("|".join(f"(?P<{k}>{_FORMS[k].replace('^', _START, 1) if _FORMS[k].startswith('^') else _FORMS[k]})" for k in kinds), re.M).match
_LINE_MATCH = _alternation(_AT_LINE)
_MATCH = {c: _alternation(kinds) for c, kinds in _BY_FIRST.items()}
_OTHER_MATCH = _alternation(("path", "url"))
_CELL_MATCH = _alternation(("cell",))
#: In a wiki table any line that starts with a bar is a row, also one of a single cell.
_WIKI_ROW_MATCH = re.compile(r"(?P<row>[ \t]*(?:\|{1,2}|!{1,2})(?=[ \t]*\S))").match


_TAIL_HASHES = re.compile(r"[ \t]+\#+[ \t]*\Z")
_OPTION = re.compile(r"\*?[ \t]*(?:\[[^\]\n]*\])?\{").match


def _partners(text: str) -> dict[int, int]:
    """Where the brace opened at each place is closed; escaped braces don't count."""
    out, stack = {}, []
    for m in re.finditer(r"\\[\s\S]|[{}]", text):
        if m[0] == "{":
            stack.append(m.start())
        elif m[0] == "}" and stack:
            out[stack.pop()] = m.start()
    return out


def _content(form: str, text: str, a: int, b: int, limit: int, braces) -> tuple[int, int, int] | None:
    """(start and end of what an element of this form holds, end of the element); None for a form that holds nothing."""
    if form in ("star", "underline", "strike"):
        s = text[a:b]
        n = min(len(s) - len(s.lstrip(s[0])), len(s) - len(s.rstrip(s[0])))
        return a + n, b - n, b
    if form in ("link", "reference"):
        return a + 1, text.index("](" if form == "link" else "][", a), b
    if form == "wikilink":
        end = b - (2 if text.endswith("]]", a + 2, b) else 1 if text.endswith("]", a + 2, b) else 0)
        start = max(text.rfind("|", a, end) + 1, text.rfind("::", a, end) + 2 if text.find("::", a, end) >= 0 else 0, a + 2)
        return start, end, b
    if form == "external":
        k = text.find(" ", a, b)
        return (k + 1, b - 1, b) if 0 <= k < b - 2 else None
    if form == "equals":
        s = text[a:b]
        return a + len(s) - len(s.lstrip(" \t=")), b - (len(s) - len(s.rstrip(" \t="))), b
    if form in ("hashes", "heading", "row"):
        end = text.find("\n", b, limit)
        end = limit if end < 0 else end
        tail = _TAIL_HASHES.search(text, b, end) if form == "hashes" else None
        return b, tail.start() if tail else end, end
    if form == "group":
        end = braces().get(a, -1)
        return (a + 1, end, end + 1) if a < end < limit else None
    if form == "texcommand":
        m = _OPTION(text, b, limit)
        if m is None or text.startswith("\\verb", a):
            return None
        start = m.end()
        end = braces().get(start - 1, -1)
        while a < end < limit and text.startswith("{", end + 1) and start < limit:  # of several arguments the last is the text
            start, end = end + 2, braces().get(end + 1, -1)
        if a < end < limit:
            return start, end, end + 1
        end = text.find("\n", start, limit)  # cut off: up to the end of its line
        end = limit if end < 0 else end
        return start, end, end
    return None


def _scan(text: str) -> Iterator[tuple[int, int, str, int, int, int]]:
    """(start, end, form, start and end of its content, end of the element) of the marks in order, those within an element's content behind its own.

    At one place a line's form goes before the others, these in the order of ``_FORMS``."""
    past, wiki, spans, known = 0, 0, [], []

    def braces() -> dict[int, int]:
        if not known:
            known.append(_partners(text))
        return known[0]

    for c in _MAY_START.finditer(text):
        at = c.start()
        if at < past:
            continue
        while spans and at >= spans[-1][1]:
            spans.pop()
        if spans and at >= spans[-1][0]:  # in the closing mark of an element
            past = spans[-1][1]
            continue
        limit = spans[-1][0] if spans else len(text)
        m = None
        if at == 0 or text[at - 1] == "\n":
            m = _LINE_MATCH(text, at, limit)
            if m is None and wiki:
                m = _WIKI_ROW_MATCH(text, at, limit)
            if m is None and c.end() > at:  # the blanks of a line's start: what stands behind them
                at = c.end() if text[at] in " \t" else at
                if at >= limit:
                    continue
        if m is None and spans and spans[-1][2] and text[at] in spans[-1][2]:
            m = _CELL_MATCH(text, at, limit)
        if m is None:
            m = _MATCH.get(text[at], _OTHER_MATCH)(text, at, limit)
        while m is not None and m.end() > m.start():
            a, b = m.span()
            form = "equals" if m.lastgroup == "eq" else m.lastgroup
            if form == "wikitable":
                mark = m[0].lstrip()
                wiki = wiki + 1 if mark.startswith("{|") else max(0, wiki - 1) if mark.startswith("|}") else wiki
            start, stop, end = _content(form, text, a, b, limit, braces) or (b, b, b)
            yield a, b, form, start, stop, end
            past = start
            if end > start or stop > start:
                spans.append((stop, end, ("|!" if "!" in m[0] else "|") if form == "row" else ""))
                limit = stop
            m = _LINE_MATCH(text, past, limit) if form == "quotation" else None


#: A text without any of this has no marks; in the form of Java's and Python's expressions alike.
MAYBE = r"(?m)[<&\\$\[{`*~|]|''|\}\}|=={1,}|__|(?<![\p{L}\p{N}_])_\S|(?:https?|ftp)://|^[ \t]*(?:[-+>#!_]|\p{Nd}{1,3}[.)][ \t]|h[1-6]\.|bq\.|=)"

_NAMES = frozenset(n.rstrip(";") for n in html.entities.html5)
_VOID = frozenset(["br", "hr", "img", "input", "meta", "link", "wbr", "col"])
_TAG_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:]*)").match
_MATHS = re.compile(r"[\\^{}]|_\w|^[A-Za-z]$").search
_TIGHT = re.compile(r"[|!]{1,2}[^ |!-]").match
_CODEY = frozenset(["pre", "code", "script", "style"])


def _shape(s: str, most: int = 3) -> str:
    """Classes of the characters of a string, runs joined: a letter, 9 digit, _ space, else the character."""
    out = []
    for c in s:
        k = "a" if c.isalpha() else "9" if c.isdigit() else "_" if c.isspace() else c
        if not out or out[-1] != k:
            out.append(k)
            if len(out) == most:
                break
    return "".join(out)


class Leaf(NamedTuple):
    """A leaf block of the tree: a mark that opens an element with content (``start`` to ``stop``, the element's end being ``last``), one of the two marks of an
    element (``other`` is the number of its partner), or one that stands alone."""

    a: int
    b: int
    form: str
    features: tuple[str, ...]
    start: int
    stop: int
    last: int


def marks(text: str) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """(start, end, form, features) of the leaf blocks of a text, in order."""
    return [x[:4] for x in parse(text)[0]]


def parse(text: str) -> tuple[list[Leaf], dict[int, int]]:
    """The tree of a text: its leaf blocks in order, and which leaf closes the element that another opens (both ways). Elements don't overlap; a mark without its partner stands alone."""
    out, stack, line_at = [], [], (0, -1, "", ())
    pairs: dict[int, int] = {}
    opened: list[tuple[str, int]] = []
    spans: list[tuple[int, str, int]] = []  # elements with content that are open: (end, form, what was opened before)

    def open_(name: str) -> None:
        opened.append((name, len(out)))

    def close(name: str) -> bool:
        for k in range(len(opened) - 1, (spans[-1][2] if spans else 0) - 1, -1):
            if opened[k][0] == name:
                pairs[opened[k][1]], pairs[len(out)] = len(out), opened[k][1]
                del opened[k:]
                return True
        return False

    for a, b, kind, start, stop, last in _scan(text):
        while spans and a >= spans[-1][0]:
            del opened[spans.pop()[2] :]
        s = text[a:b]
        before, after = text[a - 1 : a], text[b : b + 1]
        fit = [kind]
        if kind == "tag":
            name = _TAG_NAME(s)[1].lower()
            fit.append("tag:closed" if s.endswith(">") else "tag:cut=" if "=" in s or s.startswith("</") else "tag:cut")
            if s.startswith("</"):
                if name in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(name) :]
                close(name)
            elif name not in _VOID and not s.endswith("/>"):
                stack.append(name)
                open_(name)
        elif kind == "entity" or kind == "entitycut":
            fit.append("entity:named" if s.strip("&;") in _NAMES or s[1:2] == "#" else "entity:odd")
            if kind == "entitycut":
                fit.append("entitycut:" + ("start" if len(s) > 2 and any(n.startswith(s[1:]) for n in ("nbsp", "amp", "lt", "gt", "quot", "ldquo", "rdquo", "laquo", "raquo", "hellip", "aacute", "eacute", "iacute", "oacute", "uacute", "ntilde")) else "other"))
        elif kind in ("inline", "dollar"):
            body = s[1:-1]
            fit.append("money:" + ("edge" if len(body) <= 160 and (body[:1].isspace() or body[-1:].isspace() or not body) else "tight"))
            fit.append("money:" + ("math" if _MATHS(body) else "text"))
            fit.append("money:" + ("9" if before.isdigit() else "-"))
        elif kind in ("row", "cell", "pipe", "separator", "wikitable"):
            if not line_at[0] <= a < line_at[1]:
                c, d = text.rfind("\n", 0, a) + 1, text.find("\n", b)
                line = text[c : d if d >= 0 else len(text)].strip()
                line_at = (c, d if d >= 0 else len(text), f"{'double' if '||' in line or '!!' in line else 'single'}:{'shut' if line.endswith('|') else 'open'}:{'tight' if _TIGHT(line) else 'wide'}", d)
            d = line_at[3]
            fit.append(f"{kind}:{s.strip()[:1]}:{line_at[2]}")
            fit.append("table:" + (stack[-1] if stack and stack[-1].startswith("table") else "none"))
            if kind == "separator":
                stack[:] = [x for x in stack if not x.startswith("table")] + ["table-md"]
            elif kind == "wikitable":
                if s.lstrip().startswith("{|"):
                    stack.append("table-wiki")
                elif "table-wiki" in stack and s.lstrip().startswith("|}"):
                    stack.remove("table-wiki")
            elif kind == "row" and s.strip() == "||":
                stack[:] = [x for x in stack if not x.startswith("table")] + ["table-jira"]
            elif kind == "row":
                nxt = text[d + 1 : text.find("\n", d + 1) if d >= 0 and text.find("\n", d + 1) >= 0 else len(text)] if d >= 0 else ""
                fit.append("below:" + _shape(nxt.strip(), 2))
        elif kind == "fence":
            tag = "fence" + s.strip().lstrip("> ")[:1]
            stack.remove(tag) if tag in stack else stack.append(tag)
            close(tag) or open_(tag)
        elif kind == "texenv":
            name = "tex-" + re.sub(r"^\\(?:begin|end)\{?|\}$", "", s)
            if s.startswith("\\begin"):
                stack.append(name)
                open_(name)
            else:
                close(name)
                if name in stack:
                    stack.remove(name)
        elif kind == "texmath":
            open_(s) if s[1] in "([" else close("\\(" if s[1] == ")" else "\\[")
        elif kind == "template":
            open_("{" * len(s)) if s[0] == "{" else close("{" * len(s))
        elif kind == "display" or kind == "macro" and s.startswith(("{code", "{noformat")):
            tag = "display" if kind == "display" else "macro"
            stack.remove(tag) if tag in stack else stack.append(tag)
            close(tag) or open_(tag)
        elif kind == "macro":
            name = re.match(r"\{/?(\w+)", s)[1]
            close(name) or open_(name)
        elif kind == "rule":
            c = text.rfind("\n", 0, max(a - 1, 0)) + 1
            above = text[c : max(a - 1, 0)].strip() if a else ""
            fit.append(f"rule:{s.strip()[:1]}:{'under' if above and len(above) < 80 else 'alone'}")
        elif kind == "bracket":
            fit.append("bracket:" + _shape(s[1:-1], 2) + s[-1])
        elif kind == "reference":
            fit.append("reference:" + _shape(s[s.index("][") + 2 : -1], 2))
        elif kind == "braces":
            fit.append("braces:" + ("arg" if before and (before.isalpha() or before in "}^_]*") else "free"))
        elif kind == "codespan":
            fit.append("codespan:" + ("quote" if "'" in s else "clean"))
        elif kind in ("star", "underline"):
            lead, tail = len(s) - len(s.lstrip(s[0])), len(s) - len(s.rstrip(s[0]))
            fit.append(f"{kind}:{'even' if lead == tail else 'odd'}:{min(lead, 3)}")
        elif kind == "quotes":
            fit.append(f"quotes:{len(s)}")
        elif kind in ("bullet", "number", "hashes"):
            fit.append(f"{kind}:{s.strip()[:1] if kind == 'bullet' else ''}:{'task' if '[' in s else ''}")
        fit.append("before:" + _shape(before, 1) + "|" + kind)
        fit.append("after:" + _shape(after, 1) + "|" + kind)
        fit.append("in:" + ((stack[-1] if stack[-1].startswith(("table", "fence", "macro", "display", "tex-")) else "code" if stack[-1] in _CODEY else "element") if stack else "root"))
        fit.append("up:" + (spans[-1][1] if spans else "none") + "|" + kind)
        out.append(Leaf(a, b, kind, tuple(fit), start, stop, last))
        if last > start or stop > start:
            spans.append((last, kind, len(opened)))
    return out, pairs


class Crf:
    """A linear-chain conditional random field over binary features."""

    def __init__(self, weights: dict[str, tuple[float, ...]], moves: list[list[float]]):
        self.weights, self.moves = weights, moves
        self._emitted: dict[tuple[str, ...], list[float]] = {}
        self._decoded: dict[tuple, tuple[int, ...]] = {}

    def emit(self, fit: tuple[str, ...]) -> list[float]:
        e = self._emitted.get(fit)
        if e is None:
            rows = [self.weights[f] for f in fit if f in self.weights]
            e = self._emitted[fit] = [sum(c) for c in zip(*rows)] if rows else [0.0] * len(LABELS)
        return e

    def viterbi(self, fits: tuple[tuple[str, ...], ...]) -> tuple[int, ...]:
        """The likeliest labels of a chain of marks."""
        got = self._decoded.get(fits)
        if got is not None:
            return got
        k, moves = range(len(LABELS)), self.moves
        score, back = list(self.emit(fits[0])), []
        for fit in fits[1:]:
            e, step, new = self.emit(fit), [], []
            for j in k:
                best = max(k, key=lambda i: score[i] + moves[i][j])  # noqa: B023
                step.append(best)
                new.append(score[best] + moves[best][j] + e[j])
            back.append(step)
            score = new
        at = max(k, key=score.__getitem__)
        path = [at]
        for step in reversed(back):
            at = step[at]
            path.append(at)
        got = tuple(reversed(path))
        if len(self._decoded) > 200_000:
            self._decoded.clear()
        self._decoded[fits] = got
        return got

    def __getstate__(self):
        return (self.weights, self.moves)

    def __setstate__(self, state):
        self.__init__(*state)


def train(chains: list[tuple[list[tuple[str, ...]], list[int]]], epochs: int = 6, rate: float = 0.4, decay: float = 1e-5, seed: int = 7) -> Crf:
    """Fit by stochastic gradient (AdaGrad) on the log-likelihood of labelled chains."""
    names = {f: i for i, f in enumerate(dict.fromkeys(f for fits, _ in chains for fit in fits for f in fit))}
    n = len(LABELS)
    w, g = np.zeros((len(names), n)), np.full((len(names), n), 1e-6)
    t, tg = np.zeros((n, n)), np.full((n, n), 1e-6)
    data = [([np.array([names[f] for f in fit]) for fit in fits], np.array(labels)) for fits, labels in chains if fits]
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(data)
        for fits, labels in data:
            e = np.array([w[f].sum(0) for f in fits])
            m = len(e)
            alpha, beta = np.zeros((m, n)), np.zeros((m, n))
            alpha[0] = e[0]
            for i in range(1, m):
                x = alpha[i - 1][:, None] + t
                top = x.max(0)
                alpha[i] = top + np.log(np.exp(x - top).sum(0)) + e[i]
            for i in range(m - 2, -1, -1):
                x = t + (e[i + 1] + beta[i + 1])[None]
                top = x.max(1)
                beta[i] = top + np.log(np.exp(x - top[:, None]).sum(1))
            z = alpha[-1].max() + np.log(np.exp(alpha[-1] - alpha[-1].max()).sum())
            p = -np.exp(alpha + beta - z)
            p[np.arange(m), labels] += 1
            for i, f in enumerate(fits):
                if np.abs(p[i]).max() < 1e-3:
                    continue
                d = p[i] - decay * w[f]
                g[f] += d * d
                w[f] += rate * d / np.sqrt(g[f])
            if m > 1:
                d = -np.exp(alpha[:-1, :, None] + t[None] + (e[1:] + beta[1:])[:, None, :] - z).sum(0)
                np.add.at(d, (labels[:-1], labels[1:]), 1)
                tg += d * d
                t += rate * d / np.sqrt(tg)
    return Crf({f: tuple(w[i].tolist()) for f, i in names.items()}, t.tolist())


def labelled(text: str, spans: list[tuple[int, str]]) -> tuple[list[tuple[str, ...]], list[int]]:
    """The chain of a labelled page: features of its marks, and the label of the span that wrote each."""
    starts = np.array([a for a, _ in spans])
    fits, labels = [], []
    for a, b, _, fit in marks(text):
        first = a + len(text[a:b]) - len(text[a:b].lstrip())
        fits.append(fit)
        labels.append(LABELS.index(spans[int(np.searchsorted(starts, first, side="right")) - 1][1]))
    return fits, labels


@lru_cache(maxsize=1)
def model() -> Crf:
    """The model, trained once a process on the first ``PAGES`` pages."""
    from .pages import page

    return train([labelled(*page(k)) for k in range(PAGES)])


def mask(text: str | None, crf: Crf) -> int:
    """Bit k is set if the text carries a mark of language k of ``LABELS``."""
    found = marks(text) if text else []
    out = 0
    for y in set(crf.viterbi(tuple(f for *_, f in found))) if found else ():
        out |= 1 << y
    return out & ~1


# Commands whose argument is a heading, that point somewhere, or that stand for a sign; accents; environments.
_HEADS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
_POINTERS = frozenset(["cite", "ref", "label", "eqref", "pageref", "citep", "citet"])
_SIGNS = {"ldots": "…", "dots": "…", "cdot": "·", "times": "×", "le": "≤", "leq": "≤", "ge": "≥", "geq": "≥", "ne": "≠", "pm": "±", "to": "→", "infty": "∞", "S": "§", "sum": "∑", "prod": "∏", "int": "∫"}
_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307"}
_MATH_ENVS = frozenset(["equation", "align", "eqnarray", "gather", "multline", "math", "displaymath"])
_CODE_ENVS = frozenset(["verbatim", "lstlisting", "minted"])
_VERB = re.compile(r"\\verb\*?([^A-Za-z\s*])(.*?)\1").match
_ENV_ARGUMENTS = re.compile(r"(?:\[[^\]\n]*\]|\{[^{}\n]*\})*").match
_BLOCKS = frozenset(["p", "div", "body", "html", "blockquote", "section", "article", "header", "footer", "main", "dl", "figure"])
_SILENT = frozenset(["style", "script", "head", "title"])
_LINE_ONLY = frozenset(["rule", "separator", "wikitable", "switch", "comment", "doctype", "redirect", "texenv", "fence"])


class _Frame:
    """An element that is being put together: what it is, the leaf that opened it, where it closes, and what it holds so far."""

    __slots__ = ("what", "leaf", "closes", "span", "raw", "held", "number", "nest", "list")

    def __init__(self, what: str, leaf: Leaf | None = None, closes: float = float("inf"), raw: bool = False, above: "_Frame | None" = None):
        self.what, self.leaf, self.closes, self.held, self.number = what, leaf, closes, [], 0
        self.span = leaf is not None and _spans(leaf)
        self.raw = raw or above is not None and above.raw
        self.nest = (above.nest if above else 0) + (what in ("li", "itemize", "enumerate"))
        self.list = self if what in ("ul", "ol", "itemize", "enumerate") else above.list if above else None


def _signs(text: str) -> list[str]:
    """Three characters that the text does not hold: a line that goes, the start of a cell, the line above is a heading."""
    held = set(text)
    return list(itertools.islice((c for c in map(chr, itertools.chain(range(0xFDD0, 0xFDF0), range(0xF0000, 0x10FFFF))) if c not in held), 3))


def _environment(mark: str) -> str:
    return re.sub(r"^\\(?:begin|end)\{?|\*?\}?$", "", mark)


def _fields(x: str) -> str:
    """A template's name and arguments as words: "Name (key: value, value)"; of a conditional its branches."""
    name, *rest = (p.strip() for p in x.split("|"))
    if name.startswith("#"):
        name, rest = "", [name.partition(":")[2].strip(), *rest]
    rest = [": ".join(y.strip() for y in p.split("=", 1)) for p in rest if p.strip("= ")]
    return f"{name} ({', '.join(rest)})" if name and rest else name or ", ".join(rest)


def clean(text: str | None, crf: Crf) -> str | None:
    """The text without its markup. Headings come as ``#`` lines, lists as ``-`` or numbered lines indented by their depth, table cells parted by `` | ``,
    code between back-ticks or fences, formulas between dollar signs. Look-alikes stay as they are. Null gives null.

    The tree is put together in one pass: elements are kept on a stack and become text when they close."""
    if text is None:
        return None
    leaves, pairs = parse(text) if text and not text.isspace() else ([], {})
    if not leaves:
        return _tidy(text, None)
    languages = [LABELS[y] for y in crf.viterbi(tuple(x.features for x in leaves))]
    gone, cell, under = _signs(text)
    frames = [_Frame("text")]
    at = 0

    def push(what: str, i: int, raw: bool = False) -> None:
        x = leaves[i]
        frames.append(_Frame(what, x, x.stop if _spans(x) else leaves[pairs[i]].a, raw, frames[-1]))

    def pop() -> None:
        nonlocal at
        f = frames.pop()
        if f.span:
            f.held.append(text[at : f.leaf.stop])
            at = max(at, f.leaf.last)
        frames[-1].held.append(whole(f, "".join(f.held)))

    def bullet(of: _Frame | None) -> str:
        if of is None or of.what in ("ul", "itemize"):
            return "-"
        of.number += 1
        return f"{of.number}."

    def whole(f: _Frame, x: str) -> str:
        what, leaf = f.what, f.leaf
        if what == "plain":
            return text[leaf.a : leaf.start] + x + text[leaf.stop : leaf.last]
        if re.fullmatch(r"h[1-6]", what):
            return "\n" + "#" * int(what[1]) + " " + " ".join(x.split()) + "\n"
        if what == "li":
            return "\n" + "  " * (f.nest - 1) + bullet(f.list) + " " + x.strip()
        if what in ("td", "th"):
            return cell + " ".join(x.split())
        if what == "tr":
            return "\n" + (" | ".join(x.split(cell)[1:]) if cell in x else x.strip())
        if what in ("code", "tt"):
            return f"`{x}`" if x.strip() else x
        if what in ("pre", "verbatim"):
            return "\n```\n" + x.strip("\n") + "\n```\n"
        if what == "fence":
            return "```" + x + "```"
        if what in ("display", "formula"):
            return "$$" + x + "$$"
        if what == "within":
            return "$" + x + "$"
        if what in _BLOCKS:
            return "\n" + x + "\n"
        if what in ("ul", "ol", "table"):
            return x + "\n"
        if what == "template":
            return _fields(x)
        if what == "parameter":
            return x.partition("|")[2].strip()
        if what == "row":
            parts = [" ".join(p.split()) for p in x.split(cell)]
            while parts and not parts[-1]:
                parts.pop()
            return " | ".join(parts)
        if what == "heading":
            line = "#" * f.number + " " + x.strip() if f.number else x
            if leaf.form != "texcommand":
                return line
            return "\n" * (leaf.a > 0 and text[leaf.a - 1] != "\n") + line + "\n" * (leaf.last < len(text) and text[leaf.last] != "\n")
        if what == "group":
            return x.lstrip(" ")
        if what == "pointer":
            return f"[{x}]"
        if what == "note":
            return f" ({x.strip()})"
        if what in _SILENT:
            return ""
        return x

    def leaf_text(i: int, x: Leaf, language: str) -> tuple[str, int]:
        """What a leaf that stands alone becomes, and where the text goes on."""
        s, form = text[x.a : x.b], x.form
        if form == "tag":
            name = _TAG_NAME(s)[1].lower()
            if name == "li" and not s.startswith("</"):
                return "\n- ", x.b
            return ("\n" if name in ("br", "hr", "tr", "p", "div", "li", "ul", "ol", "table") else ""), x.b
        if form == "entity":
            return html.unescape(s).replace("\xa0", " "), x.b
        if form == "rule":
            return (under + s.strip()[0] if language == "markdown" and s.strip()[:1] in "=-" else gone), x.b
        if form == "image":
            return re.match(r"!\[([^\]]*)", s)[1], x.b
        if form == "definition":
            end = text.find("\n", x.b)
            return ("", x.b - len(s.split()[-1])) if s.lstrip().startswith("[^") else (gone, end if end >= 0 else len(text))
        if form in ("fence", "macro") and ("`" in s or "~" in s or s.lstrip("{/").startswith(("code", "noformat"))):
            return "```", x.b
        if form == "bullet":
            return re.sub(r"[-*+](?=[ \t])", "-", s.replace("\t", "    "), count=1), x.b
        if form in ("number", "codespan", "inline", "display", "url"):
            return s, x.b
        if form == "autolink":
            return s[1:-1], x.b
        if form == "external":
            return s.strip("[]"), x.b
        if form == "pipe":
            return "|", x.b
        if form == "cell":
            return s, x.b
        if form == "wikitable":
            return (s.strip()[2:].strip() if s.lstrip().startswith("|+") else gone), x.b
        if form == "texaccent":
            return unicodedata.normalize("NFC", (re.sub(r"[^A-Za-z]", "", s)[:1] or "") + _ACCENTS.get(s[1], "")), x.b
        if form == "texescape":
            return s[1:], x.b
        if form == "texmath":
            return ("$" if s[1] in "()" else "$$"), x.b
        if form == "ampersand":
            return "|", x.b
        if form == "braces":
            return (s if language == "latex" and text[x.a - 1 : x.a] in ("_", "^") else "" if language == "wiki" else s.strip("{}")), x.b
        if form == "bracket" or form == "dollar":
            return s, x.b
        if form == "texcommand":
            name, m = s.strip("\\*"), _VERB(text, x.a)
            if name == "verb" and m:
                return f"`{m[2]}`", m.end()
            if name == "item":
                return "  " * max(0, frames[-1].nest - 1) + bullet(frames[-1].list), x.b
            try:
                return unicodedata.lookup(f"GREEK {'SMALL' if name.islower() else 'CAPITAL'} LETTER {name.upper()}"), x.b
            except KeyError:
                return _SIGNS.get(name, gone if name == "hline" else ""), x.b
        return (gone if form in _LINE_ONLY else ""), x.b

    for i, x in enumerate(leaves):
        while x.a > frames[-1].closes or frames[-1].span and x.a == frames[-1].closes:
            pop()
        if x.a < at:
            continue
        frames[-1].held.append(text[at : x.a])
        at, s, language, form = x.b, text[x.a : x.b], languages[i], x.form
        partner = pairs.get(i)
        if partner is not None and partner < i and frames[-1].leaf is leaves[partner]:  # closes an element
            pop()
            continue
        if frames[-1].raw:  # code and formulas are kept; in HTML with their entities read
            if frames[-1].what in ("pre", "code", "tt") and form in ("entity", "tag") and language == "html":
                s = html.unescape(s).replace("\xa0", " ") if form == "entity" else ""
            frames[-1].held.append(s)
            if _spans(x):
                at = x.b
            continue
        if form == "cell" and frames[-1].what == "row":
            frames[-1].held.append(cell)
            continue
        if language == "plain":
            if _spans(x):
                push("plain", i)
                at = x.start
            else:
                frames[-1].held.append(s)
            continue
        if partner is not None and partner > i:  # opens an element
            if form == "tag":
                name = _TAG_NAME(s)[1].lower()
                push(name, i, name in ("pre", "script", "style"))
            elif form == "texenv":
                name = _environment(s)
                at = _ENV_ARGUMENTS(text, x.b).end()
                push("formula" if name in _MATH_ENVS else "verbatim" if name in _CODE_ENVS else name, i, name in _MATH_ENVS or name in _CODE_ENVS)
            elif form == "display":
                push("display", i, True)
            elif form == "texmath":
                push("within" if s[1] == "(" else "formula", i, True)
            elif form == "template":
                push("template" if len(s) == 2 else "parameter", i)
            elif form == "fence":
                push("fence", i, True)
                frames[-1].held.append(s.strip().lstrip("> ").lstrip("`~").strip())
            elif form == "macro":
                code = s.startswith(("{code", "{noformat"))
                push("fence" if code else "macro", i, code)
            continue
        if _spans(x):
            at = x.start
            if form == "wikilink" and re.match(r"\[\[\s*categor", s, re.I):
                at = x.last
                frames[-1].held.append(gone)
            elif form == "link" and x.start == x.stop:
                at = x.last
                frames[-1].held.append(re.sub(r"^\[\]\(<?|>?(?:\s+\"[^\"\n]*\")?\)$", "", text[x.a : x.last]))
            elif form == "equals" or form == "hashes" or form == "heading":
                push("heading", i)
                lead = s.strip()
                frames[-1].number = lead.count("#") if form == "hashes" else len(lead) - len(lead.lstrip("=")) if form == "equals" else int(lead[1]) if lead[0] == "h" else 0
            elif form == "texcommand":
                name = s.strip("\\*")
                push("heading" if name in _HEADS else "pointer" if name in _POINTERS else "note" if name == "footnote" else form, i)
                frames[-1].number = _HEADS.get(name, 0)
                if name == "frac":
                    frames[-1].held.append(text[x.b + 1 : x.start - 2] + "/")
            else:
                push(form, i)
            continue
        new, at = leaf_text(i, x, language)
        frames[-1].held.append(new)
    while len(frames) > 1:
        if not frames[-1].span:
            frames[-1].held.append(text[at : int(min(frames[-1].closes, len(text)))] if at < frames[-1].closes else "")
            at = max(at, int(frames[-1].closes))
        pop()
    frames[0].held.append(text[at:])
    return _tidy("".join(frames[0].held).replace(cell, " | "), (gone, under))


def _spans(x: Leaf | None) -> bool:
    return x is not None and (x.last > x.start or x.stop > x.start)


def _tidy(text: str, signs: tuple[str, str] | None) -> str:
    """Lines without blanks at their ends, no more than one empty line in a row; lines that were markup only go, a line above a rule becomes a heading."""
    out: list[str] = []
    for line in text.split("\n"):
        if signs:
            gone, under = signs
            bare = line.strip(" \t")
            if bare and not bare.strip(gone + " \t"):
                continue
            if bare.startswith(under):
                if out and out[-1].strip() and not out[-1].startswith(("#", "- ", "|")):
                    out[-1] = ("# " if bare[1:2] == "=" else "## ") + out[-1].strip()
                continue
            line = line.replace(gone, "").replace(under, "")
        out.append(re.sub(r"[ \t]+$", "", line))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n")


def carried(chunks: DataFrame, text_cols: tuple[str, ...] = ("raw_text", "context_text"), key: str = "id", at: str = "generated_at") -> DataFrame:
    """(key, markup): a row per current record and language that any of its texts carries.

    Rows are labelled where they lie; only (key, time, mask) is shuffled to find the current row of each key. Texts without any character that
    markup needs don't leave the JVM. Equal times: the greater mask. A null key is no record."""
    crf = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = np.zeros(batch.num_rows, np.int32)
            for c in range(2, batch.num_columns):
                for i, t in enumerate(batch.column(c).to_pylist()):
                    if t:
                        masks[i] |= mask(t, crf)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks)], names=[key, at, "mask"])

    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema}
    maybe = [F.when(F.col(c).rlike(MAYBE), F.col(c)).alias(c) for c in text_cols]
    rows = chunks.filter(F.col(key).isNotNull()).select(key, at, *maybe).mapInArrow(run, f"`{key}` {kinds[key]}, `{at}` {kinds[at]}, mask int")
    now = rows.groupBy(key).agg(F.max(F.struct(at, "mask")).alias("m"))
    bit = [F.when(F.col("m.mask").bitwiseAND(1 << k) != 0, F.lit(name)) for k, name in enumerate(LABELS) if k]
    return now.filter("m.mask <> 0").select(key, F.explode(F.filter(F.array(*bit), lambda x: x.isNotNull())).alias("markup"))


def cleaned(chunks: DataFrame, text_cols: tuple[str, ...] = ("raw_text", "context_text"), key: str = "id", at: str = "generated_at") -> DataFrame:
    """(key, text columns): the clean texts of the current records."""
    crf = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [pa.array([clean(t, crf) for t in batch.column(c).to_pylist()], pa.string()) for c in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[key, *text_cols])

    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema}
    now = chunks.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(at, *text_cols)).alias("m")).select(key, *(F.col(f"m.{c}").alias(c) for c in text_cols))
    return now.mapInArrow(run, f"`{key}` {kinds[key]}, " + ", ".join(f"`{c}` string" for c in text_cols))
