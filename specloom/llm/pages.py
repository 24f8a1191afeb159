"""Labelled pages for the markup model: composed text whose every span carries the language it was written in.

A page mixes plain sentences, look-alikes (plain text that merely resembles markup) and constructs of one to three markup languages."""

from __future__ import annotations

import random

_WORDS = (
    "la el los una casa puerta campo libro nota mesa árbol río monte canción viento lluvia hoja norte sur este oeste cambia abre cierra mira guarda lleva cada cuando entre sobre hasta "
    "the a house door field book note table tree river hill song wind rain leaf north south turns opens closes looks keeps takes every when between over until "
    "o os uma porta livro mesa árvore rio monte canção vento chuva folha muda abre fecha vê leva cada quando entre sobre até"
).split()
_IDS = ("alpha_one", "file_ref", "row_key", "seen_at", "big_total", "col_name")
_TAGS = ("b", "i", "em", "strong", "span", "code", "p", "li", "td", "div", "h1", "h2", "h3", "sub", "sup", "u", "font", "small", "th", "tt", "mark", "SPAN", "P", "LI", "DIV")
_ENTITIES = ("&nbsp;", "&amp;", "&lt;", "&gt;", "&hellip;", "&ldquo;", "&rdquo;", "&laquo;", "&raquo;", "&oacute;", "&ntilde;", "&eacute;", "&#233;", "&#8220;", "&#xE1;", "&#x201D;", "&quot;", "&mdash;", "&copy;")
_COMMANDS = ("alpha", "beta", "cdot", "ldots", "sqrt{x}", "frac{a}{b}", "sum_{i=1}^{n} x_{i}", "textbf{w}", "emph{w}", "cite{k2001}", "ref{sec:k}", "S", "footnote{w w}", "underline{w}", "item w", "section{W w}", "subsection{W}", "paragraph{W}", "verb|k|", "label{eq:k}", "le 3", "int_0^1 f", "texttt{k}", "url{k}", "noindent", "hline", "textbf{w \\emph{w}}", "footnote{w \\cite{k2001}}")


class _Pen:
    def __init__(self, rng: random.Random):
        self.r, self.spans = rng, []

    def put(self, text: str, label: str = "plain") -> None:
        self.spans.append((text, label))

    def words(self, low: int = 1, high: int = 3) -> str:
        return " ".join(self.r.choice(_IDS) if self.r.random() < 0.08 else self.r.choice(_WORDS) for _ in range(self.r.randint(low, high)))

    def title(self) -> str:
        return self.words(1, 3).capitalize()

    def slug(self) -> str:
        return "".join(self.r.choice("abcdefghjkmnpqrstuvwxyz23456789") for _ in range(5))

    def number(self) -> str:
        return str(self.r.randint(0, 200))


def _look_alike(p: _Pen) -> str:
    r, n, m = p.r, p.number(), p.number()
    x, y = p.words(1, 1), p.words(1, 1)
    return r.choice([
        f"{x} * {y} * {n}", f"{n} <= k <= {m}", f"[{p.words(2, 4)}]", f"{n}$ o {m}$", f"${n} y ${m}", f"${n} and ${m}", f"# {n} {x}", f"#{n}", f"{n} ~ {m}", f"~{n} {x}", f"{x} == {y}",
        f"a < b {x} c > d", f"[{n}] y [{m}]", f"[{n}]", f"[0, {n})", f"({n}, {m}]", "$HOME y $LOTE", "$PATH and $USER", f"C:\\{x.capitalize()}\\{y}", f"\\\\host{n}\\{x}\\{y}", "f(x) -> y", "x -> y", "(*)",
        f"(x<{n} && y>{m})", "row_key y otro_campo_mas", f"{n} %", f"{{{x}, {y}}}", f"`{x}' {y}", f"{n}**{m}", "_id y row_key_v2", "C# y F#", "I&D", "R&D", f"https://sitio.example/a_b_c?x={n}&y={m}",
        f"k != {n}", f"{n} + {m} = k", "a/b", f"{n}:{m}", f"x|y {x}", f"-{n} {x}", f"<{n}", f"> {n}", f"{x} & {y}", f"@{x}", "'a' y 'b'", f"{x}_{y}", f"¿{x}?", "a^b", "n/a", "*", f"{n}*", f"(~{n})",
    ])


def _sentence(p: _Pen, weave=None) -> None:
    p.put(p.words(2, 7).capitalize() + " ")
    if weave:
        weave()
        p.put(" " + p.words(1, 5))
    p.put(p.r.choice([".", ".", ".", " (véase QX-123).", "?", ", 3.14."]))


# Inline constructs, one language each.
def _html_inline(p: _Pen) -> None:
    r, w = p.r, p.words()
    t = r.choice(_TAGS)
    k = r.randint(0, 9)
    if k == 0:
        p.put(r.choice(_ENTITIES), "html")
        p.put(w)
        p.put(r.choice(_ENTITIES), "html")
    elif k == 1:
        p.put(f"<{t}>", "html")
        p.put(w)
        p.put(f"</{t}>", "html")
    elif k == 2:
        p.put(f'<a href="https://sitio.example/{p.slug()}">', "html")
        p.put(w)
        p.put("</a>", "html")
    elif k == 3:
        p.put(f'<span style="color:#{p.slug()[:3]}"\n data-k="{p.slug()}">', "html")
        p.put(w)
        p.put("</span>", "html")
    elif k == 4:
        p.put(r.choice(["<br>", "<br/>", "<BR />", "<hr>", f'<img src="{p.slug()}.png" alt="{w}" />', f'<img src="{p.slug()}.png" alt="{w}">', "<o:p></o:p>", "<wbr>"]), "html")
    elif k == 5:
        p.put(f"<!-- {w} -->", "html")
    elif k == 6:
        p.put(r.choice(_ENTITIES).join(w.split() + [p.words(1, 1)]), "html")
    elif k == 7:
        p.put(f"&lt;{t}&gt;{w}&lt;/{t}&gt;", "html")
    elif k == 8:
        p.put(r.choice([f"<{t} class='k{p.number()}'>", f"</{t}>", f"</{t}", f"<{t}>", f'<{t} class="k']), "html")
        p.put(" " + w)
    else:
        p.put(f"{w}<{t}>{p.number()}</{t}>", "html")


def _markdown_inline(p: _Pen) -> None:
    r, w, n = p.r, p.words(), p.r.randint(1, 9)
    p.put(r.choice([
        f"**{w}**", f"__{w}__", f"*{w}*", f"_{w}_", f"***{w}***", f"~~{w}~~", f"`{w}`", f"[{w}](../{p.slug()}/{p.slug()}.md)", f"[{w}](<{p.slug()}/hoja {p.slug()}.md>)", f"[{w}](https://sitio.example/{p.slug()})",
        f"![{w}](img/{p.slug()}.png)", f"[{w}][{n}]", f"[{w}][]", f"[^{n}]", f"<https://sitio.example/{p.slug()}>", f"[{w}](#{p.slug()})", f"``{w}``", f"**{w} [{p.words()}](../{p.slug()}.md)**", f"*{w} `{p.words()}`*", f"[**{w}**](../{p.slug()}.md)",
    ]), "markdown")


def _wiki_inline(p: _Pen) -> None:
    r, w = p.r, p.words()
    k = r.randint(0, 8)
    if k == 0:
        q = r.choice(["''", "'''", "'''''"])
        p.put(q, "wiki")
        p.put(w)
        p.put(q, "wiki")
    elif k == 1:
        c = r.choice(["red", "#336699", "blue"])
        p.put("{color:" + c + "}", "wiki")
        p.put(w)
        p.put("{color}", "wiki")
    elif k == 2:
        p.put(f"{{{{{r.choice(['Ficha', 'Nota', 'Caja'])}|id={p.slug()}|tipo={w}}}}}", "wiki")
    elif k == 3:
        p.put(f"[https://sitio.example/{p.slug()} {w}]", "wiki")
    else:
        p.put(r.choice([f"'''{w} [[{p.title()}]]'''", f"[[{p.title()}|''{w}'']]", f"[[{w}]]", f"[[{p.title()}|{w}]]", f"[[{p.words(1, 1)}::{w}]]", f"[[Categoría:{p.title()}]]", f"[[Archivo:{p.slug()}.png|thumb|{w}]]", f"[[{w}", "{{{" + p.words(1, 1) + "|}}}", "{noformat}", "{quote}"]), "wiki")


def _latex_inline(p: _Pen) -> None:
    r, w = p.r, p.words()
    c = r.choice(_COMMANDS).replace("w", w).replace("W", p.title()).replace("k", p.slug())
    k = r.randint(0, 7)
    if k <= 1:
        p.put("\\" + c, "latex")
    elif k == 2:
        p.put(f"$\\{r.choice(_COMMANDS[:7])}$", "latex")
    elif k == 3:
        p.put(r.choice(["$n$", "$x^2 + y^2$", "$k_{1} - k_{0}$", "$n \\le 3$", "$a+b$", "$x$", "$t_0$"]), "latex")
    elif k == 4:
        p.put(f"\\(\\{r.choice(_COMMANDS[:7])}\\)", "latex")
    elif k == 5:
        p.put("{\\" + r.choice(["sc", "bf", "it", "small", "em"]) + f" {w}}}", "latex")
    elif k == 6:
        p.put(f"{p.words(1, 1)}\\{r.choice(['%', '&', '_', '#', '$', '*', '{'])} ", "latex")
    else:
        p.put(f"{p.words(1, 1)}\\{r.choice([chr(39), '`', '^', '~'])}{{{r.choice('aeioun')}}}{p.words(1, 1)}", "latex")


_INLINE = {"html": _html_inline, "markdown": _markdown_inline, "wiki": _wiki_inline, "latex": _latex_inline}


def _code(p: _Pen) -> str:
    a, b = p.r.choice(_IDS), p.r.choice(_IDS)
    return p.r.choice([f"if {a} > {p.number()}:", f"emit({a}, {b})", f"    {a} = {b} + 1", f"assert {a} != {b}", f"select {a} where {b} = 0", f"{a}: {p.slug().upper()}", f"for k in {a}:"])


# Block constructs. ``say`` writes cell and item text, at times with inline marks of some language.
def _block(p: _Pen, lang: str, say) -> None:
    r, n = p.r, p.r.randint(2, 4)

    def line(lead: str = "", tail: str = "\n", ids: bool = False) -> None:
        p.put(lead, lang)
        p.put(r.choice(_IDS)) if ids else say()
        p.put(tail, lang)

    if lang == "markdown":
        k = r.choice([*range(13), 11, 11, 1])
        if k == 0:
            line("#" * r.randint(1, 4) + " ", r.choice(["\n", "\n", " ##\n"]))
        elif k == 1:
            t = p.title()
            p.put(t + "\n" + r.choice("=-") * max(3, len(t)) + "\n", lang)
        elif k == 2:
            f = r.choice(["```", "~~~"])
            p.put(f + r.choice(["", "yaml", "sql"]) + "\n" + "\n".join(_code(p) for _ in range(n)) + "\n" + f + "\n", lang)
        elif k == 3:
            b = r.choice("-*+")
            for _ in range(n):
                line(b + " ")
        elif k == 4:
            for _ in range(n):
                line(f"- [{r.choice(' x')}] ")
        elif k == 5:
            for i in range(n):
                line(f"{i + 1}. ")
        elif k == 6:
            line("- ")
            line("  - ")
            line("    1. ")
        elif k in (7, 8):
            p.put(r.choice(["| campo | valor |\n|---|---|\n", "| campo | valor | n |\n|---|---|---|\n", "| a | b |\n|---|:--|\n"]), lang)
            for _ in range(n):
                line("| ", " | ", ids=True)
                line("", " |\n")
        elif k == 9:
            p.put("campo | valor\n--- | ---\n", lang)
            for _ in range(n):
                line("", " | ", ids=True)
                line("")
        elif k == 10:
            for _ in range(r.randint(1, 2)):
                line("> ")
        elif k == 11:
            p.put(r.choice(["***", "___", "---", "* * *", "- - -"]) + "\n", lang)
        else:
            p.put(r.choice([f"[{r.randint(1, 9)}]: https://sitio.example/{p.slug()}", f"[{p.words()}]: ../{p.slug()}.md"]) + "\n", lang) if r.random() < 0.6 else line(f"[^{r.randint(1, 9)}]: ")
    elif lang == "wiki":
        k = r.choice([*range(10), 2, 2])
        if k in (0, 1):
            e = "=" * r.randint(2, 4)
            line(e + " ", " " + e + "\n")
        elif k == 2:
            line(f"h{r.randint(1, 5)}. ")
        elif k in (3, 4):
            p.put(r.choice(['{| class="t"\n', "{|\n", '{| class="wikitable sortable"\n|+ nota\n']) + "! campo !! valor\n", lang)
            for _ in range(n):
                line("|-\n| ", " || ", ids=True)
                line("")
            p.put("|}\n", lang)
        elif k == 5:
            p.put("||campo||valor||\n", lang)
            for _ in range(n):
                line("|", "|", ids=True)
                line("", "|\n")
        elif k == 6:
            q = r.choice(["code", "code:sql", "noformat", "code:java"])
            p.put("{" + q + "}\n" + "\n".join(_code(p) for _ in range(n)) + "\n{" + q.split(":")[0] + "}\n", lang)
        elif k == 7:
            p.put(r.choice(["__TOC__", "__NOTOC__", "__FORCETOC__", "#REDIRECT [[X]]", "#REDIRECT [[Una Casa]]"]) + "\n", lang)
        elif k == 8:
            p.put("{{#if: {{{" + p.words(1, 1) + "|}}} | {{{" + p.words(1, 1) + "}}} | sin nada }}\n", lang)
        else:
            p.put(f"[[Categoría:{p.title()}]]\n" if r.random() < 0.5 else "bq. " + p.words() + "\n", lang)
    elif lang == "latex":
        k = r.randint(0, 5)
        if k == 0:
            e = r.choice(["itemize", "enumerate"])
            p.put(f"\\begin{{{e}}}\n", lang)
            for _ in range(n):
                line("\\item ")
            p.put(f"\\end{{{e}}}\n", lang)
        elif k == 1:
            p.put("\\begin{tabular}{ll}\n", lang)
            for _ in range(n):
                line("", " & ")
                line("", " \\\\\n")
            p.put("\\end{tabular}\n", lang)
        elif k == 2:
            p.put("\\begin{verbatim}\n" + "\n".join(_code(p) for _ in range(n)) + "\n\\end{verbatim}\n", lang)
        elif k == 3:
            e = r.choice(["align*", "equation", "align", "eqnarray"])
            p.put(f"\\begin{{{e}}}\n  \\{r.choice(_COMMANDS[:7])} &= c\n  a &= b + 1 \\\\\n\\end{{{e}}}\n", lang)
        elif k == 4:
            a, b = r.choice([("$$", "$$"), ("\\[", "\\]")])
            p.put(f"{a}{r.choice([' ', chr(10)])}{r.choice(['x^2 + y^2', chr(92) + _COMMANDS[r.randint(0, 6)], 'k_{1} - k_{0}'])}{r.choice([' ', chr(10)])}{b}\n", lang)
        else:
            line("\\" + r.choice(["section", "subsection", "paragraph", "chapter"]) + "{", "}\n")
    else:
        k = r.randint(0, 6)
        if k == 0:
            p.put("<ul>", lang)
            for _ in range(n):
                line("<li>", "</li>")
            p.put("</ul>\n", lang)
        elif k == 1:
            p.put("<table>\n<tr><th>campo</th><th>valor</th></tr>\n", lang)
            for _ in range(n):
                line("<tr><td>", "</td>", ids=True)
                line("<td>", "</td></tr>\n")
            p.put("</table>\n", lang)
        elif k == 2:
            p.put("<pre><code>" + "\n".join(_code(p) for _ in range(n)).replace(">", "&gt;").replace("<", "&lt;") + "</code></pre>\n", lang)
        elif k == 3:
            line("<!DOCTYPE html><html><body>", "</body></html>\n")
        elif k == 4:
            p.put("<style>.nota{margin:2px}</style>\n" if r.random() < 0.5 else "<script>f(1)</script>\n", lang)
        elif k == 5:
            h = r.randint(1, 4)
            line(f"<h{h} class='s{n}'>", f"</h{h}>\n")
        else:
            line("<div><p>", "</p></div>\n")


def _finish(p: _Pen) -> tuple[str, list[tuple[int, str]]]:
    text, at = "", []
    for s, label in p.spans:
        if s:
            at.append((len(text), label))
            text += s
    return text, at


def page(seed: int) -> tuple[str, list[tuple[int, str]]]:
    """(text, [(start of a span, its language)])."""
    rng = random.Random(seed)
    p = _Pen(rng)
    langs = rng.sample(sorted(_INLINE), rng.choice([0, 1, 1, 1, 2, 3]))

    def say() -> None:
        p.put(p.words())
        if langs and rng.random() < 0.12:
            p.put(" ")
            _INLINE[rng.choice(langs)](p)
            p.put(" " + p.words(1, 1))
        elif rng.random() < 0.04:
            p.put(" " + _look_alike(p))

    for _ in range(rng.randint(1, 5)):
        if langs and rng.random() < 0.5:
            lang = rng.choice(langs)
            if rng.random() < 0.08:
                p.put("> ", "markdown")
            _block(p, lang, say)
        else:
            for _ in range(rng.randint(1, 3)):
                x = rng.random()
                if langs and x < 0.35:
                    _sentence(p, lambda: _INLINE[rng.choice(langs)](p))
                elif x < 0.65:
                    _sentence(p, lambda: p.put(_look_alike(p)))
                else:
                    _sentence(p)
                p.put(" ")
            p.put("\n")
        p.put("\n" if rng.random() < 0.8 else "")
    if rng.random() < 0.06:  # ends amid something
        p.put(p.words() + " ")
        if "html" in langs:
            p.put(rng.choice(_ENTITIES)[: rng.choice([3, 4, 5])].rstrip(";"), "html")
        else:
            p.put(rng.choice(["I&D", "R&D", f"{p.words(1, 1)} &", "A&B", f"{p.number()} <", "$", "x_", "[", "(*"]))
    text, at = _finish(p)
    if langs and rng.random() < 0.12:
        text = text[: max(1, int(len(text) * rng.uniform(0.3, 1)))]
    return text, [x for x in at if x[0] < len(text)]
