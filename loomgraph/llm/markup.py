"""Markup residue: detection of HTML, Markdown, wiki and LaTeX markup, and conversion to structured clean text."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of HTML (and the reference tags of wiki markup).
HTML_TAGS = (
    "a abbr address article aside audio b big blockquote body br button canvas caption center cite code col colgroup "
    "dd del details dfn div dl dt em embed fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head "
    "header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript nowiki object ol "
    "optgroup option p param picture pre q ref references s samp script section select small source span strike "
    "strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr"
).split()
# Commands of LaTeX that occur in running text and formulas.
TEX_COMMANDS = (
    "alpha approx author autoref begin beta bf bibliography big bigl bigr bullet cap caption cdot cdots chapter chi "
    "circ cite citep citet cup date delta displaystyle documentclass ell em emph emptyset end epsilon eq eqref equiv "
    "eta exists exp footnote footnotesize forall frac gamma geq hat hline href hspace iff in include includegraphics "
    "infty input int it item kappa label lambda langle large ldots left leq lim ln log maketitle mathbb mathbf "
    "mathcal mathrm max min mu nabla neq newcommand newline newpage noindent nolimits nu omega overline pageref "
    "paragraph part partial phi pi pm prod propto psi qquad quad rangle ref renewcommand rho right rightarrow sc "
    "section setminus sigma sim small sqrt sub subparagraph subsection subset subseteq subsubsection sum sup "
    "tableofcontents tau text textbf textit textsc textsf texttt textwidth theta times tilde title to top underline "
    "url usepackage varepsilon varphi vec verb vspace widehat xi zeta"
).split()

_TAG = r"</?(?:" + "|".join(sorted(HTML_TAGS, key=len, reverse=True)) + r")(?:\s+[\w:-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>]+)|\s+(?:checked|disabled|selected|hidden|controls|async|defer|nowrap))*\s*/?>"
# an element that opens with an attribute but is never closed, as cut texts leave it
_CUT_TAG = r"<(?:" + "|".join(sorted(HTML_TAGS, key=len, reverse=True)) + r")\s+[\w:-]+\s*=\s*[\"'][^<>\n]*(?=\s*(?:\n|$|<))"
_TEX = "|".join(sorted(TEX_COMMANDS, key=len, reverse=True))

#: Rules by name. Each looks for a construct, not for single characters, so that prices, arithmetic, code-like words,
#: citations in brackets, generics, arrows and paths are left alone.
RULES = {
    "html_tag": re.compile(_TAG, re.I),
    "html_cut": re.compile(_CUT_TAG, re.I),
    "html_comment": re.compile(r"<!--|-->(?=\s|$)|<!doctype\b|<!\[CDATA\[|<\?xml\b", re.I),
    "reference": re.compile(r"&(?:#\d{2,7}|#x[0-9a-f]{2,6}|[A-Za-z][A-Za-z0-9]{1,31});", re.I),
    "md_heading": re.compile(r"(?m)^ {0,3}#{1,6}[ \t]+\S"),
    "md_setext": re.compile(r"(?m)^[^\S\n]{0,3}\S[^\n]*\n[ ]{0,3}(?:={3,}|-{3,})[ \t]*$"),
    "md_rule": re.compile(r"(?m)^ {0,3}(?:(?:\*[ ]*){3,}|(?:_[ ]*){3,}|(?:-[ ]*){3,})[ \t]*$"),
    "md_fence": re.compile(r"(?m)^[ \t]{0,3}(?:```|~~~)"),
    "md_code": re.compile(r"(?<![`\w\\])`(?!`)[^`\n]+`(?![`\w'])|``[^`\n']+``"),
    "md_strong": re.compile(r"(?<![\w*])\*\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*\*(?![\w*])|(?<!\w)__(?=[^\s_])(?:(?!__)[^\n])+(?<=[^\s_])__(?!\w)"),
    "md_em": re.compile(r"(?<![\w*\\/])\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?![\w*])|(?<![\w_\\/])_(?=[^\s_])[^_\n]+(?<=[^\s_])_(?![\w_])"),
    "md_strike": re.compile(r"~~(?=\S)[^~\n]+(?<=\S)~~"),
    "md_link": re.compile(r"!?(?<![\w\]])\[[^\[\]\n]*\]\((?:<[^>\n]*>|[^()\s]+(?:\([^()\s]*\))?)(?:\s+[\"'(][^\n\"')]*[\"')])?\)|!\[[^\[\]\n]*\]\([^()\n]*\)"),
    "md_autolink": re.compile(r"<(?:https?|ftp|mailto):[^<>\s]+>|<[\w.+-]+@[\w-]+\.[\w.]+>", re.I),
    "md_refdef": re.compile(r"(?m)^ {0,3}\[[^\[\]\n]+\]:[ \t]*\S"),
    "md_footnote": re.compile(r"\[\^[\w-]+\]"),
    "md_reflink": re.compile(r"(?<!\w)\[[^\[\]\n]+\]\[[^\[\]\n]*\](?!\w)"),
    "md_task": re.compile(r"(?m)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+\[[ xX]\][ \t]+\S"),
    "md_bullet": re.compile(r"(?m)^[ \t]*[-*+][ \t]+\S[^\n]*\n[ \t]*[-*+][ \t]+\S|(?m:^)[ \t]*[-+*][ \t]+\S"),
    "md_quote": re.compile(r"(?m)^ {0,3}>+[ \t]?(?=[^\W\d]|[\"“«¿¡(*_`>])"),
    "md_table": re.compile(r"(?m)^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[^|\n]+\|[^\n]*\|[ \t]*$"),
    "md_escape": re.compile(r"(?<![\\\w:])\\[*_`#\[\]{}!](?!\\)"),
    "wiki_bold": re.compile(r"'''(?=\S)(?:(?!''')[^\n])+'''|(?<!')''(?=[^\s'])[^'\n]+(?<=\S)''(?!')"),
    "wiki_link": re.compile(r"\[\[[^\[\]\n]+\]\]"),
    "wiki_template": re.compile(r"\{\{\s*[#\w][^{}]*\}\}|^\{\{\s*\w[^\n]*$|\{\{\{\w+\|?[^{}]*\}\}\}", re.M),
    "wiki_table": re.compile(r"(?m)^[ \t]*(?:\{\||\|\}|\|-|\|\+)|^[ \t]*[|!][^\n]*(?:\|\||!!)"),
    "wiki_heading": re.compile(r"(?m)^(={2,6})[ \t]*[^=\s][^\n]*?\1[ \t]*$"),
    "wiki_extlink": re.compile(r"\[(?:https?|ftp)://[^\s\]]+(?:\s[^\]\n]*)?\]", re.I),
    "wiki_list": re.compile(r"(?m)^[*#:;]{2,}[ \t]*\S"),
    "wiki_magic": re.compile(r"__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION)__|(?m:^)#REDIRECT\b"),
    "tex_command": re.compile(r"\\(?:" + _TEX + r")(?:\*?\s*[\[{]|(?![A-Za-z\\]))"),
    "tex_group": re.compile(r"\{\\[a-zA-Z]+[ {]"),
    "tex_math": re.compile(r"\$\$|\\\[|\\\]|\\\(|\\\)|(?<![\w$\\])\$(?=[^\s$\d])[^$\n]+(?<=[^\s$\\])\$(?![\w$])|(?<![\w$\\])\$\d[^$\n\\^_={}]*[\\^_={}][^$\n]*(?<=[^\s$\\])\$(?![\w$])"),
    "tex_escape": re.compile(r"(?<=[\w\s])\\[%&#$](?![\\\w])|\\\\(?:\[[^\]]*\])?[ \t]*$", re.M),
    "tex_quote": re.compile(r"``(?=[^\s`])[^`'\n]+''"),
    "tex_comment": re.compile(r"(?m)^[ \t]*%{1,3}[ \t]*[^\W\d][^\n]*$"),
    "tex_tie": re.compile(r"(?<=[\w.])~(?=\\|\[|\()"),
}


def _known_reference(m: re.Match) -> bool:
    body = m.group()[1:]
    return body[0] == "#" or body in html5


def _code_like(kind: str, m: re.Match, text: str) -> bool:
    """Constructs that only look like markup: operators, paths, indexes, generic types."""
    s = m.group()
    if kind == "reference":
        return not _known_reference(m)
    if kind == "md_em" and s[0] == "_":
        return not re.search(r"[^\W\d_]{2}", s)
    if kind == "tex_command":
        before = text[max(0, m.start() - 3) : m.start()]
        return bool(re.search(r"[A-Za-z]:$|[\w]$", before)) and not s.rstrip().endswith(("{", "["))
    if kind in ("tex_escape", "md_escape"):
        line = text[text.rfind("\n", 0, m.start()) + 1 : m.end() + 1]
        return bool(re.search(r"[A-Za-z]:\\", line))
    return False


# What a text must hold for a rule to apply at all.
_NEEDS = {
    "html_tag": ("<",), "html_cut": ("<",), "html_comment": ("<", "-->"), "reference": ("&",), "md_heading": ("#",), "md_setext": ("===", "---"), "md_rule": ("*", "_", "-"), "md_fence": ("```", "~~~"), "md_code": ("`",), "md_strong": ("**", "__"),
    "md_em": ("*", "_"), "md_strike": ("~~",), "md_link": ("](",), "md_autolink": ("<",), "md_refdef": ("]:",), "md_footnote": ("[^",), "md_reflink": ("][",), "md_task": ("[",), "md_bullet": ("-", "*", "+"), "md_quote": (">",), "md_table": ("|",), "md_escape": ("\\",),
    "wiki_bold": ("'{}'",), "wiki_link": ("[[",), "wiki_template": ("{{",), "wiki_table": ("|", "!!"), "wiki_heading": ("==",), "wiki_extlink": ("[",), "wiki_list": ("*", "#", ":", ";"), "wiki_magic": ("__", "#"),
    "tex_command": ("\\",), "tex_group": ("{\\",), "tex_math": ("$", "\\"), "tex_escape": ("\\",), "tex_quote": ("``",), "tex_comment": ("%",), "tex_tie": ("~",),
}
_NEEDS["wiki_bold"] = ("'" * 2,)
#: Constructs that hold for their whole line.
_LINES = {"md_heading", "md_setext", "md_bullet", "md_task", "md_quote", "md_table", "md_refdef", "wiki_heading", "wiki_list", "wiki_table", "tex_comment"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "col", "param", "source", "embed"}
_BLOCK = {"p", "div", "li", "tr", "table", "ul", "ol", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "br", "hr", "dd", "dt", "body", "html"}
_DROP = {"script", "style", "template", "noscript", "head"}
#: Elements of a line: their text is judged with the block around them. Links are not, for menus consist of them.
_INLINE = {"abbr", "b", "bdi", "big", "br", "cite", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Structure that clean text keeps whatever its ratios are.
_KEPT = {"h1", "h2", "h3", "h4", "h5", "h6", "pre", "code", "math", "li", "td", "th", "dt", "dd", "blockquote", "caption", "figcaption"}
_TAG_AT = re.compile(_TAG, re.I)
_PAIRED = re.compile(r"\\(begin|end)\{([^{}\n]*)\}|(\$\$)|\\([\[\]()])|^[ \t]{0,3}(```|~~~)", re.M)


def _constructs(t: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of every construct in a text with plain line ends; elements and delimiters span what they enclose."""
    out: list[tuple[int, int, str]] = []
    open_tags: dict[str, list[int]] = {}
    if "<" in t:
        for m in _TAG_AT.finditer(t):
            s = m.group()
            tag = re.match(r"</?(\w+)", s).group(1).lower()
            if s[1] == "/":
                if open_tags.get(tag):
                    out.append((open_tags[tag].pop(), m.end(), tag))
                else:
                    out.append((m.start(), m.end(), tag))
            elif tag in _VOID or s.endswith("/>"):
                out.append((m.start(), m.end(), tag))
            else:
                if tag in ("li", "p", "td", "th", "tr", "dt", "dd", "option") and open_tags.get(tag):
                    out.append((open_tags[tag].pop(), m.start(), tag))  # an implied end
                open_tags.setdefault(tag, []).append(m.start())
        out += [(at, len(t), tag) for tag, starts in open_tags.items() for at in starts]
    waiting: dict[str, list[int]] = {}
    if "\\" in t or "$$" in t or "```" in t or "~~~" in t:
        for m in _PAIRED.finditer(t):
            word, env, dollar, delim, fence = m.groups()
            name = env if word else "math" if dollar or delim else "fence"
            key, closes = name, word == "end" or (delim in ("]", ")")) or bool((dollar or fence) and waiting.get(dollar or fence))
            key = f"env {env}" if word else dollar or fence or {"]": "[", ")": "("}.get(delim, delim)
            if closes and waiting.get(key):
                out.append((waiting[key].pop(), m.end(), name))
            elif closes:
                out.append((m.start(), m.end(), name))
            else:
                waiting.setdefault(key, []).append(m.start())
        out += [(at, len(t), "fence") for k in ("```", "~~~") for at in waiting.get(k, ())]
        out += [(at, at + 2, "math") for k in ("$$", "[", "(") for at in waiting.get(k, ())] + [(at, at + 6, "env") for k, v in waiting.items() if k.startswith("env ") for at in v]
    for k, r in RULES.items():
        if k in ("html_tag", "md_fence") or not any(x in t for x in _NEEDS[k]):
            continue
        for m in r.finditer(t):
            if _code_like(k, m, t) or (k == "tex_math" and m.group() in ("$$", "\\[", "\\]", "\\(", "\\)")):
                continue
            end = m.end()
            if k in _LINES:
                nl = t.find("\n", end)
                end = len(t) if nl < 0 else nl
            elif k == "tex_command" and t[end - 1 : end] == "{":
                close = t.find("}", end)
                end = end if close < 0 else close + 1
            out.append((m.start(), end, k))
    return sorted(out, key=lambda x: (x[0], -x[1]))


class Tree:
    """Root-to-leaf tag paths of one text: HTML elements, Markdown, wiki and LaTeX constructs alike.

    ``paths``: (parent, name) of each path, the first is the root, the plain text itself. ``leaves``: (path, start, end) in
    order; they cover the text. A construct that outlasts the one around it ends with that one. Paths are numbers, so
    no depth is too deep.
    """

    def __init__(self, t: str) -> None:
        self.text = t
        self.paths: list[tuple[int, str]] = [(-1, "")]
        self.leaves: list[tuple[int, int, int]] = []
        ids: dict[tuple[int, str], int] = {}
        stack, at = [(0, len(t))], 0

        def leaf(upto: int) -> None:
            nonlocal at
            if upto > at:
                self.leaves.append((stack[-1][0], at, upto))
                at = upto

        for start, end, name in _constructs(t):
            while stack[-1][1] <= start and len(stack) > 1:
                leaf(stack[-1][1])
                stack.pop()
            leaf(start)
            key = (stack[-1][0], name)
            if key not in ids:
                ids[key] = len(self.paths)
                self.paths.append(key)
            stack.append((ids[key], min(end, stack[-1][1])))
        while stack:
            leaf(stack[-1][1])
            stack.pop()

    def kinds(self) -> list[str]:
        """Names of the constructs on the paths, sorted."""
        return sorted({name for _, name in self.paths[1:]})


def tag_tree(text: str | None) -> Tree:
    """The paths of a text; null and blank texts have only the root."""
    return Tree(text.replace("\r\n", "\n").replace("\r", "\n") if text and not text.isspace() else "")


def markup_kinds(text: str | None) -> list[str]:
    """Names of the constructs on a text's tag paths, sorted; a text that is only its root holds no markup."""
    return tag_tree(text).kinds()


def _bare(s: str) -> str:
    return _TAG_AT.sub("", s) if "<" in s else s


def content_paths(tree: Tree) -> set[int]:
    """The paths that carry content: text length and punctuation per path, smoothed, fused, cut.

    Elements of a line count as part of the block around them, other constructs are blocks of their own. For every path:
    length ratio = text length / leaves, punctuation ratio = punctuation / leaves. Along the text both are smoothed
    with a Gaussian of radius 1 and fused by their product, of which the logarithm is taken; a path is content if the mean of its
    leaves reaches half the mean over all leaves, weighed by their text. Headings, list items, table cells, quotes, code and formulas are structure and
    always kept, but for links in them; script, style and head are never content. Holds for texts of every size.
    """
    block: list[int] = []
    dropped, kept, link = [], [], []
    for parent, name in tree.paths:
        i = len(block)
        up = parent >= 0
        inline = up and (name in _INLINE or name not in HTML_TAGS)
        block.append(block[parent] if inline else i)
        dropped.append(name in _DROP or (up and dropped[parent]))
        link.append(name == "a" or (up and link[parent]))
        kept.append((name in _KEPT or (up and kept[parent])) and not link[-1])
    seq = []
    for p, a, b in tree.leaves:
        s = _bare(tree.text[a:b]).strip()
        if s and not dropped[p]:
            seq.append((block[p], s))
    stat: dict[int, list[float]] = {}
    for p, s in seq:
        x = stat.setdefault(p, [0.0, 0.0, 0.0])
        x[0] += len(s)
        x[1] += sum(s.count(c) for c in ".,;:!?¿¡。、")
        x[2] += 1
    out = {i for i in range(len(block)) if not dropped[i]}
    if len(stat) < 2:
        return out
    ratio = np.array([(stat[p][0] / stat[p][2], stat[p][1] / stat[p][2]) for p, _ in seq])
    pad = np.pad(ratio, ((1, 1), (0, 0)), mode="edge")
    smooth = 0.25 * pad[:-2] + 0.5 * pad[1:-1] + 0.25 * pad[2:]
    fused = np.log1p(smooth[:, 0] * (1 + smooth[:, 1]))
    where = np.array([p for p, _ in seq])
    mean = np.bincount(where, fused, len(block)) / np.maximum(np.bincount(where, minlength=len(block)), 1)
    low = mean < 0.5 * np.average(fused, weights=[len(s) for _, s in seq])
    return {i for i in out if not low[block[i]] or (kept[i] and not link[i]) or block[i] == 0}


def content_text(tree: Tree) -> tuple[str, int]:
    """(text without the leaves off the content paths, number of these leaves); their tags stay for the structure."""
    keep = content_paths(tree)
    if len(keep) == len(tree.paths):
        return tree.text, 0
    parts, n = [], 0
    for p, a, b in tree.leaves:
        s = tree.text[a:b]
        if p not in keep and _bare(s).strip():
            n += 1
            s = "".join(_TAG_AT.findall(s)) if "<" in s else ""
        parts.append(s)
    return "".join(parts), n


# ---------------------------------------------------------------------------------------------- HTML to lines


class _Leaves(HTMLParser):
    """(innermost tag, whether inside script, style or head, text) of a page; block elements open and close with a line end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.open: Counter = Counter()
        self.leaves: list[tuple[str, bool, str]] = []

    def _leaf(self, s: str, tag: str | None = None) -> None:
        self.leaves.append((tag if tag is not None else self.stack[-1] if self.stack else "", any(self.open[d] for d in _DROP), s))

    def _pop(self) -> str:
        tag = self.stack.pop()
        self.open[tag] -= 1
        return tag

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("li", "td", "th", "tr", "p", "option"):  # implied ends
            while self.open[tag] and self.stack[-1] not in ("ul", "ol", "table", "tr", "tbody", "div", "body"):
                self._pop()
        if tag in _BLOCK:
            self._leaf("\n", tag)
        if tag == "img":
            alt = dict(attrs).get("alt")
            if alt:
                self._leaf(alt, "img")
        if tag not in _VOID:
            self.stack.append(tag)
            self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag]:
            while self._pop() != tag:
                pass
        if tag in _BLOCK:
            self._leaf("\n", "")

    def handle_data(self, data: str) -> None:
        self._leaf(data)


_HTML_ANY = re.compile(_TAG + "|" + _CUT_TAG + "|<!--", re.I)


def _from_html(t: str) -> str:
    """HTML elements to plain lines with Markdown-like leads for headings, items, quotes and code."""
    if not _HTML_ANY.search(t):
        return t
    t = re.sub(r"(?s)<!--.*?(?:-->|$)", "", t)
    t = re.sub(_CUT_TAG, lambda m: " ".join(re.findall(r"\balt\s*=\s*[\"']([^\"'<>]*)", m.group())), t, flags=re.I)
    t = re.sub(r"(?is)<ref\b[^>]*?/>|<ref\b[^>]*>((?:(?!<ref\b).)*?)</ref>", lambda m: f" ({m.group(1)})" if m.group(1) else "", t)
    # only real elements may reach the parser; other "<" are text
    parts, at = [], 0
    for m in re.finditer(_TAG, t, re.I):
        parts += [t[at : m.start()].replace("&", "&amp;").replace("<", "&lt;"), m.group()]
        at = m.end()
    parts.append(t[at:].replace("&", "&amp;").replace("<", "&lt;"))
    p = _Leaves()
    p.feed("".join(parts))
    p.close()
    out: list[str] = []
    for tag, hidden, x in p.leaves:
        if hidden:
            continue
        if x != "\n":
            out.append(f"| {x}" if tag in ("td", "th") and x.strip() else x)
        elif tag in ("li", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"):
            out.append("\n" + ({"li": "- ", "blockquote": "> ", "pre": "```\n"}.get(tag) or "#" * int(tag[1]) + " "))
        else:
            out.append("\n")
    return "".join(out)


# ---------------------------------------------------------------------------------------------- blocks

BLOCK = T.StructType([T.StructField("kind", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())])
_TEX_HEAD = {"part": 1, "chapter": 1, "title": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}


def _inline(s: str) -> str:
    """Inline markup of one stretch to its plain text."""
    s = re.sub(r"!\[([^\[\]\n]*)\]\([^()\n]*\)", r"\1", s)
    s = re.sub(r"(?<![\w\]])\[([^\[\]\n]*)\]\((?:<[^>\n]*>|[^()\s]+(?:\([^()\s]*\))?)(?:\s+[\"'(][^\n\"')]*[\"')])?\)", r"\1", s)
    s = re.sub(r"\[\[(?:Category|File|Image):[^\[\]\n]*\]\]", "", s, flags=re.I)
    s = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]", r"\1", s)
    s = RULES["wiki_extlink"].sub(lambda m: (re.split(r"\s", m.group()[1:-1], maxsplit=1) + [""])[1] or m.group()[1:-1], s)
    s = re.sub(r"\[\^[\w-]+\]:?", "", s)
    s = RULES["md_autolink"].sub(lambda m: m.group()[1:-1], s)
    s = re.sub(r"\{\{[^{}]*\}\}", "", s)
    s = re.sub(r"'''(?=\S)((?:(?!''')[^\n])+)'''", r"\1", s)
    s = re.sub(r"(?<!')''(?=[^\s'])([^'\n]+)''(?!')", r"\1", s)
    s = re.sub(r"``(?=[^\s`])([^`'\n]+)''", "“\\1”", s)
    for _ in range(3):
        s = re.sub(r"\\(?:textbf|textit|texttt|textsc|textsf|emph|underline|text|mbox|footnote)\{([^{}]*)\}", lambda m: f" ({m.group(1)})" if "footnote" in m.group()[:10] else m.group(1), s)
        s = re.sub(r"\{\\(?:em|bf|it|sc|tt|large|small)\s+([^{}]*)\}", r"\1", s)
    s = re.sub(r"~?\\(?:cite|citep|citet|ref|eqref|autoref|pageref|label)\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r" [\1]", s)
    s = re.sub(r"\\(?:href)\{([^{}]*)\}\{([^{}]*)\}", r"\2", s)
    s = re.sub(r"(?<=[\w\s])\\([%&#$_])", r"\1", s)
    for k in ("md_strong", "md_em", "md_strike"):
        s = RULES[k].sub(lambda m, k=k: m.group() if _code_like(k, m, s) else m.group().strip("*_~"), s)
    s = RULES["md_code"].sub(lambda m: m.group().strip("`").strip(), s)
    s = re.sub(r"(?<![\\\w:])\\([*_`#\[\]{}!])", r"\1", s)
    return re.sub(r"[ \t\xa0]+", " ", html.unescape(html.unescape(s))).strip()


def to_blocks(text: str | None) -> list[tuple[str, int, str]]:
    """(kind, level, text) blocks in order: heading, paragraph, item, quote, row, code, formula.

    Null and blank texts have no blocks. Code and formulas are kept word for word. Lines of one paragraph stay
    separated by line ends.
    """
    if not text or not text.strip():
        return []
    t = content_text(tag_tree(text))[0]
    if re.search(r"&lt;/?[a-z]", t, re.I):
        t = re.sub(r"&lt;(/?(?:" + "|".join(HTML_TAGS) + r")\b[^&]*)&gt;", r"<\1>", t, flags=re.I)
    held: list[tuple[str, str]] = []

    def hold(kind: str, body: str) -> str:
        held.append((kind, body.strip("\n")))
        return f"\n\x00{len(held) - 1}\x00\n"

    t = re.sub(r"(?ms)^[ \t]{0,3}(```|~~~)[^\n]*\n(.*?)(?:^[ \t]{0,3}\1[ \t]*$|\Z)", lambda m: hold("code", m.group(2)), t)
    t = re.sub(r"(?is)<pre\b[^>]*>(?:\s*<code\b[^>]*>)?((?:(?!<pre\b).)*?)(?:</code>\s*)?</pre>", lambda m: hold("code", html.unescape(m.group(1))), t)
    t = re.sub(r"(?is)<(?:syntaxhighlight|source)\b[^>]*>((?:(?!<(?:syntaxhighlight|source)\b).)*?)</(?:syntaxhighlight|source)>", lambda m: hold("code", m.group(1)), t)
    t = re.sub(r"(?s)\\begin\{(verbatim|lstlisting)\}((?:(?!\\begin\{).)*?)\\end\{\1\}", lambda m: hold("code", m.group(2)), t)
    t = re.sub(r"(?s)\\begin\{(equation|align|gather|displaymath|math)(\*?)\}((?:(?!\\begin\{).)*?)\\end\{\1\2\}", lambda m: hold("formula", re.sub(r"\\label\{[^{}]*\}\s*", "", m.group(3))), t)
    t = re.sub(r"(?s)\$\$(.+?)\$\$|\\\[((?:(?!\\\[).)+?)\\\]", lambda m: hold("formula", (m.group(1) or m.group(2)).strip()), t)
    t = re.sub(r"(?is)<math\b[^>]*>((?:(?!<math\b).)*?)</math>", lambda m: hold("formula", m.group(1)), t)
    t = re.sub(r"(?m)^[ \t]*%{1,3}[ \t]*[^\W\d][^\n]*\n?", "", t)
    inline_math: list[str] = []

    def keep_math(m: re.Match) -> str:
        inline_math.append(m.group().strip("$") if m.group()[0] == "$" else m.group()[2:-2])
        return f"\x01{len(inline_math) - 1}\x01"

    t = re.sub(r"(?<![\w$\\])\$(?=[^\s$\d])[^$\n]+(?<=[^\s$\\])\$(?![\w$])|\\\((?:(?!\\[()])[^\n])+\\\)", keep_math, t)
    t = re.sub(r"\\item\b(?:\[[^\]]*\])?[ \t]*", "\n- ", t)
    t = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", "\n", t)
    t = re.sub(r"\\(part|chapter|title|(?:sub){0,2}section|paragraph)\*?\{([^{}]*)\}", lambda m: f"\n{'#' * _TEX_HEAD[m.group(1)]} {m.group(2)}\n", t)
    t = re.sub(r"(?s)^\{\{[^{}]*\}\}[ \t]*$|\{\{[^{}]*\}\}", "", t, flags=re.M)
    t = _from_html(t)
    out: list[list] = []
    fresh = True
    lines = t.split("\n")
    for i, line in enumerate(lines):
        s = line.strip()
        if not s:
            fresh = True
            continue
        if m := re.fullmatch("\x00(\\d+)\x00", s):
            kind, body = held[int(m.group(1))]
            out.append([kind, 0, body])
            fresh = True
            continue
        nxt = lines[i + 1].strip() if i + 1 < len(lines) else ""
        if re.fullmatch(r"(?:={3,}|-{3,}|(?:\*[ ]*){3,}|(?:_[ ]*){3,})", s) or re.fullmatch(r"\|?[ ]*:?-{2,}:?[ ]*(?:\|[ ]*:?-{2,}:?[ ]*)*\|?", s) or re.match(r"(?:\{\||\|\}|\|-|\|\+)", s) or s == "```":
            fresh = True
            continue
        if re.match(r"\[[^\[\]\n]+\]:[ \t]*(?:https?://|/|#|<)\S*$", s) or re.fullmatch(r"\[\[Category:[^\]]*\]\]", s, re.I):
            continue
        kind, level, body = "paragraph", 0, s
        if m := re.match(r"(#{1,6})[ \t]+(.*?)[ \t#]*$", s):
            kind, level, body = "heading", len(m.group(1)), m.group(2)
        elif m := re.match(r"(={2,6})[ \t]*([^=].*?)\1$", s):
            kind, level, body = "heading", len(m.group(1)), m.group(2).strip()
        elif re.fullmatch(r"={3,}|-{3,}", nxt) and fresh:
            kind, level = "heading", 1 if nxt[0] == "=" else 2
        elif m := re.match(r"(?:[-*+]|\d+[.)])[ \t]+(?:\[[ xX]\][ \t]+)?(.*)$", s):
            kind, level, body = "item", 1 + (len(line) - len(line.lstrip())) // 2, m.group(1)
        elif m := re.match(r"([*#:;]{1,6})[ \t]*(\S.*)$", s):
            kind, level, body = "item", len(m.group(1)), m.group(2)
        elif m := re.match(r">+[ \t]?(?=[^\d=])(.*)$", s):
            kind, body = "quote", m.group(1)
        elif re.match(r"\|[^|]+\|.*\|$|[|!].*(?:\|\||!!)", s) or re.match(r"\|[ ]", s):
            kind, body = "row", " | ".join(x.strip() for x in re.split(r"\|\||!!|\|", s.strip("|!")) if x.strip())
        if kind == "paragraph" and not fresh and out and out[-1][0] == "paragraph":
            out[-1][2] += "\n" + s
        else:
            out.append([kind, level, body])
        fresh = kind != "paragraph"
    res = []
    for kind, level, body in out:
        if kind not in ("code", "formula"):
            body = "\n".join(_inline(x) for x in body.split("\n"))
        body = re.sub("\x01(\\d+)\x01", lambda m: inline_math[int(m.group(1))], body).replace("\x00", "")
        if body.strip():
            res.append((kind, level, body))
    return res


def clean_text(text: str | None) -> str | None:
    """Blocks joined by blank lines; null for null."""
    return None if text is None else "\n\n".join(b for _, _, b in to_blocks(text))


RESULT = T.StructType([
    T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("clean", T.StringType()), T.StructField("blocks", T.ArrayType(BLOCK)), T.StructField("n_noise", T.IntegerType()),
])


@F.pandas_udf(RESULT)
def _convert(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in parts:
        rows = []
        for t in texts:
            tree = tag_tree(t)
            kinds = tree.kinds()
            # texts without markup are their own clean text and one block a paragraph
            blocks = to_blocks(t) if kinds else [("paragraph", 0, p.strip()) for p in re.split(r"\n\s*\n", t or "") if p.strip()]
            clean = None if t is None else "\n\n".join(b for _, _, b in blocks) if kinds else t
            rows.append((kinds, clean, [{"kind": k, "level": lv, "text": b} for k, lv, b in blocks], content_text(tree)[1] if kinds else 0))
        yield pd.DataFrame(rows, columns=["kinds", "clean", "blocks", "n_noise"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _kinds(texts: pd.Series) -> pd.Series:
    return texts.map(markup_kinds)


def convert_markup(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``markup`` (struct of kinds, clean, blocks and n_noise, the leaves off the content paths) to every row; an existing column of that name is replaced."""
    return docs.withColumn("markup", _convert(F.col(text_col)))


def records_with_markup(docs: DataFrame, id_col: str, table_name: str, text_col: str = "text") -> DataFrame:
    """(table_name, record_id): records of which some delivery's text holds markup; null ids are left out."""
    hit = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("record_id"), _kinds(F.col(text_col)).alias("k")).where(F.size("k") > 0)
    return hit.select(F.lit(table_name).alias("table_name"), "record_id").distinct()
