"""Problem 6: clean text and structure from HTML, Markdown, wiki and LaTeX.

Every syntax is read into one kind of tree (blocks under ``body``), so that one
algorithm picks the content: composite text density gives each node its characters
per tag, adjusted for link text; the node whose children's densities sum highest is
the core of the content and is kept whole, and the lowest density on its path to ``body``
is the threshold.  What falls below the threshold of its path is dropped if it is page
furniture (``nav``, ``footer`` ... or menus of links), wherever it is, and outside the core
any block of mostly links; but never a ``header`` or ``aside`` with headings, code or formulas.
Headings, list items, code, formulas and short paragraphs are of low density by nature and
never dropped for that alone.

Trees may be as deep as they like: all walks over them keep their own stacks.

The syntax is told by the text (``<!DOCTYPE``, ``\\documentclass``), then by the
suffix of the source, then by counting the marks of each syntax; a stated content
type is only a hint, as it may be wrong.  Plain text has no elements.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- rules stated as values --------------------------------------------------
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style head title template noscript svg iframe object".split())
FURNITURE = set("nav header footer aside form menu dialog".split())
BLOCK = set(
    "address article aside blockquote body br center dd details div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html li main math menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MATH_ENVIRONMENTS = "equation align gather multline displaymath math eqnarray flalign".split()
CODE_ENVIRONMENTS = "verbatim lstlisting minted Verbatim alltt".split()
SECTIONS = "part chapter section subsection subsubsection paragraph subparagraph".split()
SUFFIXES = {
    "md": "markdown", "markdown": "markdown", "mdown": "markdown", "html": "html", "htm": "html", "xhtml": "html",
    "wiki": "wiki", "mediawiki": "wiki", "tex": "latex", "latex": "latex", "txt": "text", "text": "text", "pdf": "text",
}
# -----------------------------------------------------------------------------


def squash(text: str) -> str:
    return " ".join(text.split())


@dataclass(slots=True)
class Node:
    """A block of the tree; ``parts`` holds text and child nodes in order."""

    tag: str
    parts: list = field(default_factory=list)
    chars: int = 0
    link_chars: int = 0
    tags: int = 0
    links: int = 0
    density: float = 0.0
    blocks: bool = False  # is there a block below?
    telling: bool = False  # are there headings, code or formulas in it?
    spared: bool = False  # is it, or does it hold, a header or aside with such?

    def nodes(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]

    def text(self, skip: frozenset[str] = frozenset()) -> str:
        out: list[str] = []
        todo: list = self.parts[::-1]
        while todo:
            p = todo.pop()
            if isinstance(p, str):
                out.append(p)
            elif p.tag not in skip and p.tag not in HIDDEN:
                gap = " " if p.tag in BLOCK else ""
                todo += [gap, *p.parts[::-1], gap]
        return "".join(out)


def marks(text: str, n: int) -> list[str]:
    """Characters that the text does not have, to stand for what is put by."""
    free = (c for c in map(chr, range(0xE900, 0x110000)) if c not in text)
    return [next(free) for _ in range(n)]


# --- HTML ---------------------------------------------------------------------


class _Tree(HTMLParser):
    """Tolerant tree builder: unclosed ``p`` and ``li`` end where HTML says so."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("body")
        self.stack = [self.root]

    def _pop_to(self, tags: set[str], until: set[str]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                del self.stack[k:]
                return
            if self.stack[k].tag in until:
                return

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("html", "body"):
            return
        if tag in BLOCK and tag != "br":
            self._pop_to({"p"} | HEADINGS if tag in HEADINGS else {"p"}, {"li", "td", "th", "table", "div"})
        if tag == "li":
            self._pop_to({"li"}, {"ul", "ol"})
        elif tag in ("td", "th", "tr"):
            self._pop_to({"td", "th"} if tag != "tr" else {"tr"}, {"table"})
        elif tag in ("dt", "dd"):
            self._pop_to({"dt", "dd"}, {"dl"})
        node = Node(tag)
        self.stack[-1].parts.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.stack[-1].parts.append(Node(tag))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return
            if self.stack[k].tag in ("ul", "ol", "table") and tag not in ("ul", "ol", "table", "div", "body", "html"):
                return

    def handle_data(self, data: str) -> None:
        self.stack[-1].parts.append(data)


def parse_html(text: str) -> Node:
    tree = _Tree()
    tree.feed(text)
    tree.close()
    return tree.root


# --- Markdown -----------------------------------------------------------------

_FRONT = re.compile(r"\A\ufeff?---[ \t]*\n.*?\n---[ \t]*(?:\n|\Z)", re.S)
_FENCE = re.compile(r"^\s*(`{3,}|~{3,})([^`]*)$")
_ATX = re.compile(r"^ {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_ITEM = re.compile(r"^(\s*)(?:[-*+]|\d{1,9}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?(.*)$")
_RULE = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_TAG_LINE = re.compile(
    r"^ {0,3}<(?:!--|/?(h[1-6]|p|div|ul|ol|li|pre|table|tr|td|th|thead|tbody|section|article|nav|header|footer|"
    r"aside|main|blockquote|script|style|form|dl|dt|dd|hr|details|summary|figure|center|address)\b)",
    re.I,
)
_DEFINITION = re.compile(r"^ {0,3}\[[^\]]+\]:\s*\S+")
_CELL = re.compile(r"(?:\\.|[^|\\]|\\$)+")
_RULED = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_MATH_OPEN = re.compile(r"^\s*(\$\$|\\\[|\\begin\{(" + "|".join(MATH_ENVIRONMENTS) + r")\*?\})")
_MARKED = re.compile(r"[*_~`\[\\$<&]")  # what an inline mark begins with
_MD = re.compile(
    r"(?P<tick>`+)(?!`)(?P<code>.+?)(?<!`)(?P=tick)(?!`)"
    r"|\\\((?P<m1>.+?)\\\)|\\\[(?P<m2>.+?)\\\]|\$\$(?P<m3>.+?)\$\$"
    r"|(?<![\\$\w])\$(?=[^\s$])(?P<m4>[^$\n]*?[^\s$\\])\$(?![\d$])"
    r"|\\(?P<esc>[!-/:-@\[-`{-~])"
    r"|<!--.*?-->|<(?P<auto>https?://[^>\s]+)>|(?P<tag></?[A-Za-z][^<>]*>)",
    re.S,
)
_LINK = re.compile(r"!?\[((?:[^\[\]]|\[[^\[\]]*\])*)\](?:\([^()\s]*(?:\s+[\"'][^\"']*[\"'])?\)|\[[^\]]*\])")
_STRONG = re.compile(r"(\*{1,3})(?=\S)(.+?)(?<=\S)\1", re.S)
_UNDER = re.compile(r"(?<!\w)(_{1,3})(?=\S)(.+?)(?<=\S)\1(?!\w)", re.S)
_STRIKE = re.compile(r"~~(?=\S)(.+?)(?<=\S)~~", re.S)


def _inline_markdown(text: str) -> list:
    """Text and formula nodes of a Markdown span; marks are gone, escapes resolved."""
    kept: list = []
    if not _MARKED.search(text):
        return [text]
    first, last = marks(text, 2)

    def keep(value) -> str:
        kept.append(value)
        return f"{first}{len(kept) - 1}{last}"

    def token(m: re.Match) -> str:
        if m["code"] is not None:
            return keep(m["code"].strip() if m["code"].strip() else m["code"])
        for g in ("m1", "m2", "m3", "m4"):
            if m[g] is not None:
                return keep(Node("math", [m[g]]))
        if m["esc"]:
            return keep(m["esc"])
        if m["auto"]:
            return keep(m["auto"])
        return " " if m["tag"] and re.match(r"</?(br|p|div|li)\b", m["tag"], re.I) else ""

    out = _MD.sub(token, text)
    while True:
        linked = _LINK.sub(lambda m: m[1], out)
        if linked == out:
            break
        out = linked
    for pattern, group in ((_STRONG, 2), (_STRONG, 2), (_STRONG, 2), (_UNDER, 2), (_UNDER, 2), (_STRIKE, 1)):
        out = pattern.sub(lambda m, g=group: m[g], out)
    parts: list = []
    for k, piece in enumerate(re.split(f"{first}(\\d+){last}", out)):
        if k % 2:
            parts.append(kept[int(piece)])
        elif piece:
            parts.append(html.unescape(piece))
    return parts


def _math_block(lines: list[str], i: int, open_ended: set[str]) -> tuple[Node, int] | None:
    """A displayed formula starting at line ``i``; None if it never closes.

    ``open_ended`` keeps the closing marks of which none follows any more.
    """
    m = _MATH_OPEN.match(lines[i])
    if not m:
        return None
    close = {"$$": "$$", r"\[": r"\]"}.get(m[1]) or m[1].replace(r"\begin", r"\end")
    rest = lines[i][m.end() :]
    body: list[str] = []
    if close in open_ended:
        return None
    for k in range(i, len(lines)):
        line = rest if k == i else lines[k]
        if k > i and not line.strip() and close == "$$":
            return None
        if k > i and close != "$$" and line.lstrip().startswith(m[1]):
            return None  # opened anew: the first one has no end
        at = line.find(close)
        if at >= 0:
            return Node("math", ["\n".join([*body, line[:at]])]), k + 1
        body.append(line)
    open_ended.add(close)
    return None


def _table_markdown(lines: list[str]) -> Node:
    """Rows and cells of lines that start with a bar; the row of dashes under the head holds no text."""
    table = Node("table")
    for k, line in enumerate(lines):
        if _RULED.match(line) and (k == 1 or k == 0 and "---" in line):
            continue
        cells = [c.replace(r"\|", "|").strip() for c in _CELL.findall(line.strip())]
        table.parts.append(Node("tr", [Node("td", _inline_markdown(c)) for c in cells if c]))
    return table


def parse_markdown(text: str) -> Node:
    body = Node("body")
    quotes = [(body, _FRONT.sub("", text, count=1).split("\n"))]
    while quotes:  # a quotation is read as a text of its own
        quotes += _blocks_markdown(*quotes.pop())
    return body


_QUOTED = re.compile(r"(?:[ \t]*>)+ ?")


def _unquoted(lines: list[str]) -> list[str]:
    """Lines without the quotation marks that all of them have."""
    depth = min(_QUOTED.match(x).group().count(">") for x in lines)
    level = re.compile(r"(?:[ \t]*>){%d} ?" % depth) if depth < 1000 else _QUOTED
    return [level.sub("", x, count=1) for x in lines]


def _blocks_markdown(body: Node, lines: list[str]) -> list[tuple[Node, list[str]]]:
    """Read the blocks of ``lines`` into ``body``; the quotations among them are left to be read."""
    quotes: list[tuple[Node, list[str]]] = []
    paragraph: list[str] = []
    open_ended: set[str] = set()
    in_list = False

    def flush(tag: str = "p") -> None:
        if paragraph:
            body.parts.append(Node(tag, _inline_markdown("\n".join(paragraph))))
            paragraph.clear()

    i = 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            flush()
            i += 1
            continue
        fence = _FENCE.match(line)
        if fence and (len(line) - len(line.lstrip()) < 4 or in_list):
            flush()
            mark, code, i = fence[1], [], i + 1
            while i < len(lines):
                closing = lines[i].strip()
                if closing.startswith(mark) and not closing.strip(mark[0]):
                    break
                code.append(lines[i])
                i += 1
            i += 1
            body.parts.append(Node("pre", ["\n".join(code)]))
            in_list = False
            continue
        item = _ITEM.match(line)
        indent = len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())
        if indent >= 4 and not paragraph and not (in_list and item):
            code = []
            while i < len(lines):
                if lines[i].strip() and not lines[i].startswith(("    ", "\t")):
                    break
                code.append(lines[i])
                i += 1
            body.parts.append(Node("pre", ["\n".join(code)]))
            in_list = False
            continue
        atx = _ATX.match(line)
        if atx:
            flush()
            body.parts.append(Node("h2", _inline_markdown(atx[1] or "")))
            in_list, i = False, i + 1
            continue
        if paragraph and _UNDERLINE.match(line):
            flush("h2")
            i += 1
            continue
        if _RULE.match(line) and not (item and item[2] and not _RULE.match(line)):
            flush()
            in_list, i = False, i + 1
            continue
        math_block = _math_block(lines, i, open_ended) if not paragraph else None
        if math_block:
            node, i = math_block
            body.parts.append(node)
            in_list = False
            continue
        if item and (not paragraph or not line.strip()[0].isdigit() or line.strip().startswith(("1.", "1)"))):
            flush()
            content, i = [item[2]], i + 1
            while i < len(lines) and lines[i].strip():
                nxt = lines[i]
                if _ITEM.match(nxt) or _ATX.match(nxt) or _FENCE.match(nxt) or _TAG_LINE.match(nxt) or _RULE.match(nxt):
                    break
                content.append(nxt.strip())
                i += 1
            body.parts.append(Node("li", _inline_markdown("\n".join(content))))
            in_list = True
            continue
        if _TAG_LINE.match(line):
            flush()
            start, i = i, i + 1
            raw = re.match(r"\s*<(pre|script|style)\b", line, re.I)
            end = f"</{raw[1].lower()}>" if raw else "-->" if line.lstrip().startswith("<!--") else None
            if end:
                i = start
                while i < len(lines) and end not in lines[i].lower():
                    i += 1
                i += 1
            if not end or start + 1 <= len(lines):
                while i < len(lines) and lines[i].strip():
                    i += 1
            body.parts.append(Node("section", parse_html("\n".join(lines[start:i])).parts))
            in_list = False
            continue
        if line.lstrip().startswith(">") and not paragraph:
            start = i
            while i < len(lines) and lines[i].lstrip().startswith(">"):
                i += 1
            body.parts.append(Node("blockquote"))
            quotes.append((body.parts[-1], _unquoted([x.lstrip() for x in lines[start:i]])))
            in_list = False
            continue
        if not paragraph and line.lstrip().startswith("|"):
            start = i
            while i < len(lines) and lines[i].lstrip().startswith("|"):
                i += 1
            body.parts.append(_table_markdown(lines[start:i]))
            in_list = False
            continue
        if not paragraph and _DEFINITION.match(line):
            in_list, i = False, i + 1
            continue
        in_list = False
        paragraph.append(line)
        i += 1
    flush()
    return quotes


# --- wiki ---------------------------------------------------------------------

_W_RAW = re.compile(
    r"<(?P<t>syntaxhighlight|source|pre|math|nowiki|ref|script|style)\b(?P<a>[^>]*?)(?:/>|>(?P<b>.*?)</(?P=t)\s*>)", re.S | re.I
)
_W_TEMPLATE = re.compile(r"\{\{(?:[^{}]|\{\||\|\}(?!\}))*\}\}")  # tables in a template go with it
_W_TABLE = re.compile(r"^[\s:]*\{\|")
_W_HEADING = re.compile(r"^(={1,6})\s*(.+?)\s*\1\s*$")
_W_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
_W_DROP = re.compile(r"\[\[(?:Category|File|Image|Kategorie|Datei|Catégorie|Categoría)\s*:[^\[\]]*(?:\[\[[^\]]*\]\][^\[\]]*)*\]\]", re.I)
_W_URL = re.compile(r"\[(?:https?:)?//\S+\s+([^\]]+)\]")


def parse_wiki(text: str) -> Node:
    body = Node("body")
    kept: list[Node | str] = []
    first, last = marks(text, 2)

    def keep(value) -> str:
        kept.append(value)
        return f"{first}{len(kept) - 1}{last}"

    def raw(m: re.Match) -> str:
        tag, inside = m["t"].lower(), m["b"] or ""
        if tag in ("syntaxhighlight", "source", "pre"):
            return keep(Node("pre", [html.unescape(inside)])) if "inline" not in m["a"] else keep(inside)
        if tag == "math":
            return keep(Node("math", [html.unescape(inside)]))
        return keep(inside) if tag == "nowiki" else ""

    text = _W_RAW.sub(raw, re.sub(r"<!--.*?-->", "", text, flags=re.S))
    while True:
        less = _W_TEMPLATE.sub("", text)
        if less == text:
            break
        text = less
    text = _W_DROP.sub("", text)

    def inline(span: str) -> list:
        span = _W_URL.sub(r"\1", _W_LINK.sub(r"\1", span))
        span = re.sub(r"'{2,5}", "", span)
        span = re.sub(r"</?[A-Za-z][^<>]*>", lambda m: " " if re.match(r"<br", m[0], re.I) else "", span)
        out: list = []
        for k, piece in enumerate(re.split(f"{first}(\\d+){last}", span)):
            if k % 2:
                out.append(kept[int(piece)])
            elif piece:
                out.append(html.unescape(piece))
        return out

    lines, paragraph, i = text.split("\n"), [], 0
    stack = [body]  # the body, then the open table, row and cell

    def flush() -> None:
        if paragraph:
            stack[-1].parts.append(Node("p", inline("\n".join(paragraph))))
            paragraph.clear()

    def enter(tag: str, inside: str) -> None:
        """Open a row or cell in the innermost ``inside``."""
        flush()
        while stack[-1].tag not in inside.split():
            stack.pop()
        stack[-1].parts.append(Node(tag))
        stack.append(stack[-1].parts[-1])

    while i < len(lines):
        line = lines[i]
        heading, item = _W_HEADING.match(line), re.match(r"^([*#:;]*[*#])\s*(.*)$", line)
        bar = line.strip()[:2] if len(stack) > 1 else ""
        if not line.strip():
            flush()
        elif _W_TABLE.match(line):
            enter("table", stack[-1].tag)
        elif bar == "|}":
            flush()
            while stack.pop().tag != "table":
                pass
            if rest := line.strip()[2:].strip():
                paragraph.append(rest)
        elif bar == "|-":
            enter("tr", "table")
        elif bar[:1] in ("|", "!"):
            row = line.strip()
            cells = [row[2:]] if bar == "|+" else re.split(r"\|\||!!" if bar[0] == "!" else r"\|\|", row[1:])
            for cell in cells:
                if stack[-1].tag == "table":
                    enter("tr", "table")
                enter("td", "tr")
                head, found, rest = cell.partition("|")
                if found and "[[" not in head and ("=" in head or not head.strip()):
                    cell = rest  # before the bar stood attributes
                if cell.strip():
                    paragraph.append(cell)
        elif heading:
            flush()
            stack[-1].parts.append(Node("h2", inline(heading[2])))
        elif item:
            flush()
            stack[-1].parts.append(Node("li", inline(item[2])))
        elif _TAG_LINE.match(line):
            flush()
            start = i
            while i + 1 < len(lines) and lines[i + 1].strip() and not (len(stack) > 1 and lines[i + 1].strip()[0] in "|!"):
                i += 1
            block = parse_html("\n".join(lines[start : i + 1]))
            stack[-1].parts.append(_restore(Node("section", block.parts), inline))
        else:
            paragraph.append(re.sub(r"^[:;]+\s*", "", line))
        i += 1
    flush()
    return body


def _restore(node: Node, inline) -> Node:
    for n in [node, *below(node)]:
        n.parts = [
            x for p in n.parts
            for x in ([p] if isinstance(p, Node) else inline(p.replace("&", "&amp;").replace("<", "&lt;") if "&" in p or "<" in p else p))
        ]
    return node


# --- LaTeX --------------------------------------------------------------------

_T_CODE = re.compile(r"\\begin\{(" + "|".join(CODE_ENVIRONMENTS) + r")\}(?:\[[^\]]*\])?(?:\{[^}\n]*\})?(.*?)\\end\{\1\}", re.S)
_T_MATH = re.compile(
    r"\\begin\{(" + "|".join(MATH_ENVIRONMENTS) + r")(\*?)\}(?P<a>.*?)\\end\{\1\2\}|\\\[(?P<b>.*?)\\\]|\$\$(?P<c>.+?)\$\$"
    r"|\\\((?P<d>.*?)\\\)|(?<!\\)\$(?P<e>[^$]+?)(?<!\\)\$",
    re.S,
)
_T_COMMENT = re.compile(r"(?<!\\)((?:\\\\)*)%[^\n]*")
_T_DROP = re.compile(r"\\(?:label|cite[a-z]*|ref|eqref|pageref|index|vspace|hspace|bibliography(?:style)?|input|include)\*?(?:\[[^\]]*\])?\{[^{}]*\}")
_T_NOTE = re.compile(r"\\footnote(?:text)?(?![A-Za-z])\s*(?:\[[^\]]*\])?\s*(?=\{)")
_T_LINK = re.compile(r"\\(?:href|hyperref)(?:\[[^\]]*\])?\{[^{}]*\}\{")
_T_WORDS = {
    "textless": "<", "textgreater": ">", "textbackslash": "\\", "textasciitilde": "~", "textasciicircum": "^",
    "ldots": "…", "dots": "…", "LaTeX": "LaTeX", "TeX": "TeX", "quad": " ", "qquad": " ", "S": "§", "copyright": "©",
    "textbar": "|", "textunderscore": "_", "textdollar": "$", "euro": "€", "ss": "ß", "newline": " ", "par": " ",
}


def _braced(text: str, at: int) -> tuple[str, int]:
    """Content of the group that opens at ``text[at]``, and the place after it."""
    depth, k = 0, at
    while k < len(text):
        if text[k] == "\\":
            k += 2
            continue
        depth += (text[k] == "{") - (text[k] == "}")
        if not depth:
            return text[at + 1 : k], k + 1
        k += 1
    return text[at + 1 :], len(text)


def parse_latex(text: str) -> Node:
    body = Node("body")
    kept: list = []
    first, last, note, end_note = marks(text, 4)

    def keep(value) -> str:
        kept.append(value)
        return f"{first}{len(kept) - 1}{last}"

    text = _T_CODE.sub(lambda m: f"\n\n{keep(Node('pre', [m[2]]))}\n\n", text)
    text = re.sub(r"\\verb\*?([^A-Za-z\s])(.*?)\1", lambda m: keep(m[2]), text)
    text = _T_COMMENT.sub(r"\1", text)
    start = text.find(r"\begin{document}")
    if start >= 0:
        text = text[start + len(r"\begin{document}") :]
    text = text.split(r"\end{document}")[0]
    dollar = keep("$")
    text = re.sub(r"(?<!\\)((?:\\\\)*)\\\$", lambda m: m[1] + dollar, text)

    def formula(m: re.Match) -> str:
        inside = next(x for x in (m["a"], m["b"], m["c"], m["d"], m["e"]) if x is not None)
        return keep(Node("math", [_T_DROP.sub("", inside.replace(dollar, r"\$"))]))

    text = _T_MATH.sub(formula, text)
    text = _T_LINK.sub("{", _T_DROP.sub("", text))

    def inline(span: str) -> list:
        span = re.sub(r"\\\\(?:\[[^\]]*\])?|~", " ", span)
        span = re.sub(r"\\([&%#_{}\$ ,;:!-])", lambda m: keep(m[1]) if m[1] in "&%#_{}$" else " ", span)
        span = re.sub(r"\\([A-Za-z]+)\*?(?:\s*\{\}|\s+(?=[^A-Za-z{])|(?![A-Za-z{]))",
                      lambda m: keep(_T_WORDS.get(m[1], "")) + (" " if m[0][-1:].isspace() else ""), span)
        span = re.sub(r"\\[A-Za-z]+\*?\s*(?:\[[^\]]*\])?(?=\{)", "", span)
        span = re.sub(r"[{}]", "", span)
        out: list = []
        for k, piece in enumerate(re.split(f"{first}(\\d+){last}", span)):
            if k % 2:
                out.append(kept[int(piece)])
            elif piece:
                out.append(piece)
        return out

    heading = re.compile(r"\\(?:" + "|".join(SECTIONS) + r")\*?(?:\[[^\]]*\])?(?=\{)")
    mark = re.compile(
        heading.pattern + r"|\\item(?![A-Za-z])(?:\[(?P<o>[^\]]*)\])?|\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?|\n[ \t]*\n"
        r"|\\(?:title|author|date)(?=\{)|\\maketitle"
    )
    notes: list[str] = []
    noted = re.compile(f"{note}(\\d+){end_note}")

    def pull(text: str) -> str:
        """The text with a mark for each footnote; the footnotes are put by."""
        out, at = [], 0
        while m := _T_NOTE.search(text, at):
            inside, end = _braced(text, m.end())
            notes.append(inside)
            out += [text[at : m.start()], f"{note}{len(notes) - 1}{end_note}"]
            at = end
        return "".join([*out, text[at:]])

    def spans(text: str) -> Iterator[tuple[str, str]]:
        text = pull(text)
        at, tag, run = 0, "p", 0
        while m := mark.search(text, at):
            yield tag, text[run : m.start()]
            at = run = m.end()
            if heading.match(m[0] + "{"):
                inside, at = _braced(text, m.end())
                yield "h2", inside
                tag, run = "p", at
            elif m[0].startswith((r"\title", r"\author", r"\date")):
                at = run = _braced(text, m.end())[1]
                tag = "p"
            else:
                tag = "li" if m[0].startswith(r"\item") else "p"
        yield tag, text[run:]

    open_spans = [spans(text)]
    while open_spans:
        tag, span = next(open_spans[-1], (None, ""))
        if tag is None:
            open_spans.pop()
            continue
        plain = noted.sub("", span)
        if plain.strip():
            body.parts.append(Node(tag, inline(plain)))
        # After a block follow the footnotes met in it, as blocks of their own.
        open_spans += [spans(notes[int(n)]) for n in reversed(noted.findall(span))]
    return body


# --- syntax, density, elements --------------------------------------------------

_EVIDENCE = {
    "html": re.compile(r"</?(?:h[1-6]|p|ul|ol|li|div|pre|body|html|table)\b", re.I),
    "latex": re.compile(r"\\(?:begin\{|end\{|(?:sub)*section\*?\{|item\b|textbf\{|emph\{)"),
    "wiki": re.compile(r"^==+[^=\n]+==+\s*$|'''|\[\[|\{\{|<(?:math|syntaxhighlight|ref)\b", re.M),
    "markdown": re.compile(r"^#{1,6}\s+\S|^\s*(?:```|~~~)|\*\*\S|\]\([^)\s]+\)|^\s*[-*+]\s+\S|^(?:===+|---+)\s*$|`[^`\n]+`", re.M),
}


def syntax_of(text: str, source: str | None = None, content_type: str | None = None) -> str:
    """``html``, ``markdown``, ``wiki``, ``latex`` or ``text``."""
    head = text.lstrip("\ufeff \t\r\n")[:400]
    if re.match(r"<!doctype html|<html\b", head, re.I):
        return "html"
    if re.match(r"(?:%[^\n]*\n\s*)*\\documentclass", head):
        return "latex"
    suffix = re.search(r"\.([A-Za-z0-9]+)$", (source or "").strip())
    known = SUFFIXES.get(suffix[1].lower()) if suffix else None
    if known:
        return known
    counts = {k: len(p.findall(text)) for k, p in _EVIDENCE.items()}
    hint = (content_type or "").strip().lower().rpartition("/")[2]
    best = max(counts, key=lambda k: (counts[k] + (hint == k), k == hint))
    return best if counts[best] >= (1 if hint == best else 2) else "text"


def parse(text: str, syntax: str) -> Node:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return {"html": parse_html, "markdown": parse_markdown, "wiki": parse_wiki, "latex": parse_latex}[syntax](text)


def below(node: Node) -> Iterator[Node]:
    """All nodes under ``node``, parents before children, in order."""
    todo = node.nodes()[::-1]
    while todo:
        n = todo.pop()
        yield n
        todo += n.nodes()[::-1]


def _measure(body: Node) -> list[tuple[Node, Node | None]]:
    """Fill in characters, tags and densities; gives the visible nodes with their parents, parents first."""
    order: list[tuple[Node, Node | None]] = []
    todo: list[tuple[Node, Node | None, bool]] = [(body, None, False)]
    while todo:
        node, parent, linked = todo.pop()
        order.append((node, parent))
        linked = linked or node.tag == "a"
        chars, children = 0, []
        for p in node.parts:
            if isinstance(p, str):
                chars += len(squash(p))
                if not node.telling and "\\" in p or "$$" in p:
                    node.telling = bool(_FORMULA.search(p))
            elif p.tag not in HIDDEN:
                children.append((p, node, linked))
        node.chars, node.link_chars = chars, chars if linked else 0
        node.telling = node.telling or node.tag in _TELLING
        todo += children[::-1]
    for node, parent in reversed(order):
        node.spared = node.spared or node.telling and node.tag in ("header", "aside")
        if parent:
            parent.spared = parent.spared or node.spared
            parent.chars += node.chars
            parent.link_chars += node.link_chars
            parent.tags += node.tags + 1
            parent.links += node.links + (node.tag == "a")
            parent.blocks = parent.blocks or node.blocks or node.tag in BLOCK
            parent.telling = parent.telling or node.telling
    pull = body.link_chars / max(1, body.chars)
    for node, _ in order:
        if node.chars:
            # Composite text density: characters per tag, damped by the share of link text.
            n, links, tags = node.chars, node.link_chars, node.tags or 1
            base = math.log(n * links / max(1, n - links) + pull * n + math.e)
            ratio = n / (links or 1) * tags / (node.links or 1)
            node.density = n / tags * math.log(max(ratio, 1.0) + 1e-9) / max(base, 1.0)
    return order


def content(body: Node) -> Node:
    """The core of the densest path, and what lies beside that path and is dense enough or tells structure."""
    order = _measure(body)
    sums: dict[int, float] = dict.fromkeys((id(n) for n, _ in order), 0.0)
    for node, parent in order:
        if parent:
            sums[id(parent)] += node.density
    core = max((n for n, _ in order), key=lambda n: sums[id(n)])
    parents = {id(n): p for n, p in order}
    path, at = [core], core
    while at := parents[id(at)]:
        path.append(at)
    threshold = min(n.density for n in path)
    on_path = {id(n) for n in path}

    def furniture(n: Node) -> bool:
        menu = n.links >= 3 and n.link_chars > 0.8 * n.chars and n.tag in ("ul", "ol", "div", "table", "section")
        return (menu or n.tag in FURNITURE) and not n.spared

    def beside(n: Node) -> bool:
        """A block outside the core that is mostly links and holds no structure."""
        return n.tag in BLOCK and 2 * n.link_chars > n.chars and not n.telling and n.tag != "li" and not any(c.tag == "li" for c in below(n))

    todo = [body]
    while todo:
        node = todo.pop()
        inside = node is core or id(node) not in on_path
        node.parts = [
            p for p in node.parts
            if isinstance(p, str) or id(p) in on_path or p.density >= threshold or not (furniture(p) or not inside and beside(p))
        ]
        todo += node.nodes()
    return body


_FORMULA = re.compile(r"\\\((?P<a>.+?)\\\)|\\\[(?P<b>.+?)\\\]|\$\$(?P<c>.+?)\$\$", re.S)
_NESTED = frozenset({"ul", "ol", "pre"})
_NO_CODE = frozenset({"pre", "code", "math"})
_TELLING = HEADINGS | _NO_CODE


def elements(body: Node) -> Iterator[tuple[str, str]]:
    """``kind, clean_text`` of every structural element, in order; ``body`` is what ``content`` gave."""
    found: list[tuple[str, str]] = []
    frames: list[tuple[Iterator, list[str]]] = []

    def enter(node: Node) -> None:
        """Note the element a node is, and open it if there may be more in it."""
        if node.tag in HIDDEN:
            return
        if node.tag == "pre":
            found.append(("code", node.text()))
            return
        if node.tag == "math":
            found.append(("formula", node.text()))
            return
        if node.tag in HEADINGS:
            found.append(("heading", _plain(node.text())))
        elif node.tag == "li":
            found.append(("list_item", _plain(node.text(_NESTED))))
        frames.append((iter(node.parts), []))

    def formulas(run: list[str]) -> None:
        text = "".join(run)
        if "\\" in text or "$$" in text:
            found.extend(("formula", m["a"] or m["b"] or m["c"]) for m in _FORMULA.finditer(text))
        run.clear()

    enter(body)
    while frames:
        parts, run = frames[-1]
        p = next(parts, None)
        if p is None:
            formulas(run)
            frames.pop()
        elif isinstance(p, str):
            run.append(p)
        elif p.tag in BLOCK:
            formulas(run)
            enter(p)
        elif p.tag not in HIDDEN:
            if p.blocks:
                enter(p)
            else:
                run.append("\x00" if p.tag in _NO_CODE else p.text(_NO_CODE))
    for kind, text in found:
        if text := squash(text):
            yield kind, text


def _plain(text: str) -> str:
    return _FORMULA.sub(lambda m: m["a"] or m["b"] or m["c"], text)


def clean_text(body: Node) -> str:
    """Readable text that keeps headings, list items, code blocks and formulas."""
    out: list[str] = []
    frames: list[tuple[Iterator, list[str]]] = [(iter(body.parts), [])]

    def flush(run: list[str]) -> None:
        if line := squash("".join(run)):
            out.append(line)
        run.clear()

    while frames:
        parts, run = frames[-1]
        p = next(parts, None)
        if p is None:
            flush(run)
            frames.pop()
        elif isinstance(p, str):
            run.append(p)
        elif p.tag in HIDDEN:
            continue
        elif p.tag in HEADINGS:
            flush(run)
            out.append("# " + squash(_plain(p.text())))
        elif p.tag == "pre":
            flush(run)
            out.append("```\n" + p.text().strip("\n") + "\n```")
        elif p.tag == "math":
            run.append(f"$${squash(p.text())}$$")
        elif p.tag == "li":
            flush(run)
            out.append("- " + squash(_plain(p.text(_NESTED))))
            frames.append((iter([c for c in p.nodes() if c.tag in _NESTED]), []))
        elif p.tag in BLOCK or p.nodes():
            flush(run)
            frames.append((iter(p.parts), []))
        else:
            run.append(p.text())
    return "\n".join(out)


def read_document(text: str | None, source: str | None = None, content_type: str | None = None):
    """``(syntax, content tree)``; None for NULL and blank texts, and no tree for plain text."""
    if not text or not text.strip():
        return None
    syntax = syntax_of(text, source, content_type)
    return syntax, None if syntax == "text" else content(parse(text, syntax))


def _rows(df: DataFrame, doc_id: str, text: str, source: str | None, content_type: str | None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.col(doc_id).cast("string").alias("doc_id"),
        F.col(text).alias("t"),
        (F.col(source) if source else none).alias("s"),
        (F.col(content_type) if content_type else none).alias("c"),
    ).where(F.col("t").isNotNull())


def markup_elements(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str | None = "source", content_type: str | None = "content_type"
) -> DataFrame:
    """Distinct ``doc_id, kind, clean_text`` per row of ``df``.

    NULL, blank and plain texts have no elements. Repeated rows repeat their elements.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, kinds, texts = [], [], []
            for i, t, s, c in pdf.itertuples(index=False):
                found = read_document(t, s, c)
                if found and found[1]:
                    for kind, clean in dict.fromkeys(elements(found[1])):
                        ids.append(i)
                        kinds.append(kind)
                        texts.append(clean)
            yield pd.DataFrame({"doc_id": ids, "kind": kinds, "clean_text": texts}, dtype="object")

    return _rows(df, doc_id, text, source, content_type).mapInPandas(run, "doc_id string, kind string, clean_text string")


def markup_to_text(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str | None = "source", content_type: str | None = "content_type"
) -> DataFrame:
    """``doc_id, syntax, clean_text``: plain text comes out as it is; NULL texts give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t, s, c in pdf.itertuples(index=False):
                found = read_document(t, s, c)
                rows.append((i, found[0] if found else "text", clean_text(found[1]) if found and found[1] else t.strip()))
            yield pd.DataFrame(rows, columns=["doc_id", "syntax", "clean_text"], dtype="object")

    return _rows(df, doc_id, text, source, content_type).mapInPandas(run, "doc_id string, syntax string, clean_text string")
