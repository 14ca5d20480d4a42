r"""Tables in HTML or LaTeX in one normal form, and as grids with spans expanded.

A table is rows of cells (text, columns, rows).  Both forms are read to that, so what
is equal as a table comes out equal as HTML (which ``similarity.teds`` compares) and
as a grid.  The texts are short; Spark deals them out as Arrow batches.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .similarity import TAGS, feed_markup, rows_similarity

#: Tags that go while their content stays, and those that go with it.
UNWRAPPED = {"thead", "tbody", "tfoot", "span", "sup", "sub", "div", "p"}
REMOVED = {"colgroup", "math"}
#: LaTeX of looks and rules, which says nothing about a table.
LOOKS = [
    r"\\[vh]space\*?\{.*?\}", r"\\rule\{.*?\}\{.*?\}", r"\\addlinespace(\[.*?\])?", r"\\renewcommand\{\\arraystretch\}\{.*?\}", r"\\arraystretch\{.*?\}", r"\\(row|column|cell)color(\[.*?\])?\{.*?\}",
    r"\\rowcolors\{[^}]*\}(\{[^}]*\}){0,2}", r"\\color\{.*?\}", r"\\(tiny|scriptsize|footnotesize|small|normalsize|large|Large|LARGE|huge|Huge)(?![A-Za-z])", r"\\centering", r"\\(top|mid|bottom)rule(\[.*?\])?", r"\\hline", r"\\c(mid|line)(rule)?(\[.*?\])?(\(.*?\))?\{[0-9]+-[0-9]+\}",
]
#: What a command of each of them holds, so that texts without it are not searched.
_LOOKS = [(re.compile(p), held.split()) for p, held in zip(LOOKS, ["space", "\\rule", "\\addlinespace", "\\renewcommand", "\\arraystretch", "color", "\\rowcolors", "\\color", "\\tiny size \\small \\large \\Large \\LARGE \\huge \\Huge", "\\centering", "\\toprule \\midrule \\bottomrule", "\\hline", "\\cmid \\cline"], strict=True)]
#: Widest span that is believed: a larger one counts as 1.
WIDEST = 1000


def _span(value: str | None) -> int:
    return int(value) if value and value.strip().isdecimal() and 0 < int(value) <= WIDEST else 1


def _shown(text: str) -> str:
    return " ".join((text if text.isascii() else unicodedata.normalize("NFKC", text)).split())


class _Cells(HTMLParser):
    """Rows of the tables of a markup text, one after the other: lists of [text, columns,
    rows].  Tables within a cell count as rows of their own."""

    def __init__(self):
        super().__init__()
        self.rows: list[list[list]] = []
        self.open: list[str] = []  # tags whose content goes
        self.cell: list | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "math" and self.cell is not None and not self.open:
            self.cell[0] += f"${dict(attrs).get('alttext') or ''}$"
        if tag in REMOVED:
            self.open.append(tag)
        elif tag == "tr":
            self.rows.append([])
            self.cell = None
        elif tag in ("td", "th") and not self.open:
            if not self.rows:
                self.rows.append([])
            spans = dict(attrs)
            self.cell = ["", _span(spans.get("colspan")), _span(spans.get("rowspan"))]
            self.rows[-1].append(self.cell)
        elif tag == "br" and self.cell is not None:
            self.cell[0] += " "

    def handle_endtag(self, tag):
        if tag in self.open:
            del self.open[self.open.index(tag) :]
        elif tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None and not self.open:
            self.cell[0] += data


_TABLE = re.compile(r"<table\b[^>]*>(.*)</table>", re.DOTALL | re.IGNORECASE)
#: Markup of plain tags, quoted attributes and the three common signs; of its tags those
#: that say nothing about cells; a cell's attributes and what it shows.
_PLAIN = re.compile(rf'(?:[^<&]++|</?(?:{TAGS})>|<(?:{TAGS})(?: ++[a-z]++="[^"<>&]*+")*+ *+>|&(?:amp|lt|gt);)*+')
_MUTE = re.compile("<(?:table|{0})(?: [^>]*+)?>|</(?:br|{0})>".format("|".join(x for x in TAGS.split("|") if x not in ("table", "tr", "td", "th", "br"))))
_BREAK = re.compile("<br[^>]*+>")
_CELL = re.compile("<t[dh]([^>]*+)>([^<]*+)")
_ATTRIBUTE = re.compile(r'([a-z]+)="([^"]*)"')


def _plain_cell(attributes: str, text: str) -> tuple[str, int, int]:
    spans = dict(_ATTRIBUTE.findall(attributes)) if attributes else {}
    if "&" in text:
        text = html.unescape(text.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&"))
    return _shown(text), _span(spans.get("colspan")), _span(spans.get("rowspan"))


_short_plain_cell = lru_cache(maxsize=4096)(_plain_cell)


def _plain_row(markup: str) -> tuple | None:
    """Cells of what follows a ``<tr``, or None where it is not plain."""
    markup = "<tr" + markup
    if not _PLAIN.fullmatch(markup):
        return None
    markup = _MUTE.sub("", markup)
    if "<br" in markup:
        markup = _BREAK.sub(" ", markup)
    return tuple((_short_plain_cell if len(c[0]) + len(c[1]) <= 64 else _plain_cell)(*c) for c in _CELL.findall(markup))


_short_plain_row = lru_cache(maxsize=8192)(_plain_row)


def html_rows(text: str) -> list[list[tuple[str, int, int]]]:
    """Rows of the text's tables.  Plain markup is cut by patterns, as ``_Cells`` would read
    it; anything else is read by that."""
    m = _TABLE.search(text)
    body = m[1] if m else ""
    rows: list = []
    for markup in ("> " + body).split("<tr"):  # what stands before the first row is as one
        row = _short_plain_row(markup) if len(markup) <= 256 else _plain_row(markup)
        if row is None:
            break
        if row:
            rows.append(list(row))
    else:
        return rows
    parser = _Cells()
    feed_markup(parser, body)
    return [[(_shown(html.unescape(c[0])), c[1], c[2]) for c in row] for row in parser.rows if row]


_GROUP = re.compile(r" *+\{((?:[^{}]++|\{[^{}]*+\})*+)\}")


def _argument(text: str, at: int) -> tuple[str, int]:
    """The group in braces at a place, and where it ends; nothing where there is none."""
    if m := _GROUP.match(text, at):
        return m[1], m.end()
    while at < len(text) and text[at] == " ":
        at += 1
    if text[at : at + 1] != "{":
        return "", at
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[at + 1 : i], i + 1
    return text[at + 1 :], len(text)


_MARKS = re.compile(r"\\.|[{}&]", re.DOTALL)
#: A part whose braces are closed, at most three deep.
_CLOSED = re.compile(r"(?:[^{}\\]++|\\.|\{(?:[^{}\\]++|\\.|\{(?:[^{}\\]++|\\.|\{(?:[^{}\\]++|\\.)*+\})*+\})*+\})*+", re.DOTALL)
_BARE_MARK = re.compile(r"(?<!\\)&")


def _cut(text: str, mark: str) -> list[str]:
    r"""Parts of a text between marks outside of braces; ``\&`` is no mark."""
    if mark not in text:
        return [text]
    if mark != "&" or "\\\\" not in text:  # else an even number of backslashes may stand before it
        parts = text.split(mark) if mark != "&" else _BARE_MARK.split(text)
        for part in parts:
            if ("{" in part or "}" in part) and not _CLOSED.fullmatch(part):
                break
        else:
            return parts
    out, depth, start = [], 0, 0
    for m in _MARKS.finditer(text):
        sign = m[0]
        if sign == mark and depth == 0:
            out.append(text[start : m.start()])
            start = m.end()
        elif sign in "{}":
            depth += 1 if sign == "{" else -1
    return [*out, text[start:]]


_WRAPPED = re.compile(r"\\(?:textbf|textit|emph|text|mathrm|scalebox\{[^}]*\})\{((?:[^{}]|\{[^{}]*\})*)\}")
_ESCAPED = re.compile(r"\\([%&_#${}])")
_MULTI = re.compile(r"\\multi(column|row)\s*(?=[\[{])")
_OPTION = re.compile(r"\s*(\[[^\]]*\])?")


def _latex_text(text: str) -> str:
    if "\\" in text:
        if "{" in text:
            text = _WRAPPED.sub(r"\1", text)
        return _shown(_ESCAPED.sub(r"\1", text.replace("~", " ")))
    return _shown(text.replace("~", " "))


def _latex_cell(cell: str) -> tuple[str, int, int]:
    r"""(text, columns, rows) of what stands between two marks."""
    wide, high, cell = 1, 1, cell.strip()
    while cell.startswith("\\multi") and (m := _MULTI.match(cell)) is not None:
        n, i = _argument(cell, m.end())
        i = _OPTION.match(cell, i).end()
        spec, i = _argument(cell, i) if cell[i : i + 1] == "{" else ("", i + 1)
        inner, i = _argument(cell, i)
        wide, high = (_span(n), high) if m[1] == "column" else (wide, _span(n.lstrip("-")))
        cell = inner.strip() + cell[i:]
    return _latex_text(cell), wide, high


_short_latex_cell = lru_cache(maxsize=4096)(_latex_cell)


def _latex_line(line: str) -> tuple:
    """What ``_latex_cell`` gives for each cell of a line, and whether one spans rows."""
    cells = tuple((_short_latex_cell if len(c) <= 64 else _latex_cell)(c) for c in _cut(line, "&"))
    return cells, any(c[2] > 1 for c in cells)


_short_latex_line = lru_cache(maxsize=8192)(_latex_line)
_COMMAND = re.compile(r"\\[A-Za-z]+")


@lru_cache(maxsize=1024)
def _looks_of(commands: frozenset) -> list:
    """Patterns of looks that may be found in a text with these commands."""
    return [pattern for pattern, held in _LOOKS if any(x in c for x in held for c in commands)]


_TABULAR = re.compile(r"\\begin\{tabular\*?\}(.*)\\end\{tabular\*?\}", re.DOTALL)


def latex_rows(text: str) -> list[list[tuple[str, int, int]]]:
    r"""Rows of a ``tabular``.  Blank cells below a ``\multirow`` are part of it."""
    m = _TABULAR.search(text)
    if not m:
        return []
    body = re.sub(r"(?<!\\)%.*", "", m[1]) if "%" in m[1] else m[1]
    for pattern in _looks_of(frozenset(_COMMAND.findall(body))):
        body = pattern.sub(" ", body)
    body = body.lstrip()
    if body.startswith("["):
        body = re.sub(r"^\[[a-z]\]", "", body)
    _, at = _argument(body, 0)  # the columns' alignment
    out, covered = [], {}  # column: rows that a cell above still takes
    for line in _cut(body[at:], "\\\\"):
        if "[" in line:
            line = re.sub(r"^\s*\[[^\]]*\]", "", line)
        if not line.strip():
            continue
        cells, high_ones = (_short_latex_line if len(line) <= 256 else _latex_line)(line)
        if not covered and not high_ones:
            out.append(list(cells))
            continue
        row, column, below = [], 0, dict(covered)
        for cell in cells:
            text, wide, high = cell
            if not text and covered.get(column, 0) > 0:
                below[column] = covered[column] - 1
            else:
                row.append(cell)
                if wide == 1:
                    below[column] = high - 1
                else:
                    for c in range(column, column + wide):
                        below[c] = high - 1
            column += wide
        covered = {c: n for c, n in below.items() if n > 0}
        if row:
            out.append(row)
    return out


def table_rows(text: str | None) -> list[list[tuple[str, int, int]]]:
    """Rows of cells (text, columns, rows) of a text that holds a table in either form;
    none where it holds no table."""
    text = text or ""
    return html_rows(text) if "<" in text and re.search(r"<\s*table", text, re.IGNORECASE) else latex_rows(text)


def normal_html(text: str | None) -> str:
    """The table as HTML without looks: one kind of cells, spans of more than one; the
    empty text without a table."""
    rows = table_rows(text)

    def cell(c):
        spans = "".join(f' {name}="{n}"' for name, n in (("colspan", c[1]), ("rowspan", c[2])) if n > 1)
        return f"<td{spans}>{html.escape(c[0], quote=False)}</td>"

    body = "".join("<tr>" + "".join(map(cell, row)) + "</tr>" for row in rows)
    return f'<html><body><table border="1" >{body}</table></body></html>' if rows else ""


def grid_of(text: str | None) -> list[list[str | None]]:
    """The table as rows of equal length: a cell's text stands in every place it spans,
    null where no cell is.  Spans end with the table's last row."""
    rows = table_rows(text)
    grid: list[dict[int, str]] = [{} for _ in rows]
    for r, row in enumerate(rows):
        column = 0
        for shown, wide, high in row:
            while column in grid[r]:
                column += 1
            for i in range(r, min(r + high, len(rows))):
                for c in range(column, column + wide):
                    grid[i].setdefault(c, shown)
            column += wide
    width = max((max(g, default=-1) + 1 for g in grid), default=0)
    return [[g.get(c) for c in range(width)] for g in grid]


@F.pandas_udf(T.StringType())
def table_html(text):
    """``normal_html`` of a column."""
    return text.map(normal_html)


@F.pandas_udf(T.DoubleType())
def form_similarity(a, b):
    """``table_similarity`` of the normal forms of two columns, from their rows: no HTML is
    written and read again between."""
    import pandas as pd

    return pd.Series([rows_similarity(table_rows(s), table_rows(t)) for s, t in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def table_grid(text):
    """``grid_of`` of a column."""
    return text.map(grid_of)


#: What goes from formulas before they are compared.
FORMULA_LOOKS = [
    "\\mathbf", "\\mathrm", "\\mathnormal", "\\mathit", "\\mathbb", "\\mathcal", "\\mathscr", "\\mathfrak", "\\mathsf", "\\mathtt", "\\textbf", "\\text", "\\boldmath", "\\boldsymbol", "\\operatorname", "\\bm", "\\symbfit", "\\mathbfcal", "\\symbf",
    "\\scriptscriptstyle", "\\notag", "\\setlength", "\\coloneqq", "\\space", "\\thickspace", "\\thinspace", "\\medspace", "\\nobreakspace", "\\negmedspace", "\\quad", "\\qquad", "\\enspace", "\\substackw", " ",
]


def normal_formula(text: Column) -> Column:
    r"""A formula without marks of display maths, tags, environments, fonts and blanks, in
    lower case.  Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    inner = F.regexp_extract(text, r"\\\[(.+?)(?<!\\)\\\]", 1)
    text = F.when(inner != "", F.regexp_replace(inner, r"^\s+|\s+\z", "")).otherwise(text)
    for pattern in (r"\\tag\{.*?\}", r"\\hspace\{.*?\}", r"\\begin\{.*?\}", r"\\end\{.*?\}", r"\\arraycolsep.*?\}"):
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(text, r"^\.+|\.+\z", "")
    for x in FORMULA_LOOKS:
        text = F.replace(text, F.lit(x), F.lit(""))
    return F.lower(text)
