"""Set, sequence and tree similarities."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaccard(a: Column, b: Column) -> Column:
    """Of element sets; 1 for two empty ones."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def set_precision(a: Column, b: Column) -> Column:
    n = F.size(F.array_distinct(a))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def subset(required: Column, called: Column) -> Column:
    return F.size(F.array_except(required, called)) == 0


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the token multisets."""
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))))
    p, r = common / (F.size(a) + 1e-9), common / (F.size(b) + 1e-9)
    return 2 * p * r / (p + r + 1e-9)


def prefix_ratio(a: Column, b: Column) -> Column:
    """Length of the common prefix over the longer length."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    n = F.coalesce(F.array_position(same, False) - 1, F.size(same).cast("long"))
    n = F.when(F.array_contains(same, False), F.array_position(same, False) - 1).otherwise(F.size(same))
    return F.when(F.size(same) == 0, 1.0).otherwise(n / F.size(same))


@F.pandas_udf(T.DoubleType())
def damerau(a, b):
    """1 - unrestricted Damerau-Levenshtein distance over the longer length."""

    def distance(s, t):
        last, big = {}, len(s) + len(t)
        d = [[big] * (len(t) + 2) for _ in range(len(s) + 2)]
        for i in range(len(s) + 1):
            d[i + 1][1] = i
        for j in range(len(t) + 1):
            d[1][j + 1] = j
        for i, x in enumerate(s, 1):
            at = 0
            for j, y in enumerate(t, 1):
                k, m = last.get(y, 0), at
                if x == y:
                    at = j
                d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
            last[x] = i
        return d[-1][-1]

    return (a.fillna("").combine(b.fillna(""), lambda s, t: 1.0 if not s and not t else 1 - distance(s, t) / max(len(s), len(t)))).astype(float)


#: How the 13a tokenizer of translation scoring sets punctuation apart, in this order.
APART = [(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")]


def translation_tokens(text: str) -> list[str]:
    """Words and punctuation of a text as translation scoring cuts them."""
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for old, new in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(old, new)
    text = f" {text} "
    for pattern, to in APART:
        text = re.sub(pattern, to, text)
    return text.split()


def _grams(words: list[str], n: int) -> Counter:
    return Counter(zip(*(words[i:] for i in range(n)), strict=False))


def bleu_score(candidate: str | None, reference: str | None) -> float:
    """BLEU of up to four tokens between 0 and 1.  The k-th order without a match
    counts 1 / 2^k matches; 0 without any match or with fewer than four tokens."""
    c, r = translation_tokens(candidate or ""), translation_tokens(reference or "")
    total, missed = 0.0, 1
    for n in range(1, 5):
        x = _grams(c, n)
        hit, every = sum((x & _grams(r, n)).values()), len(c) - n + 1
        if every < 1 or (n == 1 and not hit):
            return 0.0
        if not hit:
            missed *= 2
        total += math.log(hit / every if hit else 1 / (missed * every)) / 4
    return math.exp(total + min(0.0, 1 - len(r) / len(c)))


def gleu_score(candidate: str | None, reference: str | None) -> float:
    """Matching n-grams of one to four words over the larger count of n-grams; 0 without any."""
    c, r = (candidate or "").split(), (reference or "").split()
    x = sum((_grams(c, n) for n in range(1, 5)), Counter())
    y = sum((_grams(r, n) for n in range(1, 5)), Counter())
    most = max(sum(x.values()), sum(y.values()))
    return sum((x & y).values()) / most if most else 0.0


@F.pandas_udf(T.ArrayType(T.LongType()))
def caption_counts(candidate, references):
    """Of a caption and its array of references: matches of one to four words, numbers
    of such n-grams, the caption's length, that of the nearest reference."""

    def one(c, refs):
        c, refs = (c or "").split(), [(r or "").split() for r in (refs if refs is not None else [])]
        grams = [_grams(c, n) for n in range(1, 5)]
        most = [functools.reduce(Counter.__or__, (_grams(r, n) for r in refs), Counter()) for n in range(1, 5)]
        near = min((abs(len(r) - len(c)), len(r)) for r in refs)[1] if refs else 0
        return [sum((x & m).values()) for x, m in zip(grams, most, strict=True)] + [max(0, len(c) - n) for n in range(4)] + [len(c), near]

    return candidate.combine(references, one)


@F.pandas_udf(T.DoubleType())
def bleu(candidate, reference):
    """``bleu_score`` of two columns."""
    return candidate.combine(reference, bleu_score).astype(float)


@F.pandas_udf(T.DoubleType())
def gleu(candidate, reference):
    """``gleu_score`` of two columns."""
    return candidate.combine(reference, gleu_score).astype(float)


@F.pandas_udf(T.DoubleType())
def rouge_l(candidate, reference):
    """F1 of the longest common word subsequence."""

    def one(c, r):
        c, r = (c or "").split(), (r or "").split()
        if not c or not r:
            return 0.0
        row = [0] * (len(r) + 1)
        for x in c:
            last = 0
            for j, y in enumerate(r, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        p, q = row[-1] / len(c), row[-1] / len(r)
        return 0.0 if row[-1] == 0 else 2 * p * q / (p + q)

    return candidate.combine(reference, one).astype(float)


#: Fixed value: tags that the short way of ``feed_markup`` knows; none changes how what
#: follows is read.
TAGS = "table|thead|tbody|tfoot|tr|td|th|html|body|br|b|i|sup|sub|span|div|p"
_PIECES = re.compile(rf'<({TAGS})((?: +[a-z]+="[^"<>&]*")*) *>|</({TAGS})>|([^<&]+)|&(amp|lt|gt);')
_ATTRIBUTE = re.compile(r'([a-z]+)="([^"]*)"')
_SIGNS = {"amp": "&", "lt": "<", "gt": ">"}


def feed_markup(parser: HTMLParser, text: str) -> None:
    """Feeds a whole text to a parser.  A text of plain tags, quoted attributes and the three
    common signs is cut by one pattern; anything else is read by the parser itself."""
    pieces, at = [], 0
    for m in _PIECES.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        pieces.append(m.groups())
    if at != len(text):
        parser.feed(text)
        parser.close()
        return
    for tag, attributes, end, data, sign in pieces:
        if tag:
            parser.handle_starttag(tag, _ATTRIBUTE.findall(attributes) if attributes else [])
        elif end:
            parser.handle_endtag(end)
        else:
            parser.handle_data(data or _SIGNS[sign])


class _Tree(HTMLParser):
    """Markup as nodes [tag, (colspan, rowspan), children, pieces]; pieces are what a
    cell shows: characters, and the tags of elements within."""

    VOID = {"br", "img", "meta", "hr", "input", "link"}

    def __init__(self):
        super().__init__()
        self.root = ["root", ("1", "1"), [], []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        spans = dict(attrs)
        node = [tag, (spans.get("colspan", "1"), spans.get("rowspan", "1")), [], []]
        for outer in self.open:
            outer[3].append(f"<{tag}>")
        self.open[-1][2].append(node)
        if tag not in self.VOID:
            self.open.append(node)
        else:
            for outer in self.open:
                outer[3].append(f"</{tag}>")

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                for outer in self.open:
                    outer[3].append(f"</{tag}>")
                break

    def handle_data(self, data):
        for outer in self.open:
            outer[3].extend(data)


def edit_distance(a, b) -> int:
    """Edit distance of two sequences of hashable things: the differences down a column
    of the table are two bits for each element of ``a`` (Myers)."""
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole, top = (1 << len(a)) - 1, 1 << len(a) - 1
    more, less, out = whole, 0, len(a)
    for y in b:
        hit = places.get(y, 0)
        down = hit | less
        hit |= less
        across = (((hit & more) + more) ^ more) | hit
        up, fall = less | ~(across | more), more & across
        if up & top:
            out += 1
        elif fall & top:
            out -= 1
        up, fall = up << 1 | 1, fall << 1
        more = (fall | ~(down | up)) & whole
        less = up & down & whole
    return out


def _edit_share(a: list[str], b: list[str]) -> float:
    """Edit distance of two sequences over the longer length."""
    return 0.0 if a == b else edit_distance(a, b) / max(len(a), len(b))


def _table(markup: str):
    """The first table of a markup text, or None."""
    p = _Tree()
    feed_markup(p, markup or "")
    todo = [p.root]
    while todo:
        node = todo.pop()
        if node[0] == "table":
            return node
        todo.extend(reversed(node[2]))
    return None


def _inner(node) -> int:
    return sum(1 + _inner(c) for c in node[2])


def _plain(node, structure_only: bool) -> tuple:
    """(what a node is compared by, its children): a cell is a leaf."""
    if node[0] == "td":
        return (node[0], node[1], () if structure_only else tuple(node[3])), ()
    return (node[0], None, ()), tuple(_plain(c, structure_only) for c in node[2])


def tree_distance(x, y, structure_only: bool = False) -> float:
    """Ordered tree edit distance of two tables.  A cell is a leaf; nodes of other tags or
    spans differ by 1, cells by the edit share of what they show.

    Below equal nodes, equal first and last subtrees are left out: nodes in and out cost 1
    each, so whatever maps nodes of such a pair elsewhere leaves as many nodes of the other
    one over, and costs no less."""
    return _plain_distance(_plain(x, structure_only), _plain(y, structure_only))


def _plain_distance(a, b) -> float:
    while a[0] == b[0]:
        u, v = a[1], b[1]
        first = 0
        while first < min(len(u), len(v)) and u[first] == v[first]:
            first += 1
        u, v = u[first:], v[first:]
        while u and v and u[-1] == v[-1]:
            u, v = u[:-1], v[:-1]
        if not u and not v:
            return 0.0
        if len(u) != 1 or len(v) != 1 or u[0][0] != v[0][0]:
            a, b = (a[0], u), (b[0], v)
            break
        a, b = u[0], v[0]
    paired = _paired(a, b)
    return paired if paired < 1.999 else _forest_distance(a, b)


def _cost(p, q) -> float:
    return 0.0 if p == q else 1.0 if p[:2] != q[:2] else _edit_share(p[2], q[2])


def _paired(x, y) -> float:
    """What it costs to map two trees node by node, without end where their shapes differ.
    Any other mapping of trees of one shape leaves a node out on both sides and costs 2 or
    more."""
    if len(x[1]) != len(y[1]):
        return math.inf
    out = 0.0
    for c, d in zip(x[1], y[1], strict=True):
        if c is not d and c != d:
            out += _paired(c, d)
            if out >= 1.999:
                return out
    return out + _cost(x[0], y[0])


def _forest_distance(x, y) -> float:
    """The distance between all pairs of key roots, in post-order."""

    def flat(root):
        nodes, left = [], []

        def walk(node):
            firsts = [walk(c) for c in node[1]]
            nodes.append(node[0])
            left.append(firsts[0] if firsts else len(nodes) - 1)
            return left[-1]

        walk(root)
        return nodes, left, sorted({a: i for i, a in enumerate(left)}.values())

    (x, lx, kx), (y, ly, ky) = flat(x), flat(y)
    costs = {}

    def cost(p, q):
        if (p, q) not in costs:
            costs[p, q] = 1.0 if x[p][:2] != y[q][:2] else _edit_share(x[p][2], y[q][2])
        return costs[p, q]

    d = [[0.0] * len(y) for _ in x]
    for i in kx:
        for j in ky:
            m, n = i - lx[i] + 2, j - ly[j] + 2
            f = [[float(s)] + [0.0] * (n - 1) for s in range(m)]
            f[0] = [float(t) for t in range(n)]
            for s in range(1, m):
                for t in range(1, n):
                    p, q = s + lx[i] - 1, t + ly[j] - 1
                    if lx[p] == lx[i] and ly[q] == ly[j]:
                        f[s][t] = min(f[s - 1][t] + 1, f[s][t - 1] + 1, f[s - 1][t - 1] + cost(p, q))
                        d[p][q] = f[s][t]
                    else:
                        f[s][t] = min(f[s - 1][t] + 1, f[s][t - 1] + 1, f[lx[p] - lx[i]][ly[q] - ly[j]] + d[p][q])
    return d[-1][-1]


def table_similarity(a: str, b: str, structure_only: bool = False) -> float:
    """1 - edits over the larger count of elements below the tables; 0.0 where a text
    is empty, null or holds no table, or neither table has elements."""
    x, y = _table(a), _table(b)
    if x is None or y is None:
        return 0.0
    n = max(_inner(x), _inner(y))
    return 1 - tree_distance(x, y, structure_only) / n if n else 0.0


def rows_similarity(x: list[list[tuple]], y: list[list[tuple]]) -> float:
    """``table_similarity`` of two tables given as rows of cells (text, columns, rows)."""
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    n = max(len(rows) + sum(map(len, rows)) for rows in (x, y))
    first, last = 0, 0  # equal rows, which ``tree_distance`` leaves out as well
    while first < min(len(x), len(y)) and x[first] == y[first]:
        first += 1
    while last < min(len(x), len(y)) - first and x[-1 - last] == y[-1 - last]:
        last += 1
    a, b = ((("table", None, ()), tuple((("tr", None, ()), tuple((("td", c[1:], c[0]), ()) for c in row)) for row in rows[first : len(rows) - last])) for rows in (x, y))
    return 1 - _plain_distance(a, b) / n


@F.pandas_udf(T.DoubleType())
def teds(a, b):
    """``table_similarity`` of two columns."""
    return a.combine(b, table_similarity).astype(float)


@F.pandas_udf(T.DoubleType())
def teds_structure(a, b):
    """The same without what the cells show."""
    return a.combine(b, lambda s, t: table_similarity(s, t, True)).astype(float)


def assignment(cost: list[list[float]]) -> list[int]:
    """Column of each row in the cheapest one-to-one assignment (at least as many
    columns as rows), by shortest augmenting paths."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, used, way = [float("inf")] * (m + 1), [False] * (m + 1), [0] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < low[j]:
                        low[j], way[j] = c, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out
