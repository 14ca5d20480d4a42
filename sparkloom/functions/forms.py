"""Nested forms as JSON: one order of fields, field scores, tree-edit accuracy.

A form is read once for each row into a canonical ordered tree: fields by length of
name and name, lists of forms as subtrees, everything else as texts.  Scores over a
set are sums of what rows give, so only those are shuffled.
"""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .similarity import edit_distance


def parsed(text: str | None) -> dict:
    """The JSON object of a text, or of its fenced block; an empty form where it is none."""
    m = re.search(r"```json(.*?)(```|\Z)", text or "", re.DOTALL)
    try:
        found = json.loads((m[1] if m else text or "").strip().replace("\n", ""))
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


# Blanks of a value as they should be, in this order: none between Chinese
# characters, none between them and letters or digits, one behind marks, one between
# digits and letters, one for many.
SPACING = [
    (r"(?<=[\u4e00-\u9fff])\s+(?=[\u4e00-\u9fff])", ""),
    (r"(?<=[\u4e00-\u9fff])\s+(?=[a-zA-Z0-9])", ""),
    (r"(?<=[a-zA-Z0-9])\s+(?=[\u4e00-\u9fff])", ""),
    (r"(?<![0-9])\s*([,.!?:;])\s*", r"\1 "),
    (r"(?<=[0-9])(?=[a-zA-Z])", " "),
    (r"(?<=[a-zA-Z])(?=[0-9])", " "),
    (r"\s+", " "),
]
_HALF = {0x3000: 0x20, **{c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}, ord("\u3001"): ","}


def plain_value(text: str) -> str:
    """Half-width signs, and blanks as SPACING has them."""
    text = text if text.isascii() else text.translate(_HALF)
    for pattern, to in SPACING[3:] if text.isascii() else SPACING:
        text = re.sub(pattern, to, text)
    return text


def canonical(form, clean=None):
    """A form with its fields in order, every value a list of texts or of forms, and
    without what is empty.  Lists that hold more than forms keep their texts and numbers;
    ``clean`` is put to texts outside of such lists."""
    if isinstance(form, dict):
        out = {}
        for key in sorted(form, key=lambda k: (len(k), k)):
            value = canonical(form[key], clean)
            if value:
                out[key] = value if isinstance(value, list) else [value]
        return out
    if isinstance(form, list):
        if all(isinstance(x, dict) for x in form):
            return [y for x in form if (y := canonical(x, clean))]
        return [s for x in form if type(x) in (str, int, float) and (s := str(x).strip())]
    return [(clean(form) if clean and isinstance(form, str) else str(form)).strip()]


def field_pairs(form: dict) -> Counter:
    """(path of names, text) pairs of a canonical form, as a multiset."""
    out: Counter = Counter()
    todo = [("", form)]
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict):
            todo += [(f"{path}.{k}" if path else k, v) for k, v in value.items()]
        elif isinstance(value, list):
            todo += [(path, v) for v in value]
        else:
            out[path, value] += 1
    return out


def _flat(form: dict) -> tuple[list[tuple[str, bool]], list[int]]:
    """Nodes (label, whether a text) of a canonical form in post-order, and for each its
    leftmost leaf."""
    nodes: list[tuple[str, bool]] = []
    left: list[int] = []

    def walk(label, value):
        first = None
        for child in [*value.items()] if isinstance(value, dict) else [(None, x) for x in value]:
            if child[0] is not None:
                start = walk(*child)
            elif isinstance(child[1], dict):
                start = walk("<subtree>", child[1])
            else:
                nodes.append((child[1], True))
                left.append(len(nodes) - 1)
                start = left[-1]
            first = start if first is None else first
        nodes.append((label, False))
        left.append(len(nodes) - 1 if first is None else first)
        return left[-1]

    walk("<root>", form)
    return nodes, left


def _weight(node: tuple[str, bool]) -> int:
    """What it costs to put a node in or out: a text its characters, others 1."""
    return len(node[0]) if node[1] else 1


def _change(a: tuple[str, bool], b: tuple[str, bool]) -> int:
    """What it costs to make one node of another: texts by their edit distance, names 0
    or 1, a text of a name its characters and 1."""
    if a[1] and b[1]:
        return 0 if a[0] == b[0] else edit_distance(a[0], b[0])
    if a[1] != b[1]:
        return 1 + len(a[0] if a[1] else b[0])
    return int(a[0] != b[0])


def form_distance(x: dict, y: dict) -> int:
    """Cheapest edits from one canonical form to another, as ordered trees: forests are
    compared between pairs of key roots, in post-order."""
    (a, la), (b, lb) = _flat(x), _flat(y)
    whole = [[0] * len(b) for _ in a]
    costs: dict = {}
    roots_a, roots_b = ([max(i for i, v in enumerate(left) if v == leaf) for leaf in sorted(set(left))] for left in (la, lb))
    for i in sorted(roots_a):
        for j in sorted(roots_b):
            p, q = la[i], lb[j]
            table = [[0] * (j - q + 2) for _ in range(i - p + 2)]
            for s in range(i - p + 1):
                table[s + 1][0] = table[s][0] + _weight(a[p + s])
            for t in range(j - q + 1):
                table[0][t + 1] = table[0][t] + _weight(b[q + t])
            for s in range(p, i + 1):
                for t in range(q, j + 1):
                    best = min(table[s - p][t - q + 1] + _weight(a[s]), table[s - p + 1][t - q] + _weight(b[t]))
                    if la[s] == p and lb[t] == q:
                        if (cost := costs.get((a[s], b[t]))) is None:
                            cost = costs[a[s], b[t]] = _change(a[s], b[t])
                        best = whole[s][t] = min(best, table[s - p][t - q] + cost)
                    else:
                        best = min(best, table[la[s] - p][lb[t] - q] + whole[s][t])
                    table[s - p + 1][t - q + 1] = best
    return whole[-1][-1]


def form_accuracy(said: str | None, gold: str | None) -> float:
    """1 less the edits between two forms over what it takes to write the gold one; 0 at
    least.  What is no form is an empty one; an empty gold form is met by an empty one
    alone."""
    x, y = canonical(parsed(said), plain_value), canonical(parsed(gold), plain_value)
    if x == y:
        return 1.0
    size = sum(map(_weight, _flat(y)[0])) - 1  # all but the root, which an empty form has
    return max(0.0, 1 - form_distance(x, y) / size) if size else 0.0


def regrouped(text: str | None) -> str:
    """The canonical form as JSON; an empty object for what is no form."""
    return json.dumps(canonical(parsed(text)), ensure_ascii=False)


def _fields(said: str | None, gold: str | None) -> list[tuple[str, int, int]]:
    """(field, pairs in both, pairs missed or invented) of two forms."""
    x, y = (field_pairs(canonical(parsed(t), plain_value)) for t in (said, gold))
    both, off = x & y, (x - y) + (y - x)
    out: dict[str, list[int]] = {}
    for k, found in enumerate((both, off)):
        for (field, _), n in found.items():
            out.setdefault(field, [0, 0])[k] += n
    return [(f, *v) for f, v in sorted(out.items())]


@F.pandas_udf(T.DoubleType())
def tree_accuracy(said, gold):
    """``form_accuracy`` of two columns."""
    return said.combine(gold, form_accuracy).astype(float)


@F.pandas_udf(T.StringType())
def canonical_json(text):
    """``regrouped`` of a column."""
    return text.map(regrouped)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("field", T.StringType()), T.StructField("both", T.LongType()), T.StructField("off", T.LongType())])))
def field_counts(said, gold):
    """Each field of two columns of forms with the pairs that both have and those that
    one has."""
    return said.combine(gold, _fields)


#: Fixed value: keeps an empty share from a division by 0.
LITTLE = 1e-6


def _f1(both, off):
    return both / (both + off / 2 + LITTLE)


def form_report(df: DataFrame, said: str, gold: str, by: list[str] | None = None) -> DataFrame:
    """(by, forms, f1, accuracy): micro F1 over the fields of all forms and the mean of
    their tree-edit accuracies."""
    by = by or []
    counts = F.aggregate(field_counts(said, gold), F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("o")), lambda a, x: F.struct((a["b"] + x["both"]).alias("b"), (a["o"] + x["off"]).alias("o")))
    rows = df.select(*by, counts.alias("_c"), tree_accuracy(said, gold).alias("_a"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("forms"), _f1(F.sum("_c.b"), F.sum("_c.o")).alias("f1"), (F.sum("_a") / (F.count(F.lit(1)) + LITTLE)).alias("accuracy"))


def field_report(df: DataFrame, said: str, gold: str) -> DataFrame:
    """(field, both, off, f1) of every field of a set of forms."""
    rows = df.select(F.explode(field_counts(said, gold)).alias("x")).groupBy("x.field").agg(F.sum("x.both").alias("both"), F.sum("x.off").alias("off"))
    return rows.withColumn("f1", _f1(F.col("both"), F.col("off")))
