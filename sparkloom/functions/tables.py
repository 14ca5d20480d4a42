"""Answers about tables, forms and code: denotations, amounts with units, fields.

Each rule is a plain function of texts and an Arrow-batched UDF over columns.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Quotes and dashes of one kind; what goes at a text's end, again and
# again: citations and marks, parentheses, quotes around the whole.
ALIKE = [("[‘’´`]", "'"), ("[“”]", '"'), ("[‐‑‒–—−]", "-")]
ENDINGS = [(r"((?<!^)\[[^\]]*\]|\[\d+\]|[•♦†‡*#+])*$", ""), (r"(?<!^)( \([^)]*\))*$", ""), (r'^"([^"]*)"$', r"\1")]
# Words that stand for units, and what scales write.
UNIT_WORDS = ["dollar", "gallons", "square feet", "shares", "mbtu", "mbpd", "mbbls", "mmbtu", "unit", "gwh", "year", "mmcf", "mile", "mboe"]
SCALES = [(r" ?\bthousand\b", "e3"), (r" ?\bmillion\b", "e6"), (r" ?\bbillion\b", "e9"), (r" ?%", "e-2")]


def plain_text(text: str | None) -> str:
    """Lower case without accents, citations, closing parentheses, outer quotes, a final
    dot and repeated blanks."""
    text = text or ""
    if text.isascii():
        text = text.replace("`", "'")
    else:
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn")
        for pattern, to in ALIKE:
            text = re.sub(pattern, to, text)
    before = None
    while text != before:
        before = text
        for pattern, to in ENDINGS:
            text = re.sub(pattern, to, text.strip())
    return re.sub(r"\s+", " ", text.removesuffix(".")).lower().strip()


def _number(text: str):
    for kind in (int, float):
        try:
            x = kind(text)
        except ValueError:
            continue
        return x if math.isfinite(x) else None
    return None


def _date(text: str):
    parts = text.lower().split("-")
    if len(parts) != 3:
        return None
    unknown = ({"xx", "xxxx"}, {"xx"}, {"xx"})
    try:
        y, m, d = (-1 if p in u else int(p) for p, u in zip(parts, unknown, strict=True))
    except ValueError:
        return None
    fits = (y, m, d) != (-1, -1, -1) and (m == -1 or 1 <= m <= 12) and (d == -1 or 1 <= d <= 31)
    return (y, m, d) if fits else None


def denotation(text: str) -> tuple:
    """(kind, key, plain text): a number, a date with -1 for what it leaves open, a year
    alone being a number, or a text."""
    normal, number, date = plain_text(text), _number(text), None
    if number is None:
        date = _date(text)
        if date and date[1:] == (-1, -1):
            number = date[0]
    if number is not None:
        return "number", round(number) if abs(number - round(number)) < 1e-6 else number, normal
    return ("date", date, normal) if date else ("text", normal, normal)


@lru_cache(maxsize=4096)
def _short_denotation(text: str) -> tuple:
    return denotation(text)


def same_denotations(gold: str | None, said: str | None, kinds: bool = False) -> bool:
    r"""Whether two lists, parted by bars (\p is a bar, \n a line end), hold equally many
    different values and each gold one has its like.  Null counts as empty.  A number and
    a text that have one plain form ("1.0" and "1.0.") are alike unless ``kinds`` is set:
    then values of two kinds never are."""

    def values(text):
        items = [re.sub(r"\\([np\\])", lambda m: {"n": "\n", "p": "|", "\\": "\\"}[m[1]], x) if "\\" in x else x for x in (text or "").split("|")]
        return list({v[:2]: v for v in (_short_denotation(x) if len(x) <= 64 else denotation(x) for x in items)}.values())

    def alike(a, b):
        if a[2] == b[2] and (a[0] == b[0] or not kinds):
            return True
        return a[0] == b[0] and (abs(a[1] - b[1]) < 1e-6 if a[0] == "number" else a[1] == b[1])

    x, y = values(gold), values((said or "").replace("||", "|"))
    return len(x) == len(y) and all(any(alike(a, b) for b in y) for a in x)


def amounts(text: str | None) -> tuple:
    """(amount, amount without its scale): thousand, million, billion and percent signs
    scale it, unit words and signs of money go; texts where one is no number."""
    text = re.sub(r"[\$\(\),]", "", plain_text(text))
    text = re.sub(r"\b(" + "|".join(UNIT_WORDS) + r")s?\b", "", text, flags=re.IGNORECASE)
    bare = text
    for pattern, to in SCALES:
        text, bare = re.sub(pattern, to, text), re.sub(pattern, "", bare)
    try:
        return float(text), float(bare)
    except ValueError:
        return text, bare


def reindented(code: str | None) -> str | None:
    """Python lines whose indentation was lost: one step in behind a colon, one out
    before except, elif, else and finally; blank lines go.  No further formatting."""
    if code is None:
        return None
    out, depth = [], 0
    for line in filter(None, map(str.strip, code.split("\n"))):
        if line.startswith(("except", "elif", "else", "finally")):
            depth = max(0, depth - 1)
        out.append("    " * depth + line)
        depth += line.endswith(":")
    return "\n".join(out).strip()


def field_counts(said: str | None, gold: str | None) -> list[int]:
    """[shared, missed or invented] (path, value) pairs of two JSON forms, as multisets; what
    is no JSON object has none."""

    def pairs(text):
        out = Counter()

        def walk(v, path):
            if isinstance(v, dict):
                for k, x in v.items():
                    walk(x, f"{path}.{k}" if path else k)
            elif isinstance(v, list):
                for x in v:
                    walk(x, path)
            else:
                out[path, str(v).strip()] += 1

        try:
            found = json.loads(text or "")
        except ValueError:
            return out
        if isinstance(found, dict):
            walk(found, "")
        return out

    x, y = pairs(said), pairs(gold)
    both = sum((x & y).values())
    return [both, sum(x.values()) + sum(y.values()) - 2 * both]


@F.pandas_udf(T.BooleanType())
def denotation_match(gold, said):
    return gold.combine(said, same_denotations).astype(bool)


@F.pandas_udf(T.BooleanType())
def denotation_match_by_kind(gold, said):
    """``same_denotations`` of two columns, numbers never like texts."""
    return gold.combine(said, lambda g, s: same_denotations(g, s, kinds=True)).astype(bool)


@F.pandas_udf(T.StructType([T.StructField("exact", T.BooleanType()), T.StructField("relieved", T.BooleanType())]))
def amount_match(gold, said):
    """Whether amounts agree, and whether they do with or without their scales."""
    import pandas as pd

    pairs = [(amounts(g), amounts(s)) for g, s in zip(gold, said, strict=True)]
    return pd.DataFrame({"exact": [g[0] == s[0] for g, s in pairs], "relieved": [any(a == b for a in g for b in s) for g, s in pairs]}, dtype=bool)


@F.pandas_udf(T.StringType())
def repaired_code(code):
    return code.map(reindented, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _field_counts(said, gold):
    return said.combine(gold, field_counts)


def form_f1(df: DataFrame, said: str, gold: str, by: list[str] | None = None) -> DataFrame:
    """Micro F1 of the fields of JSON forms, over all forms of a group; 0 without fields."""
    c = df.select(*(by or []), _field_counts(said, gold).alias("c"))
    both, off = F.sum(F.col("c")[0]), F.sum(F.col("c")[1])
    return c.groupBy(*(by or [])).agg(F.coalesce(2 * both / F.nullif(2 * both + off, F.lit(0)), F.lit(0.0)).alias("f1"))


def python_code(text: Column) -> Column:
    """The last Python block of the last code tags of a turn, or null."""
    last = F.try_element_at(F.regexp_extract_all(text, F.lit("(?s)<code>(.*?)</code>"), 1), F.lit(-1))
    return F.try_element_at(F.regexp_extract_all(last, F.lit(r"(?s)```python\s*\n(.*?)\n```"), 1), F.lit(-1))


def json_block(text: Column) -> Column:
    """The JSON of a fenced block, or the whole text, on one line."""
    inner = F.regexp_extract(text, "(?s)```json(.*?)```", 1)
    return F.replace(F.regexp_replace(F.when(inner != "", inner).otherwise(text), r"^\s+|\s+\z", ""), F.lit("\n"), F.lit(""))
