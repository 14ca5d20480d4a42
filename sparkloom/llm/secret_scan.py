"""Secret scans: fixed patterns, and entropy of sliding windows over candidates.

Patterns give the base spans.  A candidate is a run of WINDOW or more token
characters; for each character class its windows are passed over with counts
that change by the one character that enters and the one that leaves, and with
them the sum of c * log2(c), from which the window's Shannon entropy follows.
Windows at or above the class's bits are merged to spans; an allow-list of
shapes suppresses candidates, and spans that overlap a base span are dropped.

DataFrame functions only, and nothing is shuffled.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns (Java's, letters of the first in either case),
#: the group that counts and its least length.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}

#: Characters of a window.
WINDOW = 20

#: Characters of a run whose windows are passed over at once.
BLOCK = 1 << 15

#: Character classes: runs of it, its characters (letters folded where the class
#: takes both cases), least entropy in bits, and what a span must hold besides.
CLASSES = {
    "hexrun": (r"[0-9A-Fa-f]{20,}", "0123456789abcdef", 3.2, ["[0-9]", "[A-Fa-f]"]),
    "base32run": (r"[A-Z2-7]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 3.5, ["[2-7]", "[A-Z]"]),
    "base64run": (r"[A-Za-z0-9+/_-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.9, ["[0-9]", "[A-Z]", "[a-z]"]),
}
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"

#: Candidates that are no secrets: ids in UUID form, paths and slugs of whole words
#: and numbers, runs of an alphabet, and stand-ins of documentation.
ALLOWED = [
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^[/_+-]*([A-Z]?[a-z]+|[A-Z]+|[0-9]+)([/_+-]+([A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[/_+-]*$",
    r"(?i)abcdefgh|01234567|12345678|qwertyui",
    r"(?i)example|placeholder|changeme|dummy|redacted|x{8}",
]
#: What stands before inline data, which is no secret either.
INLINE = "base64,"

#: c * log2(c) in whole units of 2^-20 bit, so sums are exact in any order.
SCALE = 1 << 20


def weights(window: int = WINDOW) -> list[int]:
    return [0, *(round(c * math.log2(c) * SCALE) for c in range(1, window + 1))]


def most(bits: float, window: int = WINDOW) -> int:
    """The largest sum of c * log2(c) that a window of ``bits`` of entropy has."""
    return math.floor((math.log2(window) - bits) * window * SCALE)


_SPANS = "array<struct<start:int,end:int,text:string>>"
_CHUNK = 512


def _running(items: Column, start: Column) -> Column:
    """Spans of ``items`` (gap, text), each ``gap`` code points after the last one's
    end, the first ``gap`` after ``start``."""
    zero = F.struct(start.cast("int").alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(a, x):
        begin = a["at"] + x["gap"]
        end = begin + F.length(x["text"])
        return F.struct(end.alias("at"), F.concat(a["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["text"].alias("text")))).alias("spans"))

    return F.aggregate(items, zero, step)


def found(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Code-point spans (start, end, text) of the leftmost matches of ``pattern``
    in turn whose ``group`` has ``least`` characters: what Spark's ``split`` leaves
    between them gives their places.  Sums run within chunks, so the time grows
    little more than the number of matches."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m):
        items = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(m)), m, lambda p, x: F.struct(F.length(p).alias("gap"), x.alias("text")))
        chunks = F.transform(F.array(items), lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / _CHUNK).cast("int")), lambda i: F.slice(z, i * _CHUNK + 1, F.lit(_CHUNK))))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("parts"))

        def step(a, chunk):
            ran = F.transform(F.array(_running(chunk, a["at"])), lambda r: F.struct(r["at"].alias("at"), F.concat(a["parts"], F.array(r["spans"])).alias("parts")))
            return F.get(ran, F.lit(0))

        return F.flatten(F.aggregate(F.get(chunks, F.lit(0)), zero, step, lambda a: a["parts"]))

    # The array of one binds the matches, so they are looked for once.
    spans = F.get(F.transform(F.array(matches), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(F.array().cast(_SPANS))), F.lit(0))
    if group:
        return F.filter(spans, lambda s: F.length(F.regexp_extract(s["text"], pattern, group)) >= least)
    return spans if least == 0 else F.filter(spans, lambda s: F.length(s["text"]) >= least)


def hot_spans(run: Column, alphabet: str, bits: float, window: int = WINDOW) -> Column:
    """Spans (start, end) of ``run``, characters of ``alphabet``, that windows of at least
    ``bits`` of entropy cover.  A long run goes in blocks whose windows follow each other;
    spans that meet are one."""
    blocks = F.sequence(F.lit(0), F.floor((F.length(run) - 1) / BLOCK).cast("int"))
    moved = lambda i: F.transform(_block_spans(F.substr(run, i * BLOCK + 1, F.lit(BLOCK + window - 1)), alphabet, bits, window), lambda s: F.struct((s["start"] + i * BLOCK).alias("start"), (s["end"] + i * BLOCK).alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def met(a, s):
        last = F.get(a, F.size(a) - 1)
        longer = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["start"].alias("start"), s["end"].alias("end"))))
        return F.when((F.size(a) > 0) & (last["end"] >= s["start"]), longer).otherwise(F.concat(a, F.array(s)))

    return F.aggregate(F.flatten(F.transform(blocks, moved)), none, met)


def _block_spans(run: Column, alphabet: str, bits: float, window: int) -> Column:
    g, k = F.array(*[F.lit(x) for x in weights(window)]), len(alphabet)
    codes = F.transform(F.split(run, "", -1), lambda c: F.instr(F.lit(alphabet), c))
    codes = F.filter(codes, lambda c: c > 0)
    spans_type = "array<struct<start:int,end:int>>"
    zero = F.struct(
        F.lit(0).alias("at"), F.array_repeat(F.lit(0), k).alias("counts"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("held"), F.array().cast(spans_type).alias("spans")
    )

    def step(a, code):
        gone = F.when(a["at"] >= window, F.get(a["held"], F.lit(0))).otherwise(0)
        had, left = F.coalesce(F.get(a["counts"], code - 1), F.lit(0)), F.coalesce(F.get(a["counts"], gone - 1), F.lit(0))
        same = code == gone
        entering = F.get(g, had + 1) - F.get(g, had)
        leaving = F.when(gone > 0, F.get(g, left) - F.get(g, left - 1)).otherwise(0)
        total = a["sum"] + F.when(same, 0).otherwise(entering - leaving)
        counts = F.transform(a["counts"], lambda c, i: c + F.when(i == code - 1, 1).otherwise(0) - F.when(i == gone - 1, 1).otherwise(0))
        end = a["at"] + 1
        hot = (end >= window) & (total <= most(bits, window))
        last = F.get(a["spans"], F.size(a["spans"]) - 1)
        fresh = F.struct((end - window).alias("start"), end.alias("end"))
        longer = F.concat(F.slice(a["spans"], 1, F.size(a["spans"]) - 1), F.array(F.struct(last["start"].alias("start"), end.alias("end"))))
        spans = F.when(~hot, a["spans"]).when((F.size(a["spans"]) > 0) & (last["end"] >= end - window), longer).otherwise(F.concat(a["spans"], F.array(fresh)))
        held = F.concat(F.when(gone > 0, F.slice(a["held"], 2, window)).otherwise(a["held"]), F.array(code))
        return F.struct(end.alias("at"), counts.alias("counts"), total.cast("long").alias("sum"), held.alias("held"), spans.cast(spans_type).alias("spans"))

    return F.aggregate(codes, zero, step, lambda a: a["spans"])


def _named(spans: Column, number: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end")))


def _shown(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans, found) for each row of
    ``docs`` (doc_id, text).

    A span is that of a whole match, in code points from 0, its end exclusive.
    ``found`` has all spans (start, kind, end) with the kind's number; ``base`` and
    ``spans`` show those of the patterns and all as kind:start:end, by start, then
    kind as listed in BASE and CLASSES.  A span of a class is left out where it
    overlaps one of a pattern or of an earlier class.  Null text is empty and has
    none; ids may be null or repeat, and each row is one of its own; an empty
    table gives none; other columns are passed over.  A run of a hundred thousand
    characters is one candidate like any other.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select("doc_id", text.alias("text"))
    kinds = [*BASE, *CLASSES]
    for name, (pattern, group, least) in BASE.items():
        df = df.withColumn("_" + name, found(F.col("text"), pattern, group, least))
    df = df.withColumn("_base", F.concat(*[_named(F.col("_" + k), i) for i, k in enumerate(BASE)]))
    candidates = F.filter(found(F.col("text"), CANDIDATE), lambda s: ~_allowed(s["text"]))
    df = df.withColumn("_found", candidates)
    df = df.withColumn("_found", F.filter("_found", lambda s: ~((s["start"] >= len(INLINE)) & (F.substr(F.col("text"), s["start"] - len(INLINE) + 1, F.lit(len(INLINE))) == INLINE))))
    df = df.withColumn("_all", F.col("_base"))
    for number, name in enumerate(CLASSES, len(BASE)):
        df = df.withColumn("_class", F.when(F.size("_found") > 0, _of_class("_found", name, window)).otherwise(F.array().cast("array<struct<start:int,end:int>>")))
        own = F.filter("_class", lambda s: ~F.exists(F.col("_all"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        df = df.withColumn("_all", F.concat("_all", _named(own, number)))
    counts = [F.size("_" + k).cast("long").alias("n_" + k) for k in BASE]
    return df.select("doc_id", *counts, _shown(F.col("_base"), kinds).alias("base"), _shown(F.col("_all"), kinds).alias("spans"), F.array_sort("_all").alias("found"))


def _allowed(run: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | F.rlike(run, F.lit(pattern))
    return out


def _of_class(candidates: str, name: str, window: int) -> Column:
    """Spans of a class in the text, from the candidates that are left."""
    pattern, alphabet, bits, needs = CLASSES[name]
    folded = alphabet == alphabet.lower()

    def within(c):
        def spans(r):
            hot = hot_spans(F.lower(r["text"]) if folded else r["text"], alphabet, bits, window)

            def whole(s):
                held = [F.rlike(F.substr(r["text"], s["start"] + 1, s["end"] - s["start"]), F.lit(need)) for need in needs]
                return functools.reduce(lambda a, b: a & b, held)

            hot = F.filter(hot, whole)
            return F.transform(hot, lambda s: F.struct((c["start"] + r["start"] + s["start"]).alias("start"), (c["start"] + r["start"] + s["end"]).alias("end")))

        return F.flatten(F.transform(found(c["text"], pattern), spans))

    return F.flatten(F.transform(candidates, within))
