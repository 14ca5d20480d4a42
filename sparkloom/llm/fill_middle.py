"""Fill-in-the-middle: documents cut into prefix, middle and suffix by units.

A unit grammar is a list of pairs of neighbouring character classes; between two
such neighbours a unit ends.  It becomes one zero-width regex of lookarounds, so
Spark's ``split`` cuts a text there and keeps every character of it.  The empty
text, which ``split`` would give one empty piece, has no unit.

A text is split in blocks of BLOCK code points, each with its left neighbour in
front, so a task holds the pieces of one block at a time however long the text
is.  DataFrame functions only, and nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points that are in pieces at once.
BLOCK = 1 << 16

#: Unit grammars: (class of the last character, class of the next unit's first).
GRAMMARS = {
    "char": [(".", ".")],
    "word": [(r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]")],
    "line": [(r"\n", ".")],
    "sentence": [(r"[.!?。！？]", r"[\x20\x09-\x0D]")],
    "symbol": [("[A-Za-z0-9_]", "[^A-Za-z0-9_]"), ("[^A-Za-z0-9_]", ".")],
}

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


def boundary(grammar: str | list[tuple[str, str]]) -> str:
    """The regex that matches, without width, where a unit of the grammar ends.
    Classes match one code point each; a left class must not depend on what
    stands before it."""
    pairs = GRAMMARS[grammar] if isinstance(grammar, str) else grammar
    return "(?s)" + "|".join(f"(?<={left})(?={right})" for left, right in pairs)


def blocks_of(text: Column) -> Column:
    """The text in blocks of BLOCK code points, all but the first with the code
    point before them; none for the empty text."""
    last = F.floor((F.length(text) - 1) / BLOCK).cast("int")
    size = F.lit(BLOCK)
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.when(i == 0, F.substr(text, F.lit(1), size)).otherwise(F.substr(text, i * BLOCK, size + 1)))
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>"))


def _place(counts: Column, units: Column) -> Column:
    """(block, pieces): where ``units`` units end, as a block's number and its
    pieces up to there."""
    start = F.struct(F.lit(0).alias("block"), units.cast("int").alias("pieces"), F.lit(False).alias("found"))

    def step(a, c):
        found = a["found"] | (a["pieces"] <= c)
        return F.struct(F.when(found, a["block"]).otherwise(a["block"] + 1).alias("block"), F.when(found, a["pieces"]).otherwise(a["pieces"] - c).alias("pieces"), found.alias("found"))

    return F.aggregate(counts, start, step)


def _length(pieces: Column, n: Column) -> Column:
    return F.length(F.array_join(F.slice(pieces, 1, n), ""))


def cut_places(df: DataFrame, grammar: str | list[tuple[str, str]], first, second) -> DataFrame:
    """``df`` (text, never null; no column of it starts with ``_``) with ``_n``, its
    units, and the code points ``_a`` and ``_b`` before the ends of ``first(n)`` and
    ``second(n)`` units, 0 <= first <= second <= n."""
    regex = boundary(grammar)
    df = df.withColumn("_chars", F.length("text")).withColumn("_blocks", blocks_of(F.col("text")))
    df = df.withColumn("_counts", F.transform("_blocks", lambda b: F.size(F.split(b, regex, -1)) - 1))
    df = df.withColumn("_n", F.aggregate("_counts", F.when(F.col("_chars") > 0, 1).otherwise(0).cast("long"), lambda a, c: a + c))
    df = df.withColumn("_u", first(F.col("_n"))).withColumn("_v", second(F.col("_n")))
    df = df.withColumn("_p", _place(F.col("_counts"), F.col("_u"))).withColumn("_q", _place(F.col("_counts"), F.col("_v")))
    inner_u, inner_v = [(F.col(c) > 0) & (F.col(c) < F.col("_n")) for c in ("_u", "_v")]
    one_block = inner_u & inner_v & (F.col("_p.block") == F.col("_q.block"))

    def offset(place, length):
        return F.col(f"{place}.block") * BLOCK - F.when(F.col(f"{place}.block") > 0, 1).otherwise(0) + length

    def pieces(place):
        return F.split(F.get("_blocks", F.col(f"{place}.block")), regex, -1)

    # Both cuts of one block share its split.
    both = F.transform(F.array(pieces("_p")), lambda x: F.struct(_length(x, F.col("_p.pieces")).alias("a"), F.when(one_block, _length(x, F.col("_q.pieces"))).alias("b")))
    df = df.withColumn("_both", F.when(inner_u, F.get(both, F.lit(0))))
    a = F.when(F.col("_u") <= 0, 0).when(F.col("_u") >= F.col("_n"), F.col("_chars")).otherwise(offset("_p", F.col("_both.a")))
    b = F.when(F.col("_v") <= 0, 0).when(F.col("_v") >= F.col("_n"), F.col("_chars")).otherwise(offset("_q", F.when(one_block, F.col("_both.b")).otherwise(_length(pieces("_q"), F.col("_q.pieces")))))
    return df.withColumn("_a", a.cast("long")).withColumn("_b", b.cast("long")).drop("_blocks", "_counts", "_p", "_q", "_both")


def draws(seed: str, key: Column) -> list[Column]:
    """Four numbers below 2^32: the first digits, in eights, of the hex sha256 of
    seed, colon and key in decimal (null: nothing)."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def filled(docs: DataFrame, grammar: str | list[tuple[str, str]] = "char", seed: str = "1", plain: int = 10, spm: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, restored) for each row
    of ``docs`` (doc_id, text).

    ``n`` units are cut at two seeded places: u and v of 0..n by the draws of the
    id.  Of 100 documents ``plain`` stay as they are, as do empty ones and those
    that hold a mark; of 100 others ``spm`` have the suffix first.  ``restored`` is
    the text put together again from ``output`` and ``form`` alone.  Null text is
    empty and stays so; a null id draws as the empty key; repeated rows are rows of
    their own and get equal cuts if id and text are equal; an empty table gives
    none; other columns are passed over.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d1, d2, d3, d4 = draws(seed, F.col("doc_id"))
    df = docs.select(F.col("doc_id"), text.alias("text")).withColumn("_d", F.array(d1, d2, d3, d4))
    one, two = (lambda n: F.col("_d")[0] % (n + 1)), (lambda n: F.col("_d")[1] % (n + 1))
    df = cut_places(df, grammar, lambda n: F.least(one(n), two(n)), lambda n: F.greatest(one(n), two(n)))
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains(F.col("text"), F.lit(m))
    form = F.when((F.col("_chars") == 0) | marked | (F.col("_d")[2] % 100 >= 100 - plain), "plain").when(F.col("_d")[3] % 100 < spm, "spm").otherwise("psm")
    df = df.withColumn("form", form)
    at, to = F.col("_a").cast("int"), F.col("_b").cast("int")
    prefix, middle, suffix = F.substr("text", F.lit(1), at), F.substr("text", at + 1, to - at), F.substr("text", to + 1)
    p, s, m = (F.lit(x) for x in marks)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))
    shaped = F.col("form") != "plain"
    df = df.select("doc_id", F.col("_n").alias("n"), "form", F.when(shaped, F.col("_a")).alias("prefix_chars"), F.when(shaped, F.col("_b") - F.col("_a")).alias("middle_chars"), output.alias("output"))
    return df.withColumn("restored", restored(F.col("output"), F.col("form"), marks))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text of an output: no part holds a mark, and no mark overlaps another,
    so the output falls apart at the marks."""
    parts = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    whole = F.when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(F.concat(parts[1], parts[3], parts[2]))
    return F.when(form == "plain", output).otherwise(whole)
