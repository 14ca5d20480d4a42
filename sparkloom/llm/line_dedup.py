"""Line dedup: segment-partition edit join.

Two lines within t edits share, unchanged and near its place, one of the t + 1
segments that the shorter is cut into; t is a tenth of the shorter line's code
points, EDITS at most.  Segments of all distinct lines are indexed by (length,
segment number, hash) and probed with the few substrings of each line that can be
such a segment.  Of the lines that share a key each is first compared with one
leader of the key only; then all pairs that this left in different classes are.
Counts of common characters and parities of character pairs, which few edits can
hardly change, rule nearly all of them out, and a banded bit-parallel edit distance
verifies the rest.  DataFrame functions only.

Copies of a line are one distinct line, found by a partial aggregate first, so a
line that is everywhere costs no more than another, and a group of lines that are
all alike costs one comparison for each.  Texts of lines are only fetched for
lines that share a key; all else is hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, dropped, fresh_name, id_bitmap, with_possible, written

EDITS = 2
#: Code points of the shorter line for each edit that is allowed.
CHARS_AN_EDIT = 10
#: Code points that trimming leaves of a line.
LEAST = 8
#: Lines of a key that are paired in one block.
BLOCK = 512
#: Characters whose counts modulo 4 are compared: a replaced character changes two
#: counts by one, one put in or left out changes one.
PARITY = "etaoinshrdlucmfwypvbgk.,"
#: What a blank line may hold.
BLANKS = r"' \t\n\u000b\f\r'"


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line) of ``docs`` (doc_id, text), cut at line feeds; null text
    is empty, and an empty one has one empty line."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")).alias("pos", "line"))


def keyed(lines: DataFrame, edits: int) -> DataFrame:
    """``lines`` (line, n, others) with arrays own, the keys of a line's own
    segments, and other, those of the substrings that may be a segment of a line
    that is d code points shorter, for each d up to ``edits``.  Segments are even,
    the last ones longer by one.  Segment i can have moved by at most i edits
    before it, and by what is left of the edits after it.  Keys that a line's
    length does not allow are null.

    The lambda around n keeps the last step out of whole-stage code: in its one
    method the keys would be more than the JVM compiles.
    """
    # For each shorter length: its edits, segments, their size and the first longer one.
    t = {f"t{d}": F.expr(f"least({edits}, (n - {d}) div {CHARS_AN_EDIT})") for d in range(edits + 1)}
    q = {f"q{d}": F.expr(f"(n - {d}) div (t{d} + 1)") for d in range(edits + 1)}
    r = {f"r{d}": F.expr(f"t{d} + 1 - (n - {d}) % (t{d} + 1)") for d in range(edits + 1)}
    # The part of the line that holds a segment and its moves: found once, cut from often.
    o = {f"o{i}": F.expr(f"if(n < {2 * edits * CHARS_AN_EDIT}, 0, {i} * q0 - {edits + 2})") for i in range(1, edits + 1)}
    p = {f"p{i}": F.expr(f"substring(line, o{i} + 1, if(n < {2 * edits * CHARS_AN_EDIT}, n, q0 + {4 * edits + 8}))") for i in range(1, edits + 1)}
    names = lines.columns
    own, other = [], []
    for d in range(edits + 1):
        for i in range(edits + 1):
            text, at = (f"p{i}", f" - o{i}") if i else ("line", "")
            for move in range(-i, i + 1):
                least = max(1, d, i, d + i - move, move - d + i)
                if least <= edits:
                    cut = f"substring({text}, 1 + {i} * q{d} + greatest(0, {i} - r{d}) + {move}{at}, q{d} + if({i} >= r{d}, 1, 0))"
                    (other if d or move else own).append(f"if(t{d} >= {least}, xxhash64(n - {d}, {i}, {cut}), null)")
    lines = lines.withColumns(t).withColumns(q | r).withColumns(o).withColumns(p)
    names = [F.transform(F.array("n"), lambda x: x)[0].alias("n") if c == "n" else F.col(c) for c in names]
    return lines.select(*names, F.expr(f"array({', '.join(own)})").alias("own"), F.expr(f"array({', '.join(other)})").alias("other"))


def marks() -> list[Column]:
    """Columns q, g and h of a line.  Bit k of q is the lowest bit of the count of the
    k-th character of PARITY, bit k + len(PARITY) the second one.  g and h are parities
    of 128 classes of pairs of neighbouring characters, the last with the end."""
    counts = ", ".join(f"length(line) - length(replace(line, '{c}', ''))" for c in PARITY)
    q = f"aggregate(transform(array({counts}), (c, k) -> shiftleft(cast(c & 1 as bigint), k) | shiftleft(cast(c & 2 as bigint), k + {len(PARITY) - 1})), 0L, (x, y) -> x | y)"
    pairs = "transform(array(split(line, '')), s -> transform(s, (c, i) -> xxhash64(c, get(s, i + 1))))[0]"
    half = "aggregate(p, 0L, (x, y) -> x ^ if(y & 64 = {bit}, shiftleft(1L, cast(y & 63 as int)), 0L))"
    both = f"transform(array({pairs}), p -> array({half.format(bit=0)}, {half.format(bit=64)}))[0]"
    return [F.expr(q).alias("q"), F.expr(f"{both}[0]").alias("g"), F.expr(f"{both}[1]").alias("h")]


def _maybe_near(t: str) -> str:
    """SQL: whether ``marks`` and lengths n of two lines, a and b, allow t edits.  Of these
    as many as the lengths differ by, or more, put in or leave out: each changes counts
    by one and three pairs at most, a replacement counts by two and four pairs."""
    full = (1 << len(PARITY)) - 1
    odd = f"((qa ^ qb) & {full}L)"
    return f"""abs(na - nb) <= {t}
      and bit_count({odd}) + 2 * bit_count(shiftright(qa ^ qb, {len(PARITY)}) & {full}L & ~{odd}) <= 2 * {t} - abs(na - nb)
      and bit_count(ga ^ gb) + bit_count(ha ^ hb) <= 4 * {t} - abs(na - nb)"""


def _distance(a: str, b: str, edits: int) -> str:
    """SQL of the edit distance of two columns of at least 2 * edits + 2 code points, the
    first not the shorter, exact up to ``edits`` and larger beyond: a band of the
    matrix's diagonals is kept as vertical differences in two words of 2 * edits
    + 2 bits and moves one column at a time."""
    w = 2 * edits + 2
    full = (1 << w) - 1
    top = w - 1
    match = " | ".join(f"case when get(s, i + {edits + 1 - w + t}) = c then {1 << t} else 0 end" for t in range(w))
    # One column: x matches, d0 diagonal zeros, hp and hn horizontal differences.
    d0 = f"(((((x & acc.vp) + acc.vp) ^ acc.vp) | x | acc.vn) & {full})"
    step = f"""
      transform(array(struct(cast({match} as int) as x)), m -> transform(array({d0.replace("x ", "m.x ").replace("(m.x &", "(m.x &")}), d0 ->
        transform(array(struct((acc.vn | (~(d0 | acc.vp))) & {full} as hp, d0 & acc.vp as hn)), h -> struct(
          (h.hn | (~(shiftright(d0, 1) | h.hp))) & {full} as vp,
          shiftright(d0, 1) & h.hp as vn,
          acc.d + case when i < size(s) - {edits} then 1 - (shiftright(d0, {top}) & 1)
                       else case when (h.hp & acc.mask) <> 0 then 1 when (h.hn & acc.mask) <> 0 then -1 else 0 end end as d,
          case when i < size(s) - {edits} then acc.mask else shiftright(acc.mask, 1) end as mask))[0])[0])[0]"""
    start = f"struct({(full << (w - edits - 1)) & full} as vp, 0 as vn, {edits} as d, {1 << (w - 2)} as mask)"
    body = step.replace("get(s, i", "get(s, u.i").replace(" = c then", " = u.c then").replace("case when i <", "case when u.i <")
    return f"case when length({a}) - length({b}) > {edits} then {edits + 1} else transform(array(split({a}, '')), s -> aggregate(transform(split({b}, ''), (c, i) -> struct(c as c, i as i)), {start}, (acc, u) -> {body}, acc -> acc.d))[0] end"


def _trimmed(a: str, b: str) -> str:
    """SQL of struct(la, lb): two lines without most of what both start or end
    with, which leaves the edit distance as it is; LEAST code points stay of the
    second, the shorter one."""
    step = f"""
      (p, k) -> transform(array(length(p.lb) div if(k % 5 < 3, 2, 3)), h -> case
        when length(p.lb) - h < {LEAST} then p
        when k < 5 and left(p.la, h) = left(p.lb, h) then struct(substring(p.la, h + 1) as la, substring(p.lb, h + 1) as lb)
        when k >= 5 and right(p.la, h) = right(p.lb, h) then struct(left(p.la, length(p.la) - h) as la, left(p.lb, length(p.lb) - h) as lb)
        else p end)[0]"""
    return f"aggregate(sequence(0, 9), struct({a} as la, {b} as lb), {step})"


def _links(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """(u, v) of ``pairs`` (a, b) whose edit distance is small enough."""
    of = lambda x: texts.select(F.col("lid").alias(x), F.col("line").alias("l" + x), *[F.col(c).alias(c + x) for c in "nqgh"])
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("t", F.expr(f"least({edits}, least(na, nb) div {CHARS_AN_EDIT})"))
    both = both.where(_maybe_near("t"))
    both = both.select("a", "b", "t", F.expr("if(na >= nb, la, lb)").alias("la"), F.expr("if(na >= nb, lb, la)").alias("lb"))
    near = f"transform(array({_trimmed('la', 'lb')}), p -> {_distance('p.la', 'p.lb', edits)})[0] <= t"
    return both.where(near).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _shared(lines: DataFrame) -> DataFrame:
    """(key, lid, own) of the lines that share a key with another line, one of the
    two having it in the index; own: whether this line has."""
    own = lines.select("lid", F.explode("own").alias("key")).where("key is not null")
    every = lines.select("lid", F.explode(F.concat("own", "other")).alias("key")).where("key is not null")
    other = own.select(F.col("lid").alias("y"), F.col("key").alias("k"))
    hits = written(every.join(other, (F.col("key") == F.col("k")) & (F.col("lid") != F.col("y")), "left_semi").distinct(), "hits")
    keys = hits.select("key").distinct()
    mine = with_possible(own, "key", written(id_bitmap(keys, "key"), "bitmap"), "_maybe").where("_maybe").join(keys, "key", "left_semi")
    return mine.select("key", "lid", F.lit(True).alias("own")).union(hits.select("key", "lid", F.lit(False))).groupBy("key", "lid").agg(F.max("own").alias("own"))


def line_classes(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(h1, h2, first_doc, first_pos, near) of each distinct line that is not blank
    and comes up again or is linked to another: the place where its class comes up
    first, and whether the class holds more than copies.

    A class holds copies and what chains of small edits reach.  A line is known by
    128 bits of hash, links by numbers of lines.
    """
    if 2 * edits + 2 > LEAST:
        raise ValueError(f"edits must be at most {LEAST // 2 - 1}")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "pos")
    lines = keyed(_hashed(docs).where("n is not null"), edits).select("h1", "h2", place.alias("place"), "n", "own", "other")
    lines = lines.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("cnt"), F.any_value("n").alias("n"), F.any_value("own").alias("own"), F.any_value("other").alias("other"))
    lines = written(lines.withColumn("lid", F.monotonically_increasing_id()), "lines", "snappy")

    mine = written(_shared(lines), "shared")
    lids = mine.select("lid").distinct()
    nodes = with_possible(lines.select("lid", "h1", "h2", "first.doc_id", "first.pos", "cnt"), "lid", written(id_bitmap(lids, "lid"), "bitmap"), "_maybe").where("_maybe").drop("_maybe")
    nodes = written(nodes.join(lids, "lid", "left_semi"), "nodes")
    # Texts of these lines: from the documents where they come up first.
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = with_possible(source, "doc_id", written(id_bitmap(nodes, "doc_id"), "bitmap"), "_maybe").where("_maybe")
    texts = with_possible(_hashed(source), ["h1", "h2"], written(id_bitmap(nodes, "h1", "h2"), "bitmap"), "_maybe").where("_maybe").select("doc_id", "pos", "h1", "h2", "line", "n")
    at = nodes.select("lid", "cnt", F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("doc_id").alias("d"), F.col("pos").alias("p"))
    texts = texts.join(at, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("pos") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d")))
    texts = written(texts.select("lid", "cnt", "line", "n").dropDuplicates(["lid"]).select("*", *marks()), "texts")

    # Each line against one leader of each of its keys: the most frequent line that has it in the index.
    lead = mine.where("own").join(texts.select("lid", "cnt"), "lid").groupBy("key").agg(F.max(F.struct("cnt", F.negative("lid").alias("c"))).alias("top"))
    lead = written(lead.select("key", F.negative("top.c").alias("a")), "lead")
    pairs = mine.join(lead, "key").where("lid <> a").select("a", F.col("lid").alias("b")).distinct()
    stars = written(connected_components(written(_links(pairs, texts, edits), "links")), "stars")
    # Pairs of a key that are still apart.
    rows = mine.join(stars, F.col("lid") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "lid"))
    rows = written(rows.join(texts.select("lid", *"nqgh"), "lid").select("key", "lid", "own", "comp", *"nqgh"), "rows")
    # A key of many lines is dealt out in blocks, so that no task pairs it whole.
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")
    ends = written(rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), blocks).where("lo <> hi").select("key", "blocks"), "ends")
    apart = written(rows.join(ends, "key"), "apart")
    side = lambda x: [F.col("lid").alias(x), F.col("comp").alias("c" + x), *[F.col(c).alias(c + x) for c in "nqgh"]]
    x = apart.where("own").select("key", *side("a"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    y = apart.select("key", *side("b"), F.expr("cast(pmod(xxhash64(lid), blocks) as int)").alias("block"))
    pairs = x.join(y, ["key", "block"]).where(F.expr(f"ca <> cb and {_maybe_near(str(edits))}")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = written(_links(pairs, texts, edits), "links")
    classes = stars
    if not more.isEmpty():
        classes = written(connected_components(stars.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)), "classes")

    maybe = with_possible(lines.select("lid", "h1", "h2", "first", "cnt"), "lid", written(id_bitmap(classes, "node"), "bitmap"), "_maybe")
    linked = maybe.where("_maybe").join(classes, F.col("lid") == F.col("node"), "left").select("h1", "h2", "first", "cnt", F.col("component").alias("class"))
    linked = written(linked, "linked")
    first = linked.where("class is not null").groupBy("class").agg(F.min("first").alias("f"))
    near = linked.join(written(first, "first"), "class").select("h1", "h2", "f", F.lit(True).alias("near"))
    copies = maybe.where("not _maybe").select("h1", "h2", "first", "cnt").union(linked.where("class is null").select("h1", "h2", "first", "cnt")).where("cnt > 1").select("h1", "h2", F.col("first").alias("f"), F.lit(False).alias("near"))
    out = written(near.union(copies).select("h1", "h2", F.col("f.doc_id").alias("first_doc"), F.col("f.pos").alias("first_pos"), "near"), "line_classes")
    for table in (lines, mine, nodes, texts, rows, apart):
        dropped(docs.sparkSession, table)
    return out


def _hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line, n, h1, h2) of all lines; n is null for blank ones."""
    return lines_of(docs).select("doc_id", "pos", "line", F.expr(f"if(ltrim({BLANKS}, line) = '', null, length(line))").alias("n"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def marked_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(doc_id, pos, n, kept, near) of every line: kept where its class comes up
    first, by doc_id (null last) and position; near where the class holds more
    than copies.  n, kept and near are null for blank lines, so for null and empty
    texts.  Rows of equal doc_id count as one document: of lines that are equal
    in id, position and text all are kept or none.  An empty table gives none, a
    very long text or line is dealt with like any other."""
    classes = line_classes(docs, edits)
    lines = with_possible(_hashed(docs).select("doc_id", "pos", "n", "h1", "h2"), ["h1", "h2"], written(id_bitmap(classes, "h1", "h2"), "bitmap"), "_maybe")
    sure = lines.where("not _maybe").select("doc_id", "pos", "n", F.expr("if(n is null, null, true)").alias("kept"), F.expr("if(n is null, null, false)").alias("near"))
    first = F.col("first_doc").eqNullSafe(F.col("doc_id")) & (F.col("first_pos") == F.col("pos"))
    rest = lines.where("_maybe").join(classes, ["h1", "h2"], "left")
    kept = F.when(F.col("n").isNotNull(), F.coalesce(F.when(F.col("near").isNotNull(), first), F.lit(True)))
    return sure.union(rest.select("doc_id", "pos", "n", kept, F.when(F.col("n").isNotNull(), F.coalesce("near", F.lit(False)))))


def without_repeated_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """``docs`` with the lines that are kept, and blank lines, joined again.  The
    columns stay, whatever their names; a text that loses everything is empty, a
    null text stays null."""
    doc, lost = fresh_name(docs, "_doc"), fresh_name(docs, "_gone")
    gone = written(marked_lines(docs, edits).where("not kept").groupBy("doc_id").agg(F.collect_set("pos").alias(lost)).withColumnRenamed("doc_id", doc), "gone")
    out = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col(doc)), "left")
    kept = F.expr(f"array_join(filter(split(text, '\\n'), (x, i) -> not array_contains({lost}, i)), '\\n')")
    return out.withColumn("text", F.when(F.col(lost).isNull(), F.col("text")).otherwise(kept)).select(docs.columns)
