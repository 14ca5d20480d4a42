"""Benchmark decontamination by template canonicalisation.

Words become template words: numbers, names and units are replaced by typed
placeholders, everything else is lower-cased and stripped of punctuation.
Capitalised words at the start of a text, sentence or line are read both ways.
Windows of template words of the benchmark are matched by hash against all
windows of all documents.  Matching windows on neighbouring diagonals (document
position minus item position) are chained, so an item is lined up with a
document across words put in, left out or replaced.  There the slots are
compared, and the line-up counts only if the item's slot values map one-to-one
onto the document's, a few aside, which a re-parameterised question does and
text that merely has numbers in the same places mostly doesn't.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEYS, mixed, row_keys, spans_of, text_buffer, tidy, without_rows, word_bounds, word_hashes, written
from .near_dedup import lowered

WINDOW = 5
COVERED = 0.8
#: Window hashes of a benchmark that are sent to the tasks as one sorted array
#: (8 bytes each); a larger benchmark is joined by a shuffle instead.
MAX_SENT = 2_000_000

#: Consecutive windows with one hash, as within a run of numbers, are one row of up to so
#: many.
RUN = 64

# Words that are units.
UNITS = ("mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec secs min mins h hr hrs day days week weeks month months year years "
         "second seconds minute minutes hour hours meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters "
         "inch inches foot feet yard yards mile miles gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres "
         "dollar dollars cent cents euro euros percent degree degrees usd eur gbp mph kmh km/h % $ € £ °c °f").split()  # fmt: skip

PLAIN, NUMBER, NAME, UNIT, OPEN = range(5)
#: What stands for a word of each kind in a window's hash; OPEN words read as names first.
_SLOTS = np.asarray([0, 0x1111111111111111, 0x2222222222222222, 0x3333333333333333, 0x2222222222222222], np.uint64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?:;"]] = True


def _hash_of(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = word_bounds(raw, np.asarray([0, len(raw)]))
    return np.unique(word_hashes(raw, starts, ends))


_UNIT_HASHES = _hash_of(UNITS)


def template(raw: np.ndarray, own: np.ndarray):
    """Kind and value hash of each word of a span of documents, and the words
    before each document.  A number has an ASCII digit; a unit is in UNITS; a
    name starts with an upper-case ASCII letter and has a lower-case one after
    it.  At a text's start and after the end of a sentence or line such a word
    is OPEN: a name or a plain word."""
    starts, ends, first = word_bounds(raw, own)
    if not len(starts):
        return np.zeros(0, np.uint8), np.zeros(0, np.uint64), first
    low = lowered(raw)
    # Bounds without leading and trailing punctuation; a word of signs alone stays whole.
    n = len(raw)
    solid = _ALNUM[raw]
    here = np.where(solid, np.arange(n), n)
    following = np.minimum.accumulate(here[::-1])[::-1]
    there = np.where(solid, np.arange(n), -1)
    preceding = np.maximum.accumulate(there)
    a, b = following[starts], preceding[ends - 1] + 1
    bare = (a >= ends) | (b <= starts)
    a, b = np.where(bare, starts, a), np.where(bare, ends, b)
    value = word_hashes(low, a, b)

    def count(mask):
        c = np.zeros(n + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[b] - c[a]

    number = count((raw >= 48) & (raw <= 57)) > 0
    unit = np.isin(value, _UNIT_HASHES)
    head, second = raw[a], raw[np.minimum(a + 1, n - 1)]
    name = (head >= 65) & (head <= 90) & (b - a > 1) & (((second >= 97) & (second <= 122)) | (second >= 128))
    after = np.zeros(len(starts), bool)
    after[first[:-1][first[:-1] < len(starts)]] = True
    if len(starts) > 1:
        after[1:] |= _ENDS[raw[ends[:-1] - 1]]
        lines = np.zeros(n + 1, np.int64)
        np.cumsum(raw == 10, out=lines[1:])
        after[1:] |= lines[starts[1:]] > lines[ends[:-1]]
    kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name & after, OPEN, np.where(name, NAME, PLAIN)))).astype(np.uint8)
    return kind, value, first


def windows(kind: np.ndarray, value: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every window that lies within its document, once for
    each reading of its OPEN words as names or plain words."""
    n = len(kind)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = np.where(kind == PLAIN, value, _SLOTS[kind])
    m = n - width + 1
    h, open_ = np.zeros(m, np.uint64), np.zeros(m, np.int64)
    for k in range(width):
        h = h * _STEP + word[k : k + m]
        open_ |= (kind[k : k + m] == OPEN).astype(np.int64) << k
    stop = np.repeat(first[1:], np.diff(first))[:m]
    inside = np.arange(m) + width <= stop
    at, out = [np.flatnonzero(inside)], [h[inside]]
    some = np.flatnonzero(inside & (open_ > 0))
    masks, readings = open_[some], set()
    for mask in np.unique(masks).tolist():
        sub = mask
        while sub:
            readings.add(sub)
            sub = (sub - 1) & mask
    for plain in sorted(readings):
        # The hash is a sum over the words, so a reading differs by its own terms.
        here = some[(masks & plain) == plain]
        g = h[here]
        for k in range(width):
            if plain >> k & 1:
                g += (value[here + k] - _SLOTS[NAME]) * np.uint64(pow(int(_STEP), width - 1 - k, 1 << 64))
        at.append(here)
        out.append(g)
    return np.concatenate(at), mixed(np.concatenate(out))


def runs_of(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, how many, hash) of windows with one hash that start at consecutive
    words, RUN of them at most."""
    if not len(at):
        return at, np.zeros(0, np.int64), h
    order = np.lexsort((at, h))
    at, h = at[order], h[order]
    head = np.ones(len(at), bool)
    head[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
    head |= (np.arange(len(at)) - first) % RUN == 0
    heads = np.flatnonzero(head)
    return at[heads], np.diff(np.append(heads, len(at))), h[heads]


def whole_windows(value: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every window of ``width`` words as they are, without
    placeholders: what an item of so few words is looked for by."""
    m = len(value) - width + 1
    if m < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(m, width, np.uint64)
    for k in range(width):
        h = h * _STEP + value[k : k + m]
    inside = np.flatnonzero(np.arange(m) + width <= np.repeat(first[1:], np.diff(first))[:m])
    return inside, mixed(h[inside] ^ np.uint64(0x0F0F0F0F0F0F0F0F))


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """(item_id, item, item_words, at, many, win, kinds, values): every window of every
    item in each reading, ``many`` with one hash from ``at`` on.  item: a hash of the
    text; kinds, values: all words of the item, in the rows of its first window only.  An
    item of fewer than ``width`` words, but not none, has one window of all its words as
    they are."""

    def run(batches):
        for b in batches:
            raw, offsets = text_buffer(b.column(2))
            ids, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
            out = {k: [] for k in ("item_id", "item", "item_words", "at", "many", "win", "kinds", "values")}
            for i, (key, item) in enumerate(zip(ids, keys, strict=True)):
                part = raw[offsets[i] : offsets[i + 1]]
                kind, value, first = template(part, np.asarray([0, len(part)]))
                where, h = windows(kind, value, first, width) if len(kind) >= width else whole_windows(value, first, max(len(kind), 1))
                where, many, h = runs_of(where, h)
                for at, count, win in zip(where.tolist(), many.tolist(), h.view(np.int64).tolist(), strict=True):
                    out["item_id"].append(key)
                    out["item"].append(item)
                    out["item_words"].append(len(kind))
                    out["at"].append(at)
                    out["many"].append(count)
                    out["win"].append(win)
                    out["kinds"].append(None if at else kind.tobytes())
                    out["values"].append(None if at else value.astype("<u8").tobytes())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("item_id", pa.int64()), ("item", pa.int64()), ("item_words", pa.int32()), ("at", pa.int32()), ("many", pa.int32()), ("win", pa.int64()), ("kinds", pa.binary()), ("values", pa.binary())]))

    schema = "item_id long, item long, item_words int, at int, many int, win long, kinds binary, values binary"
    text = F.col("text").cast("string")
    return items.select(F.col("item_id").cast("long"), F.xxhash64(text).alias("item"), text).mapInArrow(tidy(run), schema)


def document_windows(docs: DataFrame, width: int, short: list[int], wanted: np.ndarray | None) -> DataFrame:
    """(z, id, x1, x2, pos, win, count, start, kinds, values) of the windows of whole
    texts whose hash is in ``wanted`` (None: of all), ``count`` with one hash from ``pos``
    on: the row's keys; kinds, values: the words from ``start`` on, ``width`` before the
    first window to ``width`` after the last one.  Of
    the widths ``short`` the windows of words as they are, each distinct one of a
    document where it comes first, with null kinds and values."""

    def known(h):
        if wanted is None:
            return np.ones(len(h), bool)
        return wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h if len(wanted) else np.zeros(len(h), bool)

    def rows_of(keys, doc, pos, h, count, start, kinds, values):
        own = keys.take(pa.array(doc)) if len(doc) else keys.slice(0, 0)
        return pa.RecordBatch.from_arrays([*own.flatten(), pa.array(pos, pa.int64()), pa.array(h.view(np.int64)), pa.array(count, pa.int32()), pa.array(start, pa.int64()), pa.array(kinds, pa.binary()), pa.array(values, pa.binary())], [*ROW_KEYS, "pos", "win", "count", "start", "kinds", "values"])

    def run(batches):
        for b in batches:
            keys, done = pa.StructArray.from_arrays([b.column(k) for k in range(4)], ROW_KEYS), 0
            raw, offsets = text_buffer(b.column(4))
            for s, e in spans_of(offsets, 1 << 18):
                part, own = raw[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s]
                kind, value, first = template(part, own)
                at, h = windows(kind, value, first, width)
                ok = known(h)
                # Windows of two documents don't follow each other.
                at, count, h = runs_of(at[ok], h[ok])
                doc = np.searchsorted(first, at, side="right") - 1
                lo, hi = np.maximum(at - width, first[doc]), np.minimum(at + count - 1 + 2 * width, first[doc + 1])
                ranges = list(zip(lo.tolist(), hi.tolist(), strict=True))
                kinds, values = [kind[p:q].tobytes() for p, q in ranges], [value[p:q].astype("<u8").tobytes() for p, q in ranges]
                yield rows_of(keys, done + doc, at - first[doc], h, count, lo - first[doc], kinds, values)
                for w in short:
                    at, h = whole_windows(value, first, w)
                    ok = known(h)
                    at, h = at[ok], h[ok]
                    doc = np.searchsorted(first, at, side="right") - 1
                    _, once = np.unique(np.stack([doc.astype(np.uint64), h]), axis=1, return_index=True)
                    at, h, doc = at[once], h[once], doc[once]
                    yield rows_of(keys, done + doc, at - first[doc], h, np.ones(len(at), np.int64), at - first[doc], [None] * len(at), [None] * len(at))
                done += e - s

    schema = "z boolean, id long, x1 long, x2 long, pos long, win long, count int, start long, kinds binary, values binary"
    return docs.select(*[k.alias(n) for k, n in zip(row_keys(docs), ROW_KEYS, strict=True)], F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), schema)


def _chain(match: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """The diagonal (row of ``match``: diagonal, item word) of each item word on the
    best chain: positions ascend in item and document, each matching word counts
    1 and each change of the diagonal costs 1."""
    count, words = match.shape
    # From diagonal j to k: item words that can't be used between them.
    skipped = np.maximum(0, diagonals[:, None] - diagonals[None, :])
    cost = (~np.eye(count, dtype=bool)).astype(np.int64)
    best = np.zeros((words + 1, count), np.int64)
    came = np.zeros((words, count), np.int64)
    own = np.arange(count)
    for i in range(words):
        scores = best[np.maximum(i - skipped, 0), own[:, None]] - cost
        came[i] = scores.argmax(axis=0)
        keep = scores[own, own] >= scores[came[i], own]
        came[i][keep] = own[keep]
        best[i + 1] = scores[came[i], own] + match[:, i]
    out = np.full(words, -1, np.int64)
    i, k = words - 1, int(best[words].argmax())
    while i >= 0:
        out[i] = k
        j = int(came[i, k])
        i, k = i - 1 - int(skipped[j, k]), j
    return out


def _judged(ik: list[int], iv: list[int], dk: list[int], dv: list[int]) -> tuple[int, bool] | None:
    """(covered words, exact) of matched pairs of item and document words, None
    if slot values conflict: an item's value stands for one of the document's and
    the other way round.  Where plain words are at least as many as slots, a
    fifth of the slots may conflict either way, and one value may always take the
    place of a second one too.  A conflicting word isn't covered."""
    there, back, plain, soft, slots = {}, {}, set(), [], 0
    for k, x, y in zip(ik, iv, dv, strict=True):
        if k in (NUMBER, NAME, UNIT):
            slots += 1
            there.setdefault(x, Counter())[y] += 1
            back.setdefault(y, Counter())[x] += 1
        elif x == y:
            plain.add(x)
        else:
            soft.append((x, y))
    same = len(ik) - slots - len(soft)
    forth = sum(c.total() - max(c.values()) for c in there.values())
    reverse = sum(c.total() - max(c.values()) for c in back.values())
    some = slots // 5 if same >= slots else 0
    if forth > some or reverse - forth > (max(1, some) if same >= slots else 0):
        return None
    # OPEN words that differ: a swapped name if that fits, else a swapped plain word.
    stands = {x: c.most_common(1)[0][0] for x, c in there.items()}
    swapped = 0
    for x, y in soft:
        swapped += x not in plain and stands.setdefault(x, y) == y
    exact = not soft and all(set(c) == {x} for x, c in there.items())
    return same + slots - forth + swapped, exact


def _placed(rows: list[dict], kinds: bytes, values: bytes, block: int, covered: float):
    """(coverage, exact, pos) of each place where the hits ``rows`` of a document
    line an item up, on diagonals of the block and the next one."""
    ik, iv = np.frombuffer(kinds, np.uint8), np.frombuffer(values, "<u8")
    low = min(r["start"] for r in rows)
    span = max(r["start"] + len(r["kinds"]) for r in rows) - low
    dk, dv = np.full(span, 255, np.uint8), np.zeros(span, np.uint64)
    for r in rows:
        at = r["start"] - low
        dk[at : at + len(r["kinds"])] = np.frombuffer(r["kinds"], np.uint8)
        dv[at : at + len(r["kinds"])] = np.frombuffer(r["values"], "<u8")
    near = range(block * len(ik), (block + 2) * len(ik))
    diagonals = np.unique(np.concatenate([np.arange(max(near.start, r["pos"] - r["at"] - r["many"] + 1), min(near.stop, r["pos"] - r["at"] + r["count"])) for r in rows]))
    if not len(diagonals):
        return
    p = diagonals[:, None] + np.arange(len(ik)) - low
    inside = (p >= 0) & (p < span)
    p = np.clip(p, 0, span - 1)
    k, v = np.where(inside, dk[p], 255), dv[p]
    named = np.isin(ik, (NAME, OPEN)) & np.isin(k, (NAME, OPEN))
    match = (k != 255) & (named | (iv == v) | ((ik == k) & np.isin(ik, (NUMBER, UNIT))))
    full = match.sum(axis=1)
    lines = [np.full(len(ik), d) for d in np.flatnonzero(full >= covered * len(ik))]
    if len(diagonals) > 1 and full.max() < len(ik):
        lines.append(_chain(match, diagonals))
    for line in lines:
        i = np.flatnonzero((line >= 0) & match[line, np.arange(len(ik))])
        if len(i) < covered * len(ik):
            continue
        d = line[i]
        got = _judged(ik[i].tolist(), iv[i].tolist(), k[d, i].tolist(), v[d, i].tolist())
        if got and got[0] >= covered * len(ik):
            yield got[0] / len(ik), got[1], int(diagonals[d[0]])


def _found(docs: DataFrame, items: DataFrame, width: int, covered: float) -> DataFrame:
    """(z, id, x1, x2, item_id, coverage, pos, exact): places where a row of
    ``docs``, known by its ``row_keys``, holds an item."""
    known = written(item_windows(items, width), "items")
    hashes = known.select("win").distinct()
    if hashes.limit(MAX_SENT + 1).count() <= MAX_SENT:
        rows = hashes.toArrow().column("win").combine_chunks()
        wanted = np.sort(np.asarray(rows, np.int64).view(np.uint64))
    else:
        wanted = None
    short = sorted(r[0] for r in known.where(F.col("item_words") < width).select("item_words").distinct().collect())  # fewer than width numbers
    found = document_windows(docs, width, short, wanted)
    found = written(found, "found") if wanted is not None else found
    lined = found.join(known.select("item_id", "item", "item_words", "at", "many", "win"), "win")
    of = [*ROW_KEYS, "item_id"]
    whole_items = lined.where((F.col("item_words") < width) & F.col("kinds").isNull()).select(*of, F.lit(1.0).alias("coverage"), "pos", F.lit(True).alias("exact"))
    lined = lined.where((F.col("item_words") >= width) & F.col("kinds").isNotNull())
    # Chains of less drift than the item is long lie in two neighbouring blocks of diagonals.
    low, high = F.col("pos") - F.col("at") - F.col("many") + 1, F.col("pos") - F.col("at") + F.col("count") - 1
    blocks = F.sequence(F.floor(low / F.col("item_words")) - 1, F.floor(high / F.col("item_words")))
    lined = lined.select(*of, "item", "item_words", F.explode(blocks).alias("block"), F.struct("pos", "at", "many", "count", "start", "kinds", "values").alias("row"))
    per = lined.groupBy(*of, "item", "item_words", "block").agg(F.collect_set("row").alias("rows"))
    # A hit shows 3 * width words of the document at most, and one more for each further window.
    shown = F.aggregate("rows", F.lit(0), lambda a, r: a + r["count"] + (3 * width - 1))
    per = per.where(shown >= F.lit(covered) * F.col("item_words"))
    whole = known.where("kinds is not null").select("item", "kinds", "values").dropDuplicates(["item"])
    per = per.join(whole, "item").select(*of, "rows", "kinds", "values", "block")

    def check(batches):
        for b in batches:
            out = [(i, *place) for i, (rows, kinds, values, block) in enumerate(zip(*(b.column(k).to_pylist() for k in (5, 6, 7, 8)), strict=True)) for place in _placed(rows, kinds, values, block, covered)]
            take, coverage, exact, pos = zip(*out, strict=True) if out else ((), (), (), ())
            take = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(5)), pa.array(coverage, pa.float64()), pa.array(pos, pa.int64()), pa.array(exact, pa.bool_())], [*of, "coverage", "pos", "exact"])

    placed = per.mapInArrow(tidy(check), "z boolean, id long, x1 long, x2 long, item_id long, coverage double, pos long, exact boolean")
    return placed.unionByName(whole_items) if short else placed


def leaks(docs: DataFrame, items: DataFrame, width: int = WINDOW, covered: float = COVERED) -> DataFrame:
    """(doc_id, item_id, coverage, exact, pos): items of ``items`` (item_id, text)
    that a document of ``docs`` (doc_id, text) holds, alike or
    re-parameterised: of the item's words at least the share ``covered`` stand in
    their order in the document, around common windows of ``width`` words and
    with less than the item's length of words put in or left out, and slot values
    fit as ``_judged`` says.  exact: all slot values are equal too.  pos: where
    the item's first word is, or would be.

    Items of fewer than ``width`` words are found word for word only, A-Z and
    punctuation around words aside.  Null and empty texts hold nothing and are
    held by nothing.  Repeated documents and items count alike, null ids are one
    document; the best place of a document and an item is returned, ties by
    position.
    """
    good = _found(docs, items, width, covered).withColumn("doc_id", F.when(~F.col("z"), F.col("id")))
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "exact", F.negative("pos").alias("at"))).alias("b"))
    return best.select("doc_id", "item_id", "b.coverage", "b.exact", F.negative("b.at").alias("pos"))


def decontaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW, covered: float = COVERED) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others), all columns, that hold no
    benchmark item: rows go by id and text, so a null or repeated id takes no
    other text along."""
    gone = _found(docs, items, width, covered).select(*ROW_KEYS).distinct()
    return without_rows(docs, written(gone, "gone"))
