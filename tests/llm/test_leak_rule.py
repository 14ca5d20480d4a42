"""The leak rule against a plain version: items with swapped, mixed-up and replaced words,
none put in or left out, so that one alignment of each document and item decides."""

import random
from collections import Counter, defaultdict

from sparkloom.llm import decontamination as dc

WIDTH, COVERED = dc.WINDOW, dc.COVERED
NAMES = ["Anna", "Boris", "Clara", "Dmitri", "Elena", "Farid", "Greta", "Hugo"]
UNITS = ["miles", "minutes", "kg", "hours"]


def kind(word):
    if any(c.isdigit() for c in word):
        return "number"
    if word.lower() in dc.UNITS:
        return "unit"
    return "name" if word[0].isupper() else "plain"


def matches(a, b):
    """Whether a document's word fits an item's: slots by their kind, others by themselves."""
    return kind(a) == kind(b) and (kind(a) != "plain" or a == b)


def holds(doc, item, shift):
    """The rule for the item's word i at the document's word i + shift."""
    n = len(item)
    same = [0 <= i + shift < len(doc) and matches(item[i], doc[i + shift]) for i in range(n)]
    hits = [i for i in range(n - WIDTH + 1) if all(same[i : i + WIDTH])]
    seen = {j for i in hits for j in range(i - WIDTH, i + 2 * WIDTH)}
    pairs = [(item[i].lower(), doc[i + shift].lower(), kind(item[i])) for i in range(n) if same[i] and i in seen]
    if len(pairs) < COVERED * n:
        return False
    there, back = defaultdict(Counter), defaultdict(Counter)
    for a, b, k in pairs:
        if k != "plain":
            there[a][b] += 1
            back[b][a] += 1
    slots = sum(k != "plain" for _, _, k in pairs)
    plain = len(pairs) - slots
    aside = lambda table: sum(sum(c.values()) - max(c.values()) for c in table.values())
    forth, reverse = aside(there), aside(back)
    some = slots // 5 if plain >= slots else 0
    if forth > some or reverse - forth > (max(1, some) if plain >= slots else 0):
        return False
    return len(pairs) - forth >= COVERED * n


def variant(rng, item, vocabulary):
    """The item with its slots swapped, each value for one other or each place for itself,
    and some plain words replaced."""
    out, swap = [], {}
    mixed_up, moved, lost = rng.random() < 0.4, rng.random() < 0.7, rng.choice([0, 0, 0.03, 0.08, 0.15, 0.25])
    for w in item:
        k = kind(w)
        if k == "plain":
            out.append(rng.choice(vocabulary) if rng.random() < lost else w)
            continue
        fresh = {"number": lambda: str(rng.randint(100, 999)), "name": lambda: rng.choice(NAMES), "unit": lambda: rng.choice(UNITS)}[k]()
        if mixed_up and rng.random() < 0.4:
            out.append(fresh)
        else:
            out.append(swap.setdefault(w, fresh) if moved else w)
    return out


def test_leaks_against_the_plain_rule(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(6))
    vocabulary = [word() for _ in range(500)]
    items = []
    for i in range(24):
        n = rng.randint(8, 32)
        made = [rng.choice(vocabulary)]
        for _ in range(n - 1):
            x = rng.random()
            made.append(rng.choice(vocabulary) if x < 0.7 else str(rng.randint(1, 60)) if x < 0.83 else rng.choice(NAMES[:4]) if x < 0.93 else rng.choice(UNITS))
        items.append((i, made))
    docs = []
    for i in range(360):
        filler = [word() for _ in range(25)]
        docs.append((i, filler[:12] + variant(rng, rng.choice(items)[1], vocabulary) + filler[12:]))
    want = {(d, i) for d, doc in docs for i, item in items if any(holds(doc, item, s) for s in range(-len(item), len(doc)))}
    found = dc.leaks(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == want, (sorted(got - want)[:5], sorted(want - got)[:5])
    assert 60 < len(want) < 340  # both outcomes come up often
