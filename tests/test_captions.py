"""Caption scores against plain versions over random sets, nulls and empty texts."""

import math
import random
from collections import Counter, defaultdict

import pytest

from sparkloom.operators import captions


def grams(text):
    w = (text or "").split()
    return [Counter(" ".join(w[i : i + n]) for i in range(len(w) - n + 1)) for n in range(1, 5)]


def plain_cider(rows):
    """{key: score} by the definition, a set in memory."""
    held = defaultdict(int)
    for _, _, refs in rows:
        for g in {g for r in refs or [] for c in grams(r) for g in c}:
            held[g] += 1
    total = math.log(len(rows))

    def vector(text):
        return [{g: c * (total - math.log(max(1, held[g]))) for g, c in x.items()} for x in grams(text)]

    out = {}
    for key, said, refs in rows:
        a, scores = vector(said), []
        for r in refs or []:
            b, value = vector(r), 0.0
            for x, y in zip(a, b):
                dot = sum(min(v, y[g]) * y[g] for g, v in x.items() if g in y)
                size = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
                value += dot / size if size else 0.0
            delta = sum(grams(said)[1].values()) - sum(grams(r)[1].values())
            scores.append(value / 4 * math.exp(-(delta**2) / 72))
        out[key] = 10 * sum(scores) / len(scores) if scores else 0.0
    return out


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def caption_rows(seed, n, vocabulary):
    rng = random.Random(seed)

    def text():
        return rng.choice([None, "", " "]) if rng.random() < 0.1 else " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14)))

    return [(i, text(), rng.choice([None, []]) if rng.random() < 0.1 else [text() for _ in range(rng.randint(1, 4))]) for i in range(n)]


@pytest.mark.parametrize("frequent", [100, 3, 0])
def test_cider_against_plain(spark, monkeypatch, frequent):
    """Whatever counts as frequent: all, some or none is broadcast."""
    monkeypatch.setattr(captions, "FREQUENT", frequent)
    rows = caption_rows(frequent, 60, ["a", "b", "c", "dog", "é"] + [f"w{i}" for i in range(30)])
    df = spark.createDataFrame(rows, "k long, said string, refs array<string>")
    got = {r.k: r.cider for r in captions.cider(df, "k", "said", "refs").collect()}
    assert got == pytest.approx(plain_cider(rows))


def test_a_set_of_one_and_an_empty_set(spark):
    df = spark.createDataFrame([(1, "a b", ["a b"])], "k long, said string, refs array<string>")
    assert [tuple(r) for r in captions.cider(df, "k", "said", "refs").collect()] == [(1, 0.0)]
    assert captions.cider(df.limit(0), "k", "said", "refs").count() == 0


def test_common_words_and_rouge():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert captions.common_words(a, b) == plain_common(a, b)
    assert captions.rouge_score("the cat sat", ["the cat sat"]) == pytest.approx(1.0)
    assert captions.rouge_score("a b c d", ["a c", "x"]) == pytest.approx(2.44 * 0.5 * 1.0 / (1.0 + 1.44 * 0.5))
    assert captions.rouge_score(None, [None]) == 1.0 and captions.rouge_score("a", None) == 0.0


def test_no_shuffle_by_frequent_grams(spark):
    """The frequencies of common n-grams are broadcast, so no task gets all rows of one."""
    rows = [(i, f"the {i}", ["the thing", f"the {i}"]) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, said string, refs array<string>")
    got = {r.k: r.cider for r in captions.cider(df, "k", "said", "refs").collect()}
    assert got == pytest.approx(plain_cider(rows))


def shuffled(spark):
    """MB that all stages so far have shuffled."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size())) / 1e6


def test_an_ngram_is_a_few_bytes_of_shuffle(spark, monkeypatch):
    """Round 3, F8 and F9: some 150 bytes for each n-gram before, at most 16 now."""
    monkeypatch.setattr(captions, "BLOCK", 100, raising=False)  # many blocks
    rng = random.Random(1)
    rows = [(i, *(" ".join(f"word{rng.randint(0, 999)}" for _ in range(200)) for _ in range(2))) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, said string, ref string").repartition(4).selectExpr("k", "k % 3 AS g", "said", "array(ref) AS refs").cache()
    df.count()
    n_grams = sum(len(grams(t)[n]) for r in rows for t in r[1:] for n in range(4))
    before = shuffled(spark)
    got = {r.k: r.cider for r in captions.cider(df, "k", "said", "refs").collect()}
    assert shuffled(spark) - before < 16 * n_grams / 1e6
    assert got == pytest.approx(plain_cider([(k, a, [b]) for k, a, b in rows]))
    before = shuffled(spark)
    means = {r.g: (r.captions, r.cider) for r in captions.caption_scores(df, "k", "said", "refs", ["g"]).collect()}
    assert shuffled(spark) - before < 16 * n_grams / 1e6
    assert means == {g: (200, pytest.approx(sum(100 * v for k, v in got.items() if k % 3 == g) / 200)) for g in range(3)}
    df.unpersist()


def test_packed_numbers_come_back():
    import numpy as np

    for kind in (np.uint64, np.int64):
        values = np.array([0, 1, 255, 256, 2**40 + 7], kind)
        assert (captions.unpacked(captions.packed(values), kind) == values).all()
    assert len(captions.unpacked(captions.packed(np.zeros(0, np.int64)), np.int64)) == 0
