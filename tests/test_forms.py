"""Nested forms: tree edits against a plain recursion over forests, order and fields."""

import functools
import json
import random

import pytest

from sparkloom.functions import forms


def plain_distance(x, y):
    """Over forests as tuples of (label, is text, children), by their last trees."""

    def tree(label, value):
        kids = []
        for k, v in value.items() if isinstance(value, dict) else [(None, v) for v in value]:
            kids.append(tree(k, v) if k is not None else tree("<subtree>", v) if isinstance(v, dict) else (v, True, ()))
        return label, False, tuple(kids)

    def lev(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(lev(a[1:], b) + 1, lev(a, b[1:]) + 1, lev(a[1:], b[1:]) + (a[0] != b[0]))

    lev = functools.lru_cache(None)(lev)

    def weight(n):
        return len(n[0]) if n[1] else 1

    def change(a, b):
        if a[1] and b[1]:
            return lev(a[0], b[0])
        return 1 + len((a if a[1] else b)[0]) if a[1] != b[1] else int(a[0] != b[0])

    @functools.lru_cache(None)
    def d(f, g):
        if not f and not g:
            return 0
        out = []
        if f:
            out.append(d(f[:-1] + f[-1][2], g) + weight(f[-1]))
        if g:
            out.append(d(f, g[:-1] + g[-1][2]) + weight(g[-1]))
        if f and g:
            out.append(d(f[-1][2], g[-1][2]) + d(f[:-1], g[:-1]) + change(f[-1], g[-1]))
        return min(out)

    return d((tree("<root>", x),), (tree("<root>", y),))


def random_form(rng, depth=2):
    out = {}
    for _ in range(rng.randint(0, 3)):
        key = rng.choice(["a", "b", "cc", "name"])
        kind = rng.random()
        if kind < 0.4 or depth == 0:
            out[key] = rng.choice(["x", "xy", "z", "", 3, 1.5, None, True])
        elif kind < 0.6:
            out[key] = [rng.choice(["p", "q", 2, "", None, {"a": "b"}]) for _ in range(rng.randint(0, 3))]
        elif kind < 0.8:
            out[key] = random_form(rng, depth - 1)
        else:
            out[key] = [random_form(rng, depth - 1) for _ in range(rng.randint(0, 2))]
    return out


def test_tree_edits_against_plain_recursion():
    rng = random.Random(3)
    for _ in range(250):
        x, y = forms.canonical(random_form(rng)), forms.canonical(random_form(rng))
        assert forms.form_distance(x, y) == plain_distance(x, y), (x, y)


def test_canonical_order_and_what_goes():
    form = {"name": " x ", "b": {"cc": 1, "a": [{"d": ""}, {}]}, "empty": [], "none": {}, "mix": [1, "y ", None, {"z": 1}], "t": True}
    assert json.dumps(forms.canonical(form)) == '{"b": [{"a": [{"d": [""]}], "cc": ["1"]}], "t": ["True"], "mix": ["1", "y"], "name": ["x"]}'
    assert sorted(forms.field_pairs(forms.canonical(form)).items()) == [(("b.a.d", ""), 1), (("b.cc", "1"), 1), (("mix", "1"), 1), (("mix", "y"), 1), (("name", "x"), 1), (("t", "True"), 1)]


@pytest.mark.parametrize("text, plain", [("ＡＢ　１２", "AB 12"), ("中 文 a", "中文a"), ("a ,b", "a, b"), ("1 , 2", "1 , 2"), ("10kg", "10 kg"), ("x、y", "x, y"), ("3.5", "3.5"), ("a  b", "a b")])
def test_plain_values(text, plain):
    assert forms.plain_value(text) == plain


def test_accuracies():
    gold = '{"menu": [{"name": "cake", "count": "2"}, {"name": "juice"}]}'
    assert forms.form_accuracy(gold, gold) == 1.0
    assert forms.form_accuracy('```json\n{"menu": [{"count": "2", "name": "cake"}, {"name": "juice"}]}\n```', gold) == 1.0
    # Of 1 menu, 2 subtrees, 3 names and 10 characters one character is off.
    assert forms.form_accuracy(gold.replace("cake", "cafe"), gold) == pytest.approx(1 - 1 / 16)
    assert forms.form_accuracy(None, gold) == forms.form_accuracy("no form", gold) == forms.form_accuracy("[1]", gold) == 0.0
    assert forms.form_accuracy("{}", None) == 1.0 and forms.form_accuracy(gold, "{}") == 0.0
    assert forms.form_accuracy(json.dumps({"a": "x" * 500}), gold) == 0.0


def test_reports(spark):
    rows = [("g", '{"a": "1", "b": ["x", "x"]}', '{"a": "1", "b": ["x", "y"]}'), ("g", None, '{"a": "2"}'), ("h", '{"a": "2"}', '{"a": "2"}')]
    df = spark.createDataFrame(rows, "k string, said string, gold string")
    got = {r.k: r for r in forms.form_report(df, "said", "gold", ["k"]).collect()}
    assert got["g"].f1 == pytest.approx(2 / (2 + 3 / 2), abs=1e-5) and got["h"].accuracy == pytest.approx(1, abs=1e-5)
    assert got["g"].accuracy == pytest.approx((1 - 1 / 5) / 2, abs=1e-5)
    fields = {r.field: (r.both, r.off) for r in forms.field_report(df, "said", "gold").collect()}
    assert fields == {"a": (2, 1), "b": (1, 2)}
    assert forms.form_report(df.limit(0), "said", "gold", ["k"]).count() == 0
