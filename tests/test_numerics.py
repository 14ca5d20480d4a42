"""Expressions against a plain version over random trees; rules of answers on cases."""

import math
import random
from fractions import Fraction

import pytest

from sparkloom.functions.numerics import graded, graded_match, maths_equal, maths_match, near_number, numeric_match, numeric_score, same_expressions, value_of


def tree(rng, depth):
    """(plain text, LaTeX, value) of a random expression without letters."""
    if depth == 0 or rng.random() < 0.2:
        n = rng.randint(0, 30)
        if rng.random() < 0.3:
            return f"{n}.5", f"{n}.5", Fraction(2 * n + 1, 2)
        return str(n), str(n), Fraction(n)
    kind = rng.choice("+-*/^nr")
    p, q, v = tree(rng, depth - 1)
    if kind == "n":
        return f"(-({p}))", rf"\left(-\left({q}\right)\right)", -v
    if kind == "r":
        return f"sqrt(({p})^2)", rf"\sqrt{{({q})^{{2}}}}", abs(v)
    if kind == "^":
        k = rng.randint(0, 3)
        return f"({p})^{k}", rf"\left({q}\right)^{{{k}}}", v**k
    a, b, w = tree(rng, depth - 1)
    if kind == "/":
        if w == 0:
            return p, q, v
        return f"({p})/({a})", rf"\dfrac{{{q}}}{{{b}}}", v / w
    value = {"+": v + w, "-": v - w, "*": v * w}[kind]
    sign = {"+": "+", "-": "-", "*": rng.choice([r"\cdot ", r"\times ", ""])}[kind]
    return f"({p}){kind}({a})", f"({q}){sign}({b})", value


def test_values_of_random_expressions():
    rng = random.Random(7)
    for _ in range(500):
        plain, latex, value = tree(rng, 4)
        for text in (plain, latex):
            got = value_of(text)
            if len(text) <= 1000:
                assert got == value or math.isclose(got, value, rel_tol=1e-9), text


@pytest.mark.parametrize(
    "text, value",
    [("2^3^2", 512), ("-2^2", -4), ("2^{-1}", Fraction(1, 2)), (r"\sqrt[3]{-8}", -2), (r"\frac12", Fraction(1, 2)), ("3(4+5)", 27), ("--3", 3), ("50%", Fraction(1, 2)), ("3/4/2", Fraction(3, 8)), (r"\sqrt{\frac{9}{4}}", Fraction(3, 2)), ("1e3", 1000), (".5", Fraction(1, 2)), ("2**10", 1024)]
    + [(x, None) for x in ["", "2 +", ")", "(1", "1/0", r"\sqrt{-1}", "x", r"\foo{1}", "9^9^9", "1,,2", "%", "*2", r"\frac{1}", "1" * 1001, "(1,2)+3"]],
)
def test_values(text, value):
    assert value_of(text) == value


def test_letters_are_compared_at_points():
    assert same_expressions("(x+y)^3", "x^3+3x^2y+3xy^2+y^3")
    assert not same_expressions("(x+y)^3", "x^3+3x^2y+3xy^2+y^2")
    assert same_expressions("\\frac{x^2-1}{x-1}", "x+1") and not same_expressions("x", "y")
    assert same_expressions("\\sqrt{x^2y}", "\\sqrt{y x^2}")


@pytest.mark.parametrize(
    "said, gold, score",
    [(r"\(x = 3.14\)", "3.15", 1), (r"\boxed{2\pi}", "6.28", 1), ("101", "100", 1), ("101.01", "100", 0), ("99", "100", 1), ("98.99", "100", 0), ("-101", "-100", 1), ("(3, 1)", "[1,3]", 1), ("(3, 1)", "(1,4)", 0), ("1", "(1,2)", 0), ("5 Apples", "5apples.", 1), ("$12", "12", 1), ("¥0", "0", 1), ("50%", "0.5", 1), ("20°C", "20", 1), (r"\[\frac{22}{7}\]", "3.14", 1), ("a ≈ 10", "10.05", 1), (None, None, 1), (None, "1", 0), ("", "x", 0)],
)
def test_numbers_to_one_percent(said, gold, score):
    assert numeric_score(said, gold) == score


def test_tolerance_by_its_definition():
    rng = random.Random(2)
    for _ in range(300):
        gold, said = Fraction(rng.randint(-500, 500), 10), None
        said = gold + gold * Fraction(rng.randint(-30, 30), 1000)
        assert near_number(said, gold) == (gold - abs(gold) / 100 <= said <= gold + abs(gold) / 100)


@pytest.mark.parametrize(
    "said, gold, same",
    [("0.5", r"\frac{1}{2}", True), ("50", "0.5", True), ("0.50004", "0.5", True), ("0.5001", "0.5", False), ("(1,2)", "(1, 2)", True), ("[1,2)", "[1,2]", False), ("[1,2]", "(1,2)", False), ("[0.5,2)", r"[\frac12,2.0)", True), ("1,234", "1234", True), ("2,3", "2,3.0", True), ("2,3", "2,3,4", False), ("Yes", "yes ", True), ("a", "b", False), ("$5", "5", True), ("7%", "7", True), ("101_2", "101", True), (None, "1", False), ("", "1", False), (r"x\cdot y", "yx", True), (r"\sqrt{2}/2", r"1/\sqrt2", True)],
)
def test_equal_answers(said, gold, same):
    assert maths_equal(said, gold) is same


@pytest.mark.parametrize(
    "said, gold, right",
    [("7 3/4", "31/4", True), (r"7\frac{3}{4}", "7.75", True), ("5 meters", "5", True), ("5 cm^2", "5", True), ("1,000", "1000", True), ("2/4", "1/2", False), (r"\frac{2}{4}", "1/2", False), ("3.5", "3", False), ("(1,2)", "(1,3)", False), ("(x,2)", "(x, 2)", True), ("(1,2)", "[1,2]", False), ("(a+b)^2", "a^2+2ab+b^2", True), ("12.0", "12", True), (r"\text{yes}", "Yes", True), ("90^\\circ", "90", True), ("- 3", "-3", True), ("", "1", False), (None, "1", False), ("1", None, False)],
)
def test_graded_answers(said, gold, right):
    assert graded(said, gold) is right


def test_columns(spark):
    df = spark.createDataFrame([("1/2", "0.5"), (None, "1"), ("x", "y")], "said string, gold string")
    assert [tuple(r) for r in df.select(numeric_match("said", "gold"), maths_match("said", "gold"), graded_match("said", "gold")).collect()] == [(1.0, True, True), (0.0, False, False), (0.0, False, False)]
