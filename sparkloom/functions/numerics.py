r"""Numbers written as expressions: fractions, roots, powers, units, LaTeX or plain.

``value_of`` reads an expression with a tokeniser and two stacks, over rationals as
long as they last and doubles beyond.  Two expressions with letters are taken for
equal if they have the same value wherever fixed numbers are put in for the letters.
The rules that judge answers are small functions on top, and UDFs over Arrow batches.
"""

from __future__ import annotations

import math
import operator
import re
from fractions import Fraction

from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest text that is read as an expression, and most bits of a rational.
LONGEST, MOST_BITS = 1000, 4096

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(\\?[A-Za-z]+)|(\*\*|[-+*/^(),%]))")
_PLAIN = [(r"\\(?:left|right|displaystyle|,|;|!|:|quad|qquad)(?![A-Za-z])|\\[,;!:]|~", " "), (r"\\(?:d|t|c)frac", r"\\frac"), (r"\\(?:cdot|times|ast)(?![A-Za-z])|[×·∗]", "*"), (r"\\div(?![A-Za-z])|÷", "/"), ("−|–", "-"), ("√", r"\\sqrt"), ("π", r"\\pi "), (r"\*\*", "^")]
_OPERATORS = {"+": (1, operator.add), "-": (1, operator.sub), "*": (2, operator.mul), "/": (2, operator.truediv), "^": (4, None)}
_FUNCTIONS = {"sqrt": lambda x: _power(x, Fraction(1, 2)), "sin": math.sin, "cos": math.cos, "tan": math.tan, "log": math.log, "ln": math.log, "exp": math.exp, "abs": abs}


def _bounded(x):
    if isinstance(x, Fraction) and max(x.numerator.bit_length(), x.denominator.bit_length()) > MOST_BITS:
        return float(x)
    return x


def _root(n: int, k: int) -> int | None:
    """The whole k-th root of n, if it has one."""
    r = round(n ** (1 / k)) if n < 1 << 52 else math.isqrt(n) if k == 2 else None
    return r if r is not None and r**k == n else None


def _power(x, y):
    """x to the y: exact for whole powers and exact roots; odd roots of negative
    numbers are negative."""
    if isinstance(x, Fraction) and isinstance(y, Fraction):
        size = max(x.numerator.bit_length(), x.denominator.bit_length())
        if y.denominator <= 64 and abs(y.numerator) * size <= MOST_BITS:
            base = x ** abs(y.numerator) if y >= 0 else Fraction(1) / x ** abs(y.numerator)
            if y.denominator == 1:
                return base
            sign = -1 if base < 0 and y.denominator % 2 else 1
            p, q = _root(sign * base.numerator, y.denominator) if sign * base >= 0 else None, _root(base.denominator, y.denominator)
            if p is not None and q is not None:
                return sign * Fraction(p, q)
            if sign < 0:
                return -(float(-base) ** (1 / y.denominator))
    out = float(x) ** float(y)
    if isinstance(out, complex):
        raise ValueError("no real number")
    return out


def _group(text: str, at: int, opens: str = "{", closes: str = "}") -> tuple[str, int]:
    """The argument at a place, a group or one character, and where it ends."""
    while at < len(text) and text[at] == " ":
        at += 1
    if at >= len(text):
        raise ValueError("an argument is missing")
    if text[at] != opens:
        return text[at], at + 1
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == opens) - (text[i] == closes)
        if depth == 0:
            return text[at + 1 : i], i + 1
    raise ValueError("a group is open")


def flattened(text: str, mixed: bool = False) -> str:
    r"""LaTeX fractions, roots and groups as plain expressions; ``mixed``: a whole
    number before a fraction is added to it, not multiplied by it."""
    for pattern, to in _PLAIN:
        text = re.sub(pattern, to, text)
    while (at := text.find("\\frac")) >= 0:
        a, i = _group(text, at + 5)
        b, i = _group(text, i)
        plus = "+" if mixed and re.search(r"\d\s*$", text[:at]) else " "
        # A fraction that stands alone stays as people write it: the strict rule looks at it.
        alone = re.fullmatch(r"\w+", a) and re.fullmatch(r"\w+", b) and re.search(r"(^|[-+(]|\d)\s*$", text[:at]) and not text[i:].lstrip().startswith("^")
        text = f"{text[:at]}{plus}{a}/{b}{text[i:]}" if alone and (plus == "+" or not re.search(r"\d\s*$", text[:at])) else f"{text[:at]}{plus}(({a})/({b})){text[i:]}"
    while (at := text.find("\\sqrt")) >= 0:
        degree, i = ("2", at + 5)
        if text[i : i + 1] == "[":
            degree, i = _group(text, i, "[", "]")
        if text[i : i + 1] == "(":
            a, i = _group(text, i, "(", ")")
        else:
            a, i = _group(text, i)
        text = f"{text[:at]} (({a})^(1/({degree}))){text[i:]}"
    if mixed:
        text = re.sub(r"(\d) +(\d)", r"\1+\2", text)
    return text.replace("{", "(").replace("}", ")").replace("[", "(").replace("]", ")").replace("\\%", "%")


def value_of(text: str, pi=math.pi, letters: dict | None = None, mixed: bool = False):
    """The value of an expression: a Fraction, a double, or a list of them where commas
    part it; None where it is none.  Operands side by side are multiplied; a percent
    sign divides by 100.  ``letters`` gives the values of single letters."""
    try:
        if len(text) > LONGEST:
            return None
        return _evaluated(flattened(text, mixed), pi, letters or {})
    except (ValueError, ArithmeticError, RecursionError, TypeError):
        return None


def _evaluated(text: str, pi, letters: dict):
    values: list = []
    pending: list = []  # operators, opening parentheses and names of functions

    def apply():
        op = pending.pop()
        if op == "neg":
            values.append(-values.pop())
        else:
            b, a = values.pop(), values.pop()
            values.append(_bounded(_power(a, b) if op == "^" else _OPERATORS[op][1](a, b)))

    def push(op, rank, right=False):
        while pending and pending[-1] in ("neg", *_OPERATORS):
            top = 3 if pending[-1] == "neg" else _OPERATORS[pending[-1]][0]
            if top < rank or (top == rank and right):
                break
            apply()
        pending.append(op)

    at, operand, parts = 0, False, []
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError("no token")
        at = m.end()
        number, name, sign = m.groups()
        if number or name or sign == "(":
            if operand:
                push("*", 2)
            operand = False
        if number:
            values.append(Fraction(number))
            operand = True
        elif name:
            bare = name.lstrip("\\")
            if bare in _FUNCTIONS:
                pending.append(bare)
            elif bare == "pi":
                values.append(pi)
                operand = True
            elif name.startswith("\\"):
                raise ValueError("an unknown command")
            else:
                for i, c in enumerate(bare):
                    if i:
                        push("*", 2)
                    values.append(letters[c] if c in letters else math.e if c == "e" else _unknown(c))
                operand = True
        elif sign == "(":
            pending.append("(")
        elif sign == ")" or (sign == "," and not any(p == "(" for p in pending)):
            if not operand:
                raise ValueError("an operand is missing")
            while pending and pending[-1] != "(":
                if pending[-1] in _FUNCTIONS:
                    values.append(_FUNCTIONS[pending.pop()](values.pop()))
                else:
                    apply()
            if sign == ")":
                if not pending:
                    raise ValueError("no group is open")
                pending.pop()
                if pending and pending[-1] in _FUNCTIONS:
                    values.append(_bounded(_FUNCTIONS[pending.pop()](values.pop())))
            else:
                parts.append(values.pop())
                operand = False
        elif sign == "%":
            if not operand:
                raise ValueError("an operand is missing")
            values.append(values.pop() / 100)
        elif sign == ",":
            raise ValueError("a list within a group")
        elif not operand:
            if sign == "-":
                pending.append("neg")
            elif sign != "+":
                raise ValueError("an operand is missing")
        else:
            push("^" if sign == "**" else sign, _OPERATORS["^" if sign == "**" else sign][0], sign in ("^", "**"))
            operand = False
    if not operand:
        raise ValueError("an operand is missing")
    while pending:
        if pending[-1] == "(":
            raise ValueError("a group is open")
        if pending[-1] in _FUNCTIONS:
            values.append(_FUNCTIONS[pending.pop()](values.pop()))
        else:
            apply()
    if len(values) != 1 or any(isinstance(x, float) and not math.isfinite(x) for x in [*values, *parts]):
        raise ValueError("no number")
    return [*parts, values[0]] if parts else values[0]


def _unknown(letter):
    raise ValueError(f"{letter} has no value")


def _list_of(text: str):
    """Parts of a text in one pair of parentheses or brackets, parted by commas outside
    of other groups, or None."""
    text = text.strip()
    if len(text) < 2 or text[0] not in "([" or text[-1] not in ")]":
        return None
    depth, out, start = 0, [], 1
    for i, c in enumerate(text[:-1]):
        depth += (c in "([{") - (c in ")]}")
        if depth == 0:
            return None
        if c == "," and depth == 1:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:-1]]


# ------------------------------------------------- numbers with units, one percent off

# Pi, the tolerance, what goes, marks of maths, what an answer is assigned
# to, and a box.
PI, WITHIN, DROPPED = Fraction("3.14"), Fraction(1, 100), ["$", "¥", "°C", " C", "°"]
MATHS_MARKS = [r"\\\((.*?)\\\)", r"\\\[(.*?)\\\]"]
ASSIGNED = r"(?:=|≈|\\approx)\s*(.+)"
BOXED = r"\\boxed\{((?:[^\{\}]+|\{[^\{\}]*\})*)\}"


def bare_text(text: str) -> str:
    """Without blanks, hyphens and dots, in lower case."""
    return re.sub(r"[ \-\n\t.]", "", text).lower()


def read_number(text: str):
    """What an answer says as a number or a list of numbers, or None: the marks of inline
    and display maths go, then all up to the first equals sign, money and degrees."""
    for pattern in MATHS_MARKS:
        text = re.sub(pattern, r"\1", text)
    m = re.search(ASSIGNED, text)
    text = m[1].strip() if m else text
    for x in DROPPED:
        text = text.replace(x, "")
    listed = _list_of(text)
    if listed and len(listed) > 1:
        found = [value_of(x, pi=PI) for x in listed]
        return None if any(x is None or isinstance(x, list) for x in found) else found
    return value_of(text, pi=PI)


def near_number(said, gold) -> bool:
    return abs(Fraction(said) - Fraction(gold)) <= abs(Fraction(gold)) * WITHIN


def numeric_score(said: str | None, gold: str | None) -> float:
    r"""1.0 if two answers are numbers no more than one percent of the gold one apart, or
    lists of equally many such, each in order of size; else whether their bare texts are
    equal.  A boxed answer counts alone.  Null counts as empty."""
    said, gold = (m[1] if (m := re.search(BOXED, x or "")) else (x or "") for x in (said, gold))
    a, b = read_number(said), read_number(gold)
    if a is None or b is None:
        return float(bare_text(said) == bare_text(gold))
    if isinstance(a, list) and isinstance(b, list):
        return float(len(a) == len(b) and all(map(near_number, sorted(a), sorted(b))))
    return float(not isinstance(a, list) and not isinstance(b, list) and near_number(a, b))


# ------------------------------------------------------------- equality of expressions

#: Relative tolerance of numbers.
TOLERANCE = 1e-4
#: Numbers put in for letters, in turn: fractions whose powers and sums don't meet.
POINTS = [Fraction(17, 13), Fraction(-29, 11), Fraction(43, 7), Fraction(5, 31), Fraction(83, 19)]


def same_expressions(a: str, b: str, tolerance: float = TOLERANCE, mixed: bool = False) -> bool:
    """Whether two expressions are equal: with letters, at every one of POINTS (exactly
    over rationals, to twelve digits over doubles); without, to ``tolerance``."""
    names = sorted(set(re.findall(r"(?<![A-Za-z\\])[A-Za-z](?![A-Za-z])|(?<=\d)[A-Za-z](?![A-Za-z])", a + " " + b)) - {"e"})
    if not names:
        x, y = value_of(a, mixed=mixed), value_of(b, mixed=mixed)
        return _close(x, y, tolerance)
    seen = 0
    for shift in range(len(POINTS)):
        at = {c: POINTS[(i + shift) % len(POINTS)] + i // len(POINTS) for i, c in enumerate(names)}
        x, y = value_of(a, letters=at, mixed=mixed), value_of(b, letters=at, mixed=mixed)
        if (x is None) != (y is None):
            return False
        if x is None:
            continue  # neither has a real value here
        seen += 1
        if not _close(x, y, 1e-12):
            return False
    return seen > 0


def _close(x, y, tolerance) -> bool:
    if x is None or y is None or isinstance(x, list) != isinstance(y, list):
        return False
    if isinstance(x, list):
        return len(x) == len(y) and all(_close(a, b, tolerance) for a, b in zip(x, y, strict=True))
    return x == y or math.isclose(x, y, rel_tol=tolerance)


def _digits(text: str) -> float | None:
    try:
        return float(text.replace("{,}", "").replace(",", ""))
    except ValueError:
        return None


def maths_equal(said: str | None, gold: str | None, percentages: bool = True, tolerance: float = TOLERANCE) -> bool:
    """Whether two answers agree: as texts, as numbers (also a hundred times or a
    hundredth, with ``percentages``), part by part in lists and intervals of the same
    kind, or as expressions.  Money and percent signs of plain numbers go, as does a
    base after an underscore.  Null agrees with nothing."""
    if said is None or gold is None:
        return False

    def plain(x):
        x = x[1:] if re.match(r"\$\d+(\.\d+)?", x) else x
        x = re.sub(r"^(\d+(?:\.\d+)?)\\?%$", r"\1", x)
        m = re.fullmatch(r"(\d+)_.*", x)
        return m[1] if m else x

    said, gold = plain(said)[:LONGEST], plain(gold)
    if said.strip().lower() == gold.strip().lower() or said.replace(" ", "") == gold.replace(" ", ""):
        return True
    x, y = _digits(said), _digits(gold)
    if x is not None and y is not None:
        return any(math.isclose(g, x, rel_tol=tolerance) for g in ([y / 100, y, y * 100] if percentages else [y]))
    if not said.strip():
        return False
    said, gold = said.strip(), gold.strip()
    # Signs of groups aside, equal texts are equal; kinds of intervals count otherwise.
    mixed_kinds = said[:1] + gold[:1] in ("[(", "([")
    if not mixed_kinds and re.sub(r"[(){}]", "", said) == re.sub(r"[(){}]", "", gold):
        return True
    a, b = _list_of(said), _list_of(gold)
    if a and b and len(a) == len(b) and len(a) > 1 and said[0] == gold[0] and said[-1] == gold[-1]:
        return all(maths_equal(p.strip(), q.strip(), percentages, tolerance) for p, q in zip(a, b, strict=True))
    if a is None and b is None and "," in said and "," in gold and said.count(",") == gold.count(","):
        return all(maths_equal(p.strip(), q.strip(), percentages, tolerance) for p, q in zip(said.split(","), gold.split(","), strict=True))
    return not (a and b and len(a) > 1) and same_expressions(said, gold, tolerance)


# ----------------------------------------------------------------- strictly graded ones

#: Units that go, with their plural and power, and words for numbers.
UNITS = ["degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter"]
NUMBER_WORDS = [(" or ", " , "), (" and ", " , "), ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")]


def normal_answer(text: str) -> str:
    """An answer without its text command, money, percent signs, units, degrees and the
    commas of large numbers; mixed numbers as sums; whole numbers without their point."""
    m = re.search(r"^\\text\{(.+?)\}$", text)
    text = m[1] if m else text
    text = re.sub(r"\\?[$%]", "", text)
    for word, to in NUMBER_WORDS:
        text = text.replace(word, to)
    for unit in UNITS:
        text = re.sub(rf"{unit}(es)?(s)? *(\^[0-9]+)?", "", text)
    text = re.sub(r"\^ *\\circ", "", text)
    if text[:1] == "{" and text[-1:] == "}":
        text = text[1:-1]
    text = re.sub(r",\\! *", "", text)
    if "\\" in text:
        try:
            text = flattened(text, mixed=True).strip()
        except ValueError:
            pass
    text = re.sub(r"(\d) +(\d)", r"\1+\2", re.sub("- *", "-", text)).lower()
    while (shorter := re.sub(r"(\d),(\d\d\d)($|\D)", r"\1\2\3", text)) != text:
        text = shorter
    return str(round(x)) if (x := _whole(text)) is not None else text


def _whole(text: str) -> float | None:
    try:
        x = float(text)
    except ValueError:
        return None
    return x if math.isfinite(x) and abs(x - round(x)) <= 1e-7 else None


def graded(said: str | None, gold: str | None) -> bool:
    """Whether an answer is right: equal in its normal form, or part by part equal as
    expressions, where two fractions must be written alike and a whole number is only
    equal to a whole number.  Null or empty answers are wrong."""
    if said is None or gold is None:
        return False
    a, b = normal_answer(said), normal_answer(gold)
    if a == b:
        return True
    if not a:
        return False

    def parts(x):
        got = _list_of(x)
        return [p.strip() for p in got] if got and not re.search(r"[()\[\]]", x[1:-1]) else [x]

    x, y = parts(a), parts(b)
    if len(x) != len(y) or (len(y) > 1 and (a[0], a[-1]) != (b[0], b[-1])):
        return False
    fraction = r"^-?[0-9]+.?/0*[1-9][0-9]*.?$"
    for p, q in zip(x, y, strict=True):
        if re.search(fraction, p) and re.search(fraction, q):
            same = p == q
        elif (_whole(p) is None) != (_whole(q) is None):
            same = False
        else:
            same = p == q or same_expressions(p, q, 1e-12)
        if not same:
            return False
    return True


@F.pandas_udf(T.DoubleType())
def numeric_match(said, gold):
    """``numeric_score`` of two columns."""
    return said.combine(gold, numeric_score).astype(float)


@F.pandas_udf(T.BooleanType())
def maths_match(said, gold):
    """``maths_equal`` of two columns."""
    return said.combine(gold, maths_equal).astype(bool)


@F.pandas_udf(T.BooleanType())
def graded_match(said, gold):
    """``graded`` of two columns."""
    return said.combine(gold, graded).astype(bool)
