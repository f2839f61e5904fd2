"""Boxed answers and equivalence of short mathematical answers.

Balanced braces and expression equality are no regular matters, so these are
pandas UDFs over Arrow batches.  Equivalence compares canonical sums of terms
with exact rational coefficients and roots; a fuller comparator can be passed in.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from turnmill.shipping import ship


def braced(text: str, start: int) -> int | None:
    """Where the group that opens at or after ``start`` closes, or None."""
    depth = 0
    for found in re.finditer(r"[{}]", text[start:]):
        depth += 1 if found[0] == "{" else -1
        if depth == 0:
            return start + found.start()
    return None


def last_boxed(text: str | None) -> str | None:
    """The content of the last boxed expression."""
    if text is None:
        return None
    if "\\boxed " in text:
        return text.rpartition("\\boxed ")[2].partition("$")[0]
    at = max(text.rfind("\\boxed{"), -1)
    size = len("\\boxed{")
    if at < 0:
        at, size = text.rfind("\\fbox{"), len("\\fbox{")
    if at < 0:
        return None
    end = braced(text, at)
    return None if end is None else text[at + size : end]


@F.pandas_udf(StringType())
def _boxed(text: pd.Series) -> pd.Series:
    return text.map(last_boxed, na_action="ignore")


def boxed_answer(text: Column) -> Column:
    """The last boxed expression's content, or null."""
    ship()
    return _boxed(text)


# Commands that only set space or size, and other names of operators.
SILENT = r"\\left(?![a-z])|\\right(?![a-z])|\\!|\\,|\;|\\:|\\quad|\\displaystyle|\s|~|\$"
SPELLINGS = {"\\dfrac": "\\frac", "\\tfrac": "\\frac", "\\cfrac": "\\frac", "\\cdot": "*", "\\times": "*", "\\div": "/", "\\%": "%", "\u2212": "-", "\u00b7": "*", "\u00d7": "*", "**": "^"}
#: Characters of an answer that is read as an expression, terms of one, and bits of its numbers; beyond them it is a text.
MOST_CHARS, MOST_TERMS, MOST_BITS = 400, 200, 4096

_TOKEN = re.compile(r"(?:\d+(?:,\d{3})+(?!\d)|\d+)(?:\.\d+)?(?:[eE][+-]?\d+(?![\w.]))?|\.\d+|\\[A-Za-z]+|[A-Za-z]|[-+*/^%(){}\[\]]")

#: A term: the number under its root (without square factors), and its symbols with their exponents.
Term = tuple[int, tuple[tuple[str, Fraction], ...]]
Sum = dict[Term, Fraction]
ONE: Term = (1, ())


class NoExpression(ValueError):
    """A text that is no expression of those known here."""


def _constant(x: Sum) -> Fraction | None:
    return Fraction(0) if not x else x[ONE] if set(x) == {ONE} else None


def _checked(x: Sum) -> Sum:
    x = {k: v for k, v in x.items() if v}
    if len(x) > MOST_TERMS or any(max(v.numerator.bit_length(), v.denominator.bit_length()) > MOST_BITS for v in x.values()):
        raise NoExpression
    return x


def _plus(x: Sum, y: Sum, sign: int = 1) -> Sum:
    out = dict(x)
    for term, c in y.items():
        out[term] = out.get(term, Fraction(0)) + sign * c
    return _checked(out)


def _times(x: Sum, y: Sum) -> Sum:
    if len(x) * len(y) > MOST_TERMS**2:
        raise NoExpression
    out: Sum = {}
    for (r, s), c in x.items():
        for (q, t), d in y.items():
            both = math.gcd(r, q)
            powers = dict(s)
            for name, power in t:
                powers[name] = powers.get(name, Fraction(0)) + power
            term = (r // both * (q // both), tuple(sorted((n, p) for n, p in powers.items() if p)))
            out[term] = out.get(term, Fraction(0)) + c * d * both
    return _checked(out)


def _over(x: Sum, y: Sum) -> Sum:
    """A quotient; of sums, one that is a multiple of the other is a number."""
    if len(y) > 1 and set(x) == set(y) and len({x[k] / y[k] for k in y}) == 1:
        return {ONE: x[min(x)] / y[min(x)]}
    return _times(x, _inverse(y))


def _inverse(x: Sum) -> Sum:
    if not x:
        raise NoExpression
    if len(x) == 1:
        ((root, symbols), c), *_ = x.items()
        return {(root, tuple((n, -p) for n, p in symbols)): 1 / (c * root)}
    first = x[min(x)]  # a sum that is divided by is a symbol, without the factor of its first term
    return {(1, ((f"({written({k: v / first for k, v in x.items()})})", Fraction(-1)),)): 1 / first}


def _power(x: Sum, power: Fraction) -> Sum:
    if power.denominator == 2 and (c := _constant(x)) is not None and c >= 0:
        return _power(_root(c), Fraction(power.numerator))
    if power.denominator == 1 and abs(power) <= 32:
        out = {ONE: Fraction(1)}
        for _ in range(abs(int(power))):
            out = _times(out, x)
        return _inverse(out) if power < 0 else out
    c = _constant(x)
    if power.denominator == 1 and c is not None and abs(power) * max(c.numerator.bit_length(), c.denominator.bit_length()) <= MOST_BITS and (c or power > 0):
        return _checked({ONE: c ** int(power)})
    if c is not None and c >= 0 and power.denominator <= 16 and (whole := _whole_root(c, power.denominator)) is not None:
        return _power({ONE: whole} if whole else {}, Fraction(power.numerator))
    name = f"({written(x)})"
    return {(1, ((name, power),)): Fraction(1)}


def _whole_root(c: Fraction, degree: int) -> Fraction | None:
    """The rational root of a number, if it has one."""
    if max(c.numerator, c.denominator) >= 1 << 50:
        return None
    found = Fraction(round(c.numerator ** (1 / degree)), round(c.denominator ** (1 / degree)))
    return found if found**degree == c else None


def _root(c: Fraction) -> Sum:
    """The square root of a number, without square factors under it."""
    under, out, k = c.numerator * c.denominator, 1, 2
    if under.bit_length() > 40:
        raise NoExpression
    while k * k <= under and k < 1 << 16:
        while under % (k * k) == 0:
            under, out = under // (k * k), out * k
        k += 1
    whole = math.isqrt(under)
    if whole * whole == under and under > 1:
        under, out = 1, out * whole
    return _checked({(max(under, 1), ()): Fraction(out if under else 0, c.denominator)})


def written(x: Sum) -> str:
    """A sum as text: its terms in one order."""
    def term(k: Term, v: Fraction) -> str:
        return "*".join([str(v), *([f"sqrt{k[0]}"] if k[0] > 1 else []), *[n if p == 1 else f"{n}^{p}" for n, p in k[1]]])

    return "+".join(term(k, x[k]) for k in sorted(x)) or "0"


def expression(text: str) -> Sum:
    """The sum of terms that an answer stands for; NoExpression for anything else."""
    for old, new in SPELLINGS.items():
        text = text.replace(old, new)
    text = re.sub(SILENT, "", text)
    tokens = _TOKEN.findall(text)
    if not tokens or len(text) > MOST_CHARS or "".join(tokens) != text:
        raise NoExpression
    tokens.reverse()

    def take(what: str) -> None:
        if not tokens or tokens.pop() != what:
            raise NoExpression

    def total() -> Sum:
        out: Sum = {}
        sign = 1
        while tokens and tokens[-1] in "+-":
            sign = -sign if tokens.pop() == "-" else sign
        while True:
            out = _plus(out, product(), sign)
            if not tokens or tokens[-1] not in "+-":
                return out
            sign = 1
            while tokens and tokens[-1] in "+-":
                sign = -sign if tokens.pop() == "-" else sign

    def product() -> Sum:
        out = factor()
        while tokens and tokens[-1] not in "+-)}]":
            if tokens[-1] in "*/":
                by = tokens.pop()
                negative = bool(tokens) and tokens[-1] == "-" and bool(tokens.pop())
                right = factor()
                out = _over(out, right) if by == "/" else _times(out, right)
                out = _times(out, {ONE: Fraction(-1)}) if negative else out
            else:
                out = _times(out, factor())
        return out

    def factor() -> Sum:
        out = atom()
        while tokens and tokens[-1] in "^%":
            if tokens.pop() == "%":
                out = _times(out, {ONE: Fraction(1, 100)})
                continue
            negative = tokens[-1:] == ["-"] and bool(tokens.pop())
            power = _constant(atom())
            if power is None or abs(power) > 10**6:
                raise NoExpression
            out = _power(out, -power if negative else power)
        return out

    def atom() -> Sum:
        if not tokens:
            raise NoExpression
        token = tokens.pop()
        if token[0].isdigit() or token[0] == ".":
            if "e" in token.lower() and abs(int(token.lower().partition("e")[2])) > 300:
                raise NoExpression
            return _checked({ONE: Fraction(token.replace(",", ""))})
        if token in "({":
            out = total()
            take(")" if token == "(" else "}")
            return out
        if token == "\\frac":
            above = argument()
            return _over(above, argument())
        if token == "\\sqrt":
            degree = Fraction(2)
            if tokens[-1:] == ["["]:
                tokens.pop()
                degree = _constant(total()) or Fraction(0)
                take("]")
            if degree < 1 or degree.denominator > 1:
                raise NoExpression
            return _power(argument(), 1 / degree)
        if token[0] == "\\" or token.isalpha():
            return {(1, ((token, Fraction(1)),)): Fraction(1)}
        raise NoExpression

    def argument() -> Sum:
        if tokens and tokens[-1].isdigit() and len(tokens[-1]) > 1:  # \frac12: a digit each
            token = tokens.pop()
            tokens.append(token[1:])
            return {ONE: Fraction(int(token[0]))}
        return atom()

    out = total()
    if tokens:
        raise NoExpression
    return out


def canonical(text: str | None) -> str | None:
    """Equal for equivalent answers: their expressions' terms in one order, or else the text without white space."""
    if text is None:
        return None
    try:
        return "=" + written(expression(text))
    except (NoExpression, RecursionError):
        return re.sub(r"\s", "", text)


def equivalent(a: str | None, b: str | None) -> bool:
    """Whether two answers are the same expression, or the same text but for spacing; null is equal to nothing."""
    return a is not None and b is not None and canonical(a) == canonical(b)


@F.pandas_udf(StringType())
def _canonical(text: pd.Series) -> pd.Series:
    known: dict[str, str] = {}  # answers repeat
    return text.map(lambda x: known.get(x) or known.setdefault(x, canonical(x)), na_action="ignore")


def answer_key(text: Column) -> Column:
    """``canonical`` of a column, to group by."""
    ship()
    return _canonical(text)


def maths_equal(a: Column, b: Column) -> Column:
    """Equivalence as ``equivalent`` has it."""
    return F.coalesce(answer_key(a) == answer_key(b), F.lit(False))


def latex_equal(a: Column, b: Column, comparator: Callable[[str | None, str | None], bool] = equivalent) -> Column:
    @F.pandas_udf(BooleanType())
    def compare(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([bool(comparator(p, q)) for p, q in zip(x, y, strict=True)])

    ship()
    return compare(a, b)
