"""Mathematical answers by meaning: a surface in Spark's own functions, and a verdict of `equal`, `different` or `undecided`.

Equality of expressions is decided by their values, to 60 digits, at points that are drawn from a hash of each unknown's
name: expressions that differ anywhere at a point are different for certain; expressions that agree at all points are
equal but for a chance below 1e-30. Functions that are not evaluated (sin, log, ...) stand for a number drawn from their
name and argument, so their equality is seen, but not their difference; nor is that of anything that isn't understood.

The parser and the matching run in a Pandas UDF, once for each different pair of a task's batch; all that is said of
rows, such as counts and joins by meaning (`expression_key`), is left to Spark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from decimal import Context, Decimal, DecimalException
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from heddle.functions.text import let

#: Points at which expressions are compared, digits of the values, and digits in which equal ones may differ.
POINTS = 4
_C = Context(prec=60, Emax=10**5, Emin=-(10**5))
_NEAR = Decimal(10) ** -35
#: Characters of an expression that is still looked at (a fixed value of the answers' contract), and of a whole answer.
LONGEST, LONGEST_ANSWER = 512, 8192

# What stands for nothing in an answer's surface, in the order of application.
SURFACE: list[tuple[str, str]] = [
    (r"^[\s$]+|[\s$]+$", ""), (r"\\left(?![a-zA-Z])|\\right(?![a-zA-Z])|\\displaystyle", ""), (r"\\\$", ""), (r"\\[dt]frac", r"\\frac"), (r"\\phantom(?:\{[^{}]*\}|.)", ""), (r"[ .;]+$", ""),
    (r"(?i)\\(?:text|mathrm|mbox)\{\s*,?\s*(?:and|or)\s*\}", ","), (r",\s*(?:,\s*)+", ","), (r"(?i)\\text\{\s*degrees?\s*\}", ""), (r"^\\(?:text|mathrm)\{([^{}]+)\}$", "$1"),
    (r"(?<=.)\\(?:mbox|text|mathrm)\{[^{}]*[A-Za-z][^{}]*\}(?:\^\{?\d+\}?)?$", ""), (r"\{,\}|,\\!", ""), (r"\\[,!;:]", ""), (r"\\%", "%"), (r"(?i)^([0-9A-Z]+)_\{?\d+\}?$", "$1"), (r"\^\{?\\circ\}?", ""), (r"\s+", ""),
]


def surface(x: Column | str) -> Column:
    """An answer without what stands for nothing: spacing, sizes, dollar signs, trailing units, bases and grouped thousands."""
    out = F.col(x) if isinstance(x, str) else x
    for pattern, to in SURFACE:
        out = F.regexp_replace(out, pattern, to)
    return out


class Unclear(ValueError):
    """What isn't understood."""


Values = list[Decimal | None]


@lru_cache(1 << 12)
def _drawn(name: str) -> tuple[Decimal, ...]:
    """A point for each place of a comparison: between -3 and 3, of either sign, never near 0."""
    out = []
    for k in range(POINTS):
        n = int(hashlib.sha256(f"{k}|{name}".encode()).hexdigest()[:16], 16)
        out.append(_C.divide(Decimal(n % 10**12 + 10**11), Decimal(4 * 10**11)) * (1 if k % 2 else -1 if n >> 60 & 1 else 1))
    return tuple(out)


def _each(f: Callable[..., Decimal], *args: Values) -> Values:
    """f at each point; null where it has no value."""
    out: Values = []
    for xs in zip(*args, strict=True):
        try:
            out.append(None if None in xs else f(*xs))
        except (DecimalException, ZeroDivisionError, OverflowError):
            out.append(None)
    return out


def _power(x: Decimal, y: Decimal) -> Decimal | None:
    if y != y.to_integral_value() and x < 0:
        raise ZeroDivisionError  # no real value
    return _C.power(x, y)


class Expression:
    """Values of an expression at the points; `free` if a function in it isn't evaluated. One method a level of the grammar."""

    GREEK = frozenset("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi rho sigma tau phi chi psi omega".split())
    FUNCTIONS = frozenset("sin cos tan cot sec csc sinh cosh tanh arcsin arccos arctan log ln exp".split())
    KNOWN = GREEK | FUNCTIONS | {"frac", "sqrt", "pi"}
    _NUMBER = re.compile(r"\d+(?:\.\d+)?|\.\d+")
    _COMMAND = re.compile(r"\\([A-Za-z]+)")
    _RUN = re.compile(r"[A-Za-z0-9]+")

    def __init__(self, text: str) -> None:
        if not text or len(text) > LONGEST:
            raise Unclear(text[:40])
        self.text, self.at, self.free = text, 0, False
        self.values = self.sum()
        if self.at < len(text):
            raise Unclear(text)

    def take(self, *options: str) -> str | None:
        for x in options:
            if self.text.startswith(x, self.at):
                self.at += len(x)
                return x
        return None

    def sum(self) -> Values:
        sign = self.take("+", "-")
        out = self.product()
        if sign == "-":
            out = _each(_C.minus, out)
        while op := self.take("+", "-"):
            out = _each(_C.add if op == "+" else _C.subtract, out, self.product())
        return out

    def product(self) -> Values:
        out = self.power()
        while True:
            if op := self.take("*", "/", r"\cdot", r"\times", r"\div"):
                out = _each(_C.divide if op in ("/", r"\div") else _C.multiply, out, self.signed())
            elif self.at < len(self.text) and (self.text[self.at] in "({\\." or self.text[self.at].isalnum()):
                out = _each(_C.multiply, out, self.power())
            else:
                return out

    def signed(self) -> Values:
        if self.take("-"):
            return _each(_C.minus, self.signed())
        self.take("+")
        return self.power()

    def power(self) -> Values:
        base = self.atom()
        return _each(_power, base, self.signed()) if self.take("^", "**") else base

    def group(self, begin: str, end: str) -> Values:
        if not self.take(begin):
            raise Unclear(self.text)
        out = self.sum()
        if not self.take(end):
            raise Unclear(self.text)
        return out

    def argument(self) -> Values:
        """A group, a command, or one character."""
        if self.text.startswith("{", self.at):
            return self.group("{", "}")
        if self.text[self.at : self.at + 1].isdigit():
            self.at += 1
            return [Decimal(self.text[self.at - 1])] * POINTS
        return self.atom()

    def atom(self) -> Values:
        if self.at >= len(self.text):
            raise Unclear(self.text)
        c = self.text[self.at]
        if c in "({":
            return self.group(c, ")" if c == "(" else "}")
        if m := self._NUMBER.match(self.text, self.at):
            self.at = m.end()
            return [Decimal(m[0])] * POINTS
        if m := self._COMMAND.match(self.text, self.at):  # spaces are gone: the longest name that is known ends a command
            name = next((m[1][:n] for n in range(len(m[1]), 0, -1) if m[1][:n] in self.KNOWN), m[1])
            self.at += 1 + len(name)
            return self.command(name)
        if c.isascii() and c.isalpha():
            if self.take("sqrt"):
                return _each(_C.sqrt, self.group("(", ")"))
            if self.take("pi"):
                return [PI] * POINTS
            self.at += 1
            return self.named(c)
        raise Unclear(self.text)

    def named(self, name: str) -> Values:
        if self.take("_"):
            m = re.compile(r"\{[A-Za-z0-9]+\}|[A-Za-z0-9]").match(self.text, self.at)
            if not m:
                raise Unclear(self.text)
            self.at = m.end()
            name += "_" + m[0].strip("{}")
        return list(_drawn(name))

    def command(self, name: str) -> Values:
        if name == "frac":
            return _each(_C.divide, self.argument(), self.argument())
        if name == "sqrt":
            if self.take("["):
                degree = self.sum()
                if not self.take("]"):
                    raise Unclear(self.text)
                return _each(lambda x, n: -_power(-x, 1 / n) if x < 0 and n % 2 == 1 else _power(x, _C.divide(Decimal(1), n)), self.argument(), degree)
            m = self._RUN.match(self.text, self.at)  # without braces, all letters and digits that follow
            if not m:
                return _each(_C.sqrt, self.argument())
            self.at = m.end()
            return _each(_C.sqrt, Expression(m[0]).values)
        if name == "pi":
            return [PI] * POINTS
        if name in self.GREEK:
            return self.named(name)
        if name in self.FUNCTIONS:
            self.free = True
            power = self.signed() if self.take("^") else None
            inner = self.power()
            out = _each(lambda x: abs(_drawn(f"{name}({_rounded(x)})")[0]), inner)
            return _each(_power, out, power) if power else out
        raise Unclear(name)


PI = Decimal("3.14159265358979323846264338327950288419716939937510582097494459230781640628620899862803")


def _rounded(x: Decimal) -> str:
    """30 digits of x: what equal values have in common."""
    return "0" if abs(x) < _NEAR else str(Context(prec=30).plus(x).normalize())


@lru_cache(1 << 14)
def expression(text: str) -> Expression | None:
    try:
        return Expression(text)
    except (Unclear, RecursionError, DecimalException):
        return None


def _close(x: Decimal, y: Decimal) -> bool:
    return abs(_C.subtract(x, y)) <= _NEAR * max(Decimal(1), abs(x), abs(y))


Verdict = bool | None


def same_value(a: str, b: str) -> Verdict:
    """Whether two expressions have the same value wherever both have one."""
    x, y = expression(a), expression(b)
    if x is None or y is None:
        return None
    both = [(u, v) for u, v in zip(x.values, y.values, strict=True) if u is not None and v is not None]
    if len(both) < 2:
        return None
    return True if all(_close(u, v) for u, v in both) else None if x.free or y.free else False


def same_equation(a: str, b: str) -> Verdict:
    """Whether two equations say the same up to a factor: the ratio of their sides' differences is one number at all points."""
    sides = [expression(s) for s in (*a.split("="), *b.split("="))]
    if any(s is None for s in sides):
        return None
    x, y = (_each(_C.subtract, sides[i].values, sides[i + 1].values) for i in (0, 2))
    both = [(u, v) for u, v in zip(x, y, strict=True) if u is not None and v is not None]
    if len(both) < 2:
        return None
    if all(_close(u, v) for u, v in both):
        return True
    u0, v0 = both[0]
    ok = all(abs(u) > _NEAR and abs(v) > _NEAR for u, v in both) and all(_close(_C.multiply(u, v0), _C.multiply(v, u0)) for u, v in both)
    return True if ok else None if any(s.free for s in sides) else False


def parts(text: str, cuts: Sequence[str] = (",",)) -> list[str]:
    """The text cut at the marks outside all brackets; no empty parts."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(text):
        depth = max(0, depth + (text[i] in "{([") - (text[i] in "})]"))
        mark = next((c for c in cuts if depth == 0 and text.startswith(c, i)), None)
        if mark:
            out.append(text[start:i])
            start = i + len(mark)
        i += len(mark) if mark else 1
    return [p for p in [*out, text[start:]] if p]


def every(found: Sequence[Verdict]) -> Verdict:
    return False if False in found else None if None in found else True


def matched(table: list[list[bool]]) -> bool:
    """Whether rows and columns can be paired off along true cells: augmenting paths."""
    owner: dict[int, int] = {}

    def place(row: int, tried: set[int]) -> bool:
        for column, fits in enumerate(table[row]):
            if fits and column not in tried:
                tried.add(column)
                if column not in owner or place(owner[column], tried):
                    owner[column] = row
                    return True
        return False

    return all(place(row, set()) for row in range(len(table)))


def any_order(a: list[str], b: list[str]) -> Verdict:
    if len(a) != len(b):
        return False
    table = [[same_part(x, y) for y in b] for x in a]
    if matched([[v is True for v in row] for row in table]):
        return True
    return None if matched([[v is not False for v in row] for row in table]) else False


_MATRIX = re.compile(r"(.*?)\\begin\{([pbv]?matrix)\}(.*)\\end\{\2\}", re.DOTALL)


def entries(text: str) -> list[str] | None:
    """A matrix's entries, row by row, with the factor before it."""
    m = _MATRIX.fullmatch(text)
    return [f"({m[1]})*({x})" if m[1] else x for row in m[3].split("\\\\") for x in row.split("&") if x] if m else None


def bracketed(text: str) -> tuple[str, list[str]] | None:
    """The brackets around a tuple or an interval, and what they hold."""
    if len(text) > 2 and text[0] in "([" and text[-1] in ")]" and len(inner := parts(text[1:-1])) > 1 and (text[0] + text[-1] == "()" or len(inner) == 2):
        return text[0] + text[-1], inner
    return None


def assigned(text: str) -> str | None:
    """What a single name is said to be."""
    left, sign, right = text.partition("=")
    if not sign or "=" in right:
        return None
    name = re.compile(r"[A-Za-z][A-Za-z0-9_]*")
    return right if right and name.fullmatch(left) else left if left and name.fullmatch(right) else None


def same_part(a: str, b: str) -> Verdict:
    if a == b:
        return True
    x, y = (parts(t, ("\\cup", "∪")) for t in (a, b))
    if len(x) > 1 or len(y) > 1:
        return any_order(x, y)
    p, q = bracketed(a), bracketed(b)
    m, n = entries(a), entries(b)
    if m or n:
        m, n = (e or (t[1] if t and t[0] == "()" else None) for e, t in ((m, p), (n, q)))
        return m is not None and n is not None and len(m) == len(n) and every([same_part(*z) for z in zip(m, n, strict=True)])
    if p or q:
        return p is not None and q is not None and p[0] == q[0] and len(p[1]) == len(q[1]) and every([same_part(*z) for z in zip(p[1], q[1], strict=True)])
    for one, other, swap in ((a, b, False), (b, a, True)):
        if "=" not in other and (value := assigned(one)) is not None:
            return same_part(other, value) if swap else same_part(value, other)
    if a.count("=") == 1 == b.count("="):
        return same_equation(a, b)
    return same_value(a, b)


@lru_cache(1 << 14)
def same_answer(a: str, b: str) -> Verdict:
    """Whether two surfaces mean the same answer; lists in any order."""
    if a == b:
        return True
    if max(len(a), len(b)) > LONGEST_ANSWER:
        return None
    x, y = parts(a), parts(b)
    return same_part(a, b) if len(x) == len(y) == 1 else any_order(x, y)


_SAID = {True: "equal", False: "different", None: "undecided"}


@F.pandas_udf(StringType())
def _verdicts(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _SAID[same_answer(x, y)] for x, y in zip(a, b, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def _keys(a: pd.Series) -> pd.Series:
    def key(text: str | None) -> str | None:
        found = expression(text) if text else None
        return None if found is None or None in found.values else hashlib.sha256("|".join(map(_rounded, found.values)).encode()).hexdigest()[:32]

    return pd.Series([key(x) for x in a], dtype=object)


#: A whole number or a fraction of two, of 9 digits at most: of two such, those that differ do so by more than `_NEAR`.
_RATIO = r"^[\s$]*([-+]?)(?:(\d{1,9})|\\[dt]?frac\{(\d{1,9})\}\{(\d{1,9})\})[\s$]*$"
_MARK = "\x01"


def _ratio_verdict(a: Column, b: Column) -> Column:
    """`equal` or `different` where both are such numbers, by whole numbers; else null."""

    def sides(x: Column) -> tuple[Column, Column]:
        cut = F.regexp_replace(F.when(~F.startswith(x, F.lit(_MARK)), x), _RATIO, _MARK + "$1$2$3/$4")  # mark, above, a slash, below
        own = F.when(F.startswith(cut, F.lit(_MARK)), F.substring(cut, 2, 32))
        below = F.substring_index(own, "/", -1)
        return F.substring_index(own, "/", 1).try_cast("long"), F.nullif(F.when(below == "", F.lit(1)).otherwise(below.try_cast("long")), F.lit(0))

    x, y = sides(a), sides(b)
    same = x[0] * y[1] == y[0] * x[1]
    return F.when(a.isNotNull() & b.isNotNull(), F.when(same, "equal").when(~same, "different"))


#: A whole number or a fraction of two, of 9 digits at most: of two such, those that differ do so by more than `_NEAR`.
_RATIO = r"^[\s$]*([-+]?)(?:(\d{1,9})|\\[dt]?frac\{(\d{1,9})\}\{(\d{1,9})\})[\s$]*$"
_MARK = "\x01"


def ratio_verdict(a: Column | str, b: Column | str) -> Column:
    """`equal` or `different` where both answers are plain numbers or fractions, compared by whole numbers; else null: what `math_verdict` says, without Python."""

    def sides(x: Column | str) -> Column:
        x = F.col(x) if isinstance(x, str) else x
        cut = F.regexp_replace(F.when(~F.startswith(x, F.lit(_MARK)), x), _RATIO, _MARK + "$1$2$3/$4")  # mark, above, a slash, below
        return F.when(F.startswith(cut, F.lit(_MARK)), F.split(F.substring(cut, 2, 32), "/"))

    def of(two: Column) -> Column:
        above, below = (lambda x: x[0].try_cast("long")), (lambda x: F.nullif(F.when(x[1] == "", F.lit(1)).otherwise(x[1].try_cast("long")), F.lit(0)))
        return above(two["a"]) * below(two["b"]) == above(two["b"]) * below(two["a"])

    same = let(F.struct(sides(a).alias("a"), sides(b).alias("b")), of)
    return F.when(same, "equal").when(~same, "different")


def math_verdict(a: Column | str, b: Column | str) -> Column:
    """`equal`, `different` or `undecided`: two LaTeX answers, compared by structure and meaning; null if either is null."""
    return _verdicts(surface(a), surface(b))


def expression_key(a: Column | str) -> Column:
    """A key that expressions of the same value share, to group or join answers by meaning; null for what has no value at some point."""
    return _keys(surface(a))


#: The options of a multiple choice stand behind their letters in the prompt.
_OPTION = r"(?:\\(?:textbf|text|mathrm)\{{\({0}\)\s*\}}|\({0}\))(.*?)(?=\\(?:textbf|text|mathrm)\{{\([A-E]\)|\([A-E]\)|$)"


def chosen_option(prompt: Column | str, choice: Column | str) -> Column:
    """What stands in a prompt behind the letter (A to E) that an answer consists of; null if it is no such letter or isn't there."""
    text = F.col(prompt) if isinstance(prompt, str) else prompt
    letter = F.upper(F.trim(F.col(choice) if isinstance(choice, str) else choice))
    found = F.coalesce(*(F.when(letter == x, F.nullif(F.regexp_extract(text, "(?s)" + _OPTION.format(x), 1), F.lit(""))) for x in "ABCDE"))
    bare = F.regexp_replace(F.regexp_replace(found, r"\\(?:qquad|quad)\b|\$|\\ |\\\\", ""), r"^[\s.;]+|[\s.;]+$", "")
    return F.nullif(bare, F.lit(""))
