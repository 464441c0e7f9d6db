"""Equality of mathematical answers in LaTeX or plain notation (RWD-07).

An answer is read into a value that computes itself: rational expressions modulo large primes at random places of their variables (where two
that agree are equal but for a chance of about degree / prime), others (roots, functions, pi) as complex numbers at random places. Nothing is
ever evaluated as a program, and no length makes a difference.
"""

from __future__ import annotations

import cmath
import functools
import math
import random
import re
from collections.abc import Callable
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import answers as A

PRIMES = (2**61 - 1, 2**89 - 1, 2**107 - 1)
PLACES = 4
#: Names of functions, and of constants.
FUNCTIONS: dict[str, Callable[[complex], complex]] = {"sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "ln": cmath.log, "log": cmath.log10, "exp": cmath.exp, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "sqrt": cmath.sqrt}
CONSTANTS = {"pi": cmath.pi, "e": cmath.e, "i": 1j}
_TOKEN = re.compile(r"\s*(?:(\d+(?:,\d{3})+(?:\.\d+)?(?![\d,])|\d+\.?\d*|\.\d+)|\\([A-Za-z]+)|([A-Za-z](?:_\{?\w+\}?)?)|(.))", re.S)


class Unreadable(ValueError):
    pass


class NotRational(ValueError):
    """A value that a field of residues doesn't have: a root, a function, a constant."""


@functools.lru_cache(1 << 12)
def _place(name: str) -> int:
    """A random place of a variable for each prime, as the one residue modulo their product."""
    p = math.prod(PRIMES)
    rests = ((random.Random(f"{seed}:{q}:{name}").randrange(1, q), q) for seed, q in enumerate(PRIMES))
    return sum(r * (p // q) * pow(p // q, -1, q) for r, q in rests) % p


class Field:
    """Arithmetic modulo the product of the primes, at random places of the variables: residues are equal if they are modulo each prime."""

    p = math.prod(PRIMES)

    def number(self, x: Fraction | int) -> int:
        return x % self.p if x.denominator == 1 else x.numerator * pow(x.denominator, -1, self.p) % self.p

    def variable(self, name: str) -> int:
        return _place(name)

    def add(self, a: int, b: int) -> int:
        return (a + b) % self.p

    def multiply(self, a: int, b: int) -> int:
        return a * b % self.p

    def divide(self, a: int, b: int) -> int:
        return a * pow(b, -1, self.p) % self.p  # no inverse: ValueError

    def power(self, a: int, n: Fraction | None, _: int) -> int:
        if n is None or n.denominator != 1:
            raise NotRational
        return pow(a, int(n), self.p)

    def call(self, name: str, a: int) -> int:
        raise NotRational

    def constant(self, name: str) -> int:
        raise NotRational


@functools.lru_cache(1 << 12)
def _point(seed: int, name: str) -> complex:
    return complex(random.Random(f"{seed}:{name}").uniform(0.3, 1.7))


class Complex:
    """Complex numbers, at random places of the variables."""

    def __init__(self, seed: int):
        self.seed = seed

    def number(self, x: Fraction | int) -> complex:
        return complex(x.numerator / x.denominator)

    def variable(self, name: str) -> complex:
        return _point(self.seed, name)

    def add(self, a: complex, b: complex) -> complex:
        return a + b

    def multiply(self, a: complex, b: complex) -> complex:
        return a * b

    def divide(self, a: complex, b: complex) -> complex:
        return a / b

    def power(self, a: complex, _: Fraction | None, n: complex) -> complex:
        return a**n

    def call(self, name: str, a: complex) -> complex:
        return FUNCTIONS[name](a)

    def constant(self, name: str) -> complex:
        return CONSTANTS[name]


class Reader:
    """Reads one expression and computes it in a given arithmetic on the way: sums of products of powers, \\frac, \\sqrt, functions, and products without a sign."""

    def __init__(self, tokens: list[tuple[str, str]], arithmetic):
        self.tokens, self.at, self.a = tokens, 0, arithmetic

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, sign: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if sign is not None and token != ("sign", sign):
            raise Unreadable(sign)
        self.at += 1
        return token

    def whole(self):
        out = self.sum()
        if self.peek()[0] != "end":
            raise Unreadable(self.peek()[1])
        return out

    def sum(self):
        out = None
        while True:
            minus = False
            while self.peek() in (("sign", "+"), ("sign", "-")):
                minus ^= self.take()[1] == "-"
            term = self.product()
            if minus:
                term = self.a.multiply(self.a.number(-1), term)
            out = term if out is None else self.a.add(out, term)
            if self.peek() not in (("sign", "+"), ("sign", "-")):
                return out

    def product(self):
        out = self.factor()
        while True:
            kind, value = self.peek()
            if (kind, value) in (("sign", "*"), ("sign", "/")):
                self.take()
                minus = False
                while self.peek() in (("sign", "+"), ("sign", "-")):
                    minus ^= self.take()[1] == "-"
                right = self.factor()
                out = (self.a.multiply if value == "*" else self.a.divide)(out, right)
                if minus:
                    out = self.a.multiply(self.a.number(-1), out)
            elif kind in ("number", "name", "call", "constant") or (kind, value) in (("sign", "("), ("sign", "{")):
                out = self.a.multiply(out, self.factor())
            else:
                return out

    def factor(self):
        base = self.atom()
        while self.peek() in (("sign", "^"), ("sign", "%"), ("sign", "!")):
            if self.take()[1] == "%":
                base = self.a.divide(base, self.a.number(100))
                continue
            if self.tokens[self.at - 1][1] == "!":
                raise Unreadable("!")
            start = self.at
            exact = self.exponent(Exact)
            self.at = start
            base = self.a.power(base, exact, self.exponent(lambda: self.a))
        return base

    def exponent(self, arithmetic: Callable):
        """The exponent, in another arithmetic; None where that has no such value."""
        inner = Reader(self.tokens, arithmetic())
        inner.at = self.at
        try:
            minus = False
            while inner.peek() in (("sign", "+"), ("sign", "-")):
                minus ^= inner.take()[1] == "-"
            out = inner.atom()
            while inner.peek() == ("sign", "^"):
                inner.take()
                start = inner.at
                n = inner.exponent(Exact)
                inner.at = start
                out = inner.a.power(out, n, inner.exponent(lambda: inner.a))
            out = inner.a.multiply(inner.a.number(-1), out) if minus else out
        except NotRational:
            if arithmetic is Exact:
                return None
            raise
        self.at = inner.at
        return out

    def atom(self):
        kind, value = self.take()
        if kind == "number":
            return self.a.number(int(value) if value.isdecimal() else Fraction(value.replace(",", "")))
        if kind == "name":
            return self.a.variable(value)
        if kind == "constant":
            return self.a.constant(value)
        if kind == "call":
            return self.called(value)
        if value in "({[":
            out = self.sum()
            self.take({"(": ")", "{": "}", "[": "]"}[value])
            return out
        if value == "|":
            raise Unreadable("|")
        raise Unreadable(value)

    def called(self, name: str):
        if name == "frac":
            above = self.argument()
            return self.a.divide(above, self.argument())
        if name == "sqrt":
            root = None
            if self.peek() == ("sign", "["):
                self.take()
                root = self.sum()
                self.take("]")
            inside = self.argument()
            if root is None:
                return self.a.call("sqrt", inside)
            return self.a.power(inside, None, self.a.divide(self.a.number(1), root))
        power = None
        if self.peek() == ("sign", "^"):
            self.take()
            power = self.exponent(Exact)
            if power is None or power < 0:
                raise Unreadable("^")
        value = self.a.call(name, self.argument() if self.peek() in (("sign", "("), ("sign", "{")) else self.product())
        return value if power is None else self.a.power(value, power, self.a.number(power))

    def argument(self):
        """A group, or the one digit or letter that LaTeX takes."""
        kind, value = self.peek()
        if kind == "number" and len(value) > 1 and "." not in value:
            self.tokens[self.at : self.at + 1] = [("number", c) for c in value]
        return self.atom()


class Exact:
    """Fractions, for exponents: variables and functions have no value here, nor have powers of more than 2 ** 12 bits."""

    number = staticmethod(Fraction)
    add = staticmethod(lambda a, b: a + b)
    multiply = staticmethod(lambda a, b: a * b)

    @staticmethod
    def divide(a: Fraction, b: Fraction) -> Fraction:
        if not b:
            raise NotRational
        return a / b

    @staticmethod
    def power(a: Fraction, n: Fraction | None, _) -> Fraction:
        if n is None or n.denominator != 1 or abs(n) * max(a.numerator.bit_length(), a.denominator.bit_length()) > 1 << 12 or (not a and n < 0):
            raise NotRational
        return a ** int(n)

    @staticmethod
    def variable(name: str):
        raise NotRational

    constant = variable

    @staticmethod
    def call(name: str, a):
        raise NotRational


#: Signs of LaTeX and of print, and what they mean.
_SAME = {"cdot": "*", "times": "*", "div": "/", "lbrace": "{", "rbrace": "}", "pm": "±"}
_SIGNS = {"×": "*", "·": "*", "÷": "/", "−": "-", "–": "-", "π": "\\pi ", "√": "\\sqrt ", "**": "^", "∞": "\\infty "}
_DEGREES = re.compile(r"\^\s*(?:\\circ|\{\s*\\circ\s*\})")
_BLANK = re.compile(r"\\(?:text|mbox|textbf)\s*\{[^{}]*\}|\\[,;:! ]|~|°")
_SKIPPED = {"left", "right", "displaystyle", "quad", "big", "Big", "limits", "mathrm", "mathbf", "rm", "circ"}


def _tokens(text: str) -> list[tuple[str, str]]:
    for sign, meaning in _SIGNS.items():
        text = text.replace(sign, meaning)
    text = _BLANK.sub(" ", _DEGREES.sub(" ", text))
    out: list[tuple[str, str]] = []
    for number, command, name, sign in (m.groups() for m in _TOKEN.finditer(text.strip())):
        if number:
            out.append(("number", number))
        elif command:
            command = {"dfrac": "frac", "tfrac": "frac", "cfrac": "frac"}.get(command, command)
            if command in _SKIPPED:
                continue
            if command in _SAME:
                out.append(("sign", _SAME[command]))
            elif command == "frac" or command in FUNCTIONS:
                out.append(("call", command))
            elif command in CONSTANTS:
                out.append(("constant", command))
            else:
                out.append(("name", "\\" + command))
        elif name:
            out.append(("constant", name) if name in ("e", "i") else ("name", name))
        elif not sign.isspace():
            out.append(("sign", sign))
    return _words(out)


_SPELT = {*FUNCTIONS, "pi"}
_LENGTHS = sorted({len(w) for w in _SPELT}, reverse=True)


def _words(tokens: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Function names spelt without a backslash become calls."""
    out, i = [], 0
    letters = "".join(v if k in ("name", "constant") and len(v) == 1 else " " for k, v in tokens)
    while i < len(tokens):
        for n in _LENGTHS:
            word = letters[i : i + n]
            if word in _SPELT:
                out.append(("constant", "pi") if word == "pi" else ("call", word))
                i += n
                break
        else:
            out.append(tokens[i])
            i += 1
    return out


def _split(tokens: list[tuple[str, str]], sign: str) -> list[list[tuple[str, str]]]:
    """Parts between signs that stand in no brackets."""
    out, deep = [[]], 0
    for kind, value in tokens:
        if kind == "sign":
            deep += (value in "({[") - (value in ")}]")
            if value == sign and not deep:
                out.append([])
                continue
        out[-1].append((kind, value))
    return out


def _one_equal(a: list, b: list) -> bool:
    try:
        return Reader(list(a), Field()).whole() == Reader(list(b), Field()).whole()
    except NotRational:
        pass
    except ValueError:
        return False
    hits = 0
    for seed in range(PLACES):
        try:
            x, y = Reader(list(a), Complex(seed)).whole(), Reader(list(b), Complex(seed)).whole()
        except (ValueError, ArithmeticError, TypeError):
            continue
        if not cmath.isfinite(x) or not cmath.isfinite(y) or not cmath.isclose(x, y, rel_tol=1e-11, abs_tol=1e-13):
            return False
        hits += 1
    return hits > 0


def _pieces(tokens: list) -> tuple[str, list[list]]:
    """How an answer is made up ('{' for a set, '(,)' and the like for ordered ones, '' for one value), and its parts."""
    for sides in [_split(tokens, "=")]:
        if len(sides) == 2 and len(sides[0]) == 1 and sides[0][0][0] == "name":
            tokens = sides[1]  # x = ...
    for i, (kind, value) in enumerate(tokens):
        if (kind, value) == ("sign", "±"):
            return "{", [tokens[:i] + [("sign", s)] + tokens[i + 1 :] for s in "+-"]
    if tokens and tokens[0][0] == "sign" and tokens[-1][0] == "sign" and tokens[0][1] in "([{\\" and tokens[-1][1] in ")]}\\":
        inside = tokens[1:-1]
        parts = _split(inside, ",")
        if len(parts) > 1 and len(_split(tokens, ",")) == 1:
            kind = tokens[0][1] + tokens[-1][1]
            return ("{", parts) if kind == "{}" else (kind, parts)
    parts = _split(tokens, ",")
    return ("{", parts) if len(parts) > 1 else ("", [tokens])


def symbolic_equal(a: str, b: str) -> bool:
    """Whether two answers say the same: equal values or expressions, tuples and intervals part by part, sets and lists without brackets in any order. What can't be read equals nothing."""
    try:
        (kind, x), (other, y) = _pieces(_tokens(_core(a))), _pieces(_tokens(_core(b)))
        if kind != other or len(x) != len(y) or not all(x) or not all(y):
            return False
        if kind != "{":
            return all(map(_one_equal, x, y))
        left = list(y)
        for one in x:
            at = next((i for i, two in enumerate(left) if _one_equal(one, two)), None)
            if at is None:
                return False
            del left[at]
        return True
    except (Unreadable, RecursionError, OverflowError):
        return False


def _core(text: str) -> str:
    text = re.sub(r"\\[()\[\]]", "", (A.unboxed(text) or text).replace("\\{", "{").replace("\\}", "}").replace("\\%", "%"))
    text = text.replace("$", "").strip().rstrip(".")
    return text


def equal_answers(a: Column, b: Column) -> Column:
    """symbolic_equal as a Column function; null if either is."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else symbolic_equal(p, q) for p, q in zip(x, y, strict=True)], dtype=object)

    return F.pandas_udf(run, "boolean")(a, b)

