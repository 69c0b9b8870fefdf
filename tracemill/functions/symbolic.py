"""Equality of small symbolic answers, told by exact arithmetic at fixed points."""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Callable
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

#: Values are numbers modulo this prime. Two different quotients of polynomials of degree d agree at one point with a chance of d / PRIME.
PRIME = (1 << 61) - 1
POINTS = 4
TOLERANCE = 1e-6
CONSTANTS = {"pi": math.pi, "e": math.e}
FUNCTIONS: dict[str, Callable[[float], float]] = {"sqrt": math.sqrt, "log": math.log, "ln": math.log, "exp": math.exp, "sin": math.sin, "cos": math.cos, "tan": math.tan, "abs": abs}


def parse(text: str) -> ast.expr:
    """The tree of an expression; ValueError for what can't be read."""
    text = re.sub(r"\s+", " ", text.strip()).replace("^", "**").replace("×", "*").replace("÷", "/")
    text = re.sub(r"(?<=\d)\s*(?=[A-Za-z_(])|(?<=\))\s*(?=[\w(])", "*", text)
    try:
        return ast.parse(text, mode="eval").body
    except (SyntaxError, RecursionError, MemoryError) as e:
        raise ValueError(str(e)) from None


def at_point(node: ast.expr, point: int) -> int:
    """The value modulo PRIME with every name standing for a number drawn from it and the point."""
    match node:
        case ast.Constant(value=bool()):
            raise ValueError("no number")
        case ast.Constant(value=int() | float() as v):
            over, under = (v, 1) if isinstance(v, int) else _fraction(repr(v))
            return over * pow(under, -1, PRIME) % PRIME
        case ast.Name(id=name):
            return int.from_bytes(blake2b(f"{point} {name}".encode(), digest_size=8).digest()) % PRIME
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -at_point(x, point) % PRIME
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            return at_point(x, point)
        case ast.BinOp(left=a, op=ast.Pow(), right=b):
            return pow(at_point(a, point), _whole(b), PRIME)
        case ast.BinOp(left=a, op=op, right=b):
            x, y = at_point(a, point), at_point(b, point)
            match op:
                case ast.Add():
                    return (x + y) % PRIME
                case ast.Sub():
                    return (x - y) % PRIME
                case ast.Mult():
                    return x * y % PRIME
                case ast.Div():
                    return x * pow(y, -1, PRIME) % PRIME
    raise ValueError("not supported")


def _fraction(text: str) -> tuple[int, int]:
    digits, _, power = text.partition("e")
    whole, _, part = digits.partition(".")
    shift = len(part) - int(power or 0)
    return (int(whole + part), 10**shift) if shift >= 0 else (int(whole + part) * 10**-shift, 1)


def _whole(node: ast.expr) -> int:
    """A whole power, which may be written as a sum or product of numbers."""
    value = as_number(node)
    if value is None or value != int(value):
        raise ValueError("power")
    return int(value)


def as_number(node: ast.expr) -> float | None:
    """The value of an expression without names, roots and the like included; null if it has names."""
    match node:
        case ast.Constant(value=bool()):
            return None
        case ast.Constant(value=int() | float() as v):
            return float(v)
        case ast.Name(id=name):
            return CONSTANTS.get(name)
        case ast.Call(func=ast.Name(id=name), args=[x], keywords=[]) if name in FUNCTIONS:
            v = as_number(x)
            return None if v is None else FUNCTIONS[name](v)
        case ast.BinOp(left=ast.Name(id=name), op=ast.Mult(), right=x) if name in FUNCTIONS:  # sqrt(2) after juxtaposition
            v = as_number(x)
            return None if v is None else FUNCTIONS[name](v)
        case ast.UnaryOp(op=op, operand=x):
            v = as_number(x)
            return None if v is None else -v if isinstance(op, ast.USub) else v
        case ast.BinOp(left=a, op=op, right=b):
            x, y = as_number(a), as_number(b)
            if x is None or y is None:
                return None
            match op:
                case ast.Add():
                    return x + y
                case ast.Sub():
                    return x - y
                case ast.Mult():
                    return x * y
                case ast.Div():
                    return x / y
                case ast.Pow():
                    v = x**y
                    return v if isinstance(v, float) else None
    return None


def same_function(x: ast.expr, y: ast.expr) -> bool:
    """Whether two trees are one rational function, by their values at POINTS points; false if either is none."""
    agreed = 0
    for point in range(2 * POINTS):
        try:
            if at_point(x, point) != at_point(y, point):
                return False
            agreed += 1
        except (ValueError, RecursionError):  # a pole at this point, or nothing that is a rational function
            continue
        if agreed == POINTS:
            return True
    return False


def equal(a: str | None, b: str | None) -> bool:
    """Whether two expressions are one rational function, or nearly one number; false if either can't be read."""
    if a is None or b is None:
        return False
    try:
        x, y = parse(a), parse(b)
        if same_function(x, y):
            return True
        p, e = as_number(x), as_number(y)
        return p is not None and e is not None and (abs(p) < TOLERANCE if e == 0 else abs(p - e) / abs(e) < TOLERANCE)
    except (ValueError, ZeroDivisionError, OverflowError, RecursionError, TypeError):
        return False


def assignments(text: str) -> dict[str, str] | None:
    """Right sides of x=1, y=2 by their names; None if a part is no assignment."""
    out: dict[str, str] = {}
    for part in (p.strip() for p in re.split(r"[,\n;]+", text.strip().strip("()[]{}"))):
        name, sign, value = part.partition("=")
        if part and not (sign and re.fullmatch(r"[a-zA-Z_]\w*", name.strip())):
            return None
        if part:
            out[name.strip()] = value.strip()
    return out or None


def same_assignments(a: str | None, b: str | None) -> bool:
    """Whether two answers give the same names equal values, in any order."""
    x, y = assignments(a or ""), assignments(b or "")
    return x is not None and y is not None and x.keys() == y.keys() and all(equal(x[k], y[k]) for k in x)


def symbolic_equal(a: Column | str, b: Column | str) -> Column:
    """Boolean column: equal as assignments or as expressions; give it only the rows that cheaper comparisons left open."""

    @arrow_udf("boolean")
    def same(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([s is not None and t is not None and (same_assignments(s, t) or equal(s, t)) for s, t in zip(x.to_pylist(), y.to_pylist())], pa.bool_())

    return same(a, b)


def step_status(step: Column | str) -> Column:
    """Status of a step: unknown without an equation, parse_error for several or unreadable ones, else correct if it holds exactly, or incorrect."""

    @arrow_udf("string")
    def judge(steps: pa.Array) -> pa.Array:
        def one(s: str | None) -> str:
            if s is None or "=" not in s:
                return "unknown"
            sides = s.split("=")
            try:
                if len(sides) != 2 or not all(map(str.strip, sides)):
                    return "parse_error"
                left, right = map(parse, sides)
                if same_function(left, right):
                    return "correct"
                at_point(left, 0), at_point(right, 0)
            except (ValueError, RecursionError):
                return "parse_error"
            return "incorrect"

        return pa.array([one(s) for s in steps.to_pylist()], pa.string())

    return judge(step)
