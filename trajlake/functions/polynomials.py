"""Equality of rational expressions by a normal form: quotients of polynomials with exact rational coefficients."""

from __future__ import annotations

import ast
from fractions import Fraction

#: A polynomial: coefficients, none of them zero, by monomial, a sorted tuple of (variable, power).
Polynomial = dict[tuple[tuple[str, int], ...], Fraction]
MOST_TERMS, MOST_POWER = 2000, 64


class Beyond(ValueError):
    """The expression isn't rational, has no value, or is larger than what is worked out."""


def plus(a: Polynomial, b: Polynomial) -> Polynomial:
    out = dict(a)
    for m, c in b.items():
        c = out.pop(m, Fraction(0)) + c
        if c:
            out[m] = c
    return out


def times(a: Polynomial, b: Polynomial) -> Polynomial:
    if len(a) * len(b) > MOST_TERMS**2:
        raise Beyond
    out: Polynomial = {}
    for m, c in a.items():
        for n, d in b.items():
            powers = dict(m)
            for v, k in n:
                powers[v] = powers.get(v, 0) + k
            key = tuple(sorted(powers.items()))
            e = out.pop(key, Fraction(0)) + c * d
            if e:
                out[key] = e
    if len(out) > MOST_TERMS:
        raise Beyond
    return out


def constant(c: Fraction) -> Polynomial:
    return {(): c} if c else {}


def _quotient(n: ast.AST, names: frozenset[str]) -> tuple[Polynomial, Polynomial]:
    """(numerator, denominator) of a syntax tree over numbers and the variables names."""
    one = constant(Fraction(1))
    if isinstance(n, ast.Constant) and type(n.value) in (int, float):
        return constant(Fraction(str(n.value))), one
    if isinstance(n, ast.Name) and n.id in names:
        return {((n.id, 1),): Fraction(1)}, one
    if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
        a, b = _quotient(n.operand, names)
        return (times(constant(Fraction(-1)), a), b) if isinstance(n.op, ast.USub) else (a, b)
    if not isinstance(n, ast.BinOp):
        raise Beyond
    (a, b), (c, d) = _quotient(n.left, names), _quotient(n.right, names)
    if isinstance(n.op, (ast.Add, ast.Sub)):
        c = times(constant(Fraction(-1)), c) if isinstance(n.op, ast.Sub) else c
        return (plus(a, c), b) if b == d else (plus(times(a, d), times(c, b)), times(b, d))
    if isinstance(n.op, ast.Mult):
        return times(a, c), times(b, d)
    if isinstance(n.op, ast.Div):
        if not c:
            raise Beyond
        return times(a, d), times(b, c)
    if isinstance(n.op, ast.Pow):
        whole = set(c) <= {()} and set(d) == {()} and (c.get((), Fraction(0)) / d[()]).denominator == 1
        power = int(c.get((), Fraction(0)) / d[()]) if whole else MOST_POWER + 1
        if abs(power) > MOST_POWER or (power <= 0 and not a):
            raise Beyond
        if power < 0:
            a, b = b, a
        above, below = one, one
        for _ in range(abs(power)):
            above, below = times(above, a), times(below, b)
        return above, below
    raise Beyond


def equal(a: str, b: str, names: frozenset[str]) -> bool | None:
    """Are two expressions (with ** for powers) equal as rational functions of the variables? Null where either isn't one.

    p / q equals r / s if p s - r q has no term left. Where a quotient has no value at some points, those don't count.
    """
    try:
        (p, q), (r, s) = (_quotient(ast.parse(x, mode="eval").body, names) for x in (a, b))
        if not q or not s:
            return None
        return times(p, s) == times(r, q)
    except (Beyond, SyntaxError, ValueError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None
