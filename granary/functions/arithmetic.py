"""Exact arithmetic on decimal expressions; a parser, never eval."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Context, Decimal, Inexact

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?|\.\d+)|(.))")
_EXACT = Context(prec=400)


def calculate(expression: str, depth: int = 64) -> Decimal:
    """+ - * / with signs and parentheses. A quotient is exact where it ends, else rounded half up at 16 places."""
    tokens = [(n, op) for n, op in _TOKEN.findall(expression.strip())]
    at = 0

    def peek() -> str:
        return tokens[at][1] if at < len(tokens) else ""

    def take() -> tuple[str, str]:
        nonlocal at
        if at >= len(tokens):
            raise ValueError("the expression ends too early")
        at += 1
        return tokens[at - 1]

    def factor(level: int) -> Decimal:
        if level > depth:
            raise ValueError("the expression is too deep")
        number, op = take()
        if number:
            return Decimal(number)
        if op in "+-":
            value = factor(level + 1)
            return -value if op == "-" else value
        if op != "(":
            raise ValueError(f"not expected: {op}")
        value = total(level + 1)
        if take()[1] != ")":
            raise ValueError("a parenthesis is not closed")
        return value

    def product(level: int) -> Decimal:
        value = factor(level)
        while peek() and peek() in "*/":
            _, op = take()
            right = factor(level)
            if op == "*":
                value = _EXACT.multiply(value, right)
            elif not right:
                raise ValueError("division by zero")
            else:
                value = _quotient(value, right)
        return value

    def total(level: int) -> Decimal:
        value = product(level)
        while peek() and peek() in "+-":
            _, op = take()
            right = product(level)
            value = _EXACT.add(value, right) if op == "+" else _EXACT.subtract(value, right)
        return value

    value = total(0)
    if at != len(tokens):
        raise ValueError("the expression goes on after its end")
    return value


def _quotient(a: Decimal, b: Decimal) -> Decimal:
    context = Context(prec=100)
    value = context.divide(a, b)
    return value if not context.flags[Inexact] else value.quantize(Decimal(1).scaleb(-16), ROUND_HALF_UP, Context(prec=400))


def evaluated(c: Column) -> Column:
    """The plain result of each expression, null where it can't be evaluated."""

    @F.pandas_udf("string")
    def run(values):
        def one(x):
            try:
                return format(calculate(x).normalize(_EXACT), "f") if x else None
            except (ValueError, ArithmeticError):
                return None

        return values.map(one)

    return run(c)
