"""Time expressions of the grammar  + - * / ( ) number duration  as columns.

Parsed on the driver by recursive descent; what a user wrote never reaches the SQL parser.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|(duration)|([-+*/()]))")
PROBES = (1.0, 30.0, 600.0)


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not a time expression: {text!r}")
        out.append(m.group().strip())
        at = m.end()
    return out


def parse(text: str, number: Callable[[float], Any], duration: Any, divide: Callable[[Any, Any], Any]) -> Any:
    """The value of the expression in whatever domain number and duration come from."""
    left = tokens(text)[::-1]

    def factor() -> Any:
        if not left:
            raise ValueError("the expression ends early")
        t = left.pop()
        if t == "(":
            v = total()
            if not left or left.pop() != ")":
                raise ValueError("a parenthesis isn't closed")
            return v
        if t == "-":
            return -factor()
        if t == "duration":
            return duration
        if t in ")+*/":
            raise ValueError(f"unexpected {t}")
        return number(float(t))

    def product() -> Any:
        v = factor()
        while left and left[-1] in "*/":
            v = operator.mul(v, factor()) if left.pop() == "*" else divide(v, factor())
        return v

    def total() -> Any:
        v = product()
        while left and left[-1] in "+-":
            v = v + product() if left.pop() == "+" else v - product()
        return v

    value = total()
    if left:
        raise ValueError(f"unexpected {left[-1]}")
    return value


def valid(text: str) -> bool:
    """Whether it evaluates, without a division by zero, at durations of 1, 30 and 600 seconds."""
    try:
        for p in PROBES:
            parse(text, float, p, operator.truediv)
    except (ValueError, ZeroDivisionError):
        return False
    return True


def column_of(text: str, duration: Column) -> Column:
    """The expression as a column; ValueError if it isn't valid. Division by zero gives null."""
    if not valid(text):
        raise ValueError(f"not a time expression: {text!r}")
    return parse(text, F.lit, duration, F.try_divide)
