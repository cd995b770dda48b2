"""Column helpers shared by the operators that stay inside Spark SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of every word rule here: the space and the control characters tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` worked out once a row, however often the body names it.

    Inside a lambda over an array a plain column expression would be evaluated for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words between white space; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def text_lines(text: Column) -> Column:
    """Lines between newlines; a null text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def fresh_name(taken: list[str], wish: str) -> str:
    """A column name like `wish` that none of the caller's columns has."""
    held = {name.lower() for name in taken}
    while wish.lower() in held:
        wish += "_"
    return wish
