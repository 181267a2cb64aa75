"""Small Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\u0001"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def groups(text: Column, pattern: str, n: int) -> Column:
    """The ``n`` groups of a pattern that matches whole lines, by one evaluation of the pattern: an
    array of n + 1 entries (groups from index 1), or a shorter one when the line does not match.
    A group that took no part is empty. The control character U+0001 reads as a space."""
    marked = MARK + MARK.join(f"${i}" for i in range(1, n + 1))
    clean = F.replace(text, F.lit(MARK), F.lit(" "))
    return F.split(F.regexp_replace(clean, pattern, marked), MARK)


def group_of(parts: Column, n: int, i: int) -> Column:
    """Group ``i`` of ``groups(…, n)``; NULL when the line did not match or the group is empty."""
    return F.when(F.size(parts) == n + 1, F.nullif(F.get(parts, F.lit(i)), F.lit("")))
