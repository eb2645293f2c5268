"""Bind an expression to a name inside a larger one; keep expressions that are long to put together."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times: keeps plans small when the argument is a long expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_place(value: Column) -> Column:
    """Have `value` computed where it is selected, once a row.

    The optimizer merges two selects that both call Python and copies the columns of the first into every place the second
    names them, whatever they cost.  A column that depends on the row's place, and this one does in form only, is not copied.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def filled(text: Column) -> Column:
    """Null for an empty text; the text is evaluated once."""
    return let(text, lambda t: F.when(t != "", t))


def built_once(make: Callable) -> Callable:
    """Remember what a function of plain values builds from columns, for as long as the JVM that holds them lives.

    For expressions that only name columns: they serve every table, and putting a long one together costs seconds.
    """
    kept: list[tuple] = []

    @wraps(make)
    def get(*args):
        jvm = SparkContext._gateway
        for gateway, known, value in kept:
            if gateway is jvm and known == args:
                return value
        value = make(*args)
        kept.append((jvm, args, value))
        del kept[:-8]
        return value

    return get
