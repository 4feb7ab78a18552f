"""Small helpers for composing columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` as often as needed.

    A column named twice may be computed twice, and one named inside a lambda once per element;
    a lambda variable is computed once.
    """
    return F.transform(F.array(value), body)[0]
