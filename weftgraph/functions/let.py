"""Name a value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    Without it, every mention of a regular expression is one more evaluation,
    and large rule sets outgrow the generated code of a stage.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
