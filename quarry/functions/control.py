"""Control of how expressions are evaluated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with the value made once, however often it is used; optimizers copy a column into each of its uses."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
