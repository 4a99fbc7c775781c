"""Values that an expression takes once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once, however often it stands in use."""
    return F.get(F.transform(F.array(value), use), 0)
