"""What the operators on book frames share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid_frame(kind: str = "type", flag: str = "is_valid") -> Column:
    """True for snapshots and updates whose validity flag is not false; null flags count as valid."""
    return F.coalesce(F.col(kind).isin("snapshot", "update"), F.lit(False)) & F.coalesce(F.col(flag), F.lit(True))


def number(price: str) -> Column:
    """The price, or null where it is not a number."""
    return F.when(~F.isnan(price), F.col(price))
