"""Columns of output views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: Column) -> Column:
    """Percent-encoded text that leaves letters, digits and ``-._~``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.url_encode(text), r"\+", "%20"), r"\*", "%2A"), "%7E", "~")


def contract_link(k_base: Column, p_base: Column, k_venue: str = "KALSHI") -> Column:
    """Address of a market: by ticker, by event and slug, or by slug where the event is unknown or the same; null without either."""
    event = F.when(F.col("event_ticker") != F.col("slug"), F.concat(quoted(F.col("event_ticker")), F.lit("/")))
    return F.when(F.col("exchange_name") == k_venue, F.concat(k_base, quoted(F.col("ticker")))).otherwise(
        F.concat(p_base, F.coalesce(event, F.lit("")), quoted(F.col("slug")))
    )


def signed_money(amount: Column, digits: int = 4) -> Column:
    return F.format_string(f"%+.{digits}f", amount)


def quote_line() -> Column:
    """``id bid/ask`` with three digits, a dash for a missing side."""
    side = lambda c: F.coalesce(F.format_string("%.3f", F.col(c)), F.lit("-"))
    return F.concat_ws(" ", F.col("market_id"), F.concat(F.when(F.col("bid").isNull(), "-").otherwise(side("bid")), F.lit("/"), F.when(F.col("ask").isNull(), "-").otherwise(side("ask"))))
