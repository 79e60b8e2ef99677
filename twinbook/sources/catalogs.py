"""Venue catalogs from semi-structured pages: envelopes, lenient values, the flat market record, and a paged reader."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MARKET_FIELDS = (
    "market_id string, exchange_name string, name string, subtitle string, description string, category string, subcategory string, "
    "expiration_datetime string, ticker string, slug string, primary_entity_name string, event_ticker string, volume double, volume24h double, "
    "event_title string, status string, taker_fee_coefficient double"
)


def field(raw: Column, *names: str) -> Column:
    """The first of the fields that is there and not null; empty texts count as there. ``raw``: a variant."""
    return F.coalesce(*[F.try_variant_get(raw, f"$.{n}", "string") for n in names])


def text(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def lenient_number(raw: Column, *names: str) -> Column:
    """A number given as such, as text, or as an object with ``value`` or ``amount``; null for anything else."""
    found = [F.coalesce(F.try_variant_get(raw, f"$.{n}.value", "string"), F.try_variant_get(raw, f"$.{n}.amount", "string"), F.try_variant_get(raw, f"$.{n}", "string")) for n in names]
    return F.coalesce(*found).try_cast("double")


def envelope_rows(payloads: DataFrame, column: str, *keys: str) -> DataFrame:
    """The rows of JSON payloads: a list, or the list under the first key that has one, at most one level down. Column ``raw`` (variant)."""
    body = F.try_parse_json(column)
    paths = ["$", *[f"$.{k}" for k in keys], *[f"$.{a}.{b}" for a in keys for b in keys]]
    rows = F.coalesce(*[F.try_variant_get(body, p, "array<variant>") for p in paths])
    return payloads.select(*[c for c in payloads.columns if c != column], F.explode(rows).alias("raw"))


def single_rows(payloads: DataFrame, column: str, *keys: str) -> DataFrame:
    """The one record that each JSON answer to a lookup holds: its ``market``, else the first row of its list, else the answer itself where it
    has a ticker, slug or id. Column ``raw`` (variant); answers without one are left out."""
    body = F.try_parse_json(column)
    paths = [f"$.{k}" for k in keys] + [f"$.{a}.{b}" for a in keys for b in keys]
    rows = F.coalesce(*[F.try_variant_get(body, p, "array<variant>") for p in paths], F.try_variant_get(body, "$", "array<variant>"))
    named = F.coalesce(*[F.try_variant_get(body, f"$.{n}", "string") for n in ("ticker", "slug", "id")]).isNotNull()
    inner = F.try_variant_get(body, "$.market", "variant")
    whole = F.when(F.schema_of_variant(inner).startswith("OBJECT"), inner)
    raw = F.coalesce(whole, F.get(rows, F.lit(0)), F.when(named, body))
    return payloads.select(*[c for c in payloads.columns if c != column], raw.alias("raw")).where("raw IS NOT NULL")


def parse_k(rows: DataFrame) -> DataFrame:
    """The K venue's records (``raw``) as flat markets; records without a ticker are left out."""
    r = F.col("raw")
    rules = F.nullif(F.concat_ws("\n\n", text(field(r, "rules_primary")), text(field(r, "rules_secondary"))), F.lit(""))
    ticker = field(r, "ticker")
    return rows.select(
        *[c for c in rows.columns if c != "raw"], ticker.alias("market_id"), F.lit("K").alias("exchange_name"), F.coalesce(field(r, "title", "subtitle"), ticker).alias("name"),
        text(field(r, "yes_sub_title", "subtitle")).alias("subtitle"), rules.alias("description"), F.coalesce(field(r, "category"), F.lit("Other")).alias("category"),
        text(field(r, "subcategory")).alias("subcategory"),
        text(field(r, "expected_expiration_time", "expiration_time", "close_time", "latest_expiration_time")).alias("expiration_datetime"),
        ticker.alias("ticker"), F.lit(None).cast("string").alias("slug"), text(field(r, "yes_sub_title")).alias("primary_entity_name"),
        text(field(r, "event_ticker")).alias("event_ticker"), lenient_number(r, "volume_fp", "volume").alias("volume"),
        lenient_number(r, "volume_24h_fp", "volume_24h").alias("volume24h"), text(field(r, "event_title", "title")).alias("event_title"),
        text(field(r, "status")).alias("status"), lenient_number(r, "fee_coefficient", "feeCoefficient").alias("taker_fee_coefficient"),
    ).where(F.col("market_id").isNotNull())


def parse_p(rows: DataFrame) -> DataFrame:
    """The P venue's records (``raw``) as flat markets. Where the outcome isn't in the question, the name is the description's
    first sentence, else question and outcome."""
    r = F.col("raw")
    slug = F.coalesce(field(r, "slug", "marketSlug", "market_slug"), field(r, "id"), F.lit(""))
    question = F.coalesce(field(r, "question", "name"), slug)
    outcome = text(field(r, "title", "titleShort", "participantName"))
    description = text(field(r, "description", "rules", "resolutionRules"))
    sentence = F.nullif(F.trim(F.get(F.split(description, r"(?<=[.!?])\s+", 2), F.lit(0))), F.lit(""))
    missing = outcome.isNotNull() & ~F.contains(F.lower(question), F.lower(outcome))
    closed, active = F.coalesce(field(r, "closed"), F.lit("false")) == "true", F.coalesce(field(r, "active"), F.lit("false")) == "true"
    return rows.select(
        *[c for c in rows.columns if c != "raw"], slug.alias("market_id"), F.lit("P").alias("exchange_name"),
        F.when(missing, F.coalesce(sentence, F.concat(question, F.lit(": "), outcome))).otherwise(question).alias("name"),
        text(field(r, "subtitle", "shortTitle")).alias("subtitle"), description.alias("description"), F.coalesce(field(r, "category"), F.lit("Other")).alias("category"),
        text(field(r, "subcategory")).alias("subcategory"), text(field(r, "endDate", "end_date", "expirationDate", "closeTime")).alias("expiration_datetime"),
        F.lit(None).cast("string").alias("ticker"), slug.alias("slug"), text(field(r, "primaryEntityName", "participantName", "title", "titleShort")).alias("primary_entity_name"),
        text(field(r, "eventSlug", "event_slug", "eventId")).alias("event_ticker"), lenient_number(r, "volumeNum", "volume", "sharesTraded").alias("volume"),
        lenient_number(r, "volume24hr", "volume24h", "volume_24h").alias("volume24h"), text(field(r, "eventTitle", "event_title", "question")).alias("event_title"),
        F.when(closed, "closed").when(active, "active").otherwise(text(field(r, "status"))).alias("status"),
        lenient_number(r, "feeCoefficient", "fee_coefficient").alias("taker_fee_coefficient"),
    )


def parse_venue(rows: DataFrame, venue: str) -> DataFrame:
    """Dispatch by venue; an unknown one is an error."""
    try:
        return {"K": parse_k, "P": parse_p}[venue.upper()](rows)
    except KeyError:
        raise ValueError(f"unknown venue {venue!r}") from None


def with_retry(get: Callable[[], tuple[int, str, float | None]], attempts: int = 8, most: float = 8.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Body of the first answer that isn't 429; waits as the answer says, else 0.5 s doubling up to ``most``; other errors raise."""
    for n in range(attempts):
        status, body, after = get()
        if status != 429:
            if status >= 400:
                raise OSError(f"status {status}")
            return body
        if n + 1 < attempts:
            sleep(after if after is not None else min(0.5 * 2**n, most))
    raise OSError("too many requests")


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedCatalogReader(DataSourceReader):
    """Reads ``<path>/<number>.json``: by cursor in one partition (``next`` of each page), or page by page in ``pages`` partitions."""

    def __init__(self, options: dict):
        self.path, self.pages = options["path"], int(options.get("pages", 0))

    def partitions(self) -> list[InputPartition]:
        return [_Page(i) for i in range(self.pages)] if self.pages else [_Page(-1)]

    def _load(self, number: int | str) -> str | None:
        def get() -> tuple[int, str, float | None]:
            with open(f"{self.path}/{number}.json", encoding="utf-8") as f:
                return 200, f.read(), None

        try:
            return with_retry(get)
        except FileNotFoundError:
            return None

    def read(self, partition: _Page) -> Iterator[tuple[int, str]]:
        if partition.number >= 0:
            if (body := self._load(partition.number)) is not None:
                yield partition.number, body
            return
        cursor, seen, n = "0", set(), 0
        while cursor and cursor not in seen and (body := self._load(cursor)) is not None:
            seen.add(cursor)
            yield n, body
            n += 1
            page = json.loads(body)
            cursor = str(page.get("cursor") or "") if isinstance(page, dict) else ""


class PagedCatalog(DataSource):
    """Python data source ``paged_catalog`` with columns ``page`` and ``payload``."""

    @classmethod
    def name(cls) -> str:
        return "paged_catalog"

    def schema(self) -> str:
        return "page int, payload string"

    def reader(self, schema) -> PagedCatalogReader:
        return PagedCatalogReader(self.options)


def read_pages(spark: SparkSession, path: str, pages: int = 0) -> DataFrame:
    """Pages of a catalog; rows that come twice are for ``latest_listing`` to settle."""
    spark.dataSource.register(PagedCatalog)
    return spark.read.format("paged_catalog").option("pages", pages).load(path)
