"""Search, facets and order over film scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmill.functions.values import decade_of, year_of


def cinema_entries(modern: DataFrame, public_domain: DataFrame) -> DataFrame:
    """UNION ALL of both collections with kind, release year and decade."""
    both = modern.withColumn("kind", F.lit("modern")).unionByName(public_domain.withColumn("kind", F.lit("pd")))
    credit = F.coalesce(
        F.nullif(F.try_element_at("credit", F.lit("en")), F.lit("")), F.try_element_at("credit", F.lit("ko"))
    )
    return both.withColumn("year", year_of(credit)).withColumn("decade", decade_of(F.col("year")))


def cinema_filter(entries: DataFrame, kinds: tuple[str, ...] = (), decades: tuple[int, ...] = ()) -> DataFrame:
    if kinds:
        entries = entries.filter(F.col("kind").isin(*kinds))
    if decades:
        entries = entries.filter(F.col("decade").isin(*decades))
    return entries


def cinema_search(entries: DataFrame, query: str) -> DataFrame:
    needle = query.strip().lower()
    if not needle:
        return entries
    parts = [F.coalesce(F.try_element_at("title", F.lit(x)), F.lit("")) for x in ("ko", "en", "ja")]
    parts += [F.coalesce(F.try_element_at("credit", F.lit(x)), F.lit("")) for x in ("ko", "en")]
    hay = F.concat_ws(" ", *parts, F.coalesce("studio", F.lit("")))
    return entries.filter(F.contains(F.lower(hay), F.lit(needle)))


def present_decades(entries: DataFrame) -> DataFrame:
    return entries.filter("decade > 0").select("decade").distinct().orderBy(F.desc("decade"))


def sort_cinema(entries: DataFrame, key: str, locale: str = "en") -> DataFrame:
    english = F.collate(F.try_element_at("title", F.lit("en")), "UNICODE")
    if key == "newest":
        return entries.orderBy(F.desc("year"), english, "id")
    if key == "oldest":
        return entries.orderBy(F.asc("year"), english, "id")
    collation = {"ko": "ko", "ja": "ja"}.get(locale, "UNICODE")
    return entries.orderBy(F.collate(F.try_element_at("title", F.lit(locale)), collation), "id")
