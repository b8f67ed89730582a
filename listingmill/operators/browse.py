"""Filters, orders and aggregates over the published catalogue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingmill.functions import dates, geo, text

STATUS_RANK = {"ongoing": 0, "upcoming": 1, "unknown": 2, "past": 3}


@dataclass(frozen=True)
class Facets:
    """Empty means no constraint; a NULL value fails an active facet."""

    statuses: tuple[str, ...] = ()
    mediums: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    free_only: bool = False
    cities: tuple[str, ...] = ()


def faceted_filter(df: DataFrame, f: Facets) -> DataFrame:
    """One filter per active facet, plain ``IN`` so that parquet can prune on it."""
    if f.statuses:
        df = df.filter(F.col("status").isin(*f.statuses))
    if f.mediums:
        df = df.filter(F.col("medium").isin(*f.mediums))
    if f.types:
        df = df.filter(F.col("exhibition_type").isin(*f.types))
    if f.free_only:
        df = df.filter(F.col("fee_type") == "free")
    if f.cities:
        df = df.filter(geo.region_bucket(F.col("venue.region"))["city"].isin(*f.cities))
    return df


def text_search(df: DataFrame, query: str) -> DataFrame:
    needle = query.strip().lower()
    if not needle:
        return df
    hay = F.concat_ws(
        " ", F.col("title"), F.coalesce("venue.name", F.lit("")),
        F.transform("artists", lambda a: a["name"]), F.col("genre_tags"),
    )
    return df.filter(F.contains(F.lower(hay), F.lit(needle)))


def viewport_filter(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    return df.filter(F.col("venue.lng").between(west, east) & F.col("venue.lat").between(south, north))


def mappable(df: DataFrame) -> DataFrame:
    return df.filter(F.col("venue.lat").isNotNull() & F.col("venue.lng").isNotNull()).withColumn(
        "city", geo.region_bucket(F.col("venue.region"))["city"]
    )


def status_filter(df: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    return df.filter(F.col("status").isin(*statuses)) if statuses else df


def venue_exhibitions(df: DataFrame, venue_ids: DataFrame) -> DataFrame:
    return df.join(venue_ids.select(F.col("id").alias("_wanted")).distinct(), F.col("venue.id") == F.col("_wanted"), "left_semi")


def lookup_by_id(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def bookmarked(df: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """(user_id, exhibition…) for every saved exhibition."""
    return bookmarks.select("user_id", F.col("exhibition_id").alias("id")).join(df, "id")


# --- orders: every one ends in seq, so ties keep the input order -----------------


def status_rank(c: Column) -> Column:
    out = F.lit(len(STATUS_RANK))
    for name, rank in STATUS_RANK.items():
        out = F.when(c == name, F.lit(rank)).otherwise(out)
    return out


def recommended_order() -> list[Column]:
    return [
        F.desc("featured"),
        F.desc_nulls_last("popularity_score"),
        status_rank(F.col("status")).asc(),
        F.desc_nulls_last("start_date"),
        F.asc("seq"),
    ]


def closing_order() -> list[Column]:
    return [F.coalesce(F.col("status") != "ongoing", F.lit(True)).asc(), F.asc_nulls_last("end_date"), F.asc("seq")]


def recent_order() -> list[Column]:
    return [F.desc_nulls_last("start_date"), F.asc("seq")]


def sort_exhibitions(df: DataFrame, key: str, here: tuple[float, float] | None = None) -> DataFrame:
    """recommended | closing | recent | nearby (``here`` is lng, lat; without it: recommended)."""
    if key == "closing":
        return df.orderBy(*closing_order())
    if key == "recent":
        return df.orderBy(*recent_order())
    if key == "nearby" and here:
        return with_distance(df, here).orderBy(F.asc_nulls_last("distance_km"), F.asc("seq"))
    return df.orderBy(*recommended_order())


def with_distance(df: DataFrame, here: tuple[float, float]) -> DataFrame:
    km = geo.haversine_km(F.lit(here[0]), F.lit(here[1]), F.col("venue.lng"), F.col("venue.lat"))
    return df.withColumn("distance_km", km)


def closing_soon(df: DataFrame, today, limit: int | None = 4) -> DataFrame:
    soon = df.filter((F.col("status") == "ongoing") & dates.is_closing_soon(F.col("end_date"), today))
    soon = soon.orderBy("end_date", "seq")
    return soon.limit(limit) if limit else soon


def featured_pick(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("featured"), F.asc("seq")).limit(1)


def swipe_deck(df: DataFrame, seed: int, include_past: bool = False) -> DataFrame:
    """Deck without past shows in a seeded order (any seeded order is valid)."""
    deck = df if include_past else df.filter(F.coalesce(F.col("status") != "past", F.lit(True)))
    return deck.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id"))), "seq")


# --- aggregates -------------------------------------------------------------------


def status_counts(df: DataFrame, today) -> DataFrame:
    ongoing = F.col("status") == "ongoing"
    return df.agg(
        F.count_if(ongoing).alias("ongoing"),
        F.count_if(ongoing & dates.is_closing_soon(F.col("end_date"), today)).alias("closing"),
        F.count_if(F.col("status") == "upcoming").alias("upcoming"),
    )


def venue_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("venue_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "ongoing").alias("ongoing"),
        F.count_if(F.col("status") == "upcoming").alias("upcoming"),
    )


def venue_markers(df: DataFrame) -> DataFrame:
    """One marker per venue with coordinates; values of the first listing, first non-blank poster."""
    poster = F.nullif(F.col("poster_image_url"), F.lit(""))
    key = F.coalesce("venue.id", F.concat_ws(",", "venue.lng", "venue.lat"))
    return (
        df.filter(F.col("venue.lat").isNotNull() & F.col("venue.lng").isNotNull())
        .groupBy(key.alias("marker"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by(F.struct("venue.lng", "venue.lat", "venue.name", "id"), "seq").alias("first"),
            F.min_by(poster, F.when(poster.isNotNull(), F.col("seq"))).alias("poster"),
        )
        .select(
            "marker", "n", F.col("first.lng").alias("lng"), F.col("first.lat").alias("lat"),
            F.col("first.name").alias("venue_name"), F.col("first.id").alias("first_id"),
            F.coalesce("poster", F.lit("")).alias("poster"),
        )
    )


def marker_grid_clusters(markers: DataFrame, zoom: int) -> DataFrame:
    """Markers per map cell; above the last cluster zoom every marker stands alone."""
    if zoom > geo.CLUSTER_MAX_ZOOM:
        return markers.select("marker", "n", "lng", "lat", F.lit(1).cast("long").alias("venues"))
    cells = markers.withColumn("cell", geo.mercator_cell(F.col("lng"), F.col("lat"), zoom))
    return cells.groupBy("cell.cell_x", "cell.cell_y").agg(
        F.count(F.lit(1)).alias("venues"),
        F.sum("n").alias("n"),
        F.avg("lng").alias("lng"),
        F.avg("lat").alias("lat"),
    )


def map_extent(markers: DataFrame) -> DataFrame:
    return markers.agg(
        F.min("lng").alias("west"), F.min("lat").alias("south"), F.max("lng").alias("east"), F.max("lat").alias("north")
    )


def group_by_region(df: DataFrame) -> DataFrame:
    """Mappable listings tagged with their region, in region order.

    The groups stay rows: a list per region would put a region with most of the listings into
    one value. Counts come from :func:`region_counts`.
    """
    usable = (F.coalesce("venue.region", F.lit("")) != "") & F.col("venue.lat").isNotNull() & F.col("venue.lng").isNotNull()
    return df.filter(usable).withColumn("region", F.col("venue.region"))


def region_counts(df: DataFrame) -> DataFrame:
    return group_by_region(df).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def city_facets(venues: DataFrame) -> DataFrame:
    """Cities present, in the fixed display order (an eight-row table)."""
    order = venues.sparkSession.createDataFrame(geo.CITY_ORDER, "country STRING, city STRING, position INT")
    present = venues.select(geo.region_bucket(F.col("region")).alias("b")).filter("b IS NOT NULL").select("b.*").distinct()
    return present.join(F.broadcast(order), ["country", "city"]).orderBy("position")


def distinct_regions(venues: DataFrame) -> DataFrame:
    return venues.select(text.blank_to_null(F.col("region")).alias("region")).filter("region IS NOT NULL").distinct()
