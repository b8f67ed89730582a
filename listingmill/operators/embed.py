"""Nested catalogue rows: venue and artists embedded, orphans pruned, projections for readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmill.functions.text import sanitize_description
from listingmill.functions.translations import empty_tr
from listingmill.functions.values import finite_or_null
from listingmill.operators.joins import shuffled
from listingmill.operators.merge import latest_by

ARTIST = "struct<id:string,name:string,lang:string,tr:map<string,map<string,string>>>"


def embed_venue(exhibitions: DataFrame, venues: DataFrame) -> DataFrame:
    """Add ``venue`` (struct or NULL). A plain left equi-join: venues grow with the shows, and a venue of most shows, or none, is
    split by the session as a skewed partition."""
    side = venues.select(
        F.col("id").alias("venue_id"),
        F.struct(
            "id", "name", "lang", F.coalesce("tr", empty_tr()).alias("tr"), "region", "district",
            finite_or_null(F.col("latitude")).alias("lat"), finite_or_null(F.col("longitude")).alias("lng"),
        ).alias("venue"),
    )
    return exhibitions.join(side, "venue_id", "left")


def artist_links(exhibitions: DataFrame) -> DataFrame:
    return exhibitions.select("id", F.posexplode("artist_ids").alias("pos", "artist_id"))


def embed_artists(exhibitions: DataFrame, artists: DataFrame) -> DataFrame:
    """Add ``artists``: structs in the order of ``artist_ids``, unknown ids dropped."""
    side = artists.select(
        F.col("id").alias("artist_id"),
        F.struct("id", "name", "lang", F.coalesce("tr", empty_tr()).alias("tr")).alias("artist"),
    )
    # maps cannot be compared, so the order is told by position alone
    by_position = F.array_sort("x", lambda a, b: a["pos"] - b["pos"])
    lists = (
        artist_links(exhibitions).join(shuffled(side), "artist_id")
        .groupBy("id")
        .agg(F.collect_list(F.struct("pos", "artist")).alias("x"))
        .select("id", F.transform(by_position, lambda e: e["artist"]).alias("artists"))
    )
    return exhibitions.join(shuffled(lists), "id", "left").withColumn(
        "artists", F.coalesce("artists", F.array().cast(f"array<{ARTIST}>"))
    )


def prune_venues(venues: DataFrame, exhibitions: DataFrame) -> DataFrame:
    used = exhibitions.select(F.col("venue_id").alias("id")).distinct()
    return venues.join(used, "id", "left_semi")


def prune_artists(artists: DataFrame, exhibitions: DataFrame) -> DataFrame:
    used = exhibitions.select(F.explode("artist_ids").alias("id")).distinct()
    return artists.join(used, "id", "left_semi")


def exhibition_rows(exhibitions: DataFrame, venues: DataFrame, artists: DataFrame) -> DataFrame:
    """The published shape of an exhibition. Artists come first: their list would otherwise take every row through the venue join again."""
    nested = embed_venue(embed_artists(exhibitions, artists), venues)
    return nested.select(
        "id", "source", "title", "lang", F.coalesce("tr", empty_tr()).alias("tr"), "poster_image_url",
        F.nullif(sanitize_description(F.col("description")), F.lit("")).alias("description"),
        "medium", "exhibition_type", "genre_tags", "fee_type", "price_min", "price_max",
        "start_date", "end_date", "status", "open_hours", "venue", "artists", "source_url", "featured",
        finite_or_null(F.col("popularity_score")).alias("popularity_score"), "seq",
    )


def project_catalog(snapshot: DataFrame) -> DataFrame:
    """Defaults for readers, one row per id (last wins, first position)."""
    no_strings = F.array().cast("array<string>")
    filled = snapshot.withColumns(
        {
            "genre_tags": F.coalesce("genre_tags", no_strings),
            "status": F.coalesce("status", F.lit("unknown")),
            "featured": F.coalesce("featured", F.lit(False)),
            "tr": F.coalesce("tr", empty_tr()),
        }
    )
    return latest_by(filled, ["id"])


def flat_for_alerts(catalogue: DataFrame) -> DataFrame:
    """The flat columns that notifications read."""
    return catalogue.select(
        "id", "seq", "title", "tr", "medium", "exhibition_type", "genre_tags", "fee_type",
        "start_date", "end_date", "status", "poster_image_url", "source_url",
        F.col("venue.name").alias("venue_name"),
        F.col("venue.tr").alias("venue_tr"),
        F.col("venue.region").alias("region"),
        F.transform("artists", lambda a: a["name"]).alias("artist_names"),
    )


