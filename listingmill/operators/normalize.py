"""Raw listings to typed, classified, keyed exhibitions in one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmill.functions import classify, dates, keys, text


TEXT_FIELDS = (
    "title", "title_en", "description", "category", "exhibition_type_text", "date_range", "open_hours",
    "poster_image_url", "venue_name", "venue_region", "venue_address", "organizer", "fee_text", "price_notes",
)


def normalize_listings(raw: DataFrame, crawled_at: str) -> DataFrame:
    """Every raw row, normalised. ``error`` is set when the row has no title; nothing is dropped.

    Entity text is kept in ``artist_names``, ``venue_*`` and ``organizer_name`` for resolution.
    Staged projections (trimmed cells, then dates, then folded texts, then the rest) evaluate each shared value
    once; unused stages are pruned when a caller needs only some columns.
    """
    no_strings = F.array().cast("array<string>")
    cells = raw.select(
        "source", "source_url", "seq",
        *[text.blank_to_null(F.col(f"raw.{name}")).alias(f"_{name}") for name in TEXT_FIELDS],
        F.coalesce(F.col("raw.artists"), no_strings).alias("artist_names"),
        F.coalesce(F.col("raw.genre_tags"), no_strings).alias("genre_tags"),
        F.coalesce(F.col("raw.activities"), no_strings).alias("activities"),
        F.col("raw.price_min").alias("price_min"), F.col("raw.price_max").alias("price_max"),
        F.col("raw.price_breakdown").alias("_tiers"),
        F.col("raw.venue_lat").alias("venue_lat"), F.col("raw.venue_lng").alias("venue_lng"),
    )
    c = {name: F.col(f"_{name}") for name in TEXT_FIELDS}
    staged = cells.withColumn("title", text.clean_whitespace(c["title"]))
    staged = dates.with_date_range(staged, c["date_range"])
    staged = staged.withColumns(
        {
            "_about": classify.folded(F.concat_ws(" ", F.col("title"), c["description"], c["category"])),
            "_kind": classify.folded(c["exhibition_type_text"]),
            "_titled": classify.folded(F.col("title")),
            "_fee": classify.folded(c["fee_text"]),
        }
    )
    stamp = F.lit(crawled_at).cast("timestamp")
    rows = staged.select(
        keys.exhibition_id(F.col("source"), c["venue_name"], F.col("title"), F.col("start_date")).alias("id"),
        "source", "source_url", "title",
        c["title_en"].alias("title_en"),
        text.sanitize_description(c["description"]).alias("description"),
        classify.drop_placeholder_image(c["poster_image_url"]).alias("poster_image_url"),
        classify.medium_of(F.col("_about")).alias("medium"),
        classify.exhibition_type_of(
            F.col("_kind"), F.col("_titled"), F.nullif(F.size("artist_names"), F.lit(0))
        ).alias("exhibition_type"),
        "genre_tags",
        classify.fee_type_of(F.col("_fee"), F.col("price_min"), F.col("price_max")).alias("fee_type"),
        "price_min", "price_max",
        F.filter(
            F.coalesce("_tiers", F.array().cast("array<struct<label:string,amount:int>>")),
            lambda t: (F.coalesce(t["label"], F.lit("")) != "") & t["amount"].isNotNull(),
        ).alias("price_breakdown"),
        c["price_notes"].alias("price_notes"),
        "activities", "start_date", "end_date",
        c["open_hours"].alias("open_hours"),
        "artist_names",
        *[c[name].alias(name) for name in ("venue_name", "venue_region", "venue_address")],
        "venue_lat", "venue_lng",
        c["organizer"].alias("organizer_name"),
        F.lit("unknown").alias("status"),
        # popularity and featured are never set here, so a merge writes these over curated values
        F.lit(None).cast("double").alias("popularity_score"),
        F.lit(False).alias("featured"),
        stamp.alias("crawled_at"),
        stamp.alias("updated_at"),
        F.when(c["date_range"].isNotNull() & F.col("start_date").isNull(), F.array(F.lit("date_range")))
        .otherwise(no_strings)
        .alias("_warnings"),
        "seq",
        F.when(F.col("title").isNull(), F.lit("title is required")).alias("error"),
    )
    return rows.withColumn("description", F.nullif("description", F.lit("")))


def split_rejects(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    return normalized.filter(F.col("error").isNull()).drop("error"), normalized.filter(F.col("error").isNotNull())
