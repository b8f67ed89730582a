"""Publish: id-dedupe, relevance, cross-source collapse, embed, prune."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmill.functions.translations import empty_tr
from listingmill.functions.values import finite_or_null
from listingmill.operators import embed
from listingmill.operators.collapse import collapse_cross_source, photo_relevance
from listingmill.operators.merge import drop_blank_ids, latest_by
from listingmill.session import materialize, shared_dir
from listingmill.sources.tables import write_document


@dataclass(frozen=True)
class Catalogue:
    exhibitions: DataFrame
    venues: DataFrame
    artists: DataFrame


def survivors(exhibitions: DataFrame) -> DataFrame:
    """The rows that get published, one per show."""
    unique = photo_relevance(latest_by(drop_blank_ids(exhibitions, ["id"]), ["id"]))
    # read three times by the collapse (links twice, members once): pay for the wide aggregate once
    unique = materialize(unique, shared_dir(exhibitions.sparkSession, "unique"))
    return collapse_cross_source(unique).drop("members")


def build_catalog(exhibitions: DataFrame, venues: DataFrame, artists: DataFrame) -> Catalogue:
    """The survivors feed three outputs, so they are written once to the shared folder."""
    spark = exhibitions.sparkSession
    kept = materialize(survivors(exhibitions), shared_dir(spark, "survivors"))
    venue_rows = embed.prune_venues(venues, kept).select(
        "id", "name", "lang", F.coalesce("tr", empty_tr()).alias("tr"), "venue_type", "region", "district", "address",
        "country", finite_or_null(F.col("latitude")).alias("lat"), finite_or_null(F.col("longitude")).alias("lng"),
        "website", "seq",
    )
    artist_rows = embed.prune_artists(artists, kept).select(
        "id", "name", "lang", F.coalesce("tr", empty_tr()).alias("tr"), "seq"
    )
    return Catalogue(embed.exhibition_rows(kept, venues, artists), venue_rows, artist_rows)


def publish(exhibitions: DataFrame, venues: DataFrame, artists: DataFrame, generated_at: str, path: str) -> int:
    """Build the catalogue and publish all of it as one document; nothing becomes visible unless every part is whole."""
    built = build_catalog(exhibitions, venues, artists)
    return write_document({"exhibitions": built.exhibitions, "venues": built.venues, "artists": built.artists}, generated_at, path)
