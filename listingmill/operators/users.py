"""Profiles, bookmarks and subscriptions as keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmill.functions.classify import LOCALES
from listingmill.operators.merge import delete_keys, insert_missing, latest_by, patch_rows, upsert

BOOKMARK_KEYS = ["user_id", "exhibition_id"]
NO_FILTERS = "struct<artists:array<string>,regions:array<string>,genres:array<string>,mediums:array<string>>"


def backfill_profiles(profiles: DataFrame, users: DataFrame) -> DataFrame:
    """Profiles for every user; existing rows are left alone."""
    return insert_missing(profiles, users.select("id", "email"), ["id"])


def add_bookmarks(bookmarks: DataFrame, added: DataFrame) -> DataFrame:
    return insert_missing(bookmarks, added, BOOKMARK_KEYS, "created_at")


def remove_bookmarks(bookmarks: DataFrame, removed: DataFrame) -> DataFrame:
    return delete_keys(bookmarks, removed, BOOKMARK_KEYS)


def upsert_subscriptions(subscriptions: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert on (user_id, type); the last change of a key wins."""
    filled = changes.withColumn("filters", F.coalesce("filters", _no_filters()))
    return upsert(subscriptions, filled, ["user_id", "type"])


def _no_filters():
    none = F.lit(None).cast("array<string>")
    return F.struct(*[none.alias(n) for n in ("artists", "regions", "genres", "mediums")]).cast(NO_FILTERS)


def subscriptions_of(subscriptions: DataFrame) -> DataFrame:
    """(user_id, subscriptions): type -> (enabled, filters); (user, type) is the key, so a map has few entries."""
    entry = F.struct("type", F.struct("enabled", F.coalesce("filters", _no_filters()).alias("filters")).alias("value"))
    return subscriptions.groupBy("user_id").agg(F.map_from_entries(F.collect_list(entry)).alias("subscriptions"))


def update_locales(profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """Last accepted locale per user; unsupported locales are ignored."""
    accepted = changes.filter(F.col("locale").isin(*LOCALES)).select("id", "locale", "seq")
    return patch_rows(profiles, latest_by(accepted, ["id"]).drop("seq"), ["id"])
