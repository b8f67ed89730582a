"""Natural keys: the first twelve hex digits of SHA-1 over ``|``-joined parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(*parts: Column) -> Column:
    # array_join with a null replacement keeps an empty slot; concat_ws would drop it.
    return F.substring(F.sha1(F.array_join(F.array(*parts), "|", "")), 1, 12)


def exhibition_id(source: Column, venue_name: Column, title: Column, start: Column) -> Column:
    return _digest(source, venue_name, title, start.cast("date").cast("string"))


def artist_id(name_normalized: Column) -> Column:
    return _digest(F.lit("artist"), name_normalized)


def organizer_id(name_normalized: Column) -> Column:
    return _digest(F.lit("organizer"), name_normalized)


def venue_id(name: Column, normalized_address: Column | None = None) -> Column:
    by_name = _digest(F.lit("venue:name"), name)
    if normalized_address is None:
        return by_name
    return F.when(
        F.coalesce(normalized_address, F.lit("")) != "",
        _digest(F.lit("venue:addr"), normalized_address),
    ).otherwise(by_name)


def facts_hash(*parts: Column) -> Column:
    """Sixteen hex digits of SHA-256 over the non-NULL parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
