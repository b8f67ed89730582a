"""Entity resolution as joins: override, then known entity, then new entity.

The reference order-of-arrival semantics need no loop: every key is a pure function of its own
row, so "created by an earlier row" equals "same key", and the creator is the first row by
(source order, seq).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingmill.functions.classify import map_organizer_type, map_venue_type
from listingmill.functions.keys import artist_id, organizer_id, venue_id
from listingmill.functions.text import normalize_name
from listingmill.operators.merge import latest_by
from listingmill.schemas import source_registry
from listingmill.session import materialize, shared_dir

# What the ids of a listing depend on; its artists go by ``seq``.
RESOLVED_BY = ("seq", "venue_name", "organizer_name")


def override_table(overrides: DataFrame, entity: str) -> DataFrame:
    """(pattern, target), the last row of a pattern winning."""
    usable = overrides.filter(
        (F.col("entity_type") == entity)
        & (F.coalesce("match_pattern", F.lit("")) != "")
        & (F.coalesce("canonical_id", F.lit("")) != "")
    )
    return latest_by(usable.select("match_pattern", "canonical_id", "seq"), ["match_pattern"]).select(
        F.col("match_pattern").alias("pattern"), F.col("canonical_id").alias("target")
    )


def mentions(listings: DataFrame, name: Column) -> DataFrame:
    """(raw_name, name_normalized) once per distinct text: composition and overrides run on
    distinct names, not on every mention, and a name held by a third of the rows is one row."""
    return (
        listings.select(name.alias("raw_name"))
        .filter(F.coalesce("raw_name", F.lit("")) != "")
        .distinct()
        .withColumn("norm", normalize_name(F.col("raw_name")))
    )


def artist_dictionary(listings: DataFrame, artists: DataFrame, overrides: DataFrame, artist_ids: DataFrame | None = None) -> DataFrame:
    """(raw_name, norm, own_id, own_new, target, target_from) for every distinct raw artist name.

    An override's target is usable from the arrival ``target_from`` on: always if the artist is stored, else behind the row of the
    batch whose name, itself without an override, makes that artist. Targets that never exist are left out. ``artists`` need
    only hold the batch's names if ``artist_ids`` tells the ids of all.
    """
    # read by three joins below: composed once, outside the JVM, and not once for each
    names = materialize(mentions(listings, F.explode("artist_names")), shared_dir(listings.sparkSession, "artist-mentions"))
    rules = override_table(overrides, "artist").withColumnRenamed("pattern", "raw_name")
    named = names.select("norm").distinct().withColumnRenamed("norm", "name_normalized")
    known = (
        artists.join(named, "name_normalized", "left_semi")
        .groupBy("name_normalized")
        .agg(F.max_by("id", "seq").alias("own"))
        .withColumnRenamed("name_normalized", "norm")
    )
    own = names.join(known, "norm", "left").select(
        "raw_name", "norm", F.coalesce("own", artist_id(F.col("norm"))).alias("own_id"), F.col("own").isNull().alias("own_new")
    )
    hits = rules.join(names.select("raw_name"), "raw_name", "left_semi")
    stored = (artists if artist_ids is None else artist_ids).select(F.col("id").alias("target")).distinct()
    always = hits.join(stored, "target", "left_semi").withColumn("target_from", _arrival(F.lit(-1), F.lit(0)))
    # Few rules name an artist that isn't stored; the batch's mentions are read for these alone.
    unstored = hits.join(stored, "target", "left_anti")
    makers = own.filter(F.col("own_new") & (F.col("norm") != "")).join(rules.select("raw_name"), "raw_name", "left_anti")
    makers = makers.join(unstored.select(F.col("target").alias("own_id")), "own_id", "left_semi")
    born = (
        with_arrival(listings).select("arrival", F.explode("artist_names").alias("raw_name"))
        .join(makers, "raw_name")
        .groupBy(F.col("own_id").alias("target"))
        .agg(F.min("arrival").alias("target_from"))
    )
    usable = always.unionByName(unstored.join(born, "target")).select("raw_name", "target", "target_from")
    return own.join(usable, "raw_name", "left")


def _arrival(rank: Column, seq: Column) -> Column:
    return F.struct(rank.cast("int").alias("rank"), seq.cast("long").alias("seq"))


def with_arrival(listings: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Listings with their place in the order of arrival (rank of the source, seq) and the source's country; 22 registry rows."""
    ranks = registry if registry is not None else source_registry(listings.sparkSession)
    return listings.join(F.broadcast(ranks), "source", "left").withColumn("arrival", _arrival(F.coalesce("source_rank", F.lit(1 << 30)), F.col("seq")))


def overridden() -> Column:
    """Whether a row of the dictionary goes by its override at a listing's arrival."""
    return F.col("target").isNotNull() & (F.col("arrival") > F.col("target_from"))


def resolve_artists(listings: DataFrame, artists: DataFrame, overrides: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(seq, artist_ids): ids in the order of the raw names, duplicates kept."""
    table = artist_dictionary(listings, artists, overrides) if dictionary is None else dictionary
    rows = with_arrival(listings).select("seq", "arrival", F.posexplode("artist_names").alias("pos", "raw_name"))
    found = F.when(overridden(), F.col("target")).when(F.col("norm") != "", F.col("own_id"))
    named = rows.filter(F.coalesce("raw_name", F.lit("")) != "")
    return (
        named.join(table.select("raw_name", "norm", "own_id", "target", "target_from"), "raw_name")
        .withColumn("artist_id", found)
        .filter(F.col("artist_id").isNotNull())
        .groupBy("seq")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "artist_id"))).alias("x"))
        .select("seq", F.transform("x", lambda e: e["artist_id"]).alias("artist_ids"))
    )


def venue_dictionary(listings: DataFrame, venues: DataFrame, overrides: DataFrame) -> DataFrame:
    """(venue_name, venue_id, is_new)."""
    names = listings.select("venue_name").filter(F.col("venue_name").isNotNull()).distinct()
    rules = override_table(overrides, "venue").withColumnRenamed("pattern", "venue_name")
    known = venues.select(F.col("id").alias("candidate"), F.lit(True).alias("known")).distinct()
    return (
        names.join(rules, "venue_name", "left")
        .withColumn("candidate", venue_id(F.col("venue_name")))
        .join(known, "candidate", "left")
        .select(
            "venue_name",
            F.coalesce("target", "candidate").alias("venue_id"),
            (F.col("target").isNull() & F.col("known").isNull()).alias("is_new"),
        )
    )


def resolve_venues(listings: DataFrame, venues: DataFrame, overrides: DataFrame) -> DataFrame:
    """(seq, venue_id); an empty id when the listing names no venue."""
    table = venue_dictionary(listings, venues, overrides).select("venue_name", "venue_id")
    return _looked_up(listings.select("seq", "venue_name"), table, "venue_name").select("seq", F.coalesce("venue_id", F.lit("")).alias("venue_id"))


def _looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of ``table`` for their key, NULL without one."""
    return rows.join(table, key, "left")


def organizer_dictionary(listings: DataFrame, organizers: DataFrame, overrides: DataFrame) -> DataFrame:
    """(raw_name, norm, organizer_id, is_new); the first known organiser of a name wins."""
    names = mentions(listings, F.col("organizer_name"))
    rules = override_table(overrides, "organizer").withColumnRenamed("pattern", "raw_name")
    known = (
        organizers.groupBy("name_normalized")
        .agg(F.min_by("id", "seq").alias("known_id"))
        .withColumnRenamed("name_normalized", "norm")
    )
    return (
        names.join(rules, "raw_name", "left")
        .join(known, "norm", "left")
        .select(
            "raw_name",
            "norm",
            F.coalesce("target", "known_id", organizer_id(F.col("norm"))).alias("organizer_id"),
            (F.col("target").isNull() & F.col("known_id").isNull()).alias("is_new"),
        )
    )


def resolve_organizers(with_venue: DataFrame, organizers: DataFrame, overrides: DataFrame) -> DataFrame:
    """(seq, organizer_id): the venue's id when the listing names no organiser."""
    table = organizer_dictionary(with_venue, organizers, overrides).select("raw_name", "organizer_id")
    rows = with_venue.select("seq", "venue_id", F.col("organizer_name").alias("raw_name"))
    return _looked_up(rows, table, "raw_name").select("seq", F.coalesce("organizer_id", "venue_id").alias("organizer_id"))


def resolve_listings(
    listings: DataFrame, artists: DataFrame, venues: DataFrame, organizers: DataFrame, overrides: DataFrame, dictionary: DataFrame | None = None
) -> DataFrame:
    """Listings with artist_ids, venue_id and organizer_id. ``dictionary`` is that of the artists, where the caller has it."""
    ids = materialize(resolved_ids(listings, artists, venues, organizers, overrides, dictionary), shared_dir(listings.sparkSession, "resolved-ids"))
    asked = {f"_{key}": F.col(key).eqNullSafe(F.col(f"_{key}")) for key in RESOLVED_BY}
    out = listings.join(ids.withColumnsRenamed({key: f"_{key}" for key in RESOLVED_BY}), reduce(and_, asked.values()), "left").drop(*asked)
    return out.withColumn("artist_ids", F.coalesce("artist_ids", F.array().cast("array<string>")))


def resolved_ids(
    listings: DataFrame, artists: DataFrame, venues: DataFrame, organizers: DataFrame, overrides: DataFrame, dictionary: DataFrame | None = None
) -> DataFrame:
    """(seq, venue_name, organizer_name, venue_id, organizer_id, artist_ids), once for each of the first three, which may be NULL
    or, where a listing comes again, repeat: names go through the joins, whole rows don't."""
    venue_ids = venue_dictionary(listings, venues, overrides).select("venue_name", "venue_id")
    organizer_ids = organizer_dictionary(listings, organizers, overrides).select(F.col("raw_name").alias("organizer_name"), "organizer_id")
    names = listings.select(*RESOLVED_BY).distinct()
    out = _looked_up(_looked_up(names, venue_ids, "venue_name"), organizer_ids, "organizer_name")
    venue_id = F.coalesce("venue_id", F.lit(""))
    out = out.select(*RESOLVED_BY, venue_id.alias("venue_id"), F.coalesce("organizer_id", venue_id).alias("organizer_id"))
    return out.join(resolve_artists(listings, artists, overrides, dictionary), "seq", "left")


def new_artists(listings, artists, overrides, registry, stamp, dictionary: DataFrame | None = None) -> DataFrame:
    table = artist_dictionary(listings, artists, overrides) if dictionary is None else dictionary
    fresh = table.filter(F.col("own_new") & (F.col("norm") != ""))
    rows = with_arrival(listings, registry).select(
        "source", "arrival", F.posexplode("artist_names").alias("pos", "raw_name")
    )
    # first mention per spelling before the join, so a name held by most rows joins as one row
    first = (
        rows.groupBy("raw_name")
        .agg(
            F.min_by(F.struct("source", "arrival"), F.struct("arrival", "pos")).alias("s"),
            F.min(F.struct("arrival", "pos")).alias("at"),
            F.min("arrival").alias("arrival"),
        )
        .join(fresh, "raw_name")
        .filter(~overridden())
        .groupBy("norm", "own_id")
        .agg(F.min_by(F.struct("raw_name", "s.source", "s.arrival"), "at").alias("f"))
    )
    return first.select(
        F.col("own_id").alias("id"),
        F.col("f.raw_name").alias("name"),
        F.col("norm").alias("name_normalized"),
        F.array("f.source").alias("sources"),
        F.lit(stamp).cast("timestamp").alias("first_seen_at"),
        F.lit(stamp).cast("timestamp").alias("updated_at"),
        F.col("f.arrival.seq").alias("seq"),
    )


def new_venues(listings, venues, overrides, registry, stamp) -> DataFrame:
    fresh = venue_dictionary(listings, venues, overrides).filter("is_new")
    rows = with_arrival(listings, registry).filter(F.col("venue_name").isNotNull())
    first = rows.groupBy("venue_name").agg(
        F.min_by(
            F.struct("source", "arrival", "venue_region", "venue_address", "venue_lat", "venue_lng", "country"),
            "arrival",
        ).alias("f")
    )
    return first.join(fresh, "venue_name").select(
        F.col("venue_id").alias("id"),
        F.col("venue_name").alias("name"),
        map_venue_type(F.col("venue_name")).alias("venue_type"),
        F.col("f.venue_region").alias("region"),
        F.col("f.venue_address").alias("address"),
        F.col("f.venue_lat").alias("latitude"),
        F.col("f.venue_lng").alias("longitude"),
        F.array("f.source").alias("sources"),
        F.lit(stamp).cast("timestamp").alias("first_seen_at"),
        F.lit(stamp).cast("timestamp").alias("updated_at"),
        F.coalesce("f.country", F.lit("KR")).alias("country"),
        F.col("f.arrival.seq").alias("seq"),
    )


def new_organizers(listings, organizers, overrides, registry, stamp) -> DataFrame:
    fresh = organizer_dictionary(listings, organizers, overrides).filter("is_new")
    rows = with_arrival(listings, registry).select("source", "arrival", F.col("organizer_name").alias("raw_name"))
    first = (
        rows.groupBy("raw_name")
        .agg(F.min_by("source", "arrival").alias("source"), F.min("arrival").alias("arrival"))
        .join(fresh, "raw_name")
        .groupBy("norm", "organizer_id")
        .agg(F.min_by(F.struct("raw_name", "source", "arrival"), "arrival").alias("f"))
    )
    return first.select(
        F.col("organizer_id").alias("id"),
        F.col("f.raw_name").alias("name"),
        F.col("norm").alias("name_normalized"),
        map_organizer_type(F.col("f.raw_name")).alias("organizer_type"),
        F.array("f.source").alias("sources"),
        F.lit(stamp).cast("timestamp").alias("first_seen_at"),
        F.lit(stamp).cast("timestamp").alias("updated_at"),
        F.col("f.arrival.seq").alias("seq"),
    )
