"""Batch ingest: normalise, resolve, geocode, merge, report.

The normalised listings feed four merges, so they are written once to the shared folder; from
there each output table is one lazy plan. Without that cut the optimiser would also push key
filters down through every parsing stage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from listingmill.functions.dates import compute_status
from listingmill.operators import resolve
from listingmill.operators.enrich import geocode
from listingmill.operators.merge import drop_blank_ids, refresh_status, upsert
from listingmill.operators.normalize import normalize_listings, split_rejects
from listingmill.schemas import SOFT_FAIL_SOURCES, SOURCES, source_registry
from listingmill.session import materialize, shared_dir

# Columns of a listing that a canonical exhibition stores.
EXHIBITION_COLUMNS = (
    "id", "source", "status", "source_url", "title", "title_en", "description", "poster_image_url", "medium",
    "exhibition_type", "genre_tags", "fee_type", "price_min", "price_max", "activities", "start_date", "end_date",
    "open_hours", "artist_ids", "venue_id", "organizer_id", "popularity_score", "featured", "crawled_at",
    "updated_at", "_warnings", "price_breakdown", "price_notes", "seq",
)


@dataclass(frozen=True)
class State:
    """The canonical tables a run starts from, and the lookup tables it reads.

    A run over a batch needs of each table only the rows that the batch may touch. ``due`` then holds the other shows whose status
    may have moved, and ``artist_ids`` the ids of all artists; without them the tables themselves are looked through.
    """

    exhibitions: DataFrame
    artists: DataFrame
    venues: DataFrame
    organizers: DataFrame
    overrides: DataFrame
    gazetteer: DataFrame
    due: DataFrame | None = None
    artist_ids: DataFrame | None = None


@dataclass(frozen=True)
class Ingest:
    """Merged tables (with an ``action`` per row) and the rejected listings."""

    exhibitions: DataFrame
    artists: DataFrame
    venues: DataFrame
    organizers: DataFrame
    rejects: DataFrame
    listings: DataFrame


def listing_metrics() -> list[Column]:
    """Counts of normalised rows, for ``observe``: all and the rejected, in total, by source and by reason."""
    bad = F.col("error").isNotNull()
    of = {name: F.col("source") == name for name, _ in SOURCES}
    return [
        F.count(F.lit(1)).alias("extracted"), F.count_if(bad).alias("errors"),
        *[F.count_if(c).alias(f"extracted:{n}") for n, c in of.items()], *[F.count_if(c & bad).alias(f"errors:{n}") for n, c in of.items()],
        F.collect_set("error").alias("reasons"),
    ]


def action_metrics() -> list[Column]:
    """Counts of merged shows by action, for ``observe``."""
    actions = ("new", "updated", "unchanged", "status")
    return [F.count_if(F.coalesce((F.col("action") == a) & (F.col("source") == n), F.lit(False))).alias(f"{a}:{n}") for a in actions for n, _ in SOURCES]


def run_ingest(
    raw: DataFrame, state: State | Callable[[DataFrame], State], today, stamp: str, batch_only: bool = False, observed: Observation | None = None
) -> Ingest:
    """One batch over all sources at once; the per-source loop of a crawler is just the ``source`` column.

    ``batch_only`` returns only the rows the batch touches or whose status has moved, for tables that store deltas. ``state`` may
    be made from the normalised listings, by whoever can tell from them what to read. ``observed`` gets ``listing_metrics``
    in the pass that normalises.
    """
    spark = raw.sparkSession
    registry = source_registry(spark)
    normalized = normalize_listings(raw, stamp)
    if observed is not None:
        normalized = normalized.observe(observed, *listing_metrics())
    good, rejects = split_rejects(materialize(normalized, shared_dir(spark, "normalized")))
    state = state(good) if callable(state) else state
    overrides = state.overrides
    names = resolve.artist_dictionary(good, state.artists, overrides, state.artist_ids)
    names = materialize(names, shared_dir(spark, "artist-names"))

    fresh_venues = resolve.new_venues(good, state.venues, overrides, registry, stamp)
    fresh_venues = geocode(fresh_venues, state.gazetteer, name_with_region=True).drop("geo_action")
    resolved = resolve.resolve_listings(good, state.artists, state.venues, state.organizers, overrides, names).withColumn(
        "status", compute_status(today, F.col("start_date"), F.col("end_date"))
    )
    fresh_artists = resolve.new_artists(good, state.artists, overrides, registry, stamp, names)
    fresh_organizers = resolve.new_organizers(good, state.organizers, overrides, registry, stamp)

    def merged(stored: DataFrame, batch: DataFrame) -> DataFrame:
        return upsert(stored, batch, ["id"], batch_only=batch_only)

    # the closing pass over the whole table: rows outside the batch may have opened or ended
    batch = resolved.select(*EXHIBITION_COLUMNS)
    exhibitions = refresh_status(merged(state.exhibitions, batch), today)
    if batch_only:
        elsewhere = drop_blank_ids(state.exhibitions if state.due is None else state.due, ["id"]).withColumn("action", F.lit("kept"))
        moved = refresh_status(elsewhere, today).filter(F.col("action") == "status").join(batch.select("id"), "id", "left_anti")
        exhibitions = exhibitions.unionByName(moved)
    return Ingest(
        exhibitions=exhibitions,
        artists=merged(state.artists, fresh_artists),
        venues=merged(state.venues, fresh_venues),
        organizers=merged(state.organizers, fresh_organizers),
        rejects=rejects,
        listings=resolved,
    )


def dry_run(raw: DataFrame, source: str, stamp: str) -> DataFrame:
    """Normalised rows of one source with rejects marked; nothing is written."""
    return normalize_listings(raw.filter(F.col("source") == source), stamp)


def report_rows(metrics: dict, failures: dict[str, str] | None = None) -> list[dict]:
    """The report of a run from its observed metrics, a dict for each registered source, without another look at the data."""
    rows = []
    for source, _ in SOURCES:
        counts = {k: int(metrics.get(f"{k}:{source}") or 0) for k in ("extracted", "new", "updated", "unchanged", "errors")}
        failure = (failures or {}).get(source)
        rows.append({"source": source, **counts, "failure": failure, "hard_failure": failure is not None and source not in SOFT_FAIL_SOURCES, "duration": metrics.get("duration")})
    return rows


def ingest_report(raw: DataFrame, run: Ingest, failures: DataFrame) -> DataFrame:
    """Per registered source: extracted, new, updated, unchanged, errors, failure, hard_failure.

    ``failures``: source, failure. Soft-fail sources never count as hard failures.
    """
    registry = source_registry(raw.sparkSession)
    one = F.lit(1)
    extracted = raw.groupBy("source").agg(F.count(one).alias("extracted"))
    errors = run.rejects.groupBy("source").agg(F.count(one).alias("errors"))
    actions = run.exhibitions.groupBy("source").agg(
        *[F.count_if(F.col("action") == a).alias(a) for a in ("new", "updated", "unchanged")]
    )
    out = registry
    for part in (extracted, actions, errors, failures):
        out = out.join(part, "source", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("extracted", "new", "updated", "unchanged", "errors")]
    return out.select(
        "source", "source_rank", *counts, "failure",
        (F.col("failure").isNotNull() & ~F.col("source").isin(*SOFT_FAIL_SOURCES)).alias("hard_failure"),
    )
