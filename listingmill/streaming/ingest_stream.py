"""Structured Streaming form of the ingest.

Each micro-batch runs the batch ingest over the buckets that hold its keys, and commits the new and changed rows with the rejected
listings and the run's report; the next batch starts from that commit. State lives in the tables, so no watermark is needed:
re-delivered listings come out unchanged, and a replayed batch is already committed. Stored shows whose status has moved since the
last batch are found by the calendar and written along, so the tables end in the state of a batch run.

What a batch reads and writes follows the batch: the buckets of its keys, the calendar days that have passed, and the buckets of
the shows due on them. Only if an override names one of the batch's artists, the ids of all artists are read.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from listingmill.functions.keys import venue_id
from listingmill.operators.resolve import mentions, override_table
from listingmill.plans.ingest import State, action_metrics, run_ingest
from listingmill.schemas import RAW
from listingmill.session import materialize, shared_dir, together
from listingmill.sources.commits import Store

CHANGED = ("new", "updated", "status")


def state_of(store: Store, overrides: DataFrame, gazetteer: DataFrame, today) -> Callable[[DataFrame], State]:
    """The part of the stored tables that a batch of normalised listings needs."""
    at = store.manifest()

    def read(good: DataFrame) -> State:
        artists = mentions(good, F.explode("artist_names"))
        halls = good.filter("venue_name IS NOT NULL").select(venue_id(F.col("venue_name")).alias("id"))
        ruled = override_table(overrides, "artist").join(artists, F.col("pattern") == F.col("raw_name"), "left_semi")
        due = store.due(today, at)
        tables = together({
            "exhibitions": lambda: store.scan("exhibitions", good.select("id"), at),
            "artists": lambda: store.scan("artists", artists.select("norm"), at),
            "venues": lambda: store.scan("venues", halls, at),
            "organizers": lambda: store.scan("organizers", mentions(good, F.col("organizer_name")).select("norm"), at),
            "due": lambda: store.scan("exhibitions", due, at).join(due, "id", "left_semi"),
            "artist_ids": lambda: None if ruled.isEmpty() else store.scan("artists", at=at).select("id"),
        })
        return State(**tables, overrides=overrides, gazetteer=gazetteer)

    return read


def spread(raw: DataFrame) -> DataFrame:
    """The listings in as many tasks at least as the session's shuffles have: a batch may come in one or two large files, and what is
    read in one task is parsed in it."""
    tasks = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return raw if raw.rdd.getNumPartitions() >= tasks else raw.repartition(tasks)


def ingest_batch(store: Store, raw: DataFrame, overrides: DataFrame, gazetteer: DataFrame, today, stamp: str, run_name: str) -> None:
    """Ingest one batch and commit it. Counts come from the passes that do the work, by observed metrics."""
    if store.committed(run_name):
        return
    spark, began = raw.sparkSession, time.monotonic()
    listings, shows = Observation(), Observation()
    run = run_ingest(spread(raw), state_of(store, overrides, gazetteer, today), today, stamp, batch_only=True, observed=listings)
    merged = {table: getattr(run, table) for table in ("artists", "venues", "organizers", "exhibitions")}
    merged["exhibitions"] = run.exhibitions.observe(shows, *action_metrics())
    keep = lambda table: materialize(merged[table].filter(F.col("action").isin(*CHANGED)).drop("action"), shared_dir(spark, f"changed-{table}"))
    changes = together({table: partial(keep, table) for table in merged})
    report = {**listings.get, **shows.get, "duration": round(time.monotonic() - began, 3)}
    store.commit(changes, run_name, today, run.rejects, report, run.listings)


def stream_ingest(
    spark: SparkSession,
    inbox: str,
    root: str,
    checkpoint: str,
    overrides: DataFrame,
    gazetteer: DataFrame,
    today,
    stamp: str,
    files_per_batch: int = 1000,
) -> Store:
    """Consume everything that has arrived in ``inbox`` and stop (the cron form of a stream)."""
    arrivals = (
        spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).parquet(inbox)
    )
    name = "s" + hashlib.sha256(checkpoint.encode()).hexdigest()[:16]  # a new checkpoint is another stream over the tables
    store = Store(spark, root)

    def write(raw: DataFrame, batch: int) -> None:
        own = Store(raw.sparkSession, root, store.buckets)
        own.opened = store.opened
        ingest_batch(own, raw, overrides, gazetteer, today, stamp, f"{name}-{batch}")

    query = (
        arrivals.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return store
