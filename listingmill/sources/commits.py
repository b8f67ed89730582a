"""Canonical tables as hash buckets under one manifest per commit.

Every table is dealt into buckets by the hash of its key. A commit rewrites only the buckets that hold its rows, each as a folder of
its own, and then writes a manifest, the list of the folders that make up the tables from now on. The manifest appears under its
final name at once and never changes, so a reader that starts from one sees a whole commit or none, and goes on reading its
folders while later commits are made. ``vacuum`` deletes folders that none of the last manifests name.

A commit carries the name of its run. A run that has its manifest already is not committed again, so a replayed micro-batch
changes nothing; one that died before its manifest left folders that no manifest names.

The calendar holds, by day, the ids of shows whose status changes on that day. A run reads only the days that have passed since
the last one, and opens only the buckets of their ids. A manifest also names the schema of each folder's writer: columns that were
added since are NULL in older folders.

Manifests are small: one entry for each bucket and calendar day. Their numbers are taken one after another by a single writer at a time.
"""

from __future__ import annotations

import datetime
import uuid
from dataclasses import asdict, dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from listingmill.schemas import TABLES, evolve_plan
from listingmill.session import together
from listingmill.sources.ledger import Ledger

BUCKETS = 64
#: What rows are looked up by; a row is told from others by its id.
KEYS = {"exhibitions": "id", "venues": "id", "artists": "name_normalized", "organizers": "name_normalized"}


@dataclass(frozen=True)
class Manifest:
    number: int
    run: str
    day: str | None = None  # the last day the statuses were brought up to
    tables: dict = field(default_factory=dict)  # table: {bucket: folder}
    schemas: dict = field(default_factory=dict)  # folder's version: DDL of its writer
    calendar: dict = field(default_factory=dict)  # day: [folder]
    rejects: list = field(default_factory=list)
    report: dict = field(default_factory=dict)
    listed: list = field(default_factory=list)  # folders of the dates that listings gave


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def next_change(start: Column, end: Column, today) -> Column:
    """The next day after ``today`` on which a show's status changes: its first, or the day after its last."""
    return F.when(start > F.lit(today), start).when(end >= F.lit(today), F.date_add(end, 1))


class Store:
    """Tables below ``root``, any file system that Spark opens."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, tables: dict[str, str] | None = None, keys: dict[str, str] | None = None):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.tables, self.keys = tables or TABLES, keys or KEYS
        self._commits, self._files = Ledger(spark, f"{self.root}/_commits"), Ledger(spark, self.root)
        #: Folders that scans have opened, for tests and logs.
        self.opened: list[str] = []

    # -- manifests ---------------------------------------------------------

    def numbers(self) -> list[int]:
        return self._commits.numbers()

    def manifest(self, number: int | None = None) -> Manifest:
        """The manifest of a commit, the last one by default; an empty one before the first."""
        number = max(self.numbers(), default=-1) if number is None else number
        return Manifest(**self._commits.read(number)) if number >= 0 else Manifest(-1, "")

    def _publish(self, manifest: Manifest) -> None:
        self._commits.publish(manifest.number, asdict(manifest))

    def committed(self, run: str) -> bool:
        """Whether one of the last commits is the run's; a stream replays its last batch only."""
        return any(self.manifest(n).run == run for n in self.numbers()[-16:])

    # -- reading -----------------------------------------------------------

    def scan(self, table: str, keys: DataFrame | None = None, at: Manifest | None = None) -> DataFrame:
        """The table as of a commit. With ``keys``, one column, only the buckets that may hold them (whole, other keys too)."""
        at = at or self.manifest()
        folders = at.tables.get(table, {})
        if keys is not None:
            some = keys.select(bucket_of(F.col(keys.columns[0]), self.buckets).alias("b")).distinct().collect()  # at most one row for each bucket
            folders = {b: p for b, p in folders.items() if int(b) in {r.b for r in some}}
        return self._read(table, sorted(set(folders.values())), at.schemas)

    def _read(self, table: str, folders: list[str], known: dict[str, str]) -> DataFrame:
        """Folders of one table in its present schema; each is read by the schema of its writer."""
        schema = StructType.fromDDL(self.tables[table])
        self.opened += folders
        versions: dict[str, list[str]] = {}
        for folder in folders:
            versions.setdefault(known.get(folder.split("/")[1], self.tables[table]), []).append(f"{self.root}/{folder}")
        out = self.spark.createDataFrame([], schema)
        for ddl, paths in versions.items():
            old = StructType.fromDDL(ddl)
            action, added = evolve_plan(old.names, schema.names)
            if action == "error":
                raise ValueError(f"{table}: incompatible columns {old.names} -> {schema.names}")
            part = self.spark.read.schema(old).parquet(*paths)
            out = out.unionByName(part.withColumns({c: F.lit(None).cast(schema[c].dataType) for c in added}) if added else part)
        return out

    def due(self, today: datetime.date, at: Manifest | None = None) -> DataFrame:
        """Ids of the shows whose status may have changed since the last commit, up to ``today``."""
        at = at or self.manifest()
        if at.day and str(today) < at.day:  # days don't go back: look at every show
            return self.scan("exhibitions", at=at).select("id")
        folders = [p for day, paths in at.calendar.items() if day <= str(today) for p in paths]
        self.opened += folders
        rows = self.spark.read.schema("id STRING").parquet(*[f"{self.root}/{p}" for p in folders]) if folders else self.spark.createDataFrame([], "id STRING")
        return rows.distinct()

    # -- writing -----------------------------------------------------------

    def commit(self, changes: dict[str, DataFrame], run: str, today: datetime.date | None = None, rejects: DataFrame | None = None, report: dict | None = None, listed: DataFrame | None = None) -> Manifest:
        """Make the rows of ``changes`` part of the tables, in place of rows with their id. A run is committed once."""
        last = self.manifest()
        if self.committed(run):
            return last
        version = f"{last.number + 1}-{uuid.uuid4().hex[:8]}"
        tables = {t: dict(last.tables.get(t, {})) for t in self.tables}
        schemas = dict(last.schemas)
        steps = {table: partial(self._rewrite, table, rows, last, version) for table, rows in changes.items()}
        if today is not None and "exhibitions" in changes:
            steps["calendar"] = partial(self._plan_days, changes["exhibitions"], version, today)
        if rejects is not None:
            steps["rejects"] = partial(self._put_aside, rejects, f"rejects/{version}")
        if listed is not None:
            steps["listed"] = partial(self._log_dates, listed, f"listed/{version}")
        done = together(steps)
        for table in changes:
            if done[table]:
                tables[table].update(done[table])
                schemas[f"{table}-{version}"] = self.tables[table]
        calendar = {d: list(p) for d, p in last.calendar.items() if today is None or d > str(today)}
        for day, folder in done.get("calendar", {}).items():
            calendar.setdefault(day, []).append(folder)
        kept = [*last.rejects, *done.get("rejects", [])]
        named = {p.split("/")[1] for t in tables.values() for p in t.values()}
        made = Manifest(
            last.number + 1, run, str(today) if today else last.day, tables, {v: d for v, d in schemas.items() if v in named}, calendar, kept, report or {},
            [*last.listed, *done.get("listed", [])],
        )
        self._publish(made)
        return made

    def _rewrite(self, table: str, rows: DataFrame, last: Manifest, version: str) -> dict[str, str]:
        """The buckets of ``rows`` with these rows in place of those of the same id."""
        key = self.keys[table]
        fresh = rows.select(*StructType.fromDDL(self.tables[table]).names)
        old = self.scan(table, fresh.select(key), last).join(fresh.select("id"), "id", "left_anti")
        folder = f"{table}/{table}-{version}"
        dealt = old.unionByName(fresh).withColumn("bucket", bucket_of(F.col(key), self.buckets))
        dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{folder}")
        return {str(n): f"{folder}/bucket={n}" for n in self._numbers(folder, "bucket")}

    def _plan_days(self, shows: DataFrame, version: str, today: datetime.date) -> dict[str, str]:
        """The calendar folder of each day on which one of the shows changes its status next."""
        folder = f"calendar/{version}"
        days = shows.select("id", next_change(F.col("start_date"), F.col("end_date"), today).cast("string").alias("day")).filter("day IS NOT NULL")
        days.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/{folder}")
        return {day: f"{folder}/day={day}" for day in self._numbers(folder, "day")}

    def _put_aside(self, rejects: DataFrame, folder: str) -> list[str]:
        if rejects.isEmpty():
            return []
        rejects.write.mode("overwrite").parquet(f"{self.root}/{folder}")
        return [folder]

    def _log_dates(self, listings: DataFrame, folder: str) -> list[str]:
        listings.select("id", "start_date", "end_date").distinct().write.mode("overwrite").parquet(f"{self.root}/{folder}")
        return [folder]

    def listed(self) -> DataFrame:
        """(id, start_date, end_date) of all listings, each once. The tables keep a show's last listing; its id doesn't tell end dates apart."""
        schema, folders = "id STRING, start_date DATE, end_date DATE", [f"{self.root}/{p}" for p in self.manifest().listed]
        return (self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)).distinct()

    def _numbers(self, folder: str, column: str) -> list[str]:
        return [n.removeprefix(f"{column}=") for n in self._files.names(folder) if n.startswith(f"{column}=")]

    def rejected(self, schema: str) -> DataFrame:
        """All rows that commits have put aside."""
        folders = [f"{self.root}/{p}" for p in self.manifest().rejects]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 8) -> int:
        """Delete what none of the last ``keep`` manifests name; readers of these manifests are safe. Returns how many folders went."""
        numbers = self.numbers()
        living = set()
        for n in numbers[-keep:]:
            m = self.manifest(n)
            living |= {p for t in m.tables.values() for p in t.values()} | {p for ps in m.calendar.values() for p in ps} | set(m.rejects)
        gone = 0
        for top in (*self.tables, "calendar"):
            column = "day" if top == "calendar" else "bucket"
            for version in self._files.names(top):
                for number in self._numbers(f"{top}/{version}", column):
                    if (folder := f"{top}/{version}/{column}={number}") not in living:
                        gone += self._files.delete(folder)
        for n in numbers[:-keep]:
            self._commits.delete(f"{n}.json")
        return gone
