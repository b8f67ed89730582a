"""Canonical tables on shared storage.

A table is a folder of parquet deltas, ``batch=<n>/run=<name>``, each holding only the rows that batch made
new or changed; the current state is the last row per key. ``n`` is a sequence over the table, ``run`` names who
wrote the delta. This form serves tables that are loaded now and then and read whole; the stream keeps its tables in
``commits``, as hash buckets under a manifest.
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from listingmill.schemas import RAW, TABLES, empty, non_finite
from listingmill.session import together
from listingmill.sources.ledger import Ledger


def scan_raw_listings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(RAW).format(fmt).load(path)


def delta_path(root: str, table: str, batch: int, run: str = "own") -> str:
    return f"{root}/{table}/batch={batch}/run={run}"


def reset_table(spark: SparkSession, root: str, table: str, schema: str | None = None) -> None:
    """Empty the table and restore its schema as batch -1."""
    start = spark.createDataFrame([], schema) if schema else empty(spark, table)
    start.withColumns({"batch": F.lit(-1), "run": F.lit("own")}).write.mode("overwrite").parquet(f"{root}/{table}")
    start.write.mode("overwrite").parquet(delta_path(root, table, -1))


def write_delta(df: DataFrame, root: str, table: str, batch: int, run: str = "own") -> None:
    df.write.mode("overwrite").parquet(delta_path(root, table, batch, run))


def scan_canonical(
    spark: SparkSession, root: str, table: str, before: int | None = None, schema: str | None = None
) -> DataFrame:
    """The table's rows as of a batch: last delta per id, the first delta's position.

    ``batch`` is a partition column, so ``before`` prunes folders.
    """
    rows = spark.read.schema(f"{schema or TABLES[table]}, batch INT, run STRING").parquet(f"{root}/{table}").drop("run")
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    rest = [c for c in rows.columns if c not in ("id", "batch")]
    latest = rows.groupBy("id").agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return latest.select("id", "r.*").select(*[c for c in rows.columns if c != "batch"])


def _written(part: DataFrame, path: str, fmt: str) -> int:
    """Write a part, counting its rows on the way; NaN or infinity anywhere refuses it, as strict readers would."""
    seen = Observation()
    part.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(non_finite(part)).alias("bad")).write.mode("overwrite").format(fmt).save(path)
    if seen.get["bad"]:
        raise ValueError(f"{seen.get['bad']} rows of the catalogue hold NaN or infinity")
    return seen.get["rows"]


def write_document(parts: dict[str, DataFrame], generated_at: str, path: str, keep: int = 2) -> int:
    """Publish a catalogue of several parts, JSON lines each, as one document; returns its number.

    Every plan runs once: the finite test is observed while the part is written aside. Only when all parts are whole, the document's
    entry appears, with ``generated_at`` and the counts; a refused one leaves nothing behind. Readers of the last ``keep`` documents are
    not disturbed, older ones go.
    """
    spark = next(iter(parts.values())).sparkSession
    entries = Ledger(spark, f"{path}/documents")
    version = f"parts/{uuid.uuid4().hex}"
    files = Ledger(spark, path)
    try:
        counts = together({name: partial(_written, part, f"{path}/{version}/{name}", "json") for name, part in parts.items()})
    except Exception:
        files.delete(version)
        raise
    number = max(entries.numbers(), default=-1) + 1
    entries.publish(number, {"generated_at": generated_at, "parts": {n: f"{version}/{n}" for n in parts}, "counts": counts, "version": version})
    for old in entries.numbers()[:-keep]:
        files.delete(entries.read(old)["version"])
        entries.delete(f"{old}.json")
    return number


def read_document(spark: SparkSession, path: str, schemas: dict[str, StructType]) -> tuple[dict, dict[str, DataFrame]]:
    """The last published document: its entry, and its parts by the schemas given."""
    entries = Ledger(spark, f"{path}/documents")
    entry = entries.read(entries.numbers()[-1])
    return entry, {n: spark.read.schema(schemas[n]).json(f"{path}/{p}") for n, p in entry["parts"].items() if n in schemas}


def write_catalog(catalogue: DataFrame, path: str, fmt: str = "json") -> None:
    """Publish nested rows as one folder. They are written aside, tested in the same pass, and moved there when they pass."""
    aside, files = f"{path}-{uuid.uuid4().hex}", Ledger(catalogue.sparkSession, path)
    try:
        _written(catalogue, aside, fmt)
    except Exception:
        Ledger(catalogue.sparkSession, aside).delete("")
        raise
    target, system = files.path()
    system.delete(target, True)
    if not system.rename(files._jvm.org.apache.hadoop.fs.Path(aside), target):
        raise RuntimeError(f"{aside} could not be moved to {path}")
