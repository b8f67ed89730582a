"""Keep-last, upsert, patch and append over keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingmill.functions.dates import compute_status

# --- fixed values -----------------------------------------------------------
VOLATILE = ("crawled_at", "updated_at", "first_seen_at", "_warnings")
KEPT_FROM_EXISTING = ("crawled_at", "first_seen_at")
# -----------------------------------------------------------------------------


def latest_by(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last row per key, at the first occurrence's position.

    ``max_by`` aggregates on the map side first, so a key holding most of the rows shuffles
    one row per task instead of landing in one sort.
    """
    rest = [c for c in df.columns if c not in (*keys, order)]
    return (
        df.groupBy(*keys)
        .agg(
            F.max_by(F.struct(*rest), F.col(order)).alias("_row"),
            F.min(order).alias(order),
        )
        .select(*keys, order, "_row.*")
        .select(*df.columns)
    )


def first_by(df: DataFrame, keys: list[str], order: Column | str = "seq") -> DataFrame:
    """The first row per key. ``order`` may be a struct for a compound order."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), order if isinstance(order, Column) else F.col(order)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def drop_blank_ids(df: DataFrame, keys: list[str]) -> DataFrame:
    usable = reduce(lambda a, b: a & b, [F.coalesce(F.col(k).cast("string"), F.lit("")) != "" for k in keys])
    return df.filter(usable)


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    keys: list[str],
    order: str = "seq",
    batch_only: bool = False,
) -> DataFrame:
    """Classify and merge a batch. Returns every resulting row plus an ``action`` column.

    * ``new`` / ``updated`` / ``unchanged`` for keys of the batch, ``kept`` for rows absent from it.
    * Only the columns of the batch overwrite; a change is judged without the volatile columns
      and null-safely; a changed row keeps its first crawl and first seen times.
    * Rows without a key are ignored on the existing side; on the batch side the last row of a
      key wins. Maps are compared entry-wise because map equality is not defined.
    * ``batch_only`` leaves out the ``kept`` rows: stored rows are first cut to the batch's keys,
      a semi-join that filters the stored table in place while the batch is small.
    """
    types = dict(existing.dtypes)
    fresh = [c for c in incoming.columns if c not in (*keys, order) and c in types]
    batch = (
        drop_blank_ids(incoming, keys)
        .groupBy(*keys)
        .agg(
            F.max_by(F.struct(*[F.col(c).cast(types[c]).alias(c) for c in fresh]), F.col(order)).alias("_in"),
            F.min(order).alias("_order"),
        )
    )
    stored = [c for c in existing.columns if c not in keys]
    current = drop_blank_ids(existing, keys).select(*keys, F.struct(*stored).alias("_cur"))
    if batch_only:
        current = current.join(batch.select(*keys), keys, "left_semi")
    joined = current.join(batch, keys, "full_outer")

    # one null-safe struct comparison: a field-by-field OR would be repeated in every output column
    facts = [c for c in fresh if c not in VOLATILE]
    same = _facts("_cur", facts, types).eqNullSafe(_facts("_in", facts, types))
    action = (
        F.when(F.col("_in").isNull(), F.lit("kept"))
        .when(F.col("_cur").isNull(), F.lit("new"))
        .when(same, F.lit("unchanged"))
        .otherwise(F.lit("updated"))
    )
    joined = joined.withColumn("action", action)
    takes = F.col("action").isin("new", "updated")

    def merged(c: str) -> Column:
        if c in keys:
            return F.col(c)
        old = F.col(f"_cur.{c}")
        if c == order:
            return F.coalesce(old, F.col("_order")).alias(c)
        if c not in fresh:
            return old.alias(c)
        new = F.col(f"_in.{c}")
        if c in KEPT_FROM_EXISTING:
            new = F.coalesce(old, new)
        return F.when(takes, new).otherwise(old).alias(c)

    return joined.select(*[merged(c) for c in existing.columns], "action")


def _facts(side: str, columns: list[str], types: dict[str, str]) -> Column:
    """The compared columns as one struct; maps, which have no order, as sorted entry texts."""

    def fact(c: str) -> Column:
        value = F.col(f"{side}.{c}")
        if types[c].startswith("map"):
            value = F.array_sort(F.transform(F.map_entries(value), lambda e: e.cast("string")))
        return value.alias(c)

    return F.struct(*[fact(c) for c in columns])


def action_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def append_rows(base: DataFrame, rows: DataFrame) -> DataFrame:
    return base.unionByName(rows, allowMissingColumns=True)


def insert_missing(base: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Append rows whose key is new (insert … on conflict do nothing); the first of a batch wins.

    Without ``order``, the first in the order of the remaining columns does, so that the result is settled.
    """
    rest = [c for c in rows.columns if c not in keys]
    batch = first_by(rows, keys, order or F.struct(*rest)) if rest else rows.distinct()
    fresh = batch.join(base.select(*keys), keys, "left_anti")
    return base.unionByName(fresh, allowMissingColumns=True)


def patch_rows(base: DataFrame, patch: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Partial update: the supplied columns replace, everything else stays."""
    batch = latest_by(patch, keys, order) if order else patch
    cols = [c for c in batch.columns if c not in keys and c != order]
    batch = batch.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_p_{c}") for c in cols])
    joined = base.join(batch, keys, "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
            for c in base.columns
        ]
    )


def unknown_patch_ids(base: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Patched keys that do not exist; the caller refuses the patch when any come back."""
    return patch.select(*keys).distinct().join(base.select(*keys), keys, "left_anti")


def checked_patch(base: DataFrame, patch: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    if not unknown_patch_ids(base, patch, keys).isEmpty():
        raise KeyError("patch refers to rows that do not exist")
    return patch_rows(base, patch, keys, order)


def delete_keys(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys), keys, "left_anti")


def status_changes(exhibitions: DataFrame, today) -> DataFrame:
    """(id, status) of every row whose status moved."""
    now = compute_status(today, F.col("start_date"), F.col("end_date"))
    rows = drop_blank_ids(exhibitions, ["id"]).select("id", "status", now.alias("_now"))
    return rows.filter(~F.col("status").eqNullSafe(F.col("_now"))).select("id", F.col("_now").alias("status"))


def refresh_status(exhibitions: DataFrame, today) -> DataFrame:
    """The whole table with current statuses: a projection, no join needed.

    Where a merge left an ``action``, a row that was only kept and whose status moved gets the action ``status``.
    """
    now = compute_status(today, F.col("start_date"), F.col("end_date"))
    out = exhibitions
    if "action" in out.columns:
        moved = (F.col("action") == "kept") & ~F.col("status").eqNullSafe(now)
        out = out.withColumn("action", F.when(moved, F.lit("status")).otherwise(F.col("action")))
    return out.withColumn("status", now)
