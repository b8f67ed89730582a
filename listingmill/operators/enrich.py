"""Coordinates from gazetteers, translation backlog and write-back, commentary cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmill.functions.classify import detect_lang, row_lang, target_locales
from listingmill.functions.translations import clear_fields, empty_tr, merge_tr, prune_fields
from listingmill.operators.ranking import position, running_total

# --- fixed values -----------------------------------------------------------
SCOPE = {"exhibitions": ("title", "description"), "venues": ("name",), "artists": ("name",)}
TABLE_RANK = {"exhibitions": 0, "venues": 1, "artists": 2}
BATCH_JOBS = 10
PROGRESS_TASKS = 192  # below the bound of 200 up to which shuffles are written without a sort in memory
# -----------------------------------------------------------------------------


def missing_coordinates(venues: DataFrame) -> DataFrame:
    return venues.filter(F.col("latitude").isNull() | F.col("longitude").isNull())


def geocode(venues: DataFrame, gazetteer: DataFrame, name_with_region: bool) -> DataFrame:
    """Fill missing coordinates from the gazetteer and say how: payload, geocoded or no_match.

    ``gazetteer``: backend, kind (address before place), query, lat, lng; reduced to one row per
    (backend, query) first. The query is the address, else the name (with the region at ingest).
    """
    best = gazetteer.groupBy("backend", "query").agg(
        F.min_by(F.struct("lat", "lng"), F.struct((F.col("kind") != "address").cast("int").alias("k"), "lat", "lng")).alias("hit")
    )
    backend = F.when(F.col("country") == "JP", F.lit("JP")).otherwise(F.lit("KR"))
    name = F.concat_ws(" ", F.nullif("name", F.lit("")), F.nullif("region", F.lit(""))) if name_with_region else F.col("name")
    needs = F.col("latitude").isNull() | F.col("longitude").isNull()
    query = F.nullif(F.trim(F.coalesce(F.nullif("address", F.lit("")), name)), F.lit(""))
    # Rows that have both coordinates ask nothing: their key is NULL and matches nothing.
    asked = venues.withColumns({"_ask": F.when(needs & query.isNotNull(), F.struct(backend.alias("backend"), query.alias("query"))), "needed": needs})
    best = best.select(F.struct("backend", "query").alias("_ask"), "hit")
    found = asked.join(best, "_ask", "left")
    return found.select(
        *[
            F.when(F.col("needed") & F.col("hit").isNotNull(), F.col(f"hit.{s}")).otherwise(F.col(c)).alias(c)
            if (s := {"latitude": "lat", "longitude": "lng"}.get(c))
            else F.col(c)
            for c in venues.columns
        ],
        F.when(~F.col("needed"), F.lit("payload"))
        .when(F.col("hit").isNotNull(), F.lit("geocoded"))
        .otherwise(F.lit("no_match"))
        .alias("geo_action"),
    )


def geocode_report(geocoded: DataFrame) -> DataFrame:
    return geocoded.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("geo_action") != "payload").alias("needed"),
        F.count_if(F.col("geo_action") == "geocoded").alias("geocoded"),
        F.count_if(F.col("geo_action") == "no_match").alias("no_match"),
    )


def translation_jobs(df: DataFrame, table: str) -> DataFrame:
    """(table, id, seq, field, locale, lang, text): one row per missing field × locale."""
    fields = F.array(
        *[F.struct(F.lit(f).alias("field"), F.trim(F.coalesce(F.col(f), F.lit(""))).alias("text")) for f in SCOPE[table]]
    )
    tr = F.coalesce(F.col("tr"), empty_tr())
    rows = (
        df.select("id", "seq", tr.alias("tr"), F.explode(F.filter(fields, lambda x: x["text"] != "")).alias("x"))
        .select("id", "seq", "tr", "x.field", "x.text", detect_lang(F.col("x.text")).alias("lang"))
        .withColumn("locale", F.explode(target_locales(F.col("lang"))))
    )
    known = F.try_element_at(F.try_element_at("tr", F.col("locale")), F.col("field"))
    return rows.filter(F.coalesce(known, F.lit("")) == "").select(
        F.lit(table).alias("table"), "id", "seq", "field", "locale", "lang", "text"
    )


def jobs_per_row(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("table", "id", "seq").agg(F.count(F.lit(1)).alias("jobs"))


def interleave(items: DataFrame, budget: int | None = None) -> DataFrame:
    """Round-robin over tables: first of each, second of each, …; cut by ``budget`` items, a top-k."""
    ordered = turns(items).orderBy("turn", "table_rank")
    return ordered.limit(budget) if budget else ordered


def turns(items: DataFrame) -> DataFrame:
    """The turn of every item within its table, and the table's rank, in no particular order of rows.

    Positions come from the two-level count, so a table with most of the items is not one task.
    """
    rank = F.coalesce(*[F.when(F.col("table") == t, F.lit(r)) for t, r in TABLE_RANK.items()])
    return position(items, ["table"], "seq", "turn").withColumn("table_rank", rank)


def batch_jobs(items: DataFrame, order: str = "slot", per_batch: int = BATCH_JOBS) -> DataFrame:
    """Pack consecutive items into batches of about ``per_batch`` jobs; an item is never split."""
    total = running_total(items, [], order, F.col("jobs"), "cum_jobs")
    return total.withColumn("batch", F.floor((F.col("cum_jobs") - 1) / per_batch).cast("long"))


def prune_translations(df: DataFrame, table: str) -> DataFrame:
    """Rows whose ``tr`` holds fields out of scope or empty buckets, with the pruned map."""
    pruned = prune_fields(F.coalesce(F.col("tr"), empty_tr()), SCOPE[table])
    return df.withColumn("new_tr", pruned).withColumn("changed", tr_size(F.col("new_tr")) != tr_size(F.coalesce(F.col("tr"), empty_tr())))


def tr_size(tr):
    """Buckets plus entries: moves whenever pruning or clearing removed anything."""
    return F.aggregate(F.map_values(tr), F.size(tr), lambda acc, b: acc + F.size(b))


def reset_translations(df: DataFrame, table: str) -> DataFrame:
    """In-scope texts cleared in every row; the language label is recorded anyway."""
    fields = SCOPE[table]
    return df.withColumns(
        {
            "tr": clear_fields(F.coalesce(F.col("tr"), empty_tr()), fields),
            "lang": row_lang([F.col(f) for f in fields]),
        }
    )


def apply_translations(df: DataFrame, results: DataFrame, table: str, order: str | None = None) -> DataFrame:
    """Write results (table, id, field, locale, text, failed) into ``tr``.

    A blank text keeps the original field's text; a failed job changes nothing. Of several results for one
    field and locale the last by ``order`` counts (without it, the largest text). A row has at most fields × locales
    results, so the per-row map is bounded by the scope; texts of the table join nothing.
    """
    done = results.filter((F.col("table") == table) & ~F.col("failed") & F.col("field").isin(*SCOPE[table]))
    text = F.coalesce(F.trim(F.col("text")), F.lit(""))
    buckets = (
        done.groupBy("id", "locale", "field")
        .agg((F.max_by(text, order) if order else F.max(text)).alias("text"))
        .groupBy("id", "locale")
        .agg(F.map_from_entries(F.collect_list(F.struct("field", "text"))).alias("b"))
        .groupBy("id")
        .agg(F.map_from_entries(F.collect_list(F.struct("locale", "b"))).alias("patch"))
    )
    out = df.join(buckets, "id", "left")
    touched = F.col("patch").isNotNull()
    originals = {f: F.trim(F.col(f)) for f in SCOPE[table]}

    def filled(field, value):
        own = F.coalesce(*[F.when(field == f, c) for f, c in originals.items()])
        return F.when(value == "", own).otherwise(value)

    out = out.withColumn("patch", F.transform_values("patch", lambda _, bucket: F.transform_values(bucket, filled)))
    return out.withColumns(
        {
            "tr": F.when(touched, merge_tr(F.col("tr"), F.col("patch"))).otherwise(F.col("tr")),
            "lang": F.when(touched, row_lang([F.col(f) for f in SCOPE[table]])).otherwise(F.col("lang")),
        }
    ).drop("patch")


def translation_progress(jobs: DataFrame, results: DataFrame, seen: DataFrame) -> DataFrame:
    """Per table: rows seen and patched, jobs pending, translated, failed and remaining.

    Jobs and results are dealt together by row into ``PROGRESS_TASKS`` tasks or more and counted there, so that no task
    sorts or keeps more than its share; the size of compressed shuffles says little of these rows, whose texts repeat.
    A job counts once for each of its results, or once without one.
    """
    keys = ["table", "id", "field", "locale"]
    given = results.dropna(subset=keys).select(*keys, F.lit(0).alias("job"), F.lit(1).alias("result"), "failed")
    asked = jobs.select(*keys, F.lit(1).alias("job"), F.lit(0).alias("result"), F.lit(None).cast("boolean").alias("failed"))
    tasks = max(PROGRESS_TASKS, int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    of_job = asked.unionByName(given).repartition(tasks, "table", "id").groupBy(*keys).agg(
        F.sum("job").alias("n"),
        F.greatest(F.sum("result"), F.lit(1)).alias("results"),
        F.count_if(~F.col("failed")).alias("translated"),
        F.count_if("failed").alias("errors"),
    )
    state = of_job.filter("n > 0").groupBy("table", "id").agg(
        F.sum(F.col("n") * F.col("results")).alias("pending"),
        F.sum(F.col("n") * F.col("translated")).alias("translated"),
        F.sum(F.col("n") * F.col("errors")).alias("errors"),
    )
    counts = state.groupBy("table").agg(
        F.sum("pending").alias("fields_pending"),
        F.sum("translated").alias("fields_translated"),
        F.sum("errors").alias("errors"),
        F.count_if(F.col("translated") > 0).alias("rows_patched"),
    )
    rows = seen.groupBy("table").agg(F.count(F.lit(1)).alias("rows_seen"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("fields_pending", "fields_translated", "errors", "rows_patched")}
    return (
        rows.join(counts, "table", "left")
        .withColumns(zero)
        .withColumn("fields_remaining", F.greatest(F.lit(0).cast("long"), F.col("fields_pending") - F.col("fields_translated")))
    )


def cache_hits(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Items (key, facts_hash, …) whose commentary was made from the same facts."""
    return items.join(cache, ["key", "facts_hash"])


def cache_misses(items: DataFrame, cache: DataFrame) -> DataFrame:
    return items.join(cache.select("key", "facts_hash"), ["key", "facts_hash"], "left_anti")


