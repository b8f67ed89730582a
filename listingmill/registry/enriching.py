"""Coordinates and translations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmill.functions.translations import tr_text
from listingmill.operators import enrich
from listingmill.registry.base import query, sql
from listingmill.session import materialize, shared_dir
from listingmill.sources import testdata as td

_GEO = """g AS (SELECT v.*, s.s_acctbal > 2000 AS has_address, CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN 'payload' WHEN address IS NOT NULL AND s.s_acctbal > 2000 THEN 'geocoded'
  WHEN address IS NULL THEN 'geocoded' ELSE 'no_match' END AS geo_action, s.s_suppkey AS k FROM v JOIN supplier s ON v.seq = s.s_suppkey)"""


def _geo_sql(body: str) -> str:
    return sql("v", "SELECT 1").replace("\nSELECT 1", f",\n{_GEO}\n{body}")


def geocoded(spark, d) -> DataFrame:
    return enrich.geocode(td.venues(spark, d), td.gazetteer(spark, d), name_with_region=False)


@query(
    "geocode_lookup",
    _geo_sql(
        """SELECT id, geo_action, round(CASE geo_action WHEN 'geocoded' THEN CASE WHEN address IS NOT NULL THEN 30 ELSE 31 END + CAST(k AS DOUBLE) / 1000 ELSE lat END, 6) AS latitude,
        round(CASE geo_action WHEN 'geocoded' THEN CASE WHEN address IS NOT NULL THEN 120 ELSE 121 END + CAST(k AS DOUBLE) / 1000 ELSE lng END, 6) AS longitude FROM g"""
    ),
)
def geocode_lookup(spark, d):
    return geocoded(spark, d).select("id", "geo_action", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query(
    "geocode_report",
    _geo_sql("SELECT count(*) AS total, count(*) FILTER (geo_action <> 'payload') AS needed, count(*) FILTER (geo_action = 'geocoded') AS geocoded, count(*) FILTER (geo_action = 'no_match') AS no_match FROM g"),
)
def geocode_report(spark, d):
    return enrich.geocode_report(geocoded(spark, d))


def jobs(spark, d) -> DataFrame:
    return (
        enrich.translation_jobs(td.exhibitions(spark, d), "exhibitions")
        .unionByName(enrich.translation_jobs(td.venues(spark, d), "venues"))
        .unionByName(enrich.translation_jobs(td.artists(spark, d), "artists"))
    )


_JOBS = """loc AS (SELECT unnest(['ko', 'en', 'ja']) AS locale),
f AS (SELECT 'exhibitions' AS tbl, id, seq, 'title' AS field, lang, tr_en_title AS en, tr_ja_title AS ja, CAST(NULL AS VARCHAR) AS ko FROM x
  UNION ALL SELECT 'exhibitions', id, seq, 'description', 'en', tr_en_description, NULL, NULL FROM x
  UNION ALL SELECT 'venues', id, seq, 'name', 'en', NULL, NULL, tr_ko_name FROM v
  UNION ALL SELECT 'artists', id, seq, 'name', 'en', NULL, NULL, NULL FROM a),
j AS (SELECT tbl, id, seq, field, locale, lang FROM f CROSS JOIN loc WHERE locale <> lang AND CASE locale WHEN 'en' THEN en WHEN 'ja' THEN ja ELSE ko END IS NULL),
items AS (SELECT tbl, id, seq, count(*) AS jobs FROM j GROUP BY tbl, id, seq),
turns AS (SELECT *, row_number() OVER (PARTITION BY tbl ORDER BY seq) AS turn, CASE tbl WHEN 'exhibitions' THEN 0 WHEN 'venues' THEN 1 ELSE 2 END AS rank FROM items)"""


def _jobs_sql(body: str) -> str:
    return sql("x v a", "SELECT 1").replace("\nSELECT 1", f",\n{_JOBS}\n{body}")


@query("translation_backlog", _jobs_sql("SELECT tbl, id, field, locale, lang FROM j"))
def translation_backlog(spark, d):
    return jobs(spark, d).select(F.col("table").alias("tbl"), "id", "field", "locale", "lang")


@query("interleave_tables", _jobs_sql("SELECT tbl, id, turn, CAST(rank AS BIGINT) AS rank, jobs FROM turns"))
def interleave_tables(spark, d):
    rows = enrich.interleave(enrich.jobs_per_row(jobs(spark, d)))
    return rows.select(F.col("table").alias("tbl"), "id", "turn", F.col("table_rank").cast("long").alias("rank"), "jobs")


@query(
    "batch_jobs",
    _jobs_sql(
        """SELECT tbl, id, jobs, CAST(sum(jobs) OVER (ORDER BY turns.turn * 3 + rank) AS BIGINT) AS cum_jobs, CAST((sum(jobs) OVER (ORDER BY turns.turn * 3 + rank) - 1) // 10 AS BIGINT) AS batch FROM turns"""
    ),
)
def batch_jobs(spark, d):
    """Every item in round-robin order, packed by running job count."""
    items = materialize(enrich.jobs_per_row(jobs(spark, d)), shared_dir(spark, "items"))
    numbered = materialize(enrich.turns(items), shared_dir(spark, "turns"))
    slotted = numbered.withColumn("slot", F.col("turn") * 3 + F.col("table_rank"))
    return enrich.batch_jobs(slotted).select(F.col("table").alias("tbl"), "id", "jobs", "cum_jobs", "batch")


def stale_tr(spark, d) -> DataFrame:
    """Exhibitions whose map also carries an old field and an empty bucket."""
    extra = F.expr(
        """map_filter(map('ko', IF(seq % 3 = 0, map('venue', 'old'), map()), 'en', IF(seq % 2 = 0, map('title', concat('E', seq), 'note', 'n'), map('title', concat('E', seq)))), (k, v) -> seq % 5 > 0)"""
    )
    return td.exhibitions(spark, d).withColumn("tr", extra)


@query(
    "prune_translations",
    sql("x", "SELECT id, CASE WHEN seq % 5 > 0 THEN 'E' || seq END AS en_title, CAST(CASE WHEN seq % 5 > 0 THEN 1 ELSE 0 END AS BIGINT) AS buckets, seq % 5 > 0 AS changed FROM x"),
)
def prune_translations(spark, d):
    rows = enrich.prune_translations(stale_tr(spark, d), "exhibitions")
    return rows.select("id", tr_text(F.col("new_tr"), "en", "title").alias("en_title"), F.size("new_tr").cast("long").alias("buckets"), "changed")


@query(
    "reset_translations",
    sql("x", "SELECT id, lang, CAST(CASE WHEN seq % 5 = 0 THEN 0 ELSE CAST(seq % 3 = 0 AS INT) + CAST(seq % 2 = 0 AS INT) END AS BIGINT) AS buckets FROM x"),
)
def reset_translations(spark, d):
    rows = enrich.reset_translations(stale_tr(spark, d).drop("lang"), "exhibitions")
    return rows.select("id", "lang", F.size("tr").cast("long").alias("buckets"))


def results(spark, d) -> DataFrame:
    """Finished jobs: some failed, some blank, the rest upper-cased with the locale."""
    return jobs(spark, d).selectExpr(
        "table", "id", "field", "locale",
        "CASE WHEN seq % 7 = 1 THEN ' ' ELSE concat(upper(locale), ' ', field, ' ', seq) END AS text", "seq % 7 = 0 AS failed",
    )


@query(
    "apply_translations",
    sql(
        "x",
        """SELECT id, coalesce(tr_en_title, CASE WHEN lang = 'en' OR seq % 7 = 0 THEN NULL WHEN seq % 7 = 1 THEN title ELSE 'EN title ' || seq END) AS en_title,
        CASE WHEN seq % 7 = 0 THEN NULL WHEN seq % 7 = 1 THEN title ELSE 'KO title ' || seq END AS ko_title,
        CASE WHEN seq % 7 = 0 THEN NULL WHEN seq % 7 = 1 THEN trim(description) ELSE 'JA description ' || seq END AS ja_description FROM x""",
    ),
)
def apply_translations(spark, d):
    rows = enrich.apply_translations(td.exhibitions(spark, d), results(spark, d), "exhibitions")
    return rows.select(
        "id", tr_text(F.col("tr"), "en", "title").alias("en_title"), tr_text(F.col("tr"), "ko", "title").alias("ko_title"),
        tr_text(F.col("tr"), "ja", "description").alias("ja_description"),
    )


@query(
    "translation_progress",
    _jobs_sql(
        """SELECT tbl, (SELECT count(DISTINCT f.id) FROM f WHERE f.tbl = j.tbl) AS rows_seen, count(DISTINCT id) FILTER (seq % 7 <> 0) AS rows_patched, count(*) AS fields_pending, count(*) FILTER (seq % 7 <> 0) AS fields_translated,
        count(*) FILTER (seq % 7 = 0) AS errors, count(*) FILTER (seq % 7 = 0) AS fields_remaining FROM j GROUP BY tbl"""
    ),
)
def translation_progress(spark, d):
    seen = [f(spark, d).select(F.lit(n).alias("table")) for n, f in (("exhibitions", td.exhibitions), ("venues", td.venues), ("artists", td.artists))]
    out = enrich.translation_progress(jobs(spark, d), results(spark, d), seen[0].unionByName(seen[1]).unionByName(seen[2]))
    return out.withColumnRenamed("table", "tbl")
