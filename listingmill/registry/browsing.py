"""Filters, orders, aggregates and set operations over the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmill.functions import geo
from listingmill.functions.translations import tr_text
from listingmill.operators import browse, cinema, collapse, embed, users
from listingmill.operators.enrich import missing_coordinates
from listingmill.operators.notify import reminder_filter
from listingmill.operators.ranking import position
from listingmill.plans.carousel import carousel_mix
from listingmill.plans.search import search
from listingmill.registry.base import query, sql
from listingmill.registry.collections import catalogue_of_masters
from listingmill.sources import testdata as td


def with_venue(spark, d) -> DataFrame:
    return embed.embed_venue(td.exhibitions(spark, d), td.venues(spark, d))


def nested(spark, d) -> DataFrame:
    return embed.embed_artists(with_venue(spark, d), td.artists(spark, d))


def day(c: str):
    return F.col(c).cast("string").alias(c)


# --- filters ----------------------------------------------------------------------


@query(
    "faceted_filter",
    sql("xv", "SELECT id, status, medium, city FROM xv WHERE status IN ('ongoing', 'upcoming') AND medium = 'photo' AND exhibition_type IN ('solo', 'group') AND fee_type = 'free' AND city IN ('서울', '도쿄', '부산')"),
)
def faceted_filter(spark, d):
    facets = browse.Facets(("ongoing", "upcoming"), ("photo",), ("solo", "group"), True, ("서울", "도쿄", "부산"))
    rows = browse.faceted_filter(with_venue(spark, d), facets)
    return rows.select("id", "status", "medium", geo.region_bucket(F.col("venue.region"))["city"].alias("city"))


@query(
    "text_search",
    sql("xn", "SELECT id, title FROM xn WHERE contains(lower(concat_ws(' ', title, coalesce(venue_name, ''), array_to_string(artist_names, ' '), array_to_string(genre_tags, ' '))), 'ring 12')"),
)
def text_search(spark, d):
    return browse.text_search(nested(spark, d), " Ring 12 ").select("id", "title")


@query(
    "photo_relevance",
    sql("x", "SELECT id, source, medium FROM x WHERE source <> 'artmap' OR medium IN ('photo', 'video', 'gear')"),
)
def photo_relevance(spark, d):
    return collapse.photo_relevance(td.exhibitions(spark, d)).select("id", "source", "medium")


@query("viewport_filter", sql("xv", "SELECT id, lng, lat FROM xv WHERE lng BETWEEN 127 AND 133.5 AND lat BETWEEN 33.5 AND 36"))
def viewport_filter(spark, d):
    return browse.viewport_filter(with_venue(spark, d), 127, 33.5, 133.5, 36).select("id", "venue.lng", "venue.lat")


@query("mappable_filter", sql("xv", "SELECT id, city FROM xv WHERE lat IS NOT NULL AND lng IS NOT NULL"))
def mappable_filter(spark, d):
    return browse.mappable(with_venue(spark, d)).select("id", "city")


@query("venue_status_filter", sql("x", "SELECT id, venue_id, status FROM x WHERE status IN ('ongoing', 'upcoming')"))
def venue_status_filter(spark, d):
    return browse.status_filter(td.exhibitions(spark, d), ("ongoing", "upcoming")).select("id", "venue_id", "status")


@query(
    "venue_exhibitions",
    sql("xv", "SELECT venue_id, venue_name, id, title FROM xv WHERE venue_id IN (SELECT 'v' || s_suppkey FROM supplier WHERE s_acctbal > 5000)"),
)
def venue_exhibitions(spark, d):
    chosen = td.table(spark, d, "supplier").filter("s_acctbal > 5000").selectExpr("concat('v', s_suppkey) AS id")
    rows = browse.venue_exhibitions(with_venue(spark, d), chosen)
    return rows.select("venue_id", F.col("venue.name").alias("venue_name"), "id", "title")


@query("lookup_by_id", sql("x", "SELECT id, title FROM x WHERE id IN (SELECT 'x' || user_id FROM events)"))
def lookup_by_id(spark, d):
    wanted = td.table(spark, d, "events").selectExpr("concat('x', user_id) AS id")
    return browse.lookup_by_id(td.exhibitions(spark, d), wanted).select("id", "title")


def entries(spark, d) -> DataFrame:
    return cinema.cinema_entries(*td.scenes(spark, d))


@query("cinema_filter", sql("scene", "SELECT id, kind, CAST(year AS BIGINT) AS year FROM scene WHERE kind = 'modern' AND year // 10 * 10 IN (1960, 1990, 2010)"))
def cinema_filter(spark, d):
    rows = cinema.cinema_filter(entries(spark, d), ("modern",), (1960, 1990, 2010))
    return rows.select("id", "kind", F.col("year").cast("long").alias("year"))


@query(
    "cinema_search",
    sql("scene", "SELECT id, en FROM scene WHERE contains(lower(concat_ws(' ', ko, en, ja, credit_ko, credit_en, coalesce(studio, ''))), 'brand#1')"),
)
def cinema_search(spark, d):
    return cinema.cinema_search(entries(spark, d), "BRAND#1").select("id", F.try_element_at("title", F.lit("en")).alias("en"))


@query(
    "closing_reminder_filter",
    sql("x", "SELECT id, date_diff('day', DATE '1998-07-01', end_date) AS dday FROM x WHERE status = 'ongoing' AND date_diff('day', DATE '1998-07-01', end_date) IN (3, 1)"),
)
def closing_reminder_filter(spark, d):
    return reminder_filter(td.exhibitions(spark, d), td.TODAY).select("id", F.col("dday").cast("long").alias("dday"))


@query("missing_coordinate_filter", sql("v", "SELECT id FROM v WHERE lat IS NULL OR lng IS NULL"))
def missing_coordinate_filter(spark, d):
    return missing_coordinates(td.venues(spark, d)).select("id")


# --- aggregates -------------------------------------------------------------------


@query(
    "status_counts",
    sql(
        "x",
        """SELECT count(*) FILTER (status = 'ongoing') AS ongoing, count(*) FILTER (status = 'ongoing' AND end_date BETWEEN DATE '1998-07-01' AND DATE '1998-07-08') AS closing,
        count(*) FILTER (status = 'upcoming') AS upcoming FROM x""",
    ),
)
def status_counts(spark, d):
    return browse.status_counts(td.exhibitions(spark, d), td.TODAY)


@query(
    "venue_summary",
    sql("x", "SELECT venue_id, count(*) AS total, count(*) FILTER (status = 'ongoing') AS ongoing, count(*) FILTER (status = 'upcoming') AS upcoming FROM x GROUP BY venue_id"),
)
def venue_summary(spark, d):
    return browse.venue_summary(td.exhibitions(spark, d))


_MARKERS = """m AS (SELECT v_id AS marker, count(*) AS n, any_value(lng) AS lng, any_value(lat) AS lat, any_value(venue_name) AS venue_name, arg_min(id, seq) AS first_id,
  coalesce(arg_min(poster_image_url, seq) FILTER (poster_image_url IS NOT NULL), '') AS poster FROM xv WHERE lat IS NOT NULL AND lng IS NOT NULL GROUP BY v_id)"""


def _markers_sql(body: str) -> str:
    return sql("xv", "SELECT 1").replace("\nSELECT 1", f",\n{_MARKERS}\n{body}")


@query("venue_markers", _markers_sql("SELECT * FROM m"))
def venue_markers(spark, d):
    return browse.venue_markers(with_venue(spark, d))


@query(
    "marker_grid_clusters",
    _markers_sql(
        """SELECT CAST(floor((lng + 180.0) / 360.0 * 512 * 64 / 48) AS BIGINT) AS cell_x,
        CAST(floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 512 * 64 / 48) AS BIGINT) AS cell_y,
        count(*) AS venues, CAST(sum(n) AS BIGINT) AS n, round(avg(lng), 6) AS lng, round(avg(lat), 6) AS lat FROM m GROUP BY 1, 2"""
    ),
)
def marker_grid_clusters(spark, d):
    out = browse.marker_grid_clusters(browse.venue_markers(with_venue(spark, d)), 6)
    return out.withColumns({"lng": F.round("lng", 6), "lat": F.round("lat", 6)})


@query("map_extent", _markers_sql("SELECT min(lng) AS west, min(lat) AS south, max(lng) AS east, max(lat) AS north FROM m"))
def map_extent(spark, d):
    return browse.map_extent(browse.venue_markers(with_venue(spark, d)))


@query(
    "group_by_region",
    sql(
        "xv",
        """SELECT region, id, row_number() OVER (PARTITION BY region ORDER BY seq) AS position, count(*) OVER (PARTITION BY region) AS n
        FROM xv WHERE region IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL""",
    ),
)
def group_by_region(spark, d):
    """Each region's listings in order. Positions are counted in ranges, so a huge region is no single task."""
    rows = browse.group_by_region(with_venue(spark, d)).select("region", "id", "seq")
    counts = browse.region_counts(with_venue(spark, d)).select("region", "n")
    return position(rows, ["region"], "seq").join(counts, "region").select("region", "id", "position", "n")


@query(
    "city_facets",
    sql("v", "SELECT DISTINCT CASE WHEN region IN ('서울', '부산', '경기', '인천', '강원') THEN '한국' ELSE '일본' END AS country, city FROM v WHERE city IS NOT NULL"),
)
def city_facets(spark, d):
    return browse.city_facets(td.venues(spark, d)).select("country", "city")


@query("present_decades", sql("scene", "SELECT DISTINCT CAST(year // 10 * 10 AS BIGINT) AS decade FROM scene WHERE year > 0"))
def present_decades(spark, d):
    return cinema.present_decades(entries(spark, d)).select(F.col("decade").cast("long").alias("decade"))


@query("distinct_regions", sql("v", "SELECT DISTINCT region FROM v WHERE region IS NOT NULL"))
def distinct_regions(spark, d):
    return browse.distinct_regions(td.venues(spark, d))


# --- orders and top-k -------------------------------------------------------------

_RANK = "CASE status WHEN 'ongoing' THEN 0 WHEN 'upcoming' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END"


@query(
    "sort_recommended",
    sql("x", f"SELECT id, featured, popularity_score, CAST({_RANK} AS BIGINT) AS status_rank, strftime(start_date, '%Y-%m-%d') AS start_date FROM x ORDER BY featured DESC, popularity_score DESC NULLS LAST, {_RANK}, start_date DESC NULLS LAST, seq"),
)
def sort_recommended(spark, d):
    rows = browse.sort_exhibitions(td.exhibitions(spark, d), "recommended")
    return rows.select("id", "featured", "popularity_score", browse.status_rank(F.col("status")).cast("long").alias("status_rank"), day("start_date"))


@query("sort_closing", sql("x", "SELECT id, status, strftime(end_date, '%Y-%m-%d') AS end_date FROM x ORDER BY status <> 'ongoing', end_date NULLS LAST, seq"))
def sort_closing(spark, d):
    return browse.sort_exhibitions(td.exhibitions(spark, d), "closing").select("id", "status", day("end_date"))


@query("sort_recent", sql("x", "SELECT id, strftime(start_date, '%Y-%m-%d') AS start_date FROM x ORDER BY start_date DESC NULLS LAST, seq"))
def sort_recent(spark, d):
    return browse.sort_exhibitions(td.exhibitions(spark, d), "recent").select("id", day("start_date"))


@query(
    "sort_nearby",
    sql(
        "xv",
        """SELECT id, round(2 * 6371 * asin(sqrt(power(sin(radians(lat - 37.57) / 2), 2) + cos(radians(37.57)) * cos(radians(lat)) * power(sin(radians(lng - 126.98) / 2), 2))), 6) AS distance_km
        FROM xv ORDER BY distance_km NULLS LAST, seq""",
    ),
)
def sort_nearby(spark, d):
    rows = browse.sort_exhibitions(with_venue(spark, d), "nearby", (126.98, 37.57))
    return rows.select("id", F.round("distance_km", 6).alias("distance_km"))


@query(
    "closing_soon_topk",
    sql("x", "SELECT id, strftime(end_date, '%Y-%m-%d') AS end_date FROM x WHERE status = 'ongoing' AND end_date BETWEEN DATE '1998-07-01' AND DATE '1998-07-08' ORDER BY x.end_date, seq LIMIT 4"),
)
def closing_soon_topk(spark, d):
    return browse.closing_soon(td.exhibitions(spark, d), td.TODAY).select("id", day("end_date"))


@query("featured_pick", sql("x", "SELECT id, title, featured FROM x ORDER BY featured DESC, seq LIMIT 1"))
def featured_pick(spark, d):
    return browse.featured_pick(td.exhibitions(spark, d)).select("id", "title", "featured")


@query(
    "sort_cinema",
    sql("scene", "SELECT id, CAST(year AS BIGINT) AS year, en, ja FROM scene ORDER BY year DESC, en"),
)
def sort_cinema(spark, d):
    def pick(df):
        return df.select(
            "id", F.col("year").cast("long").alias("year"), F.try_element_at("title", F.lit("en")).alias("en"),
            F.try_element_at("title", F.lit("ja")).alias("ja"),
        )

    return pick(cinema.sort_cinema(entries(spark, d), "newest"))


@query(
    "swipe_deck_list",
    sql("x", "SELECT id, status FROM x WHERE status <> 'past' AND medium IN ('photo', 'video')"),
)
def swipe_deck_list(spark, d):
    rows = search(td.exhibitions(spark, d), browse.Facets(mediums=("photo", "video")), order="closing")
    return browse.swipe_deck(rows, seed=7).select("id", "status")


@query(
    "faceted_search",
    sql(
        "xn",
        """SELECT id, title, strftime(end_date, '%Y-%m-%d') AS end_date FROM xn WHERE status IN ('ongoing', 'upcoming') AND medium = 'photo'
        AND contains(lower(concat_ws(' ', title, coalesce(venue_name, ''), array_to_string(artist_names, ' '), array_to_string(genre_tags, ' '))), 'widget') ORDER BY status <> 'ongoing', xn.end_date NULLS LAST, seq""",
    ),
)
def faceted_search(spark, d):
    facets = browse.Facets(statuses=("ongoing", "upcoming"), mediums=("photo",))
    return search(nested(spark, d), facets, "widget", "closing").select("id", "title", day("end_date"))


# --- set operations ---------------------------------------------------------------


@query("cinema_entries", sql("scene", "SELECT id, kind, CAST(year AS BIGINT) AS year FROM scene"))
def cinema_entries(spark, d):
    return entries(spark, d).select("id", "kind", F.col("year").cast("long").alias("year"))


@query(
    "carousel_mix",
    sql(
        "x sel scene",
        """SELECT 'exhibition' AS kind, id, title AS label, poster_image_url AS image, CAST(NULL AS VARCHAR) AS face FROM x
        UNION ALL SELECT * FROM (SELECT 'master', seed.id, 'Master ' || seed.id, arg_min(image_url, rank), coalesce(seed.portrait_url, arg_min({'t': thumb_url}, rank).t)
          FROM sel JOIN seed ON seed.id = sel.master_id GROUP BY seed.id, seed.portrait_url ORDER BY md5('11:' || seed.id) LIMIT 6)
        UNION ALL SELECT * FROM (SELECT 'cinema', id, en, image, CAST(NULL AS VARCHAR) FROM scene WHERE image IS NOT NULL ORDER BY md5('11:' || id) LIMIT 4)""",
    ),
)
def carousel(spark, d):
    modern, pd = td.scenes(spark, d)
    return carousel_mix(td.exhibitions(spark, d), catalogue_of_masters(spark, d), modern.unionByName(pd), seed=11)


def accounts(spark, d) -> DataFrame:
    users_seen = td.table(spark, d, "events").selectExpr("concat('u', user_id) AS id", "concat('e', user_id, '@x.org') AS email")
    return users_seen.unionByName(td.table(spark, d, "supplier").selectExpr("concat('s', s_suppkey) AS id", "concat('s', s_suppkey, '@x.org') AS email"))


@query(
    "backfill_profiles",
    sql(
        "prof",
        """SELECT id, email, locale FROM prof UNION ALL SELECT DISTINCT 's' || s_suppkey, 's' || s_suppkey || '@x.org', CAST(NULL AS VARCHAR) FROM supplier
        UNION ALL SELECT DISTINCT 'u' || user_id, 'e' || user_id || '@x.org', NULL FROM events WHERE 'u' || user_id NOT IN (SELECT id FROM prof)""",
    ),
)
def backfill_profiles(spark, d):
    return users.backfill_profiles(td.profiles(spark, d), accounts(spark, d)).select("id", "email", "locale")


@query(
    "add_bookmarks",
    sql("marks", "SELECT * FROM marks UNION SELECT 'u' || o_custkey, 'x' || o_orderkey FROM orders"),
)
def add_bookmarks(spark, d):
    added = td.table(spark, d, "orders").selectExpr(
        "concat('u', o_custkey) AS user_id", "concat('x', o_orderkey) AS exhibition_id", "CAST(o_orderdate AS TIMESTAMP) AS created_at"
    )
    return users.add_bookmarks(td.bookmarks(spark, d), added).select("user_id", "exhibition_id")


@query(
    "remove_bookmarks",
    sql("marks", "SELECT * FROM marks EXCEPT SELECT 'u' || user_id, 'x' || event_id FROM events WHERE event_type = 'view'"),
)
def remove_bookmarks(spark, d):
    gone = td.table(spark, d, "events").filter("event_type = 'view'").selectExpr("concat('u', user_id) AS user_id", "concat('x', event_id) AS exhibition_id")
    return users.remove_bookmarks(td.bookmarks(spark, d), gone).select("user_id", "exhibition_id")


# --- joins ------------------------------------------------------------------------


@query("embed_venue", sql("xv", "SELECT id, v_id AS venue, venue_name, region, lat, lng, tr_ko_name FROM xv"))
def embed_venue(spark, d):
    return with_venue(spark, d).select(
        "id", F.col("venue.id").alias("venue"), F.col("venue.name").alias("venue_name"), "venue.region", "venue.lat", "venue.lng",
        tr_text(F.col("venue.tr"), "ko", "name").alias("tr_ko_name"),
    )


@query(
    "embed_artists",
    sql("xn", "SELECT id, CAST(coalesce(len(artist_names), 0) AS BIGINT) AS n, coalesce(array_to_string(artist_names, '|'), '') AS names FROM xn"),
)
def embed_artists(spark, d):
    rows = embed.embed_artists(td.exhibitions(spark, d), td.artists(spark, d))
    return rows.select("id", F.size("artists").cast("long").alias("n"), F.array_join(F.transform("artists", lambda a: a["name"]), "|").alias("names"))


@query(
    "prune_orphans",
    sql("x v xa a", "SELECT 'venue' AS kind, id FROM v WHERE id IN (SELECT venue_id FROM x) UNION ALL SELECT 'artist', id FROM a WHERE id IN (SELECT artist_id FROM xa)"),
)
def prune_orphans(spark, d):
    rows = td.exhibitions(spark, d)
    kept = embed.prune_venues(td.venues(spark, d), rows).select(F.lit("venue").alias("kind"), "id")
    return kept.unionByName(embed.prune_artists(td.artists(spark, d), rows).select(F.lit("artist").alias("kind"), "id"))


@query(
    "bookmarked_exhibitions",
    sql("x marks", "SELECT user_id, id, status, strftime(end_date, '%Y-%m-%d') AS end_date FROM marks JOIN x ON exhibition_id = id WHERE status IN ('ongoing', 'upcoming')"),
)
def bookmarked_exhibitions(spark, d):
    saved = browse.bookmarked(browse.status_filter(td.exhibitions(spark, d), ("ongoing", "upcoming")), td.bookmarks(spark, d))
    return browse.sort_exhibitions(saved, "closing").select("user_id", "id", "status", day("end_date"))


@query(
    "project_catalog",
    sql(
        "x",
        """SELECT id, seq, CASE WHEN st = 'P' THEN 'Again ' || seq ELSE title END AS title, CASE WHEN st = 'P' THEN 'unknown' ELSE status END AS status,
        CASE WHEN st = 'P' THEN false ELSE featured END AS featured, CAST(CASE WHEN st = 'P' THEN 0 ELSE len(genre_tags) END AS BIGINT) AS n_genres FROM (SELECT x.*, o_orderstatus AS st FROM x JOIN orders ON seq = o_orderkey)""",
    ),
)
def project_catalog(spark, d):
    """A snapshot where every 'P' order is listed again later with missing values."""
    base = td.exhibitions(spark, d).select("id", "seq", "title", "status", "featured", "genre_tags", "tr")
    again = td.exhibitions(spark, d).filter("medium = 'mixed'").select(
        "id", (F.col("seq") + 10**15).alias("seq"), F.concat(F.lit("Again "), "seq").alias("title"),
        F.lit(None).cast("string").alias("status"), F.lit(None).cast("boolean").alias("featured"),
        F.lit(None).cast("array<string>").alias("genre_tags"), F.lit(None).cast("map<string,map<string,string>>").alias("tr"),
    )
    out = embed.project_catalog(base.unionByName(again))
    return out.select("id", "seq", "title", "status", "featured", F.size("genre_tags").cast("long").alias("n_genres"))


@query(
    "flat_projection",
    sql("xn", "SELECT id, venue_name, region, coalesce(array_to_string(artist_names, '|'), '') AS artists, tr_ja_title, tr_ko_name FROM xn"),
)
def flat_projection(spark, d):
    rows = embed.flat_for_alerts(nested(spark, d))
    return rows.select(
        "id", "venue_name", "region", F.array_join("artist_names", "|").alias("artists"),
        tr_text(F.col("tr"), "ja", "title").alias("tr_ja_title"), tr_text(F.col("venue_tr"), "ko", "name").alias("tr_ko_name"),
    )
