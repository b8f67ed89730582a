"""Catalogue-shaped views over the star-schema test tables.

Everything is arithmetic on the keys of whole tables, so an oracle can repeat it. The natural
ratios of the tables are used as foreign keys (15 customers per supplier, fewer customers than
parts), so every derived table grows with its base table.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TODAY = datetime.date(1998, 7, 1)
STAMP = "1998-07-01 00:00:00"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table whose rows are costly to process (whole documents or pages)."""
    return dealt(table(spark, d, name))


def dealt(df: DataFrame) -> DataFrame:
    """The rows in as many tasks as the session's shuffles have: the test tables are single files with one split."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


_SOURCE = """CASE o_orderpriority WHEN '1-URGENT' THEN 'artmap' WHEN '2-HIGH' THEN 'tokyo_art_beat'
 WHEN '3-MEDIUM' THEN 'goeun' WHEN '4-NOT SPECIFIED' THEN 'pgi' ELSE 'zen_foto' END"""
_REGION = """CASE {k} % 9 WHEN 0 THEN '서울' WHEN 1 THEN '부산' WHEN 2 THEN '경기' WHEN 3 THEN '인천' WHEN 4 THEN '강원'
 WHEN 5 THEN '東京' WHEN 6 THEN '大阪府' WHEN 7 THEN '京都' ELSE '新宿、四ツ谷' END"""


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr(
        "o_orderkey AS seq", "o_custkey AS cust", "o_orderstatus AS st", "o_totalprice AS price",
        f"{_SOURCE} AS source",
        "date_add(DATE'1998-01-01', CAST(datediff(CAST(o_orderdate AS DATE), DATE'1995-01-01') % 240 AS INT)) AS day",
    )


def exhibitions(spark: SparkSession, d: str) -> DataFrame:
    """Canonical exhibitions out of ``orders``; status as of TODAY."""
    base = _orders(spark, d).selectExpr(
        "*",
        "concat('Show ', seq % 997) AS core",
        "source IN ('artmap', 'tokyo_art_beat') AS agg",
        "IF(seq % 41 = 0, NULL, day) AS start_date",
        "IF(seq % 41 = 0 OR seq % 11 = 0, NULL, date_add(day, CAST(30 * (seq % 2 + 1) AS INT))) AS end_date",
    )
    titled = base.selectExpr("*", "IF(agg AND seq % 2 = 0, concat('写真展「', core, '」'), core) AS title")
    rows = titled.selectExpr(
        "concat('x', seq) AS id",
        "source",
        """CASE WHEN start_date IS NULL THEN 'unknown' WHEN DATE'1998-07-01' < start_date THEN 'upcoming'
           WHEN DATE'1998-07-01' > end_date THEN 'past' ELSE 'ongoing' END AS status""",
        "concat('https://', IF(seq % 3 = 0, 'www.', ''), source, '.example.org/e/', seq) AS source_url",
        "title",
        "CAST(NULL AS STRING) AS title_en",
        "concat('Notes on <', core, '> mail: a', seq, '@example.org', repeat(' lorem', CAST(seq % 5 AS INT))) AS description",
        "IF(seq % 5 = 0, NULL, concat('https://img.example.org/p', seq % 499, '.jpg')) AS poster_image_url",
        "CASE st WHEN 'F' THEN 'photo' WHEN 'O' THEN 'video' ELSE 'mixed' END AS medium",
        "CASE seq % 4 WHEN 0 THEN 'solo' WHEN 1 THEN 'group' WHEN 2 THEN 'curated' END AS exhibition_type",
        "slice(array(concat('g', seq % 97), concat('h', seq % 13)), 1, CAST(seq % 3 AS INT)) AS genre_tags",
        "CASE seq % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'paid' ELSE 'partial' END AS fee_type",
        "CAST(CASE WHEN seq % 3 <> 1 THEN 0 WHEN seq % 10 <> 0 THEN (seq % 9) * 1000 END AS INT) AS price_min",
        "CAST(IF(seq % 3 = 0, 0, (seq % 9) * 1000 + 5000) AS INT) AS price_max",
        "CAST(array() AS ARRAY<STRING>) AS activities",
        "start_date",
        "end_date",
        "CAST(NULL AS STRING) AS open_hours",
        "transform(slice(array(0, 7, 14), 1, CAST(seq % 4 AS INT)), k -> concat('a', cust + k)) AS artist_ids",
        "concat('v', CAST(cust DIV 15 AS STRING)) AS venue_id",
        "concat('v', CAST(cust DIV 15 AS STRING)) AS organizer_id",
        "IF(seq % 7 = 0, NULL, price) AS popularity_score",
        "seq % 50 = 0 AS featured",
        "TIMESTAMP'1998-01-01 00:00:00' AS crawled_at",
        "TIMESTAMP'1998-01-01 00:00:00' AS updated_at",
        "CAST(array() AS ARRAY<STRING>) AS _warnings",
        "CAST(array() AS ARRAY<STRUCT<label: STRING, amount: INT>>) AS price_breakdown",
        "CAST(NULL AS STRING) AS price_notes",
        "IF(agg AND seq % 2 = 0, 'ja', 'en') AS lang",
        """map_filter(map(
             'en', map_filter(map('title', CASE WHEN seq % 12 = 1 THEN title WHEN seq % 4 = 1 THEN concat('EN ', title) END,
                                  'description', IF(seq % 8 = 3, concat('EN notes ', core), NULL)), (k, v) -> v IS NOT NULL),
             'ja', map_filter(map('title', IF(seq % 4 = 2, concat('JA ', title), NULL)), (k, v) -> v IS NOT NULL)),
           (k, v) -> size(v) > 0) AS tr""",
        "seq",
    )
    return rows


def venues(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").selectExpr(
        "concat('v', s_suppkey) AS id",
        "s_name AS name",
        "CAST(NULL AS STRING) AS name_en",
        "CASE s_suppkey % 3 WHEN 0 THEN 'museum' WHEN 1 THEN 'gallery' ELSE 'other' END AS venue_type",
        f"IF(s_suppkey % 17 = 0, NULL, {_REGION.format(k='s_nationkey')}) AS region",
        "CAST(NULL AS STRING) AS district",
        "IF(s_suppkey % 4 = 0, NULL, concat('addr ', s_suppkey)) AS address",
        "IF(s_suppkey % 10 = 0, NULL, 33 + (s_suppkey * 7 % 500) / 100D) AS latitude",
        "IF(s_suppkey % 20 = 0, NULL, 126 + (s_suppkey * 13 % 1500) / 100D) AS longitude",
        "CAST(NULL AS STRING) AS website",
        "CAST(NULL AS STRING) AS open_hours_default",
        "array('artmap') AS sources",
        "TIMESTAMP'1998-01-01 00:00:00' AS first_seen_at",
        "TIMESTAMP'1998-01-01 00:00:00' AS updated_at",
        "IF(s_nationkey % 9 < 5, 'KR', 'JP') AS country",
        "'en' AS lang",
        "map_filter(map('ko', map_filter(map('name', IF(s_suppkey % 3 = 1, concat('공간 ', s_suppkey), NULL)), (k, v) -> v IS NOT NULL)), (k, v) -> size(v) > 0) AS tr",
        "s_suppkey AS seq",
    )


def artists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(
        "concat('a', p_partkey) AS id",
        "concat(p_name, ' ', p_partkey) AS name",
        "CAST(NULL AS STRING) AS name_en",
        "concat(p_name, ' ', p_partkey) AS name_normalized",
        "CAST(NULL AS STRING) AS bio",
        "CAST(NULL AS STRING) AS instagram",
        "CAST(NULL AS STRING) AS website",
        "array('artmap') AS sources",
        "TIMESTAMP'1998-01-01 00:00:00' AS first_seen_at",
        "TIMESTAMP'1998-01-01 00:00:00' AS updated_at",
        "'en' AS lang",
        "CAST(map() AS MAP<STRING, MAP<STRING, STRING>>) AS tr",
        "p_partkey AS seq",
    )


def raw_listings(spark: SparkSession, d: str) -> DataFrame:
    """Messy raw listings out of ``orders``: five date notations, blanks, placeholders, odd spacing.

    Dealt while the rows are narrow: the listings are built, and parsed by whoever reads them, in all tasks of the session.
    """
    base = dealt(_orders(spark, d)).selectExpr(
        "*",
        "date_add(day, CAST(30 * (seq % 2 + 1) AS INT)) AS last",
        "cust DIV 15 AS vk",
    )
    return base.selectExpr(
        "source",
        "concat('https://', source, '.example.org/e/', seq) AS source_url",
        "seq",
        """named_struct(
          'title', CASE WHEN seq % 29 = 0 THEN '   ' WHEN seq % 3 = 0 THEN concat('  Show   ', seq % 997, '　개인전 ') ELSE concat(' Show　', seq % 997) END,
          'title_en', CAST(NULL AS STRING),
          'description', concat('Notes ', seq % 5, ' <b>x</b> email: a', seq, '@example.org<script>var x;</script>', IF(seq % 4 = 0, ' film', '')),
          'category', IF(seq % 2 = 0, '사진', NULL),
          'exhibition_type_text', IF(seq % 6 = 0, '기획전', NULL),
          'date_range', CASE
             WHEN seq % 47 = 0 THEN NULL
             WHEN seq % 43 = 0 THEN '미정'
             WHEN seq % 11 = 0 THEN concat(date_format(day, 'yyyy.MM.dd'), ' ~ 미정')
             WHEN seq % 5 = 0 THEN concat(date_format(day, 'yyyy.MM.dd'), ' ~ ', date_format(last, 'yyyy.MM.dd'))
             WHEN seq % 5 = 1 THEN concat(year(day), '년 ', month(day), '월 ', day(day), '일 ~ ', year(last), '년 ', month(last), '월 ', day(last), '일')
             WHEN seq % 5 = 2 THEN concat(year(day), '年', month(day), '月', day(day), '日 ～ ', year(last), '年', month(last), '月', day(last), '日')
             WHEN seq % 5 = 3 THEN concat(date_format(day, 'MMM d'), ' – ', date_format(last, 'MMM d, yyyy'))
             ELSE concat(year(day), '. ', month(day), '. ', day(day), ' - ', month(last), '. ', day(last)) END,
          'open_hours', '  ',
          'poster_image_url', IF(seq % 5 = 0, 'https://img.example.org/coming-soon.jpg', concat('https://img.example.org/p', seq % 499, '.jpg')),
          'venue_name', IF(seq % 31 = 0, NULL, concat(' ', CASE vk % 3 WHEN 0 THEN concat('갤러리 ', vk) WHEN 1 THEN concat('Museum ', vk) ELSE concat('Hall ', vk) END)),
          'venue_region', """
        + _REGION.format(k="vk")
        + """,
          'venue_address', IF(vk % 4 = 0, NULL, concat('addr ', vk)),
          'venue_lat', CAST(IF(vk % 5 = 0, 35.5, NULL) AS DOUBLE),
          'venue_lng', CAST(IF(vk % 5 = 0, 127.25, NULL) AS DOUBLE),
          'organizer', IF(seq % 3 = 0, NULL, concat('Org  ', cust % 50, ' 재단')),
          'artists', transform(slice(array(0, 7, 14), 1, CAST(seq % 4 AS INT)), k -> IF(seq % 2 = 0, concat('Artist  ', cust + k), concat('ARTIST ', cust + k, '!'))),
          'genre_tags', slice(array(concat('g', seq % 97), concat('h', seq % 13)), 1, CAST(seq % 3 AS INT)),
          'activities', CAST(NULL AS ARRAY<STRING>),
          'fee_text', CASE seq % 7 WHEN 0 THEN '무료' WHEN 1 THEN '일부 유료' END,
          'price_min', CASE seq % 7 WHEN 2 THEN 0 WHEN 3 THEN 3000 END,
          'price_max', CASE seq % 7 WHEN 2 THEN 5000 WHEN 3 THEN 8000 END,
          'price_breakdown', IF(seq % 7 = 3, array(named_struct('label', '성인', 'amount', 8000), named_struct('label', '', 'amount', 1),
                                 named_struct('label', 'x', 'amount', CAST(NULL AS INT))), NULL),
          'price_notes', CAST(NULL AS STRING)) AS raw""",
    )


def known_artists(spark: SparkSession, d: str) -> DataFrame:
    """Entities stored before the run: large parts are known artists under their own ids."""
    return (
        table(spark, d, "part")
        .filter("p_size > 25")
        .selectExpr(
            "concat('A', p_partkey) AS id", "concat('Artist ', p_partkey) AS name",
            "concat('artist ', p_partkey) AS name_normalized", "array('koba') AS sources",
            "TIMESTAMP'1998-01-01 00:00:00' AS first_seen_at", "TIMESTAMP'1998-01-01 00:00:00' AS updated_at",
            "p_partkey AS seq",
        )
    )


def known_venues(spark: SparkSession, d: str) -> DataFrame:
    name = "CASE s_suppkey % 3 WHEN 0 THEN concat('갤러리 ', s_suppkey) WHEN 1 THEN concat('Museum ', s_suppkey) ELSE concat('Hall ', s_suppkey) END"
    return (
        table(spark, d, "supplier")
        .filter("s_acctbal > 4000")
        .selectExpr(
            f"substr(sha1(concat('venue:name|', {name})), 1, 12) AS id", f"{name} AS name", "'other' AS venue_type",
            "CAST(NULL AS STRING) AS region", "CAST(NULL AS STRING) AS address", "CAST(NULL AS DOUBLE) AS latitude",
            "CAST(NULL AS DOUBLE) AS longitude", "array('koba') AS sources",
            "TIMESTAMP'1998-01-01 00:00:00' AS first_seen_at", "TIMESTAMP'1998-01-01 00:00:00' AS updated_at",
            "'KR' AS country", "s_suppkey AS seq",
        )
    )


def known_organizers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").selectExpr(
        "concat('O', n_nationkey) AS id", "concat('Org ', n_nationkey, ' 재단') AS name",
        "concat('org ', n_nationkey, ' 재단') AS name_normalized", "'foundation' AS organizer_type",
        "array('koba') AS sources", "TIMESTAMP'1998-01-01 00:00:00' AS first_seen_at",
        "TIMESTAMP'1998-01-01 00:00:00' AS updated_at", "CAST(n_nationkey AS BIGINT) AS seq",
    )


def overrides(spark: SparkSession, d: str) -> DataFrame:
    """Per nation one rule of each kind; an artist rule may point at an unknown artist."""
    nation = table(spark, d, "nation")
    kinds = (
        ("artist", "concat('Artist  ', n_nationkey * 4)", "concat('A', n_nationkey)", 0),
        ("venue", "concat('Hall ', n_nationkey * 3 + 2)", "concat('ov', n_nationkey)", 100),
        ("organizer", "concat('Org  ', n_nationkey + 25, ' 재단')", "concat('oo', n_nationkey)", 200),
    )
    parts = [
        nation.selectExpr(
            f"'{kind}' AS entity_type", f"{pattern} AS match_pattern", f"{target} AS canonical_id",
            "CAST(NULL AS STRING) AS note", f"CAST(n_nationkey + {base} AS BIGINT) AS seq",
        )
        for kind, pattern, target, base in kinds
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def gazetteer(spark: SparkSession, d: str) -> DataFrame:
    """Addresses and place names of the suppliers, per backend."""
    s = table(spark, d, "supplier")
    address = s.filter("s_acctbal > 2000").selectExpr(
        "IF(s_nationkey % 9 < 5, 'KR', 'JP') AS backend", "'address' AS kind", "concat('addr ', s_suppkey) AS query",
        "30 + s_suppkey / 1000D AS lat", "120 + s_suppkey / 1000D AS lng",
    )
    place = s.selectExpr(
        "IF(s_nationkey % 9 < 5, 'KR', 'JP') AS backend", "'place' AS kind", "s_name AS query",
        "31 + s_suppkey / 1000D AS lat", "121 + s_suppkey / 1000D AS lng",
    )
    return address.unionByName(place)


def profiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr(
        "concat('u', c_custkey) AS id",
        "IF(c_custkey % 13 = 0, '', concat('u', c_custkey, '@example.org')) AS email",
        "TIMESTAMP'1998-01-01 00:00:00' AS created_at",
        "CASE c_custkey % 5 WHEN 0 THEN 'ko' WHEN 1 THEN 'en' WHEN 2 THEN 'ja' WHEN 3 THEN 'fr' END AS locale",
    )


def subscriptions(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    one = part.selectExpr("p_partkey AS k1", "concat(p_name, ' ', p_partkey) AS n1")
    two = part.selectExpr("p_partkey - 3 AS k2", "concat(p_name, ' ', p_partkey) AS n2")
    base = (
        table(spark, d, "customer")
        .join(one, F.col("c_custkey") == F.col("k1"), "left")
        .join(two, F.col("c_custkey") == F.col("k2"), "left")
    )
    return base.selectExpr(
        "concat('u', c_custkey) AS user_id",
        "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'weekly_digest' WHEN 'MACHINERY' THEN 'closing_soon' ELSE 'custom' END AS type",
        "c_custkey % 9 <> 0 AS enabled",
        """named_struct(
          'artists', IF(c_custkey % 4 = 0, CAST(NULL AS ARRAY<STRING>), filter(array(n1, n2), n -> n IS NOT NULL)),
          'regions', IF(c_custkey % 2 = 0 AND c_custkey % 20 <> 0, array('서울', '大阪府', '부산'), CAST(array() AS ARRAY<STRING>)),
          'genres', IF(c_custkey % 4 = 0 AND c_custkey % 20 <> 0, array(concat('g', c_custkey % 97)), CAST(array() AS ARRAY<STRING>)),
          'mediums', IF(c_custkey % 3 = 0 AND c_custkey % 20 <> 0, array('photo', 'video'), CAST(array() AS ARRAY<STRING>))) AS filters""",
        "TIMESTAMP'1998-01-01 00:00:00' AS updated_at",
        "c_custkey AS seq",
    )


def bookmarks(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "events")
        .filter("event_type <> 'error'")
        .groupBy(F.expr("concat('u', user_id)").alias("user_id"), F.expr("concat('x', event_id)").alias("exhibition_id"))
        .agg(F.min(F.col("ts").cast("timestamp")).alias("created_at"))
    )


def email_log(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    custom = table(spark, d, "orders").filter("o_orderstatus = 'P'").selectExpr(
        "concat('u', o_custkey) AS user_id", "'custom' AS type", "concat('x', o_orderkey) AS ref"
    )
    weekly = events.filter("event_type = 'signup' AND value > 20").selectExpr(
        "concat('u', user_id) AS user_id", "'weekly_digest' AS type", "'1998-W27' AS ref"
    )
    closing = events.filter("event_type = 'click'").selectExpr(
        "concat('u', user_id) AS user_id", "'closing_soon' AS type", "concat('x', event_id, ':3') AS ref"
    )
    rows = custom.unionByName(weekly).unionByName(closing).distinct()
    return rows.withColumn("sent_at", F.expr("TIMESTAMP'1998-01-01 00:00:00'"))


def works(spark: SparkSession, d: str) -> DataFrame:
    """Candidate works: a line item is a find of its part in one museum; ``seq`` is a search rank."""
    line = table(spark, d, "lineitem").selectExpr(
        "l_partkey", "l_returnflag", "l_discount", "l_tax", "l_quantity", "l_orderkey * 10 + l_linenumber AS seq"
    )
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return line.join(part, line.l_partkey == part.p_partkey).selectExpr(
        "p_brand AS master_id",
        "CASE l_returnflag WHEN 'A' THEN 'the_met' WHEN 'N' THEN 'aic' ELSE 'wikimedia' END AS source",
        "CAST(l_partkey AS STRING) AS source_object_id",
        "concat(p_name, ' ', CAST(l_partkey % 7 AS STRING)) AS title",
        "IF(l_partkey % 3 = 0, NULL, CAST(1850 + l_partkey % 100 AS STRING)) AS year",
        "p_type AS medium",
        "IF(l_partkey % 11 = 0, NULL, concat('https://img.example.org/', l_partkey % 500, '.jpg')) AS image_url",
        "IF(l_partkey % 4 = 0, NULL, concat('https://img.example.org/t/', l_partkey, '.jpg')) AS thumb_url",
        "concat('https://museum.example.org/', l_partkey) AS source_url",
        "'credit' AS credit",
        "l_partkey % 6 <> 0 AS is_public_domain",
        "l_partkey % 5 = 0 AS is_highlight",
        "seq",
    )


def seeds(spark: SparkSession, d: str) -> DataFrame:
    """One master per brand; a few hand-picked works, exclusions and title overrides each."""
    return (
        table(spark, d, "part")
        .groupBy("p_brand")
        .agg(F.min("p_partkey").alias("k0"), F.max("p_partkey").alias("k1"))
        .selectExpr(
            "p_brand AS id", "concat('Master ', p_brand) AS name", "'foreign' AS region", "'KR' AS nationality",
            "CAST(IF(k0 % 5 = 0, NULL, 1800 + k0 % 150) AS INT) AS birth_year",
            "CAST(1900 + k1 % 100 AS INT) AS death_year",
            "IF(k0 % 2 = 0, NULL, concat('https://img.example.org/face/', k0, '.jpg')) AS portrait_url",
            """array(named_struct('source', 'aic', 'query', CAST(NULL AS STRING), 'object_ids', array(CAST(k1 AS STRING), CAST(k0 AS STRING), 'none'), 'artist', CAST(NULL AS STRING)),
                     named_struct('source', 'the_met', 'query', p_brand, 'object_ids', CAST(NULL AS ARRAY<STRING>), 'artist', CAST(NULL AS STRING))) AS sources""",
            "array('RING 3') AS exclude_titles",
            "array(concat('the_met-', k1)) AS exclude_ids",
            "map(concat('aic-', k0), concat('Renamed ', k0)) AS title_overrides",
            "k0 AS seq",
        )
    )


def commentary(spark: SparkSession, d: str) -> DataFrame:
    """Cached texts: even parts have current facts, the rest a stale hash."""
    return (
        table(spark, d, "part")
        .selectExpr(
            "concat('work:aic-', p_partkey) AS key",
            "concat(p_name, ' ', CAST(p_partkey % 7 AS STRING)) AS title",
            "IF(p_partkey % 3 = 0, '', CAST(1850 + p_partkey % 100 AS STRING)) AS year",
            "p_type", "p_size", "p_partkey",
        )
        .selectExpr(
            "key",
            "IF(p_size > 10, substr(sha2(concat_ws('|', 'work', title, year, p_type), 256), 1, 16), 'stale') AS facts_hash",
            """named_struct('ko', concat('ko ', p_partkey), 'en', concat('en ', p_partkey), 'ja', concat('ja ', p_partkey),
                 'ko_tagline', '', 'en_tagline', '', 'ja_tagline', '') AS text""",
        )
    )


def scenes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(modern, public domain) film scenes out of ``part``: later and earlier credit years."""
    rows = table(spark, d, "part").selectExpr(
        "p_size",
        "concat('s', p_partkey) AS id",
        "map('ko', concat('영화 ', p_partkey), 'en', concat(p_name, ' ', p_partkey), 'ja', concat('映画 ', p_partkey)) AS title",
        """map('en', IF(p_partkey % 10 = 0, '', concat(p_brand, ' · ', CASE WHEN p_partkey % 7 = 0 THEN 'undated' WHEN p_size > 15 THEN CAST(1950 + p_partkey % 70 AS STRING)
             ELSE CAST(1890 + p_partkey % 50 AS STRING) END)), 'ko', concat('감독 · ', CAST(1890 + p_partkey % 130 AS STRING)), 'ja', '') AS credit""",
        "IF(p_partkey % 3 = 0, NULL, p_type) AS studio",
        "IF(p_partkey % 6 = 0, NULL, concat('https://img.example.org/s/', p_partkey, '.jpg')) AS image",
    )
    return rows.filter("p_size > 15").drop("p_size"), rows.filter("p_size <= 15").drop("p_size")
