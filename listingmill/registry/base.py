"""Registered queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_SOURCE = """CASE o_orderpriority WHEN '1-URGENT' THEN 'artmap' WHEN '2-HIGH' THEN 'tokyo_art_beat'
 WHEN '3-MEDIUM' THEN 'goeun' WHEN '4-NOT SPECIFIED' THEN 'pgi' ELSE 'zen_foto' END"""
_REGION = """CASE {k} % 9 WHEN 0 THEN '서울' WHEN 1 THEN '부산' WHEN 2 THEN '경기' WHEN 3 THEN '인천' WHEN 4 THEN '강원'
 WHEN 5 THEN '東京' WHEN 6 THEN '大阪府' WHEN 7 THEN '京都' ELSE '新宿、四ツ谷' END"""
_VENUE_NAME = "CASE {k} % 3 WHEN 0 THEN '갤러리 ' || {k} WHEN 1 THEN 'Museum ' || {k} ELSE 'Hall ' || {k} END"
_CITY = """CASE WHEN {r} IS NULL THEN NULL WHEN {r} = '서울' THEN '서울' WHEN {r} = '부산' THEN '부산' WHEN {r} IN ('경기', '인천') THEN '경기·인천'
 WHEN {r} = '강원' THEN '한국 기타' WHEN contains({r}, '大阪') THEN '오사카' WHEN contains({r}, '京都') THEN '교토'
 WHEN contains({r}, '東京') OR contains({r}, '、') THEN '도쿄' ELSE '일본 기타' END"""

# name -> (needs, body)
CTES: dict[str, tuple[str, str]] = {
    "o": (
        "",
        f"""SELECT o_orderkey AS seq, o_custkey AS cust, o_orderstatus AS st, o_totalprice AS price, {_SOURCE} AS source,
        CAST(DATE '1998-01-01' + CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 240 AS INTEGER) AS DATE) AS day
        FROM orders""",
    ),
    "x0": (
        "o",
        """SELECT *, 'Show ' || (seq % 997) AS core, source IN ('artmap', 'tokyo_art_beat') AS agg,
        CASE WHEN seq % 41 <> 0 THEN day END AS start_date,
        CASE WHEN seq % 41 <> 0 AND seq % 11 <> 0 THEN CAST(day + CAST(30 * (seq % 2 + 1) AS INTEGER) AS DATE) END AS end_date FROM o""",
    ),
    "x1": ("x0", "SELECT *, CASE WHEN agg AND seq % 2 = 0 THEN '写真展「' || core || '」' ELSE core END AS title FROM x0"),
    "x": (
        "x1",
        """SELECT 'x' || seq AS id, seq, cust, core, source, agg, title, start_date, end_date,
        CASE WHEN start_date IS NULL THEN 'unknown' WHEN DATE '1998-07-01' < start_date THEN 'upcoming'
             WHEN DATE '1998-07-01' > end_date THEN 'past' ELSE 'ongoing' END AS status,
        'https://' || CASE WHEN seq % 3 = 0 THEN 'www.' ELSE '' END || source || '.example.org/e/' || seq AS source_url,
        'Notes on <' || core || '> mail: a' || seq || '@example.org' || repeat(' lorem', CAST(seq % 5 AS INTEGER)) AS description,
        'Notes on <' || core || '> mail:' || CASE WHEN seq % 5 > 0 THEN repeat(' lorem', CAST(seq % 5 AS INTEGER)) ELSE '' END AS clean_description,
        CASE WHEN seq % 5 <> 0 THEN 'https://img.example.org/p' || (seq % 499) || '.jpg' END AS poster_image_url,
        CASE st WHEN 'F' THEN 'photo' WHEN 'O' THEN 'video' ELSE 'mixed' END AS medium,
        CASE seq % 4 WHEN 0 THEN 'solo' WHEN 1 THEN 'group' WHEN 2 THEN 'curated' END AS exhibition_type,
        list_slice(['g' || (seq % 97), 'h' || (seq % 13)], 1, seq % 3) AS genre_tags,
        CASE seq % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'paid' ELSE 'partial' END AS fee_type,
        CASE WHEN seq % 3 <> 1 THEN 0 WHEN seq % 10 <> 0 THEN (seq % 9) * 1000 END AS price_min,
        CASE WHEN seq % 3 = 0 THEN 0 ELSE (seq % 9) * 1000 + 5000 END AS price_max,
        list_transform(list_slice([0, 7, 14], 1, seq % 4), lambda k: 'a' || (cust + k)) AS artist_ids,
        'v' || (cust // 15) AS venue_id,
        CASE WHEN seq % 7 <> 0 THEN price END AS popularity_score, seq % 50 = 0 AS featured,
        CASE WHEN agg AND seq % 2 = 0 THEN 'ja' ELSE 'en' END AS lang,
        CASE WHEN seq % 12 = 1 THEN title WHEN seq % 4 = 1 THEN 'EN ' || title END AS tr_en_title,
        CASE WHEN seq % 8 = 3 THEN 'EN notes ' || core END AS tr_en_description,
        CASE WHEN seq % 4 = 2 THEN 'JA ' || title END AS tr_ja_title
        FROM x1""",
    ),
    "v": (
        "",
        f"""SELECT *, {_CITY.format(r='region')} AS city FROM (
        SELECT 'v' || s_suppkey AS id, s_suppkey AS seq, s_name AS name,
        CASE s_suppkey % 3 WHEN 0 THEN 'museum' WHEN 1 THEN 'gallery' ELSE 'other' END AS venue_type,
        CASE WHEN s_suppkey % 17 <> 0 THEN {_REGION.format(k='s_nationkey')} END AS region,
        CASE WHEN s_suppkey % 4 <> 0 THEN 'addr ' || s_suppkey END AS address,
        CASE WHEN s_suppkey % 10 <> 0 THEN 33 + CAST(s_suppkey * 7 % 500 AS DOUBLE) / 100 END AS lat,
        CASE WHEN s_suppkey % 20 <> 0 THEN 126 + CAST(s_suppkey * 13 % 1500 AS DOUBLE) / 100 END AS lng,
        CASE WHEN s_nationkey % 9 < 5 THEN 'KR' ELSE 'JP' END AS country,
        CASE WHEN s_suppkey % 3 = 1 THEN '공간 ' || s_suppkey END AS tr_ko_name FROM supplier)""",
    ),
    "a": ("", "SELECT 'a' || p_partkey AS id, p_partkey AS seq, p_name || ' ' || p_partkey AS name FROM part"),
    "xv": (
        "x v",
        """SELECT x.*, v.id AS v_id, v.name AS venue_name, v.region AS region, v.city AS city, v.lat AS lat, v.lng AS lng, v.tr_ko_name
        FROM x LEFT JOIN v ON x.venue_id = v.id""",
    ),
    "xa": (
        "x",
        """SELECT id, seq, generate_subscripts(artist_ids, 1) AS pos, unnest(artist_ids) AS artist_id FROM x WHERE len(artist_ids) > 0""",
    ),
    "n": (
        "o",
        f"""SELECT *, sha1(source || '|' || coalesce(venue_name, '') || '|' || title || '|' || coalesce(strftime(start_date, '%Y-%m-%d'), ''))[1:12] AS id FROM (
        SELECT seq, source, cust, cust // 15 AS vk, day,
        'https://' || source || '.example.org/e/' || seq AS source_url,
        CASE WHEN seq % 29 = 0 THEN NULL WHEN seq % 3 = 0 THEN 'Show ' || (seq % 997) || ' 개인전' ELSE 'Show ' || (seq % 997) END AS title,
        'Notes ' || (seq % 5) || ' <b>x</b>' || CASE WHEN seq % 4 = 0 THEN ' film' ELSE '' END AS description,
        CASE WHEN seq % 4 = 0 AND seq % 2 = 0 THEN 'mixed' WHEN seq % 4 = 0 THEN 'video' WHEN seq % 2 = 0 THEN 'photo' ELSE 'mixed' END AS medium,
        CASE WHEN seq % 6 = 0 THEN 'curated' WHEN seq % 3 = 0 THEN 'solo' WHEN seq % 4 = 1 THEN 'solo' WHEN seq % 4 >= 2 THEN 'group' ELSE 'curated' END AS exhibition_type,
        CASE WHEN seq % 47 <> 0 AND seq % 43 <> 0 THEN day END AS start_date,
        CASE WHEN seq % 47 <> 0 AND seq % 43 <> 0 AND seq % 11 <> 0 THEN CAST(day + CAST(30 * (seq % 2 + 1) AS INTEGER) AS DATE) END AS end_date,
        seq % 47 <> 0 AND seq % 43 = 0 AS warned,
        CASE WHEN seq % 5 <> 0 THEN 'https://img.example.org/p' || (seq % 499) || '.jpg' END AS poster_image_url,
        CASE seq % 7 WHEN 0 THEN 'free' WHEN 1 THEN 'partial' WHEN 2 THEN 'partial' WHEN 3 THEN 'paid' ELSE 'free' END AS fee_type,
        CASE WHEN seq % 7 = 3 THEN 1 ELSE 0 END AS n_tiers,
        CASE WHEN seq % 31 <> 0 THEN {_VENUE_NAME.format(k='(cust // 15)')} END AS venue_name,
        {_REGION.format(k='(cust // 15)')} AS venue_region,
        CASE WHEN (cust // 15) % 4 <> 0 THEN 'addr ' || (cust // 15) END AS venue_address,
        CASE WHEN (cust // 15) % 5 = 0 THEN 35.5 END AS venue_lat,
        CASE WHEN seq % 3 <> 0 THEN 'Org  ' || (cust % 50) || ' 재단' END AS organizer_name,
        list_transform(list_slice([0, 7, 14], 1, seq % 4), lambda k: CASE WHEN seq % 2 = 0 THEN 'Artist  ' || (cust + k) ELSE 'ARTIST ' || (cust + k) || '!' END) AS artist_names,
        list_transform(list_slice([0, 7, 14], 1, seq % 4), lambda k: cust + k) AS artist_keys
        FROM o)""",
    ),
    "good": ("n", "SELECT * FROM n WHERE title IS NOT NULL"),
    "known_a": ("", "SELECT 'A' || p_partkey AS id, p_partkey AS k FROM part WHERE p_size > 25"),
    "known_v": (
        "",
        f"SELECT sha1('venue:name|' || name)[1:12] AS id, name FROM (SELECT {_VENUE_NAME.format(k='s_suppkey')} AS name FROM supplier WHERE s_acctbal > 4000)",
    ),
    "mention": (
        "good",
        "SELECT seq, source, generate_subscripts(artist_names, 1) AS pos, unnest(artist_names) AS raw_name, unnest(artist_keys) AS k FROM good WHERE len(artist_names) > 0",
    ),
    "art_res": (
        "mention known_a",
        """SELECT m.*, COALESCE(t.id, e.id, sha1('artist|artist ' || m.k)[1:12]) AS artist_id, t.id IS NULL AND e.id IS NULL AS is_new
        FROM mention m
        LEFT JOIN nation n ON m.raw_name = 'Artist  ' || (n.n_nationkey * 4)
        LEFT JOIN known_a t ON t.id = 'A' || n.n_nationkey
        LEFT JOIN known_a e ON e.k = m.k""",
    ),
    "ven_res": (
        "good known_v",
        """SELECT g.seq, g.source, g.venue_name, g.organizer_name, g.vk, g.venue_region, g.venue_address, g.venue_lat, g.cust,
        CASE WHEN g.venue_name IS NULL THEN '' ELSE COALESCE('ov' || n.n_nationkey, sha1('venue:name|' || g.venue_name)[1:12]) END AS venue_id,
        g.venue_name IS NOT NULL AND n.n_nationkey IS NULL AND k.id IS NULL AS is_new
        FROM good g LEFT JOIN nation n ON g.venue_name = 'Hall ' || (n.n_nationkey * 3 + 2)
        LEFT JOIN known_v k ON k.name = g.venue_name""",
    ),
    "org_res": (
        "ven_res",
        """SELECT r.*, CASE WHEN r.organizer_name IS NULL THEN r.venue_id
          WHEN r.cust % 50 BETWEEN 25 AND 49 THEN 'oo' || (r.cust % 50 - 25) WHEN r.cust % 50 < 25 THEN 'O' || (r.cust % 50) END AS organizer_id FROM ven_res r""",
    ),
    "rank_of": (
        "",
        "SELECT * FROM (VALUES ('artmap', 1, 'KR'), ('tokyo_art_beat', 18, 'JP'), ('goeun', 9, 'KR'), ('pgi', 13, 'JP'), ('zen_foto', 21, 'JP')) t(source, source_rank, country)",
    ),
    "subs": (
        "",
        """SELECT 'u' || c.c_custkey AS user_id, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'weekly_digest' WHEN 'MACHINERY' THEN 'closing_soon' ELSE 'custom' END AS type,
        c.c_custkey AS seq, c.c_custkey % 9 <> 0 AS enabled,
        CASE WHEN c.c_custkey % 4 = 0 THEN [] ELSE list_filter([p1.p_name || ' ' || p1.p_partkey, p2.p_name || ' ' || p2.p_partkey], lambda n: n IS NOT NULL) END AS artists,
        CASE WHEN c.c_custkey % 2 = 0 AND c.c_custkey % 20 <> 0 THEN ['서울', '大阪府', '부산'] ELSE [] END AS regions,
        CASE WHEN c.c_custkey % 4 = 0 AND c.c_custkey % 20 <> 0 THEN ['g' || (c.c_custkey % 97)] ELSE [] END AS genres,
        CASE WHEN c.c_custkey % 3 = 0 AND c.c_custkey % 20 <> 0 THEN ['photo', 'video'] ELSE [] END AS mediums
        FROM customer c LEFT JOIN part p1 ON p1.p_partkey = c.c_custkey LEFT JOIN part p2 ON p2.p_partkey = c.c_custkey + 3""",
    ),
    "prof": (
        "",
        """SELECT 'u' || c_custkey AS id, c_custkey AS k, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE 'u' || c_custkey || '@example.org' END AS email,
        CASE c_custkey % 5 WHEN 0 THEN 'ko' WHEN 1 THEN 'en' WHEN 2 THEN 'ja' WHEN 3 THEN 'fr' END AS locale FROM customer""",
    ),
    "subscribers": (
        "subs prof",
        """SELECT s.*, p.email, CASE WHEN p.locale IN ('ko', 'en', 'ja') THEN p.locale ELSE 'ko' END AS locale
        FROM subs s JOIN prof p ON s.user_id = p.id WHERE s.enabled AND p.email <> ''""",
    ),
    "marks": ("", "SELECT DISTINCT 'u' || user_id AS user_id, 'x' || event_id AS exhibition_id FROM events WHERE event_type <> 'error'"),
    "log": (
        "",
        """SELECT 'u' || o_custkey AS user_id, 'custom' AS type, 'x' || o_orderkey AS ref FROM orders WHERE o_orderstatus = 'P'
        UNION SELECT 'u' || user_id, 'weekly_digest', '1998-W27' FROM events WHERE event_type = 'signup' AND value > 20
        UNION SELECT 'u' || user_id, 'closing_soon', 'x' || event_id || ':3' FROM events WHERE event_type = 'click'""",
    ),
    "xn": (
        "x xv xa a",
        """SELECT xv.*, n.artist_names FROM xv LEFT JOIN (SELECT xa.id, list(a.name ORDER BY pos) AS artist_names FROM xa JOIN a ON xa.artist_id = a.id GROUP BY xa.id) n ON xv.id = n.id""",
    ),
    "matched": (
        "subscribers xn",
        """SELECT s.user_id, s.locale, c.id, c.seq FROM (SELECT * FROM subscribers WHERE type = 'custom' AND len(artists) + len(regions) + len(genres) + len(mediums) > 0) s
        JOIN xn c ON (len(s.artists) = 0 OR list_has_any(c.artist_names, s.artists))
        AND (len(s.regions) = 0 OR list_contains(s.regions, c.region)) AND (len(s.genres) = 0 OR list_has_any(c.genre_tags, s.genres))
        AND (len(s.mediums) = 0 OR list_contains(s.mediums, c.medium))""",
    ),
    "w": (
        "",
        """SELECT p_brand AS master_id, CASE l_returnflag WHEN 'A' THEN 'the_met' WHEN 'N' THEN 'aic' ELSE 'wikimedia' END AS source,
        CAST(l_partkey AS VARCHAR) AS oid, l_partkey AS k, p_name || ' ' || (l_partkey % 7) AS title,
        CASE WHEN l_partkey % 3 <> 0 THEN CAST(1850 + l_partkey % 100 AS VARCHAR) END AS year, p_type AS medium,
        CASE WHEN l_partkey % 11 <> 0 THEN 'https://img.example.org/' || (l_partkey % 500) || '.jpg' END AS image_url,
        CASE WHEN l_partkey % 4 <> 0 THEN 'https://img.example.org/t/' || l_partkey || '.jpg' END AS thumb_url,
        l_partkey % 6 <> 0 AS pd, l_partkey % 5 = 0 AS hl, l_orderkey * 10 + l_linenumber AS seq
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    ),
    "seed": (
        "",
        """SELECT p_brand AS id, k0, k1, CASE WHEN k0 % 5 <> 0 THEN 1800 + k0 % 150 END AS birth_year, 1900 + k1 % 100 AS death_year,
        CASE WHEN k0 % 2 <> 0 THEN 'https://img.example.org/face/' || k0 || '.jpg' END AS portrait_url
        FROM (SELECT p_brand, min(p_partkey) AS k0, max(p_partkey) AS k1 FROM part GROUP BY p_brand)""",
    ),
    "sel": (
        "w seed",
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY master_id ORDER BY t, a, b, c, d) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY master_id, source, oid ORDER BY t, a, b, c, d) AS dup FROM (
          SELECT s.id AS master_id, w.source, w.oid, w.k, w.title, w.year, w.medium, w.image_url, w.thumb_url, w.pd, 0 AS t, 0 AS a, p.pos AS b, 0 AS c, w.seq AS d
          FROM seed s CROSS JOIN (VALUES (0), (1)) p(pos) JOIN w ON w.source = 'aic' AND w.oid = CASE p.pos WHEN 0 THEN CAST(s.k1 AS VARCHAR) ELSE CAST(s.k0 AS VARCHAR) END
          UNION ALL
          SELECT master_id, source, oid, k, title, year, medium, image_url, thumb_url, pd, 1, -CAST(hl AS INT), -CAST(year IS NOT NULL AS INT), -CAST(thumb_url IS NOT NULL AS INT), seq FROM w) u
        WHERE pd AND image_url IS NOT NULL AND NOT contains(lower(title), 'ring 3')
          AND NOT EXISTS (SELECT 1 FROM seed s WHERE s.id = master_id AND u.source = 'the_met' AND u.oid = CAST(s.k1 AS VARCHAR))) WHERE dup = 1) WHERE rank <= 10""",
    ),
    "scene": (
        "",
        """SELECT 's' || p_partkey AS id, p_partkey AS k, CASE WHEN p_size > 15 THEN 'modern' ELSE 'pd' END AS kind, '영화 ' || p_partkey AS ko, p_name || ' ' || p_partkey AS en,
        '映画 ' || p_partkey AS ja, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS studio,
        CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_brand || ' · ' || CASE WHEN p_partkey % 7 = 0 THEN 'undated' WHEN p_size > 15 THEN CAST(1950 + p_partkey % 70 AS VARCHAR) ELSE CAST(1890 + p_partkey % 50 AS VARCHAR) END END AS credit_en,
        '감독 · ' || (1890 + p_partkey % 130) AS credit_ko,
        CASE WHEN p_partkey % 10 = 0 THEN 1890 + p_partkey % 130 WHEN p_partkey % 7 = 0 THEN 0 WHEN p_size > 15 THEN 1950 + p_partkey % 70 ELSE 1890 + p_partkey % 50 END AS year,
        CASE WHEN p_partkey % 6 <> 0 THEN 'https://img.example.org/s/' || p_partkey || '.jpg' END AS image FROM part""",
    ),
}


def sql(needs: str, body: str) -> str:
    """``WITH`` the named views (and what they need) ahead of ``body``."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in CTES[name][0].split():
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for name in needs.split():
        add(name)
    if not ordered:
        return body
    recursive = "WITH RECURSIVE " if "RECURSIVE" in body else "WITH "
    return recursive + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered) + "\n" + body
