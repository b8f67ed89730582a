"""Sources, page extraction, row rules and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from listingmill import schemas
from listingmill.functions import text, urls, values
from listingmill.functions.classify import drop_placeholder_image
from listingmill.operators import merge
from listingmill.registry.base import query, sql
from listingmill.registry.scalars import q_clean, q_strip_markup
from listingmill.session import materialize, shared_dir
from listingmill.sources import extract, sites, tables
from listingmill.sources import testdata as td


def page_rules(spark, d) -> DataFrame:
    """A rule row per host of ``pages``: blogs list their links, other hosts one article per page."""
    hosts = td.table(spark, d, "pages").select(extract.page_host(F.col("url")).alias("host")).distinct()
    return hosts.selectExpr(
        "host",
        "IF(host LIKE 'blog.%', 'ryugaheon', 'gallery_lux') AS source",
        r"IF(host LIKE 'blog.%', '(?s)<li>(.*?)</li>', '(?s)<article>(.*?)</article>') AS card_regex",
        r"""IF(host LIKE 'blog.%', map('title', '(?s)<a[^>]*>(.*?)</a>', 'link', 'href="([^"]*)"'),
                map('title', '(?s)<h1>(.*?)</h1>', 'description', '(?s)</h1>(.*)$')) AS field_regex""",
        "IF(host LIKE 'blog.%', map('venue_name', 'Link hall', 'category', '사진'), map('venue_name', 'Article hall', 'venue_region', '서울')) AS constants",
    )


_PAGES = """p AS (SELECT page_id, url, html, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages)"""


@query(
    "extract_listing_pages",
    f"""WITH {_PAGES}, c AS (
      SELECT page_id, url, host, 'ryugaheon' AS source, generate_subscripts(m, 1) - 1 AS card_pos, unnest(m) AS card
        FROM (SELECT *, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS m FROM p WHERE host LIKE 'blog.%') WHERE len(m) > 0
      UNION ALL
      SELECT page_id, url, host, 'gallery_lux', generate_subscripts(m, 1) - 1, unnest(m)
        FROM (SELECT *, regexp_extract_all(html, '(?s)<article>(.*?)</article>', 1) AS m FROM p WHERE host NOT LIKE 'blog.%') WHERE len(m) > 0)
    SELECT page_id, CAST(card_pos AS BIGINT) AS card_pos, source,
      CASE WHEN source = 'ryugaheon' THEN 'https://' || host || regexp_extract(card, 'href="([^"]*)"', 1) ELSE url END AS source_url,
      nullif({q_strip_markup("regexp_extract(card, CASE WHEN source = 'ryugaheon' THEN '(?s)<a[^>]*>(.*?)</a>' ELSE '(?s)<h1>(.*?)</h1>' END, 1)")}, '') AS title,
      CASE WHEN source = 'gallery_lux' THEN nullif({q_strip_markup("regexp_extract(card, '(?s)</h1>(.*)$', 1)")}, '') END AS description,
      CASE WHEN source = 'ryugaheon' THEN 'Link hall' ELSE 'Article hall' END AS venue_name,
      CASE WHEN source = 'gallery_lux' THEN '서울' END AS venue_region FROM c""",
)
def extract_listing_pages(spark, d):
    rows = extract.extract_listing_pages(td.texts(spark, d, "pages"), page_rules(spark, d))
    return rows.select(
        "page_id", F.col("card_pos").cast("long").alias("card_pos"), "source", "source_url", "title", "description",
        "venue_name", "venue_region",
    )


def doc_pages(spark, d) -> DataFrame:
    """Detail pages around the whole text of ``documents``."""
    return td.texts(spark, d, "documents").selectExpr(
        "doc_id AS page_id",
        "concat('https://', source, '.example.org/v.php?boardid=exhib&idx=', doc_id, '&PHPSESSID=9') AS url",
        """concat('<html><head><meta property="og:title" content="Doc ', doc_id, ' | Site &amp; more"/>',
             IF(doc_id % 4 = 0, concat('<meta property="og:image" content="https://img.example.org/og', doc_id, '.jpg"/>'), ''),
             CASE doc_id % 3 WHEN 0 THEN concat('<meta property="og:description" content="About  ', doc_id, '"/>')
               WHEN 1 THEN concat('<meta name="description" content="Plain ', doc_id, '">') ELSE concat("<meta name='twitter:description' content='Tweet ", doc_id, "'>") END,
             '</head><body><img src="logo.png">', IF(doc_id % 4 = 1, concat('<img alt="x" src="/u_image/', doc_id, '.png">'), ''),
             '<table><tr><th>시간 |</th><td>10:00 <b>- 18:00</b></td></tr><tr><th>주소</th><td>old</td></tr><tr><th>주소</th><td>addr ', doc_id, '</td></tr><tr><th>기타</th><td>x</td></tr></table><p>',
             replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\\n', '</p><p class="b">'), '</p></body></html>') AS html""",
        "text",
    )


@query(
    "extract_meta_description",
    "SELECT doc_id AS page_id, CASE doc_id % 3 WHEN 0 THEN 'About ' || doc_id WHEN 1 THEN 'Plain ' || doc_id ELSE 'Tweet ' || doc_id END AS summary FROM documents",
)
def extract_meta_description(spark, d):
    return doc_pages(spark, d).select("page_id", extract.meta_description(F.col("html")).alias("summary"))


@query(
    "extract_og_tags",
    """SELECT doc_id AS page_id, 'Doc ' || doc_id AS title, CASE WHEN doc_id % 4 = 0 THEN 'https://img.example.org/og' || doc_id || '.jpg' END AS image,
    CASE WHEN doc_id % 3 = 0 THEN 'About ' || doc_id END AS description FROM documents""",
)
def extract_og_tags(spark, d):
    return doc_pages(spark, d).select("page_id", extract.og_tags(F.col("html")).alias("og")).select("page_id", "og.*")


@query(
    "extract_poster",
    """SELECT doc_id AS page_id, CASE doc_id % 4 WHEN 0 THEN 'https://img.example.org/og' || doc_id || '.jpg' WHEN 1 THEN 'https://site.example.org/u_image/' || doc_id || '.png'
    ELSE 'https://site.example.org/p_' || doc_id || '_mv.jpg' END AS poster FROM documents""",
)
def extract_poster(spark, d):
    built = F.concat(F.lit("https://site.example.org/p_"), F.col("page_id"), F.lit("_mv.jpg"))
    return doc_pages(spark, d).select("page_id", extract.poster(F.col("html"), "site.example.org", built).alias("poster"))


_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda l: {q_clean('l')}), lambda l: l <> '')"


@query(
    "extract_paragraph_text",
    f"""SELECT page_id, CASE WHEN length(t) >= 60 THEN t END AS body FROM (SELECT doc_id AS page_id,
    CASE WHEN len({_LINES}) > 0 THEN array_to_string({_LINES}, chr(10) || chr(10)) ELSE '' END AS t FROM documents)""",
)
def extract_paragraph_text(spark, d):
    return doc_pages(spark, d).select("page_id", extract.paragraph_text(F.col("html")).alias("body"))


@query(
    "pick_longest_block",
    f"""WITH b AS (SELECT doc_id, doc_id % 3 AS m, {_LINES} AS blocks FROM documents),
    u AS (SELECT doc_id, m, generate_subscripts(blocks, 1) AS pos, unnest(blocks) AS block FROM b WHERE len(blocks) > 0),
    best AS (SELECT doc_id, arg_min(block, {{'n': -length(block), 'p': pos}}) AS block FROM u WHERE NOT starts_with(block, '©') AND NOT regexp_matches(block, '^\\d{{4}}\\s*[.\\-/]\\s*\\d{{1,2}}\\s*[.\\-/]\\s*\\d{{1,2}}') GROUP BY doc_id)
    SELECT b.doc_id AS page_id, CASE WHEN length(best.block) >= 60 THEN best.block END AS body FROM b LEFT JOIN best ON b.doc_id = best.doc_id""",
)
def pick_longest_block(spark, d):
    blocks = extract.prose_paragraphs(extract.paragraphs(F.col("html")))
    staged = doc_pages(spark, d).select("page_id", "html", blocks.alias("blocks"))
    return staged.select("page_id", extract.longest_block(F.col("blocks"), F.col("html")).alias("body"))


@query(
    "extract_label_table",
    "SELECT doc_id AS page_id, '10:00 - 18:00' AS open_hours, 'addr ' || doc_id AS venue_address, CAST(2 AS BIGINT) AS n FROM documents",
)
def extract_label_table(spark, d):
    rows = doc_pages(spark, d).select("page_id", extract.label_table(F.col("html")).alias("labels"))
    rows = rows.select("page_id", extract.label_fields(F.col("labels")).alias("f"))
    return rows.select(
        "page_id", F.try_element_at("f", F.lit("open_hours")).alias("open_hours"),
        F.try_element_at("f", F.lit("venue_address")).alias("venue_address"), F.size("f").cast("long").alias("n"),
    )


def event_pages(spark, d) -> DataFrame:
    """Pages whose script carries a listing cache: one event per supplier of the nation."""
    event = F.expr(
        """named_struct('eventName', IF(s_suppkey % 13 = 0, '', concat('Event ', s_suppkey)), 'slug', concat('e-', s_suppkey),
           'categories', array(named_struct('fields', named_struct('name', IF(s_suppkey % 3 = 0, 'Painting', 'Photography')))),
           'venue', named_struct('fields', named_struct('fullName', s_name, 'localArea', named_struct('fields', named_struct('name', '東京')),
              'geoInfo', named_struct('lat', 35.5D, 'lon', 139.0D + s_nationkey))),
           'scheduleStartsOn', '1998-07-01', 'scheduleEndsOn', IF(s_suppkey % 2 = 0, '1998-08-01', NULL),
           'imageposter', named_struct('fields', named_struct('file', named_struct('url', concat('//img.example.org/', s_suppkey, '.jpg')))))"""
    )
    # an event page holds at most one nation's slice of ten suppliers
    page = td.table(spark, d, "supplier").withColumn("page_id", F.expr("s_suppkey DIV 10")).groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("s_suppkey", F.to_json(event).alias("j")))).alias("e")
    )
    body = F.concat(
        F.lit('{"props":{"pageProps":{"fallback":{"other":1,"#\\"name\\":\\"EventSearch\\"#":{"data":['),
        F.array_join(F.transform("e", lambda x: x["j"]), ","), F.lit("]}}}}}"),
    )
    return page.select(
        "page_id",
        F.when(F.col("page_id") % 7 == 6, F.lit('<script id="__NEXT_DATA__">{bad</script>'))
        .otherwise(F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), body, F.lit("</script></html>")))
        .alias("html"),
    )


@query(
    "extract_embedded_json",
    """SELECT s_suppkey // 10 AS page_id, 'https://tab.example.org/events/-/e-' || s_suppkey AS source_url, 'Event ' || s_suppkey AS title, s_name AS venue_name, '東京' AS venue_region,
    CAST(35.5 AS DOUBLE) AS venue_lat, CAST(139 + s_nationkey AS DOUBLE) AS venue_lng, CASE WHEN s_suppkey % 2 = 0 THEN '1998-07-01 ~ 1998-08-01' ELSE '1998-07-01' END AS date_range,
    'https://img.example.org/' || s_suppkey || '.jpg' AS poster_image_url FROM supplier WHERE s_suppkey % 13 <> 0 AND s_suppkey % 3 <> 0 AND (s_suppkey // 10) % 7 <> 6""",
)
def extract_embedded_json(spark, d):
    events = extract.embedded_events(event_pages(spark, d))
    return extract.event_rows(events, "https://tab.example.org").drop("pos", "categories")


@query(
    "extract_json_items",
    """SELECT s_suppkey AS page_id, '사진 &전 ' || s_suppkey AS title, 'https://s.example.org/display/detail/' || s_suppkey AS source_url,
    CASE s_suppkey % 3 WHEN 0 THEN 'KT&G 상상마당 부산 갤러리' ELSE 'KT&G 상상마당 홍대 갤러리' END AS venue_name, CASE s_suppkey % 3 WHEN 0 THEN '부산' ELSE '서울' END AS venue_region,
    '2026.05.19 ~ 2026.06.01' AS date_range FROM supplier WHERE s_suppkey % 5 <> 0""",
)
def extract_json_items(spark, d):
    body = F.expr(
        """IF(s_suppkey % 5 = 0, '{"other": []}', concat('{"displayListInfo": {"displayList": [{"title": " 사진 &amp;전 ', s_suppkey, '", "contentsSeq": ', s_suppkey,
           CASE s_suppkey % 3 WHEN 0 THEN ', "spaceCd": "BS"' WHEN 1 THEN ', "spaceCd": "ZZ"' ELSE '' END, ', "term": "2026.05.19 ~ 2026.06.01", "posterFilePath": ""},
           {"title": "회화전", "contentsSeq": 9}]}}'))"""
    )
    pages = td.table(spark, d, "supplier").select(F.col("s_suppkey").alias("page_id"), body.alias("body"))
    return extract.json_item_rows(extract.json_items(pages), "https://s.example.org").drop("pos", "poster_image_url")


@query(
    "extract_rss_items",
    """SELECT 'Feed ' || doc_id AS title, 'https://blog.example.org/' || doc_id AS source_url, 'https://img.example.org/' || doc_id || '.jpg' AS poster_image_url,
    '2026.05.19~2026.06.01' AS date_range FROM documents WHERE doc_id % 3 <> 2""",
)
def extract_rss_items(spark, d):
    """The feed is written as XML text, one item per document with its whole text, and read back by row tag."""
    esc = "replace(replace(replace(regexp_replace(text, '[\\\\x00-\\\\x08\\\\x0b\\\\x0c\\\\x0e-\\\\x1f]', ''), '&', '&amp;'), '<', '&lt;'), ']]>', '')"
    item = F.expr(
        f"""concat('<item><title>[전시 1관] Feed ', doc_id, '</title><link>https://blog.example.org/', doc_id, '?fromRss=true&amp;t=1</link><category>', IF(doc_id % 3 = 2, '아트페어', '전시소식'),
            '</category><category>etc</category><description><![CDATA[<img src="//img.example.org/', doc_id, '.jpg"><b>2026. 5. 19 ~ 6. 1</b> ', {esc}, ']]></description></item>')"""
    )
    path = shared_dir(spark, "feed")
    td.texts(spark, d, "documents").select(F.replace(item, F.lit("\n"), F.lit(" ")).alias("value")).write.text(path)
    return extract.rss_rows(extract.read_rss(spark, path), "blog.example.org")


@query(
    "parse_price_table",
    sql(
        "o",
        """SELECT seq, CAST(CASE seq % 4 WHEN 0 THEN 0 WHEN 1 THEN (seq % 20 + 1) * 500 WHEN 2 THEN 0 END AS BIGINT) AS price_min,
        CAST(CASE seq % 4 WHEN 0 THEN (seq % 20 + 1) * 1000 WHEN 1 THEN (seq % 20 + 1) * 1000 WHEN 2 THEN 0 END AS BIGINT) AS price_max,
        CASE seq % 4 WHEN 0 THEN '성인=' || (seq % 20 + 1) * 1000 || ';기본=0' WHEN 1 THEN '성인/학생=' || (seq % 20 + 1) * 1000 WHEN 2 THEN '입장=0' ELSE '' END AS tiers,
        CASE WHEN seq % 4 = 0 THEN '단체 할인 20%' END AS notes, CASE WHEN seq % 4 = 3 THEN '문의 바랍니다' END AS fee_text FROM o""",
    ),
)
def parse_price_table(spark, d):
    won = "concat(format_number((seq % 20 + 1) * 1000, 0), '원')"
    half = "concat(format_number((seq % 20 + 1) * 500, 0), ' 원')"
    cell = F.expr(
        f"""CASE seq % 4 WHEN 0 THEN concat('· 성인: ', {won}, '\\n\\n어린이 무료\\n단체 할인 20%') WHEN 1 THEN concat('성인/학생: ', {won}, '/', {half}) WHEN 2 THEN '입장: Free' ELSE '문의 바랍니다' END"""
    )
    rows = td.dealt(td._orders(spark, d).select("seq")).select("seq", cell.alias("cell"))
    rows = rows.select("seq", values.parse_price_table(F.col("cell")).alias("p"))
    tiers = F.array_join(F.transform("p.breakdown", lambda t: F.concat(t["label"], F.lit("="), t["amount"].cast("string"))), ";")
    return rows.select(
        "seq", F.col("p.price_min").cast("long").alias("price_min"), F.col("p.price_max").cast("long").alias("price_max"),
        tiers.alias("tiers"), "p.notes", "p.fee_text",
    )


@query(
    "canonicalise_url",
    """SELECT doc_id, 'https://' || source || '.example.org/v.php?boardid=exhib&mode=view&idx=' || doc_id AS board_url, 'https://blog.example.org/' || doc_id AS feed_url,
    '/jp/exhibition/%E5%86%99%E7%9C%9F%20' || doc_id || '/' AS path FROM documents""",
)
def canonicalise_url(spark, d):
    feed = F.concat(F.lit("https://blog.example.org/"), F.col("page_id"), F.lit("?fromRss=true&x=1"))
    path = F.concat(F.lit("/jp/exhibition/写真 "), F.col("page_id"), F.lit("/"))
    return doc_pages(spark, d).select(
        F.col("page_id").alias("doc_id"), extract.canonical_board_url(F.col("url")).alias("board_url"),
        urls.strip_rss_marker(feed).alias("feed_url"), urls.percent_encode_path(path).alias("path"),
    )


@query(
    "absolutise_url",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'https://cdn.example.org/' || event_id WHEN 1 THEN 'https://h.example.org/' || event_id WHEN 2 THEN 'http://a.example.org/' || event_id END AS url FROM events",
)
def absolutise_url(spark, d):
    src = F.expr("concat(CASE event_id % 4 WHEN 0 THEN '//cdn.example.org/' WHEN 1 THEN '/' WHEN 2 THEN 'http://a.example.org/' ELSE 'rel/' END, event_id)")
    return td.table(spark, d, "events").select("event_id", urls.absolutise_url(src, "h.example.org").alias("url"))


@query(
    "drop_placeholder_image",
    sql("o", "SELECT seq, CASE WHEN seq % 4 = 3 THEN 'https://img.example.org/p' || seq || '.jpg' END AS poster FROM o"),
)
def drop_placeholder_image_q(spark, d):
    url = F.expr("concat('https://img.example.org/', CASE seq % 4 WHEN 0 THEN 'Coming-Soon' WHEN 1 THEN 'no_image' WHEN 2 THEN 'dummy' ELSE 'p' END, seq, '.jpg')")
    return td._orders(spark, d).select("seq", drop_placeholder_image(url).alias("poster"))


@query(
    "split_artist_title",
    sql(
        "a",
        "SELECT id, CASE WHEN seq % 3 <> 2 THEN name END AS artist, CASE seq % 3 WHEN 0 THEN 'T ' || seq WHEN 1 THEN 'U ' || seq ELSE name END AS title FROM a",
    ),
)
def split_artist_title(spark, d):
    raw = F.expr("CASE seq % 3 WHEN 0 THEN concat(name, ' 写真展「 T ', seq, '」 2026') WHEN 1 THEN concat(' ', name, '『U ', seq, '』') ELSE concat(name, '  ') END")
    return td.artists(spark, d).select("id", text.split_artist_title(raw).alias("s")).select("id", "s.artist", "s.title")


@query(
    "split_artist_roster",
    sql("a", "SELECT id, name || '|' || id || '|z' AS roster, CAST(3 AS BIGINT) AS n FROM a"),
)
def split_artist_roster(spark, d):
    roster = text.split_artist_roster(F.concat("name", F.lit("、 "), "id", F.lit(" ，,z, ")))
    return td.artists(spark, d).select("id", F.array_join(roster, "|").alias("roster"), F.size(roster).cast("long").alias("n"))


@query(
    "extract_organizer",
    "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS organizer, 'COEX Hall ' || s_suppkey AS venue FROM supplier",
)
def extract_organizer(spark, d):
    paras = F.expr("array('소개', IF(s_suppkey % 2 = 0, concat(s_name, '와 한국방송기술인연합회가 공동주최'), '안내'))")
    venue = F.expr("concat('COEX Hall ', s_suppkey, ' (서울특별시 강남구)')")
    return td.table(spark, d, "supplier").select(
        "s_suppkey", extract.organizer(paras).alias("organizer"), extract.venue_without_address(venue).alias("venue")
    )


@query("strip_markup", f"SELECT page_id, {q_strip_markup('html')} AS body FROM pages")
def strip_markup(spark, d):
    return td.texts(spark, d, "pages").select("page_id", text.strip_markup(F.col("html")).alias("body"))


@query(
    "clean_listing_title",
    sql("a", "SELECT id, name AS title FROM a"),
)
def clean_listing_title(spark, d):
    raw = F.expr(
        """CASE seq % 5 WHEN 0 THEN concat('[CUBE1]  ', name, '_2026. 5. 19 ~') WHEN 1 THEN concat('[전시 1관, 2관] ', name) WHEN 2 THEN concat(name, ' ｜ SITE')
           WHEN 3 THEN concat(name, ' ..') ELSE concat('　', name, ' 2026.5.19(목)') END"""
    )
    return td.artists(spark, d).select("id", text.clean_listing_title(raw).alias("title"))


@query(
    "dedupe_listings_by_url",
    sql("o", "SELECT source, 'https://e.example.org/' || cust AS source_url, min(seq) AS seq, CAST(min(seq) AS VARCHAR) AS title FROM o GROUP BY source, cust"),
)
def dedupe_listings_by_url(spark, d):
    rows = td._orders(spark, d).selectExpr("source", "concat('https://e.example.org/', cust) AS source_url", "seq", "CAST(seq AS STRING) AS title")
    return extract.dedupe_by_url(rows)


@query(
    "merge_list_detail",
    sql(
        "x",
        """SELECT source_url, CASE WHEN st = 'F' THEN 'Detail ' || seq ELSE title END AS title, CASE WHEN st = 'F' AND seq % 2 = 0 THEN 'long ' || seq ELSE 'short' END AS description,
        CASE WHEN st = 'F' THEN '10:00' END AS open_hours FROM (SELECT x.*, o_orderstatus AS st FROM x JOIN orders ON seq = o_orderkey)""",
    ),
)
def merge_list_detail(spark, d):
    listing = td.exhibitions(spark, d).selectExpr("source_url", "title", "'short' AS description")
    detail = td.exhibitions(spark, d).filter("medium = 'photo'").selectExpr(
        "source_url", "concat('Detail ', seq) AS title", "IF(seq % 2 = 0, concat('long ', seq), NULL) AS description", "'10:00' AS open_hours"
    )
    return extract.merge_detail(listing, detail, ["title", "description", "open_hours"])


@query(
    "filter_relevant_listings",
    "SELECT doc_id FROM documents WHERE doc_id % 4 IN (0, 1) AND doc_id % 5 IN (0, 1)",
)
def filter_relevant_listings(spark, d):
    rows = td.table(spark, d, "documents").selectExpr(
        "doc_id",
        "array('painting', CASE doc_id % 4 WHEN 0 THEN 'Photography' WHEN 1 THEN '写真展' ELSE 'film' END) AS categories",
        "CASE doc_id % 5 WHEN 2 THEN 'https://g.example.org/access/' WHEN 3 THEN concat('https://g.example.org/movie/', doc_id) ELSE concat('https://g.example.org/show-', doc_id, '/') END AS url",
        "IF(doc_id % 5 = 4, 'Coming Soon', concat('Show ', doc_id)) AS title",
        "concat(text, ' 2026. 5. 19') AS block",
    )
    kept = extract.relevant_categories(rows).filter(extract.listing_page(F.col("url"), F.col("title"), F.col("block")))
    return kept.select("doc_id")


@query(
    "lookup_space_code",
    "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'KT&G 상상마당 춘천 갤러리' ELSE 'KT&G 상상마당 홍대 갤러리' END AS venue, CASE s_suppkey % 4 WHEN 0 THEN '강원도' ELSE '서울' END AS region FROM supplier",
)
def lookup_space_code(spark, d):
    code = F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'CC' WHEN 1 THEN 'HD' WHEN 2 THEN 'XX' END")
    code = F.coalesce(code, F.lit(extract.DEFAULT_SPACE))
    return td.table(spark, d, "supplier").select("s_suppkey", extract.space_venue(code).alias("venue"), extract.space_region(code).alias("region"))


@query(
    "source_health",
    sql(
        "o",
        """SELECT r.source, CAST(CASE WHEN r.source = 'pgi' THEN 0 ELSE coalesce(n, 0) END AS BIGINT) AS n, CASE WHEN r.source IN ('koba', 'pgi') THEN 'FAIL' WHEN n > 0 THEN 'ok' ELSE 'empty' END AS health
        FROM (SELECT unnest(['art_space_j', 'artmap', 'canon_gallery', 'fujifilm_square', 'gallery_bresson', 'gallery_kong', 'gallery_lux', 'gallery_now', 'gallery_tosei', 'goeun', 'ilwoo_space',
        'koba', 'museum_hanmi', 'pgi', 'photo_sema', 'place_m', 'ryugaheon', 'sangsangmadang', 'tokyo_art_beat', 'tokyo_photographic_art_museum', 'totem_pole', 'zen_foto']) AS source) r
        LEFT JOIN (SELECT source, count(*) AS n FROM o GROUP BY source) c ON r.source = c.source""",
    ),
)
def source_health(spark, d):
    failures = spark.createDataFrame([("koba", "timeout"), ("pgi", "selector")], "source STRING, failure STRING")
    out = extract.source_health(schemas.source_registry(spark), td.raw_listings(spark, d), failures)
    return out.select("source", "n", "health")


@query(
    "scan_raw_listings",
    sql(
        "n",
        """SELECT seq, source, source_url, title AS clean_title, venue_name, CAST(len(artist_names) AS BIGINT) AS n_artists FROM n""",
    ),
)
def scan_raw_listings(spark, d):
    path = shared_dir(spark, "raw")
    td.raw_listings(spark, d).write.json(path)
    raw = tables.scan_raw_listings(spark, path, "json")
    return raw.select(
        "seq", "source", "source_url", F.nullif(text.clean_whitespace(F.col("raw.title")), F.lit("")).alias("clean_title"),
        F.trim("raw.venue_name").alias("venue_name"), F.size("raw.artists").cast("long").alias("n_artists"),
    )


@query(
    "scan_canonical",
    sql("x", "SELECT id, seq, CASE WHEN medium = 'photo' THEN 'Edited' ELSE title END AS title, strftime(start_date, '%Y-%m-%d') AS start_date FROM x"),
)
def scan_canonical(spark, d):
    """Two deltas of one table: the base, then edited rows; the last delta of an id wins."""
    root = shared_dir(spark, "canonical")
    names = StructType.fromDDL(schemas.EXHIBITIONS).names
    base = td.exhibitions(spark, d).select(*names)
    tables.reset_table(spark, root, "exhibitions")
    tables.write_delta(base, root, "exhibitions", 0)
    tables.write_delta(base.filter("medium = 'photo'").withColumn("title", F.lit("Edited")), root, "exhibitions", 1)
    rows = tables.scan_canonical(spark, root, "exhibitions")
    return rows.select("id", "seq", "title", F.col("start_date").cast("string").alias("start_date"))


@query(
    "quarantine_malformed",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'missing_name' WHEN s_suppkey % 7 = 1 THEN 'bad_timestamp' WHEN s_suppkey % 7 = 2 THEN 'bad_venue_type' WHEN s_suppkey % 7 = 3 THEN 'bad_latitude' END AS reason,
    CASE WHEN s_suppkey % 7 > 3 THEN 'other' END AS venue_type, CASE WHEN s_suppkey % 7 > 3 THEN 'KR' END AS country, CASE WHEN s_suppkey % 7 > 3 THEN CAST(s_suppkey AS DOUBLE) END AS latitude FROM supplier""",
)
def quarantine_malformed(spark, d):
    rows = td.table(spark, d, "supplier").selectExpr(
        "CAST(s_suppkey AS STRING) AS id", "IF(s_suppkey % 7 = 0, ' ', s_name) AS name",
        "IF(s_suppkey % 7 = 1, '', '2026-01-01T00:00:00+00:00') AS first_seen_at", "'2026-01-01T00:00:00' AS updated_at",
        "IF(s_suppkey % 7 = 2, 'barn', '') AS venue_type", "IF(s_suppkey % 7 = 3, 'north', CAST(s_suppkey AS STRING)) AS latitude", "'' AS country",
    )
    good, bad = schemas.quarantine(rows, "venues")
    key = F.col("id").cast("long").alias("s_suppkey")
    return good.select(key, F.lit(None).cast("string").alias("reason"), "venue_type", "country", "latitude").unionByName(
        bad.select(
            key, "reason", F.lit(None).cast("string").alias("venue_type"), F.lit(None).cast("string").alias("country"),
            F.lit(None).cast("double").alias("latitude"),
        )
    )


@query(
    "append_rows",
    sql("x o", "SELECT id, title FROM x UNION ALL SELECT 'n' || seq, 'New ' || seq FROM o"),
)
def append_rows(spark, d):
    fresh = td._orders(spark, d).selectExpr("concat('n', seq) AS id", "concat('New ', seq) AS title")
    return merge.append_rows(td.exhibitions(spark, d), fresh).select("id", "title")


@query(
    "patch_rows",
    sql("x", "SELECT id, CASE WHEN status = 'past' THEN 'Closed ' || seq ELSE title END AS title, medium FROM x"),
)
def patch_rows(spark, d):
    base = td.exhibitions(spark, d)
    patch = base.filter("status = 'past'").selectExpr("id", "concat('Closed ', seq) AS title")
    return merge.checked_patch(base, patch, ["id"]).select("id", "title", "medium")


@query("reset_table", sql("x", "SELECT count(*) AS rows_before, CAST(0 AS BIGINT) AS rows_after, CAST(31 AS BIGINT) AS columns FROM x"))
def reset_table(spark, d):
    root = shared_dir(spark, "reset")
    names = StructType.fromDDL(schemas.EXHIBITIONS).names
    before = materialize(td.exhibitions(spark, d).select(*names), tables.delta_path(root, "exhibitions", 0)).count()
    tables.reset_table(spark, root, "exhibitions")
    after = tables.scan_canonical(spark, root, "exhibitions")
    return after.agg(
        F.lit(before).cast("long").alias("rows_before"), F.count(F.lit(1)).alias("rows_after"),
        F.lit(len(after.columns)).cast("long").alias("columns"),
    )


@query("evolve_schema", sql("x", "SELECT id, title, CAST(NULL AS VARCHAR) AS lang FROM x"))
def evolve_schema(spark, d):
    old = td.exhibitions(spark, d).select("id", "title")
    return schemas.evolve(old, StructType.fromDDL("id STRING, title STRING, lang STRING"))


@query(
    "extract_site_listings",
    """SELECT CASE page_id % 3 WHEN 0 THEN 'gallery_lux' WHEN 1 THEN 'canon_gallery' ELSE 'museum_hanmi' END AS source,
    CASE page_id % 3 WHEN 0 THEN 'https://gallerylux.net/s/' || page_id WHEN 1 THEN 'https://kr.canon/canongallery/view?gllyDispSeq=' || page_id
      ELSE 'https://museumhanmi.or.kr/post_exhibition/' || page_id || '/' END AS source_url,
    'Show ' || page_id AS title, '2026.05.19 ~ 2026.06.' || (10 + page_id % 20) AS date_range,
    CASE page_id % 3 WHEN 0 THEN '갤러리 룩스' WHEN 1 THEN '캐논 갤러리' ELSE 'Branch ' || page_id % 4 END AS venue_name,
    CASE WHEN page_id % 3 = 0 THEN 'Kim ' || page_id END AS artists,
    CASE WHEN page_id % 3 > 0 AND page_id % 2 = 0 THEN 'Notes on show ' || page_id || repeat(' and more of them', 4) END AS description FROM pages""",
)
def extract_site_listings(spark, d):
    """Every page of the table as the list page of one of three sites, every second show with a detail page, all through the shipped rules."""
    day = "concat('2026.05.19 ~ 2026.06.', 10 + page_id % 20)"
    lists = td.table(spark, d, "pages").selectExpr(
        "page_id",
        "CASE page_id % 3 WHEN 0 THEN 'https://gallerylux.net/archive/' WHEN 1 THEN 'https://kr.canon/canongallery/list/ajax' ELSE 'https://museumhanmi.or.kr/exhibition/' END AS url",
        f"""CASE page_id % 3
          WHEN 0 THEN concat('<article><a href="https://gallerylux.net/s/', page_id, '"><div class="title">Show ', page_id, '</div><div class="artist-name">Kim ', page_id, '</div><div class="date">', {day}, '</div></a></article>', html)
          WHEN 1 THEN concat('<a class="masonry-item" href="/canongallery/view?gllyDispSeq=', page_id, '"><div class="txt"><p>Show ', page_id, '</p></div><div class="info-list"><p>', {day}, '</p></div></a>', html)
          ELSE concat('<a class="item row gap-1r" href="https://museumhanmi.or.kr/post_exhibition/', page_id, '/"><h6 class="bold">Branch ', page_id % 4, '</h6><h4>Show ', page_id, '</h4><h6 class="text-sub">', {day}, '</h6></a>', html) END AS html""",
    )
    prose = "concat('<p>Notes on show ', page_id, repeat(' and more of them', 4), '</p>')"
    details = td.table(spark, d, "pages").filter("page_id % 3 > 0 AND page_id % 2 = 0").selectExpr(
        "page_id",
        "IF(page_id % 3 = 1, concat('https://kr.canon/canongallery/view?gllyDispSeq=', page_id), concat('https://museumhanmi.or.kr/post_exhibition/', page_id, '/')) AS url",
        f"IF(page_id % 3 = 1, concat('<div class=\"mid-cont\">', {prose}, '</div>'), concat('<div class=\"row\">', {prose}, '</div>')) AS html",
    )
    # The table's own markup may hold articles or links of its own; those have no title or address of these sites.
    rows = sites.site_listings(lists.unionByName(details), sites.site_rules(spark))
    return rows.select(
        "source", "source_url", "raw.title", "raw.date_range", "raw.venue_name", F.array_join("raw.artists", ",").alias("artists"), "raw.description"
    )
