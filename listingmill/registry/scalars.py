"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmill.functions import classify, dates, geo, keys, text, translations, urls, values
from listingmill.registry.base import query, sql
from listingmill.sources import testdata as td

WS = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]+"
ORNAMENTS = r"[《》「」『』\"''“”‘’()\[\]\s\p{Z}\x0b]"


def q_clean(e: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({e}, '[\x{{200b}}-\x{{200d}}\x{{feff}}]', '', 'g'), '{WS}', ' ', 'g'))"


# The references that the test tables can hold; the ampersand goes last.
Q_ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#34;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&nbsp;": " ", "&#160;": " ", "&copy;": "©",
    "&hellip;": "…", "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&amp;": "&",
}


def q_entities(e: str) -> str:
    for entity, char in Q_ENTITIES.items():
        e = f"replace({e}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return e


def q_strip_markup(e: str) -> str:
    return q_clean(q_entities(f"regexp_replace({e}, '<[^>]+>', ' ', 'g')"))


def docs(spark, d) -> DataFrame:
    return td.texts(spark, d, "documents")


@query(
    "clean_whitespace",
    f"SELECT doc_id, {q_clean('''chr(12288) || ' ' || text || chr(8203) || '  x ' ''')} AS cleaned FROM documents",
)
def clean_whitespace(spark, d):
    messy = F.concat(F.lit("　 "), F.col("text"), F.lit("​  x "))
    return docs(spark, d).select("doc_id", text.clean_whitespace(messy).alias("cleaned"))


@query(
    "clean_multiline",
    f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda l: regexp_replace(l, '^{WS}|{WS}$', '', 'g')), lambda l: l <> ''), chr(10)) AS cell,
    regexp_replace(regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda l: {q_clean('l')}), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') AS description
    FROM (SELECT doc_id, '  ' || text || chr(10) || ' ' || chr(10) || chr(10) || ' end  of it ' AS t FROM documents)""",
)
def clean_multiline(spark, d):
    t = F.concat(F.lit("  "), F.col("text"), F.lit("\n \n\n end  of it "))
    return docs(spark, d).select(
        "doc_id", text.clean_cell_lines(t).alias("cell"), text.clean_paragraph_lines(t).alias("description")
    )


_EMAIL = r"[\p{L}\p{N}_.%+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}"


@query(
    "sanitize_description",
    rf"""WITH t AS (SELECT doc_id, '<!-- c' || chr(10) || ' --><script>x()</script>' || text || ' <패 : FAIT> E-mail: someone@example.org  end' AS t FROM documents),
    s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[\x{{200b}}-\x{{200d}}\x{{feff}}]', '', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
      '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g') AS t FROM t),
    e AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)[\s\p{{Z}}]*(?:이메일|메일|e-?mail)[\s\p{{Z}}]*[:：]?[\s\p{{Z}}]*{_EMAIL}', ' ', 'g'), '{_EMAIL}', ' ', 'g') AS t FROM s)
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[\t\f\r\x0b \p{{Z}}]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS clean FROM e""",
)
def sanitize_description(spark, d):
    t = F.concat(F.lit("<!-- c\n --><script>x()</script>"), F.col("text"), F.lit(" <패 : FAIT> E-mail: someone@example.org  end"))
    return docs(spark, d).select("doc_id", text.sanitize_description(t).alias("clean"))


@query(
    "normalize_name",
    rf"""SELECT doc_id, lower(trim(regexp_replace(regexp_replace({q_clean("nfc_normalize(text)")}, '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', '', 'g'), '{WS}', ' ', 'g'))) AS name FROM documents""",
)
def normalize_name(spark, d):
    return docs(spark, d).select("doc_id", text.normalize_name(F.col("text")).alias("name"))


@query(
    "normalize_address",
    r"""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '서울 중구 ' || s_suppkey WHEN 1 THEN '세종 ' || s_suppkey WHEN 2 THEN '부산 ' || s_suppkey ELSE '제주 ' || s_suppkey END AS address FROM supplier""",
)
def normalize_address(spark, d):
    raw = F.expr(
        """concat(IF(s_suppkey % 2 = 0, '(04524) ', ''), CASE s_suppkey % 4 WHEN 0 THEN '서울특별시  중구 ' WHEN 1 THEN '세종특별자치시 '
           WHEN 2 THEN '부산광역시  ' ELSE '제주특별자치도 ' END, s_suppkey, ' ')"""
    )
    return td.table(spark, d, "supplier").select("s_suppkey", text.normalize_address(raw).alias("address"))


@query(
    "natural_keys",
    sql(
        "x",
        """SELECT seq, sha1(source || '|' || venue_id || '|' || title || '|' || coalesce(strftime(start_date, '%Y-%m-%d'), ''))[1:12] AS exhibition_key,
        sha1('artist|' || title)[1:12] AS artist_key, sha1('organizer|' || title)[1:12] AS organizer_key,
        CASE WHEN seq % 3 = 0 THEN sha1('venue:name|' || venue_id)[1:12] ELSE sha1('venue:addr|' || source_url)[1:12] END AS venue_key FROM x""",
    ),
)
def natural_keys(spark, d):
    c = F.col
    address = F.when(c("seq") % 3 != 0, c("source_url"))
    return td.exhibitions(spark, d).select(
        "seq",
        keys.exhibition_id(c("source"), c("venue_id"), c("title"), c("start_date")).alias("exhibition_key"),
        keys.artist_id(c("title")).alias("artist_key"),
        keys.organizer_id(c("title")).alias("organizer_key"),
        keys.venue_id(c("venue_id"), address).alias("venue_key"),
    )


@query(
    "parse_date",
    sql("o", "SELECT seq, CASE WHEN seq % 7 <> 6 THEN strftime(day, '%Y-%m-%d') END AS parsed FROM o"),
)
def parse_date(spark, d):
    notation = F.expr(
        """CASE seq % 7 WHEN 0 THEN date_format(day, 'yyyy.MM.dd') WHEN 1 THEN date_format(day, 'yyyy-M-d (E)')
           WHEN 2 THEN concat('기간 ', year(day), '년 ', month(day), '월 ', day(day), '일') WHEN 3 THEN concat(year(day), '年', month(day), '月', day(day), '日')
           WHEN 4 THEN date_format(day, 'MMMM d, yyyy') WHEN 5 THEN date_format(day, 'd MMM yyyy') ELSE concat(year(day), '.2.30') END"""
    )
    rows = td._orders(spark, d).select("seq", notation.alias("raw"))
    return rows.select("seq", dates.parse_date(F.col("raw")).cast("string").alias("parsed"))


@query(
    "parse_date_range",
    sql(
        "n",
        "SELECT seq, strftime(start_date, '%Y-%m-%d') AS start_date, strftime(end_date, '%Y-%m-%d') AS end_date FROM n",
    ),
)
def parse_date_range(spark, d):
    rows = dates.with_date_range(td.dealt(td.raw_listings(spark, d).select("seq", "raw.date_range")), F.col("date_range"))
    return rows.select("seq", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"))


@query(
    "extract_date_range",
    sql(
        "o",
        """SELECT seq, CASE WHEN seq % 4 = 3 THEN NULL WHEN seq % 4 = 2 THEN strftime(day, '%Y.%m.%d') || '~' || strftime(day, '%Y.%m') || '.28'
        ELSE strftime(day, '%Y.%m.%d') || '~' || strftime(day + INTERVAL 9 DAY, '%Y.%m.%d') END AS span FROM o""",
    ),
)
def extract_date_range(spark, d):
    body = F.expr(
        """concat('전시 기간: ', year(day), '. ', month(day), ' . ', day(day), '.(목) ', CASE seq % 4
           WHEN 0 THEN concat('~ ', year(date_add(day, 9)), '. ', month(date_add(day, 9)), '. ', day(date_add(day, 9)))
           WHEN 1 THEN concat('- ', month(date_add(day, 9)), '.', day(date_add(day, 9))) WHEN 2 THEN '〜 28' ELSE ' only' END, ' 장소')"""
    )
    return td._orders(spark, d).select("seq", dates.extract_date_range(body).alias("span"))


@query(
    "extract_jp_date_range",
    sql(
        "o",
        """SELECT seq, CASE WHEN seq % 3 = 2 THEN strftime(day, '%Y.%m.%d') || '~' || strftime(day, '%Y.%m') || '.28'
        ELSE strftime(day, '%Y.%m.%d') || '~' || strftime(day + INTERVAL 9 DAY, '%Y.%m.%d') END AS span FROM o""",
    ),
)
def extract_jp_date_range(spark, d):
    body = F.expr(
        """concat('会期：', year(day), '年', month(day), '月', day(day), '日(金) - ', CASE seq % 3
           WHEN 0 THEN concat(year(date_add(day, 9)), '年', month(date_add(day, 9)), '月', day(date_add(day, 9)), '日')
           WHEN 1 THEN concat(month(date_add(day, 9)), '月', day(date_add(day, 9)), '日') ELSE '28日' END)"""
    )
    return td._orders(spark, d).select("seq", dates.extract_japanese_date_range(body).alias("span"))


@query(
    "backfill_range_year",
    sql(
        "o",
        """SELECT seq, CASE WHEN seq % 3 = 2 THEN year(day) || '年' || month(day) || '月' || day(day) || '日'
        WHEN seq % 3 = 0 THEN year(day) || '年' || month(day) || '月' || day(day) || '日～' || year(day) || '年12月1日'
        ELSE year(day) || '年' || month(day) || '月' || day(day) || '日～' || (year(day) + 1) || '年1月2日' END AS filled FROM o""",
    ),
)
def backfill_range_year(spark, d):
    raw = F.expr(
        """concat(year(day), '年', month(day), '月', day(day), '日（木）', CASE seq % 3 WHEN 0 THEN '～12月1日（水）' WHEN 1 THEN concat('～', year(day) + 1, '年1月2日') ELSE '' END)"""
    )
    return td._orders(spark, d).select("seq", dates.backfill_range_year(raw).alias("filled"))


_WORDS = """CASE seq % 12 WHEN 0 THEN '사진 영상' WHEN 1 THEN 'Camera fair' WHEN 2 THEN 'VIDEO art' WHEN 3 THEN 'Photo' WHEN 4 THEN '개인전' WHEN 5 THEN 'Group show'
 WHEN 6 THEN 'festival' WHEN 7 THEN '상설 전시' WHEN 8 THEN '기획전' WHEN 9 THEN '미술관 재단' WHEN 10 THEN 'COEX 갤러리' ELSE '' END"""


def worded(spark, d) -> DataFrame:
    return td._orders(spark, d).selectExpr("*", f"{_WORDS} AS word")


@query(
    "map_medium",
    sql("o", "SELECT seq, CASE seq % 12 WHEN 0 THEN 'mixed' WHEN 1 THEN 'gear' WHEN 2 THEN 'video' WHEN 3 THEN 'photo' ELSE 'mixed' END AS medium FROM o"),
)
def map_medium(spark, d):
    return worded(spark, d).select("seq", classify.map_medium(F.col("word")).alias("medium"))


@query(
    "map_exhibition_type",
    sql(
        "o",
        """SELECT seq, CASE WHEN seq % 12 = 1 THEN 'expo' WHEN seq % 12 = 4 THEN 'solo' WHEN seq % 12 = 5 THEN 'group' WHEN seq % 12 = 6 THEN 'festival' WHEN seq % 12 = 7 THEN 'permanent'
        WHEN seq % 12 = 8 THEN 'curated' WHEN seq % 5 = 0 THEN 'solo' WHEN seq % 5 = 1 THEN 'group' WHEN seq % 4 = 1 THEN 'solo' WHEN seq % 4 >= 2 THEN 'group' ELSE 'curated' END AS kind FROM o""",
    ),
)
def map_exhibition_type(spark, d):
    title = F.expr("CASE seq % 5 WHEN 0 THEN '山田 個展' WHEN 1 THEN '그룹전 A' ELSE 'Solo walk' END")
    count = F.expr("nullif(seq % 4, 0)")
    return worded(spark, d).select("seq", classify.map_exhibition_type(F.col("word"), title, count).alias("kind"))


@query(
    "map_venue_type",
    sql("o", "SELECT seq, CASE WHEN seq % 12 = 9 THEN 'museum' WHEN seq % 12 = 10 THEN 'gallery' ELSE 'other' END AS kind FROM o"),
)
def map_venue_type(spark, d):
    return worded(spark, d).select("seq", classify.map_venue_type(F.col("word")).alias("kind"))


@query(
    "map_organizer_type",
    sql("o", "SELECT seq, CASE WHEN seq % 12 = 9 THEN 'museum' WHEN seq % 12 = 10 THEN 'gallery' WHEN seq % 3 = 0 THEN 'association' WHEN seq % 3 = 1 THEN 'corporate' ELSE 'other' END AS kind FROM o"),
)
def map_organizer_type(spark, d):
    name = F.concat("word", F.expr("CASE seq % 3 WHEN 0 THEN ' 협회' WHEN 1 THEN ' Ltd' ELSE '' END"))
    return worded(spark, d).select("seq", classify.map_organizer_type(name).alias("kind"))


@query(
    "map_fee_type",
    sql(
        "o",
        """SELECT seq, CASE seq % 7 WHEN 0 THEN 'partial' WHEN 1 THEN 'free' WHEN 2 THEN 'partial' WHEN 3 THEN 'paid' WHEN 4 THEN 'free' WHEN 5 THEN 'free' ELSE 'free' END AS fee FROM o""",
    ),
)
def map_fee_type(spark, d):
    t = F.expr("CASE seq % 7 WHEN 0 THEN '일부 유료, 무료' WHEN 1 THEN 'Free entry' END")
    low = F.expr("CASE seq % 7 WHEN 1 THEN 10 WHEN 2 THEN 0 WHEN 3 THEN 100 WHEN 4 THEN 0 WHEN 5 THEN 100 END")
    high = F.expr("CASE seq % 7 WHEN 1 THEN 10 WHEN 2 THEN 100 WHEN 3 THEN 100 WHEN 4 THEN 0 END")
    return worded(spark, d).select("seq", classify.map_fee_type(t, low, high).alias("fee"))


@query("compute_status", sql("x", "SELECT id, status AS computed FROM x"))
def compute_status(spark, d):
    c = F.col
    return td.exhibitions(spark, d).select("id", dates.compute_status(td.TODAY, c("start_date"), c("end_date")).alias("computed"))


@query("days_until", sql("x", "SELECT id, date_diff('day', DATE '1998-07-01', end_date) AS days FROM x"))
def days_until(spark, d):
    return td.exhibitions(spark, d).select("id", dates.days_until(F.col("end_date"), td.TODAY).cast("long").alias("days"))


@query(
    "dday_label",
    sql(
        "x",
        """SELECT id, CASE WHEN end_date = DATE '1998-07-01' THEN 'D-day' WHEN end_date > DATE '1998-07-01' THEN 'D-' || date_diff('day', DATE '1998-07-01', end_date) END AS label FROM x""",
    ),
)
def dday_label(spark, d):
    return td.exhibitions(spark, d).select("id", dates.dday_label(F.col("end_date"), td.TODAY).alias("label"))


@query(
    "is_closing_soon",
    sql("x", "SELECT id, coalesce(end_date BETWEEN DATE '1998-07-01' AND DATE '1998-07-08', false) AS closing FROM x"),
)
def is_closing_soon(spark, d):
    return td.exhibitions(spark, d).select("id", dates.is_closing_soon(F.col("end_date"), td.TODAY).alias("closing"))


@query(
    "iso_week",
    "SELECT o_orderkey AS seq, strftime(CAST(o_orderdate AS DATE), '%G-W%V') AS week FROM orders",
)
def iso_week(spark, d):
    day = F.col("o_orderdate").cast("date")
    return td.table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), dates.iso_week(day).alias("week"))


@query(
    "haversine_km",
    sql(
        "v",
        """SELECT id, round(2 * 6371 * asin(sqrt(power(sin(radians(lat - 37.57) / 2), 2) + cos(radians(37.57)) * cos(radians(lat)) * power(sin(radians(lng - 126.98) / 2), 2))), 6) AS km FROM v""",
    ),
)
def haversine_km(spark, d):
    km = geo.haversine_km(F.lit(126.98), F.lit(37.57), F.col("longitude"), F.col("latitude"))
    return td.venues(spark, d).select("id", F.round(km, 6).alias("km"))


@query(
    "region_bucket",
    sql("v", "SELECT id, CASE WHEN region IS NOT NULL THEN CASE WHEN region IN ('서울', '부산', '경기', '인천', '강원') THEN '한국' ELSE '일본' END END AS country, city FROM v"),
)
def region_bucket(spark, d):
    return td.venues(spark, d).select("id", geo.region_bucket(F.col("region")).alias("b")).select("id", "b.country", "b.city")


def scripted(spark, d) -> DataFrame:
    return docs(spark, d).selectExpr(
        "doc_id", "concat(text, CASE doc_id % 4 WHEN 0 THEN ' 한글' WHEN 1 THEN ' 世田谷' WHEN 2 THEN ' カメラ' ELSE '' END) AS text"
    )


@query("detect_lang", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'ko' WHEN 1 THEN 'ja' WHEN 2 THEN 'ja' ELSE 'en' END AS lang FROM documents")
def detect_lang(spark, d):
    return scripted(spark, d).select("doc_id", classify.detect_lang(F.col("text")).alias("lang"))


@query(
    "target_locales",
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'en,ja' WHEN 3 THEN 'ko,ja' ELSE 'ko,en' END AS targets FROM documents",
)
def target_locales(spark, d):
    lang = classify.detect_lang(F.col("text"))
    return scripted(spark, d).select("doc_id", F.array_join(classify.target_locales(lang), ",").alias("targets"))


@query(
    "row_lang",
    "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'ja' WHEN doc_id % 5 = 1 THEN 'ko' ELSE CASE doc_id % 4 WHEN 0 THEN 'ko' WHEN 1 THEN 'ja' WHEN 2 THEN 'ja' ELSE 'en' END END AS lang FROM documents",
)
def row_lang(spark, d):
    title = F.expr("CASE WHEN doc_id % 5 = 0 THEN '写真' WHEN doc_id % 5 = 1 THEN ' ' END")
    body = F.expr("CASE WHEN doc_id % 5 > 1 THEN text END")
    return scripted(spark, d).select("doc_id", classify.row_lang([title, body]).alias("lang"))


@query(
    "parse_translation_map",
    f"""SELECT doc_id, CASE WHEN doc_id % 6 IN (1, 2, 3) THEN 'T' || doc_id END AS en_title,
    CASE WHEN doc_id % 6 IN (1, 2) THEN 'see ' || doc_id END AS en_description, CASE WHEN doc_id % 6 = 1 THEN 'J' || doc_id END AS ja_title,
    CAST(CASE doc_id % 6 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS BIGINT) AS buckets FROM documents""",
)
def parse_translation_map(spark, d):
    stored = F.expr(
        """CASE doc_id % 6 WHEN 0 THEN '{bad json' WHEN 1 THEN concat('{"en": {"title": "T', doc_id, '", "description": "see ', doc_id, ' x@example.org"}, "ja": {"title": "J', doc_id, '"}}')
           WHEN 2 THEN concat('{"en": {"title": "T', doc_id, '", "description": "<!-- a -->see ', doc_id, '"}, "ja": 5}')
           WHEN 3 THEN concat('{"en": {"title": "T', doc_id, '", "description": " x@example.org "}}') WHEN 4 THEN '[1]' END"""
    )
    tr = translations.parse_translation_map(stored, ("title", "description"))
    t = translations.tr_text
    return docs(spark, d).select("doc_id", tr.alias("tr")).select(
        "doc_id", t(F.col("tr"), "en", "title").alias("en_title"), t(F.col("tr"), "en", "description").alias("en_description"),
        t(F.col("tr"), "ja", "title").alias("ja_title"), F.size("tr").cast("long").alias("buckets"),
    )


@query(
    "localized_text",
    sql("x", "SELECT id, CASE WHEN tr_en_title <> title THEN tr_en_title END AS localized, coalesce(tr_en_title, title) AS shown FROM x"),
)
def localized_text(spark, d):
    c = F.col
    return td.exhibitions(spark, d).select(
        "id", translations.localized(c("title"), c("tr"), "en", "title").alias("localized"),
        translations.in_locale(c("title"), c("tr"), "en", "title").alias("shown"),
    )


@query(
    "bilingual_text",
    sql("x", "SELECT id, coalesce(tr_ja_title, title) AS first_line, CASE WHEN tr_ja_title <> title THEN title END AS second_line FROM x"),
)
def bilingual_text(spark, d):
    b = translations.bilingual(F.col("title"), translations.tr_text(F.col("tr"), "ja", "title"))
    return td.exhibitions(spark, d).select("id", b.alias("b")).select(
        "id", F.col("b.primary").alias("first_line"), F.col("b.secondary").alias("second_line")
    )


@query(
    "split_csv",
    "SELECT event_id, event_type || '|' || user_id AS parts, CAST(2 AS BIGINT) AS n FROM events",
)
def split_csv(spark, d):
    cell = F.expr("concat(' ', event_type, ' ,, ', user_id, ', ')")
    return td.table(spark, d, "events").select(
        "event_id", F.array_join(text.split_csv(cell), "|").alias("parts"), F.size(text.split_csv(cell)).cast("long").alias("n")
    )


@query(
    "safe_casts",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN event_id END AS as_int, CASE event_id % 5 WHEN 0 THEN CAST(event_id AS DOUBLE) / 2 END AS as_float,
    event_id % 3 = 0 AS as_bool FROM events""",
)
def safe_casts(spark, d):
    i = F.expr("CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(event_id AS STRING) WHEN 2 THEN 'x' END")
    f = F.expr("CASE event_id % 5 WHEN 0 THEN CAST(event_id / 2 AS STRING) WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' WHEN 3 THEN '' END")
    b = F.expr("CASE event_id % 3 WHEN 0 THEN ' true ' WHEN 1 THEN 'FALSE' END")
    return td.table(spark, d, "events").select(
        "event_id", values.int_or_null(i).cast("long").alias("as_int"), values.float_or_null(f).alias("as_float"),
        values.bool_cell(b).alias("as_bool"),
    )


@query(
    "dedup_title_key",
    rf"SELECT doc_id, lower(regexp_replace('《' || text || '》 (x)', '{ORNAMENTS}', '', 'g')) AS title_key FROM documents",
)
def dedup_title_key(spark, d):
    t = F.concat(F.lit("《"), F.col("text"), F.lit("》 (x)"))
    return docs(spark, d).select("doc_id", text.dedup_title_key(t).alias("title_key"))


@query(
    "core_title_key",
    sql("x", "SELECT id, lower(replace(core, ' ', '')) AS core_key FROM x"),
)
def core_title_key(spark, d):
    return td.exhibitions(spark, d).select("id", text.core_title_key(F.col("title")).alias("core_key"))


@query(
    "source_label",
    sql(
        "o",
        """SELECT seq, CASE WHEN seq % 4 = 0 THEN CASE source WHEN 'artmap' THEN 'ARTMAP' WHEN 'tokyo_art_beat' THEN 'Tokyo Art Beat' WHEN 'goeun' THEN '고은사진미술관' WHEN 'pgi' THEN 'PGI' ELSE 'ZEN FOTO GALLERY' END
        WHEN seq % 4 = 1 THEN 'PGI' WHEN seq % 4 = 2 THEN source || '.example.org' END AS label FROM o""",
    ),
)
def source_label(spark, d):
    s = F.expr("IF(seq % 4 = 0, source, IF(seq % 8 = 3, '', NULL))")
    u = F.expr("CASE seq % 4 WHEN 1 THEN concat('https://www.pgi.ac/e/', seq) WHEN 2 THEN concat('https://www.', source, '.example.org/', seq) WHEN 3 THEN 'not a url' END")
    u = F.when(F.col("source").contains("_"), F.replace(u, F.lit("_"), F.lit("-"))).otherwise(u)
    out = urls.source_label(s, u)
    return td._orders(spark, d).select("seq", F.replace(out, F.lit("-"), F.lit("_")).alias("label"))


@query("year_of", sql("scene", "SELECT id, CAST(year AS BIGINT) AS year FROM scene"))
def year_of(spark, d):
    modern, pd = td.scenes(spark, d)
    credit = F.coalesce(F.nullif(F.try_element_at("credit", F.lit("en")), F.lit("")), F.try_element_at("credit", F.lit("ko")))
    return modern.unionByName(pd).select("id", values.year_of(credit).cast("long").alias("year"))


@query("decade_of", sql("scene", "SELECT id, CAST(year // 10 * 10 AS BIGINT) AS decade FROM scene"))
def decade_of(spark, d):
    modern, pd = td.scenes(spark, d)
    credit = F.coalesce(F.nullif(F.try_element_at("credit", F.lit("en")), F.lit("")), F.try_element_at("credit", F.lit("ko")))
    return modern.unionByName(pd).select("id", values.decade_of(values.year_of(credit)).cast("long").alias("decade"))


@query(
    "validate_feedback",
    """SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 9 = 0 THEN 'invalid type' WHEN length(regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) NOT BETWEEN 1 AND 2000 THEN 'invalid message'
    WHEN (conv_id + turn) % 9 = 1 THEN 'invalid email' WHEN (conv_id + turn) % 9 = 2 THEN 'too many images' WHEN (conv_id + turn) % 9 = 3 THEN 'invalid image type' WHEN (conv_id + turn) % 9 = 4 THEN 'invalid image' END AS reason FROM conversations""",
)
def validate_feedback(spark, d):
    n = "(conv_id + turn) % 9"
    kind = F.expr(f"IF({n} = 0, 'praise', 'bug')")
    email = F.expr(f"IF({n} = 1, 'a b@x.org', ' a@x.org ')")
    images = F.expr(
        f"""CASE {n} WHEN 2 THEN array_repeat(named_struct('filename', 'f', 'type', 'image/png', 'dataBase64', 'QQ=='), 4)
            WHEN 3 THEN array(named_struct('filename', 'f', 'type', 'image/gif', 'dataBase64', 'QQ=='))
            WHEN 4 THEN array(named_struct('filename', CAST(NULL AS STRING), 'type', 'image/png', 'dataBase64', 'QQ=='))
            WHEN 5 THEN array(named_struct('filename', 'f', 'type', 'image/png', 'dataBase64', 'QQ==')) END"""
    )
    return td.table(spark, d, "conversations").select(
        "conv_id", "turn", values.validate_feedback(kind, F.col("text"), email, images).alias("reason")
    )


@query(
    "price_label_fields",
    sql(
        "x",
        """SELECT id, CASE WHEN fee_type = 'free' THEN 'free' WHEN price_min > 0 THEN 'from' ELSE 'paid' END AS kind,
        CAST(CASE WHEN fee_type <> 'free' AND price_min > 0 THEN price_min END AS BIGINT) AS amount FROM x""",
    ),
)
def price_label_fields(spark, d):
    p = classify.price_label(F.col("fee_type"), F.col("price_min"))
    return td.exhibitions(spark, d).select("id", p.alias("p")).select("id", "p.kind", F.col("p.amount").cast("long").alias("amount"))
