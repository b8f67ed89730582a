"""Golden rows of the column functions."""

from __future__ import annotations

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from listingmill.functions import classify, dates, geo, keys, text, translations, urls, values

D = datetime.date


def test_single_dates(one):
    cases = {
        "2026.05.19": D(2026, 5, 19), "2026-05-19": D(2026, 5, 19), "2026/05/19": D(2026, 5, 19), "2026년 5월 19일": D(2026, 5, 19),
        "May 19, 2026": D(2026, 5, 19), "19 May 2026": D(2026, 5, 19), "2026年12月3日": D(2026, 12, 3), "전시 2026년 5월 10일 (화)": D(2026, 5, 10),
        "Sept. 3, 2026": D(2026, 9, 3), "미정": None, "": None, None: None, "2026.02.30": None, "2026년 13월 1일": None, "May 19": None,
    }
    assert one(cases, dates.parse_date) == list(cases.values())


RANGES = [
    ("2026.05.19 ~ 2026.10.25", D(2026, 5, 19), D(2026, 10, 25)),
    ("2026-05-19 - 2026-10-25", D(2026, 5, 19), D(2026, 10, 25)),
    ("2026.05.19 ~ 미정", D(2026, 5, 19), None),
    ("2026.05.22. 금 ~ 2026.09.30. 수", D(2026, 5, 22), D(2026, 9, 30)),
    ("2026. 06. 01. 월 ~ 2026. 07. 15. 화", D(2026, 6, 1), D(2026, 7, 15)),
    ("2026.03.27. 금 ~ 2026.07.19. 일", D(2026, 3, 27), D(2026, 7, 19)),
    ("2026年5月10日 ～ 2026年7月3日", D(2026, 5, 10), D(2026, 7, 3)),
    ("2026/5/10〜2026/7/3", D(2026, 5, 10), D(2026, 7, 3)),
    ("May 10 – Jul 3, 2026", D(2026, 5, 10), D(2026, 7, 3)),
    ("2025년 5월 20일(화) ~ 23일(금)", D(2025, 5, 20), D(2025, 5, 23)),
    ("2025년 5월 20일 ~ 6월 3일", D(2025, 5, 20), D(2025, 6, 3)),
    ("2025年5月20日 ～ 23日", D(2025, 5, 20), D(2025, 5, 23)),
    ("Oct 15 ~ 30 , 2021", D(2021, 10, 15), D(2021, 10, 30)),
    ("Oct 15 ~ 30, 2021", D(2021, 10, 15), D(2021, 10, 30)),
    ("2021. 6. 4 - 7. 2", D(2021, 6, 4), D(2021, 7, 2)),
    ("2020.12. 3 - 12. 24", D(2020, 12, 3), D(2020, 12, 24)),
    ("2019. 10. 4 - 11. 3", D(2019, 10, 4), D(2019, 11, 3)),
    ("2020. 12. 30 - 1. 5", D(2020, 12, 30), D(2021, 1, 5)),
    ("2020. 12. 30 - 2. 29", D(2020, 12, 30), None),
    ("2026.05.19", D(2026, 5, 19), D(2026, 5, 19)),
    ("미정", None, None),
    ("", None, None),
    (None, None, None),
]


def test_date_ranges(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RANGES)], "i int, raw string")
    got = {r.i: (r.start_date, r.end_date) for r in dates.with_date_range(df, F.col("raw")).collect()}
    for i, (raw, start, end) in enumerate(RANGES):
        assert got[i] == (start, end), raw


def test_spans_in_text(one):
    assert one(["기간 2026. 5. 19(화) ~ 6. 1 장소", "2026.5.19 - 28", "2026.13.1 ~ 2026.14.1", "none"], dates.extract_date_range) == [
        "2026.05.19~2026.06.01", "2026.05.19~2026.05.28", None, None,
    ]
    assert one(["2026年5月1日(金) － 6月2日(土)", "2026年5月1日-2027年1月2日", "x"], dates.extract_japanese_date_range) == [
        "2026.05.01~2026.06.02", "2026.05.01~2027.01.02", None,
    ]
    assert one(["2026年5月1日（金）～5月9日（土）", "2026年5月1日～2027年1月2日"], dates.backfill_range_year) == ["2026年5月1日～2026年5月9日", "2026年5月1日～2027年1月2日"]


def test_status_and_countdown(spark):
    today = D(2026, 6, 1)
    rows = [(None, None), (D(2026, 6, 2), None), (D(2026, 5, 1), D(2026, 5, 31)), (D(2026, 5, 1), None), (D(2026, 6, 1), D(2026, 6, 1)), (D(2026, 5, 1), D(2026, 6, 8))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s date, e date").orderBy("i")
    out = df.select(
        dates.compute_status(today, F.col("s"), F.col("e")), dates.dday_label(F.col("e"), today), dates.is_closing_soon(F.col("e"), today)
    ).collect()
    assert [tuple(r) for r in out] == [
        ("unknown", None, False), ("upcoming", None, False), ("past", None, False), ("ongoing", None, False), ("ongoing", "D-day", True), ("ongoing", "D-7", True),
    ]


def test_iso_week_crosses_the_year(one):
    assert one([D(2027, 1, 1), D(2026, 12, 31), D(2026, 1, 5)], dates.iso_week, "date") == ["2026-W53", "2026-W53", "2026-W02"]


def test_clean_and_sanitize(one):
    assert one(["　a ​ b\n\tc ", " x", None], text.clean_whitespace) == ["a b c", "x", None]
    dirty = "<!-- <script>x</script>\n-->본문 <패 : FAIT>\n\n\n\n끝 이메일: a.b@c.co.kr <style>p{}</style>\t 더"
    assert one([dirty, None, "Email：x@y.io 안녕", "see x@y.io"], text.sanitize_description) == [
        "본문 <패 : FAIT>\n\n끝 더", "", "안녕", "see",
    ]
    assert one([" a \n\n  b \r\n c"], text.clean_cell_lines) == ["a\nb\nc"]
    assert one(["\n\n a  b\n\n\n\nc\n"], text.clean_paragraph_lines) == ["a b\n\nc"]


def test_name_folding(one):
    import unicodedata

    cases = [unicodedata.normalize("NFD", "홍길동 "), "Kim, Ｊane!", " A_B-c ", "…", "²½"]
    expected = ["홍길동", "kim ｊane", "a_bc", "", "²½"]
    assert one(cases, text.normalize_name) == expected
    assert one(["(04524) 서울특별시 중구", "제주특별자치도  제주시"], text.normalize_address) == ["서울 중구", "제주 제주시"]


def test_title_keys_and_splits(one):
    assert one(["《봄》 \"전\"", None], text.dedup_title_key) == ["봄전", ""]
    assert one(["写真展「 Sun burn」東京", "Sunburn", "『』", None], text.core_title_key) == ["sunburn", "sunburn", "", ""]
    assert one(["山田 写真展「光」", "無題", "「 」"], lambda c: text.split_artist_title(c)["title"]) == ["光", "無題", "「 」"]
    assert one(["山田 写真展「光」", "無題"], lambda c: text.split_artist_title(c)["artist"]) == ["山田", None]
    assert one(["a、 b，,c, "], text.split_artist_roster) == [["a", "b", "c"]]
    assert one(["[CUBE1] 전시_2026. 5. 19 ~", "[전시 1관] 가 ..", "A | SITE"], text.clean_listing_title) == ["전시", "가", "A"]
    assert one(["<p>a &amp;lt; b</p>&nbsp;<br>c"], text.strip_markup) == ["a &lt; b c"]


def test_classifiers(one):
    assert one(["사진과 영상", "Camera expo", "미디어", "PHOTO", "회화", None], classify.map_medium) == ["mixed", "gear", "video", "photo", "mixed", "mixed"]
    kind = lambda t, title, n: lambda c: classify.map_exhibition_type(F.lit(t), F.lit(title), F.lit(n).cast("int"))
    assert one(["x"], kind("개인전", None, None)) == ["solo"]
    assert one(["x"], kind("", "山田個展", 5)) == ["solo"]
    assert one(["x"], kind("", "2인전", 1)) == ["group"]
    assert one(["x"], kind("", "Talk show", 2)) == ["group"]
    assert one(["x"], kind(None, None, None)) == ["curated"]
    assert one(["서울시립미술관", "COEX", "카페", "스페이스", "홀"], classify.map_venue_type) == ["museum", "convention", "cafe", "alt_space", "other"]
    assert one(["사진재단", "협회", "Ltd", "구청", "x"], classify.map_organizer_type) == ["foundation", "association", "corporate", "public", "other"]
    assert one(["https://x/Coming_Soon.jpg", "https://x/a.jpg", None], classify.drop_placeholder_image) == [None, "https://x/a.jpg", None]
    assert one(["한글 写真", "世田谷", "カメラ", "plain"], classify.detect_lang) == ["ko", "ja", "ja", "en"]


def test_keys_keep_empty_parts(spark):
    row = spark.range(1).select(
        keys.exhibition_id(F.lit("pgi"), F.lit(None).cast("string"), F.lit("t"), F.lit(None).cast("date")), keys.venue_id(F.lit("V")),
        keys.venue_id(F.lit("V"), F.lit("addr")), keys.artist_id(F.lit("a")),
    ).first()
    digest = [hashlib.sha1(s.encode()).hexdigest()[:12] for s in ("pgi||t|", "venue:name|V", "venue:addr|addr", "artist|a")]
    assert list(row) == digest


def test_geo(spark):
    km = spark.range(1).select(geo.haversine_km(F.lit(126.978), F.lit(37.5665), F.lit(129.0756), F.lit(35.1796))).first()[0]
    assert abs(km - 325.1) < 0.5


def test_region_buckets(one):
    got = one(["서울", "인천", "제주", "大阪府", "京都府", "新宿、四ツ谷", "北海道", "", None], geo.region_bucket)
    assert [g and (g.country, g.city) for g in got] == [
        ("한국", "서울"), ("한국", "경기·인천"), ("한국", "한국 기타"), ("일본", "오사카"), ("일본", "교토"), ("일본", "도쿄"), ("일본", "일본 기타"), None, None,
    ]


def test_urls(one):
    assert one(["//a/b", "/c", "http://d", "e"], lambda c: urls.absolutise_url(c, "h.org")) == ["https://a/b", "https://h.org/c", "http://d", None]
    keep = lambda c: urls.keep_query_params(c, {"boardid": "exhib", "mode": "view", "idx": None}, "idx")
    assert one(["https://s/v.php?idx=9&PHPSESSID=1&mode=view", "https://s/v.php?idx=x"], keep) == ["https://s/v.php?boardid=exhib&mode=view&idx=9", None]
    label = lambda c: urls.source_label(F.lit(None).cast("string"), c)
    assert one(["https://www.pgi.ac/x", "https://www.other.org/", None, "nonsense"], label) == ["PGI", "other.org", None, None]


def test_translations(spark, one):
    stored = ['{"en": {"title": "T", "description": "<!--x-->d"}, "ja": 3}', "{bad", None, '{"en": {"description": "a@b.io"}}']
    got = one(stored, lambda c: translations.parse_translation_map(c, ("title", "description")))
    assert got == [{"en": {"title": "T", "description": "d"}}, {}, {}, {}]
    tr = F.create_map(F.lit("en"), F.create_map(F.lit("title"), F.lit("T")))
    assert one(["T", "원제"], lambda c: translations.localized(c, tr, "en", "title")) == [None, "T"]
    assert one(["원제"], lambda c: translations.in_locale(c, tr, "ja", "title")) == ["원제"]


def test_prices(one):
    def parsed(v):
        r = one([v], values.parse_price_table)[0]
        return r.price_min, r.price_max, [(t.label, t.amount) for t in r.breakdown or []], r.notes, r.fee_text

    assert parsed("성인: 10,000원\n· 청소년: 8,000 원\n단체 20% 할인") == (8000, 10000, [("성인", 10000), ("청소년", 8000)], "단체 20% 할인", None)
    assert parsed("성인/청소년 10,000원/8,000원\n어린이: 무료") == (0, 10000, [("기본", 10000), ("어린이", 0)], None, None)
    assert parsed("무료") == (0, 0, [("기본", 0)], None, None)
    assert parsed("문의") == (None, None, [], None, "문의")


def test_feedback(spark):
    img = "array<struct<filename:string,type:string,dataBase64:string>>"
    big = "A" * (7 * 1024 * 1024)
    rows = [
        ("bug", "hi", "a@b.co", None, None), ("spam", "hi", "a@b.co", None, "invalid type"), ("bug", "  ", "a@b.co", None, "invalid message"),
        ("bug", "x" * 2001, "a@b.co", None, "invalid message"), ("bug", "x", "a b@c.d", None, "invalid email"),
        ("bug", "x", "a@b.co", [("f", "image/png", "QQ==")] * 4, "too many images"), ("bug", "x", "a@b.co", [("f", "image/gif", "QQ==")], "invalid image type"),
        ("bug", "x", "a@b.co", [("f", "image/png", big)], "image too large"), ("bug", "x", "a@b.co", [(None, "image/png", "QQ==")], "invalid image"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, k string, m string, e string, p {img}, want string").orderBy("i")
    for r in df.select("i", "want", values.validate_feedback(F.col("k"), F.col("m"), F.col("e"), F.col("p")).alias("got")).collect():
        assert r.got == r.want, rows[r.i][:3]


@pytest.mark.parametrize("raw,year,decade", [("A · 2019", 2019, 2010), ("1899–1901", 1899, 1890), ("n.d.", 0, 0), ("12019", 0, 0)])
def test_credit_years(one, raw, year, decade):
    assert one([raw], values.year_of) == [year]
    assert one([raw], lambda c: values.decade_of(values.year_of(c))) == [decade]
