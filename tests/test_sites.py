"""A golden list and detail page per shipped site rule, and the way from pages to canonical rows."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from listingmill.plans.ingest import State, run_ingest
from listingmill.schemas import SOURCES, TABLES, empty
from listingmill.sources.sites import SITES, site_listings, site_rules

PROSE = "A long enough text about the show, its photographs and the person who made them all."
NESTED = f"<div><div><p>{PROSE[:40]}</p></div><div><p>{PROSE[40:]}</p></div></div>"
NESTED_TEXT = f"{PROSE[:40].strip()}\n\n{PROSE[40:].strip()}"
FEED = '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>blog</title>{}</channel></rss>'


def item(title, number, category, text="", account="x"):
    return f"<item><title>{title}</title><category>{category}</category><link>https://blog.naver.com/{account}/{number}?fromRss=true&amp;a=b</link><description><![CDATA[{text}]]></description></item>"


def state(name, data):
    return '<html><script id="__NEXT_DATA__" type="application/json">' + json.dumps({"props": {"pageProps": {"fallback": {"other": 1, '#name:"x"': {}, f'@"#","name":"{name}",': {"data": data}}}}}) + "</script></html>"


PAGES = {
    "art_space_j": [
        ("http://www.artspacej.com/sub/sub03_01.php?boardid=exhib",
         '<!-- <a href="/sub/sub03_01.php?mode=view&idx=1">old</a> --><table><tr><td><table><tr><td>9</td><td><a href="/sub/sub03_01.php?boardid=exhib&mode=view&idx=7&PHPSESSID=q"><img src="/t.jpg"></a>'
         '<a href="/sub/sub03_01.php?boardid=exhib&mode=view&idx=7&PHPSESSID=q">[CUBE1]김 개인전 <조각 - 어디>2026.05.06-06.30</a></td><td>2026.05.06<br>~<br>2026.06.30</td></tr>'
         '<tr><td>8</td><td><a href="/sub/sub03_01.php?mode=view&idx=--">teaser</a></td></tr></table></td></tr></table>'),
        ("http://www.artspacej.com/sub/sub03_01.php?boardid=exhib&mode=view&idx=7", f'<body><img src="/logo.gif"><img src="/uploaded/board/exhib/p.jpg">{NESTED}</body>'),
        {"title": "김 개인전 <조각 - 어디>", "date_range": "2026.05.06~2026.06.30", "category": "사진", "description": NESTED_TEXT, "poster_image_url": "http://www.artspacej.com/uploaded/board/exhib/p.jpg"},
        "http://www.artspacej.com/sub/sub03_01.php?boardid=exhib&mode=view&idx=7",
    ],
    "artmap": [
        ("https://art-map.co.kr/data/new_exhibition.php",
         "<div><a href='view.php?idx=12'><div><img src='/up/12.jpg'></div><div class='new_exh_list'><span id='t'>《산》</span><br/><span>덕수관/서울</span><br/><span>2026.05.19 ~ 2026.10.25</span></div></a></div>"),
        ("https://art-map.co.kr/exhibition/view.php?idx=12",
         f"<div class='info_wrap'><div><pre>  {PROSE}\n\n  and more </pre></div></div><table id='view_table'><tr><th>작가 |</th><td><span class='aut_name'>유</span><span class='aut_name'>유</span><span class='aut_name'>박</span></td></tr>"
         "<tr><th>시간 |</th><td>10:00\n\n  - 18:00</td></tr><tr><th>주소</th><td>서울 중구</td></tr><tr><th>관람료</th><td>성인: 5,000원\n어린이: 무료\n단체 할인</td></tr></table>"),
        {"title": "《산》", "venue_name": "덕수관", "venue_region": "서울", "artists": ["유", "박"], "open_hours": "10:00\n- 18:00", "venue_address": "서울 중구", "price_min": 0, "price_max": 5000,
         "description": f"{PROSE}\nand more", "poster_image_url": "https://art-map.co.kr/up/12.jpg", "price_notes": "단체 할인"},
        "https://art-map.co.kr/exhibition/view.php?idx=12",
    ],
    "fujifilm_square": [
        ("https://fujifilmsquare.jp/", '<!-- <a href="/exhibition/260605_03.html">soon</a> --><a href="/exhibition/260529_01.html">x</a><a href="/exhibition/260529_01.html"><img></a>'),
        ("https://fujifilmsquare.jp/exhibition/260529_01.html",
         f'<meta property="og:title" content="写真月間 ｜ スクエア"><p class="section-content">{PROSE}</p><table><tr><th>開催期間</th><td>2026年5月29日（金）〜6月4日（木）</td></tr><tr><th>開館時間</th><td>10:00–19:00</td></tr></table>'),
        {"title": "写真月間", "date_range": "2026年5月29日～2026年6月4日", "open_hours": "10:00–19:00", "description": PROSE, "poster_image_url": "https://fujifilmsquare.jp/assets/img/photo_event_260529_01_mv.jpg"},
    ],
    "gallery_bresson": [
        ("http://gallerybresson.com/index.php?rest_route=/wp/v2/posts&categories=279,248",
         json.dumps([{"link": "http://gallerybresson.com/?p=1", "title": {"rendered": "사진 &amp; 정신"}, "content": {"rendered": "<p>기간 2025.8.1~8.30</p>"}, "_embedded": {"wp:featuredmedia": [{"source_url": "http://gallerybresson.com/h.jpg"}]}},
                     {"link": "http://gallerybresson.com/?p=2", "title": {"rendered": " "}, "content": {"rendered": "x"}}])),
        {"title": "사진 & 정신", "date_range": "2025.08.01~2025.08.30", "poster_image_url": "http://gallerybresson.com/h.jpg", "category": "사진", "description": "기간 2025.8.1~8.30"},
    ],
    "gallery_kong": [
        ("https://www.konggallery.com/EXHIBITIONS_PAST", '<div class="_item item_gallary"><div><h4></h4></div><a class="item_container _item_container" href="/Show1"><div class="img_wrap _img_wrap" data-src="https://i.org/1.jpg"></div></a></div><div class="_item item_gallary"><a href="javascript:x">n</a></div>'),
        ("https://www.konggallery.com/Show1", '<div id="text_0"><p> </p></div><div id="text_a"><div><p>빛</p></div><div><p>Light</p><p>2022.01.05 - 2022.02.06</p></div></div>'),
        {"title": "빛", "date_range": "2022.01.05 - 2022.02.06", "poster_image_url": "https://i.org/1.jpg", "venue_name": "공근혜갤러리"},
    ],
    "gallery_lux": [
        ("https://gallerylux.net/archive/page/2/", '<article><a href="https://gallerylux.net/s/1"><div class="card-thumbnail"><img src="/w/1.jpg"></div><h1><div class="title">The &amp; Show</div></h1><div class="artist-name">Kim</div><div class="date">2026.01.02 - 2026.02.03</div></a></article>'),
        {"title": "The & Show", "date_range": "2026.01.02 - 2026.02.03", "poster_image_url": "https://gallerylux.net/w/1.jpg", "artists": ["Kim"]},
    ],
    "gallery_now": [
        ("https://rss.blog.naver.com/gallerynow.xml", FEED.format(item("지금 전", 5, " 전시소식", '<img src="//i.net/x.jpg?s" /> 기간 : 2026.05.06(수)-05.30(토)') + item("페어", 6, "아트페어") + "<item><title>u</title></item>")),
        {"title": "지금 전", "date_range": "2026.05.06~2026.05.30", "poster_image_url": "https://i.net/x.jpg?s", "category": "사진"}, "https://blog.naver.com/x/5",
    ],
    "gallery_tosei": [
        ("http://www.tosei-sha.jp/TOSEI-NEW-HP/html/EXHIBITIONS/j_exhibitions.html",
         '<table><tr><td class="j12"><font size="1">か</font><font size="4">Coming Soon</font><font size="4" color="#5">河合写真展<br />x</font><p>2026年6月28日(日) - 7月12日(日)</p><href="../../html/EXHIBITIONS/j_K.html" target="_self"></a>'
         '<td align="center"><img src="../../jpg/EXHIBITIONS/PAST/k.jpg"></td></tr><tr><td class="j12">address</td></tr></table>'),
        ("http://www.tosei-sha.jp/TOSEI-NEW-HP/html/EXHIBITIONS/j_K.html", f"<body><p>{PROSE}</p></body>"),
        {"title": "河合写真展", "date_range": "2026.06.28~2026.07.12", "poster_image_url": "http://www.tosei-sha.jp/TOSEI-NEW-HP/jpg/EXHIBITIONS/PAST/k.jpg", "description": PROSE},
        "http://www.tosei-sha.jp/TOSEI-NEW-HP/html/EXHIBITIONS/j_K.html",
    ],
    "goeun": [
        ("https://www.goeunmuseum.kr/bbs/board.php?bo_table=exhibition", '<div class="list-item"><div class="imgframe"><a href="/bbs/board.php?bo_table=exhibition&amp;wr_id=7"><img src="https://i.org/7.jpg"></a></div><h2 class="notranslate">고은전</h2><div class="list-details text-muted"><p>이</p><p>2026.03.01 ~ 2026.04.01</p></div></div>'),
        ("https://www.goeunmuseum.kr/bbs/board.php?bo_table=exhibition&wr_id=7", f'<div class="charter-wrap">{NESTED}</div><div class="charter-wrap">x</div>'),
        {"title": "고은전", "date_range": "2026.03.01 ~ 2026.04.01", "description": NESTED_TEXT, "artists": ["이"]},
    ],
    "ilwoo_space": [
        ("https://www.ilwoo.org/default/m02/p03.php",
         "<table><tr><td><table><tr onclick=\"location.href='/default/m02/p03.php?com_board_basic=read_form&com_board_idx=93&&com_board_page=&&com_board_id=10'; return false;\">"
         "<td class='bbsnewf5'><a href=''><a href='/default/m02/p03.php?com_board_basic=read_form&com_board_idx=93&&com_board_search_code=&com_board_page=&&com_board_id=10'>이 개인전<Marks 과거>..</a></a></td>"
         "<td class=\"bbsetc_add1\">2026.5. 1 ~ 2026.5.31</td></tr></table></td></tr></table>"),
        ("https://www.ilwoo.org/default/m02/p03.php?com_board_basic=read_form&com_board_idx=93&com_board_search_code=", f"<table><tr><td class='board_description'><table><tr><td><p>{PROSE}</p></td></tr></table><p>end</p></td></tr></table><img src='/x/u_image/p.jpg'>"),
        {"title": "이 개인전", "date_range": "2026.5. 1 ~ 2026.5.31", "description": f"{PROSE}\n\nend", "poster_image_url": "https://www.ilwoo.org/x/u_image/p.jpg"},
        "https://www.ilwoo.org/default/m02/p03.php?com_board_basic=read_form&com_board_idx=93&com_board_page=&com_board_id=10",
    ],
    "koba": [
        ("https://conference.kobashow.com/kor/about/info.asp",
         f'<h4>menu</h4><div id="content"><div><p>한국사와 한국협회가 공동주최하는 전시회. {PROSE}</p></div><h4 class="gapl">KOBA 2025</h4><table><tr><th>기간</th><td>2025년 5월 20일(화) ~ 23일(금)</td><th>개장</th><td>10</td></tr><tr><th>장소</th><td>COEX A홀 (서울 영동대로)</td></tr></table></div>'),
        {"title": "KOBA 2025", "date_range": "2025년 5월 20일(화) ~ 23일(금)", "venue_name": "COEX A홀", "organizer": "한국사", "exhibition_type_text": "박람회", "description": f"한국사와 한국협회가 공동주최하는 전시회. {PROSE}"},
    ],
    "museum_hanmi": [
        ("https://museumhanmi.or.kr/exhibition/?pgs=1", '<a class="item row gap-1r" href="https://museumhanmi.or.kr/post_exhibition/a/"><img src="https://i.org/a.jpg"><h6 class="bold">삼청본관</h6><h4>한미전</h4><h6 class="text-sub">2026.01.01 ~ 2026.05.01</h6></a>'),
        ("https://museumhanmi.or.kr/post_exhibition/a/", f'<div class="row"><p>t</p></div><div class="row">{NESTED}</div>'),
        {"title": "한미전", "venue_name": "삼청본관", "date_range": "2026.01.01 ~ 2026.05.01", "description": NESTED_TEXT},
    ],
    "canon_gallery": [
        ("https://kr.canon/canongallery/list/ajax", '<a class="masonry-item" href="/canongallery/view?gllyDispSeq=3"><div class="img"><img src="//i.org/c.jpg"></div><div class="txt"><p>캐논전</p></div><div class="info-list"><p>2026.06.01 ~ 2026.06.30</p></div></a><a class="masonry-item" href="/other"><div class="txt"><p>no</p></div></a>'),
        ("https://kr.canon/canongallery/view?gllyDispSeq=3", f'<div class="mid-cont">{NESTED}</div>'),
        {"title": "캐논전", "poster_image_url": "https://i.org/c.jpg", "description": NESTED_TEXT},
    ],
    "photo_sema": [
        ("https://sema.seoul.go.kr/kr/whatson/landing?x=1", '<div class="viewLink" data-idx="12" data-ex-menu-div="EXM01"><div><div><img src="/f/1.jpg"></div></div><strong class="o_h1">사진전</strong><span class="epEcPlaceNm">서울시립 사진미술관</span><span class="o_h3">2026.02.01 ~ 2026.03.01</span></div><div class="viewLink" data-idx="13" data-ex-menu-div="EXM01"><strong class="o_h1">회화</strong><span class="epEcPlaceNm">본관</span></div>'),
        ("https://sema.seoul.go.kr/kr/whatson/exhibition/detail?exNo=12", f'<div class="o_body">{NESTED}</div>'),
        {"title": "사진전", "venue_name": "서울시립 사진미술관", "description": NESTED_TEXT, "poster_image_url": "https://sema.seoul.go.kr/f/1.jpg"},
    ],
    "pgi": [
        ("https://www.pgi.ac/exhibitions", '<a href="https://www.pgi.ac/exhibitions/99/"><div><div>山田「海」</div></div> <p>2026.5.1 - 2026.6.1</p></a>'),
        ("https://www.pgi.ac/exhibitions/99/", f'<meta property="og:image" content="https://i.org/p.jpg"><div class="right-side-inner"><div><p>2026.5.1 - 6.1</p><p>{PROSE}</p></div><p>© x</p></div>'),
        {"title": "山田「海」", "date_range": "2026.05.01~2026.06.01", "poster_image_url": "https://i.org/p.jpg", "description": PROSE, "category": "写真", "open_hours": "月－土 11:00－18:00 / 日・祝休館"},
    ],
    "place_m": [
        ("https://www.placem.com/schedule/schedule.php",
         "<table><tr><th>A</th></tr><tr><td class=ymd>2026.06.01 - 2026.06.07</td><td><a href=../schedule/2026/main/20260601/exhibition.php>星玄人「西成」</a></td></tr><tr><td>2026.06.08 - 2026.06.14</td><td>no link</td></tr></table>"),
        ("https://www.placem.com/schedule/2026/main/20260601/exhibition.php", '<img src="/logo.png"><div class="title">2026.06.01<br />西成<div>あいりん地区</div></div><div class="photo"><p><img src="../../../../schedule/2026/main/20260601/h.jpg"></p></div>'),
        {"title": "西成", "artists": ["星玄人"], "date_range": "2026.06.01~2026.06.07", "category": "写真", "poster_image_url": "https://www.placem.com/schedule/2026/main/20260601/h.jpg", "description": "2026.06.01西成あいりん地区"},
        "https://www.placem.com/schedule/2026/main/20260601/exhibition.php",
    ],
    "ryugaheon": [
        ("https://rss.blog.naver.com/noongamgo.xml", FEED.format(item("[전시 1관, 2관] 류가헌전", 9, "any", '<img src="/x.jpg" />') + item("[전시 1관]", 10, "any"))),
        {"title": "류가헌전", "venue_name": "류가헌", "poster_image_url": "https://blog.naver.com/x.jpg"}, "https://blog.naver.com/x/9",
    ],
    "sangsangmadang": [
        ("https://www.sangsangmadang.com/display/selectDisplayList/HD/all", json.dumps({"displayListInfo": {"displayList": [{"title": "상상 사진전 &amp;", "contentsSeq": 3, "spaceCd": "BS", "term": "2026.04.22~2026.05.02", "posterFilePath": "https://i.org/s.jpg"}, {"title": "회화", "contentsSeq": 4}]}})),
        {"title": "상상 사진전 &", "venue_name": "KT&G 상상마당 부산 갤러리", "venue_region": "부산", "date_range": "2026.04.22~2026.05.02"}, "https://www.sangsangmadang.com/display/detail/3",
    ],
    "tokyo_art_beat": [
        ("https://www.tokyoartbeat.com/events", state("EventSearch", [
            {"slug": "s/1", "eventName": "光", "categories": [{"fields": {"name": "Photography"}}], "venue": {"fields": {"fullName": "V", "localArea": {"fields": {"name": "港区"}}, "geoInfo": {"lat": 35.5, "lon": 139}}}, "scheduleStartsOn": "2026-06-01", "scheduleEndsOn": "2026-07-01", "imageposter": {"fields": {"file": {"url": "//i.org/t.jpg"}}}},
            {"slug": "s/2", "eventName": "油", "categories": [{"fields": {"name": "Painting"}}], "venue": {"fields": {"fullName": "V"}}}, {"slug": "s/3", "eventName": "x", "categories": [{"fields": {"name": "写真"}}], "venue": {"fields": {}}}])),
        ("https://www.tokyoartbeat.com/events/-/s/1", state("EventDetail", [{"description": f" {PROSE} \n\n\n\nmore", "artists": "甲、乙, 丙"}])),
        {"title": "光", "venue_name": "V", "venue_region": "港区", "venue_lat": 35.5, "venue_lng": 139.0, "date_range": "2026-06-01 ~ 2026-07-01", "poster_image_url": "https://i.org/t.jpg", "artists": ["甲", "乙", "丙"], "description": f"{PROSE}\n\nmore"},
        "https://www.tokyoartbeat.com/events/-/s/1",
    ],
    "tokyo_photographic_art_museum": [
        ("https://topmuseum.jp/exhibition/", '<div class="slider__item"><a href="/exhibition/5/"></a><div class="slider__img"><img src="/i/5.jpg"></div><dl class="slider__cell"><dt><em class="main">光の展</em><em class="sub">Light</em></dt><dd><em>3F</em>2026.7.1 - 2026.9.1</dd></dl></div><div class="slider__item -movie"><a href="/movie/1"></a><dl><dt><em class="main">m</em></dt></dl></div>'),
        ("https://topmuseum.jp/exhibition/5/", f'<div class="exhibition_box5">{NESTED}</div>'),
        {"title": "光の展", "title_en": "Light", "date_range": "2026.7.1 - 2026.9.1", "description": NESTED_TEXT},
    ],
    "totem_pole": [
        ("https://tppg.jp/", '<ul><li><a href="https://tppg.jp/about/">About</a> 2026.05.26</li><li class="cat-post-item"><ul><li>x</li></ul><a href="/over-1/" title="OVER 1">写真展</a><p class="cpwp-excerpt-text">新井 / Arai 写真展「OVER」 2026.06.09 (tue) – 2026.06.14</p></li></ul><article><a href="/no-date/">n</a></article>'),
        ("https://tppg.jp/over-1/", f'<figure class="post-thumbnail"><img src="/wp/1.jpg"></figure><div class="entry-content">{NESTED}</div>'),
        {"title": "OVER 1", "artists": ["新井 / Arai"], "date_range": "2026.06.09~2026.06.14", "description": NESTED_TEXT, "poster_image_url": "https://tppg.jp/wp/1.jpg"}, "https://tppg.jp/over-1/",
    ],
    "zen_foto": [
        ("https://zen-foto.jp/jp/exhibitions", '<a href="https://zen-foto.jp/jp/exhibition/x-“y”">x</a>'),
        ("https://zen-foto.jp/jp/exhibition/x-%E2%80%9Cy%E2%80%9D", '<meta property="og:title" content="海 | ZEN FOTO GALLERY - a"><meta property="og:description" content="blurb"><p>会期：2026年5月1日（金） — 6月1日（土）</p>'),
        {"title": "海", "description": "blurb", "date_range": "2026.05.01~2026.06.01", "category": "写真"}, "https://zen-foto.jp/jp/exhibition/x-%E2%80%9Cy%E2%80%9D",
    ],
}


@pytest.fixture(scope="module")
def listings(spark):
    pages = [p for parts in PAGES.values() for p in parts if isinstance(p, tuple)]
    pages += [pages[0], ("https://elsewhere.org/archive/", "<article>no</article>"), ("https://gallerylux.net/archive/", None)]
    table = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return site_listings(table, site_rules(spark)).cache()


def test_golden_pages(listings):
    rows = {}
    for r in listings.collect():
        assert r.source not in rows, r
        rows[r.source] = r
    assert set(rows) == {s.source for s in SITES} == set(PAGES) == {name for name, _ in SOURCES}
    for source, parts in PAGES.items():
        wants = next(p for p in parts if isinstance(p, dict))
        for name, want in wants.items():
            assert getattr(rows[source].raw, name) == want, (source, name, getattr(rows[source].raw, name))
        if isinstance(parts[-1], str):
            assert rows[source].source_url == parts[-1]


def test_current_show_of_two_kinds_of_block(spark):
    """A site whose shows stand in articles and in list items has a rule for each."""
    html = '<article><header><a href="https://tppg.jp/sun/"><p class="tppg-title">Sun</p></a></header><p class="tppg-name">蔡 / Cai</p><p class="tppg-date">2026.05.26(tue) - 06.07(sun)</p></article>'
    table = spark.createDataFrame([(1, "https://tppg.jp/", html)], "page_id long, url string, html string")
    [row] = site_listings(table, site_rules(spark)).collect()
    assert (row.source_url, row.raw.title, row.raw.artists, row.raw.date_range) == ("https://tppg.jp/sun/", "Sun", ["蔡 / Cai"], "2026.05.26~2026.06.07")


def test_pages_that_are_not_what_their_rule_expects(spark):
    hosts = [("https://rss.blog.naver.com/gallerynow.xml", "<rss><bad"), ("https://www.tokyoartbeat.com/events", '<script id="__NEXT_DATA__">{bad</script>'), ("http://gallerybresson.com/index.php?rest_route=/wp/v2/posts", "<html>"),
             ("https://www.placem.com/schedule/schedule.php", "<table><tr"), ("https://gallerylux.net/archive/", ""), ("https://kr.canon/canongallery/list/ajax", None), (None, "x")]
    table = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(hosts)], "page_id long, url string, html string")
    assert site_listings(table, site_rules(spark)).isEmpty()
    assert site_listings(table.limit(0), site_rules(spark)).isEmpty()


def test_pages_to_canonical_rows(spark, listings):
    overrides = spark.createDataFrame([], "entity_type string, match_pattern string, canonical_id string, note string, seq long")
    places = spark.createDataFrame([], "backend string, kind string, query string, lat double, lng double")
    state = State(**{n: empty(spark, n) for n in TABLES}, overrides=overrides, gazetteer=places)
    run = run_ingest(listings, state, datetime.date(2026, 5, 15), "2026-05-15 00:00:00")
    shows = {r.source: r for r in run.exhibitions.collect()}
    assert len(shows) == len(PAGES) and shows["goeun"].status == "past" and shows["pgi"].status == "ongoing"
    assert run.rejects.isEmpty() and run.venues.filter(F.col("name") == "PGI").count() == 1
