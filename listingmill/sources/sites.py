"""Listings of the known sites: rule rows, one job over all pages.

A rule row says which pages of a host are lists and which are details, how a list is cut into items, which pattern or path gives
which field, where the prose of a detail page lies, and what is constant. Pages are HTML, JSON, the JSON state inside an HTML
page, or an RSS feed: ``reader`` says which. ``site_listings`` runs all rows at once: list items, first of each address, completed
by the detail page of the same address, in the shape that the ingest reads.

``page_id`` names a page. NULL pages and pages that are not what their rule expects (no JSON, broken XML) give no item.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from listingmill.functions.dates import backfill_range_year, extract_date_range, extract_japanese_date_range
from listingmill.functions.text import MIN_DESCRIPTION_LEN, clean_cell_lines, clean_paragraph_lines, clean_whitespace, split_artist_roster
from listingmill.functions.urls import percent_encode_path, strip_rss_marker
from listingmill.functions.values import parse_price_table
from listingmill.operators.merge import first_by
from listingmill.schemas import RAW
from listingmill.sources.elements import attributes, bind, css, cut, element_text, elements, group, link_to, markup, plain, row_spans, settled
from listingmill.sources.extract import (
    ORGANIZER_LEAD,
    PHOTO_CARD_KEYWORDS,
    PHOTO_KEYWORDS,
    PLACEHOLDER_TITLE,
    RSS_CATEGORIES,
    SECTION_SLUGS,
    meta_content,
    meta_description,
    page_host,
    prose_paragraphs,
    space_region,
    space_venue,
)

LINK = link_to("")
_MAP, _LIST = "MAP<STRING, STRING>", "ARRAY<STRING>"


def _of(kind: str = "STRING", default=None):
    """A column of the rule table with its type."""
    empty = {"STRING": "", "BOOLEAN": False}.get(kind, default)
    return field(default_factory=dict if kind == _MAP else list, metadata={"kind": kind}) if kind in (_MAP, _LIST) else field(default=empty, metadata={"kind": kind})


@dataclass(frozen=True)
class Site:
    source: str
    host: str
    list_page: str  # of the page's address
    reader: str = "html"  # html, json, state or rss
    # the items of a list
    items: str = _of()  # json: path of the items; state: name of the entry that holds them
    card_tag: str = _of()  # html: the element of an item, blank for the whole page
    card_attrs: str = _of()
    within_row: bool = _of("BOOLEAN")  # an item's fields may also stand in the table row around it
    link: str = field(default=LINK, metadata={"kind": "STRING"})  # html: group 1; else: path
    link_format: str = field(default="%s", metadata={"kind": "STRING"})
    link_after: str = _of()  # the address stands in the first tag with this pattern from the item on
    numbered: bool = _of("BOOLEAN")  # an item without an address gets a number on its page
    params: list = _of(_LIST)  # query parameters that make the address, name=default
    numeric: str = _of()  # the one that must be a number
    encode: bool = _of("BOOLEAN")  # percent-encode the address
    fields: dict = _of(_MAP)  # html: pattern in the markup of an item, group 1; else: path
    text_fields: dict = _of(_MAP)  # pattern in the text of an item, group 1
    whole_title: bool = _of("BOOLEAN")  # without another title, the item's text
    title_cut: str = _of()  # what is no part of a title
    artist_cut: str = _of()
    labels: dict = _of(_MAP)  # header cells of a table, and the fields of their cells
    dated: bool = _of("BOOLEAN")  # only items with a date
    japanese: bool = _of("BOOLEAN")  # dates in year-month-day signs
    keep: str = _of()  # what an item must contain
    drop: str = _of()  # what its address must not contain
    title_words: list = _of(_LIST)  # one of them must stand in the title
    categories: list = _of(_LIST)  # one of them must be a category
    category_words: list = _of(_LIST)  # one of them must stand in a category
    constants: dict = _of(_MAP)
    # detail pages
    detail_page: str = _of()
    detail_title: str = _of()  # og, first
    detail_date: str = _of()  # last, japanese, label
    block_tag: str = _of()
    block_attrs: str = _of()
    prose: str = _of()  # longest, first, text, lines, prose, og
    summary: bool = _of("BOOLEAN")  # the page's own summary where there is no prose
    poster_tag: str = _of()  # posters: og:image first, then images inside these elements, blank for the whole page
    poster_attrs: str = _of()
    poster_src: str = _of()  # what their address must hold
    poster_format: str = _of()  # the address built from the detail page's, where no image is found


# --- fixed values: hosts, page addresses, element classes, labels, paths and venues of the sites ----------------
def _place(name: str, region: str, address: str, **more: str) -> dict[str, str]:
    return {"venue_name": name, "venue_region": region, "venue_address": address, **more}


def _in(name: str, css_name: str = "") -> str:
    """The inside of the first ``name`` element, of class ``css_name``."""
    return rf"""(?s)<{name}\b""" + (rf"""[^>]*class=["'][^"']*(?<![\w-]){css_name}(?![\w-])[^"']*["']""" if css_name else "") + rf"""[^>]*>(.*?)</{name}>"""


IMAGE = r"""(?is)<img\b[^>]*?\ssrc\s*=\s*["']?((?<=")[^"]*|(?<=')[^']*|(?<=[=\s])[^\s"'>]+)"""
DATE_START = r"\d{4}\s*\.\s*\d{1,2}"
BEFORE_DATE = rf"(?s)^\s*(.*?)\s*{DATE_START}"
SITE_SUFFIX = r"\s*[|｜].*$"
TOTEM_LINK = link_to(rf"(?:(?:https?:)?//tppg\.jp)?(?<![^\"'=\s./a-z:])/(?!(?:{'|'.join(SECTION_SLUGS)})/)[^/\"'\s>]+/(?=[\"'\s>])")
SITES = (
    Site("art_space_j", "www.artspacej.com", r"/sub/sub03_0[13]\.php\?boardid=exhib$", card_tag="a", card_attrs=attributes(link_to("mode=view")), within_row=True,
         params=["boardid=exhib", "mode=view", "idx="], numeric="idx", whole_title=True, title_cut=rf"^\s*\[[^\]]+\]\s*|[_\s]*{DATE_START}\s*\.\s*\d{{1,2}}.*$|[_\s]+$",
         constants=_place("Art Space J", "성남", "경기도 성남시 분당구 정자일로 166 SPG Dream Bldg. 1층", category="사진"),
         detail_page=r"mode=view", block_tag="body", prose="first", summary=True, poster_src="uploaded/board/exhib"),
    Site("artmap", "art-map.co.kr", r"/data/new_exhibition\.php", card_tag="a", card_attrs=attributes(link_to(r"view\.php\?idx=\d+")),
         link=r"view\.php\?idx=(\d+)", link_format="https://art-map.co.kr/exhibition/view.php?idx=%s",
         fields={"title": r"(?s)new_exh_list.*?<span\b[^>]*>(.*?)</span>", "venue": r"(?s)new_exh_list.*?</span>.*?<span\b[^>]*>(.*?)</span>",
                 "date_range": r"(?s)new_exh_list.*?</span>.*?</span>.*?<span\b[^>]*>(.*?)</span>", "poster_image_url": IMAGE},
         constants={"category": "사진"}, labels={"시간": "open_hours", "주소": "venue_address", "관람료": "price_text", "작가": "artists"},
         detail_page=r"/exhibition/view\.php\?idx=\d+", block_tag="pre", prose="lines"),
    Site("canon_gallery", "kr.canon", r"/canongallery/list", card_tag="a", card_attrs=attributes(css("masonry-item")),
         fields={"title": r"(?s)<div[^>]*class=\"txt\"[^>]*>.*?<p[^>]*>(.*?)</p>", "date_range": r"(?s)<div[^>]*class=\"info-list\"[^>]*>.*?<p[^>]*>(.*?)</p>", "poster_image_url": IMAGE},
         constants=_place("캐논 갤러리", "서울", "서울특별시 강남구 봉은사로 217 캐논플렉스 지하 1층"), keep="gllyDispSeq",
         detail_page=r"/canongallery/.*gllyDispSeq=", block_tag="div", block_attrs=attributes(css("mid-cont")), prose="longest", summary=True),
    Site("fujifilm_square", "fujifilmsquare.jp", r"^https?://[^/]+/?$", card_tag="a", card_attrs=attributes(link_to(r"/exhibition/\d{6}_\d{2}\.html")),
         link=r"/exhibition/(\d{6}_\d{2})\.html", link_format="https://fujifilmsquare.jp/exhibition/%s.html", title_cut=SITE_SUFFIX,
         labels={"開催期間": "date_range", "開館時間": "open_hours"},
         constants=_place("フジフイルム スクエア", "東京", "東京都港区赤坂9-7-3 東京ミッドタウン・ウエスト1F", category="写真"),
         detail_page=r"/exhibition/\d{6}_\d{2}\.html$", detail_title="og", detail_date="label", block_tag="p", block_attrs=attributes(css("section-content")), prose="longest", summary=True,
         poster_src=r"photo_event[^\"'>]*_mv", poster_format="/assets/img/photo_event_%s_mv.jpg"),
    Site("gallery_bresson", "gallerybresson.com", r"/index\.php\?.*rest_route=/wp/v2/posts", reader="json", items="$", link="$.link",
         fields={"title": "$.title.rendered", "text": "$.content.rendered", "poster_image_url": "$._embedded['wp:featuredmedia'][0].source_url"},
         constants=_place("갤러리 브레송", "서울", "서울특별시 중구 퇴계로 163", category="사진")),
    Site("gallery_kong", "www.konggallery.com", r"/EXHIBITIONS_PAST$", card_tag="div", card_attrs=attributes(css("item_gallary")), fields={"poster_image_url": r'data-src="([^"]+)"'},
         constants=_place("공근혜갤러리", "서울", "서울특별시 종로구 삼청로7길 38"),
         detail_page=r"konggallery\.com/(?!EXHIBITIONS_PAST)[^/]+$", detail_title="first", detail_date="last", block_tag="div", block_attrs=attributes(r"\sid=[\"']text_")),
    Site("gallery_lux", "gallerylux.net", r"/archive/", card_tag="article",
         fields={"title": _in("div", "title"), "artist": _in("div", "artist-name"), "date_range": _in("div", "date"), "poster_image_url": IMAGE},
         constants=_place("갤러리 룩스", "서울", "서울특별시 종로구 옥인동 62")),
    Site("gallery_now", "rss.blog.naver.com", r"/gallerynow\.xml", reader="rss", link="$.link", fields={"title": "$.title", "text": "$.description"}, categories=list(RSS_CATEGORIES), keep="https://blog.naver.com",
         constants=_place("gallery NoW", "서울", "서울시 강남구 언주로 152길 16", category="사진")),
    Site("gallery_tosei", "www.tosei-sha.jp", r"/EXHIBITIONS/j_exhibitions\.html", card_tag="td", card_attrs=attributes(css("j12")), within_row=True,
         link="", link_after=r"""["'](\.{0,2}[^"']*?EXHIBITIONS/j_(?!exhibitions)[^/"']+\.html)["']""", numbered=True, dated=True, japanese=True,
         fields={"title": rf"""(?i)<font\b[^>]*size=["']?4\b[^>]*>(?!\s*{PLACEHOLDER_TITLE}\s*<)([^<]*[^<\s][^<]*)<""", "poster_image_url": r"""(?is)<img\b[^>]*?\ssrc=["']((?![^"']*Coming soon)[^"']*EXHIBITIONS[^"']*)"""},
         constants=_place("Gallery Tosei", "東京", "東京都中野区中央5-18-20", category="写真"),
         detail_page=r"/EXHIBITIONS/j_(?!exhibitions)[^/]+\.html", block_tag="body", prose="first"),
    Site("goeun", "www.goeunmuseum.kr", r"/bbs/board\.php(?!.*wr_id=)", card_tag="div", card_attrs=attributes(css("list-item")),
         link=r"""(?i)\shref=["'][^"']*?[?&;]wr_id=(\d+)""", link_format="https://www.goeunmuseum.kr/bbs/board.php?bo_table=exhibition&wr_id=%s",
         fields={"title": _in("h2", "notranslate"), "artist": r"(?s)list-details.*?<p[^>]*>(.*?)</p>", "date_range": r"(?s)list-details.*?</p>.*?<p[^>]*>(.*?)</p>", "poster_image_url": IMAGE},
         constants=_place("고은사진미술관", "부산", "부산광역시 해운대구 해운대로 452번길 16"),
         detail_page=r"/bbs/board\.php.*wr_id=\d+", block_tag="div", block_attrs=attributes(css("charter-wrap")), prose="longest", summary=True),
    Site("ilwoo_space", "www.ilwoo.org", r"/m02/p03\.php(?!.*com_board_idx)", card_tag="tr", card_attrs=attributes(r"\sonclick=[^>]*read_form[^>]*com_board_idx"), link=link_to("com_board_idx"),
         params=["com_board_basic=read_form", "com_board_idx=", "com_board_page=", "com_board_id=10"], numeric="com_board_idx", title_cut=r"\s*\.\.$",
         fields={"title": _in("td", "bbsnewf5"), "date_range": _in("td", "bbsetc_add1")}, constants=_place("일우스페이스", "서울", "서울시 중구 서소문로 117 대한항공 빌딩 6층"),
         detail_page=r"/m02/p03\.php.*com_board_idx", block_tag="td", block_attrs=attributes(css("board_description")), prose="longest", summary=True, poster_src="/u_image/"),
    Site("koba", "conference.kobashow.com", r"/kor/about/info\.asp", link="", link_format="https://conference.kobashow.com/kor/about/info.asp",
         fields={"title": r"""(?is)^(?:.*?\bid=["']content["'].*?|.*?)<h4\b[^>]*>(.*?)</h4>"""}, labels={"기간": "date_range", "장소": "venue_name", "주최": "organizer"}, dated=True, constants={"exhibition_type_text": "박람회"},
         detail_page=r"/kor/about/info\.asp", block_tag="div", block_attrs=attributes(r"\sid=[\"']content\b"), prose="longest", summary=True),
    Site("museum_hanmi", "museumhanmi.or.kr", r"/exhibition/", card_tag="a", card_attrs=attributes(css("item"), css("gap-1r")),
         fields={"title": _in("h4"), "venue_name": _in("h6", "bold"), "date_range": _in("h6", "text-sub"), "poster_image_url": IMAGE}, keep="/post_exhibition/",
         detail_page=r"/post_exhibition/", block_tag="div", block_attrs=attributes(css("row")), prose="longest", summary=True),
    Site("pgi", "www.pgi.ac", r"/exhibitions/?$", card_tag="a", card_attrs=attributes(link_to(r"/exhibitions/\d+")), text_fields={"title": BEFORE_DATE}, whole_title=True,
         constants=_place("PGI", "東京", "東京都港区東麻布2-3-4 TKBビル3F", category="写真", open_hours="月－土 11:00－18:00 / 日・祝休館"),
         detail_page=r"/exhibitions/\d+", block_tag="div", block_attrs=attributes(css("right-side-inner")), prose="prose"),
    Site("photo_sema", "sema.seoul.go.kr", r"/kr/whatson/landing", card_tag="div", card_attrs=attributes(css("viewLink"), r"\sdata-ex-menu-div=[\"']EXM01"),
         link=r'data-idx="(\d+)"', link_format="https://sema.seoul.go.kr/kr/whatson/exhibition/detail?exNo=%s",
         fields={"title": _in("strong", "o_h1"), "venue_name": _in("span", "epEcPlaceNm"), "date_range": _in("span", "o_h3"), "poster_image_url": IMAGE}, keep="사진미술관",
         detail_page=r"/exhibition/detail\?exNo=", block_tag="div", block_attrs=attributes(css("o_body")), prose="longest", summary=True),
    Site("place_m", "www.placem.com", r"/schedule/schedule\.php", card_tag="a", card_attrs=attributes(link_to(r"schedule/\d{4}/(?:main|mini)/\d{8}/exhibition\.php")), within_row=True,
         text_fields={"title": "「(.+?)」", "artist": "(?s)^(.+?)「.+?」"}, whole_title=True, constants=_place("Place M", "東京", "東京都新宿区新宿1-2-11 第二都ビル3F", category="写真"),
         detail_page=r"/schedule/\d{4}/(?:main|mini)/\d{8}/", block_tag="div", block_attrs=attributes(css("title")), prose="text", summary=True,
         poster_tag="div", poster_attrs=attributes(css("photo"))),
    Site("ryugaheon", "rss.blog.naver.com", r"/noongamgo\.xml", reader="rss", link="$.link", fields={"title": "$.title", "markup": "$.description"}, title_cut=r"^\[전시[^\]]*\]\s*", keep="https://blog.naver.com",
         constants=_place("류가헌", "서울", "서울시 종로구 자하문로 106 아카이브빌딩 2F, B1")),
    Site("sangsangmadang", "www.sangsangmadang.com", r"/display/selectDisplayList/", reader="json", items="$.displayListInfo.displayList",
         link="$.contentsSeq", link_format="https://www.sangsangmadang.com/display/detail/%s",
         fields={"title": "$.title", "space": "$.spaceCd", "date_range": "$.term", "poster_image_url": "$.posterFilePath"}, title_words=list(PHOTO_CARD_KEYWORDS)),
    Site("tokyo_art_beat", "www.tokyoartbeat.com", r"/events/?$", reader="state", items="EventSearch", link="$.slug", link_format="https://www.tokyoartbeat.com/events/-/%s",
         fields={"title": "$.eventName", "venue_name": "$.venue.fields.fullName", "venue_region": "$.venue.fields.localArea.fields.name", "venue_lat": "$.venue.fields.geoInfo.lat",
                 "venue_lng": "$.venue.fields.geoInfo.lon", "starts": "$.scheduleStartsOn", "ends": "$.scheduleEndsOn", "poster_image_url": "$.imageposter.fields.file.url"},
         category_words=list(PHOTO_KEYWORDS), detail_page=r"/events/-/", prose="state", block_tag="EventDetail"),
    Site("tokyo_photographic_art_museum", "topmuseum.jp", r"/exhibition/$", card_tag="div", card_attrs=attributes(css("slider__item"), r"(?![^>]*-movie)"),
         fields={"title": _in("em", "main"), "title_en": _in("em", "sub"), "date_range": r"(?s)<dd[^>]*>(?:\s*<em[^>]*>.*?</em>)*(.*?)</dd>", "poster_image_url": IMAGE},
         constants=_place("東京都写真美術館", "東京都", "東京都目黒区三田1-13-3 恵比寿ガーデンプレイス内"), drop="/movie/",
         detail_page=r"/exhibition/\d+/?$", block_tag="div", block_attrs=attributes(css("exhibition_box5")), prose="longest", summary=True),
    Site("totem_pole", "tppg.jp", r"^https?://[^/]+/?$", card_tag="article", link=TOTEM_LINK, dated=True,
         fields={"title": _in("p", "tppg-title"), "artist": _in("p", "tppg-name"), "date_range": _in("p", "tppg-date"), "named": r"""(?i)<a\b[^>]*?\stitle=["']([^"']+)"""},
         constants=_place("Totem Pole Photo Gallery", "東京", "東京都新宿区四谷四丁目22 第二富士川ビル1F", category="写真"),
         detail_page=r"^https?://tppg\.jp/[^/]+/$", block_tag="div", block_attrs=attributes(css("entry-content")), prose="first", summary=True, poster_tag="figure", poster_attrs=attributes(css("post-thumbnail"))),
    Site("totem_pole", "tppg.jp", r"^https?://[^/]+/?$", card_tag="li", card_attrs=attributes(css("cat-post-item")), link=TOTEM_LINK, dated=True,
         fields={"title": r"""(?i)<a\b[^>]*?\stitle=["']([^"']+)""", "named": r"(?is)<a\b[^>]*>(.*?)</a>", "excerpt": _in("p", "cpwp-excerpt-text")},
         text_fields={"artist": r"(?s)^(.+?)[\"“”「『].+?[\"”」』]"}, artist_cut=r"(?:写真展|個展|展)\s*$",
         constants=_place("Totem Pole Photo Gallery", "東京", "東京都新宿区四谷四丁目22 第二富士川ビル1F", category="写真")),
    Site("zen_foto", "zen-foto.jp", r"/jp/exhibitions", card_tag="a", card_attrs=attributes(link_to("/jp/exhibition/")), encode=True, title_cut=SITE_SUFFIX,
         constants=_place("ZEN FOTO GALLERY", "東京", "東京都港区六本木6-6-9 ピラミデビル208号室", category="写真", open_hours="火－土 12:00－19:00 / 日・月・祝休廊"),
         detail_page=r"/jp/exhibition/", detail_title="og", detail_date="japanese", prose="og"),
)
FEED = "channel STRUCT<item: ARRAY<STRUCT<title: STRING, link: STRING, category: ARRAY<STRING>, description: STRING>>>"
STATE = r"""(?s)<script[^>]*id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""
# ---------------------------------------------------------------------------------------------------------------

_RULE = ", ".join(f"{'dropped' if f.name == 'drop' else f.name} {f.metadata.get('kind', 'STRING')}" for f in fields(Site))
_FIELDS = ("title", "title_en", "artist", "date_range", "venue_name", "venue", "text", "named", "excerpt")
_DETAIL = ("title", "date_range", "description", "poster_image_url", "open_hours", "venue_address", "fee_text", "price_notes", "price_min", "price_max", "price_breakdown", "artists")


def site_rules(spark: SparkSession, sites: tuple[Site, ...] = SITES) -> DataFrame:
    """The rule table, one row for each kind of item; it is fixed and small."""
    return spark.createDataFrame([tuple(getattr(s, f.name) for f in fields(Site)) for s in sites], _RULE)


def _blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _first(pattern: Column, text: Column) -> Column:
    """Group 1 of the first match; a blank pattern finds nothing."""
    pattern = F.nullif(pattern, F.lit(""))
    return _blank(F.get(F.regexp_extract_all(text, pattern, F.lit(1)), F.lit(0)))


def _rule(name: str, of: str = "fields") -> Column:
    return F.try_element_at(of, F.lit(name))


def _absolute(address: Column, page: Column) -> Column:
    """Against the page's address, ``..`` resolved; an address without a leading slash is taken below the page's folder."""
    return bind(address, lambda url: bind(_joined(url, page), _without_dots))


def _joined(url: Column, page: Column) -> Column:
    root = F.regexp_extract(page, r"^(https?:)?//[^/?#]+", 0)
    folder = F.regexp_replace(F.regexp_replace(page, r"[?#].*$", ""), r"(?<!/)/[^/]*$", "/")
    return (
        F.when(url.rlike("(?i)^(?:#|javascript:|mailto:)"), F.lit(None).cast("string"))
        .when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url))
        .when(url.rlike("(?i)^https?:"), url)
        .when(F.startswith(url, F.lit("/")), F.concat(root, url))
        .when(url != "", F.concat(folder, F.regexp_replace(url, r"^\./", "")))
    )


def _without_dots(whole: Column) -> Column:
    out = whole
    for _ in range(8):
        out = F.regexp_replace(out, r"(?<=[^/:])/(?!\.\./)[^/]+/\.\./", "/")
    # What is left of "..", or follows the root, leads nowhere above it.
    return F.when(F.contains(whole, F.lit("/../")), F.regexp_replace(out, r"(?<=[^/:])(?:/\.\.)+/", "/")).otherwise(whole)


def _canonical(url: Column) -> Column:
    """The address of an item by its rule: tracking marks dropped, identity parameters only, percent-encoded."""
    value = lambda p: group(url, F.concat(F.lit("[?&]"), F.substring_index(p, "=", 1), F.lit("=([^&#]*)")), 1)
    kept = F.transform("params", lambda p: F.concat(F.substring_index(p, "=", 1), F.lit("="), F.coalesce(_blank(value(p)), F.substring_index(p, "=", -1))))
    number = group(url, F.concat(F.lit("[?&]"), F.col("numeric"), F.lit("=([^&#]*)")), 1)
    rebuilt = F.when((F.col("numeric") == "") | number.rlike(r"^\d+$"), F.concat(F.regexp_replace(url, r"[?#].*$", ""), F.lit("?"), F.array_join(kept, "&")))
    root = F.regexp_extract(url, r"^https?://[^/?#]+", 0)
    encoded = F.concat(root, percent_encode_path(F.substr(url, F.length(root) + 1)))
    return F.when(F.size("params") > 0, rebuilt).when(F.col("encode") & url.rlike(r"[^\x21-\x7e]"), encoded).otherwise(strip_rss_marker(url))


def _hosted(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages with the rules of their host; the rule table is fixed, so it is broadcast and the pages stay where they are."""
    return pages.select("page_id", "url", "html", page_host(F.col("url")).alias("host")).join(F.broadcast(rules), "host")


# ---------------------------------------------------------------------------
# lists


def _state_entry(html: Column, name: Column) -> Column:
    """``data`` of the entry ``name`` in the page's state, as an array of variants."""
    state = F.try_variant_get(F.try_parse_json(_blank(F.regexp_extract(html, STATE, 1))), "$.props.pageProps.fallback", "variant").try_cast("map<string, variant>")
    entry = F.map_values(F.map_filter(state, lambda k, v: F.contains(k, F.concat(F.lit('"name":"'), name, F.lit('"')))))
    return F.try_variant_get(F.get(entry, F.lit(0)), "$.data", "array<variant>")


def _variants(hosted: DataFrame) -> DataFrame:
    """One row for each item of the JSON, state and RSS lists: ``item`` as a variant, ``pos`` its place."""
    feed = F.expr(f"from_xml(html, '{FEED}')")["channel"]["item"]
    listed = F.when(F.col("reader") == "json", F.expr("try_variant_get(try_parse_json(html), items, 'array<variant>')")).when(F.col("reader") == "state", _state_entry(F.col("html"), F.col("items")))
    listed = listed.when(F.col("reader") == "rss", F.transform(feed, lambda x: F.parse_json(F.to_json(x))))
    return hosted.filter("reader <> 'html'").select("*", F.posexplode(listed).alias("pos", "item")).drop("html")


def _variant_cards(hosted: DataFrame) -> DataFrame:
    rows = _variants(hosted)
    of_text = bind(F.col("_plain"), extract_date_range)
    names = ("title", "date_range", "venue_name", "venue_region", "venue_lat", "venue_lng", "poster_image_url", "text", "markup", "space", "starts", "ends")
    rows = rows.withColumns({f"_{n}": F.expr(f"try_variant_get(item, fields['{n}'], 'string')") for n in names})
    categories = F.coalesce(
        F.try_variant_get("item", "$.category", "array<string>"),
        F.transform(F.try_variant_get("item", "$.categories", "array<variant>"), lambda c: F.try_variant_get(c, "$.fields.name", "string")),
        F.array().cast("array<string>"),
    )
    rows = rows.withColumns({"_categories": F.transform(categories, lambda c: F.trim(F.coalesce(c, F.lit("")))), "_link": F.trim(F.expr("try_variant_get(item, link, 'string')"))})
    of_kind = ((F.size("categories") == 0) | F.arrays_overlap("_categories", "categories")) & (
        (F.size("category_words") == 0) | F.exists("_categories", lambda c: F.exists("category_words", lambda w: F.contains(F.lower(c), w)))
    )
    # A state's own pages name a venue for every event; what lacks one is no listing.
    venued = (F.col("reader") != "state") | (F.coalesce("_venue_name", F.lit("")) != "")
    rows = rows.withColumn("_plain", plain(F.col("_text")))
    whole_text = F.col("_plain")
    image = F.trim(_first(F.lit(IMAGE), F.coalesce("_text", "_markup")))
    period = F.when(F.col("_starts").isNotNull() & F.col("_ends").isNotNull(), F.concat_ws(" ~ ", "_starts", "_ends")).otherwise(F.coalesce("_starts", "_ends"))
    spaced = F.try_element_at("fields", F.lit("space")).isNotNull()
    code = F.coalesce("_space", F.lit(""))
    shown = bind(image, lambda i: F.when(i.rlike("^(?:https?:|/)"), i))
    return rows.filter(of_kind & venued).select(
        *_COMMON, plain(F.col("_title")).alias("_title"), F.lit(None).cast("string").alias("_title_en"), F.lit(None).cast("string").alias("_artist"),
        _blank(F.coalesce("_date_range", period, of_text)).alias("_date_range"),
        F.when(spaced, space_venue(code)).otherwise(F.col("_venue_name")).alias("_venue_name"), F.when(spaced, space_region(code)).otherwise(F.col("_venue_region")).alias("_venue_region"),
        F.col("_venue_lat").try_cast("double").alias("venue_lat"), F.col("_venue_lng").try_cast("double").alias("venue_lng"),
        F.coalesce(_blank("_poster_image_url"), shown).alias("_poster"),
        F.when(F.col("reader") == "json", _blank(whole_text)).alias("description"), F.lit(None).cast("string").alias("organizer"),
        F.when(F.col("_link") != "", F.replace("link_format", F.lit("%s"), F.col("_link"))).alias("_link"), F.col("_link").alias("_body"),
    )


_COMMON = ["page_id", "url", "source", "reader", "pos", "constants", "keep", "dropped", "title_words", "title_cut", "artist_cut", "params", "numeric", "encode", "dated", "numbered", "detail_title"]


def _html_cards(hosted: DataFrame) -> DataFrame:
    """One row for each element that is an item, with the table row around it where the rule asks for that."""
    pages = hosted.filter("reader = 'html' AND html IS NOT NULL").withColumn("parts", markup(F.col("html")))
    pages = pages.withColumn("spans", elements(F.col("parts"), F.col("card_tag"), F.col("card_attrs")))
    inside = pages.filter("within_row")
    found = row_spans(inside, inside.select("page_id", F.explode("spans.a").alias("a")))
    rows = found.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("a", "row"))).alias("rows"))
    inside = inside.join(rows, "page_id", "left")
    pages = pages.filter(~F.col("within_row")).withColumn("rows", F.lit(None).cast("map<int, struct<a: int, b: int>>")).unionByName(inside)
    # Addresses that stand after an item: the tags that hold one, looked up by position.
    after = F.when(F.col("link_after") != "", F.filter(F.transform("parts", lambda p, i: F.struct(i.alias("i"), _first(F.col("link_after"), p).alias("url"))), lambda x: x["url"].isNotNull()))
    pages = pages.withColumn("_after", after)

    def card(span: Column) -> Column:
        row = F.try_element_at("rows", span["a"])
        follows = F.get(F.filter("_after", lambda x: x["i"] >= span["a"]), F.lit(0))["url"]
        return F.struct(cut(F.col("parts"), span).alias("body"), F.when(row.isNotNull(), cut(F.col("parts"), row)).alias("around"), follows.alias("follows"))

    cards = pages.withColumn("cards", F.transform("spans", card)).drop("parts", "spans", "rows", "_after", "html")
    return cards.select("*", F.posexplode("cards").alias("pos", "card")).drop("cards").select("*", "card.body", "card.around", "card.follows").drop("card")


def _cells(html: Column) -> Column:
    """Header cells with the cell after each, for rules that name labels: array of struct(label, cell); a bar ends no label."""
    pattern = F.lit(r"(?is)<th\b[^>]*>(.*?)</th>\s*<td\b[^>]*>(.*?)</td>")
    pairs = F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("label"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("cell"))
    named = F.transform(pairs, lambda p: F.struct(F.regexp_replace(plain(p["label"]), r"\s*\|\s*$", "").alias("label"), p["cell"].alias("cell")))
    return F.when(F.size(F.map_keys("labels")) > 0, named)


def _labelled(field_name: str) -> Column:
    """The last cell whose label the rule gives to the field."""
    hit = F.filter("_cells", lambda p: F.coalesce(F.try_element_at("labels", p["label"]) == field_name, F.lit(False)))
    return F.get(F.reverse(hit), F.lit(0))["cell"]


def _page_cards(hosted: DataFrame) -> DataFrame:
    cards = _html_cards(hosted).withColumn("_cells", _cells(F.col("body")))
    body = F.col("body")
    poster = F.coalesce(*[_first(_rule("poster_image_url"), c) for c in (body, F.col("around"))])
    raw = {**{n: _first(_rule(n), body) for n in _FIELDS}, "plain": body, "around": F.col("around"), "period": _labelled("date_range"), "place": _labelled("venue_name")}
    # All texts of an item are made plain by one expression.
    cards = cards.withColumns({"_texts": F.transform(F.array(*raw.values()), plain), "_poster": F.trim(poster), "_raw_link": _first(F.col("link"), body)})
    cards = cards.withColumns({f"_{n}": _blank(F.get("_texts", F.lit(k))) for k, n in enumerate(raw)})
    # What a text pattern reads is the excerpt where a rule names one.
    cards = cards.withColumn("_read", F.coalesce("_excerpt", "_plain"))
    cards = cards.withColumns({f"_t_{n}": _blank(clean_whitespace(_first(_rule(n, "text_fields"), F.col("_read")))) for n in ("title", "artist")})
    title = F.coalesce("_title", "_t_title", "_named", F.when(F.col("whole_title"), F.col("_plain")))
    # A date's own element first; where dates stand in free text, that of the row, then that of the item.
    free = F.col("within_row") | F.col("whole_title") | F.col("dated")
    texts = F.array(F.when(F.col("dated"), F.col("_date_range")), F.when(free, F.col("_around")), F.when(free, F.col("_read")))
    ranges = F.transform(texts, lambda c: F.when(F.col("japanese"), extract_japanese_date_range(c)).otherwise(extract_date_range(c)))
    found = F.get(F.filter(ranges, lambda r: r.isNotNull()), F.lit(0))
    tidy = F.when(~F.col("dated"), F.col("_date_range"))
    paragraphs = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), plain)
    lead = F.get(F.filter(paragraphs, lambda p: p.rlike(ORGANIZER_LEAD)), F.lit(0))
    lead = F.when(F.array_contains(F.map_values("labels"), "organizer"), lead)
    venue = _blank(F.trim(F.regexp_replace("_place", r"\s*\([^)]+\)\s*$", "")))
    link = F.when((F.col("link") == "") & (F.col("link_after") == ""), F.col("link_format")).when(F.col("_raw_link").isNotNull(), F.replace("link_format", F.lit("%s"), F.col("_raw_link"))).otherwise(F.col("follows"))
    return cards.select(
        *_COMMON, title.alias("_title"), "_title_en", F.coalesce("_artist", "_t_artist").alias("_artist"),
        F.coalesce(tidy, "_period", found).alias("_date_range"),
        F.coalesce("_venue_name", venue, _blank(F.trim(F.substring_index("_venue", "/", 1)))).alias("_venue_name"),
        F.when(F.contains("_venue", F.lit("/")), _blank(F.trim(F.regexp_replace("_venue", "^[^/]*/", "")))).alias("_venue_region"),
        F.lit(None).cast("double").alias("venue_lat"), F.lit(None).cast("double").alias("venue_lng"), "_poster",
        F.lit(None).cast("string").alias("description"), _blank(F.trim(F.regexp_extract(lead, ORGANIZER_LEAD, 1))).alias("organizer"),
        link.alias("_link"), body.alias("_body"),
    )


def site_cards(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row for each item of a list page: source, source_url, seq and the item's fields. Rules are a fixed small table."""
    hosted = _hosted(pages, rules).filter(F.regexp_like("url", F.col("list_page")))
    cards = _page_cards(hosted).unionByName(_variant_cards(hosted))
    constant = lambda n: _rule(n, "constants")
    title = _blank(clean_whitespace(F.when(F.col("title_cut") != "", F.regexp_replace("_title", F.col("title_cut"), F.lit(""))).otherwise(F.col("_title"))))
    artist = _blank(clean_whitespace(F.when(F.col("artist_cut") != "", F.regexp_replace("_artist", F.col("artist_cut"), F.lit(""))).otherwise(F.col("_artist"))))
    cards = cards.withColumns({"title": title, "artist": artist, "_absolute": _absolute(F.regexp_replace("_link", "&amp;", "&"), F.col("url"))})
    cards = settled(cards.withColumn("source_url", _canonical(F.col("_absolute"))))
    titled = F.col("title").isNotNull() | (F.col("detail_title") != "")
    wanted = titled & F.contains("_body", F.col("keep")) & (~F.col("dated") | F.col("_date_range").isNotNull())
    wanted &= (F.size("title_words") == 0) | F.exists("title_words", lambda w: F.contains(F.col("title"), w))
    cards = cards.filter(F.coalesce(wanted, F.lit(False)))
    # Numbers on a page, for the items that may lack an address; the rows are narrow here.
    place = F.row_number().over(W.partitionBy("page_id", "source").orderBy("pos"))
    cards = cards.withColumn("source_url", F.coalesce("source_url", F.when(F.col("numbered"), F.concat(F.col("url"), F.lit("#show"), place.cast("string")))))
    known = F.col("source_url").isNotNull() & ((F.col("dropped") == "") | ~F.contains("source_url", F.col("dropped")))
    return cards.filter(known).select(
        "source", "source_url", (F.col("page_id").cast("long") * (1 << 20) + F.col("pos")).alias("seq"), "title", F.col("_title_en").alias("title_en"), "artist",
        F.col("_date_range").alias("date_range"), _absolute(F.col("_poster"), F.when(F.col("reader") == "rss", F.col("source_url")).otherwise(F.col("url"))).alias("poster_image_url"),
        F.coalesce("_venue_name", constant("venue_name")).alias("venue_name"), F.coalesce("_venue_region", constant("venue_region")).alias("venue_region"),
        constant("venue_address").alias("venue_address"), "venue_lat", "venue_lng", "organizer", constant("category").alias("category"),
        constant("exhibition_type_text").alias("exhibition_type_text"), constant("open_hours").alias("open_hours"), "description",
    )


# ---------------------------------------------------------------------------
# details


def _paragraphs(block: Column) -> Column:
    """Texts of the paragraphs of a block, blanks dropped. A paragraph without an end tag ends at the next."""
    opened = F.split(block, r"(?i)<p(?=[\s>])[^>]*>")
    bodies = F.transform(F.slice(opened, 2, F.size(opened)), lambda b: F.get(F.split(b, "(?i)</p>", 2), F.lit(0)))
    return F.filter(F.transform(bodies, plain), lambda p: p != "")


def site_details(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row for each detail page: source, source_url and the fields that its site takes from there."""
    hosted = _hosted(pages, rules).filter((F.col("detail_page") != "") & F.col("html").isNotNull() & F.regexp_like("url", F.col("detail_page")))
    both = F.regexp_like("url", F.col("list_page")) & (F.col("link") != "")
    hosted = hosted.filter(~both).withColumn("parts", F.when(F.col("prose") != "state", markup(F.col("html"))))
    html, parts = F.col("html"), F.col("parts")
    spans = elements(parts, F.when(F.col("prose") != "state", F.col("block_tag")).otherwise(F.lit("")), F.col("block_attrs"))
    posters = F.when((F.col("poster_tag") != "") | (F.col("poster_src") != ""), elements(parts, F.col("poster_tag"), F.col("poster_attrs")))
    hosted = hosted.withColumns({"_blocks": F.transform(spans, lambda s: cut(parts, s)), "_posters": F.transform(posters, lambda s: cut(parts, s)), "_body": F.array_join(parts, "<")}).drop("parts")
    hosted = hosted.withColumns({"_paragraphs": F.transform("_blocks", _paragraphs), "_texts": F.transform("_blocks", plain), "_event": F.when(F.col("prose") == "state", F.get(_state_entry(html, F.col("block_tag")), F.lit(0)))})

    joined = F.zip_with("_paragraphs", "_texts", lambda p, t: F.when(F.size(p) > 0, F.array_join(p, "\n\n")).otherwise(t))
    ranked = F.array_sort(F.transform(joined, lambda b, i: F.struct((-F.length(b)).alias("n"), i.alias("pos"), b.alias("text"))))
    longest = F.get(ranked, F.lit(0))["text"]
    first = lambda c: F.get(c, F.lit(0))
    long_enough = lambda c: F.when(F.length(c) >= MIN_DESCRIPTION_LEN, c)
    prose = F.col("prose")
    described = (
        F.when(prose == "longest", long_enough(longest)).when(prose == "first", _blank(first(joined))).when(prose == "text", _blank(first(F.col("_texts"))))
        .when(prose == "prose", _blank(F.array_join(prose_paragraphs(first(F.col("_paragraphs"))), "\n\n"))).when(prose == "lines", _blank(clean_cell_lines(element_text(first(F.col("_blocks"))))))
        .when(prose == "og", meta_content(html, "og:description")).when(prose == "state", long_enough(clean_paragraph_lines(F.try_variant_get("_event", "$.description", "string"))))
    )
    summary = F.when(F.col("summary"), bind(meta_description(html), lambda m: F.when((prose != "longest") | (F.length(m) >= MIN_DESCRIPTION_LEN), m)))
    lines = first(F.filter("_paragraphs", lambda p: F.size(p) > 0))
    images = F.flatten(F.transform("_posters", lambda b: F.regexp_extract_all(b, F.lit(IMAGE), F.lit(1))))
    image = F.get(F.filter(F.transform(images, F.trim), lambda s: (F.col("poster_src") == "") | F.regexp_like(s, F.col("poster_src"))), F.lit(0))
    code = F.regexp_extract("url", r"/([^/]+?)(?:\.html)?$", 1)
    built = F.when(F.col("poster_format") != "", F.replace("poster_format", F.lit("%s"), code))
    og_image = F.when((F.col("poster_src") == "") & prose.isin("prose", "og", "text", "first"), meta_content(html, "og:image"))
    title = F.when(F.col("detail_title") == "og", meta_content(html, "og:title")).when(F.col("detail_title") == "first", first(lines))
    title = bind(title, lambda t: _blank(clean_whitespace(F.when(F.col("title_cut") != "", F.regexp_replace(t, F.col("title_cut"), F.lit(""))).otherwise(t))))
    hosted = hosted.withColumn("_cells", _cells(F.col("_body")))
    shown = ("open_hours", "venue_address", "price_text", "date_range")
    hosted = hosted.withColumn("_lines", F.transform(F.array(*[_labelled(n) for n in shown]), lambda c: clean_cell_lines(element_text(c))))
    cell = lambda n: _blank(F.get("_lines", F.lit(shown.index(n))))
    date = F.when(F.col("detail_date") == "japanese", bind(plain(F.col("_body")), extract_japanese_date_range)).when(F.col("detail_date") == "last", F.get(lines, F.size(lines) - 1))
    date = date.when(F.col("detail_date") == "label", bind(clean_whitespace(cell("date_range")), backfill_range_year))
    named = lambda cells, name: F.array_distinct(F.filter(F.transform(F.regexp_extract_all(cells, F.lit(_in(r"\w+", name)), F.lit(1)), plain), lambda x: x != ""))
    either = F.array(*[named(F.col("_names"), n) for n in ("aut_name", "aut_wrap_other")])
    names = F.get(F.filter(either, lambda x: F.size(x) > 0), F.lit(0))
    roster = split_artist_roster(F.try_variant_get("_event", "$.artists", "string"))
    hosted = hosted.withColumns({"_price": bind(cell("price_text"), parse_price_table), "_names": _labelled("artists")})
    priced = F.col("_price.price_min").isNotNull() | F.col("_price.price_max").isNotNull() | F.col("_price.notes").isNotNull() | F.col("_price.fee_text").isNotNull()
    return hosted.select(
        "source", _canonical(F.col("url")).alias("source_url"), "page_id", title.alias("title"), _blank(date).alias("date_range"),
        F.coalesce(described, summary).alias("description"), _absolute(F.coalesce(og_image, image, built), F.col("url")).alias("poster_image_url"),
        cell("open_hours").alias("open_hours"), cell("venue_address").alias("venue_address"),
        F.col("_price.fee_text").alias("fee_text"), F.col("_price.notes").alias("price_notes"), F.col("_price.price_min").alias("price_min"), F.col("_price.price_max").alias("price_max"),
        F.when(priced & (F.size("_price.breakdown") > 0), F.col("_price.breakdown")).alias("price_breakdown"), F.coalesce(names, F.when(F.size(roster) > 0, roster)).alias("artists"),
    )


def site_listings(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of the ingest's input: items, first of each address, with what their detail page overrides; without a title none."""
    cards = first_by(site_cards(pages, rules), ["source", "source_url"])
    cards = cards.withColumn("artists", F.when(F.col("artist").isNotNull(), F.array("artist")))
    details = first_by(site_details(pages, rules), ["source", "source_url"], "page_id").drop("page_id")
    details = details.withColumnsRenamed({c: f"_d_{c}" for c in _DETAIL})
    rows = cards.join(details, ["source", "source_url"], "left")
    rows = rows.withColumns({c: F.coalesce(F.col(f"_d_{c}"), F.col(c)) if c in cards.columns else F.col(f"_d_{c}") for c in _DETAIL})
    rows = rows.filter(F.coalesce("title", F.lit("")) != "")
    shape = pages.sparkSession.createDataFrame([], RAW).schema["raw"].dataType
    filled = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields]
    return rows.select("source", "source_url", "seq", F.struct(*filled).alias("raw"))
