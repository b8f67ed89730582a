"""Pages to raw listings, driven by a rule table instead of one parser per site.

A rule row says how one host's pages are read: a regex that cuts cards, a regex per field, and
constants. Adding a site means adding a row. JSON, RSS and label-table pages have their own
readers below; all of them are built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listingmill.functions.dates import NUMERIC, extract_date_range
from listingmill.functions.text import (
    MIN_DESCRIPTION_LEN,
    bind,
    clean_listing_title,
    clean_whitespace,
    decode_entities,
    strip_markup,
)
from listingmill.functions.urls import absolutise_url, keep_query_params, lookup, strip_rss_marker
from listingmill.operators.joins import lookup_join
from listingmill.operators.merge import first_by

RULES = "host STRING, source STRING, card_regex STRING, field_regex MAP<STRING, STRING>, constants MAP<STRING, STRING>"
FIELDS = (
    "title", "date_range", "venue_name", "venue_region", "venue_address", "category", "description",
    "poster_image_url", "link",
)

# --- fixed values -----------------------------------------------------------
PHOTO_KEYWORDS = ("写真", "フォト", "photography", "photo")
PHOTO_CARD_KEYWORDS = ("사진", "포토", "photo", "Photo", "PHOTO")
RSS_CATEGORIES = ("전시소식", "기타전시")
POSTER_MARKERS = ("/u_image/", "uploaded/board/exhib", "photo_event")
SECTION_SLUGS = (
    "about", "access", "contact", "current", "upcoming", "past", "archive", "news", "member", "rental",
    "workshop", "shop", "category", "tag", "wp", "en", "privacy-policy", "law",
)
PLACEHOLDER_TITLE = "Coming Soon"
SPACE_VENUES = {
    "HD": "KT&G 상상마당 홍대 갤러리",
    "NS": "KT&G 상상마당 논산 갤러리",
    "CC": "KT&G 상상마당 춘천 갤러리",
    "DC": "KT&G 상상마당 대치 갤러리",
    "BS": "KT&G 상상마당 부산 갤러리",
}
SPACE_REGIONS = {"HD": "서울", "NS": "충남", "CC": "강원도", "DC": "서울", "BS": "부산"}
DEFAULT_SPACE = "HD"
ORGANIZER_LEAD = r"^(.+?)(?:와|이)\s+(?:한국|방송|미디어)"
LABEL_FIELDS = {"시간": "open_hours", "주소": "venue_address", "관람료": "price_text", "기간": "date_range", "장소": "venue_name", "開催期間": "date_range"}
# -----------------------------------------------------------------------------


def page_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def extract_listing_pages(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(source, source_url, page_id, card, fields…) for every card of every page with a rule.

    ``rules`` is one row per host, broadcast after a size check, so page texts do not shuffle.
    """
    hosted = pages.select("page_id", "url", "html", page_host(F.col("url")).alias("host"))
    cards = (
        lookup_join(hosted, rules, "host", spread_by=F.col("page_id"))
        .select(
            "page_id", "url", "host", "source", "field_regex", "constants",
            F.posexplode(F.regexp_extract_all("html", F.col("card_regex"), F.lit(1))).alias("card_pos", "card"),
        )
    )

    def field(name: str) -> Column:
        pattern = F.try_element_at("field_regex", F.lit(name))
        found = F.get(F.regexp_extract_all("card", pattern, F.lit(1)), F.lit(0))
        constant = F.try_element_at("constants", F.lit(name))
        return F.coalesce(F.nullif(strip_markup(found), F.lit("")), constant)

    out = cards.select("page_id", "url", "host", "source", "card_pos", "card", *[field(n).alias(n) for n in FIELDS])
    link = F.when(F.startswith("link", F.lit("/")), F.concat(F.lit("https://"), F.col("host"), F.col("link"))).otherwise(F.col("link"))
    return out.withColumn("source_url", F.coalesce(link, "url")).drop("link", "host")


# --- pieces of a detail page ------------------------------------------------------


def meta_content(html: Column, name: str) -> Column:
    """Content of ``<meta property|name="…">``; whitespace cleaned, blank as NULL."""
    pattern = rf'(?is)<meta[^>]*?(?:property|name)\s*=\s*["\']{name}["\'][^>]*?content\s*=\s*(?:"([^"]*)"|\'([^\']*)\')'
    found = F.concat(F.regexp_extract(html, pattern, 1), F.regexp_extract(html, pattern, 2))
    return F.nullif(clean_whitespace(decode_entities(found)), F.lit(""))


def meta_description(html: Column) -> Column:
    return F.coalesce(*[meta_content(html, n) for n in ("og:description", "description", "twitter:description")])


def og_tags(html: Column) -> Column:
    """struct(title, image, description); the title is the part left of ``|``."""
    title = clean_whitespace(F.substring_index(meta_content(html, "og:title"), "|", 1))
    return F.struct(
        F.nullif(title, F.lit("")).alias("title"),
        meta_content(html, "og:image").alias("image"),
        meta_content(html, "og:description").alias("description"),
    )


def image_sources(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?is)<img[^>]*?src\s*=\s*["\']([^"\']*)["\']'), F.lit(1))


def poster(html: Column, host: str, fallback: Column | None = None) -> Column:
    """og:image, else the first image under a poster path, else the constructed address."""
    marked = F.filter(
        F.transform(image_sources(html), F.trim),
        lambda s: F.contains(s, F.lit(POSTER_MARKERS[0]))
        | F.contains(s, F.lit(POSTER_MARKERS[1]))
        | (F.contains(s, F.lit(POSTER_MARKERS[2])) & F.contains(s, F.lit("_mv"))),
    )
    options = [meta_content(html, "og:image"), absolutise_url(F.get(marked, F.lit(0)), host)]
    return F.coalesce(*options, *([fallback] if fallback is not None else []))


def paragraphs(html: Column) -> Column:
    """Cleaned texts of the ``<p>`` elements, blanks dropped."""
    opened = F.split(html, r"(?i)<p(?=[\s>])[^>]*>")
    after = bind(opened, lambda o: F.slice(o, 2, F.size(o)))
    bodies = F.transform(after, lambda b: F.get(F.split(b, "(?i)</p>", 2), F.lit(0)))
    return F.filter(F.transform(bodies, strip_markup), lambda p: p != "")


def paragraph_text(html: Column) -> Column:
    """Paragraphs joined by a blank line, else the whole text; NULL below the minimum length."""
    text = bind(paragraphs(html), lambda parts: F.when(F.size(parts) > 0, F.array_join(parts, "\n\n")).otherwise(strip_markup(html)))
    return bind(text, lambda t: F.when(F.length(t) >= MIN_DESCRIPTION_LEN, t))


def prose_paragraphs(parts: Column) -> Column:
    """Photo credits and date-only rows are no prose."""
    return F.filter(parts, lambda p: ~F.startswith(p, F.lit("©")) & ~p.rlike(NUMERIC))


def longest_block(blocks: Column, html: Column) -> Column:
    """The longest block (the first on a tie) if long enough, else the page's meta description if that is."""
    ranked = F.array_sort(
        F.transform(blocks, lambda b, i: F.struct((-F.length(b)).alias("n"), i.alias("pos"), b.alias("text")))
    )
    best = F.get(ranked, F.lit(0))["text"]
    chosen = F.when(F.length(best) >= MIN_DESCRIPTION_LEN, best).otherwise(F.coalesce(meta_description(html), best))
    return F.when(F.length(chosen) >= MIN_DESCRIPTION_LEN, chosen)


def label_table(html: Column) -> Column:
    """``<th>label</th><td>value</td>`` pairs as a map; the last value of a label wins.

    The page is searched once, and a pair is read from its match.
    """
    pattern = r"(?is)<th[^>]*>(.*?)</th>\s*<td[^>]*>(.*?)</td>"

    def pair(found: Column) -> Column:
        name = F.regexp_replace(strip_markup(F.regexp_extract(found, pattern, 1)), r"\s*\|\s*$", "")
        return F.struct(name.alias("label"), strip_markup(F.regexp_extract(found, pattern, 2)).alias("value"))

    pairs = F.filter(F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), pair), lambda e: e["label"] != "")
    return F.map_from_entries(_last_of_key(pairs, "label"))


def _last_of_key(entries: Column, key: str) -> Column:
    """Map keys must be unique: an entry stays only when no later one has its key."""
    return bind(
        entries,
        lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda later: later[key] == e[key])),
    )


def label_fields(table: Column) -> Column:
    """The label map renamed to listing fields; unknown labels and blank values dropped."""
    kept = F.map_filter(table, lambda k, v: k.isin(*LABEL_FIELDS) & (v != ""))
    entries = F.transform(F.map_entries(kept), lambda e: F.struct(lookup(LABEL_FIELDS, e["key"]).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(_last_of_key(entries, "key"))


def organizer(paragraph_texts: Column) -> Column:
    """Organiser named first in the intro sentence."""
    intro = F.filter(paragraph_texts, lambda p: p.rlike(ORGANIZER_LEAD))
    return F.nullif(F.trim(F.regexp_extract(F.get(intro, F.lit(0)), ORGANIZER_LEAD, 1)), F.lit(""))


def venue_without_address(venue: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(venue, r"\s*\([^)]+\)\s*$", "")), F.lit(""))


# --- JSON and RSS pages -----------------------------------------------------------


def embedded_events(pages: DataFrame, entry: str = "EventSearch") -> DataFrame:
    """(page_id, pos, event VARIANT) of the page-state JSON in ``<script id="__NEXT_DATA__">``."""
    blob = F.regexp_extract("html", r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    state = F.try_variant_get(F.try_parse_json(blob), "$.props.pageProps.fallback", "variant")
    keyed = pages.select("page_id", state.alias("state")).filter(F.col("state").isNotNull())
    entries = keyed.select("page_id", F.expr("try_cast(state AS MAP<STRING, VARIANT>)").alias("m"))
    data = entries.select("page_id", F.explode("m").alias("key", "value")).filter(
        F.contains("key", F.lit(f'"name":"{entry}"'))
    )
    events = F.try_variant_get("value", "$.data", "array<variant>")
    return data.select("page_id", F.posexplode(events).alias("pos", "event"))


def event_rows(events: DataFrame, base_url: str) -> DataFrame:
    """Embedded events with a photographic category, a slug, a title and a venue, flattened."""

    def get(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("event", path, kind)

    names = F.transform(
        F.coalesce(get("$.categories", "array<variant>"), F.array().cast("array<variant>")),
        lambda c: F.lower(F.coalesce(F.try_variant_get(c, "$.fields.name", "string"), F.lit(""))),
    )
    poster_url = get("$.imageposter.fields.file.url")
    starts, ends = get("$.scheduleStartsOn"), get("$.scheduleEndsOn")
    rows = events.select(
        "page_id", "pos",
        F.concat(F.lit(f"{base_url}/events/-/"), get("$.slug")).alias("source_url"),
        get("$.eventName").alias("title"),
        get("$.venue.fields.fullName").alias("venue_name"),
        get("$.venue.fields.localArea.fields.name").alias("venue_region"),
        get("$.venue.fields.geoInfo.lat", "double").alias("venue_lat"),
        get("$.venue.fields.geoInfo.lon", "double").alias("venue_lng"),
        F.when(starts.isNotNull() & ends.isNotNull(), F.concat(starts, F.lit(" ~ "), ends)).otherwise(F.coalesce(starts, ends)).alias("date_range"),
        F.when(F.startswith(poster_url, F.lit("//")), F.concat(F.lit("https:"), poster_url)).otherwise(poster_url).alias("poster_image_url"),
        names.alias("categories"),
    )
    filled = [F.coalesce(c, F.lit("")) != "" for c in ("source_url", "title", "venue_name")]
    return relevant_categories(rows.filter(filled[0] & filled[1] & filled[2]))


def json_items(responses: DataFrame) -> DataFrame:
    """(page_id, pos, item) of the list API; a missing path gives no rows."""
    schema = (
        "displayListInfo STRUCT<displayList: ARRAY<STRUCT<title: STRING, contentsSeq: STRING, spaceCd: STRING, "
        "term: STRING, posterFilePath: STRING>>>"
    )
    parsed = F.from_json("body", schema)
    return responses.select("page_id", F.posexplode(parsed["displayListInfo"]["displayList"]).alias("pos", "item"))


def json_item_rows(items: DataFrame, base_url: str) -> DataFrame:
    title = F.trim(decode_entities(F.col("item.title")))
    code = F.coalesce("item.spaceCd", F.lit(DEFAULT_SPACE))
    return items.select(
        "page_id", "pos", title.alias("title"),
        F.concat(F.lit(f"{base_url}/display/detail/"), F.col("item.contentsSeq")).alias("source_url"),
        space_venue(code).alias("venue_name"), space_region(code).alias("venue_region"),
        F.nullif("item.term", F.lit("")).alias("date_range"),
        F.nullif("item.posterFilePath", F.lit("")).alias("poster_image_url"),
    ).filter((F.coalesce("title", F.lit("")) != "") & F.col("source_url").isNotNull() & photo_title(F.col("title")))


def rss_rows(items: DataFrame, host: str, categories: tuple[str, ...] | None = RSS_CATEGORIES) -> DataFrame:
    """Rows of RSS items (title, link, category array, description); ``categories`` is the feed's allow-set, None keeps all."""
    allowed = F.lit(True)
    if categories is not None:
        allowed = F.arrays_overlap(F.transform("category", F.trim), F.array(*[F.lit(c) for c in categories]))
    image = F.get(image_sources(F.col("description")), F.lit(0))
    return (
        items.filter(allowed)
        .select(
            clean_listing_title(F.col("title")).alias("title"),
            strip_rss_marker(F.col("link")).alias("source_url"),
            F.trim(image).alias("image"),
            strip_markup(F.col("description")).alias("body"),
        )
        .select(
            "title", "source_url", absolutise_url(F.col("image"), host).alias("poster_image_url"),
            extract_date_range(F.col("body")).alias("date_range"),
        )
        .filter((F.coalesce("title", F.lit("")) != "") & F.startswith("source_url", F.lit(f"https://{host}")))
    )


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    schema = "title STRING, link STRING, category ARRAY<STRING>, description STRING"
    return spark.read.format("xml").option("rowTag", "item").option("multiLine", "false").schema(schema).load(path)


# --- row rules --------------------------------------------------------------------


def space_venue(code: Column) -> Column:
    return F.coalesce(lookup(SPACE_VENUES, code), F.lit(SPACE_VENUES[DEFAULT_SPACE]))


def space_region(code: Column) -> Column:
    return F.coalesce(lookup(SPACE_REGIONS, code), F.lit(SPACE_REGIONS[DEFAULT_SPACE]))


def _contains_any(c: Column, words) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(c, F.lit(word))
    return out


def photo_title(title: Column) -> Column:
    return _contains_any(title, PHOTO_CARD_KEYWORDS)


def relevant_categories(rows: DataFrame) -> DataFrame:
    return rows.filter(F.exists("categories", lambda c: _contains_any(F.lower(c), PHOTO_KEYWORDS)))


def listing_page(url: Column, title: Column, block: Column) -> Column:
    """A listing, not a section page, film card, placeholder or undated block."""
    slug = F.lower(F.regexp_extract(url, r"^https?://[^/]+/([^/?#]+)/?$", 1))
    return (
        ~slug.isin(*SECTION_SLUGS)
        & ~F.contains(url, F.lit("/movie/"))
        & (F.coalesce(title, F.lit("")) != "")
        & (title != PLACEHOLDER_TITLE)
        & block.rlike(r"\d{4}\s*\.\s*\d{1,2}\s*\.\s*\d{1,2}")
    )


def dedupe_by_url(listings: DataFrame) -> DataFrame:
    return first_by(listings, ["source", "source_url"])


def merge_detail(listings: DataFrame, details: DataFrame, fields: list[str]) -> DataFrame:
    """Detail values override the list row's; a missing detail or NULL value leaves it."""
    side = details.select("source_url", *[F.col(f).alias(f"_d_{f}") for f in fields])
    joined = listings.join(side, "source_url", "left")
    return joined.select(
        *[F.coalesce(f"_d_{c}", c).alias(c) if c in fields else F.col(c) for c in listings.columns],
        *[F.col(f"_d_{f}").alias(f) for f in fields if f not in listings.columns],
    )


def source_health(registry: DataFrame, counts_from: DataFrame, failures: DataFrame) -> DataFrame:
    """(source, n, health) for every registered source: ok, empty or FAIL."""
    counts = counts_from.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    broken = failures.select("source", F.lit(True).alias("failed")).distinct()
    return registry.join(counts, "source", "left").join(broken, "source", "left").select(
        "source", "source_rank",
        F.when(F.col("failed"), F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n"),
        F.when(F.col("failed"), F.lit("FAIL")).when(F.col("n") > 0, F.lit("ok")).otherwise(F.lit("empty")).alias("health"),
    )


def canonical_board_url(url: Column) -> Column:
    return keep_query_params(url, {"boardid": "exhib", "mode": "view", "idx": None}, numeric="idx")
