"""Keyword classifiers. Every one is an ordered CASE over substring tests."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
PHOTO_WORDS = ("사진", "photo", "写真", "フォト")
VIDEO_WORDS = ("영상", "video", "film", "movie", "미디어", "映像", "動画")
GEAR_WORDS = ("카메라", "camera", "장비", "기자재", "imaging", "カメラ", "機材")
TYPE_WORDS = (
    ("solo", ("개인전", "solo")),
    ("group", ("단체전", "group")),
    ("festival", ("페스티벌", "festival")),
    ("expo", ("박람회", "expo", "fair", "show")),
    ("permanent", ("상설", "permanent")),
    ("curated", ("기획", "curated")),
)
TITLE_TYPE_WORDS = (
    ("solo", ("개인전", "個展", "solo exhibition", "solo show")),
    ("group", ("단체전", "그룹전", "2인전", "3인전", "group exhibition", "group show")),
)
VENUE_WORDS = (
    ("museum", ("미술관", "museum")),
    ("gallery", ("갤러리", "gallery")),
    ("convention", ("coex", "kintex", "컨벤션", "convention", "센터")),
    ("cafe", ("카페", "cafe")),
    ("alt_space", ("대안공간", "alt space", "스페이스")),
)
ORGANIZER_WORDS = (
    ("museum", ("미술관",)),
    ("gallery", ("갤러리",)),
    ("foundation", ("재단", "foundation")),
    ("association", ("협회", "association")),
    ("corporate", ("주식회사", "corp", "inc", "ltd")),
    ("public", ("시청", "공사", "공단", "정부", "구청")),
)
PARTIAL_FEE_WORDS = ("일부 유료", "partial")
FREE_WORDS = ("무료", "free")
PLACEHOLDER_IMAGE = "(?i)coming[-_]?soon|no[-_]?image|noimg|placeholder|dummy"
HANGUL, KANA_OR_HAN = "[가-힣]", "[぀-ヿ一-鿿]"
LOCALES = ("ko", "en", "ja")
# -----------------------------------------------------------------------------


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def folded(text: Column) -> Column:
    """The text that words are looked up in. Every word names it again, so a plan of many columns stages it."""
    return F.lower(F.coalesce(text, F.lit("")))


def _first_label(text: Column, table, chain: Column | None = None) -> Column:
    for label, words in table:
        test = has_any(text, words)
        chain = F.when(test, F.lit(label)) if chain is None else chain.when(test, F.lit(label))
    return chain


def map_medium(text: Column) -> Column:
    return medium_of(folded(text))


def medium_of(t: Column) -> Column:
    photo, video, gear = (has_any(t, w) for w in (PHOTO_WORDS, VIDEO_WORDS, GEAR_WORDS))
    return (
        F.when(photo & video, F.lit("mixed"))
        .when(photo, F.lit("photo"))
        .when(video, F.lit("video"))
        .when(gear, F.lit("gear"))
        .otherwise(F.lit("mixed"))
    )


def map_exhibition_type(text: Column, title: Column, artist_count: Column) -> Column:
    return exhibition_type_of(folded(text), folded(title), artist_count)


def exhibition_type_of(text: Column, title: Column, artist_count: Column) -> Column:
    chain = _first_label(text, TYPE_WORDS)
    chain = _first_label(title, TITLE_TYPE_WORDS, chain)
    return (
        chain.when(artist_count == 1, F.lit("solo"))
        .when(artist_count >= 2, F.lit("group"))
        .otherwise(F.lit("curated"))
    )


def map_venue_type(text: Column) -> Column:
    return _first_label(folded(text), VENUE_WORDS).otherwise(F.lit("other"))


def map_organizer_type(text: Column) -> Column:
    return _first_label(folded(text), ORGANIZER_WORDS).otherwise(F.lit("other"))


def map_fee_type(text: Column, price_min: Column, price_max: Column) -> Column:
    return fee_type_of(folded(text), price_min, price_max)


def fee_type_of(t: Column, price_min: Column, price_max: Column) -> Column:
    priced = price_min.isNotNull() & price_max.isNotNull()
    return (
        F.when(has_any(t, PARTIAL_FEE_WORDS), F.lit("partial"))
        .when(has_any(t, FREE_WORDS), F.lit("free"))
        .when(priced & (price_min == 0) & (price_max > 0), F.lit("partial"))
        .when(priced & (price_min > 0), F.lit("paid"))
        .otherwise(F.lit("free"))
    )


def drop_placeholder_image(url: Column) -> Column:
    return F.when(~url.rlike(PLACEHOLDER_IMAGE), url)


def detect_lang(text: Column) -> Column:
    return (
        F.when(text.rlike(HANGUL), F.lit("ko"))
        .when(text.rlike(KANA_OR_HAN), F.lit("ja"))
        .otherwise(F.lit("en"))
    )


def target_locales(lang: Column) -> Column:
    return F.array_remove(F.array(*[F.lit(x) for x in LOCALES]), lang)


def row_lang(fields: list[Column]) -> Column:
    """Language of the first non-blank field, Korean when all are blank."""
    first = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in fields])
    return F.when(first.isNull(), F.lit("ko")).otherwise(detect_lang(first))


def price_label(fee_type: Column, price_min: Column) -> Column:
    """struct(kind, amount): free, from-price, or paid without a known price."""
    kind = (
        F.when(fee_type == "free", F.lit("free"))
        .when(price_min > 0, F.lit("from"))
        .otherwise(F.lit("paid"))
    )
    return F.struct(kind.alias("kind"), F.when(kind == "from", price_min).alias("amount"))
