"""The ``tr`` map: locale -> field -> text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listingmill.functions.classify import LOCALES
from listingmill.functions.text import sanitize_description

EMPTY_TR = "map<string,map<string,string>>"


def empty_tr() -> Column:
    return F.create_map().cast(EMPTY_TR)


def parse_translation_map(tr_json: Column, fields: tuple[str, ...]) -> Column:
    """Stored JSON to a map. Malformed JSON or buckets give nothing; descriptions are sanitised.

    One JSON parse per row into VARIANT, then a typed read per (locale, field): a single
    ``from_json`` would null the whole map on one malformed bucket.
    """
    doc = F.try_parse_json(tr_json)
    buckets = []
    for locale in LOCALES:
        entries = []
        for field in fields:
            text = F.try_variant_get(doc, f"$.{locale}.{field}", "string")
            if field == "description":
                text = F.nullif(sanitize_description(text), F.lit(""))
            entries += [F.lit(field), text]
        bucket = F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())
        buckets += [F.lit(locale), bucket]
    return F.map_filter(F.create_map(*buckets), lambda _, v: F.size(v) > 0)


def tr_text(tr: Column, locale, field: str) -> Column:
    locale = F.lit(locale) if isinstance(locale, str) else locale
    return F.try_element_at(F.try_element_at(tr, locale), F.lit(field))


def localized(original: Column, tr: Column, locale, field: str) -> Column:
    """The translation when present, non-empty and different; otherwise NULL."""
    text = F.nullif(tr_text(tr, locale, field), F.lit(""))
    return F.when(~text.eqNullSafe(F.coalesce(original, F.lit(""))), text)


def in_locale(original: Column, tr: Column, locale, field: str) -> Column:
    return F.coalesce(localized(original, tr, locale, field), original, F.lit(""))


def bilingual(original: Column, translated: Column) -> Column:
    """struct(primary, secondary): translation over original when it differs."""
    differs = (F.coalesce(translated, F.lit("")) != "") & (translated != original)
    return F.struct(
        F.when(differs, translated).otherwise(original).alias("primary"),
        F.when(differs, original).alias("secondary"),
    )


def prune_fields(tr: Column, keep: tuple[str, ...]) -> Column:
    """Only in-scope fields; empty buckets go."""
    cut = F.transform_values(tr, lambda _, b: F.map_filter(b, lambda f, __: f.isin(*keep)))
    return F.map_filter(cut, lambda _, b: F.size(b) > 0)


def clear_fields(tr: Column, drop: tuple[str, ...]) -> Column:
    cut = F.transform_values(tr, lambda _, b: F.map_filter(b, lambda f, __: ~f.isin(*drop)))
    return F.map_filter(cut, lambda _, b: F.size(b) > 0)


def merge_tr(base: Column, patch: Column) -> Column:
    """Per (locale, field) merge, the patch winning."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(
        F.coalesce(base, empty_tr()),
        F.coalesce(patch, empty_tr()),
        lambda _, b, p: F.map_zip_with(
            F.coalesce(b, empty), F.coalesce(p, empty), lambda __, x, y: F.coalesce(y, x)
        ),
    )
