"""Typed reads of stored cells, price tables and small validations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listingmill.functions.text import bind, strip

# --- fixed values -----------------------------------------------------------
FEEDBACK_TYPES = ("bug", "feature", "other")
MAX_MESSAGE, MAX_IMAGES, MAX_IMAGE_BYTES = 2000, 3, 5 * 1024 * 1024
IMAGE_TYPES = ("image/jpeg", "image/png", "image/webp")
EMAIL_SHAPE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
DISCOUNT, FREE, DEFAULT_TIER, PRICE = "할인", "무료", "기본", r"(\d{1,3}(?:,\d{3})*)\s*원"
# -----------------------------------------------------------------------------


def int_or_null(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("int")


def finite_or_null(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def float_or_null(c: Column) -> Column:
    return finite_or_null(F.nullif(c, F.lit("")).try_cast("double"))


def bool_cell(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c)) == "TRUE", F.lit(False))


def parse_price_table(text: Column) -> Column:
    """struct(price_min, price_max, breakdown, notes, fee_text) of a multi-line price cell.

    Lines, prices and tiers are bound, as each is named several times: none is computed again for a mention.
    """
    lines = F.filter(
        F.transform(
            F.split(text, r"\r\n|\r|\n"), lambda x: strip(F.regexp_replace(strip(x), "^·+", ""))
        ),
        lambda x: x != "",
    )

    def tier(line: Column) -> Column:
        labelled = F.contains(line, F.lit(":"))
        label = F.when(labelled, strip(F.substring_index(line, ":", 1))).otherwise(F.lit(""))
        value = F.when(labelled, strip(F.regexp_replace(line, "^[^:]*:", ""))).otherwise(line)

        def read(value: Column) -> Column:
            found = F.transform(
                F.regexp_extract_all(value, F.lit(PRICE), F.lit(1)),
                lambda p: F.replace(p, F.lit(","), F.lit("")).try_cast("int"),
            )
            names_free = F.contains(value, F.lit(FREE)) | F.contains(F.lower(value), F.lit("free"))
            return bind(found, lambda prices: F.struct(prices.alias("prices"), ((F.size(prices) == 0) & names_free).alias("free")))

        return bind(
            bind(value, read),
            lambda v: F.struct(
                F.coalesce(F.nullif(label, F.lit("")), F.lit(DEFAULT_TIER)).alias("label"),
                F.when(F.size(v["prices"]) > 0, F.array_max(v["prices"])).when(v["free"], F.lit(0)).alias("amount"),
                F.array_min(v["prices"]).alias("low"),
                v["free"].alias("free"),
            ),
        )

    def summed(notes: Column, tiers: Column) -> Column:
        any_free = F.exists(tiers, lambda t: t["free"])
        low = F.array_min(F.transform(tiers, lambda t: t["low"]))
        high = F.array_max(F.transform(F.filter(tiers, lambda t: ~t["free"]), lambda t: t["amount"]))
        bounds = F.struct(
            F.when(any_free, F.lit(0)).otherwise(low).alias("price_min"),
            F.when(F.size(tiers) > 0, F.coalesce(high, F.lit(0))).alias("price_max"),
        )
        return bind(
            bounds,
            lambda b: F.struct(
                b["price_min"].alias("price_min"),
                b["price_max"].alias("price_max"),
                F.transform(
                    tiers, lambda t: F.struct(t["label"].alias("label"), t["amount"].alias("amount"))
                ).alias("breakdown"),
                notes.alias("notes"),
                F.when(b["price_min"].isNull() & b["price_max"].isNull(), F.nullif(text, F.lit(""))).alias("fee_text"),
            ),
        )

    def whole(lines: Column) -> Column:
        notes = F.nullif(F.array_join(F.filter(lines, lambda x: F.contains(x, F.lit(DISCOUNT))), "\n"), F.lit(""))
        tiers = F.filter(
            F.transform(F.filter(lines, lambda x: ~F.contains(x, F.lit(DISCOUNT))), tier),
            lambda t: t["amount"].isNotNull(),
        )
        return bind(tiers, lambda t: summed(notes, t))

    return bind(lines, whole)


def base64_bytes(b64: Column) -> Column:
    padding = F.when(F.endswith(b64, F.lit("==")), 2).when(F.endswith(b64, F.lit("=")), 1).otherwise(0)
    return F.floor(F.length(b64) * 3 / 4) - padding


def validate_feedback(kind: Column, message: Column, reply_to: Column, images: Column) -> Column:
    """First failing rule, NULL when the feedback is valid."""
    text = strip(message)
    pictures = F.coalesce(images, F.array().cast("array<struct<filename:string,type:string,dataBase64:string>>"))
    return (
        F.when(F.coalesce(~kind.isin(*FEEDBACK_TYPES), F.lit(True)), F.lit("invalid type"))
        .when(message.isNull() | ~F.length(text).between(1, MAX_MESSAGE), F.lit("invalid message"))
        .when(F.coalesce(~strip(reply_to).rlike(EMAIL_SHAPE), F.lit(True)), F.lit("invalid email"))
        .when(F.size(pictures) > MAX_IMAGES, F.lit("too many images"))
        .otherwise(
            F.get(
                F.filter(
                    F.transform(
                        pictures,
                        lambda i: F.when(i["filename"].isNull() | i["dataBase64"].isNull(), F.lit("invalid image"))
                        .when(F.coalesce(~i["type"].isin(*IMAGE_TYPES), F.lit(True)), F.lit("invalid image type"))
                        .when(base64_bytes(i["dataBase64"]) > MAX_IMAGE_BYTES, F.lit("image too large")),
                    ),
                    lambda reason: reason.isNotNull(),
                ),
                F.lit(0),
            )
        )
    )


def year_of(credit: Column) -> Column:
    """First plausible year of a credit line, 0 when there is none."""
    return F.coalesce(
        F.regexp_extract(credit, r"\b((?:18|19|20)\d{2})\b", 1).try_cast("int"), F.lit(0)
    )


def decade_of(year: Column) -> Column:
    return F.when(year > 0, (F.floor(year / 10) * 10).cast("int")).otherwise(F.lit(0))
