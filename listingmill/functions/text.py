"""Text clean-up and matching keys as Spark columns."""

from __future__ import annotations

import html.entities
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values -----------------------------------------------------------
ZERO_WIDTH = "[​-‍﻿]"
# Unicode white space, spelled out: the (?U) classes look properties up per character
SPACE_CHARS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NOT_PLAIN_SPACE = SPACE_CHARS.replace(r"\x20", r"\x1f")
NOT_NEWLINE_SPACE = SPACE_CHARS.replace(r"\t-\r", r"\t\x0b-\r")
# Letters, digits and marks that most texts consist of: one look at them instead of one at each kind of space
COMMON_CHARS = r"!-~\u3041-\ud7a3"
TRIM_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
EMAIL = r"[\p{L}\p{N}_.%+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}"
EMAIL_WITH_LABEL = r"(?iU)[\s]*(?:이메일|메일|e-?mail)[\s]*[:：]?[\s]*" + EMAIL
CITY_RANKS = "특별시|광역시|특별자치시|특별자치도"
TITLE_ORNAMENTS = r"[《》「」『』\"'“”‘’()\[\]" + SPACE_CHARS + "]"
BRACKETED = "[「『《【](.+?)[」』》】]"
MIN_DESCRIPTION_LEN = 60
# -----------------------------------------------------------------------------


# The named character references of the HTML standard, as Python's library lists them.
NAMED_ENTITIES = json.dumps({f"&{name}": char for name, char in html.entities.html5.items() if name.endswith(";")})
COMMON_ENTITIES = {"&lt;": "<", "&gt;": ">", "&amp;": "&", "&quot;": '"', "&nbsp;": "\u00a0"}


def bind(value: Column, use) -> Column:
    """``use`` of a value that it names several times: the value is planned and computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Trim Unicode whitespace on both ends (without the list, ``trim`` only drops U+0020)."""
    return F.btrim(c, F.lit(TRIM_CHARS))


def collapse_spaces(c: Column) -> Column:
    """Every white-space run to one space. Lone plain spaces, nearly all of them, never match."""
    return F.regexp_replace(c, _runs(NOT_PLAIN_SPACE, SPACE_CHARS), " ")


def _runs(first: str, chars: str) -> str:
    """Runs of ``chars`` but for lone plain spaces; ``first`` are those other than the plain space."""
    return f"[[^{COMMON_CHARS}]&&[{first}]][{chars}]*| [[^{COMMON_CHARS}]&&[{chars}]]+"


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def clean_whitespace(c: Column) -> Column:
    return F.trim(collapse_spaces(F.regexp_replace(c, ZERO_WIDTH, "")))


def clean_cell_lines(c: Column) -> Column:
    """Trim every line and drop the blank ones (table cells)."""
    lines = F.transform(F.split(c, r"\r\n|\r|\n"), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def clean_paragraph_lines(c: Column) -> Column:
    """Clean every line and keep at most one blank line between blocks (descriptions)."""
    lines = F.transform(F.split(c, "\n"), clean_whitespace)
    joined = F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(joined, r"^\n+|\n+$", "")


def sanitize_description(c: Column) -> Column:
    """Drop comments, scripts, styles and e-mail addresses; keep titles in angle brackets.

    NULL or blank input gives an empty string.
    """
    out = F.regexp_replace(F.coalesce(c, F.lit("")), ZERO_WIDTH, "")
    for pattern in (
        r"(?s)<!--.*?-->",
        r"(?is)<script\b[^>]*>.*?</script>",
        r"(?is)<style\b[^>]*>.*?</style>",
    ):
        out = F.regexp_replace(out, pattern, " ")
    out = F.when(
        F.contains(out, F.lit("@")),
        F.regexp_replace(F.regexp_replace(out, EMAIL_WITH_LABEL, " "), EMAIL, " "),
    ).otherwise(out)
    out = F.regexp_replace(out, _runs(NOT_NEWLINE_SPACE.replace(r"\x20", r"\x1f"), NOT_NEWLINE_SPACE), " ")
    out = F.regexp_replace(out, r" *\n *", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return strip(out)


@F.pandas_udf(StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def to_nfc(c: Column) -> Column:
    """Canonical composition. Spark has no ``normalize``; pure ASCII rows skip the Python value."""
    ascii_only = ~c.rlike(r"[^\x00-\x7f]")
    return F.when(ascii_only, c).otherwise(_nfc(F.when(~ascii_only, c)))


def normalize_name(c: Column) -> Column:
    return fold_name(to_nfc(c))


def fold_name(c: Column) -> Column:
    """The JVM-only part of :func:`normalize_name`, for text already composed."""
    bare = F.regexp_replace(clean_whitespace(c), r"[^\p{L}\p{N}_ ]", "")
    return F.lower(F.trim(F.regexp_replace(bare, "  +", " ")))


def normalize_address(c: Column) -> Column:
    out = F.regexp_replace(to_nfc(c), r"(?U)^\(\s*\d{3,5}\s*\)\s*", "")
    return clean_whitespace(F.regexp_replace(out, CITY_RANKS, ""))


def dedup_title_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), TITLE_ORNAMENTS, ""))


def core_title_key(c: Column) -> Column:
    core = F.nullif(F.regexp_extract(c, BRACKETED, 1), F.lit(""))
    return dedup_title_key(F.coalesce(core, c))


def decode_entities(c: Column) -> Column:
    """Every named, decimal and hexadecimal character reference, in one pass; a no-break space becomes a plain one.

    Unknown names stay as they are, numbers that are no character become U+FFFD.
    """
    names = F.from_json(F.lit(NAMED_ENTITIES), "map<string, string>")

    def decoded(entity: Column) -> Column:
        digits = F.regexp_extract(entity, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
        hexadecimal = F.lower(F.substring(entity, 3, 1)) == "x"
        number = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).try_cast("long")

        def character(point: Column) -> Column:
            fits = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
            return F.decode(F.unhex(F.lpad(F.hex(F.when(fits, point).otherwise(0xFFFD)), 8, "0")), "UTF-32")

        # A lookup in the map reads its two thousand names one by one; most references are of these few.
        plain = F.when(F.startswith(entity, F.lit("&#")), bind(number, character))
        for name, char in COMMON_ENTITIES.items():
            plain = plain.when(entity == name, F.lit(char))
        return bind(plain.otherwise(F.coalesce(F.try_element_at(names, entity), entity)), lambda p: F.when(p == "\u00a0", " ").otherwise(p))

    pattern = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"

    def whole(value: Column) -> Column:
        found = F.transform(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), decoded)
        joined = F.zip_with(F.split(value, pattern, -1), found, lambda gap, char: F.concat(gap, F.coalesce(char, F.lit(""))))
        return F.when(F.contains(value, F.lit("&")), F.array_join(joined, "")).otherwise(value)

    return bind(c, whole)


def strip_markup(c: Column) -> Column:
    return clean_whitespace(decode_entities(F.regexp_replace(c, "<[^>]+>", " ")))


def split_csv(c: Column) -> Column:
    """Comma list to a trimmed array without blanks; NULL gives an empty array."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip)
    return F.filter(parts, lambda x: x != "")


def split_artist_roster(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[、，,]"), strip)
    return F.filter(parts, lambda x: x != "")


def clean_listing_title(c: Column) -> Column:
    """Room tag, hall prefix, site suffix, trailing date, truncation dots and underscore removed."""
    out = F.regexp_replace(c, r"^\s*\[[^\]]+\]\s*", "")
    out = F.regexp_replace(out, r"\s*[|｜].*$", "")
    out = F.regexp_replace(out, r"_?\s*\d{4}\s*\.\s*\d{1,2}\s*\.\s*\d{1,2}.*$", "")
    out = F.regexp_replace(strip(out), r"\s*\.\.$", "")
    return F.regexp_replace(clean_whitespace(out), "[_ ]+$", "")


QUOTED_TITLE = "[\"“”「『](.+?)[\"”」』]"


def split_artist_title(c: Column) -> Column:
    """``artist 「title」`` to a struct(artist, title); the whole text is the title without quotes."""
    whole = clean_whitespace(c)
    quoted = clean_whitespace(F.regexp_extract(c, QUOTED_TITLE, 1))
    before = F.regexp_replace(c, "(?s)" + QUOTED_TITLE + ".*$", "")
    artist = clean_whitespace(F.regexp_replace(before, r"(?:写真展|個展|展)\s*$", ""))
    found = c.rlike(QUOTED_TITLE)
    return F.struct(
        F.when(found, F.nullif(artist, F.lit(""))).alias("artist"),
        F.when(found & (quoted != ""), quoted).otherwise(whole).alias("title"),
    )
