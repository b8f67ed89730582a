"""Date grammar of the listings: Korean, Japanese, numeric and English forms, single or range.

Only the enumerated forms parse. A date with no year anywhere stays NULL; nothing ever
depends on the current day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingmill.functions.text import bind, strip

# --- fixed values -----------------------------------------------------------
RANGE_SEPARATOR = r"(?U)\s*[~–—〜～－]\s*|\s+-\s+"
YEAR_TOKEN = r"(?U)\b(\d{4})\b"
KOREAN = r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일"
JAPANESE = r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
NUMERIC = r"^(\d{4})\s*[.\-/]\s*(\d{1,2})\s*[.\-/]\s*(\d{1,2})"
SHORT_END = (
    r"(?U)^\s*(?:(\d{1,2})\s*[월月.\-/]\s*)?(\d{1,2})\s*[일日]?\s*"
    r"(?:[（(]\s*[월화수목금토일月火水木金土日]\s*[）)])?\s*$"
)
MONTH = (
    "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    "|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_FIRST = rf"(?i:{MONTH}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?\s*,?\s+(\d{{4}}))"
DAY_FIRST = rf"(?i:(\d{{1,2}})(?:st|nd|rd|th)?\s+{MONTH}\.?\s*,?\s+(\d{{4}}))"
WEEKDAY_PARENS = r"[（(]\s*[월화수목금토일月火水木金土日]\s*[）)]"
ENGLISH_WEEKDAY_PARENS = r"(?i)[（(]\s*(?:mon|tue|wed|thu|fri|sat|sun)\s*[）)]"
DOTTED_SPAN = (
    r"(?U)(\d{4})\s*\.\s*(\d{1,2})\s*\.\s*(\d{1,2})\s*\.?"
    r"\s*[~∼〜～\-–—－−]\s*"
    r"(?:(\d{4})\s*\.\s*)?(?:(\d{1,2})\s*\.\s*)?(\d{1,2})\s*\.?"
)
JAPANESE_SPAN = (
    r"(?U)(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日[^0-9年]*?"
    r"(?:(\d{4})\s*年\s*)?(?:(\d{1,2})\s*月\s*)?(\d{1,2})\s*日"
)
# -----------------------------------------------------------------------------

# Every notation in the order of its claim on a text, the first two anywhere in it; a text of none leaves all groups empty.
NOTATIONS = rf"^(?:(?s:(?:.*?{KOREAN}|.*?{JAPANESE}|{NUMERIC[1:]}).*)|{MONTH_FIRST}|{DAY_FIRST}|(?s:.*))$"
MONTH_NAME = "[A-Za-z]+"
YEAR_MONTH_DAY = "$1$4$7$12$15-$2$5$8$10$14-$3$6$9$11$13"


def _date(y: Column, m: Column, d: Column) -> Column:
    """A date from numeric or text parts, NULL when impossible (``make_date`` throws under ANSI)."""
    parts = [p.cast("string") for p in (y, m, d)]
    return F.concat(parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2]).try_cast("date")


def _group(c: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))


def _month_number(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3)))


def _ordered(raw: Column) -> Column:
    """``y-m-d`` of any notation in one regex pass, a month maybe by name; ``--`` where none is."""
    return F.regexp_replace(strip(raw), NOTATIONS, YEAR_MONTH_DAY)


def _dated(ordered: Column) -> Column:
    number = _month_number(F.regexp_extract(ordered, MONTH_NAME, 0)).cast("string")
    return F.when(number == "0", ordered).otherwise(F.regexp_replace(ordered, F.lit(MONTH_NAME), number)).try_cast("date")


def parse_date(raw: Column) -> Column:
    """Every notation is rewritten to ``y-m-d`` text and cast once; an impossible date is NULL."""
    return bind(_ordered(raw), _dated)


def with_date_range(df: DataFrame, raw: Column, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Add the start and end date of a listing's date text.

    Done in staged projections: every half is parsed once and later stages refer to the result,
    which keeps the generated code small. A year given only in the end half is lent to the
    start; a yearless or monthless end borrows from the start and may roll over new year.
    """
    # not F.split, which compiles its pattern for every row
    halves = df.withColumn("_left", F.regexp_replace(raw, f"(?s)(?:{RANGE_SEPARATOR}).*$", ""))
    left, right = F.col("_left"), F.col("_right")
    rest = F.substring(raw, F.length(left) + 1, F.length(raw))
    halves = halves.withColumn("_right", F.when(left != raw, F.regexp_replace(rest, f"^(?:{RANGE_SEPARATOR})", "")))
    year = _group(right, YEAR_TOKEN, 1)
    lent = F.when(
        year.isNotNull() & ~left.rlike(YEAR_TOKEN), F.concat(strip(left), F.lit(", "), year)
    )
    staged = halves.withColumns({"_year": year, "_lent": lent})
    staged = staged.withColumns({"_first": parse_date(F.coalesce("_lent", "_left")), "_whole": parse_date(right)})
    first, whole = F.col("_first"), F.col("_whole")
    # a whole end with its own year stands as it is: only the others are read as short ends
    short = F.when(F.col("_year").isNull(), strip(right)).when(
        whole.isNull(), F.regexp_replace(F.regexp_replace(right, YEAR_TOKEN, ""), "^[ ,.]+|[ ,.]+$", "")
    )
    staged = staged.withColumn("_short", F.when(first.isNotNull(), short))
    staged = staged.withColumns(
        {
            "_month": F.coalesce(_group(F.col("_short"), SHORT_END, 1), F.month("_first").cast("string")),
            "_day": _group(F.col("_short"), SHORT_END, 2),
        }
    )
    staged = staged.withColumn("_short_date", _date(F.coalesce("_year", F.year(first).cast("string")), F.col("_month"), F.col("_day")))
    near = F.col("_short_date")
    next_year = F.add_months(near, 12)
    rolled = F.when(near >= first, near).when(F.day(near) == F.day(next_year), next_year)
    last = (
        F.when(right.isNull(), first)
        .when(first.isNotNull() & F.col("_year").isNull(), F.coalesce(rolled, whole))
        .when(first.isNotNull() & whole.isNull(), near)
        .otherwise(whole)
    )
    return staged.withColumns({start: first, end: last}).drop(
        "_left", "_right", "_year", "_lent", "_first", "_whole", "_short", "_month", "_day", "_short_date"
    )


def _span(text: Column, pattern: str) -> Column:
    """The text is searched once; its groups and dates are read from the match."""

    def ends(hit: Column) -> Column:
        sy, sm, sd = (_group(hit, pattern, i) for i in (1, 2, 3))
        ey = F.coalesce(_group(hit, pattern, 4), sy)
        em = F.coalesce(_group(hit, pattern, 5), sm)
        ed = _group(hit, pattern, 6)
        return F.struct(_date(sy, sm, sd).alias("start"), _date(ey, em, ed).alias("end"))

    def written(d: Column) -> Column:
        return F.when(
            d["start"].isNotNull() & d["end"].isNotNull(),
            F.concat(F.date_format(d["start"], "yyyy.MM.dd"), F.lit("~"), F.date_format(d["end"], "yyyy.MM.dd")),
        )

    return bind(bind(F.regexp_extract(text, pattern, 0), ends), written)


def extract_date_range(text: Column) -> Column:
    """First dotted span of free text as ``YYYY.MM.DD~YYYY.MM.DD``."""
    bare = F.regexp_replace(text, WEEKDAY_PARENS, " ")
    return _span(F.regexp_replace(bare, ENGLISH_WEEKDAY_PARENS, " "), DOTTED_SPAN)


def extract_japanese_date_range(text: Column) -> Column:
    return _span(text, JAPANESE_SPAN)


def backfill_range_year(text: Column) -> Column:
    """Weekday parentheses dropped; a Japanese end without a year gets the start's year."""
    bare = strip(F.regexp_replace(text, "（[^）]*）", ""))
    parts = F.split(bare, r"\s*[〜～~]\s*", 2)
    year = _group(bare, r"^(\d{4})年", 1)
    end = F.get(parts, F.lit(1))
    return F.when(
        year.isNotNull() & end.isNotNull() & ~F.contains(end, F.lit("年")),
        F.concat(strip(F.get(parts, F.lit(0))), F.lit("～"), year, F.lit("年"), strip(end)),
    ).otherwise(bare)


def days_until(end: Column, today) -> Column:
    return F.datediff(end, F.lit(today))


def dday_label(end: Column, today) -> Column:
    days = days_until(end, today)
    return F.when(days == 0, F.lit("D-day")).when(days > 0, F.concat(F.lit("D-"), days.cast("string")))


def is_closing_soon(end: Column, today) -> Column:
    return F.coalesce(days_until(end, today).between(0, 7), F.lit(False))


def iso_week(day: Column) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.extract(F.lit("WEEK"), day))


def compute_status(today, start: Column, end: Column) -> Column:
    now = F.lit(today)
    return (
        F.when(start.isNull(), F.lit("unknown"))
        .when(now < start, F.lit("upcoming"))
        .when(end.isNotNull() & (now > end), F.lit("past"))
        .otherwise(F.lit("ongoing"))
    )
