"""Table shapes and the checks at their edges."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from listingmill.functions.text import blank_to_null

TR = "MAP<STRING, MAP<STRING, STRING>>"
TIERS = "ARRAY<STRUCT<label: STRING, amount: INT>>"
RAW = (
    "source STRING, source_url STRING, seq BIGINT, raw STRUCT<title: STRING, title_en: STRING, "
    "description: STRING, category: STRING, exhibition_type_text: STRING, date_range: STRING, "
    "open_hours: STRING, poster_image_url: STRING, venue_name: STRING, venue_region: STRING, "
    "venue_address: STRING, venue_lat: DOUBLE, venue_lng: DOUBLE, organizer: STRING, "
    "artists: ARRAY<STRING>, genre_tags: ARRAY<STRING>, activities: ARRAY<STRING>, fee_text: STRING, "
    f"price_min: INT, price_max: INT, price_breakdown: {TIERS}, price_notes: STRING>"
)
EXHIBITIONS = (
    "id STRING, source STRING, status STRING, source_url STRING, title STRING, title_en STRING, "
    "description STRING, poster_image_url STRING, medium STRING, exhibition_type STRING, "
    "genre_tags ARRAY<STRING>, fee_type STRING, price_min INT, price_max INT, activities ARRAY<STRING>, "
    "start_date DATE, end_date DATE, open_hours STRING, artist_ids ARRAY<STRING>, venue_id STRING, "
    "organizer_id STRING, popularity_score DOUBLE, featured BOOLEAN, crawled_at TIMESTAMP, "
    f"updated_at TIMESTAMP, _warnings ARRAY<STRING>, price_breakdown {TIERS}, price_notes STRING, "
    f"lang STRING, tr {TR}, seq BIGINT"
)
ARTISTS = (
    "id STRING, name STRING, name_en STRING, name_normalized STRING, bio STRING, instagram STRING, "
    "website STRING, sources ARRAY<STRING>, first_seen_at TIMESTAMP, updated_at TIMESTAMP, "
    f"lang STRING, tr {TR}, seq BIGINT"
)
VENUES = (
    "id STRING, name STRING, name_en STRING, venue_type STRING, region STRING, district STRING, "
    "address STRING, latitude DOUBLE, longitude DOUBLE, website STRING, open_hours_default STRING, "
    "sources ARRAY<STRING>, first_seen_at TIMESTAMP, updated_at TIMESTAMP, country STRING, "
    f"lang STRING, tr {TR}, seq BIGINT"
)
ORGANIZERS = (
    "id STRING, name STRING, name_en STRING, name_normalized STRING, organizer_type STRING, "
    "website STRING, sources ARRAY<STRING>, first_seen_at TIMESTAMP, updated_at TIMESTAMP, seq BIGINT"
)
OVERRIDES = "entity_type STRING, match_pattern STRING, canonical_id STRING, note STRING, seq BIGINT"
TABLES = {"exhibitions": EXHIBITIONS, "artists": ARTISTS, "venues": VENUES, "organizers": ORGANIZERS}

# --- fixed values -----------------------------------------------------------
VENUE_TYPES = ("museum", "gallery", "cafe", "alt_space", "convention", "other")
ORGANIZER_TYPES = ("museum", "gallery", "foundation", "association", "corporate", "public", "other")
# source, country; the registry's order is the order of this list
SOURCES = (
    ("art_space_j", "KR"),
    ("artmap", "KR"),
    ("canon_gallery", "KR"),
    ("fujifilm_square", "JP"),
    ("gallery_bresson", "KR"),
    ("gallery_kong", "KR"),
    ("gallery_lux", "KR"),
    ("gallery_now", "KR"),
    ("gallery_tosei", "JP"),
    ("goeun", "KR"),
    ("ilwoo_space", "KR"),
    ("koba", "KR"),
    ("museum_hanmi", "KR"),
    ("pgi", "JP"),
    ("photo_sema", "KR"),
    ("place_m", "JP"),
    ("ryugaheon", "KR"),
    ("sangsangmadang", "KR"),
    ("tokyo_art_beat", "JP"),
    ("tokyo_photographic_art_museum", "JP"),
    ("totem_pole", "JP"),
    ("zen_foto", "JP"),
)
SOFT_FAIL_SOURCES = ("gallery_lux",)
# -----------------------------------------------------------------------------


def source_registry(spark: SparkSession) -> DataFrame:
    """(source, source_rank, country): a fixed table of 22 rows."""
    rows = [(name, rank, country) for rank, (name, country) in enumerate(SOURCES)]
    return spark.createDataFrame(rows, "source STRING, source_rank INT, country STRING")


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def _reason(name: str, bad: Column) -> Column:
    return F.when(bad, F.lit(name))


def quarantine(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Split text rows of an entity table into typed good rows and (row, reason) rejects.

    Input columns are strings. Blank cells count as missing; defaults follow the table.
    """
    known = set(df.columns)

    def cell(name: str) -> Column:
        return blank_to_null(F.col(name)) if name in known else F.lit(None).cast("string")

    seen, updated = cell("first_seen_at").try_cast("timestamp"), cell("updated_at").try_cast("timestamp")
    reasons = [
        _reason("missing_id", cell("id").isNull()),
        _reason("missing_name", cell("name").isNull()),
        _reason("bad_timestamp", seen.isNull() | updated.isNull()),
    ]
    typed = {"first_seen_at": seen, "updated_at": updated}
    if table == "venues":
        venue_type = F.coalesce(cell("venue_type"), F.lit("other"))
        reasons.append(_reason("bad_venue_type", ~venue_type.isin(*VENUE_TYPES)))
        typed |= {"venue_type": venue_type, "country": F.coalesce(cell("country"), F.lit("KR"))}
        for name in ("latitude", "longitude"):
            value = cell(name).try_cast("double")
            reasons.append(_reason(f"bad_{name}", cell(name).isNotNull() & value.isNull()))
            typed[name] = value
    if table == "organizers":
        kind = F.coalesce(cell("organizer_type"), F.lit("other"))
        reasons.append(_reason("bad_organizer_type", ~kind.isin(*ORGANIZER_TYPES)))
        typed["organizer_type"] = kind
    if table in ("artists", "organizers"):
        typed["name_normalized"] = F.coalesce(cell("name_normalized"), cell("name"))
    checked = df.withColumn("reason", F.coalesce(*reasons))
    good = checked.filter(F.col("reason").isNull()).select(
        *[typed.get(c, cell(c) if t == "string" else F.col(c)).alias(c) for c, t in df.dtypes]
    )
    return good, checked.filter(F.col("reason").isNotNull())


def evolve_plan(existing: list[str], expected: list[str]) -> tuple[str, list[str]]:
    """What a table needs to reach the expected header: noop, create, append (which columns) or error."""
    if not existing:
        return "create", list(expected)
    head, tail = expected[: len(existing)], expected[len(existing) :]
    if head != existing:
        return "error", []
    return ("append", tail) if tail else ("noop", [])


def evolve(df: DataFrame, expected: StructType) -> DataFrame:
    """Add the new columns at the end; refuse a reordered, renamed or shorter header."""
    action, added = evolve_plan(df.columns, expected.names)
    if action == "error":
        raise ValueError(f"incompatible columns: {df.columns} -> {expected.names}")
    return df.withColumns({c: F.lit(None).cast(expected[c].dataType) for c in added}) if added else df


def non_finite_rows(df: DataFrame) -> DataFrame:
    """Rows with NaN or infinity in any floating point value, nested ones included."""
    return df.filter(non_finite(df))


def non_finite(df: DataFrame) -> Column:
    """Whether a row holds NaN or infinity anywhere."""
    tests = [t for f in df.schema.fields if (t := _non_finite(F.col(f.name), f.dataType)) is not None]
    return F.coalesce(reduce(or_, tests, F.lit(False)), F.lit(False))


def _non_finite(c: Column, kind: DataType) -> Column | None:
    """Whether the value holds NaN or infinity; None where its type cannot."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    if isinstance(kind, StructType):
        inner = [t for f in kind.fields if (t := _non_finite(c[f.name], f.dataType)) is not None]
        return reduce(or_, inner) if inner else None
    if isinstance(kind, ArrayType):
        if _non_finite(c, kind.elementType) is None:
            return None
        return F.coalesce(F.exists(c, lambda x: _non_finite(x, kind.elementType)), F.lit(False))
    if isinstance(kind, MapType):
        return _non_finite(F.map_values(c), ArrayType(kind.valueType))
    return None
