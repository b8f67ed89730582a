"""Distances, regions and map cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
EARTH_RADIUS_KM = 6371
KOREAN_REGIONS = (
    "서울", "경기", "인천", "부산", "대구", "광주", "대전", "울산", "세종",
    "강원", "충북", "충남", "전북", "전남", "경북", "경남", "제주",
)
CITY_ORDER = (
    ("한국", "서울", 1), ("한국", "경기·인천", 2), ("한국", "부산", 3), ("한국", "한국 기타", 4),
    ("일본", "도쿄", 5), ("일본", "오사카", 6), ("일본", "교토", 7), ("일본", "일본 기타", 8),
)
TILE_PX, CLUSTER_RADIUS_PX, CLUSTER_MAX_ZOOM = 512, 48, 14
# -----------------------------------------------------------------------------


def haversine_km(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lng = F.radians(lng2 - lng1) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_lng), 2
    )
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(chord))


def region_bucket(raw: Column) -> Column:
    """struct(country, city) for a raw region; NULL for a missing or empty one."""
    korean = raw.isin(*KOREAN_REGIONS)
    city = (
        F.when(raw == "서울", F.lit("서울"))
        .when(raw == "부산", F.lit("부산"))
        .when(raw.isin("경기", "인천"), F.lit("경기·인천"))
        .when(korean, F.lit("한국 기타"))
        .when(F.contains(raw, F.lit("大阪")), F.lit("오사카"))
        .when(F.contains(raw, F.lit("京都")), F.lit("교토"))
        .when(F.contains(raw, F.lit("東京")) | F.contains(raw, F.lit("、")), F.lit("도쿄"))
        .otherwise(F.lit("일본 기타"))
    )
    country = F.when(korean, F.lit("한국")).otherwise(F.lit("일본"))
    return F.when(
        raw.isNotNull() & (raw != ""), F.struct(country.alias("country"), city.alias("city"))
    )


def mercator_cell(lng: Column, lat: Column, zoom: int) -> Column:
    """struct(cell_x, cell_y): web-mercator pixel position over the cluster radius."""
    world = float(TILE_PX * 2**zoom)
    x = (lng + 180.0) / 360.0 * world
    s = F.sin(F.radians(lat))
    y = (0.5 - F.ln((1 + s) / (1 - s)) / (4 * math.pi)) * world
    return F.struct(
        F.floor(x / CLUSTER_RADIUS_PX).alias("cell_x"),
        F.floor(y / CLUSTER_RADIUS_PX).alias("cell_y"),
    )
