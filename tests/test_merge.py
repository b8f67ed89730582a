"""Keyed merges, positions, schema changes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from listingmill import schemas
from listingmill.operators import merge, ranking

DDL = "id string, title string, tags array<string>, crawled_at string, updated_at string, first_seen_at string, _warnings string, extra string, seq long"


def rows(df):
    return {r.id: r for r in df.collect()}


def test_upsert_cases(spark):
    stored = spark.createDataFrame(
        [
            ("same", "t", ["a"], "c0", "u0", "f0", "", "keep", 1), ("changed", "t", ["a"], "c0", "u0", "f0", "", "keep", 2),
            ("nulled", "t", None, "c0", "u0", "f0", "", "keep", 3), ("absent", "t", [], "c0", "u0", "f0", "", "keep", 4), ("", "blank", [], "", "", "", "", "", 5),
        ],
        DDL,
    )
    batch = spark.createDataFrame(
        [
            ("same", "t", ["a"], "c1", "u1", "f1", "w", 10), ("changed", "old", ["a"], "c1", "u1", "f1", "", 11), ("changed", "new", ["b"], "c1", "u1", "f1", "", 12),
            ("nulled", None, None, "c1", "u1", "f1", "", 13), ("fresh", "n", None, "c1", "u1", "f1", "", 14),
        ],
        "id string, title string, tags array<string>, crawled_at string, updated_at string, first_seen_at string, _warnings string, seq long",
    )
    got = rows(merge.upsert(stored, batch, ["id"]))
    assert {k: r.action for k, r in got.items()} == {"same": "unchanged", "changed": "updated", "nulled": "updated", "absent": "kept", "fresh": "new"}
    assert (got["same"].updated_at, got["same"]._warnings) == ("u0", "")
    c = got["changed"]
    assert (c.title, c.tags, c.crawled_at, c.first_seen_at, c.updated_at, c.extra, c.seq) == ("new", ["b"], "c0", "f0", "u1", "keep", 2)
    assert got["nulled"].title is None and got["fresh"].crawled_at == "c1" and got["fresh"].extra is None and got["fresh"].seq == 14


def test_repeating_a_batch_changes_nothing(spark):
    batch = spark.createDataFrame([(f"i{k}", "t", ["a"], "c", "u", "f", "", "x", k) for k in range(50)], DDL)
    first = merge.upsert(spark.createDataFrame([], DDL), batch, ["id"]).drop("action")
    actions = {r.action: r.n for r in merge.action_counts(merge.upsert(first, batch, ["id"])).collect()}
    assert actions == {"unchanged": 50}


def test_latest_keeps_the_first_position(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, None), ("a", 2, "z")], "id string, seq long, v string")
    assert {(r.id, r.seq, r.v) for r in merge.latest_by(df, ["id"]).collect()} == {("a", 1, None), ("b", 2, "y")}
    assert {(r.id, r.seq, r.v) for r in merge.first_by(df, ["id"]).collect()} == {("a", 1, "x"), ("b", 2, "y")}


def test_patch_only_touches_supplied_columns(spark):
    base = spark.createDataFrame([("a", "t", 1), ("b", "t", 2)], "id string, title string, n int")
    patch = spark.createDataFrame([("a", None)], "id string, title string")
    assert {tuple(r) for r in merge.checked_patch(base, patch, ["id"]).collect()} == {("a", None, 1), ("b", "t", 2)}
    with pytest.raises(KeyError):
        merge.checked_patch(base, spark.createDataFrame([("z", "t")], "id string, title string"), ["id"])


def test_status_changes_only(spark):
    import datetime

    df = spark.createDataFrame(
        [("a", "ongoing", datetime.date(2026, 1, 1), datetime.date(2026, 2, 1)), ("b", None, None, None), ("c", "past", datetime.date(2026, 1, 1), datetime.date(2026, 2, 1)), ("", "x", None, None)],
        "id string, status string, start_date date, end_date date",
    )
    assert {tuple(r) for r in merge.status_changes(df, datetime.date(2026, 3, 1)).collect()} == {("a", "past"), ("b", "unknown")}


def test_positions_and_running_totals_match_brute_force(spark):
    """One group holds most of the rows; ranges are tiny so that several levels are crossed."""
    rng = random.Random(3)
    data = [("hot" if k % 10 else "cold", k * rng.choice([1, 1, 3]) + k, rng.randrange(5)) for k in range(1, 600)]
    data = list({(g, s): (g, s, n) for g, s, n in data}.values())
    df = spark.createDataFrame(data, "g string, seq long, n long")
    got = ranking.running_total(ranking.position(df, ["g"], "seq"), [], "seq", F.col("n"), "cum", width=7).collect()
    place, total = {}, 0
    expected = {}
    for g, s, n in sorted(data, key=lambda r: r[1]):
        place[g] = place.get(g, 0) + 1
        total += n
        expected.setdefault(s, []).append((g, place[g], total))
    for r in got:
        assert any(r.g == g and r.position == p for g, p, _ in expected[r.seq])
    assert max(r.cum for r in got) == sum(n for _, _, n in data)
    narrow = ranking.running_total(df, ["g"], "seq", F.lit(1), "p", width=5).collect()
    wide = {(r.g, r.seq): r.position for r in ranking.position(df, ["g"], "seq").collect()}
    assert {(r.g, r.seq): r.p for r in narrow} == wide


def test_schema_evolution(spark):
    assert schemas.evolve_plan([], ["a"]) == ("create", ["a"])
    assert schemas.evolve_plan(["a"], ["a"]) == ("noop", [])
    assert schemas.evolve_plan(["a"], ["a", "b"]) == ("append", ["b"])
    for existing in (["b", "a"], ["a", "b", "c"], ["x"]):
        assert schemas.evolve_plan(existing, ["a", "b"])[0] == "error"
    df = spark.createDataFrame([("1",)], "a string")
    assert schemas.evolve(df, StructType.fromDDL("a string, b int")).dtypes == [("a", "string"), ("b", "int")]
    with pytest.raises(ValueError):
        schemas.evolve(df, StructType.fromDDL("z string"))


def test_quarantine(spark):
    ok = "2026-01-01T00:00:00"
    df = spark.createDataFrame(
        [("1", "V", ok, ok, "", "1.5", ""), ("2", " ", ok, ok, "", "", ""), ("3", "V", "", ok, "", "", ""), ("4", "V", ok, ok, "barn", "", ""), ("5", "V", ok, ok, "cafe", "x", "JP")],
        "id string, name string, first_seen_at string, updated_at string, venue_type string, latitude string, country string",
    )
    good, bad = schemas.quarantine(df, "venues")
    assert [(r.id, r.venue_type, r.latitude, r.country) for r in good.collect()] == [("1", "other", 1.5, "KR")]
    assert {r.id: r.reason for r in bad.collect()} == {"2": "missing_name", "3": "bad_timestamp", "4": "bad_venue_type", "5": "bad_latitude"}
