"""Ingest end to end: idempotence, counts, and the stream against the batch."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from listingmill.operators.merge import status_changes
from listingmill.plans.ingest import State, ingest_report, report_rows, run_ingest
from listingmill.plans.publish import build_catalog, publish
from listingmill.schemas import RAW, TABLES, empty
from listingmill.sources.commits import Store
from listingmill.sources.ledger import Ledger
from listingmill.sources.tables import read_document, write_document
from listingmill.streaming.ingest_stream import ingest_batch, stream_ingest

TODAY = datetime.date(2026, 6, 1)
FIELDS = (
    "title", "title_en", "description", "category", "exhibition_type_text", "date_range", "open_hours", "poster_image_url", "venue_name", "venue_region",
    "venue_address", "venue_lat", "venue_lng", "organizer", "artists", "genre_tags", "activities", "fee_text", "price_min", "price_max", "price_breakdown", "price_notes",
)


def listing(seq, source, **raw):
    return (source, f"https://e.org/{seq}", seq, tuple(raw.get(f) for f in FIELDS))


ROWS = [
    listing(1, "pgi", title="光", date_range="2026年5月1日 ～ 7月1日", venue_name="PGI", venue_region="東京", artists=["山田", "Kim"]),
    listing(2, "tokyo_art_beat", title="写真展「光」", date_range="2026.5.1 ~ 2026.7.1", venue_name="PGI 麻布台", venue_lat=35.0, venue_lng=139.0, artists=["kim!"], genre_tags=["x"]),
    listing(3, "artmap", title="회화전", date_range="미정", venue_name="갤러리", venue_address="addr 1", price_min=0, price_max=10),
    listing(4, "artmap", title="  "),
    listing(5, "artmap", title="사진전", date_range="2026.07.01 ~ 2026.08.01", venue_name="갤러리", organizer="사진재단"),
]


@pytest.fixture()
def lookups(spark):
    overrides = spark.createDataFrame([], "entity_type string, match_pattern string, canonical_id string, note string, seq long")
    places = spark.createDataFrame([("KR", "address", "addr 1", 37.0, 127.0), ("JP", "place", "PGI 東京", 35.6, 139.7)], "backend string, kind string, query string, lat double, lng double")
    return overrides, places


def start(spark, lookups, **tables):
    return State(**{n: tables.get(n, empty(spark, n)) for n in TABLES}, overrides=lookups[0], gazetteer=lookups[1])


def test_run_repeat_and_publish(spark, lookups):
    raw = spark.createDataFrame(ROWS, RAW)
    run = run_ingest(raw, start(spark, lookups), TODAY, "2026-06-01 00:00:00")
    shows = {r.seq: r for r in run.exhibitions.collect()}
    assert {s: r.status for s, r in shows.items()} == {1: "ongoing", 2: "ongoing", 3: "unknown", 5: "upcoming"}
    assert shows[3]._warnings == ["date_range"] and shows[3].fee_type == "partial" and shows[3].medium == "mixed" and shows[5].medium == "photo"
    assert shows[1].artist_ids[1] == shows[2].artist_ids[0] and shows[5].organizer_id != shows[5].venue_id
    assert [r.seq for r in run.rejects.collect()] == [4]
    venues = {r.name: r for r in run.venues.collect()}
    assert (venues["PGI"].latitude, venues["PGI"].country) == (35.6, "JP") and venues["PGI 麻布台"].latitude == 35.0 and venues["갤러리"].latitude == 37.0

    report = {r.source: r for r in ingest_report(raw, run, spark.createDataFrame([("gallery_lux", "timeout"), ("koba", "boom")], "source string, failure string")).collect()}
    assert (report["artmap"].extracted, report["artmap"].new, report["artmap"].errors) == (3, 2, 1) and len(report) == 22
    assert not report["gallery_lux"].hard_failure and report["koba"].hard_failure

    stored = {n: spark.createDataFrame(getattr(run, n).drop("action").collect(), getattr(run, n).drop("action").schema) for n in TABLES}
    again = run_ingest(raw, start(spark, lookups, **stored), TODAY, "2026-06-02 00:00:00")
    assert {r.action for r in again.exhibitions.collect()} == {"unchanged"}
    for name in ("artists", "venues", "organizers"):
        assert {r.action for r in getattr(again, name).collect()} == {"kept"}

    later = run_ingest(raw.filter("seq = 1"), start(spark, lookups, **stored), datetime.date(2026, 7, 15), "2026-07-15 00:00:00")
    assert {r.seq: (r.action, r.status) for r in later.exhibitions.collect()} == {
        1: ("updated", "past"), 2: ("status", "past"), 3: ("kept", "unknown"), 5: ("status", "ongoing"),
    }

    published = build_catalog(stored["exhibitions"], stored["venues"], stored["artists"])
    rows = {r.seq: r for r in published.exhibitions.collect()}
    assert sorted(rows) == [1, 5] and rows[1].source == "pgi" and len(rows[1].artists) == 2 and rows[1].genre_tags == ["x"]
    assert {r.name for r in published.venues.collect()} == {"PGI", "갤러리"}
    assert {r.id for r in published.artists.collect()} == {a.id for r in rows.values() for a in r.artists}


def test_stream_equals_batch(spark, lookups, tmp_path):
    raw = spark.createDataFrame(ROWS, RAW)
    inbox, root = str(tmp_path / "in"), str(tmp_path / "tables")
    args = (inbox, root, str(tmp_path / "check"), *lookups, TODAY, "2026-06-01 00:00:00", 1)
    raw.filter("seq <= 2").coalesce(1).write.parquet(inbox)
    stream_ingest(spark, *args)
    raw.coalesce(1).write.mode("append").parquet(inbox)  # everything again, plus the rest
    store = stream_ingest(spark, *args)
    batch = run_ingest(raw, start(spark, lookups), TODAY, "2026-06-01 00:00:00")
    for name in TABLES:
        cols = [c for c in empty(spark, name).columns if c not in ("tr",)]
        got, want = store.scan(name).select(*cols), getattr(batch, name).select(*cols)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
    # rejects and counts of each commit, without a second look at the data
    assert [r.seq for r in store.rejected("seq long, source string, error string").collect()] == [4]
    last = store.manifest().report
    rows = {r["source"]: r for r in report_rows(last, {"koba": "boom"})}
    assert len(rows) == 22 and rows["koba"]["hard_failure"] and rows["artmap"]["duration"] > 0
    assert (rows["artmap"]["extracted"], rows["artmap"]["errors"], rows["artmap"]["new"], rows["pgi"]["unchanged"]) == (3, 1, 2, 1)
    # another checkpoint over the same tables, on a later day: nothing is lost, and statuses of untouched rows move
    later = datetime.date(2026, 7, 15)
    more, other = str(tmp_path / "more"), str(tmp_path / "check2")
    raw.filter("seq = 1").coalesce(1).write.parquet(more)
    before = store.manifest()
    stream_ingest(spark, more, root, other, *lookups, later, "2026-07-15 00:00:00", 1)
    after = {r.seq: r.status for r in store.scan("exhibitions").collect()}
    assert after == {1: "past", 2: "past", 3: "unknown", 5: "ongoing"}
    # a reader of the earlier commit still sees it whole, also after what is old has been deleted
    assert {r.seq: r.status for r in store.scan("exhibitions", at=before).collect()} == {1: "ongoing", 2: "ongoing", 3: "unknown", 5: "upcoming"}
    assert store.vacuum(keep=2) >= 0 and store.scan("exhibitions", at=before).count() == 4
    assert store.vacuum(keep=1) > 0 and {r.seq: r.status for r in store.scan("exhibitions").collect()} == after


def test_a_batch_opens_what_it_needs(spark, lookups, tmp_path):
    """Files opened follow the batch and the days that passed, not the table."""
    store = Store(spark, str(tmp_path / "t"), buckets=16)

    def shows(first, n):
        return [listing(first + k, "artmap", title=f"show {first + k}", date_range=f"2026.06.{1 + k % 20:02d} ~ 2026.{7 + k % 3:02d}.{1 + k % 25:02d}", venue_name=f"hall {(first + k) % 40}") for k in range(n)]

    ingest_batch(store, spark.createDataFrame(shows(0, 300), RAW), *lookups, TODAY, "2026-06-01 00:00:00", "a")
    full = {t: len(set(p.values())) for t, p in store.manifest().tables.items()}
    assert full["exhibitions"] == 16
    store.opened.clear()
    ingest_batch(store, spark.createDataFrame(shows(1000, 1), RAW), *lookups, TODAY, "2026-06-01 01:00:00", "b")
    assert len({p for p in store.opened if p.startswith("exhibitions")}) == 1 and len({p for p in store.opened if p.startswith("venues")}) == 1
    kept = store.manifest()
    assert len(set(kept.tables["exhibitions"].values()) & set(store.manifest(0).tables["exhibitions"].values())) == 15
    # replayed: nothing is read or written
    store.opened.clear()
    ingest_batch(store, spark.createDataFrame(shows(1000, 1), RAW), *lookups, TODAY, "2026-06-01 01:00:00", "b")
    assert store.manifest() == kept and not store.opened

    # a day later only the shows due on it are looked at, and the state is that of a full pass
    store.opened.clear()
    day = datetime.date(2026, 6, 3)
    nothing = spark.createDataFrame([], RAW)
    ingest_batch(store, nothing, *lookups, day, "2026-06-03 00:00:00", "c")
    days = {p.split("day=")[1] for p in store.opened if p.startswith("calendar")}
    assert days == {"2026-06-02", "2026-06-03"}
    rows = store.scan("exhibitions")
    assert rows.count() == 301 and status_changes(rows, day).isEmpty()
    for later in (datetime.date(2026, 6, 30), datetime.date(2026, 8, 10), datetime.date(2026, 7, 5)):
        ingest_batch(store, nothing, *lookups, later, f"{later} 00:00:00", str(later))
        assert status_changes(store.scan("exhibitions"), later).isEmpty()
    assert not [d for d in store.manifest().calendar if d <= "2026-07-05"]


def test_tables_of_two_schemas(spark, tmp_path):
    root, keys = str(tmp_path / "t"), {"things": "id"}
    old = Store(spark, root, 4, {"things": "id STRING, n INT"}, keys)
    old.commit({"things": spark.createDataFrame([(str(k), k) for k in range(20)], "id string, n int")}, "one")
    new = Store(spark, root, 4, {"things": "id STRING, n INT, tag STRING"}, keys)
    assert new.scan("things").filter("tag IS NULL").count() == 20
    new.commit({"things": spark.createDataFrame([("3", 33, "x"), ("99", 9, "y")], "id string, n int, tag string")}, "two")
    rows = {r.id: (r.n, r.tag) for r in new.scan("things").collect()}
    assert len(rows) == 21 and rows["3"] == (33, "x") and rows["4"] == (4, None) and rows["99"] == (9, "y")
    assert {d for d in new.manifest().schemas.values()} == {"id STRING, n INT", "id STRING, n INT, tag STRING"}
    with pytest.raises(ValueError):
        Store(spark, root, 4, {"things": "n INT, id STRING, tag STRING"}, keys).scan("things").collect()
    with pytest.raises(RuntimeError):
        new._publish(new.manifest())  # the number is taken
    assert new.commit({}, "two") == new.manifest() and Store(spark, str(tmp_path / "none"), 4, new.tables, keys).scan("things").isEmpty()


def test_override_to_an_artist_of_an_earlier_source(spark, lookups):
    """Sources arrive one after another: the artist of an earlier source is there, whatever its rows' numbers."""
    from listingmill.functions.keys import artist_id

    kim, own = (spark.range(1).select(artist_id(F.lit(n))).first()[0] for n in ("kim", "alias"))
    overrides = spark.createDataFrame([("artist", "Alias", kim, None, 1)], lookups[0].schema)
    rows = [listing(5, "zen_foto", title="a", artists=["Alias"]), listing(10, "artmap", title="b", artists=["Kim"]), listing(20, "art_space_j", title="c", artists=["Alias"])]
    run = run_ingest(spark.createDataFrame(rows, RAW), start(spark, (overrides, lookups[1])), TODAY, "2026-06-01 00:00:00")
    assert {r.seq: r.artist_ids for r in run.exhibitions.collect()} == {5: [kim], 10: [kim], 20: [own]}
    assert {r.name for r in run.artists.collect()} == {"Kim", "Alias"}


def test_override_to_an_artist_of_the_same_batch(spark, lookups):
    """An alias goes to an artist that an earlier row makes; before that row it makes its own."""
    from listingmill.functions.keys import artist_id

    kim, own = (spark.range(1).select(artist_id(F.lit(n))).first()[0] for n in ("kim", "alias"))
    overrides = spark.createDataFrame([("artist", "Alias", kim, None, 1), ("artist", "Ghost", "nobody", None, 2)], lookups[0].schema)
    rows = [listing(n, "artmap", title=f"t{n}", artists=a) for n, a in ((1, ["Alias", "Ghost"]), (2, ["Kim"]), (3, ["Alias"]))]
    run = run_ingest(spark.createDataFrame(rows, RAW), start(spark, (overrides, lookups[1])), TODAY, "2026-06-01 00:00:00")
    ids = {r.seq: r.artist_ids for r in run.exhibitions.collect()}
    assert ids[1][0] == own and ids[2] == [kim] and ids[3] == [kim]
    made = {r.name for r in run.artists.collect()}
    assert made == {"Alias", "Ghost", "Kim"}
    later = run_ingest(spark.createDataFrame(rows[1:], RAW), start(spark, (overrides, lookups[1])), TODAY, "2026-06-01 00:00:00")
    assert {r.name for r in later.artists.collect()} == {"Kim"}


def test_a_document_is_published_whole_or_not_at_all(spark, lookups, tmp_path):
    raw = spark.createDataFrame(ROWS, RAW)
    run = run_ingest(raw, start(spark, lookups), TODAY, "2026-06-01 00:00:00")
    stored = {n: spark.createDataFrame(getattr(run, n).drop("action").collect(), getattr(run, n).drop("action").schema) for n in TABLES}
    path = str(tmp_path / "doc")
    assert [publish(stored["exhibitions"], stored["venues"], stored["artists"], f"day {n}", path) for n in range(3)] == [0, 1, 2]
    shape = StructType.fromDDL("id STRING, name STRING, title STRING")
    entry, parts = read_document(spark, path, dict.fromkeys(("exhibitions", "venues", "artists"), shape))
    assert entry["generated_at"] == "day 2" and entry["counts"] == {n: p.count() for n, p in parts.items()} == {"exhibitions": 2, "venues": 2, "artists": 2}
    assert len(Ledger(spark, f"{path}/documents").numbers()) == 2 == len(Ledger(spark, f"{path}/parts").names())
    bad = {"venues": spark.createDataFrame([("v", 1.0)], "id string, lat double"), "artists": spark.createDataFrame([("a", float("nan"))], "id string, score double")}
    with pytest.raises(ValueError, match="NaN"):
        write_document(bad, "day 3", path)
    assert read_document(spark, path, {})[0] == entry and len(Ledger(spark, f"{path}/parts").names()) == 2


def test_dates_of_listings_with_one_id(spark, tmp_path):
    """A show listed with two end dates is one row of the table; the log of dates tells both, also when they come again."""
    store = Store(spark, str(tmp_path))
    rows = spark.sql("SELECT 'a' id, DATE'2026-05-01' start_date, end_date, 'x' title FROM VALUES (DATE'2026-05-02'), (CAST(NULL AS DATE)), (DATE'2026-05-02') AS t(end_date)")
    for run in ("r1", "r2"):
        store.commit({}, run, listed=rows)
    assert sorted(str(r.end_date) for r in store.listed().collect()) == ["2026-05-02", "None"]
