"""Resolution, orders, alerts, works, extraction: small golden tables."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from listingmill.functions import text
from listingmill.operators import browse, cinema, embed, enrich, joins, masters, notify, resolve
from listingmill.plans.search import search
from listingmill.schemas import source_registry
from listingmill.sources import extract, tables

D = datetime.date
TODAY = D(2026, 6, 1)
SHOWS = (
    "id string, seq long, title string, status string, medium string, exhibition_type string, fee_type string, featured boolean, popularity_score double, "
    "start_date date, end_date date, genre_tags array<string>, venue struct<id:string,name:string,region:string,lat:double,lng:double>, artists array<struct<name:string>>"
)


@pytest.fixture(scope="module")
def shows(spark):
    v1, v2 = ("v1", "Museum", "서울", 37.5, 127.0), ("v2", "Hall", "大阪府", 34.7, 135.5)
    rows = [
        ("a", 1, "Alpha", "ongoing", "photo", "solo", "free", False, 5.0, D(2026, 5, 1), D(2026, 6, 5), ["g"], v1, [("Kim",)]),
        ("b", 2, "Beta", "past", "video", None, "paid", True, None, D(2026, 1, 1), D(2026, 2, 1), [], v2, []),
        ("c", 3, "Gamma", "ongoing", None, "group", "free", False, None, None, None, ["k"], None, [("Lee",), ("Park",)]),
        ("d", 4, "Delta", "upcoming", "photo", "solo", "partial", False, 5.0, D(2026, 7, 1), D(2026, 8, 1), [], v1, []),
        ("e", 5, "Eps", "unknown", "photo", "solo", None, False, 5.0, D(2026, 7, 1), D(2026, 6, 2), [], ("v3", "Bare", None, None, 1.0), []),
    ]
    return spark.createDataFrame(rows, SHOWS)


def ids(df):
    return [r.id for r in df.collect()]


def test_orders(shows):
    assert ids(browse.sort_exhibitions(shows, "recommended")) == ["b", "a", "d", "e", "c"]
    assert ids(browse.sort_exhibitions(shows, "closing")) == ["a", "c", "b", "e", "d"]
    assert ids(browse.sort_exhibitions(shows, "recent")) == ["d", "e", "a", "b", "c"]
    assert ids(browse.sort_exhibitions(shows, "nearby", (135.0, 34.7))) == ["b", "a", "d", "c", "e"]
    assert ids(browse.sort_exhibitions(shows, "nearby")) == ["b", "a", "d", "e", "c"]
    assert ids(browse.featured_pick(shows)) == ["b"] and ids(browse.closing_soon(shows, TODAY)) == ["a"]


def test_filters_and_search(shows):
    f = browse.Facets
    assert ids(browse.faceted_filter(shows, f())) == ["a", "b", "c", "d", "e"]
    assert ids(browse.faceted_filter(shows, f(mediums=("photo",), types=("solo",)))) == ["a", "d", "e"]
    assert ids(browse.faceted_filter(shows, f(free_only=True))) == ["a", "c"]
    assert ids(browse.faceted_filter(shows, f(cities=("오사카",)))) == ["b"]
    assert ids(browse.text_search(shows, " LEE park ")) == ["c"] and len(ids(browse.text_search(shows, "  "))) == 5
    assert ids(browse.text_search(shows, "alpha museum kim g")) == ["a"]
    assert ids(search(shows, f(statuses=("ongoing", "upcoming")), "a", "closing")) == ["a", "c", "d"]
    assert sorted(ids(browse.swipe_deck(shows, 1))) == ["a", "c", "d", "e"] and ids(browse.mappable(shows)) == ["a", "b", "d"]


def test_counts_and_markers(shows):
    assert tuple(browse.status_counts(shows, TODAY).first()) == (2, 1, 1)
    marks = {r.marker: (r.n, r.first_id) for r in browse.venue_markers(shows.withColumn("poster_image_url", F.lit(""))).collect()}
    assert marks == {"v1": (2, "a"), "v2": (1, "b")}
    assert {(r.region, r.n) for r in browse.region_counts(shows).collect()} == {("서울", 2), ("大阪府", 1)}


def test_cinema(spark):
    scene = "id string, title map<string,string>, credit map<string,string>, studio string, image string"
    modern = spark.createDataFrame([("m1", {"en": "B", "ko": "나", "ja": "い"}, {"en": "X · 2019"}, "S", None), ("m2", {"en": "a", "ko": "가", "ja": "あ"}, {"en": "", "ko": "감독 1994"}, None, None)], scene)
    pd = spark.createDataFrame([("p1", {"en": "C", "ko": "다", "ja": "う"}, {"en": "Y"}, None, None)], scene)
    rows = cinema.cinema_entries(modern, pd)
    assert ids(cinema.sort_cinema(rows, "newest")) == ["m1", "m2", "p1"] and ids(cinema.sort_cinema(rows, "oldest")) == ["p1", "m2", "m1"]
    assert ids(cinema.sort_cinema(rows, "name", "ko")) == ["m2", "m1", "p1"] and ids(cinema.sort_cinema(rows, "name", "en")) == ["m2", "m1", "p1"]
    assert [r.decade for r in cinema.present_decades(rows).collect()] == [2010, 1990]
    assert ids(cinema.cinema_filter(rows, ("modern",), (1990,))) == ["m2"] and ids(cinema.cinema_search(rows, "나 b")) == ["m1"]


def test_resolution_precedence(spark):
    listings = spark.createDataFrame(
        [
            (1, "pgi", ["Kim!", "Alias", "Ghost", "…", "New", "new"], "갤러리 A", "서울", None, None, None, None),
            (2, "artmap", ["NEW"], "Renamed", None, None, None, None, "Org  X"), (3, "artmap", [], None, None, None, None, None, None),
        ],
        "seq long, source string, artist_names array<string>, venue_name string, venue_region string, venue_address string, venue_lat double, venue_lng double, organizer_name string",
    )
    artists = spark.createDataFrame([("K1", "kim", 1), ("K2", "kim", 2), ("T", "t", 3)], "id string, name_normalized string, seq long")
    venues = spark.createDataFrame([], "id string")
    organizers = spark.createDataFrame([("O1", "org x", 1), ("O2", "org x", 2)], "id string, name_normalized string, seq long")
    rules = spark.createDataFrame(
        [("artist", "Alias", "T", 1), ("artist", "Ghost", "missing", 2), ("venue", "Renamed", "old", 3), ("venue", "Renamed", "V9", 4)],
        "entity_type string, match_pattern string, canonical_id string, seq long",
    )
    got = {r.seq: r for r in resolve.resolve_listings(listings, artists, venues, organizers, rules).collect()}
    ghost, new = (resolve.artist_id(F.lit(n)) for n in ("ghost", "new"))
    ghost, new = spark.range(1).select(ghost, new).first()
    assert got[1].artist_ids == ["K2", "T", ghost, new, new]
    assert got[2].venue_id == "V9" and got[2].organizer_id == "O1"
    assert got[1].organizer_id == got[1].venue_id and (got[3].venue_id, got[3].organizer_id, got[3].artist_ids) == ("", "", [])
    made = resolve.new_artists(listings, artists, rules, source_registry(spark), "2026-01-01").collect()
    assert {(r.name, r.sources[0]) for r in made} == {("Ghost", "pgi"), ("NEW", "artmap")}
    place = resolve.new_venues(listings, venues, rules, source_registry(spark), "2026-01-01").collect()
    assert [(r.name, r.venue_type, r.region, r.country) for r in place] == [("갤러리 A", "gallery", "서울", "JP")]


def brute_match(subs, shows):
    for user, f in subs:
        active = [(f[k], pick) for k, pick in (("regions", 2), ("mediums", 3), ("artists", 4), ("genres", 5)) if f[k]]
        for s in shows:
            if active and all(set(want) & set(s[i] if isinstance(s[i], list) else [s[i]]) for want, i in active):
                yield user, s[0]


def test_custom_matching_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    some = lambda pool, n: [rng.choice(pool) for _ in range(rng.randrange(n))]
    subs = [
        (f"u{i}", {"artists": some(["k", "l", "m"], 3), "regions": some(["s", "b"], 2), "genres": some(["x", "y", "z"], 3), "mediums": some(["photo"], 2)}) for i in range(40)
    ]
    items = [(f"e{i}", i, rng.choice(["s", "b", None]), rng.choice(["photo", "video", None]), some(["k", "l", "m", "n"], 4), some(["x", "y"], 3)) for i in range(60)]
    s = spark.createDataFrame([(u, f) for u, f in subs], "user_id string, filters struct<artists:array<string>,regions:array<string>,genres:array<string>,mediums:array<string>>")
    c = spark.createDataFrame(items, "id string, seq long, region string, medium string, artist_names array<string>, genre_tags array<string>")
    got = [(r.user_id, r.id) for r in notify.match_custom(s, c).collect()]
    assert len(got) == len(set(got)) and set(got) == set(brute_match(subs, items))
    log = spark.createDataFrame([(u, "custom", e) for u, e in got[::3]], "user_id string, type string, ref string")
    alerts = notify.custom_alerts(s, c, log).collect()
    assert {(r.user_id, r.id) for r in alerts} == set(got) - set(got[::3])
    for user in {r.user_id for r in alerts}:
        mine = sorted((r.seq, r.mailed) for r in alerts if r.user_id == user)
        assert [m for _, m in mine] == [True] * min(12, len(mine)) + [False] * max(0, len(mine) - 12)


def test_reminders_and_digest(spark):
    rows = [("a", 1, "ongoing", D(2026, 6, 4)), ("b", 2, "ongoing", D(2026, 6, 3)), ("c", 3, "ongoing", D(2026, 6, 2)), ("d", 4, "upcoming", D(2026, 6, 4)), ("e", 5, "ongoing", None), ("f", 6, "ongoing", D(2026, 5, 1))]
    df = spark.createDataFrame(rows, "id string, seq long, status string, end_date date")
    assert sorted(ids(notify.reminder_filter(df, TODAY))) == ["a", "c"]
    assert [r.id for r in notify.digest_items(df, TODAY).orderBy("slot").collect()] == ["f", "c", "b", "a", "d", "e"]


def test_log_key_is_unique(spark):
    log = spark.createDataFrame([("u", "custom", "a", None)], "user_id string, type string, ref string, sent_at timestamp")
    out = notify.record_sent(log, spark.createDataFrame([("u", "custom", "a"), ("u", "custom", "b"), ("u", "custom", "b")], "user_id string, type string, ref string"), "2026-06-01")
    assert sorted(r.ref for r in out.collect()) == ["a", "b"]


def test_work_selection(spark):
    cols = "master_id string, source string, source_object_id string, title string, year string, medium string, image_url string, thumb_url string, source_url string, credit string, is_public_domain boolean, is_highlight boolean, seq long"
    w = lambda oid, seq, title="T", year="1900", image="i", thumb="t", pd=True, hl=False, src="aic": ("m", src, oid, title, year, None, image, thumb, "", "", pd, hl, seq)
    works = spark.createDataFrame(
        [w("1", 1, year=None), w("2", 2, hl=True), w("3", 3), w("4", 4, pd=False), w("5", 5, image=None), w("6", 6, title="A BAD one"), w("7", 7), w("3", 8), w("9", 9, thumb=None)], cols
    )
    src = "sources array<struct<source:string,query:string,object_ids:array<string>,artist:string>>"
    seeds = spark.createDataFrame([("m", [("aic", None, ["9", "none", "1"], None)], ["bad"], ["aic-7"], {"aic-1": "Renamed"})], f"id string, {src}, exclude_titles array<string>, exclude_ids array<string>, title_overrides map<string,string>")
    got = masters.select_master_works(seeds, works, cap=4).orderBy("rank").collect()
    assert [(r.work_id, r.title) for r in got] == [("aic-9", "T"), ("aic-1", "Renamed"), ("aic-2", "T"), ("aic-3", "T")]


def test_works_of_one_search_rank_come_by_id(spark):
    cols = "master_id string, source string, source_object_id string, title string, year string, medium string, image_url string, thumb_url string, source_url string, credit string, is_public_domain boolean, is_highlight boolean, seq long"
    rows = [("m", "aic", oid, "T", "1900", None, "i", "t", "", "", True, False, 5) for oid in ("3", "1", "4", "2")]
    src = "sources array<struct<source:string,query:string,object_ids:array<string>,artist:string>>"
    seeds = spark.createDataFrame([("m", [], [], [], {})], f"id string, {src}, exclude_titles array<string>, exclude_ids array<string>, title_overrides map<string,string>")
    for given in (rows, rows[::-1], [rows[2], *rows[:2], rows[3]]):
        got = masters.select_master_works(seeds, spark.createDataFrame(given, cols), cap=2).orderBy("rank").collect()
        assert [r.work_id for r in got] == ["aic-1", "aic-2"]


def test_credit_match(spark):
    files = [
        ("File:Portrait of Eugène Atget.jpg", "Eugène Atget", ""), ("File:Eugène Atget (1899).jpg", "Eugène Atget", ""), ("File:Atget Eugène.jpg", "", ""),
        ("File:Eugène Atget - Stairs.jpg", "Eugène Atget", ""), ("File:Stairs by Atget.jpg", "", ""), ("File:Stairs.jpg", "", ""), ("File:Atget park.jpg", "Someone", ""),
        ("File:Park Atget.jpg", "<b>ATGET</b>", "Book covers of France"), ("File:Portrait of a Baker.jpg", "Atget", ""),
    ]
    df = spark.createDataFrame([("m", i, *f, "Public domain", "u") for i, f in enumerate(files)], "master_id string, seq long, file_name string, artist string, categories string, licence string, image_url string")
    who = spark.createDataFrame([("m", "Eugène Atget", "Atget")], "master_id string, query string, needle string")
    assert [r.seq for r in masters.credit_match(df, who).orderBy("seq").collect()] == [3, 4, 8]


def test_search_titles(one):
    assert one(['"Stairs" (Paris) from the series X'], masters.clean_search_title) == ["Stairs"]


def test_lookup_join_splits_a_hot_key(spark):
    """The salted join gives the rows of a plain one."""
    big = spark.range(500).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    small = spark.range(50).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v")).unionByName(spark.sql("select 'hot' k, 2 v"))
    salted = sorted(map(tuple, joins.lookup_join(big, small, "k", F.col("id")).select("k", "id", "v").collect()))
    assert salted == sorted(map(tuple, big.join(small, "k").select("k", "id", "v").collect())) and len(salted) == 167 + 33


def test_geocoding(spark):
    venues = spark.createDataFrame(
        [("1", "A", "서울", "addr", None, None, "KR"), ("2", "B", None, None, 1.0, None, "JP"), ("3", "C", None, "x", 1.0, 2.0, "KR"), ("4", "D", None, None, None, None, "FR")],
        "id string, name string, region string, address string, latitude double, longitude double, country string",
    )
    places = spark.createDataFrame([("KR", "place", "addr", 9.0, 9.0), ("KR", "address", "addr", 5.0, 6.0), ("KR", "place", "B", 7.0, 7.0), ("KR", "place", "D", 8.0, 8.0)], "backend string, kind string, query string, lat double, lng double")
    got = {r.id: (r.latitude, r.longitude, r.geo_action) for r in enrich.geocode(venues, places, False).collect()}
    assert got == {"1": (5.0, 6.0, "geocoded"), "2": (1.0, None, "no_match"), "3": (1.0, 2.0, "payload"), "4": (8.0, 8.0, "geocoded")}


def test_page_pieces(one):
    page = '<meta content="x" name="a"><meta property="og:title" content="T | Site"><p>one<p class="b">two &amp; <b>three</b></p><p> </p><table><tr><th>시간 |</th><td>10</td><th>시간</th><td>11</td></tr></table><img src="a.png"><img src="/u_image/1.png">'
    assert one([page], extract.paragraphs) == [["one", "two & three"]]
    assert one([page], lambda c: extract.og_tags(c)["title"]) == ["T"] and one([page, ""], extract.meta_description) == [None, None]
    assert one([page], extract.label_table) == [{"시간": "11"}]
    assert one([page], lambda c: extract.poster(c, "h.org")) == ["https://h.org/u_image/1.png"]
    assert one(["<p>short</p>", "<p>" + "x" * 60 + "</p>"], extract.paragraph_text) == [None, "x" * 60]


def test_embedded_json_survives_bad_pages(spark):
    good = '<script id="__NEXT_DATA__" type="x">{"props":{"pageProps":{"fallback":{"#\\"name\\":\\"EventSearch\\"":{"data":[{"slug":"s","eventName":"E","categories":[{"fields":{"name":"写真"}}],"venue":{"fields":{"fullName":"V"}},"scheduleStartsOn":"2026-01-01"},{"slug":"q"}]}}}}}</script>'
    pages = spark.createDataFrame([(1, good), (2, '<script id="__NEXT_DATA__">{</script>'), (3, "none")], "page_id long, html string")
    rows = extract.event_rows(extract.embedded_events(pages), "https://t.org").collect()
    assert [(r.page_id, r.source_url, r.date_range) for r in rows] == [(1, "https://t.org/events/-/s", "2026-01-01")]


def test_catalogue_refuses_nan(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.write_catalog(spark.createDataFrame([("a", float("nan"))], "id string, v double"), str(tmp_path / "c"))
    tables.write_catalog(spark.createDataFrame([("a", None)], "id string, v double"), str(tmp_path / "c"))
    deep = "id string, v struct<a: array<struct<b: double>>, m: map<string, float>>"
    for bad in ((([(float("inf"),)]), {}), ([(1.0,)], {"k": float("nan")})):
        with pytest.raises(ValueError):
            tables.write_catalog(spark.createDataFrame([("a", bad)], deep), str(tmp_path / "d"))
    tables.write_catalog(spark.createDataFrame([("a", ([(1.0,), (None,)], None)), ("b", None)], deep), str(tmp_path / "d"))


def test_entities(one):
    texts = ["caf&eacute; &#8211; &#x2019;n&copy;", "&amp;lt; &#38;amp; &unknown; & &#; &#x110000;", "a&nbsp;b&#160;c", "plain", None]
    assert one(texts, text.decode_entities) == ["café – ’n©", "&lt; &amp; &unknown; & &#; \ufffd", "a b c", "plain", None]


def test_a_feed_without_allow_set_keeps_all(spark):
    items = spark.createDataFrame([("A", "https://h.org/1", ["전시1관 Gallery1"], "d"), ("B", "https://h.org/2", ["전시소식"], "d")], "title string, link string, category array<string>, description string")
    assert extract.rss_rows(items, "h.org").count() == 1 and extract.rss_rows(items, "h.org", None).count() == 2


def test_alerts_with_a_hot_medium(spark):
    """A third of the subscribers on one medium that most items have: same rows as brute force, no cell of the join above the split."""
    import random

    rng = random.Random(6)
    items = [(f"x{k}", k, [f"a{rng.randrange(30)}"], [f"g{rng.randrange(9)}"] if k % 3 else [], "서울" if k % 2 else None, "photo" if k % 5 else "video") for k in range(300)]
    want = lambda k: {"artists": [f"a{k % 40}"] if k % 4 == 1 else [], "genres": ["g1", "g2"] if k % 5 == 0 else None, "regions": ["서울"] if k % 7 == 0 else [], "mediums": ["photo"] if k % 3 == 0 else ["video", "video"] if k % 3 == 1 else []}
    people = [(f"u{k}", want(k)) for k in range(240)]
    catalogue = spark.createDataFrame(items, "id string, seq long, artist_names array<string>, genre_tags array<string>, region string, medium string")
    subscribers = spark.createDataFrame(people, "user_id string, filters struct<artists: array<string>, genres: array<string>, regions: array<string>, mediums: array<string>>")
    expected = set()
    for user, f in people:
        active = {d: set(v) for d, v in f.items() if v}
        for i, _, artists, genres, region, medium in items:
            has = {"artists": set(artists), "genres": set(genres), "regions": {region}, "mediums": {medium}}
            if active and all(v & has[d] for d, v in active.items()):
                expected.add((user, i))
    rows = notify.match_custom(subscribers, catalogue, split=32).collect()
    assert {(r.user_id, r.id) for r in rows} == expected and len(rows) == len(expected)
    offers = notify._offers(catalogue)
    left, right = notify.dealt(notify.probes(subscribers, offers), offers, 32)
    for side in (left, right):
        assert side.groupBy("pair", "row", "cell").count().agg({"count": "max"}).first()[0] <= 2 * 32
    # who asks for a rare artist and a common medium probes by the artist
    lead = notify.probes(subscribers, offers).filter("pair.dimension = 'mediums' AND size(want_artists) > 0")
    assert lead.isEmpty()


def test_lookups_beside_missing_and_popular_keys(spark):
    venues = spark.createDataFrame([(f"v{k}", "Hall", "서울", None if k % 2 else "addr", "KR", 1.0 if k % 3 else None, 2.0) for k in range(90)] + [(None, None, None, None, None, None, None)], "id string, name string, region string, address string, country string, latitude double, longitude double")
    places = spark.createDataFrame([("KR", "address", "addr", 5.0, 6.0)], "backend string, kind string, query string, lat double, lng double")
    rows = {r.id: (r.latitude, r.geo_action) for r in enrich.geocode(venues, places, False).collect()}
    assert len(rows) == 91 and rows["v0"] == (5.0, "geocoded") and rows["v3"] == (None, "no_match") and rows["v1"] == (1.0, "payload") and rows[None] == (None, "no_match")


def test_growing_lookups_are_joined_without_copies(spark, capsys):
    """A lookup copied for each salt is broadcast by the size of one copy, and the copies fill the driver."""
    shows = spark.sql("SELECT 'x1' id, 1L seq, array('a1') artist_ids, 'v1' venue_id")
    artists = spark.sql("SELECT 'a1' id, 'A' name, 'en' lang, CAST(NULL AS MAP<STRING, MAP<STRING, STRING>>) tr")
    offers = spark.sql("SELECT 'x1' id, 1L seq, named_struct('dimension', 'mediums', 'value', 'photo') pair")
    asked = spark.sql("SELECT 'u' user_id, named_struct('dimension', 'mediums', 'value', 'photo') pair, 1L n")
    for df in (embed.embed_artists(shows, artists), *notify.dealt(asked, offers)):
        df.explain(True)
        assert "_salt" not in capsys.readouterr().out


def test_matches_do_not_shuffle_to_be_flagged(spark, monkeypatch):
    """Equal seqs go by id, and the flag needs no join of the matches with themselves."""
    rows = spark.createDataFrame([("u", f"e{i:02}", i // 5) for i in range(20)], "user_id string, id string, seq long")
    monkeypatch.setattr(notify, "match_custom", lambda *_: rows)
    log = spark.createDataFrame([("u", "custom", "e00"), ("u", "weekly_digest", "e01")], "user_id string, type string, ref string")
    got = notify.custom_alerts(None, None, log)
    assert sorted(r.id for r in got.collect() if r.mailed) == [f"e{i:02}" for i in range(1, 13)] and got.count() == 19


def test_new_alerts_are_those_of_rows(spark, monkeypatch):
    """Blocks, cells and ranges of several sizes, holes in the log, missing and equal seqs: the rows that flagging all matches gives, and nothing
    of the size of the matches is written. Equal filters in another order are matched once."""
    import random

    rng = random.Random(9)
    monkeypatch.setattr(notify, "RANGE_WIDTH", 100)
    written, real = {}, notify.materialize
    monkeypatch.setattr(notify, "materialize", lambda df, path: written.update({path.split("/")[-1].rsplit("-", 1)[0]: (out := real(df, path))}) or out)
    people = [(f"u{k}", {"artists": [f"a{k}"] if k % 9 == 0 else None, "genres": [], "regions": [], "mediums": ["photo", "video"] if k % 2 else ["video", "photo"]}) for k in range(40)]
    items = [(f"x{k}", None if k % 70 == 0 else k // 2, [f"a{rng.randrange(40)}"], ["g"], None, rng.choice(["photo", "video", "other"])) for k in range(500)]
    catalogue = spark.createDataFrame(items, "id string, seq long, artist_names array<string>, genre_tags array<string>, region string, medium string")
    subscribers = spark.createDataFrame(people, "user_id string, filters struct<artists: array<string>, genres: array<string>, regions: array<string>, mediums: array<string>>")
    first = [i for i, s, _, _, _, m in sorted(items, key=lambda i: (i[1] is not None, i[1], i[0])) if m != "other"]
    log = [(f"u{k}", "custom", i) for k in range(1, 40, 2) for i in (first[:k * 4] if k % 3 else rng.sample(first, 60))] + [("u2", "weekly_digest", first[0]), ("nobody", "custom", "x1"), ("u4", "custom", "gone")]
    log = spark.createDataFrame(log, "user_id string, type string, ref string")
    got = notify.new_alerts(subscribers, catalogue, log, split=64).collect()
    assert written["alert-places"].count() < 700 and written["alert-classes"].agg({"s": "max"}).first()[0] == 35
    plain = notify.custom_alerts(subscribers, catalogue, log).collect()
    assert len(got) == len(plain) > 6000
    assert {(r.user_id, r.ref, r.seq, r.mailed) for r in got} == {(r.user_id, r.id, r.seq, r.mailed) for r in plain}
    dated = log.selectExpr("*", "CAST(NULL AS TIMESTAMP) sent_at")
    doubled = subscribers.unionByName(subscribers.filter("user_id < 'u2'"))
    doubled = doubled.unionByName(spark.createDataFrame([("u3", {"artists": ["a1"], "genres": [], "regions": [], "mediums": []})], subscribers.schema))
    rows = notify.record_alerts(dated, doubled, catalogue.unionByName(catalogue.limit(50)), "2026-06-01")
    assert rows.count() == rows.select("user_id", "type", "ref").distinct().count()
    more = {("u3", i) for i, _, a, _, _, _ in items if a == ["a1"]}
    assert {(r.user_id, r.ref) for r in rows.collect()} == {(r.user_id, r.ref) for r in got} | {(r.user_id, r.ref) for r in log.collect()} | more
