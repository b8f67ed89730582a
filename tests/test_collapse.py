"""Cross-source dedup: golden cases, brute force on random inputs, and a hot group."""

from __future__ import annotations

import datetime
import random

import pytest

from listingmill.operators import collapse, joins

DDL = (
    "seq long, id string, source string, title string, description string, poster_image_url string, venue_id string, "
    "start_date date, end_date date, artist_ids array<string>, genre_tags array<string>"
)
S, E = datetime.date(2026, 5, 1), datetime.date(2026, 6, 1)


def row(seq, source="pgi", title="T", start=S, end=E, venue="v", poster=None, artists=(), genres=(), description=None):
    return (seq, f"id{seq:04d}", source, title, description, poster, venue, start, end, list(artists), list(genres))


def collapsed(spark, rows, **kw):
    out = collapse.collapse_cross_source(spark.createDataFrame(rows, DDL), **kw).collect()
    return {r.seq: r for r in out}


def test_primary_wins_and_associations_are_grafted(spark):
    got = collapsed(spark, [
        row(0, "artmap", "《봄》", artists=["a", "b"], genres=["x"], description="long text"), row(1, "pgi", "봄", artists=["c", "a"], genres=["y"]),
    ])
    assert list(got) == [0]
    assert got[0].id == "id0001" and got[0].artist_ids == ["c", "a", "b"] and got[0].genre_tags == ["y", "x"] and got[0].members == 2


def test_kept_apart(spark):
    rows = [
        row(0, title="T"), row(1, title="T", start=datetime.date(2027, 5, 1)), row(2, title=""), row(3, title=None), row(4, title="U", start=None),
        row(5, title="U", start=None), row(6, "artmap", "other", venue="w"), row(7, "tokyo_art_beat", "another", venue="w"), row(8, "pgi", "third", venue="v"),
    ]
    assert sorted(collapsed(spark, rows)) == list(range(9))


def test_signals(spark):
    assert sorted(collapsed(spark, [row(0, "tokyo_art_beat", "写真展「光」", venue="a"), row(1, "pgi", "光", venue="b")])) == [0]
    assert sorted(collapsed(spark, [row(0, "tokyo_art_beat", "Light", venue="a"), row(1, "pgi", "光", venue="a")])) == [0]
    assert sorted(collapsed(spark, [row(0, "pgi", "A", poster="p", venue="a"), row(1, "pgi", "B", poster="p", venue="b")])) == [0]
    assert sorted(collapsed(spark, [row(0, "pgi", "A", poster="p", venue="a"), row(1, "koba", "B", poster="p", venue="b")])) == [0, 1]
    assert sorted(collapsed(spark, [row(0, end=None), row(1, end=None), row(2)])) == [0, 2]


def brute_force(rows):
    """Union-find over all pairs, straight from the four signals."""
    parent = {r[0]: r[0] for r in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def key(t):
        return "".join(ch for ch in (t or "") if ch not in "《》「」『』\"'()[] ").lower()

    def core(t):
        return key(t.split("「")[1].split("」")[0]) if t and "「" in t else key(t)

    agg = collapse.AGGREGATORS
    for a in rows:
        for b in rows:
            if a[0] >= b[0] or not key(a[3]) or not key(b[3]) or a[7] is None or (a[7], a[8]) != (b[7], b[8]):
                continue
            same = key(a[3]) == key(b[3]) or (a[5] and a[5] == b[5] and a[2] == b[2])
            if (a[2] in agg) != (b[2] in agg):
                same = same or (a[6] and a[6] == b[6]) or core(a[3]) == core(b[3])
            if same:
                parent[find(a[0])] = find(b[0])
    least = {}
    for r in rows:
        root = find(r[0])
        least[root] = min(least.get(root, r[0]), r[0])
    return {r[0]: least[find(r[0])] for r in rows}


@pytest.mark.parametrize("seed", range(3))
def test_random_components(spark, seed):
    rng = random.Random(seed)
    rows = [
        row(
            i, rng.choice(["artmap", "tokyo_art_beat", "pgi", "koba"]), rng.choice(["", "「{}」展", "{}", "{}"]).format(rng.randrange(60)),
            start=rng.choice([S, S, None]), end=rng.choice([E, None]), venue=rng.choice([None, ""] + [f"v{k}" for k in range(40)]),
            poster=rng.choice([None, f"p{rng.randrange(50)}"]),
        )
        for i in range(400)
    ]
    got = collapse.with_component(spark.createDataFrame(rows, DDL), splits=4).collect()
    assert {r.seq: r.component for r in got} == brute_force(rows)


def test_long_chain_settles_quickly(spark):
    """A path graph is the worst case of plain label passing; the jump makes it logarithmic."""
    order = list(range(300))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(299)], "seq long, hub long")
    got = collapse.connected_components(links, max_rounds=14).collect()
    assert {r.component for r in got} == {0} and len(got) == 300


@pytest.mark.parametrize("seed", range(2))
def test_components_of_random_links(spark, seed):
    """Chains, stars, cycles and links of a row to itself, with negative ids: the smallest id of each component."""
    rng = random.Random(seed)
    links = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)] + [(1000 + k, 1000) for k in range(50)] + [(5000, 5000)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = collapse.connected_components(spark.createDataFrame(links, "seq long, hub long")).collect()
    assert sorted((r.seq, r.component) for r in got) == sorted((x, find(x)) for x in list(parent))
    assert collapse.connected_components(spark.createDataFrame([], "seq long, hub long")).count() == 0


def test_rounds_contract_the_links(spark, monkeypatch):
    """A star of stars: links go down from round to round, so all rounds together join little more than the first."""
    written = []
    real = collapse.materialize
    monkeypatch.setattr(collapse, "materialize", lambda df, path: written.append((path.split("/")[-1], out := real(df, path))) or out)
    links = [(k, k % 20) for k in range(20, 1000)] + [(k, k + 1) for k in range(20)]
    got = collapse.connected_components(spark.createDataFrame(links, "seq long, hub long")).collect()
    assert len(got) == 1000 and {r.component for r in got} == {0}
    counts = {name: df.count() for name, df in written if name.startswith("links")}
    assert counts["links"] == 1000 and counts["links-0"] < 800 and sum(counts.values()) < 3000, counts


def test_rows_go_through_the_rounds_once(spark, monkeypatch):
    """Links between hubs only: far fewer than rows, where each row has several signals."""
    seen = []
    whole = collapse.connected_components
    monkeypatch.setattr(collapse, "connected_components", lambda links, **kw: seen.append(links.count()) or whole(links, **kw))
    rows = [row(i, "artmap" if i % 2 else "pgi", f"t{i % 7}", venue=f"v{i % 5}", poster=f"p{i % 6}") for i in range(600)]
    got = collapse.with_component(spark.createDataFrame(rows, DDL)).collect()
    assert {r.component for r in got} == {0} and seen[0] < 60


def test_hot_group_links_stay_linear_and_split(spark):
    """A third of the rows in one group: no more links than rows per signal, no hub with more than its slice."""
    rows = [row(i, "artmap" if i % 2 else "pgi", "Hot" if i % 3 == 0 else f"t{i}", venue=f"v{i}") for i in range(3000)]
    links = collapse.same_show_links(spark.createDataFrame(rows, DDL), splits=16)
    counted = links.groupBy("hub").count().collect()
    assert sum(r["count"] for r in counted) < 1000 * 1.1
    assert max(r["count"] for r in counted) <= 1000 // 16 + 16 + 1
    got = collapsed(spark, rows, splits=16)
    assert len(got) == 2001 and got[0].members == 1000


def test_collapse_is_idempotent(spark):
    rows = [row(i, "artmap" if i % 2 else "pgi", f"t{i % 5}") for i in range(20)]
    once = collapse.collapse_cross_source(spark.createDataFrame(rows, DDL)).drop("members")
    again = collapse.collapse_cross_source(once).drop("members")
    assert sorted(map(tuple, once.select("seq", "id").collect())) == sorted(map(tuple, again.select("seq", "id").collect()))


def test_growing_tables_of_the_catalogue_do_not_pass_through_the_driver(spark, monkeypatch):
    """However few bytes their files have: rows repeated for each signal, nested artists and components are never broadcast."""
    from listingmill.operators import embed

    plans, real = [], collapse.materialize
    executed = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(collapse, "materialize", lambda df, path: plans.append((path.split("/")[-1], executed(df))) or real(df, path))
    monkeypatch.setattr(joins, "FEW", -1)
    shows = [row(i, start=datetime.date(2026, 1, i % 3 + 1), end=None, title=f"t{i % 4}", artists=["a1"]) for i in range(24)]
    unique = real(spark.createDataFrame(shows, DDL), collapse.shared_dir(spark, "unique"))
    merged = collapse.collapse_cross_source(unique)
    artists = real(spark.sql("SELECT 'a1' id, 'A' name, 'en' lang, CAST(NULL AS MAP<STRING, MAP<STRING, STRING>>) tr"), collapse.shared_dir(spark, "artists"))
    plans += [("merged", executed(merged)), ("artists", executed(embed.embed_artists(unique, artists)))]
    assert len(plans) > 5 and not [name for name, text in plans if "Broadcast" in text]
    assert merged.count() == 12
