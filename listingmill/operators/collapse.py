"""Cross-source duplicates: find same-show links, connect them, keep one row each.

Two rows with the same start and end dates are one show when

1. their title keys are equal, or
2. they share poster and source, or
3. exactly one comes from an aggregator and the venue is the same, or
4. exactly one comes from an aggregator and the bracketed core titles are equal.

Comparing pairs is quadratic in a popular date, so each signal becomes a *group key* and each
group a star: rows link to the group's smallest ``seq``. For 3 and 4 every row of a group that
holds both kinds is connected (all aggregator × primary pairs), and a group with one kind has
no links; a star over the mixed groups therefore gives the same components.

A group may hold a third of all rows. The links given out (``same_show_links``) are split by ``seq % SPLITS``: rows link to
the hub of their slice and slice hubs link to the group's hub, so no hub sees more than ``1/SPLITS`` of it. Components
(``show_components``) follow from each row's hubs, one a signal, and only links between hubs go through the rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from listingmill.functions.text import core_title_key, dedup_title_key
from listingmill.operators.joins import shuffled, unless_few
from listingmill.session import materialize, shared_dir

# --- fixed values -----------------------------------------------------------
AGGREGATORS = ("artmap", "naver", "tokyo_art_beat")
GENERAL_SOURCES = ("artmap", "naver")
PHOTO_MEDIUMS = ("photo", "video", "gear")
# -----------------------------------------------------------------------------
SPLITS = 256


def is_aggregator(source: Column) -> Column:
    return F.coalesce(source.isin(*AGGREGATORS), F.lit(False))


def photo_relevance(exhibitions: DataFrame) -> DataFrame:
    """Rows of the all-genre sources stay only with a photographic medium."""
    general = F.coalesce(F.col("source").isin(*GENERAL_SOURCES), F.lit(False))
    return exhibitions.filter(~general | F.coalesce(F.col("medium").isin(*PHOTO_MEDIUMS), F.lit(False)))


def signal_rows(exhibitions: DataFrame) -> DataFrame:
    """(seq, aggregator, signal, key): one row per signal a listing can match on."""
    title_key = dedup_title_key(F.col("title"))
    matchable = exhibitions.filter((title_key != "") & F.col("start_date").isNotNull())
    dates = F.concat_ws("~", F.col("start_date").cast("string"), F.coalesce(F.col("end_date").cast("string"), F.lit("")))

    poster = F.nullif(F.col("poster_image_url"), F.lit(""))
    keyed = matchable.select(
        "seq",
        is_aggregator(F.col("source")).cast("int").alias("kind"),
        dates.alias("dates"),
        title_key.alias("k1"),
        F.when(poster.isNotNull(), F.concat_ws("\u001f", F.coalesce(F.col("source"), F.lit("")), poster)).alias("k2"),
        F.nullif(F.col("venue_id"), F.lit("")).alias("k3"),
        F.nullif(core_title_key(F.col("title")), F.lit("")).alias("k4"),
    )
    signals = F.array(*[F.struct(F.lit(n).alias("signal"), F.col(f"k{n}").alias("value")) for n in (1, 2, 3, 4)])
    return (
        keyed.select("seq", "kind", "dates", F.explode(signals).alias("s"))
        .filter(F.col("s.value").isNotNull())
        .select("seq", "kind", "s.signal", F.concat_ws("\u001f", "dates", "s.value").alias("key"))
    )


def same_show_links(exhibitions: DataFrame, splits: int = SPLITS) -> DataFrame:
    """Star links (seq, hub) whose connected components are the duplicate groups.

    The hub table is read twice, so it is written once; it is small, since it keeps only slices
    of groups with more than one row, and its minima combine on the map side.
    """
    keys = ["h", "signal", "key", "slice"]
    # The leading hash makes joins and sorts compare a long; the real key follows it, so a
    # collision changes nothing.
    rows = signal_rows(exhibitions).withColumn("slice", F.pmod(F.col("seq"), F.lit(splits)))
    rows = rows.withColumn("h", F.xxhash64("signal", "key", "slice"))
    slices = rows.groupBy(*keys).agg(
        F.min("seq").alias("hub"),
        F.min("kind").alias("k0"),
        F.max("kind").alias("k1"),
        F.count(F.lit(1)).alias("n"),
    )
    group = W.partitionBy("signal", "key")  # at most `splits` rows
    hubs = (
        slices.withColumns(
            {
                "root": F.min("hub").over(group),
                "mixed": F.min("k0").over(group) < F.max("k1").over(group),
                "total": F.sum("n").over(group),
            }
        )
        .filter((F.col("total") > 1) & (F.col("mixed") | (F.col("signal") <= 2)))
        .select(*keys, "hub", "root")
    )
    hubs = materialize(hubs, shared_dir(exhibitions.sparkSession, "hubs"))
    to_slice = rows.join(hubs.select(*keys, "hub"), keys).select("seq", "hub")
    to_root = hubs.select(F.col("hub").alias("seq"), F.col("root").alias("hub"))
    return to_slice.unionByName(to_root).filter(F.col("seq") != F.col("hub")).distinct()


def connected_components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(seq, component): the smallest reachable ``seq`` of every linked row.

    Random contraction: each round ranks the vertices by a hash of its own, a vertex goes to the least ranked of itself and its
    neighbours, and the links are drawn between the places gone to. No order of the ids makes a chain slow: of a path or a star about half
    the vertices are left, of dense groups almost none, so the rounds grow with the logarithm and all rounds together cost two or three times the first.
    The places are then followed back from the last round to the first.

    Minima combine on the map side; joins meet a table with one row a vertex, so a vertex of many links is split by the session
    as a skewed partition. Every round is written to the shared folder, which cuts the lineage.
    """
    root = shared_dir(links.sparkSession, "components")
    edges = materialize(links.select(F.col("seq").alias("a"), F.col("hub").alias("b")), f"{root}/links")
    steps = []
    for number in range(max_rounds):

        def rank(c: str, number: int = number) -> Column:
            return F.xxhash64(F.lit(number), c)

        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e"))
        near = ends.select("e.*").groupBy("v").agg(F.min_by("w", rank("w")).alias("w"))
        steps.append(materialize(near.select("v", F.when(rank("w") < rank("v"), F.col("w")).otherwise(F.col("v")).alias("place")), f"{root}/step-{number}"))
        met = unless_few(steps[-1])
        gone = [met.select(F.col("v").alias(end), F.col("place").alias(name)) for end, name in (("a", "x"), ("b", "y"))]
        drawn = edges.join(gone[0], "a").join(gone[1], "b").filter(F.col("x") != F.col("y"))
        edges = materialize(drawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{root}/links-{number}")
        if edges.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = steps.pop()
    while steps:
        later = unless_few(found).select(F.col("v").alias("place"), F.col("place").alias("further"))
        back = steps.pop().join(later, "place", "left").select("v", F.coalesce("further", "place").alias("place"))
        found = materialize(back, f"{root}/places-{len(steps)}")
    least = found.groupBy("place").agg(F.min("v").alias("component"))
    return unless_few(found).join(least, "place").select(F.col("v").alias("seq"), "component")


def show_groups(exhibitions: DataFrame) -> DataFrame:
    """(seq, hub): each row of a group that makes links, the first one too, with the group's smallest ``seq``.

    The groups are those of ``same_show_links``, told apart by 128 bits of hash, so that no text is shuffled. A group's row is a map-side
    combined aggregate, and a group with most of the rows is split by the session as a skewed partition of the join.
    """
    keys = ["h", "g"]
    rows = signal_rows(exhibitions).select(
        F.xxhash64("signal", "key").alias("h"), F.xxhash64(F.lit("again"), F.col("key"), F.col("signal")).alias("g"), "seq", "kind", "signal"
    )
    groups = rows.groupBy(*keys).agg(
        F.min("seq").alias("hub"), F.count(F.lit(1)).alias("n"), (F.min("kind") < F.max("kind")).alias("mixed"), F.min("signal").alias("signal")
    )
    linking = groups.filter((F.col("n") > 1) & (F.col("mixed") | (F.col("signal") <= 2)))
    return rows.select(*keys, "seq").join(shuffled(linking.select(*keys, "hub")), keys).select("seq", "hub")


def show_components(exhibitions: DataFrame) -> DataFrame:
    """(seq, component) of every listing with a duplicate.

    A row has at most one hub a signal: it belongs to the least, and only links between hubs, which coincide from row to row, go
    through the rounds of ``connected_components``.
    """
    spark = exhibitions.sparkSession
    held = show_groups(exhibitions).groupBy("seq").agg(F.array_sort(F.collect_set("hub")).alias("hubs"))
    held = materialize(held.select("seq", F.get("hubs", F.lit(0)).alias("hub"), F.slice("hubs", 2, 3).alias("others")), shared_dir(spark, "hubs"))
    between = held.select(F.explode("others").alias("seq"), "hub").distinct()
    named = connected_components(between).withColumnsRenamed({"seq": "hub"})
    placed = held.select("seq", "hub").join(shuffled(named), "hub", "left")
    return materialize(placed.select("seq", F.coalesce("component", "hub").alias("component")), shared_dir(spark, "shows"))


def with_component(exhibitions: DataFrame, splits: int = SPLITS) -> DataFrame:
    """Every listing with its component (its own ``seq`` when alone) and whether it has a duplicate.

    ``splits`` is accepted as in ``same_show_links``; components need no slices.
    """
    return (
        exhibitions.join(show_components(exhibitions), "seq", "left")
        .withColumn("linked", F.col("component").isNotNull())
        .withColumn("component", F.coalesce("component", "seq"))
    )


def winner_order() -> Column:
    """Most authoritative first: primary, longest description, most artists, poster, id."""
    return F.struct(
        is_aggregator(F.col("source")).cast("int").alias("o1"),
        (-F.length(F.coalesce("description", F.lit("")))).alias("o2"),
        (-F.size(F.coalesce("artist_ids", F.array().cast("array<string>")))).alias("o3"),
        (F.coalesce("poster_image_url", F.lit("")) == "").cast("int").alias("o4"),
        F.col("id").alias("o5"),
    )


def union_in_order(members: DataFrame, group: str, array_col: str, order: str = "seq") -> DataFrame:
    """(group, array_col): distinct elements of a group's arrays, first seen first.

    Elements are reduced to one row per (group, value) before any list is built, so a list only
    ever holds the distinct values that the result has to carry.
    """
    values = F.posexplode(F.filter(array_col, lambda v: v != "")).alias("pos", "value")
    firsts = members.select(group, order, values).groupBy(group, "value").agg(F.min(F.struct(order, "pos")).alias("at"))
    lists = firsts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("found"))
    return lists.select(group, F.transform("found", lambda f: f["value"]).alias(array_col))


def merge_duplicates(exhibitions: DataFrame, components: DataFrame) -> DataFrame:
    """One row per component at the first member's position, with artists and genres grafted on.

    Winners are chosen, and lists united, on the columns that this needs; whole rows are read and joined once, at the end, to
    what becomes of them. The lists of a component hold all its distinct artists and genres, since the result row does.
    """
    empty = F.array().cast("array<string>")
    grafted = {"artist_ids": "all_artists", "genre_tags": "all_genres"}
    narrow = exhibitions.select("seq", winner_order().alias("_order"), *grafted).join(shuffled(components), "seq")
    linked = materialize(narrow, shared_dir(exhibitions.sparkSession, "linked"))
    groups = linked.groupBy("component").agg(
        F.min_by("seq", "_order").alias("winner"), F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_members")
    )
    for column, name in grafted.items():
        groups = groups.join(shuffled(union_in_order(linked, "component", column).withColumnRenamed(column, name)), "component", "left")
    fate = components.select("seq", F.lit(True).alias("_linked")).join(shuffled(groups.drop("component").withColumnRenamed("winner", "seq")), "seq", "left")
    kept = exhibitions.join(shuffled(fate), "seq", "left").filter(F.col("_linked").isNull() | F.col("_first").isNotNull())
    return kept.select(
        F.coalesce("_first", "seq").alias("seq"),
        *[
            F.array_distinct(F.concat(F.coalesce(c, empty), F.coalesce(grafted[c], empty))).alias(c) if c in grafted else F.col(c)
            for c in exhibitions.columns
            if c != "seq"
        ],
        F.coalesce("_members", F.lit(1).cast("long")).alias("members"),
    )


def collapse_cross_source(exhibitions: DataFrame, splits: int = SPLITS) -> DataFrame:
    return merge_duplicates(exhibitions, show_components(exhibitions))
