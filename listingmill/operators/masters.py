"""Works of the masters: one schema from three museum records, selection, commentary, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from listingmill.functions.keys import facts_hash
from listingmill.functions.text import clean_whitespace, strip_markup
from listingmill.operators.joins import lookup_join
from listingmill.operators.merge import first_by

# --- fixed values -----------------------------------------------------------
IIIF, AIC_PAGE = "https://www.artic.edu/iiif/2", "https://www.artic.edu/artworks"
AIC_CREDIT = "Art Institute of Chicago · CC0"
MET_CREDIT = "The Metropolitan Museum of Art"
COMMONS_CREDIT = "Wikimedia Commons · Public domain"
NON_WORK_CATEGORIES = "book covers|title pages|advertisements|paintings|drawings"
NAME_ONLY_REST = r"^(?:|\(?c?\.? ?1[89]\d\d\)?|m?\d{1,6}|portrait)$"
MAX_OBJECT_NAME = 120
WORKS_CAP = 10
UNKNOWN_BIRTH = 9999
# -----------------------------------------------------------------------------
WORK_COLUMNS = (
    "master_id", "source", "source_object_id", "title", "year", "medium", "image_url", "thumb_url",
    "source_url", "credit", "is_public_domain", "is_highlight", "seq",
)


def work_id(source: Column, object_id: Column) -> Column:
    return F.concat(source, F.lit("-"), object_id)


def _text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def is_public_domain(licence: Column) -> Column:
    low = F.lower(F.coalesce(licence, F.lit("")))
    return F.contains(low, F.lit("public domain")) | F.contains(low, F.lit("cc0")) | F.contains(low, F.lit("pd-"))


def file_title(object_name: Column, file_name: Column) -> Column:
    """Object name when short enough, else the file name without prefix, extension and underscores."""
    name = strip_markup(F.coalesce(object_name, F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(file_name, F.lit("")), "^File:", ""), r"\.[A-Za-z]{3,4}$", "")
    bare = F.trim(F.replace(bare, F.lit("_"), F.lit(" ")))
    return F.when(F.length(name).between(1, MAX_OBJECT_NAME), name).otherwise(
        F.coalesce(_text(bare), F.lit("Untitled"))
    )


def work_year(taken: Column) -> Column:
    return _text(F.regexp_extract(strip_markup(F.coalesce(taken, F.lit(""))), r"\b(1[89]\d\d)\b", 1))


def met_works(records: DataFrame) -> DataFrame:
    return records.select(
        "master_id", F.lit("the_met").alias("source"), F.col("objectID").cast("string").alias("source_object_id"),
        F.coalesce(_text(F.col("title")), F.lit("Untitled")).alias("title"), _text(F.col("objectDate")).alias("year"),
        _text(F.col("medium")).alias("medium"), _text(F.col("primaryImage")).alias("image_url"),
        F.coalesce(_text(F.col("primaryImageSmall")), _text(F.col("primaryImage"))).alias("thumb_url"),
        F.coalesce("objectURL", F.lit("")).alias("source_url"),
        F.coalesce(_text(F.col("creditLine")), F.lit(MET_CREDIT)).alias("credit"),
        F.coalesce("isPublicDomain", F.lit(False)).alias("is_public_domain"),
        F.coalesce("isHighlight", F.lit(False)).alias("is_highlight"), "seq",
    )


def aic_works(records: DataFrame) -> DataFrame:
    def image(size: str) -> Column:
        return F.when(
            F.coalesce("image_id", F.lit("")) != "",
            F.concat(F.lit(f"{IIIF}/"), F.col("image_id"), F.lit(f"/full/{size},/0/default.jpg")),
        )

    return records.filter(F.col("id").isNotNull()).select(
        "master_id", F.lit("aic").alias("source"), F.col("id").cast("string").alias("source_object_id"),
        F.coalesce(_text(F.col("title")), F.lit("Untitled")).alias("title"), _text(F.col("date_display")).alias("year"),
        _text(F.col("medium_display")).alias("medium"), image("843").alias("image_url"), image("200").alias("thumb_url"),
        F.concat(F.lit(f"{AIC_PAGE}/"), F.col("id").cast("string")).alias("source_url"), F.lit(AIC_CREDIT).alias("credit"),
        F.coalesce("is_public_domain", F.lit(False)).alias("is_public_domain"), F.lit(False).alias("is_highlight"), "seq",
    )


def commons_works(records: DataFrame) -> DataFrame:
    url = F.coalesce(_text(F.col("thumburl")), _text(F.col("url")))
    return records.filter(F.contains(F.coalesce("mime", F.lit("")), F.lit("image"))).select(
        "master_id", F.lit("wikimedia").alias("source"), F.col("pageid").cast("string").alias("source_object_id"),
        file_title(F.col("object_name"), F.col("file_name")).alias("title"), work_year(F.col("taken")).alias("year"),
        F.lit(None).cast("string").alias("medium"), url.alias("image_url"), url.alias("thumb_url"),
        F.coalesce(_text(F.col("descriptionurl")), _text(F.col("url")), F.lit("")).alias("source_url"),
        F.lit(COMMONS_CREDIT).alias("credit"), is_public_domain(F.col("licence")).alias("is_public_domain"),
        F.lit(False).alias("is_highlight"), "seq",
    )


def unify_works(met: DataFrame, aic: DataFrame, commons: DataFrame) -> DataFrame:
    return met_works(met).unionByName(aic_works(aic)).unionByName(commons_works(commons))


def works_by_id(wanted: DataFrame, works: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Hand-picked works in authored order. ``wanted``: master_id, source, object_ids, list_pos.

    ``aliases`` (from_id, to_id) follows title normalisation; ids that do not exist are skipped.
    """
    asked = wanted.select("master_id", "source", "list_pos", F.posexplode("object_ids").alias("pos", "asked_id"))
    if aliases is not None:
        asked = asked.join(aliases, asked.asked_id == aliases.from_id, "left")
        asked = asked.withColumn("source_object_id", F.coalesce("to_id", "asked_id")).drop("from_id", "to_id")
    else:
        asked = asked.withColumn("source_object_id", F.col("asked_id"))
    keys = ["source", "source_object_id"]
    # only the asked records are reduced to one per id
    records = first_by(works.drop("master_id").join(asked.select(*keys).distinct(), keys, "left_semi"), keys)
    return asked.join(records, keys)


def select_master_works(seeds: DataFrame, works: DataFrame, cap: int = WORKS_CAP) -> DataFrame:
    """Works kept per master, with ``rank`` 1..cap.

    Authored works come first in authored order, then found ones by highlight, year, thumbnail.
    One row per work id is kept by a map-side combined minimum; the cap is a ``row_number`` limit,
    which Spark also applies before the shuffle, so a master with most of the works stays cheap.
    Found works of one search rank are told apart by their id.
    """
    wanted = seeds.select(F.col("id").alias("master_id"), F.posexplode("sources").alias("list_pos", "s")).select(
        "master_id", "list_pos", "s.source", "s.object_ids"
    )
    zero = F.lit(0).cast("long")

    def order(tier: int, *parts: Column) -> Column:
        names = ("a", "b", "c", "d")
        padded = [*parts, *[zero] * (4 - len(parts))]
        return F.struct(F.lit(tier).alias("tier"), *[p.cast("long").alias(n) for p, n in zip(padded, names, strict=True)])

    authored = works_by_id(wanted.filter(F.size("object_ids") > 0), works).withColumn(
        "at", order(0, F.col("list_pos"), F.col("pos"))
    )
    found = works.withColumn(
        "at",
        order(
            1,
            -F.col("is_highlight").cast("int"),
            -F.col("year").isNotNull().cast("int"),
            -F.col("thumb_url").isNotNull().cast("int"),
            F.col("seq"),
        ),
    )
    cols = [*WORK_COLUMNS, "at"]
    rules = seeds.select(F.col("id").alias("master_id"), "exclude_titles", "exclude_ids", "title_overrides")
    shown = (
        authored.select(*cols)
        .unionByName(found.select(*cols))
        .filter(F.col("is_public_domain") & (F.coalesce("image_url", F.lit("")) != ""))
        .withColumn("work_id", work_id(F.col("source"), F.col("source_object_id")))
    )
    candidates = (
        lookup_join(shown, rules, "master_id", spread_by=F.col("work_id"))
        .filter(
            ~F.array_contains("exclude_ids", F.col("work_id"))
            & ~F.exists("exclude_titles", lambda t: F.contains(F.lower("title"), F.lower(t)))
        )
        .withColumn("title", F.coalesce(F.try_element_at("title_overrides", F.col("work_id")), F.col("title")))
        .drop("exclude_titles", "exclude_ids", "title_overrides")
    )
    once = first_by(candidates, ["master_id", "work_id"], "at")
    return once.withColumn("rank", F.row_number().over(W.partitionBy("master_id").orderBy("at", "work_id"))).filter(
        F.col("rank") <= cap
    )


def selection_report(seeds: DataFrame, selected: DataFrame) -> DataFrame:
    """Works kept per master and whether the master is dropped for having none."""
    counts = selected.groupBy("master_id").agg(F.count(F.lit(1)).alias("works"))
    return seeds.select(F.col("id").alias("master_id")).join(counts, "master_id", "left").select(
        "master_id",
        F.coalesce("works", F.lit(0).cast("long")).alias("works"),
        F.col("works").isNull().alias("dropped"),
    )


def dedupe_by_image(works: DataFrame) -> DataFrame:
    """First work per (master, image); a master without any simply has no row left."""
    return first_by(works, ["master_id", "image_url"])


def credit_match(candidates: DataFrame, seeds: DataFrame, limit: int = WORKS_CAP) -> DataFrame:
    """Found files that are the master's own works. ``seeds``: master_id, query, needle."""
    low = {c: F.lower(F.coalesce(c, F.lit(""))) for c in ("file_name", "categories")}
    credited = F.lower(strip_markup(F.coalesce("artist", F.lit(""))))
    needle, query = F.lower("needle"), F.lower("query")
    name = F.lower(F.trim(F.regexp_replace(F.coalesce("file_name", F.lit("")), r"^File:|\.[A-Za-z]{3,4}$", "")))
    backwards = F.array_join(F.reverse(F.split(query, r"\s+")), " ")

    def only_name(prefix: Column) -> Column:
        rest = F.regexp_replace(F.substr(name, F.length(prefix) + 1), r"^[\s\-–—,.]+", "")
        return F.startswith(name, prefix) & F.trim(rest).rlike(NAME_ONLY_REST)

    # the needle as a whole word after "portrait of", before any comma
    portrait = F.rlike(name, F.concat(F.lit(r"(?U)^\[?\s*portrait of [^,]*\b\Q"), needle, F.lit(r"\E\b")))

    mine = F.when(credited != "", F.contains(credited, needle)).otherwise(F.contains(low["file_name"], needle))
    kept = lookup_join(candidates, seeds, "master_id", spread_by=F.col("seq")).filter(
        mine
        & ~low["categories"].rlike(NON_WORK_CATEGORIES)
        & ~portrait
        & ~only_name(query)
        & ~only_name(backwards)
        & is_public_domain(F.col("licence"))
        & (F.coalesce("image_url", F.lit("")) != "")
    )
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("master_id").orderBy("seq"))).filter(
        F.col("rank") <= limit
    )


def work_facts(works: DataFrame) -> DataFrame:
    blank = F.lit("")
    return works.withColumns(
        {
            "key": F.concat(F.lit("work:"), work_id(F.col("source"), F.col("source_object_id"))),
            "facts_hash": facts_hash(
                F.lit("work"), F.coalesce("title", blank), F.coalesce("year", blank), F.coalesce("medium", blank)
            ),
        }
    )


def master_facts(seeds: DataFrame) -> DataFrame:
    none = F.lit("None")
    return seeds.withColumns(
        {
            "key": F.concat(F.lit("master:"), F.col("id")),
            "facts_hash": facts_hash(
                F.lit("master"), F.col("name"),
                F.coalesce(F.col("birth_year").cast("string"), none),
                F.coalesce(F.col("death_year").cast("string"), none),
            ),
        }
    )


def _tr_of(fields: dict[str, dict[str, str]]) -> Column:
    """locale -> field -> text out of the ``text`` struct; a missing text is empty."""
    entries = []
    for locale, names in fields.items():
        inner = []
        for field, source in names.items():
            inner += [F.lit(field), F.coalesce(F.col(f"text.{source}"), F.lit(""))]
        entries += [F.lit(locale), F.create_map(*inner)]
    return F.create_map(*entries)


def master_catalogue(seeds: DataFrame, selected: DataFrame, cache: DataFrame) -> DataFrame:
    """Masters with their ordered works and commentary; masters without works drop out.

    The list per master is bounded by the selection cap.
    """
    texts = first_by(cache.select("key", "facts_hash", "text", F.lit(0).alias("seq")), ["key", "facts_hash"]).drop("seq")
    works = (
        work_facts(selected)
        .join(texts, ["key", "facts_hash"], "left")
        .groupBy("master_id")
        .agg(
            F.collect_list(
                F.struct(
                    "rank", F.col("work_id").alias("id"), "title", "year", "medium", "image_url", "thumb_url", "source",
                    "source_url", "credit", F.coalesce("text.ko", F.lit("")).alias("commentary"),
                    F.coalesce("text.en", F.lit("")).alias("commentary_en"),
                    F.coalesce("text.ja", F.lit("")).alias("commentary_ja"),
                )
            ).alias("works")
        )
        .withColumn("works", F.array_sort("works"))
    )
    return (
        master_facts(seeds)
        .join(texts, ["key", "facts_hash"], "left")
        .join(works.withColumnRenamed("master_id", "id"), "id")
        .select(
            "id", "name", F.lit("ko").alias("lang"), "region", "nationality", "birth_year", "death_year",
            F.coalesce("text.ko_tagline", F.lit("")).alias("tagline"), F.coalesce("text.ko", F.lit("")).alias("bio"),
            "portrait_url",
            _tr_of({"en": {"tagline": "en_tagline", "bio": "en"}, "ja": {"tagline": "ja_tagline", "bio": "ja"}}).alias("tr"),
            "works",
        )
    )


def master_images(masters: DataFrame) -> DataFrame:
    """face: portrait, else the thumbnail of the first work with any image; hero: first work image, else portrait."""
    shown = F.get(
        F.filter("works", lambda w: (F.coalesce(w["thumb_url"], w["image_url"], F.lit("")) != "")), F.lit(0)
    )
    hero = F.get(F.filter("works", lambda w: F.coalesce(w["image_url"], F.lit("")) != ""), F.lit(0))
    return masters.withColumns(
        {
            "face": F.coalesce("portrait_url", shown["thumb_url"]),
            "hero": F.coalesce(hero["image_url"], "portrait_url"),
        }
    )


def sort_masters(masters: DataFrame, limit: int | None = None) -> DataFrame:
    """Masters by birth, unknown ones last, with their 1-based ``position``; ``limit`` is the preview's."""
    born = F.coalesce("birth_year", F.lit(UNKNOWN_BIRTH)).cast("long")
    years = masters.groupBy(born.alias("_year")).agg(F.count(F.lit(1)).alias("_n"))  # one row per year of birth
    before = W.orderBy("_year").rowsBetween(W.unboundedPreceding, -1)
    years = years.select("_year", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    here = F.row_number().over(W.partitionBy("_year").orderBy("seq"))
    placed = masters.withColumn("_year", born).join(years, "_year").withColumn("position", here + F.col("_base"))
    ordered = placed.drop("_year", "_base").orderBy("position")
    return ordered.limit(limit) if limit else ordered


def clean_search_title(title: Column) -> Column:
    out = F.regexp_replace(title, r"\([^)]*\)", " ")
    out = F.regexp_replace(out, r"(?i)\bfrom the series\b.*", " ")
    return clean_whitespace(F.regexp_replace(out, "[\"']", " "))


def rehost(works: DataFrame, candidates: DataFrame) -> DataFrame:
    """Point non-Commons works at the first public-domain candidate crediting the full artist name.

    ``works``: master_id, master_name, work_id, …; ``candidates``: work_id, seq and file facts.
    Works without a match drop out; Commons works stay as they are.
    """
    full = F.lower(F.trim(F.substring_index("master_name", "(", 1)))
    own = works.filter(F.col("source") == "wikimedia")
    other = works.filter(F.col("source") != "wikimedia")
    # The name test needs the work. Copies of a credit are first reduced to the earliest file
    # (map-side combined), so a work with very many candidates joins as its distinct credits.
    hay = F.lower(F.concat_ws(" ", F.coalesce("file_name", F.lit("")), F.coalesce("artist", F.lit(""))))
    file = F.struct("thumburl", F.coalesce("descriptionurl", "url").alias("page"))
    usable = (
        candidates.filter(F.contains("mime", F.lit("image")) & is_public_domain(F.col("licence")))
        .groupBy("work_id", hay.alias("hay"))
        .agg(F.min_by(file, "candidate_seq").alias("file"), F.min("candidate_seq").alias("at"))
    )
    picks = (
        other.select("work_id", full.alias("full"))
        .join(usable, "work_id")
        .filter(F.contains("hay", F.col("full")))
        .groupBy("work_id")
        .agg(F.min_by("file", "at").alias("pick"))
    )
    moved = other.join(picks, "work_id").withColumns(
        {
            "image_url": F.col("pick.thumburl"),
            "thumb_url": F.col("pick.thumburl"),
            "source": F.lit("wikimedia"),
            "source_url": F.col("pick.page"),
            "credit": F.lit(COMMONS_CREDIT),
        }
    )
    return own.unionByName(moved.drop("pick"))
