"""Benchmark decontamination as a prefix-filtered set join.

An item's windows (13 consecutive words, or all words of a shorter item) are sets of word shingles. A
document that holds a window holds all its shingles, so the rarest one is a sufficient prefix: shingle
frequencies are counted over the whole corpus, every window is keyed by its rarest shingle, windows with a
shingle that occurs nowhere are dropped, and only documents' shingles equal to a key become candidates. The
shingle's offset fixes where the window would lie (positional bound), which must fit into the document (length
bound), and the words are then compared one by one, so hash collisions change nothing.

All of it is built-in functions. In the usual plan the words of a document stay in one code-generated stage from
the scan to the comparison: nothing but verified hits is shuffled. That plan broadcasts the item windows, after
their size is measured; beyond ``BROADCAST_BYTES`` the keys meet by a shuffle of (document, position, key) and
only candidate documents are read again.

NULL texts have no words, items without words no windows; repeated rows give repeated results; items with a NULL
id count for hits but have no name. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingmill.llm.common import boxed, left_by_row
from listingmill.session import materialize, shared_dir

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SHINGLE = 3
BROADCAST_BYTES = 32 << 20


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts of one-byte characters take the quick way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def words(text: str = "text") -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def _keys(w: str, width: int) -> Column:
    """The hash of every run of ``width`` words, by position."""
    run = F.transform(w, lambda x, i: F.xxhash64(F.lit(width), x, *[F.get(w, i + k) for k in range(1, width)]))
    return F.slice(run, 1, F.greatest(F.size(w) - (width - 1), F.lit(0)))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: wid, win (words), width of its shingles, ids of the items that hold it."""
    df = items.select("item_id", words().alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    df = df.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, window))).alias("win"))
    df = df.groupBy("win").agg(F.collect_set("item_id").alias("ids"))
    return df.select(F.xxhash64("win").alias("wid"), "win", "ids", F.least(F.size("win"), F.lit(SHINGLE)).alias("width"))


def _shingles(windows: DataFrame, width: int) -> DataFrame:
    return windows.filter(F.col("width") == width).select("wid", "win", "ids", F.posexplode(_keys("win", width)).alias("off", "k"))


def _frequencies(docs: DataFrame, keys: DataFrame, width: int, small: bool) -> DataFrame:
    """k, n: occurrences in the whole corpus of every shingle of the items."""
    found = docs.select(words().alias("w")).select(F.explode(_keys("w", width)).alias("k"))
    return found.join(F.broadcast(keys) if small else keys, "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def prefixes(docs: DataFrame, windows: DataFrame, width: int, small: bool) -> DataFrame:
    """k, off, win, ids: every window that can occur under its rarest shingle."""
    rows = _shingles(windows, width)
    counts = _frequencies(docs, rows.select("k").distinct(), width, small)
    rarest = (
        rows.join(counts, "k", "left")
        .groupBy("win")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("off"), F.col("k"))).alias("p"), F.first("ids").alias("ids"))
    )
    return rarest.filter(F.col("p.n") > 0).select(F.col("p.k").alias("k"), F.col("p.off").alias("off"), "win", "ids")


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), words().alias("w"))


def hits(docs: DataFrame, windows: DataFrame, widths: list[int], small: bool) -> DataFrame:
    """doc_id, th, n_words, start, len, ids: every occurrence of a window, and one row without start for every document."""
    out = None
    for number, width in enumerate(widths or [SHINGLE]):
        keyed = materialize(prefixes(docs, windows, width, small), shared_dir(docs.sparkSession, "prefixes"))
        tagged = _tagged(docs)
        # Element 0 is a marker that keeps documents without a candidate; it is made once.
        marker = F.array(F.lit(None).cast("long")) if number == 0 else F.array().cast("array<bigint>")
        shift = 1 if number == 0 else 0
        listed = F.concat(marker, _keys("w", width))
        start = F.col("pos") - F.col("off")
        fits = (start >= 0) & (start + F.size("win") <= F.size("w"))
        exact = F.slice("w", start + 1, F.size("win")) == F.col("win")
        rows = tagged.select("doc_id", "th", "w", F.posexplode(listed).alias("at", "k")).withColumn("pos", F.col("at") - shift)
        if small:
            found = rows.join(F.broadcast(keyed), "k", "left" if shift else "inner")
        else:
            pairs = rows.select("doc_id", "th", "k", "pos").join(keyed, "k", "left" if shift else "inner").drop("k")
            # Repeated rows would pair with each other: one stands for all of them.
            found = left_by_row(pairs, tagged.dropDuplicates(["doc_id", "th"]), "inner")
        # `when` guards the comparison, since slice() refuses a start of 0.
        hit = F.when(F.col("win").isNotNull() & fits, F.when(fits, exact)).otherwise(F.lit(False))
        keep = hit | (F.col("pos") < 0) if shift else hit
        rows = found.filter(keep).select(
            "doc_id", "th", F.size("w").cast("long").alias("n_words"),
            F.when(F.col("win").isNotNull(), start).alias("start"), F.size("win").alias("len"), "ids",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, th, copies, n_words, n_hit and the sorted ids of items that occur; equal rows of ``docs`` are one row with their number."""
    windows = materialize(item_windows(items, window), shared_dir(docs.sparkSession, "windows"))
    size = windows.agg(
        F.coalesce(F.sum(F.size("win") * (F.octet_length(F.array_join("win", "")) + 64) + 16 * F.size("ids")), F.lit(0)).alias("b"),
        F.collect_set("width").alias("widths"),
    ).first()
    rows = hits(docs, windows, sorted(size["widths"]), size["b"] <= broadcast_bytes)
    spots = F.array_distinct(F.flatten(F.transform("at", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))
    return rows.groupBy("doc_id", "th").agg(
        F.sum(F.when(F.col("start").isNull(), 1).otherwise(0)).alias("copies"),
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "len"))).alias("at"),
        F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"),
    ).select(
        "doc_id", "th", "copies", "n_words", F.size(spots).cast("long").alias("n_hit"),
        F.sort_array(F.transform("ids", lambda i: i.cast("string"))).alias("items"),
    )


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The columns of the registered query, one row for each row of ``docs``."""
    rows = contamination(docs, items).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("copies", F.lit(1).cast("long")))))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated documents."""
    bad = contamination(docs, items).filter(contaminated()).select("doc_id", "th")
    return left_by_row(boxed(docs), bad, "left_anti").select("_row.*")


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_W} AS w FROM documents),
i AS (SELECT item_id, {_W} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, list_slice(w, s, s + 12) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM iw),
dw AS (SELECT r, s, n, list_slice(w, s, s + n - 1) AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes)),
h AS (SELECT r, s, n, item_id FROM dw JOIN iw USING (win)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN it USING (r)
"""
