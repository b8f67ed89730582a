"""Work that must not be repeated for each mention of a value, and rows that must not meet in one task."""

from __future__ import annotations

import __spark_entry__ as entry
from pyspark.sql import functions as F

from listingmill.functions import dates, values
from listingmill.operators import enrich, resolve
from listingmill.schemas import empty
from listingmill.sources import extract
from listingmill.sources import testdata as td


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def query(spark, name):
    return entry.queries()[name](spark, entry.SMOKE_DIR)


def column(spark, fn) -> str:
    return plan(spark.createDataFrame([("x",)], "v string").select(fn(F.col("v")).alias("r")))


def test_price_lines_are_read_once_and_dealt(spark):
    assert column(spark, values.parse_price_table).count("regexp_extract_all(") == 1
    assert query(spark, "parse_price_table").rdd.getNumPartitions() == 4


def test_pages_are_searched_once(spark):
    assert column(spark, extract.paragraph_text).count("(?i)</p>") == 1
    labels = column(spark, lambda c: extract.label_fields(extract.label_table(c)))
    assert labels.count("</th>\\s*<td[^>]*>(.*?)</td>, 0)") == 1


def test_label_tables_keep_the_last_of_a_label(one):
    page = "<table><tr><th>주소</th><td>old</td></tr><tr><th>주소 |</th> <td>a &lt;b&gt;</td></tr><tr><th> </th><td>x</td></tr></table>"
    assert one([page, "<p>no table</p>", None], extract.label_table) == [{"주소": "a <b>"}, {}, None]
    assert one([page], lambda c: extract.label_fields(extract.label_table(c))) == [{"venue_address": "a <b>"}]


def test_feed_texts_are_searched_once_for_dates(spark, one):
    assert column(spark, dates.extract_date_range).count(f"{dates.DOTTED_SPAN}, 0)") == 1
    assert one(["x 2026. 5. 19 ~ 6. 1 y", "2026.2.30 ~ 3.1", "none", None], dates.extract_date_range) == ["2026.05.19~2026.06.01", None, None, None]


def test_translation_progress_is_counted_in_small_tasks_without_a_join(spark):
    job = "table string, id string, field string, locale string"
    jobs = spark.createDataFrame([("a", "1", "name", "en"), ("a", "1", "name", "ja"), ("a", "2", "name", "en"), ("a", None, "name", "en"), ("v", "1", "name", "ko")], job)
    rows = [("a", "1", "name", "en", False), ("a", "1", "name", "ja", True), ("a", "1", "name", "ja", False), ("a", "2", "name", "en", None), ("a", "2", "title", "en", False), ("a", None, "name", "en", False)]
    results = spark.createDataFrame(rows, f"{job}, failed boolean")
    seen = spark.createDataFrame([("a",), ("a",), ("v",), ("x",)], "table string")
    out = enrich.translation_progress(jobs, results, seen)
    text = plan(out)
    assert "RepartitionByExpression" in text and text.count("Join ") == 1  # that of the few tables
    got = {r.table: (r.rows_seen, r.rows_patched, r.fields_pending, r.fields_translated, r.errors, r.fields_remaining) for r in out.collect()}
    assert got == {"a": (2, 1, 5, 2, 1, 3), "v": (1, 0, 1, 0, 0, 1), "x": (1, 0, 0, 0, 0, 0)}


def test_listings_are_dealt_before_they_are_parsed(spark):
    assert td.raw_listings(spark, entry.SMOKE_DIR).rdd.getNumPartitions() == 4


def test_listings_are_normalised_in_methods_that_the_jvm_compiles(spark):
    """The JVM only interprets a method of more than 8,000 bytes, for every row."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        executed = query(spark, "normalize_listing")._jdf.queryExecution().executedPlan()
        stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(executed)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert sizes and max(sizes) < 8000


def test_date_texts_are_searched_once_and_split_without_compiling(spark):
    assert column(spark, dates.parse_date).count("(\\d{4})\\s*년") == 1
    df = spark.createDataFrame([("May 5 ~ Sept 9, 2026",), ("2026.5.1 ~ ",), (" ~ 2026.5.1",), ("2026.12.30 - 1.3",), ("2026.2.30 ~ 3.1",), ("5 may 2026",), (None,)], "v string")
    out = dates.with_date_range(df, F.col("v"))
    assert "split(" not in plan(out)
    got = {r.v: (str(r.start_date), str(r.end_date)) for r in out.collect()}
    assert got == {
        "May 5 ~ Sept 9, 2026": ("2026-05-05", "2026-09-09"), "2026.5.1 ~ ": ("2026-05-01", "None"), " ~ 2026.5.1": ("None", "2026-05-01"),
        "2026.12.30 - 1.3": ("2026-12-30", "2027-01-03"), "2026.2.30 ~ 3.1": ("None", "None"), "5 may 2026": ("2026-05-05", "2026-05-05"), None: ("None", "None"),
    }


def test_resolution_reads_its_listings_and_names_once(spark):
    for name in ("resolve_artists", "new_entities"):
        text = plan(query(spark, name))
        assert "o_orderkey" not in text and "ArrowEvalPython" not in text.split("Join")[0], name


def test_listings_of_one_number_keep_their_own_venues(spark):
    listing = "seq long, source string, artist_names array<string>, venue_name string, organizer_name string"
    rows = [(1, "pgi", ["Ann"], "Hall A", None), (1, "pgi", [], "Hall B", "Org"), (None, "koba", ["Bo"], "Hall C", None), (2, "koba", ["Cy"], None, None), (2, "koba", ["Cy"], None, None)]
    tables = [empty(spark, n) for n in ("artists", "venues", "organizers")]
    overrides = spark.createDataFrame([], "entity_type string, match_pattern string, canonical_id string, note string, seq long")
    out = resolve.resolve_listings(spark.createDataFrame(rows, listing), *tables, overrides)
    assert "venue_name" in out.columns and not [c for c in out.columns if c.startswith("_")]
    got = sorted((r.venue_name or "", r.venue_id != "", r.organizer_id == r.venue_id, len(r.artist_ids)) for r in out.collect())
    assert got == [("", False, True, 2), ("", False, True, 2), ("Hall A", True, True, 1), ("Hall B", True, False, 1), ("Hall C", True, True, 0)]


def test_a_batch_of_one_file_is_parsed_in_all_tasks(spark, monkeypatch, tmp_path):
    """The deliveries are written and parsed in all tasks, and each is still a micro-batch of its own."""
    from listingmill.registry import merging
    from listingmill.streaming import ingest_stream

    td.raw_listings(spark, entry.SMOKE_DIR).coalesce(1).write.parquet(f"{tmp_path}/one")
    raw = spark.read.parquet(f"{tmp_path}/one")
    wide = ingest_stream.spread(raw)
    assert raw.rdd.getNumPartitions() == 1 and wide.rdd.getNumPartitions() == 4 and wide.count() == raw.count()
    assert ingest_stream.spread(wide.repartition(7)).rdd.getNumPartitions() == 7
    seen = {}

    def stop(session, inbox, *_, files_per_batch):
        seen.update(files=len(session.read.parquet(inbox).inputFiles()), size=files_per_batch)
        raise InterruptedError

    monkeypatch.setattr(merging, "stream_ingest", stop)
    try:
        query(spark, "stream_ingest")
    except InterruptedError:
        pass
    assert seen == {"files": 8, "size": 4}
