"""Line dedup over levelled sorted runs of line hashes.

A run is a table bucketed and sorted by the 128-bit hash of a line's key: how many documents of its batches hold the key, and,
where no earlier run had the key, the largest doc_id among them. Batches are ranges of doc_id in falling order. The keys of a new
batch are anti-joined with the runs: what no run holds is new, and since later batches have smaller ids only, its largest id is the
one of the whole table; the batch's own keys are then added as a run of level 0. ``FAN`` runs of a level are compacted into one
of the next, so a batch meets few runs. Runs of one bucketing join and compact bucket by bucket, without a shuffle of the old runs.

``LineRuns`` is the incremental operator; ``dedup`` runs it over a table and drops the lines: keys of ``LEAST_CHARS`` code points
or more that ``LEAST_DOCS`` documents or more hold lose all their lines but those of the largest doc_id.

All of it is DataFrame work. A key in a third of all documents is one row a task before it is shuffled, and one row a batch in
the runs; where its lines meet the decision, the key is salted (or the decisions broadcast, if Spark finds them small).
The hashes of a document's dropped lines come back as positions, a list no longer than its lines.

A key is the line without ASCII white space at both ends and A-Z in lower case. NULL and empty texts are one empty line; repeated
rows are one document as far as keys are counted (documents are told apart by doc_id, all NULL ids are one document, the smallest),
and each keeps its own result row. If several texts share the largest doc_id, all keep their lines. Extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listingmill.operators.joins import lookup_join
from listingmill.session import materialize, shared_dir

LEAST_CHARS = 40
LEAST_DOCS = 5
BATCHES = 4
FAN = 2
#: doc_id of rows without one, below all others.
NO_ID = -(1 << 63)
_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(text: Column) -> Column:
    """A-Z in lower case; ``lower`` would change other letters, so it serves ASCII texts only."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc, th (id and hash of the text) and pos, h of every line whose key is long enough."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(_doc_id().alias("doc"), F.xxhash64(text).alias("th"), fold(text).alias("t")).filter(F.length("t") >= LEAST_CHARS)
    keys = F.transform(F.split("t", "\n"), lambda line, i: F.struct(i.alias("pos"), F.btrim(line, F.lit(_BLANK)).alias("key")))
    long = rows.select("doc", "th", F.explode(F.filter(keys, lambda k: F.length(k.key) >= LEAST_CHARS)).alias("k"))
    return long.select("doc", "th", "k.pos", F.unhex(F.md5(F.col("k.key").cast("binary"))).alias("h"))


def _doc_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


class LineRuns:
    """The runs of one table of lines, below one folder. Batches must come in falling order of doc_id and share no id."""

    def __init__(self, spark: SparkSession, folder: str, fan: int = FAN, buckets: int | None = None):
        self.spark, self.folder, self.fan = spark, folder, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame, level: int) -> str:
        """One more table, bucketed and sorted by h; a rewrite by a repeated task replaces the file of its bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{self.folder}/level-{level}/{name}"
        rows.write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").option("path", path).saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch of (doc, h) rows; returns h, n_docs and top of its keys, top being NULL where an earlier batch has the key."""
        each = lines.groupBy("h", "doc").agg(F.lit(1).alias("one"))
        own = each.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("top"))
        if runs := self.runs():
            own = materialize(own, f"{self.folder}/batch-{uuid.uuid4().hex}")
            fresh = own
            for run in runs:
                fresh = fresh.join(run.select("h"), "h", "left_anti")
            known = own.join(fresh.select("h"), "h", "left_anti").withColumn("top", F.lit(None).cast("long"))
            own = fresh.unionByName(known)
        self._push(self._write(own, 0), 0)
        return own

    def _push(self, name: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fan:
            merged = self._write(self._merged([self.spark.table(n) for n in self.levels[level]]), level + 1)
            self.levels[level] = []
            self._push(merged, level + 1)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Merge join of sorted runs: counts added, the one ``top`` of a key kept.

        Not a union: Spark takes one of bucketed scans for partitioned by the bucket's key and would aggregate it without a shuffle.
        """
        whole = runs[0]
        for run in runs[1:]:
            other = run.select("h", F.col("n_docs").alias("_n"), F.col("top").alias("_top"))
            both = F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))
            whole = whole.join(other, "h", "full").select("h", both.alias("n_docs"), F.greatest("top", "_top").alias("top"))
        return whole

    def totals(self) -> DataFrame:
        """h, n_docs and top over all batches."""
        return self._merged(self.runs())


def frequent(lines: DataFrame, batches: int = BATCHES, fan: int = FAN, least_docs: int = LEAST_DOCS) -> DataFrame:
    """h and top of the keys that ``least_docs`` documents or more hold. ``lines`` is read once for each batch, so it should be stored."""
    spark = lines.sparkSession
    cuts = lines.agg(F.percentile_approx("doc", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    edges = sorted(set(cuts), reverse=True)
    runs = LineRuns(spark, shared_dir(spark, "line-runs"), fan)
    for k in range(len(edges) + 1):
        part = lines
        if k > 0:
            part = part.filter(F.col("doc") <= edges[k - 1])
        if k < len(edges):
            part = part.filter(F.col("doc") > edges[k])
        runs.add(part.select("h", "doc"))
    return runs.totals().filter(F.col("n_docs") >= least_docs).select("h", "top")


def dropped_lines(docs: DataFrame, batches: int = BATCHES, fan: int = FAN, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc, th and ``gone``, the positions of the lines to drop, of each document that loses one."""
    lines = materialize(lines_of(docs), shared_dir(docs.sparkSession, "lines"))
    keys = materialize(frequent(lines, batches, fan, least_docs), shared_dir(docs.sparkSession, "frequent-lines"))
    hit = lookup_join(lines, keys, "h", F.struct("doc", "pos")).filter(F.col("doc") < F.col("top"))
    return hit.groupBy("doc", "th").agg(F.collect_set("pos").alias("gone"))


def dedup(docs: DataFrame, batches: int = BATCHES, fan: int = FAN, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and ``kept``, the text without the dropped lines, one row for each row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), _doc_id().alias("doc"), F.xxhash64(text).alias("th"))
    gone = materialize(dropped_lines(docs, batches, fan, least_docs), shared_dir(docs.sparkSession, "dropped-lines"))
    # Only texts that lose a line are cut; the others go through as they are.
    cut = rows.join(gone, ["doc", "th"], "left").withColumn("lines", F.when(F.col("gone").isNotNull(), F.split("text", "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    return cut.select(
        "doc_id",
        (breaks + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS line, trim(translate(ls[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
f AS (SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT r, doc_id, i, line, top IS NOT NULL AND doc_id < top AS gone FROM l LEFT JOIN f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
