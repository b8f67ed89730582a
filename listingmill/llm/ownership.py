"""Secret scan with corpus-wide ownership frequency.

Candidates are found by fixed patterns. A value is then judged by who holds it: its hash is counted by
distinct documents (repositories) and distinct sources (owners) over the whole corpus. A value that many
owners hold is a copied example; one that a single owner holds, and that looks random, is live.
Candidates without any key word (``bare``) become spans only if they are live in that sense.

All of it is built-in column functions. Counts are pre-aggregated by (value, owner, document) and then by
(value, owner), so a value that a third of the rows carry meets as one row for each owner. NULL texts have no
spans, a NULL source is an owner of its own, repeated rows count once, extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingmill.llm.common import boxed, left_by_row
from listingmill.session import materialize, shared_dir

ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
BARE = r"[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "bare")
#: From so many owners on a value is a copied example.
EXAMPLE_OWNERS = 3
PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|dummy|xxxx|1234567|(.)\1{5}"


def _spans(text: str, pattern: str, kind: str, value_group: int, least: int) -> Column:
    """array<struct(start, end, kind, value)> of the matches whose value has ``least`` characters.

    Spark's functions give no positions, but the gaps of a split by the same pattern and the matches
    themselves add up to them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if value_group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    rows = F.arrays_zip(found.alias("m"), values.alias("v"), F.split(text, pattern, -1).alias("g"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int, kind: string, value: string>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        at = acc.at + F.length(x.g)
        end = at + F.coalesce(F.length(x.m), F.lit(0))
        span = F.struct(at.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x.v.alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x.v) >= least, F.array_append(acc.out, span)).otherwise(acc.out).alias("out"))

    return F.when(F.col(text).rlike(pattern), F.aggregate(rows, start, add, lambda acc: acc.out)).otherwise(start.out)


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = lambda k: F.element_at(F.create_map(*[F.lit(x) for i, name in enumerate(KINDS) for x in (name, i)]), k)
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s.start.alias("start"), rank(s.kind).alias("r"), s.end.alias("end"), s.kind.alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, source, the hash of the text and the arrays ``base`` and ``bare``; written once, since both sides of the count read it."""
    df = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("t"))
    df = df.select(
        "doc_id", "source", F.xxhash64("t").alias("th"), _spans("t", ASSIGN, "assign", 2, 8).alias("a"), _spans("t", ACCESS, "access", 0, 16).alias("k"),
        _spans("t", HEX, "hex", 0, 32).alias("h"), _spans("t", BARE, "bare", 0, 24).alias("b"),
    )
    mixed = lambda s: s.value.rlike("[0-9]") & s.value.rlike("[A-Z]") & s.value.rlike("[a-z]")
    df = df.withColumn("base", F.concat("a", "k", "h"))
    free = lambda s: ~F.exists("base", lambda x: (x.start < s.end) & (s.start < x.end))
    out = df.select("doc_id", "source", "th", "base", F.filter("b", lambda s: mixed(s) & free(s)).alias("bare"))
    return materialize(out, shared_dir(docs.sparkSession, "secrets"))


def ownership(found: DataFrame) -> DataFrame:
    """vh (hash of a value), n_docs, n_owners over the whole corpus."""
    rows = found.select("doc_id", "source", F.explode(F.concat("base", "bare")).alias("s"))
    held = rows.select(F.xxhash64("s.value").alias("vh"), "source", "doc_id").distinct()
    per_owner = held.groupBy("vh", "source").agg(F.count(F.lit(1)).alias("n"))
    return per_owner.groupBy("vh").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_owners"))


def judged(found: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row for each span: doc_id, th, start, end, kind, value, n_docs, n_owners, verdict (live, shared, example)."""
    spans = found.select("doc_id", "th", F.explode(F.concat("base", "bare")).alias("s")).select("doc_id", "th", "s.*").distinct()
    spans = spans.withColumn("vh", F.xxhash64("value")).join(ownership(found), "vh").drop("vh")
    verdict = (
        F.when((F.col("n_owners") >= example_owners) | F.col("value").rlike(PLACEHOLDER), "example").when(F.col("n_owners") == 1, "live").otherwise("shared")
    )
    return spans.withColumn("verdict", verdict).filter((F.col("kind") != "bare") | (F.col("verdict") == "live"))


def scan(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with its base spans and its judged ``found`` spans (array of struct)."""
    found = candidates(docs)
    per_doc = judged(found).groupBy("doc_id", "th").agg(
        F.collect_list(F.struct("start", "end", "kind", "value", "n_docs", "n_owners", "verdict")).alias("found")
    )
    return left_by_row(found, per_doc).select("doc_id", "source", "th", "base", "found")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    empty = F.array().cast("array<struct<start: int, end: int, kind: string, value: string, n_docs: bigint, n_owners: bigint, verdict: string>>")
    rows = scan(docs).withColumn("found", F.coalesce("found", empty))
    number = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")
    verdicts = lambda v: F.size(F.filter("found", lambda s: s.verdict == v)).cast("long")
    return rows.select(
        "doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"),
        verdicts("live").alias("n_live"), verdicts("shared").alias("n_shared"), verdicts("example").alias("n_example"),
    )


def redact(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with every span that is not a copied example replaced by ``mark``; overlapping spans become one mark.

    Rows without such spans come back unchanged. ``n_chars`` follows the new text.
    """
    hit = judged(candidates(docs)).filter(F.col("verdict") != "example")
    per_doc = hit.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cut"))
    text = F.col("_row.text")
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        between = F.substring(text, acc.at + 1, s.start - acc.at)
        return F.struct(
            F.greatest(acc.at, s.end).alias("at"), F.when(s.start < acc.at, acc.out).otherwise(F.concat(acc.out, between, F.lit(mark))).alias("out")
        )

    cleaned = F.aggregate("cut", first, add, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))))
    out = left_by_row(boxed(docs), per_doc).withColumn("_new", F.when(F.col("cut").isNotNull(), cleaned).otherwise(text))
    size = F.when(F.col("cut").isNotNull(), F.length("_new").cast(dict(docs.dtypes).get("n_chars", "int")))
    changed = {"text": F.col("_new"), "n_chars": F.coalesce(size, F.col("_row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[(changed[c] if c in changed else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def _sql() -> str:
    def found(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
        p = pattern.replace("'", "''")
        return f"""SELECT r, '{kind}' AS kind, {rank} AS k, {least} AS least, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v,
          string_split_regex(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}')"""

    kinds = ((ASSIGN, 2, 8), (ACCESS, 0, 16), (HEX, 0, 32), (BARE, 0, 24))
    every = "\n UNION ALL ".join(found(KINDS[i], i, *kind) for i, kind in enumerate(kinds))
    # RE2 has no back reference: the same character six times, for every character of a value.
    same = "|".join(f"[{c}]{{6}}" for c in "abcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    placeholder = PLACEHOLDER.replace(r"(.)\1{5}", same)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
m AS ({every}),
u AS (SELECT r, kind, k, least, unnest(m) AS m, unnest(v) AS v, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i FROM m),
p AS (SELECT r, kind, k, least, v, length(m) AS n, CAST(sum(length(g) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS e FROM u),
s AS (SELECT r, kind, k, v, e - n AS a, e FROM p WHERE length(v) >= least),
free AS (SELECT * FROM s WHERE k < 3 UNION ALL SELECT * FROM s WHERE k = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')
  AND NOT EXISTS (SELECT 1 FROM s b WHERE b.r = s.r AND b.k < 3 AND b.a < s.e AND s.a < b.e)),
own AS (SELECT v, count(DISTINCT coalesce(source, chr(1))) AS n FROM free JOIN d USING (r) GROUP BY v),
j AS (SELECT *, CASE WHEN n >= {EXAMPLE_OWNERS} OR regexp_matches(v, '{placeholder}') THEN 'example' WHEN n = 1 THEN 'live' ELSE 'shared' END AS verdict FROM free JOIN own USING (v)),
x AS (SELECT r, count(*) FILTER (k = 0) AS na, count(*) FILTER (k = 1) AS nk, count(*) FILTER (k = 2) AS nh,
  string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, k) FILTER (k < 3) AS base,
  string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, k) FILTER (k < 3 OR verdict = 'live') AS spans,
  count(*) FILTER (verdict = 'live') AS nl, count(*) FILTER (verdict = 'shared' AND k < 3) AS ns, count(*) FILTER (verdict = 'example' AND k < 3) AS ne FROM j GROUP BY r)
SELECT doc_id, coalesce(na, 0) AS n_assign, coalesce(nk, 0) AS n_access, coalesce(nh, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(nl, 0) AS n_live, coalesce(ns, 0) AS n_shared, coalesce(ne, 0) AS n_example FROM d LEFT JOIN x USING (r)
"""


SQL = _sql()
