"""Quality rules as a bitmask ledger.

Every document is measured once, every rule evaluated once, and the failures are stored as bits next
to the measurements. A policy is a versioned mask over those bits: applying one, comparing two, or
asking what a rule removes on its own are bitwise expressions over the ledger, without touching a text.

All of it is built-in column functions. NULL texts have no words and fail as too short. Repeated rows
give repeated ledger rows, and extra columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingmill.llm.common import WORD

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``failed`` is a SQL condition over the measurements; ``bit`` never changes once given."""

    bit: int
    name: str
    failed: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "many_words", "n_words > 1000000"),
    Rule(3, "short_words", "word_chars < 2 * n_words"),
    Rule(4, "long_words", "word_chars > 20 * n_words"),
    Rule(5, "symbols", "2 * n_symbols > n_words"),
    Rule(6, "repeated_lines", "2 * n_dup_lines > n_lines"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(r.mask for r in RULES if r.name in self.rules)


POLICIES = (
    Policy("base", ("few_words", "repeated_windows")),
    Policy("v1", ("few_words", "repeated_windows", "many_words", "short_words", "long_words", "symbols", "repeated_lines")),
)
BASE, CURRENT = POLICIES


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements, one row for each input row.

    Repeated windows are found inside the row: the hashes of all 3-word windows are sorted with their
    positions only where one occurs twice, equal neighbours are kept, and the positions they cover are
    counted once each.
    """
    text = F.coalesce("text", F.lit(""))
    step = docs.select("doc_id", text.alias("t")).select(
        "doc_id",
        F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"),
        F.length(F.regexp_replace("t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
    )
    step = step.select(
        "doc_id",
        "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.slice(
            F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))), 1, F.greatest(F.size("w") - 2, F.lit(0))
        ).alias("h"),
    )
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    none = F.lit(None).cast("array<struct<h: bigint, i: int>>")
    step = step.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs).otherwise(none)).drop("h")
    twice = F.filter("s", lambda x, k: (x.h == F.get("s", k + 1).h) | ((k > 0) & (x.h == F.get("s", F.greatest(k - 1, F.lit(0))).h)))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x.i, x.i + 1, x.i + 2))))
    return step.withColumn("n_repeat_words", F.coalesce(F.when(F.col("s").isNotNull(), F.size(covered)), F.lit(0)).cast("long")).drop("s")


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements with ``failed_bits``: bit b is set where rule b fails."""
    bits: Column = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.failed), F.lit(rule.mask).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured(docs).withColumn("failed_bits", bits)


def passes(policy: Policy, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger rows with ``kept`` under the policy."""
    return rows.withColumn("kept", passes(policy))


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """One row for each rule of the policy: how many rows fail it, how many fail nothing else, how many pass without it.

    One narrow aggregate over the bits: rows are counted by mask first, so the rest works on at most 2**rules rows.
    """
    masks = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    listed = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.mask).cast("long").alias("b")) for r in RULES if r.name in policy.rules])
    per_rule = masks.select("m", "n", F.explode(listed).alias("r"))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    return per_rule.groupBy(F.lit(policy.version).alias("version"), F.col("r.rule").alias("rule")).agg(
        count(F.col("m").bitwiseAND(F.col("r.b")) != 0).alias("n_failed"),
        count(F.col("m") == F.col("r.b")).alias("n_failed_alone"),
        count(F.col("m").bitwiseAND(F.bitwise_not("r.b")) == 0).alias("n_kept_without"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    rows = ledger(docs).withColumn("base_failed", ~passes(BASE))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & passes(CURRENT)).alias("kept"), "n_lines", "failed_bits", F.lit(CURRENT.version).alias("policy"),
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, i, list_slice(w, i, i + 2) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (n_words > 1000000)::INT + 8 * (word_chars < 2 * n_words)::INT
  + 16 * (word_chars > 20 * n_words)::INT + 32 * (2 * n_symbols > n_words)::INT + 64 * (2 * n_dup_lines > n_lines)::INT AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, n_lines, failed_bits,
  'v1' AS policy FROM b
"""
