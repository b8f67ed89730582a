"""Sharding along a Hilbert curve.

Metadata dimensions are quantised to a few bits each, the cell of a row gets its index on the Hilbert
curve, rows are ordered by that index, and runs of equal length become the shards. Neighbouring cells
share a shard, so per-shard minima and maxima of every dimension stay narrow and a reader that filters
on any of them skips most files.

Positions are exact without a window over the table: cells are counted (their number is bounded by the
bits), every cell is split by a hash into ``splits`` parts that grow with the rows, and rows are
numbered inside a part. A cell with a third of all rows is thus many parts. The law is ``rows``: shard
sizes differ by at most one.

NULL dimensions fall into the first cell of their axis, NULL texts count 8 bytes. Rows that agree in
every column are numbered in any order among themselves. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BITS = 5
SHARDS = 24
#: Rows that one numbering window should see.
PART_ROWS = 1 << 18


def hashed_axis(col: str, bits: int = BITS) -> Column:
    """A category as a number below 2**bits: equal values share a cell, NULL is cell 0."""
    return F.when(F.col(col).isNull(), 0).otherwise(F.crc32(F.col(col).cast("string").cast("binary")) % (1 << bits)).cast("int")


def log_axis(value: Column, bits: int = BITS) -> Column:
    """A size on a scale of powers of two, NULL and 0 in cell 0."""
    return F.least(F.length(F.bin(F.coalesce(value, F.lit(0)).cast("long"))), F.lit((1 << bits) - 1)).cast("int")


def curve_index(axes: list[str], bits: int = BITS) -> Column:
    """The Hilbert index of integer columns ``axes`` below 2**bits.

    The axes are turned into the transposed index level by level (complement or exchange of the low bits), Gray-decoded, and
    their bits interleaved. The levels are a fold over an array, so the expression stays small.
    """
    n = len(axes)
    steps = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(i).alias("axis")) for level in range(bits - 1, 0, -1) for i in range(n)])

    def fold(x: Column, step: Column) -> Column:
        mask = F.element_at(F.array(*[F.lit((1 << k) - 1) for k in range(bits)]), step.level + 1)
        first, own = F.get(x, F.lit(0)), F.get(x, step.axis)
        on = own.bitwiseAND(mask + 1) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(mask)
        changed = F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(swap)).when(j == step.axis, v.bitwiseXOR(swap)).otherwise(v))
        flipped = F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(mask)).otherwise(v))
        return F.when(on, flipped).otherwise(changed)

    start = F.array(*[F.col(a).cast("int") for a in axes])
    folded = F.aggregate(steps, start, fold)
    none = F.array().cast("array<int>")
    grey = F.aggregate(folded, none, lambda acc, v: F.array_append(acc, v.bitwiseXOR(F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), acc), -1), F.lit(0)))))
    levels = F.array(*[F.lit(k) for k in range(bits - 1, 0, -1)])

    def finish(x: Column) -> Column:
        def flip(t: Column, level: Column) -> Column:
            mask = F.element_at(F.array(*[F.lit((1 << k) - 1) for k in range(bits)]), level + 1)
            return F.when(F.element_at(x, -1).bitwiseAND(mask + 1) != 0, t.bitwiseXOR(mask)).otherwise(t)

        return F.transform(x, lambda v: v.bitwiseXOR(F.aggregate(levels, F.lit(0), flip)))

    # A one-element fold binds the decoded axes, so that they are computed once.
    turned = F.element_at(F.transform(F.array(grey), finish), 1)
    picks = F.array(*[F.struct(F.lit(1 << k).alias("bit"), F.lit(i).alias("axis")) for k in range(bits - 1, -1, -1) for i in range(n)])
    interleave = lambda x: F.aggregate(
        picks, F.lit(0), lambda acc, p: acc * 2 + F.when(F.get(x, p.axis).bitwiseAND(p.bit) != 0, 1).otherwise(0)
    )
    return F.element_at(F.transform(F.array(turned), interleave), 1)


def runs(df: DataFrame, cell: str, ties: list[str], shards: int = SHARDS, part_rows: int = PART_ROWS) -> DataFrame:
    """Add ``shard`` and ``slot``: equal runs along (cell, hash part, ties), shards at most one row apart."""
    total = df.count()
    splits = 1 << max(0, (total // part_rows).bit_length())
    tagged = df.withColumn("_part", F.pmod(F.xxhash64(*ties), F.lit(splits)).cast("int"))
    parts = tagged.groupBy(cell, "_part").agg(F.count(F.lit(1)).alias("_n"))
    cells = parts.groupBy(cell).agg(F.sum("_n").alias("_cn"))  # at most 2 ** (axes * bits) rows
    before = W.orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(cell, F.coalesce(F.sum("_cn").over(before), F.lit(0)).alias("_cbase"))
    inner = W.partitionBy(cell).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_pbase", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
    bases = parts.join(cells, cell).select(cell, "_part", (F.col("_cbase") + F.col("_pbase")).alias("_base"))
    here = W.partitionBy(cell, "_part").orderBy(*ties)
    ranked = tagged.join(bases, [cell, "_part"]).withColumn("_rank", F.row_number().over(here) - 1 + F.col("_base"))
    shard = F.expr(f"(_rank * {shards}) div {max(total, 1)}")
    return (
        ranked.withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("_rank") - F.expr(f"(cast(shard as bigint) * {max(total, 1)} + {shards - 1}) div {shards}"))
        .drop("_part", "_base", "_rank")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the cell on the curve of source, lang and size."""
    binary = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", (F.octet_length(binary) + 8).cast("long").alias("size"), F.crc32(binary).alias("text_crc32"),
        hashed_axis("source").alias("_source"), hashed_axis("lang").alias("_lang"),
    )
    rows = rows.withColumn("_size", log_axis(F.col("size")))
    rows = rows.withColumn("cell", curve_index(["_source", "_lang", "_size"]))
    placed = runs(rows.drop("_source", "_lang", "_size"), "cell", ["doc_id", "text_crc32", "size"], shards, part_rows)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell"
    )
