"""Joins of a large table with a lookup that holds one row for each key.

A lookup that grows with the data is joined plainly: a copy for each salt would be broadcast by the size of the lookup alone, since
the optimiser's estimate doesn't count the copies. Where such a table has no copies but its rows are many more bytes than its file
(``shuffled``), it must not be broadcast either. ``lookup_join`` is for lookups of few rows whose keys hold many of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32
#: Rows of a table that may pass through the driver.
FEW = 1 << 18


def shuffled(growing: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: joined by a shuffle, never broadcast.

    The optimiser judges by the bytes of the file and the width of the types. Columns of a well compressed file, rows that an
    explode repeats and nested values are many times that in memory, and a broadcast passes through the driver whole.
    """
    return growing.hint("merge")


def unless_few(written: DataFrame) -> DataFrame:
    """``shuffled``, unless the table, one that has been written, has few rows."""
    return shuffled(written) if written.count() > FEW else written


def lookup_join(big: DataFrame, small: DataFrame, key: str, spread_by: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join on ``key``, one lookup row per key.

    For lookups of few rows only, such as masters or hosts: each lookup row is repeated per salt and the big side spreads by ``spread_by``, so a key with most of the rows is
    split; the salt also keeps a later aggregate on ``key`` from reusing the skewed partitioning. Nothing is hinted: the optimiser
    broadcasts the lookup where its bytes are below the session's threshold, and then the big side never shuffles.
    """
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    return spread.join(salted, [key, "_salt"], how).drop("_salt")
