"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One run of anything but ASCII white space, for Java and for RE2 patterns alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_of_id(col: str = "doc_id") -> Column:
    """Unsigned crc32 of the id as decimal text; NULL ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def raw_texts(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column, row by row, without making Python strings."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py()


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut a run of rows where the summed lengths pass ``most``; a longer row stands alone."""
    start = total = 0
    for at, n in enumerate(lengths):
        if at > start and total + n > most:
            yield start, at
            start, total = at, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def boxed(docs: DataFrame) -> DataFrame:
    """doc_id, th (the hash of the text) and the whole row as ``_row``, so that no name of the table meets a stage's own."""
    return docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))


def left_by_row(rows: DataFrame, other: DataFrame, how: str = "left") -> DataFrame:
    """Join on (doc_id, th), the id and the hash of the text: NULL ids meet each other, and the keys come back once."""
    renamed = other.withColumnsRenamed({"doc_id": "_doc_id", "th": "_th"})
    same = (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    joined = rows.join(renamed, same, how)
    return joined if how == "left_anti" else joined.drop("_doc_id", "_th")
