"""Session settings the library relies on, and where intermediate tables may live."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and bench. A cluster brings its own; AQE stays on in both."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("listingmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


@functools.cache
def _fallback_dir() -> str:
    return tempfile.mkdtemp(prefix="listingmill-")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    A private folder serves only a local session without that setting (tests); a cluster must name one that all its machines share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = _fallback_dir()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write once to the shared folder and read back: lineage is cut, a lost executor costs a re-read.

    Unlike ``checkpoint()`` the plan runs once, and the copy is columnar.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(steps: dict[str, Callable]) -> dict:
    """Results of independent steps that each start Spark jobs, side by side: small jobs fill the cluster between them."""
    with ThreadPoolExecutor(max(1, len(steps))) as pool:
        started = {name: pool.submit(step) for name, step in steps.items()}
        return {name: future.result() for name, future in started.items()}
