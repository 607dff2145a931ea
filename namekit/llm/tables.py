"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from namekit.session import checkpoint_dir, ship_package


def table_path(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that no later job reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Rows of a table of known size in each of its files.
FILE_ROWS = 100_000


def written(rows: DataFrame, n: int | None = None) -> DataFrame:
    """``rows``, computed once, as a Parquet table under ``spark.checkpoint.dir``. It cuts the
    lineage like a checkpoint (which computes its last stage twice and is not compressed). ``n``: rows at most, where
    that is known; they are then written by as many tasks as they need, not one for each shuffle partition."""
    spark = rows.sparkSession
    if n is not None:
        rows = rows.coalesce(max(1, -(-n // FILE_ROWS)))
    path = table_path(spark)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def arrow_map(rows: DataFrame, function: Callable, schema) -> DataFrame:
    """``rows.mapInArrow`` with a function that uses this package on the executors."""
    ship_package(rows.sparkSession)
    return rows.mapInArrow(function, schema)
