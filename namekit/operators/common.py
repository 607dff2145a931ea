"""Helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a broadcast side, measured uncompressed, at most. Beyond it a plain join is planned, which Spark may
#: still split where keys are skewed.
MAX_BROADCAST_BYTES = 32 << 20


def materialize(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: computed once, and of known size in later plans. With
    ``rows_per_file`` a task's rows go to as many files, which other tasks then read."""
    import uuid

    from ..session import checkpoint_dir
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/part-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured_side(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The small side of a join (per-language statistics, a caller's lookup), computed once and broadcast if its
    rows have at most ``max_bytes``. One job computes it, one reads its size; neither touches the big side."""
    side = materialize(df)
    size = side.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(side) if size <= max_bytes else side


def with_global(df: DataFrame, key: str, aggs: list, label: str = "global") -> DataFrame:
    """Per-``key`` aggregates plus one ``global`` row in a single GROUPING
    SETS ((key), ()) aggregate (ROLLUP on one column)."""
    g = df.rollup(key).agg(*aggs, F.grouping_id().alias("_gid"))
    return (g.withColumn(key, F.when(F.col("_gid") == 1, F.lit(label)).otherwise(F.col(key)))
            .drop("_gid"))
