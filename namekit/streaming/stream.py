"""Streaming ingestion of dump shards (S1) and running language counts.

S1: new dump shards arrive as text files; each micro-batch is parsed with the
same column functions as the batch path (A5, B1), gets the types of its classes (B9, B15) and is written to a folder of
its own; the manifest (``snapshots``) then names it. The entity table is the latest version per id, i.e. an upsert
(B17) that never rewrites old files; ``compact_entities`` folds the batches into one snapshot. A replayed batch
is already named and changes nothing. S2: a stateful ``groupBy(language, type).count()``; the state has one row per
(language, type), so no watermark is needed. Every result is a new version. Both use checkpointed queries
and ``availableNow`` in tests.
"""

from __future__ import annotations

import functools
import uuid
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import kb as B
from ..operators.common import materialize, measured_side
from ..sources import dump as DU
from .snapshots import read_manifest, remove, replace_manifest

NAME_SCHEMA = T.StructType([T.StructField(c, T.StringType())
                            for c in ("wikidata_id", "eng", "alias", "language", "type")])


def _with_types(entities: DataFrame, closure: DataFrame | None) -> DataFrame:
    """Entities with ``types``: those of their classes; empty without a class in the closure. ``_row``, if they have it,
    numbers the rows of a table; else they are written to have one, as only their numbers go to the classes."""
    none = F.array().cast("array<string>")
    if closure is None:
        return entities.withColumn("types", none)
    rows = entities if "_row" in entities.columns else materialize(entities.withColumn("_row", F.monotonically_increasing_id()))
    of_class = measured_side(closure.groupBy("class").agg(F.collect_set("type").alias("_types")))
    each = rows.select("_row", F.explode("instance_of").alias("class")).join(of_class, "class")
    types = each.groupBy("_row").agg(F.array_distinct(F.flatten(F.collect_set("_types"))).alias("types"))
    fields = [c for c in rows.columns if c != "_row"]
    return rows.join(types, "_row", "left").select(*fields, F.coalesce("types", none).alias("types"))


def _ingested(state: dict, batch_id: int) -> bool:
    return batch_id <= state.get("upto", -1) or batch_id in state.get("batches", [])


def ingest_batch(spark: SparkSession, batch: DataFrame, batch_id: int, base: str) -> None:
    """Adds a batch of entities to the table under ``base``, unless it is already in it."""
    state = read_manifest(spark, base)
    if _ingested(state, batch_id):
        return
    path = f"{base}/batch-{batch_id}"
    batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(path)
    replace_manifest(spark, base, {**state, "batches": [*state.get("batches", []), batch_id]})


def stream_entities(spark: SparkSession, src_dir: str, base: str, checkpoint: str,
                    available_now: bool = True, closure: DataFrame | None = None):
    """Start the shard-ingesting query; returns the StreamingQuery. With ``closure`` (type, class) entities get
    the types of their classes."""
    lines = spark.readStream.format("text").load(src_dir)
    ents = DU.parse_entity_lines(lines).filter(~F.col("_corrupt")).drop("_corrupt")
    simple = B.simplify_entities(ents)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        if closure is None or _ingested(read_manifest(spark, base), batch_id):
            return ingest_batch(spark, _with_types(batch, closure), batch_id, base)
        parsed = f"{base}/parsed-{batch_id}"
        rows = batch.withColumn("_row", F.monotonically_increasing_id())
        rows.write.mode("overwrite").parquet(parsed)
        ingest_batch(spark, _with_types(spark.read.schema(rows.schema).parquet(parsed), closure), batch_id, base)
        remove(spark, [parsed])

    w = simple.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def _folders(base: str, state: dict) -> list[str]:
    snapshot = [state["snapshot"]] if "snapshot" in state else []
    return [f"{base}/{name}" for name in (*snapshot, *(f"batch-{k}" for k in state.get("batches", [])))]


def _latest(spark: SparkSession, base: str, state: dict) -> DataFrame:
    log = functools.reduce(DataFrame.unionByName, map(spark.read.parquet, _folders(base, state)))
    if "snapshot" in state and not state.get("batches"):
        return log  # compaction has left one row an id
    fields = [c for c in log.columns if c not in ("id", "_batch")]
    latest = log.groupBy("id").agg(F.max_by(F.struct(*fields), F.col("_batch")).alias("_r"), F.max("_batch").alias("_batch"))
    return latest.select("id", *[F.col(f"_r.{c}").alias(c) for c in fields], "_batch")


def current_entities(spark: SparkSession, base: str) -> DataFrame:
    """The entity table as the manifest has it: latest batch per id."""
    return _latest(spark, base, read_manifest(spark, base)).drop("_batch")


def current_names(spark: SparkSession, base: str, languages: Sequence[str] | None = (B.DEFAULT_LANGUAGE,),
                  include: Sequence[str] = (), exclude: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Names of the typed entities of the table, once per type (as B15 over a whole dump)."""
    ents = current_entities(spark, base)
    ents = B.filter_by_any_language(ents, languages) if languages else ents
    names = B.explode_names(ents.withColumn("type", F.explode("types")))
    return B.filter_output_languages(names, include, exclude, strict)


def compact_entities(spark: SparkSession, base: str) -> None:
    """Folds all batches into one snapshot. The folders it replaces go with the next compaction."""
    state = read_manifest(spark, base)
    if not state.get("batches"):
        return
    name = f"snapshot-{uuid.uuid4().hex}"
    _latest(spark, base, state).write.parquet(f"{base}/{name}")
    old = [p.rsplit("/", 1)[1] for p in _folders(base, state)]
    replace_manifest(spark, base, {"snapshot": name, "upto": max(state["batches"]), "batches": [], "old": old})
    remove(spark, [f"{base}/{p}" for p in state.get("old", [])])


def stream_language_counts(spark: SparkSession, src_dir: str, out_path: str, checkpoint: str,
                           fmt: str = "json", available_now: bool = True, state_partitions: int = 8):
    """Running (language, type) counts over name files; every micro-batch
    publishes the small complete result under ``out_path`` as a new version (``current_counts`` reads it).

    The state has one row per (language, type), so it is kept in
    ``state_partitions`` partitions (fixed when the query's checkpoint is
    created) instead of the session's shuffle-partition count."""
    names = spark.readStream.format(fmt).schema(NAME_SCHEMA).load(src_dir)
    counts = names.filter(F.length("language") > 0).groupBy("language", "type").count()

    def snapshot(batch: DataFrame, batch_id: int) -> None:
        publish_counts(spark, batch, batch_id, out_path)

    w = (counts.writeStream.outputMode("complete").foreachBatch(snapshot)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    # the streaming query clones the session conf when it starts
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    try:
        return w.start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def publish_counts(spark: SparkSession, counts: DataFrame, batch_id: int, out_path: str) -> None:
    """Makes ``counts`` the table under ``out_path``, unless this or a later batch is there."""
    state = read_manifest(spark, out_path)
    if batch_id <= state.get("batch", -1):
        return
    name = f"version-{batch_id}-{uuid.uuid4().hex}"
    counts.write.parquet(f"{out_path}/{name}")
    replace_manifest(spark, out_path, {"batch": batch_id, "version": name, "before": state.get("version")})
    if state.get("before"):
        remove(spark, [f"{out_path}/{state['before']}"])


def current_counts(spark: SparkSession, out_path: str) -> DataFrame:
    return spark.read.parquet(f"{out_path}/{read_manifest(spark, out_path)['version']}")
