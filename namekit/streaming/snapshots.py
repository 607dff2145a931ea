"""Tables that change as a whole: every state is written to folders of its own, and a small manifest names the folders
that are the table. The manifest is replaced by one rename, so a reader sees the state before or after, and nothing
half written. Folders no manifest names stay for one more change, for readers that still use them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

MANIFEST = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def read_manifest(spark: SparkSession, base: str) -> dict:
    """The manifest under ``base``; an empty one where there is none yet."""
    path, fs = _fs(spark, f"{base}/{MANIFEST}")
    if not fs.exists(path):
        return {}
    stream = fs.open(path)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def replace_manifest(spark: SparkSession, base: str, manifest: dict) -> None:
    """Writes the manifest beside the old one and renames it over that."""
    path, fs = _fs(spark, f"{base}/.{MANIFEST}-{uuid.uuid4().hex}")
    stream = fs.create(path, True)
    try:
        stream.write(bytearray(json.dumps(manifest).encode()))
    finally:
        stream.close()
    jvm = spark._jvm
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(path, jvm.org.apache.hadoop.fs.Path(f"{base}/{MANIFEST}"), over)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path, fs = _fs(spark, p)
        fs.delete(path, True)
