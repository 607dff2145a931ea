"""Repeated lines, by levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, A-Z lower-cased; its hash has 128 bits.
The documents come in batches. Of every batch, hashes are summed to one record each (lines with it,
largest doc_id), sorted into buckets by hash and anti-joined, bucket by bucket, with the runs that are
there: unknown hashes become a run of level 0, known ones go to a log of repeats. When a level has as many
runs as the fan-out, they are merged into one run of the next level. So each hash stands in one run only,
a batch is moved once, and the runs are only read by merge joins, never moved again but by a compaction.

Runs and log together give the candidates: hashes on enough lines, which are at least as many as
their documents. Only the lines of candidates are then fetched, counted exactly by document and dropped.
A hash on more lines than a partition has on average is spread over several; there are at most as
many of those as partitions, so that their list, and nothing else, is broadcast.

Defined results: a null or empty text is one empty line. Rows of equal doc_id are one document. A row with a
null doc_id is a document of its own (equal texts one), below every doc_id; lines only such rows hold
all stay. All repeats of a key within the document that keeps it stay.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namekit.llm.tables import discard, table_path
from namekit.session import checkpoint_dir

#: White space stripped at both ends: [\x20\x09-\x0D].
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(STRIPPED))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """h, doc_id, row (hash of the text), pos: every line whose key has ``min_chars`` code points."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    lines = lines.where(F.char_length(F.btrim("line", F.lit(STRIPPED))) >= min_chars)
    return lines.select(F.unhex(F.md5(line_key(F.col("line")))).alias("h"), "doc_id", "row", "pos")


class SortedRuns:
    """Levels of runs: tables of (h, n, top), bucketed and sorted by ``h``, each hash in one run only. The log
    of repeats is not bucketed (a union of bucketed tables, taken for bucketed itself, groups wrongly in Spark 4.1)."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.log: list[str] = []
        self.paths: dict[str, str] = {}

    def _store(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = f"{checkpoint_dir(self.spark).rstrip('/')}/{name}"
        rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", self.paths[name]).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        discard(self.spark, self.paths.pop(name))

    def add(self, batch: DataFrame) -> None:
        """Takes a batch of (h, n, top) with one row for each hash."""
        runs = [name for level in self.levels for name in level]
        own = self._store(batch)
        if runs:
            rows = self.spark.table(own)
            fresh = reduce(lambda left, run: left.join(self.spark.table(run).select("h"), "h", "left_anti"), runs, rows)
            new = self._store(fresh)
            self.log.append(table_path(self.spark))
            rows.join(self.spark.table(new).select("h"), "h", "left_anti").write.parquet(self.log[-1])
            self._drop(own)
            own = new
        self.levels[0].append(own)
        self._compact()

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) < self.fanout:
                continue
            if k + 1 == len(self.levels):
                self.levels.append([])
            merged = reduce(DataFrame.union, map(self.spark.table, level)).repartition(self.buckets, "h")
            self.levels[k + 1].append(self._store(merged))
            for name in level:
                self._drop(name)
            level.clear()

    def frequent(self, least: int) -> DataFrame:
        """(h, n, top) over all batches, of the hashes with ``n`` of at least ``least``."""
        runs = [self.spark.table(name) for level in self.levels for name in level]
        if self.log:
            log = self.spark.read.schema(runs[0].schema).parquet(*self.log)
            again = self.spark.table(self._store(log.groupBy("h").agg(F.sum("n").alias("m"), F.max("top").alias("last"))))
            runs = [run.join(again, "h", "left").select(
                "h", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), F.greatest("top", "last").alias("top")) for run in runs]
        return reduce(DataFrame.union, runs).where(F.col("n") >= least)

    def close(self) -> None:
        for name in list(self.paths):
            self._drop(name)
        for path in self.log:
            discard(self.spark, path)


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """doc_id, row, drop: the positions (from 0) of the lines to drop of each distinct row that has any."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys_path = table_path(spark)
    lines = long_lines(docs.select("doc_id", "text"), min_chars)
    (lines.withColumn("batch", F.pmod(F.xxhash64("doc_id", "row", "pos"), F.lit(batches)).cast("int"))
     .hint("rebalance", F.col("batch")).write.partitionBy("batch").parquet(keys_path))
    id_type = lines.schema["doc_id"].dataType.simpleString()
    keys = spark.read.schema(f"h binary, doc_id {id_type}, row long, pos int, batch int").parquet(keys_path)

    runs = SortedRuns(spark, fanout)
    for k in range(batches):
        runs.add(keys.where(F.col("batch") == k).groupBy("h").agg(F.count("*").alias("n"), F.max("doc_id").alias("top")))
    hot_path = table_path(spark)
    runs.frequent(min_docs).write.parquet(hot_path)
    runs.close()
    hot = spark.read.schema(f"h binary, n long, top {id_type}").parquet(hot_path)

    total = max(1, keys.count())
    spread = F.ceil(F.col("n") * parts / total).cast("int")
    heavy = hot.where(F.col("n") * parts >= total).select("h", spread.alias("spread"))  # at most as many as parts
    dealt = F.pmod(F.xxhash64("doc_id", "row", "pos", F.spark_partition_id()), F.coalesce("spread", F.lit(1))).cast("int")
    salted = keys.join(F.broadcast(heavy), "h", "left").select("h", "doc_id", "row", "pos", dealt.alias("salt"))
    copies = F.when(F.col("n") * parts >= total, spread).otherwise(1)
    hot = hot.select("h", "top", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"))
    found_path = table_path(spark)
    salted.join(hot, ["h", "salt"]).select("h", "salt", "top", "doc_id", "row", "pos").distinct().write.parquet(found_path)
    found = spark.read.parquet(found_path)

    own = F.when(F.col("doc_id").isNull(), F.col("row"))
    few = found.select("h", "doc_id", own.alias("own")).distinct().groupBy("h").count().where(F.col("count") < min_docs).select("h")
    few = hot.select("h", "salt").join(few, "h")  # so that a hash on many lines stays spread
    drops = found.where(F.col("top").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("top"))).join(few, ["h", "salt"], "left_anti")
    drops_path = table_path(spark)
    drops.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("drop")).write.parquet(drops_path)
    for path in (keys_path, hot_path, found_path):
        discard(spark, path)
    return spark.read.parquet(drops_path)


def drop_lines(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_lines, n_dropped, text: each row's lines that stay, joined by a line feed."""
    docs = docs.select("doc_id", "text")
    drops = repeated_lines(docs, **how).select(F.col("doc_id").alias("at"), "row", "drop")
    rows = docs.withColumn("row", F.xxhash64("text"))
    rows = rows.join(drops.withColumnRenamed("row", "same"), F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("row") == F.col("same")), "left")

    def stretch(s: Column, k: Column) -> Column:  # the lines between two dropped ones
        after = F.when(k == 0, F.lit(-1)).otherwise(F.element_at(s["drop"], F.greatest(k, F.lit(1))))
        until = F.when(k == F.size(s["drop"]), F.size(s["lines"])).otherwise(F.element_at(s["drop"], F.least(k + 1, F.size(s["drop"]))))
        return F.slice(s["lines"], after + 2, until - after - 1)

    both = F.array(F.struct(lines_of(F.col("text")).alias("lines"), F.col("drop").alias("drop")))
    left = F.transform(both, lambda s: F.array_join(F.flatten(F.transform(
        F.sequence(F.lit(0), F.size(s["drop"])), lambda k: stretch(s, k))), "\n"))[0]
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), text).otherwise(left).alias("text"))
