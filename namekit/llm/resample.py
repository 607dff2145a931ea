"""Documents drawn towards a target distribution by importance weights with Gumbel noise.

Features are runs of words, hashed into buckets by crc32. One pass counts the buckets of the documents and of
the target (per task one array of counts, summed by bucket); the logarithms of their smoothed ratios are a
fixed-size array of integer gains. A second pass adds up the gains of each document's features, and
a noise that depends on the id alone makes the highest scores a sample in proportion to the weights.

The cutoff: a quantile sketch of the scores gives a bracket around the wanted rank. Exact counts above and
inside it validate the bracket or widen it; only rows inside are sorted, and the row at the wanted rank is the
cutoff. Sorting is range partitioned; a partition's rank offset is the number of rows in the partitions before it.

Defined results: a null text has no words, a null doc_id hashes as an empty one and comes last among ties.
Rows with equal score and doc_id stand in order of n_features; rows that agree in that too are
interchangeable and take consecutive ranks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namekit.llm.arrowtext import slices, text_array
from namekit.llm.tables import arrow_map, written
from namekit.llm.wordarray import word_array

SLICE_BYTES = 4 << 20
#: Ranks of one row of the ranked table, at most, when equal rows are set out one by one.
BLOCK = 10_000


def _features(texts: pa.Array, ngrams: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature, the text it belongs to, and the words of each text."""
    words, first = word_array(texts)
    n_words = np.diff(first)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    of, at, grams = [], [], words
    for n in range(1, ngrams + 1):
        if n > 1:
            grams = pc.binary_join_element_wise(grams[:-1], words[n - 1:], pa.scalar(b" ", pa.large_binary()))
        if not len(grams):
            break
        whole = owner[:len(grams)] == owner[n - 1:]
        inside = grams if whole.all() else grams.filter(pa.array(whole))
        coded = inside.dictionary_encode()
        by_code = np.fromiter((zlib.crc32(g.as_buffer()) % buckets for g in coded.dictionary), np.int64, len(coded.dictionary))
        of.append(by_code[coded.indices.to_numpy()] if len(inside) else np.zeros(0, np.int64))
        at.append(owner[:len(grams)][whole])
    none = np.zeros(0, np.int64)
    return np.concatenate(of) if of else none, np.concatenate(at) if at else none, n_words


def bucket_counts(texts: DataFrame, ngrams: int, buckets: int) -> np.ndarray:
    """Features of the column ``text`` in each bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            column = text_array(batch.column(0))
            for a, b in slices(column, SLICE_BYTES):
                total += np.bincount(_features(column[a:b], ngrams, buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = arrow_map(texts.select("text"), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in counted.collect():  # at most ``buckets`` rows
        out[row.bucket] = row.n
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))), in doubles."""
    S, T, n = float(docs.sum()), float(target.sum()), len(docs)
    return np.array([math.floor(1000 * math.log(((t + 1.0) * (S + n)) / ((s + 1.0) * (T + n))))
                     for s, t in zip(docs.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, ngrams: int) -> DataFrame:
    """doc_id, n_words, n_features, weight."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = text_array(batch.column(1))
            for a, b in slices(column, SLICE_BYTES):
                of, at, n_words = _features(column[a:b], ngrams, len(gain))
                weight = np.zeros(b - a, np.int64)
                np.add.at(weight, at, gain[of])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(n_words.astype(np.int64)), pa.array(np.bincount(at, minlength=b - a)), pa.array(weight)],
                    ["doc_id", "n_words", "n_features", "weight"])

    return arrow_map(docs.select("doc_id", "text"), measure, schema)


def noise(doc_id: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln(u))) with u from the first 8 hex digits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _order() -> list[Column]:
    """The drawing order of rows."""
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]


def _placed(groups: DataFrame) -> DataFrame:
    """``groups`` (distinct rows with their number ``c``) with ``before``: the rows that stand before, in drawing order."""
    dealt = groups.repartitionByRange(*_order()).withColumn("part", F.spark_partition_id())
    dealt = written(dealt)
    sums = dealt.groupBy("part").agg(F.sum("c").alias("rows"))  # one row per partition
    offsets = sums.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("offset"))
    inside = F.sum("c").over(Window.partitionBy("part").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    return dealt.withColumn("inside", inside).join(F.broadcast(offsets), "part").select(
        *groups.columns, (F.col("offset") + F.col("inside")).alias("before"))


def bracket(scores: DataFrame, wanted: int, n: int, accuracy: int = 10_000) -> tuple[int, int, int]:
    """Scores (low, high) between which the ``wanted``-th highest of ``n`` lies, and the exact number above high."""
    width = 2.0 / accuracy
    while True:
        p = 1.0 - wanted / n
        ends = [max(0.0, p - width), min(1.0, p + width)]
        if width < 1.0:
            low, high = scores.agg(F.percentile_approx("score", ends, accuracy)).first()[0]
        else:
            low, high = scores.agg(F.min("score"), F.max("score")).first()
        s = F.col("score")
        above, inside = scores.agg(F.count_if(s > high), F.count_if((s >= low) & (s <= high))).first()
        if above < wanted <= above + inside:
            return low, high, above
        width *= 8


def _upto(cut) -> Column:
    """Rows that stand at the row ``cut`` or before it, in drawing order."""
    doc, score, n = F.col("doc_id"), F.col("score"), F.col("n_features")
    same = doc.eqNullSafe(F.lit(cut.doc_id))
    earlier = doc.isNotNull() if cut.doc_id is None else F.coalesce(doc < F.lit(cut.doc_id), F.lit(False))
    return (score > cut.score) | ((score == cut.score) & (earlier | (same & (n <= cut.n_features))))


def draw(scored: DataFrame, min_words: int, percent: int, accuracy: int = 10_000) -> DataFrame:
    """``scored`` (doc_id, n_words, n_features, weight, score) with ``rank``, null where not drawn."""
    columns = ["doc_id", "n_features", "weight", "score"]
    eligible = scored.where(F.col("n_words") >= min_words)
    n = eligible.count()
    wanted = percent * n // 100
    if not wanted:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    low, high, above = bracket(eligible.select("score"), wanted, n, accuracy)
    keys = ["score", "doc_id", "n_features"]
    near = eligible.where(F.col("score").between(low, high)).groupBy(*keys).agg(F.count("*").alias("c"))
    m = wanted - above
    cut = _placed(near).where((F.col("before") < m) & (F.col("before") + F.col("c") >= m)).first()
    drawn = (F.col("n_words") >= min_words) & _upto(cut)
    groups = scored.where(drawn).groupBy(*keys, "weight").agg(F.count("*").alias("c"))
    # equal rows are set out one by one, in blocks dealt over all tasks, so that no task gets a whole large group
    first = F.sequence(F.lit(0).cast("long"), F.col("c") - 1, F.lit(BLOCK).cast("long"))
    blocks = _placed(groups).withColumn("start", F.explode(first)).repartition("before", "start")
    ranks = F.sequence(F.col("before") + F.col("start") + 1, F.col("before") + F.least(F.col("start") + BLOCK, "c"))
    rows = blocks.select(*columns, F.explode(ranks).alias("rank"))
    ranked = rows.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.union(scored.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, ngrams: int = 1, min_words: int = 20,
             percent: int = 10, seed: str = "2024") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; the highest ``percent`` of those with
    ``min_words`` words have a rank."""
    docs, target = docs.select("doc_id", "text"), target.select("text")
    gain = gains(bucket_counts(docs, ngrams, buckets), bucket_counts(target, ngrams, buckets))
    scored = weigh(docs, gain, ngrams).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return draw(written(scored), min_words, percent)
