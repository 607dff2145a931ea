"""Toxicity by maximum-scoring segments.

Every token has a score: the log-odds of toxic against other training texts under a Dirichlet prior
that is proportional to the token's share of the whole corpus, drawn towards zero by ERRORS standard
errors, less a drift. A linear scan finds all maximal scoring segments of a text. Extreme-value
statistics say how many segments of a score chance makes in a text of that length (K n exp(-lambda S)):
lambda solves the usual equation for the word scores of clean texts, K is counted on them. A
text's evidence, the surprise of its best segment and of all significant segments together, becomes
a probability by a logistic curve, fitted to training texts that are scored by the tokens of the
other half of the training texts.

Tokens are words in lower case and their stems (the first STEM_BYTES bytes), numbered by 18 bits of
their hash each, so the table of scores has a fixed size; a word has the greater of both scores. Corpus counts cover all texts; the labels used are at most MAX_LABELS (a bounded sample
by a hash of the id, beyond that many).

Defined results: null, empty and wordless texts have no segment and get the lowest probability of
the curve; equal texts get equal scores; of several labels of an id the toxic one counts; null ids
count as the empty string and have no label; without training texts of both kinds every score is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namekit.llm import arrowtext
from namekit.llm.tables import arrow_map

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
STEM_BYTES = 5
MAX_LABELS = 200_000
PRIOR = 5_000.0
DRIFT = 0.25
#: Standard errors by which log-odds are drawn towards zero.
ERRORS = 1.0
#: Segments of at least this score count for K.
K_LEVEL = 1.0
#: Scores are gathered in bins of this width for lambda and K.
BIN = 1 / 16
SLICE_BYTES = 1 << 20
HALVES = 2


def held_out(id_column: Column) -> Column:
    """Rows whose labels are not learnt from."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def token_scores(toxic: np.ndarray, clean: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Score of each bucket from its counts in toxic texts, in clean texts and in the corpus."""
    prior = PRIOR * (corpus + 1e-3) / (corpus + 1e-3).sum()
    a, b = toxic + prior, clean + prior
    total_a, total_b = a.sum(), b.sum()
    odds = np.log(a / (total_a - a)) - np.log(b / (total_b - b))
    error = np.sqrt(1 / a + 1 / b)
    sure = np.sign(odds) * np.maximum(np.abs(odds) - ERRORS * error, 0)
    return np.clip(sure, -4, 8) - DRIFT


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) in linear time."""
    # of each open segment: sum before it, sum to its end, start, end, last earlier one with a smaller sum before
    left: list[float] = []
    right: list[float] = []
    start: list[int] = []
    end: list[int] = []
    lower: list[int] = []
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        l, r, a = before, total, i
        j = len(left) - 1
        while True:
            while j >= 0 and left[j] >= l:
                j = lower[j]
            if j < 0 or right[j] >= r:
                break
            l, a = left[j], start[j]
            del left[j:], right[j:], start[j:], end[j:], lower[j:]
            j = len(left) - 1
        left.append(l)
        right.append(r)
        start.append(a)
        end.append(i + 1)
        lower.append(j)
    return [(r - l, a, b) for l, r, a, b in zip(left, right, start, end, strict=True)]


def buckets(words: arrowtext.Words) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of each word and of its stem."""
    word = (words.hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    stem = np.zeros(len(word), np.uint64)
    last = len(words.low) - 1
    for k in range(STEM_BYTES):
        at = words.starts + k
        stem = stem << np.uint64(8) | np.where(at < words.ends, words.low[np.minimum(at, last)], 0).astype(np.uint64)
    return word, (arrowtext.mix(stem) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) + BUCKETS


def word_scores(words: arrowtext.Words, scores: np.ndarray) -> np.ndarray:
    word, stem = buckets(words)
    return np.maximum(scores[word], scores[stem]).astype(np.float64)


def text_segments(words: arrowtext.Words, value: np.ndarray) -> list[list[tuple[float, int, int]]]:
    """Per text its segments in words, by its words' scores. Neighbours of like sign are one step of the scan."""
    n = len(value)
    out: list[list] = [[] for _ in range(len(words.first) - 1)]
    if n == 0:
        return out
    positive = value > 0
    begins = np.zeros(n + 1, bool)
    begins[words.first] = True
    new = begins[:n].copy()
    new[1:] |= positive[1:] != positive[:-1]
    at = np.flatnonzero(new)
    sums = np.add.reduceat(value, at)
    group = np.searchsorted(at, words.first)
    hot = np.concatenate([[0], np.cumsum(sums > 0)])
    place = np.concatenate([at, [n]])
    for d in np.flatnonzero(hot[group[1:]] > hot[group[:-1]]):
        a, b = group[d], group[d + 1]
        begin = words.first[d]
        out[d] = [(s, int(place[a + x] - begin), int(place[a + y] - begin)) for s, x, y in segments(sums[a:b].tolist())]
    return out


@dataclass
class Model:
    """``scores``: of each bucket, for new texts and for each half of the training texts."""

    scores: list[np.ndarray]
    rate: list[float]
    k: float
    curve: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def evidence(self, found: list, n: int, part: int = 0) -> tuple[float, float, float, float]:
        """Logs of: the surprise of the best segment; that of the best r segments together, for the r
        where it is greatest; the same for each word; the number of segments that are significant."""
        if not found:
            return 0.0, 0.0, 0.0, 0.0
        base = np.log(max(self.k * n, 1e-9))
        surprise = np.sort([self.rate[part] * s - base for s, _, _ in found])[::-1]
        # r segments of these scores in any order: their surprises and log r!
        together = max(0.0, float(np.cumsum(surprise + np.log(np.arange(1, len(surprise) + 1))).max()))
        return (float(np.log1p(max(surprise[0], 0.0))), float(np.log1p(together)), float(np.log1p(100 * together / (n + 20))),
                float(np.log1p((surprise > 0).sum())))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        x = (evidence - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[1:] + self.curve[0], -30, 30)))


def _rate(scores: np.ndarray, n: np.ndarray) -> float:
    """lambda: sum of share * exp(lambda * score) = 1, for ``n`` words of each score."""
    share = n / max(n.sum(), 1)
    if share @ scores >= 0 or scores.max(initial=0) <= 0:
        return 1.0
    low, high = 1e-6, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        if share @ np.exp(mid * scores) > 1:
            high = mid
        else:
            low = mid
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Balanced logistic regression by Newton's method with a small ridge."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    weight = np.ones(len(y)) / len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 1e-4 * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sample(labels: DataFrame, id_col: str, label_col: str, limit: int) -> DataFrame:
    """Training labels (label_id, toxic, half), at most about ``limit``."""
    rows = (labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("toxic"))
            .where("label_id is not null and toxic in (0, 1)").where(~held_out(F.col("label_id")))
            .groupBy("label_id").agg(F.max("toxic").alias("toxic")))
    n = rows.count()
    if n > limit:
        rows = rows.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < F.lit(int(limit / n * (1 << 20))))
    return rows.withColumn("half", F.pmod(F.floor(F.crc32(F.col("label_id").cast("string").cast("binary")) / 5),
                                          F.lit(HALVES)).cast("int"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_id_col: str = "doc_id", label_col: str = "toxic", max_labels: int = MAX_LABELS) -> Model | None:
    """The model, or None if the training texts aren't of both kinds."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # at most max_labels rows of three numbers
    sample = F.broadcast(_sample(labels, label_id_col, label_col, max_labels))
    marked = (rows.join(sample, rows.doc_id == sample.label_id, "left")
              .select("text", F.coalesce(F.col("toxic") * HALVES + F.col("half"), F.lit(-1)).alias("part"), "label_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((1 + 2 * HALVES, 2 * BUCKETS), np.int64)
        for batch in batches:
            texts = arrowtext.text_array(batch.column(0))
            part = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in arrowtext.slices(texts, SLICE_BYTES):
                words = arrowtext.split(texts.slice(a, b - a))
                which = np.repeat(part[a:b], words.counts())
                for bucket in buckets(words):
                    seen[0] += np.bincount(bucket, minlength=2 * BUCKETS)
                    for p in range(2 * HALVES):
                        if len(mine := bucket[which == p]):
                            seen[1 + p] += np.bincount(mine, minlength=2 * BUCKETS)
        at = np.flatnonzero(seen[0])
        columns = [pa.array(at, pa.int64()), *[pa.array(seen[p][at], pa.int64()) for p in range(1 + 2 * HALVES)]]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", *names])

    names = [f"n{p}" for p in range(1 + 2 * HALVES)]
    counts = (arrow_map(marked, count, "bucket long, " + ", ".join(f"{c} long" for c in names))
              .groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toArrow())  # at most 2 * BUCKETS rows
    table = np.zeros((1 + 2 * HALVES, 2 * BUCKETS))
    at = counts.column("bucket").to_numpy()
    for p, c in enumerate(names):
        table[p, at] = counts.column(c).to_numpy()
    clean, toxic = table[1:1 + HALVES], table[1 + HALVES:]
    if not clean.sum() or not toxic.sum():
        return None
    # tables of new texts, then of each half: learnt from the other half; words and stems apart
    def learnt(t: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.concatenate([token_scores(x, y, z) for x, y, z in zip(np.split(t, 2), np.split(c, 2), np.split(table[0], 2), strict=True)])

    whole = [learnt(toxic.sum(0), clean.sum(0))]
    whole += [learnt(toxic.sum(0) - toxic[h], clean.sum(0) - clean[h]) for h in range(HALVES)]
    scores = [s.astype(np.float32) for s in whole]
    shared = spark.sparkContext.broadcast(scores)

    def by_own_half(texts: pa.Array, part: list[int]):
        """Words of each text, their scores by the other half, and its segments."""
        words = arrowtext.split(texts)
        n = words.counts()
        half = np.repeat(np.array(part) % HALVES, n)
        value = np.zeros(len(words.hashes))
        for h in range(HALVES):
            value = np.where(half == h, word_scores(words, shared.value[1 + h]), value)
        return n, value, text_segments(words, value)

    def chance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            texts = arrowtext.text_array(batch.column(0))
            part = batch.column(1).to_pylist()
            for a, b in arrowtext.slices(texts, SLICE_BYTES):
                _, value, found = by_own_half(texts.slice(a, b - a), part[a:b])
                seen.update({(0, int(x)): int(m) for x, m in zip(*np.unique(np.round(value / BIN), return_counts=True), strict=True)})
                seen.update((1, min(int(s / BIN), 1000)) for f in found for s, _, _ in f)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.int32()),
                                          pa.array(list(seen.values()), pa.int64())], names=["what", "bin", "n"])

    # of clean training texts: how many words and how many segments have which score; some hundred rows
    bins = (arrow_map(marked.where((F.col("part") >= 0) & (F.col("part") < HALVES)), chance, "what int, bin int, n long")
            .groupBy("what", "bin").agg(F.sum("n").alias("n")).collect())
    at, n = (np.array([r[k] for r in bins if not r.what], float) for k in ("bin", "n"))
    rate = _rate(at * BIN, n)
    # segments a word at the level, carried to score 0
    over = sum(r.n for r in bins if r.what and r.bin * BIN >= K_LEVEL) * np.exp(rate * K_LEVEL)
    model = Model(scores, [rate] * (1 + HALVES), (over + 0.5) / (n.sum() + 1), np.zeros(5), np.zeros(4), np.ones(4))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = arrowtext.text_array(batch.column(0))
            part = batch.column(1).to_pylist()
            for a, b in arrowtext.slices(texts, SLICE_BYTES):
                n, _, found = by_own_half(texts.slice(a, b - a), part[a:b])
                x = [model.evidence(f, int(m), 1 + p % HALVES) for f, m, p in zip(found, n, part[a:b], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).slice(a, b - a), pa.array([p >= HALVES for p in part[a:b]], pa.bool_()),
                     *[pa.array([v[k] for v in x], pa.float64()) for k in range(4)]], names=["label_id", "toxic", *numbers])

    # a label is one row, the mean of its documents, whatever their number: at most max_labels rows of four numbers
    numbers = [f"x{k}" for k in range(4)]
    seen = (arrow_map(marked.where("part >= 0"), measure,
                      "label_id long, toxic boolean, " + ", ".join(f"{c} double" for c in numbers))
            .groupBy("label_id", "toxic").agg(*[F.avg(c).alias(c) for c in numbers]).toArrow().sort_by("label_id"))
    x = np.stack([seen.column(c).to_numpy() for c in numbers], axis=1)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    model.curve = _logistic((x - model.mean) / model.scale, seen.column("toxic").to_numpy().astype(float))
    return model


def _probabilities(texts: pa.Array, model: Model | None):
    words = arrowtext.split(texts)
    n = words.counts()
    found = text_segments(words, word_scores(words, model.scores[0])) if model else [[] for _ in n]
    x = np.array([model.evidence(f, int(m)) for f, m in zip(found, n, strict=True)]) if model and len(n) else np.zeros((len(n), 4))
    return (model.probability(x) if model else np.zeros(len(n))), x, found


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, best (surprise of the best segment), passages (start, end
    in words and score of every significant segment)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = arrowtext.text_array(batch.column(1))
            for a, b in arrowtext.slices(texts, SLICE_BYTES):
                p, x, found = _probabilities(texts.slice(a, b - a), m)
                significant = [[{"start": s, "end": e, "score": v} for v, s, e in f if m.evidence([(v, s, e)], 1)[0] > 0] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)),
                     pa.array(x[:, 0], pa.float64()), pa.array(significant, kind)],
                    names=["doc_id", "score", "predicted", "best", "passages"])

    out = arrow_map(rows, run, "doc_id long, score double, predicted int, best double, "
                               "passages array<struct<start:long,end:long,score:double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "best", "passages")


def remove_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a score under 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = arrowtext.text_array(batch.column(column))
            for a, b in arrowtext.slices(texts, SLICE_BYTES):
                p = _probabilities(texts.slice(a, b - a), shared.value)[0]
                yield batch.slice(a, b - a).filter(pa.array(p < 0.5))

    return arrow_map(docs, run, docs.schema)
