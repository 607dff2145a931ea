"""Benchmark decontamination by training suffix arrays.

Every shard of training texts (a bounded slice of one task's rows) gets a suffix array over its
words. Every suffix of the benchmark texts is looked up in it by binary search, which yields all
places where at least a whole window of the benchmark occurs word for word, and from there the
longest verbatim matches. A text lies wholly inside one shard, so its result needs no shuffle.

The suffix array is sparse: a training suffix that meets a word outside the benchmark's vocabulary
before a window is full cannot match, so only runs of vocabulary words that are long enough are
sorted. Words are compared by 64-bit hashes first; every word of a match is then compared by its
bytes, and a colliding word is taken out before the search is repeated.

Defined results: a null or wordless text has no words and no hits; a null item text is never hit;
a null item id counts as the empty string; rows of equal item id count as one item; repeated
documents each get their own row; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namekit.llm import arrowtext
from namekit.llm.tables import arrow_map
from namekit.session import checkpoint_dir

WINDOW = 10
SHARD_BYTES = 2 << 20
#: A block of benchmark texts that is sent to every task has about this many bytes at most.
BLOCK_BYTES = 16 << 20

SCHEMA = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
          "contaminated boolean, longest_match long, "
          "matches array<struct<item_id:string,start:long,length:long>>")


class TestIndex:
    """One block of benchmark texts as word codes: 1 and up in the order of the words' hashes."""

    def __init__(self, ids: list, texts: list, window: int):
        self.ids = ["" if x is None else str(x) for x in ids]
        w = arrowtext.split(pa.array(texts, pa.large_string()).fill_null(""))
        self.vocabulary, at, codes = np.unique(w.hashes, return_index=True, return_inverse=True)
        self.low = [w.word(i) for i in at]
        lengths = np.array([0] + [len(x) for x in self.low], np.int64)
        self.bytes = np.frombuffer(b"".join(self.low), np.uint8)
        self.from_byte = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.n_bytes = lengths
        codes = (codes + 1).astype(np.int64)
        counts = w.counts()
        self.depth = int(counts.max(initial=1))
        #: by window length: the distinct windows, and the (item, position) pairs of each
        self.windows: dict[int, tuple[np.ndarray, list]] = {}
        for size in sorted({min(window, int(n)) for n in counts if n}):
            rows, where = [], []
            for item, n in enumerate(counts):
                if n and min(window, n) == size:
                    for p in range(n - size + 1):
                        a = w.first[item] + p
                        rows.append(codes[a:a + size])
                        where.append((item, p))
            distinct, which = np.unique(np.array(rows), axis=0, return_inverse=True)
            places: list[list] = [[] for _ in distinct]
            for k, x in zip(which.ravel(), where, strict=True):
                places[k].append(x)
            self.windows[size] = (distinct, places)
        full = [s for s in self.windows]
        self.least = min(full, default=0)
        self.window = window
        self.short_first = {int(c) for s in full if s < window for c in self.windows[s][0][:, 0]}

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Codes of words; 0 outside the vocabulary."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        bits = getattr(self, "_bits", None)
        if bits is None:
            bits = self._bits = np.zeros(1 << 20, bool)
            bits[self.vocabulary >> np.uint64(44)] = True
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(bits[hashes >> np.uint64(44)])
        at = np.searchsorted(self.vocabulary, hashes[maybe])
        at[at == len(self.vocabulary)] = 0
        out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0)
        return out


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, ordered by their first ``depth`` words at least (prefix doubling)."""
    _, rank = np.unique(codes, return_inverse=True)
    rank = rank.astype(np.int64)
    n, h = len(codes), 1
    while h < depth:
        after = np.zeros(n, np.int64)
        after[:-h] = rank[h:] + 1
        distinct, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
        if len(distinct) == n:
            break
        h *= 2
        if h >= n:
            break
    return np.argsort(rank, kind="stable")


def _bounds(codes: np.ndarray, order: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row of ``wanted`` the range of ``order`` whose suffixes start with it."""
    n, size = wanted.shape
    steps = np.arange(size)
    found = []
    for upper in (False, True):
        lo, hi = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            seen = codes[order[mid][:, None] + steps]
            differs = seen != wanted[open_]
            at = differs.argmax(axis=1)
            rows = np.arange(len(open_))
            less = seen[rows, at] < wanted[open_][rows, at]
            right = np.where(differs[rows, at], less, upper)
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
        found.append(lo)
    return found[0], found[1]


def _occurrences(codes: np.ndarray, words: arrowtext.Words, index: TestIndex):
    """(item, item position, word index, window length) of every window that occurs."""
    first = words.first
    doc_start = np.zeros(len(codes) + 1, bool)
    doc_start[first] = True
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = codes > 0
    cut = doc_start[:-1]
    run_start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut))
    run_end = np.flatnonzero(inside[1:-1] & (~inside[2:] | doc_start[1:])) + 1
    length = run_end - run_start
    keep = length >= index.window
    if index.least < index.window:
        starts_short = np.isin(codes, list(index.short_first))
        some = np.concatenate([[0], np.cumsum(starts_short)])
        keep |= (length >= index.least) & (some[run_end] > some[run_start])
    run_start, length = run_start[keep], length[keep]
    empty = np.zeros((0, 4), np.int64)
    if not len(run_start):
        return empty
    # the kept runs, each followed by a 0
    total = int(length.sum() + len(length))
    place = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    word_at = np.arange(total) - np.repeat(place - run_start, length + 1)
    compact = np.zeros(total + index.window, np.int64)
    real = np.ones(total, bool)
    real[place + length] = False
    compact[:total][real] = codes[word_at[real]]
    order = suffix_array(compact[:total], index.depth)
    found = []
    for size, (wanted, places) in index.windows.items():
        lo, hi = _bounds(compact, order, wanted)
        for k in np.flatnonzero(hi > lo):
            at = word_at[order[lo[k]:hi[k]]]
            for item, p in places[k]:
                found.append(np.stack([np.full(len(at), item), np.full(len(at), p), at,
                                       np.full(len(at), size)], axis=1))
    return np.concatenate(found) if found else empty


def _confirmed(words: arrowtext.Words, index: TestIndex):
    """Occurrences whose words are equal byte for byte."""
    codes = index.codes(words.hashes)
    while True:
        found = _occurrences(codes, words, index)
        if not len(found):
            return found, None
        edge = (np.bincount(found[:, 2], minlength=len(codes) + 1)
                - np.bincount(found[:, 2] + found[:, 3], minlength=len(codes) + 1))
        hit = np.cumsum(edge)[:-1] > 0
        at = np.flatnonzero(hit)
        size = words.ends[at] - words.starts[at]
        wrong = size != index.n_bytes[codes[at]]
        ok = np.flatnonzero(~wrong)
        n = size[ok]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        same = (words.low[np.repeat(words.starts[at[ok]], n) + step]
                == index.bytes[np.repeat(index.from_byte[codes[at[ok]]], n) + step])
        bad = np.repeat(np.arange(len(ok)), n)[~same]
        wrong[ok[bad]] = True
        if not wrong.any():
            return found, hit
        codes[at[wrong]] = 0


def search(texts: pa.Array, index: TestIndex) -> list[tuple]:
    """Per text: number of words, covered ranges of words, items, longest verbatim matches."""
    words = arrowtext.split(texts)
    counts = words.counts()
    found, hit = _confirmed(words, index) if index.windows and len(words.hashes) else ((), None)
    out = [(int(n), [], set(), []) for n in counts]
    if not len(found):
        return out
    edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    # ranges end at a text's last word
    cuts = np.zeros(len(hit) + 1, bool)
    cuts[words.first] = True
    start = np.flatnonzero((edges[:-1] == 1) | (hit & cuts[:-1]))
    end = np.flatnonzero((edges[1:] == -1) | (hit & cuts[1:])) + 1
    for d, a, b in zip(np.searchsorted(words.first, start, "right") - 1, start, end, strict=True):
        out[d][1].append((int(a - words.first[d]), int(b - words.first[d])))
    # windows that follow each other in item and text alike make one longest match
    item, p, at, size = found.T
    sort = np.lexsort((at, at - p, item))
    item, p, at, size = item[sort], p[sort], at[sort], size[sort]
    doc = np.searchsorted(words.first, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = ((item[1:] != item[:-1]) | (at[1:] - p[1:] != at[:-1] - p[:-1])
               | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]))
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(at)]]) - 1
    for h, t in zip(head, tail, strict=True):
        name, d = index.ids[item[h]], doc[h]
        out[d][2].add(name)
        out[d][3].append((name, int(at[h] - words.first[d]), int(at[t] + size[t] - at[h])))
    return out


def _merged(ranges: list) -> list:
    out: list = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list, bool]]:
    """Benchmark rows in blocks of bounded size, and whether a block is the last; each is read when it is asked for."""
    b = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    size = b.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + F.lit(64))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        rows = part.collect()
        yield [r.i for r in rows], [r.t for r in rows], k == n - 1


def _searched(batch: pa.RecordBatch, column: int, index: TestIndex) -> Iterator[tuple[int, int, list]]:
    texts = arrowtext.text_array(batch.column(column))
    for a, b in arrowtext.slices(texts, SHARD_BYTES):
        yield a, b, search(texts.slice(a, b - a), index)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text",
                  window: int = WINDOW) -> DataFrame:
    """One row per document: SCHEMA. ``matches``: longest verbatim matches (item, first word, words)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = "n_words long, cover array<array<long>>, items array<string>, " \
            "matches array<struct<item_id:string,start:long,length:long>>"
    state = None
    for ids, texts, last in _blocks(benchmark, item_id_col, item_text_col):
        index = spark.sparkContext.broadcast(TestIndex(ids, texts, window))
        more = state is not None

        def run(batches, index=index, last=last, more=more):
            for batch in batches:
                for a, b, found in _searched(batch, 1, index.value):
                    part = batch.slice(a, b - a)
                    if more:
                        old = part.select(["cover", "items", "matches"]).to_pylist()
                        found = [(n, c + [tuple(x) for x in o["cover"]], i | set(o["items"]),
                                  m + [(x["item_id"], x["start"], x["length"]) for x in o["matches"]])
                                 for (n, c, i, m), o in zip(found, old, strict=True)]
                    yield _out(part, found, last)

        rows = rows if state is None else state
        schema = SCHEMA if last else f"doc_id long, text string, {parts}"
        state = arrow_map(rows, run, schema)
        if not last:
            checkpoint_dir(spark)
            state = state.checkpoint()
    return state


def _matches(found: list) -> pa.Array:
    kind = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
    return pa.array([[{"item_id": i, "start": s, "length": n} for i, s, n in sorted(m)] for *_, m in found], kind)


def _out(part: pa.RecordBatch, found: list, last: bool) -> pa.RecordBatch:
    n_words = pa.array([n for n, *_ in found], pa.int64())
    covers = [_merged(c) for _, c, _, _ in found]
    items = [sorted(i) for _, _, i, _ in found]
    if not last:
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), n_words, pa.array(covers, pa.list_(pa.list_(pa.int64()))),
             pa.array(items, pa.list_(pa.string())), _matches(found)],
            names=["doc_id", "text", "n_words", "cover", "items", "matches"])
    hits = [sum(b - a for a, b in c) for c in covers]
    return pa.RecordBatch.from_arrays(
        [part.column(0), n_words, pa.array(hits, pa.int64()), pa.array([len(i) for i in items], pa.int64()),
         pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
         pa.array([h > 0 for h in hits], pa.bool_()),
         pa.array([max((x[2] for x in m), default=0) for *_, m in found], pa.int64()), _matches(found)],
        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "matches"])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                        item_id_col: str = "item_id", item_text_col: str = "text",
                        window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold a window of the benchmark."""
    spark, out = docs.sparkSession, docs
    column = docs.columns.index(text_col)
    for ids, texts, _ in _blocks(benchmark, item_id_col, item_text_col):
        index = spark.sparkContext.broadcast(TestIndex(ids, texts, window))

        def run(batches, index=index):
            for batch in batches:
                for a, b, found in _searched(batch, column, index.value):
                    clean = pa.array([not c for _, c, _, _ in found], pa.bool_())
                    yield batch.slice(a, b - a).filter(clean)

        out = arrow_map(out, run, docs.schema)
    return out
