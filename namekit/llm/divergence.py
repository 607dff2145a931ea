"""How far the sources of a language differ in their vocabulary, by in-mapper stripes.

Every task folds the whole documents of its partitions into stripes, one for each (language, term): the number of
documents with the term and its occurrences by source. Stripes of a task are few next to its words; when
they outgrow a bound they are spilled, sorted, and the next ones begin. Spark deals the spills by
(language, term), sorts them, and one pass over the sorted rows merges those of a key, keeps the terms of enough
documents and writes their stripes. From them follow each group's total and the vocabulary's size, and with these
at hand the merged stripes directly emit their share of every divergence: blocks of terms against all
pairs of a language's sources, and each source's most distinctive terms.

The merged stripes are dealt by a hash of the term into as many blocks as their entries ask for, whatever the language, so
a language of most rows is spread evenly. A block's task also gets the totals of all (language, source) groups; the
result has a row for every pair of them within a language, which is more.

Defined results: null text, lang and source are empty strings, equal rows count as often as they stand
there, a language without kept terms has pairs of value 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namekit.llm.arrowtext import slices, text_array
from namekit.llm.tables import arrow_map, written
from namekit.llm.wordarray import IS_LETTER, word_array
from namekit.session import ship_package

SLICE_BYTES = 4 << 20
#: A task spills its stripes beyond so many entries (term and source, or term and language).
MAX_ENTRIES = 1 << 20
#: Rows of an Arrow batch that a task puts out.
OUT_ROWS = 1 << 14
#: Entries of merged stripes in a block, and numbers in a table of terms by sources at a time.
BLOCK_ENTRIES = 200_000
TABLE_NUMBERS = 1 << 20
#: Blocks at least, so that a small vocabulary is spread as well.
MIN_BLOCKS = 64
ONE = 1_000_000_000

STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"
STRIPE_ARROW = pa.schema([("lang", pa.string()), ("term", pa.string()), ("df", pa.int64()),
                          ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[heads], np.add.reduceat(counts, heads)


def _stripes(lang: pa.Array, term: pa.Array, df: np.ndarray, first: np.ndarray, sources: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stripe ``i`` has the entries ``first[i]`` to ``first[i + 1]``."""
    for a in range(0, len(df), OUT_ROWS):
        b = min(len(df), a + OUT_ROWS)
        x, y = int(first[a]), int(first[b])
        places = pa.array((first[a:b + 1] - x).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [lang[a:b].cast(pa.string()), term[a:b].cast(pa.string()), pa.array(df[a:b]),
             pa.ListArray.from_arrays(places, sources[x:y].cast(pa.string())), pa.ListArray.from_arrays(places, pa.array(counts[x:y]))],
            schema=STRIPE_ARROW)


class _Stripes:
    """Stripes of the documents folded so far. An entry's key is term * 2^32 + group (or language)."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.langs: dict[str, int] = {}
        none = np.zeros(0, np.int64)
        self.count, self.df = (none, none), (none, none)

    def fold(self, langs: list[str], sources: list[str], texts: pa.Array) -> None:
        words, first = word_array(texts, IS_LETTER)
        group = np.array([self.groups.setdefault(k, len(self.groups)) for k in zip(langs, sources, strict=True)], np.int64)
        lang = np.array([self.langs.setdefault(k, len(self.langs)) for k in langs], np.int64)
        if not len(words):
            return
        coded = words.dictionary_encode()
        ids = np.array([self.terms.setdefault(w, len(self.terms)) for w in coded.dictionary.to_pylist()], np.int64)
        term = ids[coded.indices.to_numpy()]
        doc = np.repeat(np.arange(len(langs)), np.diff(first))
        once, n = _summed((term << 32) | doc, np.ones(len(term), np.int64))  # a term's occurrences in a document
        term, doc = once >> 32, once & 0xFFFFFFFF
        cells = _summed((term << 32) | group[doc], n)
        docs = _summed((term << 32) | lang[doc], np.ones(len(term), np.int64))
        self.count = _summed(*(np.concatenate(x) for x in zip(self.count, cells, strict=True)))
        self.df = _summed(*(np.concatenate(x) for x in zip(self.df, docs, strict=True)))

    def entries(self) -> int:
        return max(len(self.count[0]), len(self.df[0]), len(self.terms))

    def spill(self) -> Iterator[pa.RecordBatch]:
        if self.terms:
            names, groups = list(self.terms), list(self.groups)
            lang_of = np.array([self.langs[lang] for lang, _ in groups], np.int64)
            term, group = self.count[0] >> 32, self.count[0] & 0xFFFFFFFF
            order = np.lexsort((group, lang_of[group], term))  # like df: by term, then language
            term, group, counts = term[order], group[order], self.count[1][order]
            heads = np.flatnonzero(np.r_[True, ((term << 32) | lang_of[group])[1:] != ((term << 32) | lang_of[group])[:-1]])
            first = np.r_[heads, len(term)]
            sources = pa.array([s for _, s in groups], pa.large_string()).take(pa.array(group))
            langs = pa.array(list(self.langs), pa.large_string()).take(pa.array(self.df[0] & 0xFFFFFFFF))
            words = pa.array(names, pa.large_binary()).take(pa.array(self.df[0] >> 32)).cast(pa.large_string())
            yield from _stripes(langs, words, self.df[1], first, sources, counts)
        self.__init__()


def stripes(docs: DataFrame) -> DataFrame:
    """Stripes of ``docs``, several for a (lang, term) where several tasks or spills have it."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Stripes()
        for batch in batches:
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_array(batch.column(2))
            for a, b in slices(texts, SLICE_BYTES):
                held.fold(langs[a:b], sources[a:b], texts[a:b])
                if held.entries() > MAX_ENTRIES:
                    yield from held.spill()
        yield from held.spill()

    return arrow_map(docs.select("lang", "source", "text"), fold, STRIPE)


def _merge(table: pa.Table, min_docs: int) -> Iterator[pa.RecordBatch]:
    """One stripe for each (lang, term) of ``table``, whose rows are sorted by them."""
    lang, term = (table.column(k).combine_chunks().cast(pa.large_string()) for k in (0, 1))
    a, b = lang.dictionary_encode().indices.to_numpy(), term.dictionary_encode().indices.to_numpy()
    heads = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    df = np.add.reduceat(table.column(2).to_numpy(), heads)
    sources = table.column(3).combine_chunks()
    lengths = np.diff(sources.offsets.to_numpy())
    key = np.repeat(np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(a)])), lengths)
    coded = sources.flatten().dictionary_encode()
    cells, counts = _summed((key << 32) | coded.indices.to_numpy(), table.column(4).combine_chunks().flatten().to_numpy())
    kept = df >= min_docs
    inside = kept[cells >> 32]
    cells, counts = cells[inside], counts[inside]
    first = np.searchsorted(cells >> 32, np.r_[np.flatnonzero(kept), len(df)])
    at = pa.array(heads[kept])
    names = coded.dictionary.cast(pa.large_string()).take(pa.array(cells & 0xFFFFFFFF))
    yield from _stripes(lang.take(at), term.take(at), df[kept], first, names, counts)


def merged(parts: DataFrame, min_docs: int) -> DataFrame:
    """One stripe for each (lang, term) in ``min_docs`` documents or more."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = (batch.column(0)[-1].as_py(), batch.column(1)[-1].as_py())
            cut = batch.num_rows - 1
            while cut and (batch.column(0)[cut - 1].as_py(), batch.column(1)[cut - 1].as_py()) == last:
                cut -= 1
            if cut or held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != last:
                done = [*held, batch[:cut]]
                yield from _merge(pa.Table.from_batches([x.cast(STRIPE_ARROW) for x in done if x.num_rows]), min_docs)
                held = []
            held.append(batch[cut:])  # its key may go on in the next batch
        if held:
            yield from _merge(pa.Table.from_batches([x.cast(STRIPE_ARROW) for x in held]), min_docs)

    dealt = parts.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return arrow_map(dealt, merge, STRIPE)


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), for count < total, without leaving 64 bits."""
    rest, out = count + 1, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def _emit(stripe: pa.Table, totals: pa.Table, top: int, numbers: int) -> Iterator[tuple[str, str, str, str, int]]:
    """(lang, source, part, item, value) of one block of terms."""
    by_lang: dict[str, list[tuple[str, int, int]]] = {}
    for row in totals.select(["lang", "source", "n", "v", "bucket"]).to_pylist():
        by_lang.setdefault(row["lang"], []).append((row["source"], row["n"], row["v"]))
        bucket = row["bucket"]
    langs = stripe.column("lang").to_pylist()
    rows_of: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        rows_of.setdefault(lang, []).append(i)
    for lang, groups in by_lang.items():
        own = stripe.take(pa.array(rows_of[lang])) if lang in rows_of else stripe[:0]
        if not len(own) and bucket:
            continue
        groups.sort()
        names, v = [g[0] for g in groups], groups[0][2]
        place = {s: i for i, s in enumerate(names)}
        n = np.array([g[1] for g in groups], np.int64)
        pairs = np.zeros((len(names), len(names)), np.int64)
        best: list[list[tuple[int, str]]] = [[] for _ in names]
        step = max(1, numbers // len(names))
        for a in range(0, len(own), step):
            part = own[a:a + step].combine_chunks()
            terms = part.column("term").to_pylist()
            lists = part.column("sources").combine_chunks()
            count = np.zeros((len(terms), len(names)), np.int64)
            row = np.repeat(np.arange(len(terms)), np.diff(lists.offsets.to_numpy()))
            count[row, [place[s] for s in lists.flatten().to_pylist()]] = part.column("counts").combine_chunks().flatten().to_numpy()
            p = share(count, (n + v)[None, :])
            q = share(count.sum(axis=1), n.sum() + v)
            for g in range(len(names)):
                d = p[:, g, None] - p
                pairs[g] += (d * d // p).sum(axis=0)
                more = np.flatnonzero((count[:, g] > 0) & (p[:, g] > q))
                f = (p[more, g] - q[more]) ** 2 // q[more]
                if len(more) > top:
                    enough = f >= np.partition(f, -top)[-top]
                    more, f = more[enough], f[enough]
                best[g] = sorted([*best[g], *((-x, terms[i]) for x, i in zip(f.tolist(), more.tolist(), strict=True))])[:top]
        for g, source in enumerate(names):
            for h, other in enumerate(names):
                if g != h:
                    yield lang, source, "pair", other, int(pairs[g, h])
            for value, term in best[g]:
                yield lang, source, "term", term, -value


EMITTED = "lang string, source string, part string, item string, value long"


def divergences(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    docs = docs.select(*text, "text")
    kept = written(merged(stripes(docs), min_docs))
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e"))
    n = each.groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("n"))
    v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = docs.select("lang", "source").distinct().join(n, ["lang", "source"], "left").join(v, "lang", "left")
    totals = groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
    entries = kept.agg(F.coalesce(F.sum(F.size("sources")), F.lit(0))).first()[0]
    blocks = max(MIN_BLOCKS, -(-entries // BLOCK_ENTRIES))

    numbers = TABLE_NUMBERS

    def emit(stripe: pa.Table, totals: pa.Table) -> pa.Table:
        rows = list(_emit(stripe, totals, top, numbers)) if len(totals) else []
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.string()] * 4 + [pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "source", "part", "item", "value"])

    ship_package(docs.sparkSession)
    left = kept.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")).groupBy("bucket")
    right = totals.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("bucket")
    emitted = written(left.cogroup(right).applyInArrow(emit, EMITTED))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = emitted.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = emitted.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.union(terms)
