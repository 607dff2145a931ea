"""Evaluation of transliteration outputs and of the filters (K1-K7).

Rows are (language, reference, hypothesis[, source]). Every metric is a
grouped aggregate; ``metrics_by_language`` computes all languages and the
``global`` row in one GROUPING SETS pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distance import list_distance, text_distance, word_error_rate
from ..functions.text import tokens
from ..session import ship_package
from .common import with_global

LANG, REF, HYP = "language", "reference", "hypothesis"
#: Tokens that are counted together.
TOKENS = 1 << 20

def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_accuracy(ref, hyp) -> Column:
    """K1 per row: 1 if equal else 0 (average * 100 for the metric)."""
    return (_c(ref) == _c(hyp)).cast("double")


def lcs_f1(ref, hyp) -> Column:
    """K2: lcs = (len a + len b - Levenshtein) / 2; P = lcs/len(ref),
    R = lcs/len(hyp); F1, 0 when undefined."""
    from ..functions.script import _let
    r, h = _c(ref), _c(hyp)

    # lengths and distance are bound once; every ratio uses them again
    def f1(p):
        lcs = (p["r"] + p["h"] - p["d"]) / 2.0
        rec = F.coalesce(F.try_divide(lcs, p["h"]), F.lit(0.0))
        prec = F.coalesce(F.try_divide(lcs, p["r"]), F.lit(0.0))
        return _let(F.struct(rec.alias("rec"), prec.alias("prec")), lambda q: F.coalesce(
            F.try_divide(2 * q["rec"] * q["prec"], q["rec"] + q["prec"]), F.lit(0.0)))
    return _let(F.struct(F.length(r).alias("r"), F.length(h).alias("h"), text_distance(r, h).alias("d")), f1)


def token_edit_distance(ref_tokens: Column, hyp_tokens: Column) -> Column:
    """Edit distance between two token lists."""
    return list_distance(ref_tokens, hyp_tokens)


def label_error_rate(ref, hyp, unit: str = "word") -> Column:
    """K3 per row: edit distance / reference length in words (or chars)."""
    r, h = _c(ref), _c(hyp)
    if unit == "char":
        return F.try_divide(text_distance(r, h).cast("double"), F.length(r))
    return word_error_rate(r, h)


def _ngrams(toks: Column, n: int) -> Column:
    idx = F.sequence(F.lit(1), F.size(toks) - n + 1)
    return F.when(F.size(toks) >= n, F.transform(idx, lambda i: F.array_join(F.slice(toks, i, n), " "))) \
        .otherwise(F.array().cast("array<string>"))


def clipped_matches(hyp: Column, ref: Column) -> Column:
    """Elements that two arrays have in common, with their numbers: the size of the multiset intersection. The
    distinct common ones count once each; only those that both arrays repeat are counted, in sorted arrays."""
    from ..functions.script import _let
    repeated = lambda x: F.array_distinct(F.filter(x, lambda v, i: (i > 0) & (v == F.element_at(x, F.greatest(i, F.lit(1))))))
    number = lambda x, v: F.size(x) + 2 - F.array_position(x, v) - F.array_position(F.reverse(x), v)

    def more(p):
        both = F.array_intersect(repeated(p["h"]), repeated(p["r"]))
        return F.aggregate(both, F.lit(0).cast("long"), lambda n, v: n + F.least(number(p["h"], v), number(p["r"], v)) - 1)
    common = F.size(F.array_intersect(hyp, ref))
    plain = (F.size(F.array_distinct(hyp)) == F.size(hyp)) | (F.size(F.array_distinct(ref)) == F.size(ref))
    return (common + F.when(plain, F.lit(0)).otherwise(_let(F.struct(F.array_sort(hyp).alias("h"), F.array_sort(ref).alias("r")), more))).cast("long")


def bleu_row_stats(ref, hyp) -> Column:
    """Struct of per-row BLEU sufficient statistics: clipped n-gram matches c1..c4, hypothesis n-gram totals
    t1..t4 and lengths, all inside the row, so that no n-gram is moved; the corpus statistics are plain sums. The
    form for single rows; ``bleu_stats`` counts the same for a batch of rows at a time."""
    from ..functions.script import _let

    def stats(p):
        r, h = p["r"], p["h"]
        counts = []
        for n in range(1, 5):
            total = F.greatest(F.size(h) - n + 1, F.lit(0)).cast("long")
            match = _let(F.struct((h if n == 1 else _ngrams(h, n)).alias("x"), (r if n == 1 else _ngrams(r, n)).alias("y")),
                         lambda g: clipped_matches(g["x"], g["y"]))
            counts += [F.when(r == h, total).otherwise(match).alias(f"c{n}"), total.alias(f"t{n}")]
        return F.struct(*counts, F.size(h).cast("long").alias("hyp_len"), F.size(r).cast("long").alias("ref_len"))
    toks = lambda c: F.coalesce(tokens(_c(c)), F.array().cast("array<string>"))
    return _let(F.struct(toks(ref).alias("r"), toks(hyp).alias("h")), stats)


_BLEU_SUMS = [f"{k}{n}" for n in range(1, 5) for k in ("c", "t")] + ["hyp_len", "ref_len"]


def _batch_counts(ref: pa.Array, hyp: pa.Array) -> list[np.ndarray]:
    """``_BLEU_SUMS`` of every row of two columns of token lists. An n-gram's number stands for its row and its words:
    it comes from the number of the (n-1)-gram before its last token, and of that token. Only n-grams of both sides
    are made longer."""
    size = [x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (hyp, ref)]
    rows, lengths = len(hyp), np.concatenate(size)
    words = pa.concat_arrays([hyp.flatten(), ref.flatten()]).dictionary_encode()
    row = np.repeat(np.tile(np.arange(rows), 2), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(row))  # tokens from here to the end of the text
    is_hyp = np.arange(len(row)) < size[0].sum()
    numbers, first = np.unique(row * (len(words.dictionary) + 1) + words.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    at, gram, out = np.arange(len(row)), first, []
    for n in range(1, 5):
        if n > 1:
            go = (both[gram] > 0) & (left[at] >= n)
            at = at[go]
            gram = np.unique(gram[go] * len(numbers) + first[at + n - 1], return_inverse=True)[1]
        h = is_hyp[at]
        k = int(gram.max(initial=-1)) + 1
        both = np.minimum(np.bincount(gram[h], minlength=k), np.bincount(gram[~h], minlength=k))
        owner = np.zeros(k, np.int64)
        owner[gram] = row[at]
        out += [np.bincount(owner, both, rows).astype(np.int64), np.maximum(size[0] - n + 1, 0)]
    return out + size


def _batch_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of keys, reference and hypothesis tokens -> keys and ``_BLEU_SUMS``, some ``TOKENS`` at a time."""
    for batch in batches:
        ref, hyp = batch.columns[-2:]
        ends = np.cumsum(sum(x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (ref, hyp)))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOKENS, "right")))
            counts = _batch_counts(ref.slice(a, b - a), hyp.slice(a, b - a))
            keys = [c.slice(a, b - a) for c in batch.columns[:-2]]
            yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, counts)], names=[*batch.schema.names[:-2], *_BLEU_SUMS])
            a = b


def _text_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_batch_stats`` of texts, whose words are what white space separates, as in ``tokens``; a null text has none."""
    words = lambda texts: pa.array([[] if x is None else x.split() for x in texts.to_pylist()], pa.list_(pa.string()))
    return _batch_stats(pa.RecordBatch.from_arrays([*b.columns[:-2], *map(words, b.columns[-2:])], names=b.schema.names) for b in batches)


def bleu_stats(outputs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per group: summed clipped matches c1..c4, totals t1..t4 and lengths. N-grams are counted inside the tasks, a
    batch of rows at a time, and not moved; the work grows with the tokens."""
    keys = keys or []
    ship_package(outputs.sparkSession)
    rows = outputs.select(*keys, _c(REF).alias("_r"), _c(HYP).alias("_h"))
    schema = T.StructType([*rows.schema.fields[:-2], *[T.StructField(c, T.LongType()) for c in _BLEU_SUMS]])
    return rows.mapInArrow(_text_stats, schema).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _BLEU_SUMS])


def bleu_from_stats(sums: DataFrame, keys: list[str] | None = None, max_n: int = 4) -> DataFrame:
    """Corpus BLEU (0-100) with brevity penalty and exponential smoothing of
    zero n-gram precisions (the k-th zero precision becomes 1 / (2^k total))."""
    keys = keys or []
    logs = []
    k = F.lit(0)
    for n in range(1, max_n + 1):
        c, t = F.coalesce(F.col(f"c{n}"), F.lit(0)), F.coalesce(F.col(f"t{n}"), F.lit(0))
        k = k + F.when((c == 0) & (t > 0), 1).otherwise(0)
        p = F.when(t == 0, F.lit(None)).when(c == 0, 1.0 / (F.pow(F.lit(2.0), k) * t)).otherwise(c / t)
        logs.append(F.log(p))
    mean_log = sum(logs) / max_n
    hl, rl = F.col("hyp_len"), F.col("ref_len")
    bp = F.when(hl == 0, F.lit(0.0)).when(hl < rl, F.exp(1 - rl / hl)).otherwise(1.0)
    return sums.select(*keys, F.coalesce(100 * bp * F.exp(mean_log), F.lit(0.0)).alias("bleu"))


def corpus_bleu(outputs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """K4: corpus BLEU (whitespace tokens, 4-grams) per ``keys`` group."""
    return bleu_from_stats(bleu_stats(outputs, keys), keys)


def metrics_by_language(outputs: DataFrame, digits: int = 5, with_ler: bool = True) -> DataFrame:
    """K5: per language and ``global``: LER, word accuracy/error, mean F1, BLEU."""
    row = outputs.select(LANG, REF, HYP, word_accuracy(REF, HYP).alias("_acc"),
                         lcs_f1(REF, HYP).alias("_f1"),
                         (label_error_rate(REF, HYP) if with_ler else F.lit(None).cast("double")).alias("_ler"))
    agg = [F.avg("_ler").alias("label_error_rate"), (100 * F.avg("_acc")).alias("word_acc"),
           (100 * F.avg("_f1")).alias("mean_f1")]
    basic = with_global(row, LANG, agg)
    # BLEU sufficient statistics are additive: the global row sums the
    # per-language ones, in one plan that counts n-grams once
    sums = with_global(bleu_stats(outputs, [LANG]), LANG, [F.sum(c).alias(c) for c in _BLEU_SUMS])
    out = basic.join(bleu_from_stats(sums, [LANG]), on=LANG, how="left")
    r = lambda c: F.round(c, digits)
    return out.select(LANG, r(F.col("label_error_rate")).alias("label_error_rate"),
                      r(F.col("word_acc")).alias("word_acc"), r(100 - F.col("word_acc")).alias("word_err"),
                      r(F.col("mean_f1")).alias("mean_f1"), r(F.col("bleu")).alias("bleu"))


def metrics_table(metrics: DataFrame) -> DataFrame:
    """K5 as a table: Language, CER, Accuracy and F1, rounded to 3 digits."""
    return metrics.select(F.col(LANG).alias("Language"), F.round("label_error_rate", 3).alias("CER"),
                          F.round("word_acc", 3).alias("Accuracy"), F.round("mean_f1", 3).alias("F1"))


def _prf(tp, fp, fn, tn):
    acc = F.coalesce(F.try_divide(tp + tn, tp + fp + fn + tn), F.lit(0.0))
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return acc, prec, rec, f1


def filter_quality(gold: DataFrame, removed: DataFrame, key: str = "wikidata_id",
                   digits: int = 6) -> DataFrame:
    """K6: accuracy / precision / recall / F1 of the removed ids against gold
    (``should_remove`` per (language, id)), per language and ``global``."""
    r = removed.select(key, LANG).distinct().withColumn("_rm", F.lit(True))
    j = gold.join(r, on=[key, LANG], how="left").withColumn("_pred", F.coalesce(F.col("_rm"), F.lit(False)))
    t, p = F.col("should_remove"), F.col("_pred")
    agg = [F.sum((t & p).cast("long")).alias("tp"), F.sum((~t & p).cast("long")).alias("fp"),
           F.sum((t & ~p).cast("long")).alias("fn"), F.sum((~t & ~p).cast("long")).alias("tn")]
    c = with_global(j, LANG, agg)
    acc, prec, rec, f1 = _prf(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    r6 = lambda x: F.round(x, digits)
    return c.select(LANG, r6(acc).alias("accuracy"), r6(prec).alias("precision"),
                    r6(rec).alias("recall"), r6(f1).alias("f1"))


def reorder_quality(gold: DataFrame, final: DataFrame, key: str = "wikidata_id",
                    digits: int = 6) -> DataFrame:
    """K7: accuracy and mean F1 of the final aliases against gold aliases,
    joined on (language, id); gold keys must be unique."""
    g = gold.select(LANG, key, F.col("alias").alias(REF))
    f = final.select(LANG, key, F.col("alias").alias(HYP))
    j = g.join(f, on=[LANG, key], how="inner")
    agg = [F.round(100 * F.avg(word_accuracy(REF, HYP)), digits).alias("accuracy"),
           F.round(100 * F.avg(lcs_f1(REF, HYP)), digits).alias("mean_f1")]
    return with_global(j, LANG, agg)
