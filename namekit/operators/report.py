"""Counts and reports over the name table.

All reports are grouped aggregates with map-side partial aggregation; results
have one row per language / type / bin, so the final sorts are on small data.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import measured_side, with_global

ID, ENG, ALIAS, LANG, TYPE = "wikidata_id", "eng", "alias", "language", "type"
TYPE_ORDER = ["LOC", "ORG", "PER"]


def counts_per_language_and_type(names: DataFrame) -> DataFrame:
    """(language, type, count), non-empty language, count descending."""
    return (names.filter(F.length(LANG) > 0)
            .groupBy(LANG, TYPE).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), LANG, TYPE))


def counts_per_language(names: DataFrame, top: int | None = None) -> DataFrame:
    """Rows per language, descending (optionally the top n)."""
    out = (names.groupBy(LANG).agg(F.count(F.lit(1)).alias("count"))
           .orderBy(F.desc("count"), LANG))
    return out.limit(top) if top else out


def corpus_totals(names: DataFrame, approximate: bool = False) -> DataFrame:
    """Total names, unique ids, unique aliases, languages."""
    cd = (lambda c: F.approx_count_distinct(c)) if approximate else (lambda c: F.countDistinct(c))
    return names.agg(F.count(F.lit(1)).alias("n_names"), cd(ID).alias("n_ids"),
                     cd(ALIAS).alias("n_aliases"), cd(LANG).alias("n_languages"))


def english_match(names: DataFrame, per_language: bool = True) -> DataFrame:
    """Rows whose alias equals the English name: count, total, percent
    (rounded to 2), per language plus a ``global`` row."""
    eq = (F.col(ALIAS) == F.col(ENG)).cast("long")
    aggs = [F.sum(eq).alias("n_equal"), F.count(F.lit(1)).alias("n_rows"),
            F.round(100 * F.avg(eq), 2).alias("pct_equal")]
    if not per_language:
        return names.agg(*aggs).select(F.lit("global").alias(LANG), "*")
    return with_global(names, LANG, aggs)


def _length_category() -> F.Column:
    d = F.length(ALIAS) - F.length(ENG)
    return F.when(d == 0, "equal").when(d < 0, "shorter").otherwise("longer")


def length_comparison(names: DataFrame) -> DataFrame:
    """Among alias != eng, equal / shorter / longer counts and percent."""
    ne = names.filter(F.col(ALIAS) != F.col(ENG)).select(_length_category().alias("alias_category"))
    c = ne.groupBy("alias_category").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def containment(names: DataFrame) -> DataFrame:
    """Counts by (length category, eng contains alias, alias contains eng)."""
    ne = names.filter(F.col(ALIAS) != F.col(ENG))
    return (ne.select(_length_category().alias("alias_category"),
                      F.col(ENG).contains(F.col(ALIAS)).alias("eng_contains_alias"),
                      F.col(ALIAS).contains(F.col(ENG)).alias("alias_contains_eng"))
            .groupBy("alias_category", "eng_contains_alias", "alias_contains_eng")
            .agg(F.count(F.lit(1)).alias("n")))


def summary_table(counts: DataFrame, entropy: DataFrame, match: DataFrame,
                  lookup: DataFrame, n: int | None = None) -> DataFrame:
    """Per language: long name, formatted counts, entropy, English match %.

    ``counts`` = J2, ``entropy`` = D19, ``match`` = J4 (per language). All
    inputs have one row per language.
    """
    from .clean import add_language_name
    t = counts.join(entropy.select(F.col("language_code").alias(LANG), "script_entropy"),
                    on=LANG, how="left")
    # from the counts: the percentage of J4 has only two digits left
    share = F.round(100 * F.col("n_equal") / F.col("n_rows"), 3)
    t = t.join(match.select(LANG, F.concat(share.cast("string"), F.lit("%")).alias("english_match")), on=LANG, how="left")
    t = add_language_name(t, lookup, LANG, "language_long")
    t = t.select(LANG, "language_long", "count",
                 F.format_number(F.col("count"), 0).alias("n_names"),
                 "script_entropy", "english_match")
    t = t.orderBy(F.desc("count"), LANG)
    return t.limit(n) if n else t


def top_entropy(entropy: DataFrame, n: int = 10) -> DataFrame:
    """Top n languages by script entropy."""
    return entropy.orderBy(F.desc("script_entropy"), "language_code").limit(n)


def equal_width_histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """(bin, lower, upper, n) over [min, max] of ``col``; last bin closed."""
    # the range is one scalar pair: fetched with a small job, then used as literals
    lo, hi = df.agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n bigint")
    width = (hi - lo) / bins
    if hi == lo:
        b = F.lit(0)
    else:
        b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return (df.select(b.alias("bin"))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
            .select("bin",
                    F.round(F.lit(lo) + F.col("bin") * F.lit(width), 6).alias("lower"),
                    F.round(F.lit(lo) + (F.col("bin") + 1) * F.lit(width), 6).alias("upper"),
                    "n"))


def entropy_histogram(entropy: DataFrame, bins: int = 20, top: int | None = None,
                      threshold: float = 0.1, pruned: bool = False) -> DataFrame:
    """Binned counts of script entropy (top n, optionally >= threshold)."""
    e = entropy
    if top:
        e = top_entropy(e, top)
    if pruned:
        e = e.filter(F.col("script_entropy") >= threshold)
    return equal_width_histogram(e, "script_entropy", bins)


def most_diverse_entities(names: DataFrame, n: int = 10) -> DataFrame:
    """Ids with the most distinct aliases (top n)."""
    return (names.groupBy(ID).agg(F.countDistinct(ALIAS).alias("n_aliases"))
            .orderBy(F.desc("n_aliases"), ID).limit(n))


def names_per_entity_histogram(names: DataFrame, bins: int = 10) -> DataFrame:
    """Counts of names per id in equal-width bins."""
    per = names.groupBy(ID).agg(F.count(F.lit(1)).alias("n_names"))
    return equal_width_histogram(per, "n_names", bins)


def with_summary_rows(table: DataFrame, key: str, value_cols: Sequence[str],
                      digits: int = 0) -> DataFrame:
    """The table plus rounded ``Average`` and ``Median`` rows."""
    avg = table.agg(*[F.round(F.avg(c), digits).alias(c) for c in value_cols])
    med = table.agg(*[F.round(F.median(c), digits).alias(c) for c in value_cols])
    base = table.select(key, *[F.col(c).cast("double").alias(c) for c in value_cols])
    return (base.unionByName(avg.select(F.lit("Average").alias(key), *value_cols))
            .unionByName(med.select(F.lit("Median").alias(key), *value_cols)))


def types_per_language(names: DataFrame, lookup: DataFrame,
                       wiki_languages: DataFrame | None = None) -> DataFrame:
    """Per language: LOC/ORG/PER counts, Total, English overlap (%) and
    Has Wikipedia (language long name in ``wiki_languages(name)``)."""
    from .clean import add_language_name
    wide = (names.groupBy(LANG).pivot(TYPE, TYPE_ORDER).agg(F.count(F.lit(1)))
            .na.fill(0, TYPE_ORDER))
    wide = wide.withColumn("Total", sum(F.col(t) for t in TYPE_ORDER))
    eq = names.groupBy(LANG).agg(
        F.round(100 * F.round(F.avg((F.col(ALIAS) == F.col(ENG)).cast("double")), 3), 6)
        .alias("english_overlap_pct"))
    t = wide.join(eq, on=LANG, how="inner")
    t = add_language_name(t, lookup, LANG, "language_name")
    if wiki_languages is not None:
        w = wiki_languages.select(F.col("name").alias("_w")).distinct()
        t = (t.join(measured_side(w), F.col("language_name") == F.col("_w"), "left")
             .withColumn("has_wikipedia", F.col("_w").isNotNull()).drop("_w"))
    else:
        t = t.withColumn("has_wikipedia", F.lit(False))
    return t.select("language_name", F.col(LANG).alias("language_code"), "has_wikipedia",
                    *TYPE_ORDER, "Total", "english_overlap_pct")


def languages_without_names(lookup: DataFrame, names: DataFrame) -> DataFrame:
    """Codes of the lookup that have no names."""
    return lookup.join(names.select(F.col(LANG).alias("code")).distinct(), on="code",
                       how="left_anti")


def non_english_share(names: DataFrame, languages: Iterable[str] | None = None) -> DataFrame:
    """Per language, mean of (eng != alias or eng = id)."""
    n = names if languages is None else names.filter(F.col(LANG).isin(list(languages)))
    flag = ((F.col(ENG) != F.col(ALIAS)) | (F.col(ENG) == F.col(ID))).cast("double")
    return n.groupBy(LANG).agg(F.round(F.avg(flag), 6).alias("non_english_share"))


def f1_vs_train_size(f1: DataFrame, counts: DataFrame, key: str = LANG) -> DataFrame:
    """F1 rows joined to the training counts."""
    return f1.join(counts, on=key, how="inner")


def rank_by_count(counts: DataFrame, n: str = "count", key: str = LANG) -> DataFrame:
    """Zipf rank: languages by count descending.

    A global ``row_number`` needs one ordered partition; its input is one row
    per language, so it is small.
    """
    w = Window.orderBy(F.desc(n), F.col(key))
    return counts.withColumn("rank", F.row_number().over(w).cast("long"))
