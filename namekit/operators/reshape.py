"""Pivots and unpivots."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID, ENG, ALIAS, LANG, TYPE = "wikidata_id", "eng", "alias", "language", "type"


def pivot_names(names: DataFrame, languages: Sequence[str],
                index: Sequence[str] = (ID, TYPE, ENG)) -> DataFrame:
    """One row per (id, type, eng), one column per language ('' if none).

    Languages are passed explicitly (no extra job to find them); duplicates
    of (index, language) resolve to the greatest alias, so the result does
    not depend on row order.
    """
    q = names.filter(F.col(ID).startswith("Q"))
    wide = q.groupBy(*index).pivot(LANG, list(languages)).agg(F.max(ALIAS))
    return wide.na.fill("", list(languages))


def assert_no_null_language(names: DataFrame) -> DataFrame:
    """Rows with a null language (empty when the invariant holds)."""
    return names.filter(F.col(LANG).isNull())


def compare_languages(names: DataFrame, a: str, b: str, languages: Sequence[str] | None = None) -> DataFrame:
    """Per (id, type): eng, the alias in every language (a column each), url and equality flags of ``a`` and
    ``b`` (false where a side is missing). ``languages``: the columns; by default all languages of the names, which one
    job lists."""
    from .clean import ENTITY_URL_PREFIX
    if languages is None:
        languages = sorted(r[0] for r in names.select(LANG).distinct().collect() if r[0] is not None)
    columns = [*languages, *(x for x in (a, b) if x not in languages)]
    g = names.groupBy(ID, TYPE).agg(F.max(ENG).alias(ENG), *[F.max(F.when(F.col(LANG) == x, F.col(ALIAS))).alias(x) for x in columns])
    return g.select(ID, TYPE, ENG, *[F.col(f"`{x}`") for x in columns],
                    F.concat(F.lit(ENTITY_URL_PREFIX), F.col(ID)).alias("url"),
                    F.coalesce(F.col(f"`{a}`") == F.col(ENG), F.lit(False)).alias(f"{a}_is_eng"),
                    F.coalesce(F.col(f"`{b}`") == F.col(ENG), F.lit(False)).alias(f"{b}_is_eng"),
                    F.coalesce(F.col(f"`{a}`") == F.col(f"`{b}`"), F.lit(False)).alias(f"{a}_is_{b}"))


def type_counts_wide(counts: DataFrame, top: int | None = None,
                     types: Sequence[str] = ("LOC", "ORG", "PER")) -> DataFrame:
    """I4: language x type counts (0 filled), sorted by total, top n."""
    w = counts.groupBy(LANG).pivot(TYPE, list(types)).agg(F.sum("count")).na.fill(0, list(types))
    w = w.withColumn("total", sum(F.col(t) for t in types)).orderBy(F.desc("total"), LANG)
    return w.limit(top) if top else w


def comparison_table(names: DataFrame, entity: str, languages: Sequence[str]) -> DataFrame:
    """One entity's English name and its aliases in chosen languages."""
    sub = names.filter((F.col(ID) == entity) & F.col(LANG).isin(list(languages)))
    return (sub.groupBy(ID).pivot(LANG, list(languages))
            .agg(F.max(ALIAS))
            .join(sub.groupBy(ID).agg(F.max(ENG).alias("English")), on=ID))


def wide_to_long(df: DataFrame, key: str, value_cols: Sequence[str], prefix: str = "F1_",
                 value_name: str = "F1", var_name: str = "conll_type") -> DataFrame:
    """E.g. (Language, F1_LOC, F1_PER, F1_ORG) -> (language, F1, conll_type)."""
    long = df.unpivot([key], list(value_cols), var_name, value_name)
    return long.select(F.col(key).alias("language"), value_name,
                       F.regexp_replace(F.col(var_name), "^" + prefix, "").alias(var_name))
