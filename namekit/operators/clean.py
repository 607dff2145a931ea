"""Projection, filtering and cleaning of the name table."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import measured_side

from ..functions.text import strip_parenthesis, unicode_strip

ID, ENG, ALIAS, LANG, TYPE = "wikidata_id", "eng", "alias", "language", "type"

# Type-combination rules of entity disambiguation.
DISAMBIGUATION_RULES = {
    "LOC-ORG": "LOC",
    "LOC-ORG-PER": "ORG",
    "ORG-PER": "ORG",
    "LOC-PER": "PER",
}

ENTITY_URL_PREFIX = "https://www.wikidata.org/wiki/"


def keep_item_ids(names: DataFrame, id_col: str = ID) -> DataFrame:
    """Only item ids (``Q...``); property ids are dropped."""
    return names.filter(F.col(id_col).startswith("Q"))


def rename_english(names: DataFrame, src: str = "name", dst: str = ENG) -> DataFrame:
    """C2."""
    return names.withColumnRenamed(src, dst)


def language_counts(names: DataFrame, lang_col: str = LANG) -> DataFrame:
    return names.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n"))


def keep_above_threshold(names: DataFrame, m: int, lang_col: str = LANG) -> DataFrame:
    """Languages with at least ``m`` rows (no-op when m <= 0).

    The languages to keep are counted first; the names are not moved by language.
    """
    if m <= 0:
        return names
    big = language_counts(names, lang_col).filter(F.col("n") >= m).select(lang_col)
    return names.join(measured_side(big), on=lang_col, how="left_semi")


def dropped_languages(names: DataFrame, m: int, lang_col: str = LANG) -> DataFrame:
    """C4: (language, n) of the languages removed by C3."""
    return language_counts(names, lang_col).filter(F.col("n") < m)


def _rules_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in DISAMBIGUATION_RULES.items() for x in kv])


def id_type_sets(names: DataFrame, id_col: str = ID, type_col: str = TYPE) -> DataFrame:
    """Per id: number of distinct types and their sorted '-' join.

    ``distinct`` first: the partial aggregation collapses a hot id to at most
    a handful of (id, type) rows before the shuffle.
    """
    return (names.select(id_col, type_col).distinct()
            .groupBy(id_col)
            .agg(F.count(F.lit(1)).alias("n_types"),
                 F.array_join(F.sort_array(F.collect_list(type_col)), "-").alias("types")))


def disambiguate_types(names: DataFrame, id_col: str = ID, type_col: str = TYPE,
                       rules: dict | None = None) -> DataFrame:
    """One type per entity following the combination rules.

    Combinations without a rule keep their old types. Exact duplicate rows
    are dropped only when at least one id is ambiguous (as the reference).
    """
    rmap = _rules_map() if rules is None else F.create_map(
        *[F.lit(x) for kv in rules.items() for x in kv])
    sets = id_type_sets(names, id_col, type_col).filter(F.col("n_types") > 1)
    canon = sets.select(id_col, F.element_at(rmap, F.col("types")).alias("_canon"))
    if not canon.limit(1).count():          # one small job: is anything ambiguous?
        return names
    cols = names.columns
    out = (names.join(canon, on=id_col, how="left")
           .withColumn(type_col, F.coalesce(F.col("_canon"), F.col(type_col)))
           .select(*cols))
    return out.dropDuplicates()


def assert_single_type(names: DataFrame, id_col: str = ID, type_col: str = TYPE) -> DataFrame:
    """Ids violating "one type per id" (empty when the invariant holds)."""
    return id_type_sets(names, id_col, type_col).filter(F.col("n_types") > 1)


def remove_parentheses(names: DataFrame, cols: Sequence[str] = (ENG, ALIAS)) -> DataFrame:
    """Greedy parenthesis removal + strip on ``eng`` and ``alias``."""
    for c in cols:
        names = names.withColumn(c, strip_parenthesis(F.col(c)))
    return names


def drop_blank_or_untranslated(names: DataFrame, text_col: str = ALIAS,
                               eng_col: str = ENG, id_col: str = ID,
                               require_english: bool = True) -> DataFrame:
    """Non-blank text and (optionally) an English label other than the id."""
    cond = unicode_strip(F.col(text_col)) != ""
    if require_english:
        cond = cond & (F.col(eng_col) != F.col(id_col))
    return names.filter(cond)


def drop_empty_labels(names: DataFrame, col: str = ALIAS) -> DataFrame:
    """C9."""
    return names.filter(F.col(col) != "")


def keep_languages(names: DataFrame, langs: Iterable[str], lang_col: str = LANG) -> DataFrame:
    """C10 (inclusion list)."""
    return names.filter(F.col(lang_col).isin(list(langs)))


def drop_languages(names: DataFrame, langs: Iterable[str], lang_col: str = LANG) -> DataFrame:
    """C10 (exclusion list). A row without a language is in no list and stays."""
    return names.filter(~F.coalesce(F.col(lang_col).isin(list(langs)), F.lit(False)))


def search(names: DataFrame, col: str, regex: str) -> DataFrame:
    """C11: unanchored regular-expression row filter."""
    return names.filter(F.col(col).rlike(regex))


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Absent columns are ignored."""
    return df.drop(*[c for c in cols if c in df.columns])


def keep_nonempty(df: DataFrame, col: str = LANG) -> DataFrame:
    """C13."""
    return df.filter(F.length(F.col(col)) > 0)


def entity_url(df: DataFrame, id_col: str = ID, out: str = "url") -> DataFrame:
    """C14."""
    return df.withColumn(out, F.concat(F.lit(ENTITY_URL_PREFIX), F.col(id_col)))


def add_language_name(df: DataFrame, lookup: DataFrame, code_col: str = LANG,
                      out: str = "language_long") -> DataFrame:
    """Long language name from a (code, name) lookup, code as fallback.

    The lookup has one row per language code, so it is a bounded table and is
    broadcast.
    """
    lk = lookup.select(F.col("code").alias("_code"), F.col("name").alias("_name"))
    joined = df.join(measured_side(lk), F.col(code_col) == F.col("_code"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_name"), F.col(code_col))).drop("_code", "_name")


def drop_flagged_languages(names: DataFrame, decisions: DataFrame,
                           lang_col: str = LANG) -> DataFrame:
    """Remove languages whose decision row says ``should_drop``."""
    flagged = (decisions.filter(F.col("should_drop"))
               .select(F.col("language_code").alias(lang_col)).distinct())
    return names.join(measured_side(flagged), on=lang_col, how="left_anti")


def distinct_aliases(names: DataFrame, col: str = ALIAS) -> DataFrame:
    """C17: sorted unique aliases."""
    return names.select(col).distinct().orderBy(col)


def sort_names(names: DataFrame, cols: Sequence[str] = (LANG,)) -> DataFrame:
    """Total order (all columns break ties) before a sink."""
    rest = [c for c in names.columns if c not in cols]
    return names.orderBy(*cols, *rest)
