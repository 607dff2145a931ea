"""Registered queries: cleaning (C), reports (J) and reshaping (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import report as J
from ..operators import reshape as I
from ..operators import script as D
from ..sources import tables as T
from . import oracle as O
from .registry import register

NAMES5 = "wikidata_id, eng, alias, language, type"
LANGS = ["de", "en", "es", "fr"]
THRESHOLD = 1500


def _names(spark, sf_dir, pos=False):
    return T.names(spark, sf_dir, pos)


def _lookup(spark):
    from .queries import language_lookup
    return language_lookup(spark)


# ------------------------------------------------------------------ C
@register("c1_keep_item_ids", O.with_names() +
          f"SELECT {NAMES5} FROM names WHERE starts_with(wikidata_id, 'Q')")
def q_c1(spark, d):
    return C.keep_item_ids(_names(spark, d))


@register("c2_rename_english", O.with_names() +
          "SELECT DISTINCT wikidata_id, eng FROM names")
def q_c2(spark, d):
    raw = _names(spark, d).withColumnRenamed("eng", "name")
    return C.rename_english(raw).select("wikidata_id", "eng").distinct()


@register("c3_keep_above_threshold", O.with_names() + f"""
SELECT {NAMES5} FROM names WHERE language IN
  (SELECT language FROM names GROUP BY language HAVING count(*) >= {THRESHOLD})""")
def q_c3(spark, d):
    return C.keep_above_threshold(_names(spark, d), THRESHOLD)


@register("c4_dropped_languages", O.with_names() + f"""
SELECT language, count(*) AS n FROM names GROUP BY language HAVING count(*) < {THRESHOLD}""")
def q_c4(spark, d):
    return C.dropped_languages(_names(spark, d), THRESHOLD)


DISAMBIG_SQL = """
types AS (
  SELECT wikidata_id, count(*) AS n_types, string_agg(type, '-' ORDER BY type) AS types
  FROM (SELECT DISTINCT wikidata_id, type FROM names) GROUP BY wikidata_id
),
rules(types, canon) AS (VALUES ('LOC-ORG', 'LOC'), ('LOC-ORG-PER', 'ORG'),
                               ('ORG-PER', 'ORG'), ('LOC-PER', 'PER')),
disamb AS (
  SELECT DISTINCT n.wikidata_id, n.eng, n.alias, n.language,
         coalesce(CASE WHEN t.n_types > 1 THEN r.canon END, n.type) AS type
  FROM names n JOIN types t USING (wikidata_id) LEFT JOIN rules r ON r.types = t.types
)"""


@register("c5_disambiguate_types", O.with_names(DISAMBIG_SQL) + f"SELECT {NAMES5} FROM disamb")
def q_c5(spark, d):
    return C.disambiguate_types(_names(spark, d))


@register("c6_ambiguous_ids", O.with_names(DISAMBIG_SQL) +
          "SELECT wikidata_id, n_types, types FROM types WHERE n_types > 1")
def q_c6(spark, d):
    return C.assert_single_type(_names(spark, d))


@register("c6_single_type_after_rules", O.with_names(DISAMBIG_SQL) + """
SELECT wikidata_id, count(*) AS n_types, string_agg(type, '-' ORDER BY type) AS types
FROM (SELECT DISTINCT wikidata_id, type FROM disamb) GROUP BY wikidata_id HAVING count(*) > 1""")
def q_c6b(spark, d):
    return C.assert_single_type(C.disambiguate_types(_names(spark, d)))


@register("c7_remove_parentheses", O.with_names() + f"""
SELECT wikidata_id, {O.strip_paren('eng')} AS eng, {O.strip_paren('alias')} AS alias, language, type
FROM names""")
def q_c7(spark, d):
    return C.remove_parentheses(_names(spark, d))


@register("c8_drop_blank_or_untranslated", O.with_names() + f"""
SELECT {NAMES5} FROM names WHERE {O.strip('alias')} <> '' AND eng <> wikidata_id""")
def q_c8(spark, d):
    return C.drop_blank_or_untranslated(_names(spark, d))


@register("c9_drop_empty_labels", O.with_names() + f"SELECT {NAMES5} FROM names WHERE alias <> ''")
def q_c9(spark, d):
    return C.drop_empty_labels(_names(spark, d))


@register("c10_keep_languages", O.with_names() +
          f"SELECT {NAMES5} FROM names WHERE language IN ('en', 'de')")
def q_c10a(spark, d):
    return C.keep_languages(_names(spark, d), ["en", "de"])


@register("c10_drop_languages", O.with_names() +
          f"SELECT {NAMES5} FROM names WHERE language NOT IN ('fr')")
def q_c10b(spark, d):
    return C.drop_languages(_names(spark, d), ["fr"])


SEARCH_RE = "(^| )the( |$)"


@register("c11_search", O.with_names() +
          f"SELECT {NAMES5} FROM names WHERE regexp_matches(alias, '{SEARCH_RE}')")
def q_c11(spark, d):
    return C.search(_names(spark, d), "alias", SEARCH_RE)


@register("c12_drop_columns", O.with_names() + "SELECT wikidata_id, eng, alias, language FROM names")
def q_c12(spark, d):
    return C.drop_columns(_names(spark, d), ["type", "not_a_column"])


@register("c13_keep_nonempty", O.with_names() +
          f"SELECT {NAMES5} FROM names WHERE length(alias) > 0")
def q_c13(spark, d):
    return C.keep_nonempty(_names(spark, d), "alias")


@register("c14_entity_url", O.with_names() + """
SELECT DISTINCT wikidata_id, 'https://www.wikidata.org/wiki/' || wikidata_id AS url FROM names""")
def q_c14(spark, d):
    return C.entity_url(_names(spark, d).select("wikidata_id").distinct())


@register("c15_add_language_name", O.with_names(O.language_lookup_sql()) + """
SELECT n.language, coalesce(l.name, n.language) AS language_long, n.n
FROM (SELECT language, count(*) AS n FROM names GROUP BY language) n
LEFT JOIN lookup l ON l.code = n.language""")
def q_c15(spark, d):
    return C.add_language_name(C.language_counts(_names(spark, d)), _lookup(spark),
                               "language", "language_long")


DECISIONS = [("es", "small, noisy", True), ("fr", "keep", False)]


@register("c16_drop_flagged_languages", O.with_names() + f"""
SELECT {NAMES5} FROM names WHERE language NOT IN ('es')""")
def q_c16(spark, d):
    dec = spark.createDataFrame(DECISIONS, "language_code string, comment string, should_drop boolean")
    return C.drop_flagged_languages(_names(spark, d), dec)


@register("c17_distinct_aliases", O.with_names() + "SELECT DISTINCT alias FROM names")
def q_c17(spark, d):
    return C.distinct_aliases(_names(spark, d))


@register("c18_sort_names", O.with_names() + f"SELECT {NAMES5} FROM names ORDER BY language, alias")
def q_c18(spark, d):
    return C.sort_names(_names(spark, d), ["language", "alias"])


# ------------------------------------------------------------------ J
@register("j1_counts_per_language_and_type", O.with_names() + """
SELECT language, type, count(*) AS count FROM names WHERE length(language) > 0
GROUP BY language, type""")
def q_j1(spark, d):
    return J.counts_per_language_and_type(_names(spark, d))


@register("j2_counts_per_language", O.with_names() +
          "SELECT language, count(*) AS count FROM names GROUP BY language")
def q_j2(spark, d):
    return J.counts_per_language(_names(spark, d))


@register("j3_corpus_totals", O.with_names() + """
SELECT count(*) AS n_names, count(DISTINCT wikidata_id) AS n_ids,
       count(DISTINCT alias) AS n_aliases, count(DISTINCT language) AS n_languages FROM names""")
def q_j3(spark, d):
    return J.corpus_totals(_names(spark, d))


@register("j4_english_match", O.with_names() + """
SELECT language, CAST(sum(CAST(alias = eng AS BIGINT)) AS BIGINT) AS n_equal, count(*) AS n_rows,
       round(100 * avg(CAST(alias = eng AS BIGINT)), 2) AS pct_equal FROM names GROUP BY language
UNION ALL
SELECT 'global', CAST(sum(CAST(alias = eng AS BIGINT)) AS BIGINT), count(*),
       round(100 * avg(CAST(alias = eng AS BIGINT)), 2) FROM names""")
def q_j4(spark, d):
    return J.english_match(_names(spark, d))


LEN_CAT = ("CASE WHEN length(alias) = length(eng) THEN 'equal' "
           "WHEN length(alias) < length(eng) THEN 'shorter' ELSE 'longer' END")


@register("j5_length_comparison", O.with_names() + f"""
SELECT alias_category, n, round(100 * n / sum(n) OVER (), 2) AS pct FROM (
  SELECT {LEN_CAT} AS alias_category, count(*) AS n FROM names WHERE alias <> eng GROUP BY 1)""")
def q_j5(spark, d):
    return J.length_comparison(_names(spark, d))


@register("j6_containment", O.with_names() + f"""
SELECT {LEN_CAT} AS alias_category, contains(eng, alias) AS eng_contains_alias,
       contains(alias, eng) AS alias_contains_eng, count(*) AS n
FROM names WHERE alias <> eng GROUP BY 1, 2, 3""")
def q_j6(spark, d):
    return J.containment(_names(spark, d))


def _entropy(spark, d):
    from .queries import cleaned_names, language_lookup
    return D.script_entropy(cleaned_names(spark, d), language_lookup(spark))


def _entropy_sql():
    from .queries import CLEANED_SQL
    return [CLEANED_SQL, O.language_lookup_sql(),
            O.char_rows("cleaned", "alias", "doc_id, line_no, language"),
            O.mode_rows("ch", "doc_id, line_no, language"),
            """cnt AS (SELECT language, block, count(*) AS n FROM md GROUP BY language, block)""",
            """pp AS (SELECT language, n * 1.0 / sum(n) OVER (PARTITION BY language) AS p FROM cnt)""",
            """entropy AS (
  SELECT pp.language AS language_code, coalesce(l.name, pp.language) AS language,
         round(-sum(p * log2(p)) + 0.0, 3) AS script_entropy
  FROM pp LEFT JOIN lookup l ON l.code = pp.language GROUP BY pp.language, l.name)"""]


@register("j7_summary_table", O.with_names(*_entropy_sql()) + """
, counts AS (SELECT language, count(*) AS count FROM names GROUP BY language)
, m AS (SELECT language, round(100 * avg(CAST(alias = eng AS BIGINT)), 3) AS pct_equal
        FROM names GROUP BY language)
SELECT c.language, coalesce(l.name, c.language) AS language_long, c.count,
       format('{:,}', c.count) AS n_names, e.script_entropy,
       CAST(m.pct_equal AS VARCHAR) || '%' AS english_match
FROM counts c LEFT JOIN entropy e ON e.language_code = c.language
LEFT JOIN m ON m.language = c.language LEFT JOIN lookup l ON l.code = c.language""")
def q_j7(spark, d):
    n = _names(spark, d)
    return J.summary_table(J.counts_per_language(n), _entropy(spark, d),
                           J.english_match(n), _lookup(spark))


@register("j8_top_entropy", O.with_names(*_entropy_sql()) +
          "SELECT * FROM entropy ORDER BY script_entropy DESC, language_code LIMIT 3")
def q_j8(spark, d):
    return J.top_entropy(_entropy(spark, d), 3)


def _hist_sql(src: str, col: str, bins: int) -> str:
    return f"""
, rng AS (SELECT min({col})::DOUBLE AS lo, max({col})::DOUBLE AS hi FROM {src})
, b AS (SELECT CASE WHEN hi = lo THEN 0 ELSE
          least(floor(({col} - lo) / ((hi - lo) / {bins})), {bins - 1})::INTEGER END AS bin, lo, hi
        FROM {src}, rng)
SELECT bin, round(lo + bin * (hi - lo) / {bins}, 6) AS lower,
       round(lo + (bin + 1) * (hi - lo) / {bins}, 6) AS upper, count(*) AS n
FROM b GROUP BY bin, lo, hi"""


@register("j9_entropy_histogram", O.with_names(*_entropy_sql()) + _hist_sql("entropy", "script_entropy", 20))
def q_j9(spark, d):
    return J.entropy_histogram(_entropy(spark, d), bins=20)


@register("j10_most_diverse_entities", O.with_names() + """
SELECT wikidata_id, count(DISTINCT alias) AS n_aliases FROM names GROUP BY wikidata_id
ORDER BY n_aliases DESC, wikidata_id LIMIT 10""")
def q_j10(spark, d):
    return J.most_diverse_entities(_names(spark, d), 10)


@register("j11_names_per_entity_histogram", O.with_names(
    "per AS (SELECT wikidata_id, count(*) AS n_names FROM names GROUP BY wikidata_id)")
    + _hist_sql("per", "n_names", 10))
def q_j11(spark, d):
    return J.names_per_entity_histogram(_names(spark, d), 10)


@register("j12_with_summary_rows", O.with_names(
    "c AS (SELECT language, count(*) AS count FROM names GROUP BY language)") + """
SELECT language, CAST(count AS DOUBLE) AS count FROM c
UNION ALL SELECT 'Average', round(avg(count)) FROM c
UNION ALL SELECT 'Median', round(median(count)) FROM c""")
def q_j12(spark, d):
    return J.with_summary_rows(J.counts_per_language(_names(spark, d)), "language", ["count"])


WIKI_LANGS = ["English", "French", "German"]


@register("j13_types_per_language", O.with_names(O.language_lookup_sql()) + """
, w AS (SELECT language,
          count(*) FILTER (WHERE type = 'LOC') AS LOC, count(*) FILTER (WHERE type = 'ORG') AS ORG,
          count(*) FILTER (WHERE type = 'PER') AS PER, count(*) AS Total,
          round(100 * round(avg(CAST(alias = eng AS DOUBLE)), 3), 6) AS english_overlap_pct
        FROM names GROUP BY language)
SELECT coalesce(l.name, w.language) AS language_name, w.language AS language_code,
       coalesce(l.name, w.language) IN ('English', 'French', 'German') AS has_wikipedia,
       LOC, ORG, PER, Total, english_overlap_pct
FROM w LEFT JOIN lookup l ON l.code = w.language""")
def q_j13(spark, d):
    wiki = spark.createDataFrame([(x,) for x in WIKI_LANGS], "name string")
    return J.types_per_language(_names(spark, d), _lookup(spark), wiki)


EXTRA_CODES = [("am", "Amharic"), ("ti", "Tigrinya")]


@register("j14_languages_without_names", O.with_names() + """
, lk(code, name) AS (VALUES ('en', 'English'), ('fr', 'French'), ('de', 'German'),
                           ('es', 'Spanish'), ('am', 'Amharic'), ('ti', 'Tigrinya'))
SELECT code, name FROM lk WHERE code NOT IN (SELECT DISTINCT language FROM names)""")
def q_j14(spark, d):
    from .oracle import LANGUAGE_NAMES
    lk = spark.createDataFrame(list(LANGUAGE_NAMES.items()) + EXTRA_CODES, "code string, name string")
    return J.languages_without_names(lk, _names(spark, d))


@register("j15_non_english_share", O.with_names() + """
SELECT language, round(avg(CAST(eng <> alias OR eng = wikidata_id AS DOUBLE)), 6) AS non_english_share
FROM names GROUP BY language""")
def q_j15(spark, d):
    return J.non_english_share(_names(spark, d))


@register("j17_rank_by_count", O.with_names() + """
SELECT language, count, row_number() OVER (ORDER BY count DESC, language) AS rank FROM
  (SELECT language, count(*) AS count FROM names GROUP BY language)""")
def q_j17(spark, d):
    return J.rank_by_count(J.counts_per_language(_names(spark, d)))


# ------------------------------------------------------------------ I
@register("i1_pivot_names", O.with_names() + """
SELECT wikidata_id, type, eng,
  coalesce(max(alias) FILTER (WHERE language = 'de'), '') AS de,
  coalesce(max(alias) FILTER (WHERE language = 'en'), '') AS en,
  coalesce(max(alias) FILTER (WHERE language = 'es'), '') AS es,
  coalesce(max(alias) FILTER (WHERE language = 'fr'), '') AS fr
FROM names WHERE starts_with(wikidata_id, 'Q') GROUP BY wikidata_id, type, eng""")
def q_i1(spark, d):
    return I.pivot_names(_names(spark, d), LANGS)


@register("i2_null_languages", O.with_names() + f"SELECT {NAMES5} FROM names WHERE language IS NULL")
def q_i2(spark, d):
    return I.assert_no_null_language(_names(spark, d))


@register("i3_compare_languages", O.with_names() + """
SELECT wikidata_id, type, eng, de, en, es, fr,
       'https://www.wikidata.org/wiki/' || wikidata_id AS url,
       coalesce(en = eng, false) AS en_is_eng, coalesce(fr = eng, false) AS fr_is_eng, coalesce(en = fr, false) AS en_is_fr
FROM (SELECT wikidata_id, type, max(eng) AS eng,
             max(CASE WHEN language = 'de' THEN alias END) AS de, max(CASE WHEN language = 'en' THEN alias END) AS en,
             max(CASE WHEN language = 'es' THEN alias END) AS es, max(CASE WHEN language = 'fr' THEN alias END) AS fr
      FROM names GROUP BY wikidata_id, type)""")
def q_i3(spark, d):
    return I.compare_languages(_names(spark, d), "en", "fr")


@register("i4_type_counts_wide", O.with_names() + """
SELECT language, count(*) FILTER (WHERE type = 'LOC') AS LOC,
       count(*) FILTER (WHERE type = 'ORG') AS ORG, count(*) FILTER (WHERE type = 'PER') AS PER,
       count(*) AS total
FROM names GROUP BY language""")
def q_i4(spark, d):
    return I.type_counts_wide(J.counts_per_language_and_type(_names(spark, d)))


@register("i5_comparison_table", O.with_names() + """
, top AS (SELECT wikidata_id FROM names GROUP BY wikidata_id
          ORDER BY count(DISTINCT alias) DESC, wikidata_id LIMIT 1)
SELECT wikidata_id, max(alias) FILTER (WHERE language = 'de') AS de,
       max(alias) FILTER (WHERE language = 'en') AS en,
       max(alias) FILTER (WHERE language = 'es') AS es,
       max(alias) FILTER (WHERE language = 'fr') AS fr, max(eng) AS English
FROM names WHERE wikidata_id IN (SELECT wikidata_id FROM top)
GROUP BY wikidata_id""")
def q_i5(spark, d):
    n = _names(spark, d)
    top = J.most_diverse_entities(n, 1).first()["wikidata_id"]
    return I.comparison_table(n, top, LANGS)


@register("i6_wide_to_long", O.with_names() + """
SELECT language, F1, conll_type FROM (
  SELECT language, CAST(count(*) FILTER (WHERE type = 'LOC') AS BIGINT) AS F1, 'LOC' AS conll_type FROM names GROUP BY language
  UNION ALL SELECT language, count(*) FILTER (WHERE type = 'ORG'), 'ORG' FROM names GROUP BY language
  UNION ALL SELECT language, count(*) FILTER (WHERE type = 'PER'), 'PER' FROM names GROUP BY language)""")
def q_i6(spark, d):
    wide = I.type_counts_wide(J.counts_per_language_and_type(_names(spark, d)))
    wide = wide.select("language", *[F.col(t).alias(f"F1_{t}") for t in ("LOC", "ORG", "PER")])
    return I.wide_to_long(wide, "language", ["F1_LOC", "F1_ORG", "F1_PER"])
