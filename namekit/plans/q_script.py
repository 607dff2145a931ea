"""Registered queries: Unicode blocks, script statistics and anomaly tagging (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import script as S
from ..functions.blocks import block_sql
from ..operators import script as D
from ..sources import tables as T
from . import oracle as O
from .registry import register

KEYS = "doc_id, line_no, language"
POS5 = "doc_id, line_no, wikidata_id, eng, alias, language, type"


def _pos(spark, d):
    return T.names(spark, d, with_position=True)


def _docs(spark, d):
    return T.table(spark, d, "documents")


# ----------------------------------------------------------------- D1 / D2
@register("d1_unicode_block", f"""
SELECT DISTINCT c AS ch, unicode(c) AS codepoint, {block_sql('unicode(c)')} AS block
FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> ''""")
def q_d1(spark, d):
    ch = _docs(spark, d).select(F.explode(S.characters(F.col("text"))).alias("ch")).distinct()
    return ch.select("ch", F.ascii("ch").alias("codepoint"),
                     F.element_at(S.block_entries(F.col("ch")), 1)["block"].alias("block"))


@register("d2_char_categories", """
SELECT DISTINCT c AS ch, regexp_matches(c, '^[\\p{P}\\p{S}]$') AS is_punctuation,
       regexp_matches(c, '^\\p{N}$') AS is_number
FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> ''""")
def q_d2(spark, d):
    ch = _docs(spark, d).select(F.explode(S.characters(F.col("text"))).alias("ch")).distinct()
    return ch.select("ch", S.is_punctuation("ch").alias("is_punctuation"),
                     S.is_number("ch").alias("is_number"))


# ----------------------------------------------------------------- D3-D5
DEFAULT_CTES = [O.char_rows("names_all", "alias", KEYS, name="dch"),
                f"""dcount AS (SELECT {KEYS}, block, count(*) AS n, min(pos) AS first_pos
                   FROM dch GROUP BY {KEYS}, block)""",
                O.mode_rows("dch", KEYS, name="dmode")]


@register("d3_block_counts", O.with_names(*DEFAULT_CTES) + f"""
SELECT doc_id, line_no, string_agg(block || '=' || n, ';' ORDER BY first_pos) AS block_counts
FROM dcount GROUP BY doc_id, line_no""")
def q_d3(spark, d):
    e = S.block_entries(F.col("alias"))
    out = _pos(spark, d).select("doc_id", "line_no", F.concat_ws(";", F.transform(
        e, lambda x: F.concat(x["block"], F.lit("="), x["n"].cast("string")))).alias("block_counts"))
    return out.filter(F.col("block_counts") != "")


@register("d4_block_histogram", O.with_names(*DEFAULT_CTES) + """
SELECT doc_id, line_no, block, round(n * 1.0 / sum(n) OVER (PARTITION BY doc_id, line_no), 6) AS share
FROM dcount""")
def q_d4(spark, d):
    n = _pos(spark, d).select("doc_id", "line_no", F.explode(S.block_histogram(F.col("alias"))))
    return n.select("doc_id", "line_no", F.col("key").alias("block"), F.round("value", 6).alias("share"))


@register("d5_most_common_block", O.with_names(*DEFAULT_CTES) + """
SELECT n.doc_id, n.line_no, coalesce(m.block, '') AS block
FROM names_all n LEFT JOIN dmode m USING (doc_id, line_no)""")
def q_d5(spark, d):
    return _pos(spark, d).select("doc_id", "line_no", S.most_common_block(F.col("alias")).alias("block"))


STRICT_CTES = [O.char_rows("names_all", "alias", KEYS, strip_text=True, ignore_punct=True,
                           ignore_num=True, name="sch"),
               O.mode_rows("sch", KEYS, name="smode")]


@register("d5_strict_most_common_block", O.with_names(*STRICT_CTES) + """
SELECT n.doc_id, n.line_no, coalesce(m.block, '') AS block
FROM names_all n LEFT JOIN smode m USING (doc_id, line_no)""")
def q_d5s(spark, d):
    return _pos(spark, d).select("doc_id", "line_no", S.strict_most_common_block(F.col("alias")).alias("block"))


# ----------------------------------------------------------------- D6 / D7
LANG_CTES = STRICT_CTES + [
    O.char_rows("names_all", "alias", KEYS, ignore_punct=True, ignore_num=True, name="pch"),
    """proto AS (SELECT language, block, n * 1.0 / sum(n) OVER (PARTITION BY language) AS q
               FROM (SELECT language, block, count(*) AS n FROM pch GROUP BY language, block))""",
    """nb AS (SELECT n.doc_id, n.line_no, n.language, coalesce(m.block, '') AS block
            FROM names_all n LEFT JOIN smode m USING (doc_id, line_no))""",
    """expected AS (SELECT language, block AS expected_block FROM (
         SELECT language, block, row_number() OVER (PARTITION BY language ORDER BY n DESC, block) AS rn
         FROM (SELECT language, block, count(*) AS n FROM nb GROUP BY language, block)) WHERE rn = 1)""",
]


@register("d6_language_prototype", O.with_names(*LANG_CTES) +
          "SELECT language, block, round(q, 6) AS share FROM proto")
def q_d6(spark, d):
    p = D.prototype_long(T.names(spark, d))
    return p.select("language", "block", F.round("share", 6).alias("share"))


@register("d7_expected_block", O.with_names(*LANG_CTES) + "SELECT language, expected_block FROM expected")
def q_d7(spark, d):
    return D.expected_block(T.names(spark, d))


TAG_CTES = DEFAULT_CTES + LANG_CTES + [
    """hist AS (SELECT doc_id, line_no, block, n * 1.0 / sum(n) OVER (PARTITION BY doc_id, line_no) AS p
              FROM dcount)""",
    """np AS (SELECT n.doc_id, n.line_no, pr.block, pr.q FROM names_all n JOIN proto pr USING (language))""",
    """jsd AS (SELECT doc_id, line_no, 0.5 * sum(
                 CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END +
                 CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) AS jsd
               FROM (SELECT coalesce(h.doc_id, np.doc_id) AS doc_id, coalesce(h.line_no, np.line_no) AS line_no,
                            coalesce(h.p, 0) AS p, coalesce(np.q, 0) AS q
                     FROM hist h FULL OUTER JOIN np
                       ON h.doc_id = np.doc_id AND h.line_no = np.line_no AND h.block = np.block)
               GROUP BY doc_id, line_no)""",
    """tags AS (
  SELECT n.doc_id, n.line_no, n.language, n.wikidata_id, n.eng, n.alias, n.type,
         coalesce(dm.block, '') <> e.expected_block AS t1,
         NOT EXISTS (SELECT 1 FROM hist h WHERE h.doc_id = n.doc_id AND h.line_no = n.line_no
                     AND h.block = e.expected_block) AS t2,
         j.jsd >= 0.1 AS t3,
         CASE WHEN regexp_matches(n.language, '^(ja|zh-*|lzh|wuu)') THEN
           CASE WHEN n.language = 'ja' THEN NOT kana ELSE kana END END AS t4,
         CASE WHEN regexp_matches(n.language, '^(ja|zh-*|lzh|wuu)') THEN cjk END AS t5
  FROM names_all n LEFT JOIN dmode dm USING (doc_id, line_no)
  LEFT JOIN expected e ON e.language = n.language
  LEFT JOIN jsd j ON j.doc_id = n.doc_id AND j.line_no = n.line_no
  LEFT JOIN (SELECT doc_id, line_no, bool_or(block IN ('HIRAGANA', 'KATAKANA')) AS kana,
                    bool_or(starts_with(block, 'CJK')) AS cjk FROM hist GROUP BY doc_id, line_no) k
    ON k.doc_id = n.doc_id AND k.line_no = n.line_no)""",
    """votes AS (
  SELECT *, CASE WHEN t1 IS NULL THEN 0 WHEN t1 THEN 1 ELSE -1 END AS v1,
            CASE WHEN t2 IS NULL THEN 0 WHEN t2 THEN 1 ELSE -1 END AS v2,
            CASE WHEN t3 IS NULL THEN 0 WHEN t3 THEN 1 ELSE -1 END AS v3,
            CASE WHEN t4 IS NULL THEN 0 WHEN t4 THEN 1 ELSE -1 END AS v4,
            CASE WHEN t5 IS NULL THEN 0 WHEN t5 THEN 1 ELSE -1 END AS v5
  FROM tags)""",
]


@register("d14_tag_names", O.with_names(*TAG_CTES) + """
SELECT doc_id, line_no, language, v1 AS vote_incorrect_block, v2 AS vote_missing_block,
       v3 AS vote_divergent, v4 AS vote_kana, v5 AS vote_cjk, v1 + v2 + v3 + v4 + v5 > 0 AS anomalous
FROM votes""")
def q_d14(spark, d):
    t = D.tag_names(_pos(spark, d), keep_votes=True)
    return t.select("doc_id", "line_no", "language", "vote_incorrect_block", "vote_missing_block",
                    "vote_divergent", "vote_kana", "vote_cjk", "anomalous")


@register("d15_split_tagged", O.with_names(*TAG_CTES) + """
SELECT language, count(*) FILTER (WHERE NOT (v1 + v2 + v3 + v4 + v5 > 0)) AS n_kept,
       count(*) FILTER (WHERE v1 + v2 + v3 + v4 + v5 > 0) AS n_filtered
FROM votes GROUP BY language""")
def q_d15(spark, d):
    # both sides of the split counted from one tagged plan (one pass)
    t = D.tag_names(T.names(spark, d))
    return t.groupBy("language").agg(F.count_if(~F.col("anomalous")).alias("n_kept"),
                                     F.count_if(F.col("anomalous")).alias("n_filtered"))


ALLOW = [("en", ["BASIC_LATIN"]), ("de", ["BASIC_LATIN", "SPACE"])]
ALLOW_SQL = """allow(language_code, scripts) AS (VALUES ('en', ['BASIC_LATIN']),
                                                       ('de', ['BASIC_LATIN', 'SPACE']))"""


def _allow(spark):
    return spark.createDataFrame(ALLOW, "language_code string, scripts array<string>")


@register("d16_apply_script_allowlist", O.with_names(*DEFAULT_CTES, ALLOW_SQL) + """
SELECT n.doc_id, n.line_no, CASE
         WHEN a.language_code IS NULL THEN 'valid_unlisted'
         WHEN list_contains(a.scripts, coalesce(m.block, '')) THEN 'valid_listed'
         ELSE 'filtered' END AS category
FROM names_all n LEFT JOIN dmode m USING (doc_id, line_no)
LEFT JOIN allow a ON a.language_code = n.language""")
def q_d16(spark, d):
    listed, unlisted, filtered = D.apply_script_allowlist(_pos(spark, d), _allow(spark))
    sel = lambda df, c: df.select("doc_id", "line_no", F.lit(c).alias("category"))
    return sel(listed, "valid_listed").unionByName(sel(unlisted, "valid_unlisted")).unionByName(
        sel(filtered, "filtered"))


@register("d17_standardize_script", O.with_names(*TAG_CTES, ALLOW_SQL) + """
SELECT v.doc_id, v.line_no, CASE WHEN a.language_code IS NULL THEN NOT (v1 + v2 + v3 + v4 + v5 > 0)
         ELSE list_contains(a.scripts, coalesce(m.block, '')) END AS kept
FROM votes v LEFT JOIN dmode m ON m.doc_id = v.doc_id AND m.line_no = v.line_no
LEFT JOIN allow a ON a.language_code = v.language""")
def q_d17(spark, d):
    return D.standardize_script_flagged(_pos(spark, d), _allow(spark)).select(
        "doc_id", "line_no", "kept")


@register("d18_script_counts", O.with_names(*DEFAULT_CTES) + """
SELECT n.language, n.type, coalesce(m.block, '') AS script, count(*) AS n
FROM names_all n LEFT JOIN dmode m USING (doc_id, line_no) GROUP BY ALL""")
def q_d18(spark, d):
    return D.script_counts(T.names(spark, d))


@register("d20_script_of_distinct_aliases", O.with_names(*DEFAULT_CTES) + """
SELECT n.doc_id, n.line_no, n.alias, coalesce(m.block, '') AS script
FROM names_all n LEFT JOIN dmode m USING (doc_id, line_no)""")
def q_d20(spark, d):
    return D.script_of_distinct_aliases(_pos(spark, d)).select("doc_id", "line_no", "alias", "script")


def _entropy_pair(spark, d):
    from .queries import cleaned_names, language_lookup
    lk = language_lookup(spark)
    from ..operators import clean as C
    raw = C.keep_item_ids(T.names(spark, d))
    return D.script_entropy(raw, lk), D.script_entropy(cleaned_names(spark, d), lk)


def _entropy_ctes(src: str, prefix: str) -> list[str]:
    return [O.char_rows(src, "alias", KEYS, name=f"{prefix}ch"),
            O.mode_rows(f"{prefix}ch", KEYS, name=f"{prefix}md"),
            f"""{prefix}cnt AS (SELECT language, block, count(*) AS n FROM {prefix}md GROUP BY language, block)""",
            f"""{prefix}p AS (SELECT language, n * 1.0 / sum(n) OVER (PARTITION BY language) AS p FROM {prefix}cnt)""",
            f"""{prefix}ent AS (SELECT {prefix}p.language AS language_code, coalesce(l.name, {prefix}p.language) AS language,
                 round(-sum(p * log2(p)) + 0.0, 3) AS script_entropy
               FROM {prefix}p LEFT JOIN lookup l ON l.code = {prefix}p.language GROUP BY {prefix}p.language, l.name)"""]


def _entropy_change_sql():
    from .queries import CLEANED_SQL
    raw = "raw AS (SELECT * FROM names_all WHERE starts_with(wikidata_id, 'Q'))"
    return O.with_names(CLEANED_SQL, raw, O.language_lookup_sql(),
                        *_entropy_ctes("raw", "b"), *_entropy_ctes("cleaned", "a"))


@register("d21_entropy_change", _entropy_change_sql() + """
SELECT b.language_code, b.language, b.script_entropy AS before, a.script_entropy AS after,
       a.script_entropy - b.script_entropy AS change
FROM bent b LEFT JOIN aent a USING (language_code, language)
WHERE a.script_entropy - b.script_entropy <> 0""")
def q_d21(spark, d):
    before, after = _entropy_pair(spark, d)
    return D.entropy_change(before, after)


@register("d22_describe", O.with_names() + """
SELECT count(n) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std,
       round(min(n), 6) AS min, round(quantile_cont(n, 0.25), 6) AS p25,
       round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.75), 6) AS p75,
       round(max(n), 6) AS max
FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM names GROUP BY wikidata_id)""")
def q_d22(spark, d):
    per = T.names(spark, d).groupBy("wikidata_id").agg(F.count(F.lit(1)).alias("n"))
    return D.describe(per, "n")


@register("d23_script_purity", O.with_names(*DEFAULT_CTES) + """
, nb AS (SELECT doc_id, line_no, count(*) AS n_blocks FROM dcount GROUP BY doc_id, line_no)
SELECT language, type, CAST(sum(CASE WHEN nb.n_blocks = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pure, count(*) AS n_tot,
       round(sum(CASE WHEN nb.n_blocks = 1 THEN 1 ELSE 0 END) * 1.0 / count(*), 6) AS purity,
       round(1 - sum(CASE WHEN nb.n_blocks = 1 THEN 1 ELSE 0 END) * 1.0 / count(*), 6) AS impurity
FROM names_all n LEFT JOIN nb USING (doc_id, line_no) GROUP BY language, type""")
def q_d23(spark, d):
    return D.script_purity(T.names(spark, d))


@register("d24_label_entropy", O.with_names(*DEFAULT_CTES) + """
, c AS (SELECT n.language, coalesce(m.block, '') AS script, count(*) AS count
        FROM names_all n LEFT JOIN dmode m USING (doc_id, line_no) GROUP BY ALL)
, r AS (SELECT language, script, count(*) AS k FROM c GROUP BY language, script)
, p AS (SELECT language, k * 1.0 / sum(k) OVER (PARTITION BY language) AS p FROM r)
SELECT language, round(-sum(p * ln(p)) + 0.0, 4) AS entropy FROM p GROUP BY language""")
def q_d24(spark, d):
    counts = D.script_counts(T.names(spark, d), by=["language"]).withColumnRenamed("n", "count")
    return D.label_entropy(counts)


@register("d25_evaluate_tagging", O.with_names(*TAG_CTES) + """
, g AS (SELECT v.language, v1 + v2 + v3 + v4 + v5 > 0 AS pred, l.quality = 0 AS gold
        FROM votes v JOIN labels l ON l.doc_id = v.doc_id)
, agg AS (SELECT language, CAST(sum(CAST(pred AND gold AS BIGINT)) AS BIGINT) AS tp,
                 CAST(sum(CAST(pred AND NOT gold AS BIGINT)) AS BIGINT) AS fp,
                 CAST(sum(CAST(NOT pred AND gold AS BIGINT)) AS BIGINT) AS fn,
                 CAST(sum(CAST(NOT pred AND NOT gold AS BIGINT)) AS BIGINT) AS tn
          FROM g GROUP BY GROUPING SETS ((language), ()))
SELECT coalesce(language, 'global') AS language, tp, fp, fn, tn FROM agg""")
def q_d25(spark, d):
    pos = _pos(spark, d)
    tagged = D.tag_names(pos)
    gold = (T.table(spark, d, "labels").select("doc_id", (F.col("quality") == 0).alias("gold_anomalous"))
            .join(pos.select("doc_id", "line_no", "language"), "doc_id"))
    return D.evaluate_tagging(tagged, gold, keys=["doc_id", "line_no", "language"])


@register("d25_tagging_errors", O.with_names(*TAG_CTES) + """
, g AS (SELECT v.doc_id, v.line_no, v.language, v.alias, v1 + v2 + v3 + v4 + v5 > 0 AS pred, l.quality = 0 AS gold
        FROM votes v JOIN labels l ON l.doc_id = v.doc_id)
SELECT doc_id, line_no, language, alias, CASE WHEN gold THEN 'missed' ELSE 'false_alarm' END AS error FROM g WHERE gold <> pred""")
def q_d25_errors(spark, d):
    pos = _pos(spark, d)
    gold = (T.table(spark, d, "labels").select("doc_id", (F.col("quality") == 0).alias("gold_anomalous"))
            .join(pos.select("doc_id", "line_no", "language"), "doc_id"))
    errors = D.tagging_errors(D.tag_names(pos), gold, keys=["doc_id", "line_no", "language"])
    return errors.select("doc_id", "line_no", "language", "alias", "error")


@register("d13_vote_methods", O.with_names(*TAG_CTES) + """
SELECT doc_id, line_no,
       v1 + v2 + v3 + v4 + v5 > 0 AS majority_vote,
       (v1 <> 0 OR v2 <> 0 OR v3 <> 0 OR v4 <> 0 OR v5 <> 0) AND least(v1, v2, v3, v4, v5) >= 0 AS all_votes,
       greatest(v1, v2, v3, v4, v5) = 1 AS any_vote,
       v1 <> 0 AND v2 <> 0 AND v3 <> 0 AND v4 <> 0 AND v5 <> 0 AS all_compat,
       v1 <> 0 OR v2 <> 0 OR v3 <> 0 OR v4 <> 0 OR v5 <> 0 AS any_compat
FROM votes""")
def q_d13(spark, d):
    t = D.tag_names(_pos(spark, d), keep_votes=True)
    votes = [F.col(f"vote_{k}") for k in ("incorrect_block", "missing_block", "divergent", "kana", "cjk")]
    return t.select("doc_id", "line_no",
                    D.aggregate_votes(votes, "majority_vote").alias("majority_vote"),
                    D.aggregate_votes(votes, "all").alias("all_votes"),
                    D.aggregate_votes(votes, "any").alias("any_vote"),
                    D.aggregate_votes(votes, "all", compat=True).alias("all_compat"),
                    D.aggregate_votes(votes, "any", compat=True).alias("any_compat"))


def tag_ctes(src: str, keys: list[str], p: str = "t_") -> list[str]:
    """The D14 oracle CTEs for any source table with a unique row key
    ``keys`` (which must include ``language``); names are prefixed by ``p``."""
    k = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys)
    rk = list(keys)
    rkl = ", ".join(rk)
    return [
        O.char_rows(src, "alias", k, name=f"{p}dch"),
        f"""{p}dcount AS (SELECT {k}, block, count(*) AS n, min(pos) AS first_pos FROM {p}dch GROUP BY {k}, block)""",
        O.mode_rows(f"{p}dch", k, name=f"{p}dmode"),
        O.char_rows(src, "alias", k, strip_text=True, ignore_punct=True, ignore_num=True, name=f"{p}sch"),
        O.mode_rows(f"{p}sch", k, name=f"{p}smode"),
        O.char_rows(src, "alias", k, ignore_punct=True, ignore_num=True, name=f"{p}pch"),
        f"""{p}proto AS (SELECT language, block, n * 1.0 / sum(n) OVER (PARTITION BY language) AS q
               FROM (SELECT language, block, count(*) AS n FROM {p}pch GROUP BY language, block))""",
        f"""{p}nb AS (SELECT n.language, coalesce(m.block, '') AS block FROM {src} n
               LEFT JOIN {p}smode m ON {on('n', 'm')})""",
        f"""{p}expected AS (SELECT language, block AS expected_block FROM (
               SELECT language, block, row_number() OVER (PARTITION BY language ORDER BY n DESC, block) AS rn
               FROM (SELECT language, block, count(*) AS n FROM {p}nb GROUP BY language, block)) WHERE rn = 1)""",
        f"""{p}hist AS (SELECT {k}, block, n * 1.0 / sum(n) OVER (PARTITION BY {rkl}) AS p FROM {p}dcount)""",
        f"""{p}np AS (SELECT {', '.join('n.' + c for c in rk)}, pr.block, pr.q FROM {src} n JOIN {p}proto pr USING (language))""",
        f"""{p}jsd AS (SELECT {rkl}, 0.5 * sum(
                 CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END +
                 CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) AS jsd
               FROM (SELECT {', '.join(f'coalesce(h.{c}, np.{c}) AS {c}' for c in rk)},
                            coalesce(h.p, 0) AS p, coalesce(np.q, 0) AS q
                     FROM {p}hist h FULL OUTER JOIN {p}np np ON {on('h', 'np')} AND h.block = np.block)
               GROUP BY {rkl})""",
        f"""{p}votes AS (
  SELECT n.*, CASE WHEN t1 IS NULL THEN 0 WHEN t1 THEN 1 ELSE -1 END
            + CASE WHEN t2 IS NULL THEN 0 WHEN t2 THEN 1 ELSE -1 END
            + CASE WHEN t3 IS NULL THEN 0 WHEN t3 THEN 1 ELSE -1 END
            + CASE WHEN t4 IS NULL THEN 0 WHEN t4 THEN 1 ELSE -1 END
            + CASE WHEN t5 IS NULL THEN 0 WHEN t5 THEN 1 ELSE -1 END > 0 AS anomalous,
         coalesce(dm.block, '') AS block
  FROM {src} n LEFT JOIN (
    SELECT n.{rk[0]} AS _k0, {', '.join(f'n.{c} AS _k{i}' for i, c in enumerate(rk) if i)}{',' if len(rk) > 1 else ''}
           coalesce(dm.block, '') <> e.expected_block AS t1,
           NOT EXISTS (SELECT 1 FROM {p}hist h WHERE {on('h', 'n')} AND h.block = e.expected_block) AS t2,
           j.jsd >= 0.1 AS t3,
           CASE WHEN regexp_matches(n.language, '^(ja|zh-*|lzh|wuu)') THEN
             CASE WHEN n.language = 'ja' THEN NOT kana ELSE kana END END AS t4,
           CASE WHEN regexp_matches(n.language, '^(ja|zh-*|lzh|wuu)') THEN cjk END AS t5
    FROM {src} n LEFT JOIN {p}dmode dm ON {on('n', 'dm')}
    LEFT JOIN {p}expected e ON e.language = n.language
    LEFT JOIN {p}jsd j ON {on('n', 'j')}
    LEFT JOIN (SELECT {rkl}, bool_or(block IN ('HIRAGANA', 'KATAKANA')) AS kana,
                      bool_or(starts_with(block, 'CJK')) AS cjk FROM {p}hist GROUP BY {rkl}) kk ON {on('n', 'kk')}
  ) v ON {' AND '.join(f'n.{c} = v._k{i}' for i, c in enumerate(rk))}
  LEFT JOIN {p}dmode dm ON {on('n', 'dm')})""",
    ]
