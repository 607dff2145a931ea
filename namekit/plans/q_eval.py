"""Registered queries: sampling and splits (H) and evaluation (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import strip_parenthesis_permute_comma
from ..operators import evaluate as K
from ..operators import sample as H
from ..sources import tables as T
from . import oracle as O
from .registry import register

NAMES5 = "wikidata_id, eng, alias, language, type"
KEY = "concat_ws('|', wikidata_id, eng, alias, language, type)"


def _ok(seed="1917"):
    return f"md5('{seed}|' || {KEY})"


def _names(spark, d):
    return T.names(spark, d)


@register("h1_sample_balanced", O.with_names() + f"""
SELECT {NAMES5} FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY {_ok()}) AS rn FROM names)
WHERE rn <= (2000 // (SELECT count(DISTINCT language) FROM names))""")
def q_h1(spark, d):
    return H.sample_balanced(_names(spark, d), "language", 2000)


@register("h2_sample_empirical", O.with_names() + f"SELECT {NAMES5} FROM names ORDER BY {_ok()} LIMIT 500")
def q_h2(spark, d):
    return H.sample_empirical(_names(spark, d), 500)


@register("h3_sample_by_language", O.with_names() + f"""
, q AS (SELECT language, count(*) AS quota FROM (SELECT language FROM names ORDER BY {_ok()} LIMIT 1000)
        GROUP BY language)
SELECT {NAMES5} FROM (
  SELECT n.*, q.quota, row_number() OVER (PARTITION BY n.language ORDER BY {_ok('1917|rows')}) AS rn
  FROM names n JOIN q USING (language)) WHERE rn <= quota""")
def q_h3(spark, d):
    return H.sample_by_language(_names(spark, d), 1000)


UNIF = f"((CAST(('0x' || substr({_ok()}, 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)"


@register("h4_sample_smoothed", O.with_names() + f"""
, w AS (SELECT language, pow(count(*) * 1.0 / (SELECT count(*) FROM names), 0.7) AS w FROM names GROUP BY language)
SELECT {NAMES5} FROM (SELECT n.*, -ln({UNIF}) / w.w AS es FROM names n JOIN w USING (language))
ORDER BY es LIMIT 500""")
def q_h4(spark, d):
    return H.sample_smoothed(_names(spark, d), 500, 0.7)


@register("h5_min_names_after_sampling", O.with_names() + f"""
, s AS (SELECT {NAMES5} FROM names ORDER BY {_ok()} LIMIT 500)
SELECT * FROM s WHERE language IN (SELECT language FROM s GROUP BY language HAVING count(*) >= 100)""")
def q_h5(spark, d):
    return H.min_names_after_sampling(H.sample_empirical(_names(spark, d), 500), 100)


@register("h6_sample_per_language", O.with_names() + f"""
SELECT {NAMES5} FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY {_ok()}) AS rn FROM names)
WHERE rn <= 1000""")
def q_h6(spark, d):
    return H.sample_per_language(_names(spark, d), 1000)


@register("h7_assign_split", O.with_names() + """
SELECT DISTINCT wikidata_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'dev' ELSE 'test' END AS split
FROM (SELECT wikidata_id, (CAST(('0x' || substr(md5('1917|' || wikidata_id), 1, 13)) AS BIGINT) + 0.5)
                          / 4503599627370496.0 AS u FROM names)""")
def q_h7(spark, d):
    return H.assign_split(_names(spark, d)).select("wikidata_id", "split").distinct()


@register("h8_noise_samples", O.with_names() + """
, a AS (SELECT DISTINCT alias FROM names)
, r AS (SELECT alias, row_number() OVER (ORDER BY md5('1917|' || alias), alias) AS rk FROM a)
, own AS (SELECT DISTINCT language, alias FROM names)
, l AS (SELECT DISTINCT language FROM names)
SELECT language, alias, true AS anomalous, true AS noise_sample FROM (
  SELECT l.language, r.alias, row_number() OVER (PARTITION BY l.language ORDER BY r.rk) AS rn
  FROM l, r WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.language = l.language AND o.alias = r.alias))
WHERE rn <= 50""")
def q_h8(spark, d):
    return H.noise_samples(_names(spark, d), 50)


@register("h9_extreme_examples", O.with_names() + f"""
, k AS (SELECT {NAMES5}, length(alias) AS len, {_ok()} AS ok,
               CAST(('0x' || substr({_ok()}, 1, 8)) AS BIGINT) % CAST(ceil((SELECT count(*) FROM names) / 1000.0) AS BIGINT) AS chunk
        FROM names)
, w AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY len DESC, ok) AS hi,
                  row_number() OVER (PARTITION BY chunk ORDER BY len, ok) AS lo FROM k)
SELECT {NAMES5}, len, chunk, CASE WHEN hi <= 30 THEN 'top' ELSE 'bottom' END AS extreme
FROM w WHERE hi <= 30 OR lo <= 30""")
def q_h9(spark, d):
    n = _names(spark, d)
    n = n.withColumn("len", F.length("alias").cast("long"))
    return H.extreme_examples(n, "len", 30, 1000, key_cols=["wikidata_id", "eng", "alias", "language", "type"])


# ------------------------------------------------------------------ K
def _outputs(spark, d):
    """System outputs derived from the names: reference = alias, hypothesis =
    the comma/parenthesis-normalised alias."""
    n = T.names(spark, d)
    return n.select("language", F.col("alias").alias("reference"),
                    strip_parenthesis_permute_comma(F.col("alias")).alias("hypothesis"),
                    F.concat(F.lit("<"), F.col("language"), F.lit("> "), F.col("alias")).alias("source"))


def _outputs_sql():
    from .q_names import E3_SQL
    return f"""outputs AS (SELECT language, alias AS reference, {E3_SQL} AS hypothesis FROM names_all)"""


def _f1_sql(r: str, h: str) -> str:
    lcs = f"((length({r}) + length({h}) - levenshtein({O.safe(r)}, {O.safe(h)})) / 2.0)"
    rec = f"(CASE WHEN length({h}) = 0 THEN 0.0 ELSE {lcs} / length({h}) END)"
    prec = f"(CASE WHEN length({r}) = 0 THEN 0.0 ELSE {lcs} / length({r}) END)"
    return f"(CASE WHEN {rec} + {prec} = 0 THEN 0.0 ELSE 2 * {rec} * {prec} / ({rec} + {prec}) END)"


@register("k1_word_accuracy", O.with_names(_outputs_sql()) + """
SELECT coalesce(language, 'global') AS language, round(100 * avg(CAST(reference = hypothesis AS DOUBLE)), 5) AS word_acc,
       round(100 - 100 * avg(CAST(reference = hypothesis AS DOUBLE)), 5) AS word_err
FROM outputs GROUP BY GROUPING SETS ((language), ())""")
def q_k1(spark, d):
    o = _outputs(spark, d).withColumn("_a", K.word_accuracy("reference", "hypothesis"))
    agg = [F.round(100 * F.avg("_a"), 5).alias("word_acc"), F.round(100 - 100 * F.avg("_a"), 5).alias("word_err")]
    from ..operators.common import with_global
    return with_global(o, "language", agg)


@register("k2_lcs_f1", O.with_names(_outputs_sql()) + f"""
SELECT coalesce(language, 'global') AS language, round(100 * avg({_f1_sql('reference', 'hypothesis')}), 5) AS mean_f1
FROM outputs GROUP BY GROUPING SETS ((language), ())""")
def q_k2(spark, d):
    o = _outputs(spark, d).withColumn("_f1", K.lcs_f1("reference", "hypothesis"))
    from ..operators.common import with_global
    return with_global(o, "language", [F.round(100 * F.avg("_f1"), 5).alias("mean_f1")])


#: Word edit distance of every row of ``outputs`` (rid), one word of the hypothesis at a time: a row of the table of
#: distances is a running minimum over the one before.
_LER_SQL = f"""
, ot AS (SELECT row_number() OVER () AS rid, language, reference, hypothesis,
                {O.tokens('reference')} AS rt, {O.tokens('hypothesis')} AS ht FROM outputs)
, dp(rid, i, j, d) AS (
    SELECT rid, 0, unnest(range(0, len(rt) + 1)) AS j, unnest(range(0, len(rt) + 1)) AS d FROM ot WHERE rt <> ht
    UNION ALL
    SELECT rid, i + 1, j, j + min(c - j) OVER (PARTITION BY rid ORDER BY j) FROM (
      SELECT dp.rid, dp.i, dp.j, least(dp.d + 1, coalesce(lag(dp.d) OVER (PARTITION BY dp.rid ORDER BY dp.j)
               + CASE WHEN ot.rt[dp.j] = ot.ht[dp.i + 1] THEN 0 ELSE 1 END, dp.d + 1)) AS c
      FROM dp JOIN ot USING (rid) WHERE dp.i < len(ot.ht)))
, ler AS (SELECT ot.rid, ot.language, ot.reference, ot.hypothesis,
                 CASE WHEN len(rt) > 0 THEN coalesce(dp.d, 0)::DOUBLE / len(rt) END AS ler
          FROM ot LEFT JOIN dp ON dp.rid = ot.rid AND dp.i = len(ot.ht) AND dp.j = len(ot.rt))"""


def _outputs_rec() -> str:
    return O.with_names(_outputs_sql()).replace("WITH ", "WITH RECURSIVE ", 1)


@register("k3_label_error_rate", _outputs_rec() + _LER_SQL + """
SELECT language, round(avg(ler), 5) AS label_error_rate FROM ler GROUP BY language""")
def q_k3(spark, d):
    o = _outputs(spark, d).withColumn("_ler", K.label_error_rate("reference", "hypothesis"))
    return o.groupBy("language").agg(F.round(F.avg("_ler"), 5).alias("label_error_rate"))


def _bleu_sql(group: str) -> str:
    toks = lambda x: O.tokens(x)
    return f"""
, t AS (SELECT {group} AS g, {toks('reference')} AS rt, {toks('hypothesis')} AS ht,
               md5(concat_ws('|', language, reference, hypothesis)) AS rid FROM outputs)
, ng AS (SELECT g, rid, n, 'h' AS side, array_to_string(ht[i:i + n - 1], ' ') AS gram
         FROM t, (VALUES (1), (2), (3), (4)) v(n), unnest(range(1, len(ht) - n + 2)) u(i)
         UNION ALL
         SELECT g, rid, n, 'r', array_to_string(rt[i:i + n - 1], ' ')
         FROM t, (VALUES (1), (2), (3), (4)) v(n), unnest(range(1, len(rt) - n + 2)) u(i))
, cnt AS (SELECT g, rid, n, gram, count(*) FILTER (WHERE side = 'h') AS ch, count(*) FILTER (WHERE side = 'r') AS cr
          FROM ng GROUP BY g, rid, n, gram)
, pn AS (SELECT g, n, sum(least(ch, cr)) AS correct, sum(ch) AS total FROM cnt GROUP BY g, n)
, w AS (SELECT g, {', '.join(f"sum(correct) FILTER (WHERE n = {n}) AS c{n}, sum(total) FILTER (WHERE n = {n}) AS t{n}" for n in range(1, 5))}
        FROM pn GROUP BY g)
, lens AS (SELECT g, sum(len(ht)) AS hl, sum(len(rt)) AS rl FROM t GROUP BY g)
, k AS (SELECT *, {', '.join(f"(CASE WHEN coalesce(c{n}, 0) = 0 AND coalesce(t{n}, 0) > 0 THEN 1 ELSE 0 END) AS z{n}" for n in range(1, 5))}
        FROM lens LEFT JOIN w USING (g))
, p AS (SELECT g, hl, rl, {', '.join(
        f"(CASE WHEN coalesce(t{n}, 0) = 0 THEN NULL WHEN coalesce(c{n}, 0) = 0 THEN 1.0 / (pow(2.0, {' + '.join(f'z{m}' for m in range(1, n + 1))}) * t{n}) ELSE c{n} * 1.0 / t{n} END) AS p{n}"
        for n in range(1, 5))} FROM k)
SELECT g AS language, round(coalesce(100 * (CASE WHEN hl = 0 THEN 0.0 WHEN hl < rl THEN exp(1 - rl * 1.0 / hl) ELSE 1.0 END)
       * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4), 0.0), 5) AS bleu FROM p"""


@register("k4_corpus_bleu", O.with_names(_outputs_sql()) + _bleu_sql("language"))
def q_k4(spark, d):
    b = K.corpus_bleu(_outputs(spark, d), ["language"])
    return b.select("language", F.round("bleu", 5).alias("bleu"))


def _k5_sql() -> str:
    body = _outputs_rec().rstrip()
    twice = """
, outputs_all AS (SELECT language, reference, hypothesis FROM outputs UNION ALL SELECT 'global', reference, hypothesis FROM outputs)"""
    bleu, _, last = _bleu_sql("language").rpartition("SELECT g AS language")
    rest = (_LER_SQL + bleu).replace("FROM outputs", "FROM outputs_all")
    return body + twice + rest + f"""
, bl AS (SELECT g AS language{last})
SELECT language, round(avg(ler), 5) AS label_error_rate, round(100 * avg(CAST(reference = hypothesis AS DOUBLE)), 5) AS word_acc,
       round(100 - 100 * avg(CAST(reference = hypothesis AS DOUBLE)), 5) AS word_err,
       round(100 * avg({_f1_sql('reference', 'hypothesis')}), 5) AS mean_f1, any_value(bleu) AS bleu
FROM ler JOIN bl USING (language) GROUP BY language"""


@register("k5_metrics_by_language", _k5_sql())
def q_k5(spark, d):
    return K.metrics_by_language(_outputs(spark, d))


@register("k5_metrics_table", f"""
SELECT language AS "Language", round(label_error_rate, 3) AS "CER", round(word_acc, 3) AS "Accuracy", round(mean_f1, 3) AS "F1"
FROM ({_k5_sql()})""")
def q_k5_table(spark, d):
    return K.metrics_table(K.metrics_by_language(_outputs(spark, d)))


def _gold(spark, d):
    """Gold for the filters: a document's names should be removed when the
    document is labelled low quality."""
    n = T.names(spark, d).select("wikidata_id", "language").distinct()
    lab = T.table(spark, d, "labels").select(
        F.concat(F.lit("Q"), F.col("doc_id").cast("string")).alias("wikidata_id"),
        (F.col("quality") == 0).alias("should_remove"))
    return n.join(lab, "wikidata_id")


@register("k6_filter_quality", O.with_names() + """
, gold AS (SELECT DISTINCT n.wikidata_id, n.language, l.quality = 0 AS should_remove
           FROM names n JOIN labels l ON n.wikidata_id = 'Q' || CAST(l.doc_id AS VARCHAR))
, removed AS (SELECT DISTINCT wikidata_id, language FROM names WHERE regexp_matches(alias, '(^| )the( |$)'))
, j AS (SELECT g.language, g.should_remove AS t, r.wikidata_id IS NOT NULL AS p
        FROM gold g LEFT JOIN removed r USING (wikidata_id, language))
, c AS (SELECT coalesce(language, 'global') AS language, sum(CAST(t AND p AS BIGINT)) AS tp,
               sum(CAST(NOT t AND p AS BIGINT)) AS fp, sum(CAST(t AND NOT p AS BIGINT)) AS fn,
               sum(CAST(NOT t AND NOT p AS BIGINT)) AS tn FROM j GROUP BY GROUPING SETS ((language), ()))
SELECT language, round(CASE WHEN tp + fp + fn + tn = 0 THEN 0 ELSE (tp + tn) * 1.0 / (tp + fp + fn + tn) END, 6) AS accuracy,
       round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp * 1.0 / (tp + fp) END, 6) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp * 1.0 / (tp + fn) END, 6) AS recall,
       round(CASE WHEN tp + fp = 0 OR tp + fn = 0 OR tp = 0 THEN 0
                  ELSE 2 * (tp * 1.0 / (tp + fp)) * (tp * 1.0 / (tp + fn)) / (tp * 1.0 / (tp + fp) + tp * 1.0 / (tp + fn)) END, 6) AS f1
FROM c""")
def q_k6(spark, d):
    from ..operators import clean as C
    removed = C.search(T.names(spark, d), "alias", "(^| )the( |$)")
    return K.filter_quality(_gold(spark, d), removed)


@register("k7_reorder_quality", O.with_names() + f"""
, gold AS (SELECT language, wikidata_id, max(eng) AS reference FROM names GROUP BY language, wikidata_id)
, fin AS (SELECT language, wikidata_id, max({__import__('namekit.plans.q_names', fromlist=['E3_SQL']).E3_SQL.replace('alias', 'eng')}) AS hypothesis
          FROM names GROUP BY language, wikidata_id)
, j AS (SELECT * FROM gold JOIN fin USING (language, wikidata_id))
SELECT coalesce(language, 'global') AS language,
       round(100 * avg(CAST(reference = hypothesis AS DOUBLE)), 6) AS accuracy,
       round(100 * avg({_f1_sql('reference', 'hypothesis')}), 6) AS mean_f1
FROM j GROUP BY GROUPING SETS ((language), ())""")
def q_k7(spark, d):
    n = T.names(spark, d)
    gold = n.groupBy("language", "wikidata_id").agg(F.max("eng").alias("alias"))
    fin = n.groupBy("language", "wikidata_id").agg(
        F.max(strip_parenthesis_permute_comma(F.col("eng"))).alias("alias"))
    return K.reorder_quality(gold, fin)


@register("j16_f1_vs_train_size", O.with_names(_outputs_sql()) + f"""
, f AS (SELECT language, round(100 * avg({_f1_sql('reference', 'hypothesis')}), 5) AS mean_f1
        FROM outputs GROUP BY language)
, c AS (SELECT language, count(*) AS n_train FROM names_all GROUP BY language)
SELECT * FROM f JOIN c USING (language)""")
def q_j16(spark, d):
    from ..operators import report as J
    o = _outputs(spark, d).withColumn("_f1", K.lcs_f1("reference", "hypothesis"))
    f1 = o.groupBy("language").agg(F.round(100 * F.avg("_f1"), 5).alias("mean_f1"))
    counts = J.counts_per_language(T.names(spark, d)).withColumnRenamed("count", "n_train")
    return J.f1_vs_train_size(f1, counts)
