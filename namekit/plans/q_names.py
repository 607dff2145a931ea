"""Registered queries: name standardization (E), alignment statistics (F)
and similarity (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import align as A
from ..functions import permute as P
from ..functions import similarity as G
from ..functions.text import permute_first_comma, strip_parenthesis, strip_parenthesis_permute_comma
from ..operators import names as E
from ..operators import align as FA
from ..sources import tables as T
from . import oracle as O
from .registry import register


def _pos(spark, d):
    return T.names(spark, d, with_position=True)


def _proc(expr_sql: str) -> str:
    return O.with_names() + f"""
SELECT doc_id, line_no, {expr_sql} AS text, ({expr_sql}) IS NOT DISTINCT FROM alias AS is_unchanged
FROM names_all"""


def _comma_sql(x: str) -> str:
    swapped = (f"regexp_replace(substr({x}, strpos({x}, ',') + 1) || ' ' || "
               f"substr({x}, 1, strpos({x}, ',') - 1), '^,+|,+$', '', 'g')")
    return f"(CASE WHEN strpos({x}, ',') = 0 THEN {x} ELSE {O.strip(swapped)} END)"


@register("e1_strip_parenthesis", _proc(O.strip_paren("alias")))
def q_e1(spark, d):
    n = _pos(spark, d)
    t = strip_parenthesis(F.col("alias"))
    return n.select("doc_id", "line_no", t.alias("text"), t.eqNullSafe(F.col("alias")).alias("is_unchanged"))


@register("e2_permute_first_comma", _proc(_comma_sql("alias")))
def q_e2(spark, d):
    n = _pos(spark, d)
    t = permute_first_comma(F.col("alias"))
    return n.select("doc_id", "line_no", t.alias("text"), t.eqNullSafe(F.col("alias")).alias("is_unchanged"))


@register("e3_strip_parenthesis_permute_comma",
          _proc(f"regexp_replace({_comma_sql(O.strip_paren('alias'))}, '^,+|,+$', '', 'g')"))
def q_e3(spark, d):
    n = _pos(spark, d)
    t = strip_parenthesis_permute_comma(F.col("alias"))
    return n.select("doc_id", "line_no", t.alias("text"), t.eqNullSafe(F.col("alias")).alias("is_unchanged"))


def _e4_sql(src_expr: str) -> str:
    return O.with_names(O.perm_values()) + f"""
, src AS (SELECT doc_id, line_no, {src_expr} AS t, strip_accents({src_expr}) AS r, eng, alias FROM names_all)
, tk AS (SELECT *, {O.tokens("replace(t, ',', '')")} AS tok, {O.tokens("replace(r, ',', '')")} AS rtok FROM src)
, tk2 AS (SELECT *, len(tok) AS n, len(rtok) AS m FROM tk)
, cand AS (
  SELECT tk2.doc_id, tk2.line_no, p.k,
         array_to_string(list_transform(p.idx, lambda i: tok[i]), ' ') AS name,
         levenshtein({O.safe(f'''array_to_string(list_transform(
             CASE WHEN m <= 4 THEN rp.idx ELSE list_concat(range(1, m - 3), list_transform(p4.idx, lambda i: i + m - 4)) END,
             lambda i: rtok[i]), ' ')''')}, {O.safe('eng')}) AS d
  FROM tk2 JOIN perm p ON p.n = tk2.n
  LEFT JOIN perm rp ON rp.n = tk2.m AND rp.k = p.k
  LEFT JOIN perm p4 ON p4.n = 4 AND p4.k = p.k
  WHERE tk2.n BETWEEN 2 AND 4 AND p.k < least({O.fact('tk2.n')}, {O.fact('tk2.m')}))
, best AS (SELECT doc_id, line_no, name FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY d, k) AS rn FROM cand) WHERE rn = 1)
SELECT tk2.doc_id, tk2.line_no,
       CASE WHEN tk2.n BETWEEN 2 AND 4 THEN b.name ELSE tk2.t END AS text,
       CASE WHEN tk2.n BETWEEN 2 AND 4 THEN b.name = tk2.t ELSE true END AS is_unchanged
FROM tk2 LEFT JOIN best b ON b.doc_id = tk2.doc_id AND b.line_no = tk2.line_no"""


@register("e4_permute_lowest_distance", _e4_sql("alias"))
def q_e4(spark, d):
    n = _pos(spark, d)
    r = P.permute_lowest_distance(F.col("alias"), P.romanize(F.col("alias")), F.col("eng"))
    return n.select("doc_id", "line_no", r["text"].alias("text"), r["is_unchanged"].alias("is_unchanged"))


@register("e5_strip_parenthesis_permute_distance", _e4_sql(O.strip_paren("alias")))
def q_e5(spark, d):
    n = _pos(spark, d).withColumn("src", strip_parenthesis(F.col("alias")))
    r = P.permute_lowest_distance(F.col("src"), P.romanize(F.col("src")), F.col("eng"))
    return n.select("doc_id", "line_no", r["text"].alias("text"), r["is_unchanged"].alias("is_unchanged"))


E3_SQL = f"regexp_replace({_comma_sql(O.strip_paren('alias'))}, '^,+|,+$', '', 'g')"


@register("e7_standardize_names", O.with_names() + f"""
SELECT wikidata_id, eng, alias, language, type, false AS anomalous, is_unchanged FROM (
  SELECT wikidata_id, eng, {E3_SQL} AS alias, language, type,
         {E3_SQL} IS NOT DISTINCT FROM alias AS is_unchanged FROM names_all)
WHERE {O.strip('alias')} <> '' AND eng <> wikidata_id""")
def q_e7(spark, d):
    return E.standardize_names(T.names(spark, d), "remove_parenthesis_permute_comma")


_E8_SQL = O.with_names(O.language_lookup_sql()) + f"""
, s AS (SELECT row_number() OVER () AS rid, language, alias, {E3_SQL} AS new FROM names_all)
, tk AS (SELECT rid, {O.tokens("replace(alias, ',', ' ')")} AS old_t, {O.tokens("replace(new, ',', ' ')")} AS new_t FROM s WHERE alias <> new)
, o AS (SELECT rid, tok, pos, row_number() OVER (PARTITION BY rid, tok ORDER BY pos) AS nth
        FROM (SELECT rid, unnest(old_t) AS tok, unnest(range(len(old_t))) AS pos FROM tk))
, w AS (SELECT rid, tok, pos, row_number() OVER (PARTITION BY rid, tok ORDER BY pos) AS nth
        FROM (SELECT rid, unnest(new_t) AS tok, unnest(range(len(new_t))) AS pos FROM tk))
, whole AS (SELECT rid FROM tk WHERE list_sort(old_t) = list_sort(new_t))
, x AS (SELECT rid, count(*) FILTER (WHERE t < high) AS n_cross FROM (
          SELECT rid, w.pos AS t, max(w.pos) OVER (PARTITION BY rid ORDER BY o.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high
          FROM o JOIN w USING (rid, tok, nth) JOIN whole USING (rid)) GROUP BY rid)
, g AS (SELECT language, sum(coalesce(n_cross, 0)) AS x, count(*) AS n, count(*) FILTER (WHERE alias IS DISTINCT FROM new) AS n_changed,
               count(*) FILTER (WHERE alias IS NOT DISTINCT FROM new) AS n_unchanged
        FROM s LEFT JOIN x USING (rid) GROUP BY GROUPING SETS ((language), ()))
SELECT CASE WHEN g.language IS NULL THEN 'global' ELSE coalesce(l.name, g.language) END AS language,
       round(CAST(g.x AS DOUBLE) / n, 8) AS mean_crossing_alignments, n_changed, n_unchanged
FROM g LEFT JOIN lookup l ON l.code = g.language"""


@register("e8_change_stats", _E8_SQL)
def q_e8(spark, d):
    from .queries import language_lookup
    p = E.apply_permuter(T.names(spark, d), "remove_parenthesis_permute_comma")
    p = p.withColumn("n_cross", A.crossing_count(E.token_alignment("original_text", "alias")))
    return E.change_stats(p, "n_cross", lookup=language_lookup(spark))


@register("e9_permutation_report", O.with_names() + f"""
SELECT wikidata_id, language, type, {E3_SQL} AS alias, alias AS original_text,
       {E3_SQL} IS NOT DISTINCT FROM alias AS is_unchanged FROM names_all""")
def q_e9(spark, d):
    return E.permutation_report(E.apply_permuter(T.names(spark, d), "remove_parenthesis_permute_comma"))


@register("e11_romanize", O.with_names() + "SELECT doc_id, line_no, strip_accents(alias) AS romanized FROM names_all")
def q_e11(spark, d):
    return _pos(spark, d).select("doc_id", "line_no", P.romanize(F.col("alias")).alias("romanized"))


@register("e12_add_romanized", O.with_names() + f"""
SELECT doc_id, line_no, strip_accents(alias) AS romanized,
       levenshtein({O.safe('lower(alias)')}, {O.safe('lower(strip_accents(alias))')}) AS distance
FROM names_all""")
def q_e12(spark, d):
    r = E.add_romanized(_pos(spark, d), with_distance=True)
    return r.select("doc_id", "line_no", "romanized", "distance")


# ------------------------------------------------------------------ F
@register("f1_alignment_pairs", O.with_names() + """
SELECT doc_id, line_no,
  array_to_string(list_filter(string_split(""" + O.strip("replace(alias, ' ', '▁')") + """, ''), lambda c: c <> ''), ' ')
  || ' ||| ' ||
  array_to_string(list_filter(string_split(replace(eng, ' ', '▁'), ''), lambda c: c <> ''), ' ') AS pair
FROM names_all""")
def q_f1(spark, d):
    return _pos(spark, d).select("doc_id", "line_no", A.alignment_pair(F.col("alias"), F.col("eng")).alias("pair"))


ALIGN_SQL = """
al AS (SELECT l_orderkey AS id,
              string_agg((l_suppkey % 4) || '-' || (l_partkey % 5), ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS before,
              string_agg((l_linenumber - 1) || '-' || (l_partkey % 5), ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS after
       FROM lineitem GROUP BY l_orderkey),
grp AS (SELECT al.*, o.o_orderstatus AS language FROM al JOIN orders o ON o.o_orderkey = al.id)"""


def _cross_sql(col: str, name: str) -> str:
    return f"""{name} AS (
  SELECT id, count(*) FILTER (WHERE t < coalesce(mx, 0)) AS n_cross FROM (
    SELECT id, t, max(t) OVER (PARTITION BY id ORDER BY s, pos
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx
    FROM (SELECT id, CAST(split_part(tok, '-', 1) AS INTEGER) AS s,
                 CAST(split_part(tok, '-', 2) AS INTEGER) AS t, pos
          FROM (SELECT id, unnest(string_split({col}, ' ')) AS tok,
                       generate_subscripts(string_split({col}, ' '), 1) AS pos FROM grp)))
  GROUP BY id)"""


def _alignments(spark, d):
    return FA.lineitem_alignments(T.table(spark, d, "lineitem"), T.table(spark, d, "orders"))


@register("f0_read_alignments", "WITH " + ALIGN_SQL + """
SELECT id, pos - 1 AS pos, CAST(split_part(tok, '-', 1) AS INTEGER) AS s,
       CAST(split_part(tok, '-', 2) AS INTEGER) AS t
FROM (SELECT id, unnest(string_split(before, ' ')) AS tok,
             generate_subscripts(string_split(before, ' '), 1) AS pos FROM grp)""")
def q_f0(spark, d):
    a = _alignments(spark, d).select("id", F.explode(A.parse_alignment(F.col("before"))).alias("p"))
    return a.select("id", F.col("p.pos").cast("long").alias("pos"), "p.s", "p.t")


@register("f3_crossing_count", "WITH " + ALIGN_SQL + "," + _cross_sql("before", "cb") + """
SELECT grp.id, grp.before AS alignment, coalesce(cb.n_cross, 0) AS n_cross
FROM grp LEFT JOIN cb USING (id)""")
def q_f3(spark, d):
    a = _alignments(spark, d)
    return a.select("id", F.col("before").alias("alignment"), A.crossing_count(F.col("before")).alias("n_cross"))


@register("f4_mean_crossing", "WITH " + ALIGN_SQL + "," + _cross_sql("before", "cb") + """
SELECT coalesce(language, 'global') AS language,
       round(sum(coalesce(n_cross, 0)) * 1.0 / count(*), 8) AS mean_crossing_alignments, count(*) AS n_names
FROM grp LEFT JOIN cb USING (id) GROUP BY GROUPING SETS ((language), ())""")
def q_f4(spark, d):
    a = _alignments(spark, d).withColumn("n_cross", A.crossing_count(F.col("before")))
    return FA.mean_crossing(a)


@register("f6_mca_change", "WITH " + ALIGN_SQL + "," + _cross_sql("before", "cb") + "," +
          _cross_sql("after", "ca") + """
, m AS (SELECT coalesce(language, 'global') AS language,
               round(sum(coalesce(cb.n_cross, 0)) * 1.0 / count(*), 8) AS before,
               round(sum(coalesce(ca.n_cross, 0)) * 1.0 / count(*), 8) AS after
        FROM grp LEFT JOIN cb USING (id) LEFT JOIN ca USING (id) GROUP BY GROUPING SETS ((language), ()))
SELECT language, before, after, round(after - before, 8) AS diff FROM m""")
def q_f6(spark, d):
    a = (_alignments(spark, d).withColumn("n_before", A.crossing_count(F.col("before")))
         .withColumn("n_after", A.crossing_count(F.col("after"))))
    b = FA.mean_crossing(a.withColumn("n_cross", F.col("n_before")))
    c = FA.mean_crossing(a.withColumn("n_cross", F.col("n_after")))
    return FA.mca_change(b, c)


@register("f7_join_results", "WITH " + ALIGN_SQL + "," + _cross_sql("before", "cb") + "," +
          _cross_sql("after", "ca") + """
, m1 AS (SELECT coalesce(language, 'global') AS language,
                round(sum(coalesce(cb.n_cross, 0)) * 1.0 / count(*), 8) AS mca_before
         FROM grp LEFT JOIN cb USING (id) GROUP BY GROUPING SETS ((language), ()))
, m2 AS (SELECT coalesce(language, 'global') AS language,
                round(sum(coalesce(ca.n_cross, 0)) * 1.0 / count(*), 8) AS mca_after
         FROM grp LEFT JOIN ca USING (id) GROUP BY GROUPING SETS ((language), ()))
, m3 AS (SELECT language, count(*) AS n_names FROM grp GROUP BY language)
SELECT language, mca_before, mca_after, n_names FROM m1 JOIN m2 USING (language) JOIN m3 USING (language)""")
def q_f7(spark, d):
    a = (_alignments(spark, d).withColumn("n_before", A.crossing_count(F.col("before")))
         .withColumn("n_after", A.crossing_count(F.col("after"))))
    m1 = FA.mean_crossing(a.withColumn("n_cross", F.col("n_before"))).select(
        "language", F.col("mean_crossing_alignments").alias("mca_before"))
    m2 = FA.mean_crossing(a.withColumn("n_cross", F.col("n_after"))).select(
        "language", F.col("mean_crossing_alignments").alias("mca_after"))
    m3 = a.groupBy("language").agg(F.count(F.lit(1)).alias("n_names"))
    return FA.join_results([m1, m2, m3], "language")


# ------------------------------------------------------------------ G
def _jacc_sql(a: str, b: str) -> str:
    sa = f"list_distinct(list_filter(string_split({a}, ''), lambda c: c <> ''))"
    sb = f"list_distinct(list_filter(string_split({b}, ''), lambda c: c <> ''))"
    return (f"(CASE WHEN len(list_distinct(list_concat({sa}, {sb}))) = 0 THEN 1.0 ELSE "
            f"len(list_intersect({sa}, {sb})) * 1.0 / len(list_distinct(list_concat({sa}, {sb}))) END)")


@register("g2_char_jaccard", O.with_names() +
          f"SELECT doc_id, line_no, round({_jacc_sql('alias', 'eng')}, 6) AS jaccard FROM names_all")
def q_g2(spark, d):
    return _pos(spark, d).select("doc_id", "line_no",
                                 F.round(G.char_jaccard(F.col("alias"), F.col("eng")), 6).alias("jaccard"))


@register("g3_filter_similar", O.with_names() +
          f"SELECT doc_id, line_no, {_jacc_sql('alias', 'eng')} >= 0.95 AS flagged FROM names_all")
def q_g3(spark, d):
    from ..operators import similarity as GS
    kept, flagged = GS.filter_similar(_pos(spark, d), 0.95, exact=True)
    return (kept.select("doc_id", "line_no", F.lit(False).alias("flagged"))
            .unionByName(flagged.select("doc_id", "line_no", F.lit(True).alias("flagged"))))


def _minhash_sql(x: str) -> str:
    hashes = f"list_transform(list_filter(list_distinct(string_split({x}, '')), lambda c: c <> ''), lambda c: CAST('0x' || substr(md5(c), 1, 7) AS BIGINT))"
    return f"list_transform(perms, lambda p: coalesce(list_min(list_transform({hashes}, lambda h: (p.a * h + p.b) % {G.PRIME})), {G.PRIME}))"


def _g1_sql() -> str:
    rows = ", ".join(f"{{'a': {a}::BIGINT, 'b': {b}::BIGINT}}" for a, b in G.permutations())
    return O.with_names(f"perms AS (SELECT [{rows}] AS perms)") + f"""
, s AS (SELECT doc_id, line_no, alias, eng, {_minhash_sql('alias')} AS x, {_minhash_sql('eng')} AS y FROM names_all, perms)
SELECT doc_id, line_no, len(list_filter(list_zip(x, y), lambda z: z[1] = z[2])) / {G.NUM_PERM} AS jaccard_estimate FROM s"""


@register("g1_minhash_jaccard", _g1_sql())
def q_g1(spark, d):
    return _pos(spark, d).select("doc_id", "line_no",
                                 G.minhash_jaccard(F.col("alias"), F.col("eng")).alias("jaccard_estimate"))


def _g3_minhash_sql() -> str:
    return _g1_sql().replace("AS jaccard_estimate FROM s", ">= 0.95 AS flagged FROM s")


@register("g3_filter_similar_minhash", _g3_minhash_sql())
def q_g3_minhash(spark, d):
    from ..operators import similarity as GS
    kept, flagged = GS.filter_similar(_pos(spark, d), 0.95)
    return (kept.select("doc_id", "line_no", F.lit(False).alias("flagged"))
            .unionByName(flagged.select("doc_id", "line_no", F.lit(True).alias("flagged"))))


@register("e10_anomaly_report", O.with_names(*__import__("namekit.plans.q_script", fromlist=["TAG_CTES"]).TAG_CTES) + """
SELECT CASE WHEN v1 + v2 + v3 + v4 + v5 > 0 THEN 'anomalous' ELSE 'non_anomalous' END AS category,
       v.wikidata_id, v.language, v.type, v.alias, coalesce(dm.block, '') AS most_common_unicode_block
FROM votes v LEFT JOIN dmode dm ON dm.doc_id = v.doc_id AND dm.line_no = v.line_no""")
def q_e10(spark, d):
    from ..operators import script as D
    return E.anomaly_report(D.tag_names(T.names(spark, d), keep_block=E.BLOCK))


@register("e13_edit_distance", "WITH RECURSIVE " + __import__("namekit.plans.q_kb", fromlist=["ENTS_SQL"]).ENTS_SQL.strip() + f"""
SELECT s.id AS wikidata_id, l.language, l.value AS alias, s.name,
       levenshtein({O.safe('l.value')}, {O.safe('s.name')}) AS distance
FROM simple s JOIN labels l USING (id)""")
def q_e13(spark, d):
    from ..operators import kb as B
    from .resource import ingest
    n = B.explode_names(ingest(spark, d), "NONE")
    return n.select("wikidata_id", "language", "alias", "name",
                    P.edit_distance(F.col("alias"), F.col("name")).alias("distance"))


def _f5_sql() -> str:
    from .em_sql import crossings_sql, em_sql
    from .q_kb import DUMP_NAMES_SQL, _sql
    def mean(al, by):
        on = " AND c.language = d.language" if by else ""
        return f"""SELECT coalesce(d.language, 'global') AS language, round(CAST(sum(coalesce(n_cross, 0)) AS DOUBLE) / count(*), 8) AS mca
  FROM dnames d LEFT JOIN {al} c ON c.text = d.alias AND c.eng = d.name{on} GROUP BY GROUPING SETS ((d.language), ())"""
    return _sql(DUMP_NAMES_SQL + ", " + em_sql("dnames", "alias", "name", 3, name="pool") + ", " + crossings_sql("pool", "px")
                + ", " + em_sql("dnames", "alias", "name", 3, by="language", name="sep") + ", " + crossings_sql("sep", "sx") + f"""
SELECT language, a.mca AS mca_pooled, b.mca AS mca_separate
FROM ({mean("px", False)}) a JOIN ({mean("sx", True)}) b USING (language)""")


@register("f5_pooled_vs_separate", _f5_sql())
def q_f5(spark, d):
    """F2 trained once on all languages and once per language; mean
    crossings of both, joined per language."""
    from .resource import typed_names
    n = typed_names(spark, d).select("alias", F.col("name").alias("eng"), "language")
    # equal names are one row with their number; a pair has as many of them as languages
    n = n.groupBy("language", "alias", "eng").agg(F.count(F.lit(1)).alias("n"))
    pooled = FA.align_characters(n, iterations=3, weight="n", carry=[F.collect_list(F.struct("language", "n")).alias("of")])
    sep = FA.align_characters(n, iterations=3, by="language", weight="n")
    jp = pooled.select("of", A.column_crossings("alignment").alias("n_cross")).select("n_cross", F.inline("of"))
    # a name without a language has no model of its own
    js = sep.select("language", F.when(F.col("language").isNotNull(), A.column_crossings("alignment")).alias("n_cross"),
                    F.col("w").alias("n"))
    a = FA.mean_crossing(jp, weight="n").select("language", F.col("mean_crossing_alignments").alias("mca_pooled"))
    b = FA.mean_crossing(js, weight="n").select("language", F.col("mean_crossing_alignments").alias("mca_separate"))
    return FA.join_results([a, b], "language")
