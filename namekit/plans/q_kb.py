"""Registered queries: dump reading (A5-A7) and knowledge-base extraction (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kb as B
from ..sources import dump as DU
from .em_sql import crossings_sql, em_sql
from .oracle import perm_values, permuted_sql, strip, strip_paren
from .registry import register

ENTS_SQL = """
po AS (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey))) AS parts,
              min({'ln': l_linenumber, 'pk': l_partkey}) AS first FROM lineitem GROUP BY l_orderkey),
ents AS (
  SELECT 'Q' || CAST(o.o_orderkey AS VARCHAR) AS id, o.o_orderstatus, o.o_orderpriority, c.c_name, n.n_name,
         (['de', 'fr', 'es', 'it', 'nl'])[n.n_regionkey + 1] AS rl, po.parts, p.p_name
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN po ON po.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON p.p_partkey = po.first.pk),
labels AS (
  SELECT id, 'en' AS language, c_name AS value FROM ents WHERE o_orderstatus <> 'P'
  UNION ALL SELECT id, rl, concat_ws(', ', n_name, c_name) FROM ents WHERE rl IS NOT NULL
  UNION ALL SELECT id, 'pt', p_name FROM ents WHERE p_name IS NOT NULL),
inst AS (
  SELECT id, CASE WHEN o_orderpriority = '5-LOW' THEN []::VARCHAR[]
                  ELSE list_transform(coalesce(parts, []::BIGINT[]), lambda k: 'Q' || CAST(k AS VARCHAR)) END AS instance_of
  FROM ents),
simple AS (
  SELECT e.id, coalesce((SELECT value FROM labels l WHERE l.id = e.id AND l.language = 'en'), e.id) AS name,
         i.instance_of,
         (SELECT list_sort(list(language)) FROM labels l WHERE l.id = e.id) AS languages
  FROM ents e JOIN inst i USING (id)),
edges AS (SELECT 'Q' || CAST(p_partkey AS VARCHAR) AS child, 'Q' || CAST(p_partkey // 2 AS VARCHAR) AS parent
          FROM part WHERE p_partkey >= 1),
roots(type, root) AS (VALUES ('PER', 'Q3'), ('LOC', 'Q4'), ('ORG', 'Q5')),
cl(type, class) AS (SELECT type, root FROM roots
                    UNION SELECT cl.type, e.child FROM cl JOIN edges e ON e.parent = cl.class)
"""


def _sql(body: str) -> str:
    return "WITH RECURSIVE " + ENTS_SQL.strip() + "\n" + body


def _entities(spark, d):
    return DU.parse_entity_lines(DU.build_dump_lines(spark, d)).filter(~F.col("_corrupt")).drop("_corrupt")


def _simple(spark, d):
    return B.simplify_entities(_entities(spark, d))


def _closure(spark, d):
    return B.subclass_closure(DU.class_edges(spark, d), DU.type_roots(spark))


def _sorted_join(c):
    return F.array_join(F.array_sort(c), ",")


def _dump_files(spark, d):
    """The dump as files, sorted by entity over all of them, with two kinds of bad lines after every entity whose
    number ends in 0: text after the object, and two objects."""
    from ..sources.io import scratch_path
    path = scratch_path(spark, "dump")
    lines = DU.build_dump_lines(spark, d).withColumn("key", F.coalesce(F.get_json_object("value", "$.id"), F.lit("")))
    bad = lines.where("key LIKE 'Q%0'").select(F.explode(F.array(*[
        F.struct(F.concat(t, F.lit(",")).alias("value"), F.concat("key", F.lit(k)).alias("key"))
        for k, t in (("!", F.format_string('{"id":"%s"} text}', "key")), ("!!", F.format_string('{"id":"%s"}{"id":"Q1"}', "key")))])).alias("b")).select("b.*")
    lines.unionByName(bad).orderBy("key", "value").select("value").write.text(path)
    return path


_DUMP_LINES_SQL = """
, dump_lines AS (
  SELECT id AS key, id, TRUE AS good FROM ents
  UNION ALL SELECT '', NULL, FALSE FROM range(2)
  UNION ALL SELECT id || b, NULL, FALSE FROM ents, (VALUES ('!'), ('!!')) v(b) WHERE id LIKE 'Q%0')"""


@register("a5_read_entity_dump", _sql("""
SELECT e.id, (SELECT count(*) FROM labels l WHERE l.id = e.id) AS n_labels,
       CAST(len(coalesce(e.parts, []::BIGINT[])) + CASE WHEN e.o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS BIGINT) AS n_p31
FROM ents e"""))
def q_a5(spark, d):
    e = DU.read_entity_dump(spark, _dump_files(spark, d))
    return e.select("id", F.size("labels").cast("long").alias("n_labels"),
                    F.size(F.coalesce(F.col("claims.P31"), F.array())).cast("long").alias("n_p31"))


@register("a6_dump_decode_errors", _sql(_DUMP_LINES_SQL + """
SELECT count(*) FILTER (WHERE NOT good) AS n_errors, count(*) FILTER (WHERE good) AS n_entities FROM dump_lines"""))
def q_a6(spark, d):
    return DU.dump_decode_errors(DU.read_entity_dump(spark, _dump_files(spark, d), with_errors=True))


@register("a7_take_dump_prefix", _sql(_DUMP_LINES_SQL + """
SELECT id, CAST(line_id AS BIGINT) AS line_id
FROM (SELECT *, row_number() OVER (ORDER BY key) AS line_id FROM dump_lines) WHERE good AND line_id <= 100"""))
def q_a7(spark, d):
    parsed = DU.read_entity_dump(spark, _dump_files(spark, d), with_errors=True)
    return DU.take_dump_prefix(parsed, 100).select("id", "line_id")


@register("b1_simplify_entities", _sql("""
SELECT id, name, array_to_string(list_sort(instance_of), ',') AS instance_of,
       array_to_string(languages, ',') AS languages,
       (SELECT string_agg(language || '=' || value, ';' ORDER BY language) FROM labels l WHERE l.id = s.id) AS aliases
FROM simple s"""))
def q_b1(spark, d):
    s = _simple(spark, d)
    al = F.array_join(F.transform(F.array_sort(F.map_entries("aliases")),
                                  lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return s.select("id", "name", _sorted_join(F.col("instance_of")).alias("instance_of"),
                    _sorted_join(F.col("languages")).alias("languages"), al.alias("aliases"))


@register("b2_instance_of_lenient", _sql("""
SELECT id, array_to_string(list_sort(list_transform(coalesce(parts, []::BIGINT[]), lambda k: 'Q' || CAST(k AS VARCHAR))), ',')
       AS instance_of FROM ents"""))
def q_b2(spark, d):
    e = _entities(spark, d)
    return e.select("id", _sorted_join(B.instance_of(reference_mode=False)).alias("instance_of"))


@register("b5_entity_name", _sql("SELECT id, name FROM simple"))
def q_b5(spark, d):
    return _entities(spark, d).select("id", B.entity_name().alias("name"))


@register("b6_is_instance_of", _sql("""
SELECT id FROM simple WHERE list_has_any(instance_of, ['Q3', 'Q4', 'Q5', 'Q6', 'Q7'])"""))
def q_b6(spark, d):
    return B.is_instance_of(_simple(spark, d), ["Q3", "Q4", "Q5", "Q6", "Q7"]).select("id")


@register("b7_has_claim", _sql("""
SELECT count(*) AS n FROM ents WHERE len(coalesce(parts, []::BIGINT[])) > 0 OR o_orderpriority = '5-LOW'"""))
def q_b7(spark, d):
    return B.has_claim(_entities(spark, d)).agg(F.count(F.lit(1)).alias("n"))


@register("b8_subclass_closure", _sql("SELECT type, class FROM cl"))
def q_b8(spark, d):
    return _closure(spark, d)


@register("b9_filter_by_class", _sql("""
SELECT DISTINCT s.id FROM simple s, unnest(s.instance_of) u(c) JOIN cl ON cl.class = u.c WHERE cl.type = 'PER'"""))
def q_b9(spark, d):
    return B.filter_by_class(_simple(spark, d), _closure(spark, d), "PER").select("id")


@register("b10_filter_by_any_language", _sql("SELECT id FROM simple WHERE list_has_any(languages, ['en'])"))
def q_b10(spark, d):
    return B.filter_by_any_language(_simple(spark, d)).select("id")


@register("b11_filter_by_ids", _sql("""
SELECT s.id, s.name FROM simple s WHERE s.id IN
  (SELECT 'Q' || CAST(o_orderkey AS VARCHAR) FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
   WHERE c.c_mktsegment = 'BUILDING')"""))
def q_b11(spark, d):
    from ..sources.tables import table
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    ids = o.join(c, o.o_custkey == c.c_custkey, "left_semi").select(
        F.concat(F.lit("Q"), F.col("o_orderkey").cast("string")).alias("id"))
    return B.filter_by_ids(_simple(spark, d), ids).select("id", "name")


@register("b12_limit_entities", _sql("SELECT id, name FROM simple ORDER BY id LIMIT 100"))
def q_b12(spark, d):
    return B.limit_entities(_simple(spark, d), 100).select("id", "name")


@register("b13_explode_names", _sql("""
SELECT s.id AS wikidata_id, s.name, l.language, l.value AS alias, 'NONE' AS type
FROM simple s JOIN labels l USING (id)"""))
def q_b13(spark, d):
    return B.explode_names(_simple(spark, d), "NONE")


@register("b14_filter_output_languages", _sql("""
SELECT s.id AS wikidata_id, s.name, l.language, l.value AS alias, 'NONE' AS type
FROM simple s JOIN labels l USING (id) WHERE l.language IN ('en', 'de', 'pt') AND l.language NOT IN ('pt')"""))
def q_b14(spark, d):
    n = B.explode_names(_simple(spark, d), "NONE")
    return B.filter_output_languages(n, include=["en", "de", "pt"], exclude=["pt"], strict=True)


DUMP_NAMES_SQL = """
, typed AS (SELECT DISTINCT s.id, cl.type FROM simple s, unnest(s.instance_of) u(c) JOIN cl ON cl.class = u.c
            WHERE list_has_any(s.languages, ['en']))
, dnames AS (SELECT s.id AS wikidata_id, s.name, l.language, l.value AS alias, t.type
             FROM typed t JOIN simple s USING (id) JOIN labels l ON l.id = s.id)
"""


@register("b15_dump_names", _sql(DUMP_NAMES_SQL + "SELECT * FROM dnames"))
def q_b15(spark, d):
    return B.dump_names(_simple(spark, d), _closure(spark, d))


@register("b16_collect_instance_of", _sql("""
SELECT s.id, array_to_string(list_sort(list(u.c)), ',') AS instance_of, min(s.name) AS name
FROM simple s, unnest(s.instance_of) u(c) GROUP BY s.id"""))
def q_b16(spark, d):
    ex = _simple(spark, d).select("id", F.explode("instance_of").alias("instance_of"), "name")
    g = B.collect_instance_of(ex)
    return g.select("id", F.array_join("instance_of", ",").alias("instance_of"), "name")


@register("b17_upsert_entities", _sql("""
, base AS (SELECT id, name FROM simple)
, upd AS (SELECT s.id, upper(s.name) AS name FROM simple s JOIN ents e USING (id) WHERE e.o_orderstatus = 'F'
          UNION ALL SELECT 'P' || CAST(p_partkey AS VARCHAR), p_name FROM part)
SELECT coalesce(b.id, u.id) AS id, coalesce(u.name, b.name) AS name FROM base b FULL OUTER JOIN upd u USING (id)"""))
def q_b17(spark, d):
    from ..sources.tables import table
    s = _simple(spark, d)
    e = _entities(spark, d)
    status = table(spark, d, "orders").select(
        F.concat(F.lit("Q"), F.col("o_orderkey").cast("string")).alias("id"), "o_orderstatus")
    upd = (s.join(status, "id").filter(F.col("o_orderstatus") == "F").select("id", F.upper("name").alias("name"))
           .unionByName(table(spark, d, "part").select(
               F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"))))
    del e
    return B.upsert_entities(s.select("id", "name"), upd)


# ------------------------------------------------------------------ entry points
PIPE_ALLOW = [("en", ["BASIC_LATIN"])]


def _resource_post_sql() -> str:
    return f"""
, pn AS (SELECT wikidata_id, name AS eng, alias, language, type FROM dnames WHERE starts_with(wikidata_id, 'Q'))
, ptypes AS (SELECT wikidata_id, count(*) AS n_types, string_agg(type, '-' ORDER BY type) AS types
             FROM (SELECT DISTINCT wikidata_id, type FROM pn) GROUP BY wikidata_id)
, prules(types, canon) AS (VALUES ('LOC-ORG', 'LOC'), ('LOC-ORG-PER', 'ORG'), ('ORG-PER', 'ORG'), ('LOC-PER', 'PER'))
, pd AS (SELECT DISTINCT p.wikidata_id, p.eng, p.alias, p.language,
                coalesce(CASE WHEN t.n_types > 1 THEN r.canon END, p.type) AS type
         FROM pn p JOIN ptypes t USING (wikidata_id) LEFT JOIN prules r ON r.types = t.types)
, pc AS (SELECT wikidata_id, {strip_paren('eng')} AS eng, {strip_paren('alias')} AS alias, language, type FROM pd)
"""


def _resource_sql() -> str:
    from .q_script import tag_ctes
    body = DUMP_NAMES_SQL + _resource_post_sql() + """
, unl AS (SELECT * FROM pc WHERE language <> 'en')
, """ + ",\n".join(tag_ctes("unl", ["wikidata_id", "language"])) + """
, """ + ",\n".join(tag_ctes("pc", ["wikidata_id", "language"], p="l_")[:3]) + """
, lst AS (SELECT pc.*, coalesce(m.block, '') AS block FROM pc
          LEFT JOIN l_dmode m ON m.wikidata_id = pc.wikidata_id AND m.language = pc.language
          WHERE pc.language = 'en')
SELECT wikidata_id, eng, alias, language, type FROM lst WHERE block IN ('BASIC_LATIN')
UNION ALL
SELECT wikidata_id, eng, alias, language, type FROM t_votes WHERE NOT anomalous"""
    return _sql(body)


@register("resource_build", _resource_sql())
def q_resource_build(spark, d):
    from .resource import build_resource
    allow = spark.createDataFrame(PIPE_ALLOW, "language_code string, scripts array<string>")
    return build_resource(spark, d, allow)


_POST_SQL = _resource_post_sql()

CROSSING_SQL = _sql(DUMP_NAMES_SQL + _POST_SQL + f"""
, {perm_values()}
, cn AS (SELECT row_number() OVER () AS rn, wikidata_id, eng, alias, language, type FROM pc)
, {permuted_sql("cn", "rn", "alias", "eng")}
, ex AS (SELECT language, eng, t AS alias, t IS NOT DISTINCT FROM alias AS is_unchanged
         FROM cn JOIN permuted USING (rn) WHERE {strip('t')} <> '' AND eng <> wikidata_id)
, {em_sql("ex", "alias", "eng", 5)}
, {crossings_sql("al")}
, g AS (SELECT language, coalesce(sum(n_cross), 0) AS x, count(*) AS n, count(*) FILTER (WHERE NOT is_unchanged) AS n_changed,
               count(*) FILTER (WHERE is_unchanged) AS n_unchanged
        FROM ex LEFT JOIN xc ON xc.text = ex.alias AND xc.eng = ex.eng GROUP BY GROUPING SETS ((language), ()))
SELECT coalesce(language, 'global') AS language, round(CAST(x AS DOUBLE) / n, 8) AS mean_crossing_alignments, n_changed, n_unchanged
FROM g""")


@register("crossing_experiment", CROSSING_SQL)
def q_crossing_experiment(spark, d):
    from .resource import crossing_experiment
    return crossing_experiment(spark, d)


@register("f2_align_characters", _sql(DUMP_NAMES_SQL + ", " + em_sql("dnames", "alias", "name", 5) + """
SELECT text AS alias, eng, w, alignment FROM al"""))
def q_f2(spark, d):
    from ..operators import align as FA
    from .resource import typed_names
    n = typed_names(spark, d).select("alias", F.col("name").alias("eng"))
    return FA.align_characters(n, iterations=5)


@register("b3_labels_map", _sql("""
SELECT id, (SELECT string_agg(language || '=' || coalesce(value, ''), ';' ORDER BY language)
            FROM labels l WHERE l.id = e.id) AS labels FROM ents e"""))
def q_b3(spark, d):
    e = _entities(spark, d).select("id", B.labels_map().alias("m"))
    s = F.array_join(F.transform(F.array_sort(F.map_entries("m")),
                                 lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit("")))), ";")
    return e.select("id", F.when(F.size("m") > 0, s).alias("labels"))


@register("b4_label_languages", _sql("""
SELECT id, (SELECT string_agg(language, ',' ORDER BY language) FROM labels l WHERE l.id = e.id) AS languages
FROM ents e"""))
def q_b4(spark, d):
    e = _entities(spark, d).select("id", B.label_languages().alias("l"))
    return e.select("id", F.when(F.size("l") > 0, F.array_join(F.array_sort("l"), ",")).alias("languages"))
