"""Registered queries: sources and sinks (A) and streaming (S). Each writes
data derived from the driver tables to a fresh folder under the checkpoint
folder and reads it back with the operator under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import html as HT
from ..sources import io as IO
from ..sources import tables as T
from . import oracle as O
from .registry import register

NAMES5 = "wikidata_id, eng, alias, language, type"
NA_SQL = "(" + ", ".join("'" + t.replace("'", "''") + "'" for t in __import__(
    "namekit.functions.text", fromlist=["NA_TOKENS"]).NA_TOKENS) + ")"


def _na(c: str) -> str:
    return f"CASE WHEN {c} IN {NA_SQL} THEN NULL ELSE {c} END AS {c}"


@register("a1_read_names_tsv", O.with_names() + "SELECT " + ", ".join(_na(c) for c in NAMES5.split(", ")) + " FROM names")
def q_a1(spark, d):
    path = IO.scratch_path(spark, "names-tsv")
    IO.write_names(T.names(spark, d), path, "tsv")
    return IO.read_names(spark, path, "tsv", IO.NAME_COLUMNS)


@register("a3_write_names_jsonl", O.with_names() + f"SELECT {NAMES5} FROM names")
def q_a3(spark, d):
    path = IO.scratch_path(spark, "names-jsonl")
    IO.write_names(T.names(spark, d), path, "jsonl")
    return IO.read_names(spark, path, "jsonl", IO.NAME_COLUMNS)


@register("a4_write_projected", O.with_names() + "SELECT " + ", ".join(_na(c) for c in ("wikidata_id", "alias")) + " FROM names")
def q_a4(spark, d):
    path = IO.scratch_path(spark, "projected")
    IO.write_projected(T.names(spark, d), path, ["wikidata_id", "alias"], "tsv")
    return IO.read_names(spark, path, "tsv", ["wikidata_id", "alias"])


@register("a8_write_by_language", O.with_names() + f"SELECT {NAMES5} FROM names")
def q_a8(spark, d):
    path = IO.scratch_path(spark, "by-language")
    IO.write_by_language(T.names(spark, d), path)
    return spark.read.parquet(path).select(*IO.NAME_COLUMNS)


@register("a8_write_language_folders", O.with_names() + f"SELECT {NAMES5} FROM names WHERE language IN ('en', 'fr')")
def q_a8_folders(spark, d):
    path = IO.scratch_path(spark, "language-folders")
    IO.write_by_language(T.names(spark, d), path, use_subfolders=True)
    return spark.read.parquet(f"{path}/en", f"{path}/fr").select(*IO.NAME_COLUMNS)


@register("a18_write_by_language_and_type", O.with_names() +
          "SELECT language, type, count(*) AS n FROM names GROUP BY language, type")
def q_a18(spark, d):
    path = IO.scratch_path(spark, "by-language-type")
    IO.write_by_language_and_type(T.names(spark, d), path)
    return spark.read.parquet(path).groupBy("language", "type").agg(F.count(F.lit(1)).alias("n"))


@register("a9_read_code_lookup", "SELECT DISTINCT lang AS code, upper(lang) AS name FROM documents")
def q_a9(spark, d):
    path = IO.scratch_path(spark, "lookup")
    langs = T.table(spark, d, "documents").select(F.col("lang").alias("k")).distinct()
    (langs.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", F.upper("k"))))).alias("value"))
     .write.mode("overwrite").text(path))
    return IO.read_code_lookup(spark, path)


@register("a10_read_script_allowlist", """
SELECT DISTINCT lang AS language_code, ['BASIC_LATIN', 'LATIN_EXTENDED_LETTER'] AS scripts FROM documents""")
def q_a10(spark, d):
    path = IO.scratch_path(spark, "allow")
    langs = T.table(spark, d, "documents").select(F.col("lang").alias("language_code")).distinct()
    langs.withColumn("scripts_to_keep", F.lit("BASIC_LATIN, LATIN_EXTENDED_LETTER")) \
        .write.mode("overwrite").options(header="true", sep="\t").csv(path)
    return IO.read_script_allowlist(spark, path)


def _outputs(spark, d):
    from .q_eval import _outputs as outs
    return outs(spark, d)


def _a11_sql():
    from .q_names import E3_SQL
    st = O.strip
    src = "'<' || language || '> ' || regexp_replace(alias, '[\\r\\n]', ' ', 'g')"
    return O.with_names() + f"""
, o AS (SELECT language AS lg, regexp_replace(alias, '[\\r\\n]', ' ', 'g') AS ref,
               regexp_replace({E3_SQL}, '[\\r\\n]', ' ', 'g') AS hyp, {src} AS src FROM names_all)
SELECT trim(translate(substr(src, 1, CASE WHEN substr(src, 6, 1) = '>' THEN 5 ELSE strpos(src, '>') - 1 END), '<>', ''))
         AS language, {st('ref')} AS reference, {st('hyp')} AS hypothesis, {st('src')} AS source FROM o"""


@register("a11_parse_tagged_outputs", _a11_sql())
def q_a11(spark, d):
    base = IO.scratch_path(spark, "tagged")
    IO.write_parallel_lines(_outputs(spark, d), base, ["hypothesis", "reference", "source"])
    return IO.parse_tagged_outputs(spark, *(f"{base}/file={i}" for i in range(3)))


@register("a12_parse_combined_outputs", O.with_names() + """
SELECT trim(translate(substr(src, 1, 5), '<>', '')) AS language, ref AS reference, hyp AS hypothesis, src AS source
FROM (SELECT CASE WHEN h IN """ + NA_SQL + """ THEN NULL ELSE h END AS hyp,
             CASE WHEN alias IN """ + NA_SQL + """ THEN NULL ELSE alias END AS ref,
             '<' || language || '> ' || alias AS src
      FROM (SELECT *, """ + __import__("namekit.plans.q_names", fromlist=["E3_SQL"]).E3_SQL + """ AS h FROM names_all))""")
def q_a12(spark, d):
    path = IO.scratch_path(spark, "combined")
    o = _outputs(spark, d).select(F.col("hypothesis").alias("hyp"), F.col("reference").alias("ref"),
                                  F.col("source").alias("src"))
    IO.write_names(o, path, "tsv")
    return IO.parse_combined_outputs(spark, path)


def _cells_sql() -> str:
    """DuckDB version of the <ul>/<li> extraction: cell text = inner HTML
    without tags, with the five XML entities decoded."""
    txt = "regexp_replace(x, '<[^>]*>', '', 'g')"
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        txt = f"replace({txt}, '{ent}', '{ch}')"
    return f"""cells AS (
  SELECT page_id, CAST(generate_subscripts(uls, 1) - 1 AS INTEGER) AS row_ix,
         list_transform(regexp_extract_all(unnest(uls), '<li[^>]*>(.*?)</li>', 1), lambda x: {txt}) AS cells
  FROM (SELECT page_id, regexp_extract_all(html, '<ul[^>]*>(.*?)</ul>', 1) AS uls FROM pages))"""


def _a14_sql() -> str:
    key = O.strip("cells[1]")
    val = O.strip("replace(cells[2], ' (closed)', '')")
    return "WITH " + _cells_sql() + f"""
, kv AS (SELECT {key} AS key, {val} AS value, page_id, row_ix FROM cells)
SELECT key, arg_max(value, {{'p': page_id, 'r': row_ix}}) AS value FROM kv WHERE key IS NOT NULL GROUP BY key"""


@register("a13_extract_html_tables", "WITH " + _cells_sql() + " SELECT page_id, row_ix, cells FROM cells")
def q_a13(spark, d):
    return HT.extract_html_tables(T.table(spark, d, "pages"), "ul", "li", skip_header=False)


@register("a14_table_to_lookup", _a14_sql())
def q_a14(spark, d):
    cells = HT.extract_html_tables(T.table(spark, d, "pages"), "ul", "li", skip_header=False)
    return HT.table_to_lookup(cells, 0, 1)


@register("a15_union_type_dumps", O.with_names() + f"""
SELECT {NAMES5} FROM names WHERE type = 'PER' UNION ALL SELECT {NAMES5} FROM names WHERE type = 'LOC'
UNION ALL SELECT {NAMES5} FROM names WHERE type = 'ORG'""")
def q_a15(spark, d):
    n = T.names(spark, d)
    return IO.union_type_dumps([IO.split_by_type(n, t) for t in ("PER", "LOC", "ORG")])


@register("a16_split_by_type", O.with_names() + f"SELECT {NAMES5} FROM names WHERE type = 'PER'")
def q_a16(spark, d):
    return IO.split_by_type(T.names(spark, d), "PER")


@register("a17_write_jsonl", O.with_names() + f"SELECT {NAMES5} FROM names")
def q_a17(spark, d):
    path = IO.scratch_path(spark, "jsonl")
    IO.write_jsonl(T.names(spark, d), path)
    return IO.read_names(spark, path, "jsonl", IO.NAME_COLUMNS)


# ------------------------------------------------------------------ streaming
@register("s2_stream_language_counts", O.with_names() + """
SELECT language, type, count(*) AS count FROM names WHERE length(language) > 0 GROUP BY language, type""")
def q_s2(spark, d):
    from ..streaming.stream import current_counts, stream_language_counts
    base = IO.scratch_path(spark, "stream-counts")
    # the source folder receives the names as JSON shards, as many as the rows' tasks
    T.names(spark, d).write.mode("overwrite").json(f"{base}/in")
    q = stream_language_counts(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    return current_counts(spark, f"{base}/out")


def _s1_sql():
    from .q_kb import _sql
    return _sql("SELECT id, name, array_to_string(list_sort(instance_of), ',') AS instance_of FROM simple")


@register("s1_stream_entities", _s1_sql())
def q_s1(spark, d):
    from ..sources.dump import build_dump_lines
    from ..streaming.stream import current_entities, stream_entities
    base = IO.scratch_path(spark, "stream-entities")
    build_dump_lines(spark, d).write.mode("overwrite").text(f"{base}/in")
    q = stream_entities(spark, f"{base}/in", f"{base}/log", f"{base}/ckpt")
    q.awaitTermination()
    ents = current_entities(spark, f"{base}/log")
    return ents.select("id", "name", F.array_join(F.array_sort("instance_of"), ",").alias("instance_of"))


def _s1_names_sql():
    from .q_kb import DUMP_NAMES_SQL, _sql
    return _sql(DUMP_NAMES_SQL + "SELECT * FROM dnames")


@register("s1_stream_names", _s1_names_sql())
def q_s1_names(spark, d):
    from ..operators import kb as B
    from ..session import shuffles_freed
    from ..sources.dump import build_dump_lines, class_edges, type_roots
    from ..streaming.stream import compact_entities, current_names, stream_entities
    base = IO.scratch_path(spark, "stream-names")
    with shuffles_freed(spark):
        # the shards are many times the tables as text
        (build_dump_lines(spark, d).write.mode("overwrite").option("zlib.compress.level", "BEST_SPEED")
         .text(f"{base}/in", compression="gzip"))
        closure = B.subclass_closure(class_edges(spark, d), type_roots(spark))
        stream_entities(spark, f"{base}/in", f"{base}/table", f"{base}/ckpt", closure=closure).awaitTermination()
        compact_entities(spark, f"{base}/table")
    return current_names(spark, f"{base}/table")
