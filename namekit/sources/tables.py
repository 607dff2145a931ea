"""Access to the parquet tables of a scale-factor folder and the views this
engine derives from them (see README, "Inputs").

``names_from_documents`` is the name table used by the registered queries:
every line of every document (whole text, nothing cut) is one name row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

TYPES = ["PER", "LOC", "ORG"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_parallelism(df: DataFrame) -> DataFrame:
    """Spread rows over the cluster's cores when the source scan produced
    fewer partitions than that (e.g. one unsplittable file). Only planning is
    needed to decide; a large, well-split input is left untouched, so no
    shuffle is added at scale."""
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < target:
            return df.repartition(target)
    except Exception:  # no SparkContext access (e.g. Spark Connect): keep the plan
        pass
    return df


def names_from_documents(documents: DataFrame, with_position: bool = False) -> DataFrame:
    """One name row per document line.

    wikidata_id = 'Q' || doc_id, alias = the line, eng = first line of the
    document, language = lang, type = PER/LOC/ORG rotating with the line
    number (so an entity with several lines carries several types, the input
    of type disambiguation).
    """
    # the first line is taken before the explode, so it is cut out once per
    # document and not once per line
    docs = documents.select("doc_id", "lang", F.split(F.col("text"), "\n").alias("_lines"))
    docs = docs.select("doc_id", "lang", "_lines", F.element_at("_lines", 1).alias("eng"))
    # outer explode: no inferred size/null filters that would split the whole
    # text again; a null text gives one null row, removed right after
    exploded = (docs.select("doc_id", "lang", "eng",
                            F.posexplode_outer("_lines").alias("line_no", "alias"))
                .filter(F.col("line_no").isNotNull()))
    exploded = exploded.withColumn("line_no", F.col("line_no").cast("long"))
    out = exploded.select(
        F.concat(F.lit("Q"), F.col("doc_id").cast("string")).alias("wikidata_id"),
        "eng", "alias", F.col("lang").alias("language"),
        F.element_at(F.array(*[F.lit(t) for t in TYPES]),
                     F.pmod(F.col("doc_id") + F.col("line_no"), F.lit(3)).cast("int") + 1
                     ).alias("type"),
        "doc_id", "line_no")
    out = ensure_parallelism(out)
    if not with_position:
        out = out.drop("doc_id", "line_no")
    return out


def names(spark: SparkSession, sf_dir: str, with_position: bool = False) -> DataFrame:
    return names_from_documents(
        table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), with_position)


# SQL text of the same view for oracle queries (DuckDB dialect).
NAMES_SQL = """
names_src AS (
  SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents
),
names_pos AS (
  SELECT 'Q' || CAST(doc_id AS VARCHAR) AS wikidata_id, ls[1] AS eng,
         unnest(ls) AS alias, lang AS language,
         doc_id, generate_subscripts(ls, 1) - 1 AS line_no
  FROM names_src
),
names_all AS (
  SELECT wikidata_id, eng, alias, language,
         (['PER', 'LOC', 'ORG'])[CAST((doc_id + line_no) % 3 AS INTEGER) + 1] AS type,
         doc_id, line_no
  FROM names_pos
),
names AS (SELECT wikidata_id, eng, alias, language, type FROM names_all)
"""
