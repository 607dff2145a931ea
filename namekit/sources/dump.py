"""Knowledge-base dump lines: reading (A5-A7) and building them from the
driver tables.

A dump is one JSON entity per line with a trailing comma, wrapped in ``[`` /
``]`` lines. Reading is ``spark.read.text`` (splittable, also for bz2) and
``from_json`` with a fixed schema; lines that do not parse are counted, not
fatal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .io import is_one_json_value, with_line_number

SNAK = T.StructType([T.StructField("mainsnak", T.StructType([
    T.StructField("snaktype", T.StringType()),
    T.StructField("datavalue", T.StructType([
        T.StructField("value", T.StructType([T.StructField("id", T.StringType())]))]))]))])
DUMP_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StructType([
        T.StructField("language", T.StringType()), T.StructField("value", T.StringType())]))),
    T.StructField("claims", T.StructType([T.StructField("P31", T.ArrayType(SNAK))])),
])

# Dump-building choices (our mapping of the driver tables).
REGION_LANGUAGES = ["de", "fr", "es", "it", "nl"]


def parse_entity_lines(lines: DataFrame, col: str = "value", keep_line_id: bool = False) -> DataFrame:
    """A5 on a DataFrame of text lines: strip the trailing comma, parse;
    ``_corrupt`` marks lines that are not an entity object."""
    body = F.regexp_replace(F.col(col), r",\s*$", "")
    # each step is the row of a generator, which no later filter is moved below, so that a line is built, parsed and
    # judged once, however often its fields are used
    keep = ["line_id"] if keep_line_id else []
    d = lines.select(*keep, F.explode(F.array(body)).alias("_body"))
    # this parser stops at the end of the object: what follows it makes the line a bad one
    parsed = F.from_json("_body", DUMP_SCHEMA, {"mode": "PERMISSIVE"})
    d = d.select(*keep, F.inline(F.array(F.struct(parsed.alias("e"), is_one_json_value(F.col("_body")).alias("whole")))))
    out = d.select("e.*", *keep, (F.col("e").isNull() | F.col("e.id").isNull() | ~F.col("whole")).alias("_corrupt"))
    return out


def read_entity_dump(spark: SparkSession, path: str, with_errors: bool = False) -> DataFrame:
    """A5: read a dump folder/file; good entities only unless ``with_errors``.

    ``line_id`` is the number of the line, from 1, over the files in the order of their paths.
    """
    lines = with_line_number(spark.read.text(path), "line_id").withColumn("line_id", F.col("line_id") + 1)
    parsed = parse_entity_lines(lines, "value", keep_line_id=True)
    return parsed if with_errors else parsed.filter(~F.col("_corrupt")).drop("_corrupt")


def dump_decode_errors(parsed_with_errors: DataFrame) -> DataFrame:
    """Number of lines that are not an entity object."""
    return parsed_with_errors.agg(F.count_if(F.col("_corrupt")).alias("n_errors"),
                                  F.count_if(~F.col("_corrupt")).alias("n_entities"))


def take_dump_prefix(parsed: DataFrame, max_docs: int) -> DataFrame:
    """The good entities among the first ``max_docs`` lines; bad lines count as lines."""
    kept = parsed.filter(F.col("line_id") <= max_docs)
    return kept.filter(~F.col("_corrupt")).drop("_corrupt") if "_corrupt" in kept.columns else kept


def build_dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dump lines derived from the driver tables (see README, "Inputs").

    Entity = order ``Q<o_orderkey>``; labels: ``en`` = customer name (not for
    status 'P'), a region language = "nation, customer", ``pt`` = name of the
    part on the order's first line; P31 = the order's parts ``Q<l_partkey>``,
    plus one snak without value for priority '5-LOW'.
    """
    from .tables import table
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    per_order = li.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_set("l_partkey")).alias("parts"),       # <= 7 lines per order
        F.min(F.struct("l_linenumber", "l_partkey")).alias("first"))
    per_order = per_order.join(p, per_order["first.l_partkey"] == p["p_partkey"], "left")
    base = (o.join(c, o.o_custkey == c.c_custkey, "left")
            .join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(per_order, o.o_orderkey == per_order.l_orderkey, "left"))
    eid = F.concat(F.lit("Q"), F.col("o_orderkey").cast("string"))
    rl = F.element_at(F.array(*[F.lit(x) for x in REGION_LANGUAGES]), F.col("n_regionkey") + 1)
    lab = lambda code, value: F.struct(code.alias("k"), F.struct(code.alias("language"), value.alias("value")).alias("v"))
    labels = F.map_from_entries(F.filter(F.array(
        F.when(F.col("o_orderstatus") != "P", lab(F.lit("en"), F.col("c_name"))),
        F.when(rl.isNotNull(), lab(rl, F.concat_ws(", ", F.col("n_name"), F.col("c_name")))),
        F.when(F.col("p_name").isNotNull(), lab(F.lit("pt"), F.col("p_name")))), lambda x: x.isNotNull()))
    snak = lambda k: F.struct(F.struct(F.lit("value").alias("snaktype"), F.struct(F.struct(
        F.concat(F.lit("Q"), k.cast("string")).alias("id")).alias("value")).alias("datavalue")).alias("mainsnak"))
    nosnak = F.struct(F.struct(F.lit("somevalue").alias("snaktype"),
                               F.lit(None).cast(SNAK["mainsnak"].dataType["datavalue"].dataType).alias("datavalue")
                               ).alias("mainsnak"))
    p31 = F.transform(F.coalesce(F.col("parts"), F.array().cast("array<bigint>")), snak)
    p31 = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(p31, F.array(nosnak))).otherwise(p31)
    doc = F.struct(eid.alias("id"), labels.alias("labels"), F.struct(p31.alias("P31")).alias("claims"))
    lines = base.select(F.concat(F.to_json(doc), F.lit(",")).alias("value"))
    brackets = spark.createDataFrame([("[",), ("]",)], "value string")
    return brackets.unionByName(lines)


def class_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subclass edges (child, parent) from ``part``: Q<k> -> Q<k div 2>."""
    from .tables import table
    p = table(spark, sf_dir, "part").select("p_partkey").filter(F.col("p_partkey") >= 1)
    return p.select(F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("child"),
                    F.concat(F.lit("Q"), (F.col("p_partkey") / 2).cast("long").cast("string")).alias("parent"))


# Type roots of the class hierarchy built from ``part``.
TYPE_ROOTS = [("PER", "Q3"), ("LOC", "Q4"), ("ORG", "Q5")]


def type_roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TYPE_ROOTS, "type string, root string")
