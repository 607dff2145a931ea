"""File sources and sinks for name tables.

Readers use explicit string schemas (no inference) and turn the NA tokens
into real nulls; writers are plain DataFrame writers, partitioned by language
(and type) where the reference writes one file per language. Skewed languages
are spread with a REBALANCE hint, which AQE splits into evenly sized files.
"""

from __future__ import annotations

from pathlib import PurePath
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import na_to_null, unicode_strip

#: Records of one CSV or TSV file, at most.
CSV_RECORDS = 2_000_000
NAME_COLUMNS = ["wikidata_id", "eng", "alias", "language", "type"]


def infer_format(path: str, fmt: str | None = None) -> str:
    """The explicit format, else the file suffix."""
    return fmt or PurePath(path.rstrip("/")).suffix.lstrip(".")


def _csv_options(fmt: str) -> dict:
    return {"header": "true", "sep": "\t" if fmt == "tsv" else ",", "quote": '"', "escape": '"',
            "encoding": "UTF-8", "multiLine": "false",
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def is_one_json_value(text: F.Column) -> F.Column:
    """The whole text is one JSON value. Spark's JSON functions stop at a value's end and overlook what follows, so the
    value stands first in an object here, whose second field is found only if nothing else comes between."""
    probe = F.concat(F.lit('{"value":'), text, F.lit(',"the end":1}'))
    return F.coalesce(F.get_json_object(probe, "$['the end']") == "1", F.lit(False))


def _files_where(lines: DataFrame, odd) -> list[str]:
    """Paths of the files with a line for which ``odd`` holds (one scan; at most one row a file comes back)."""
    found = lines.select(F.col("_metadata.file_path").alias("f"), odd.alias("odd")).where("odd").select("f").distinct()
    return [r.f for r in found.collect()]


def _in_files(df: DataFrame, files: list[str], inside: bool = True) -> DataFrame:
    """Rows of the given files (or of all others); Spark lists only those files."""
    hit = F.col("_metadata.file_path").isin(files)
    return df.where(hit if inside else ~hit)


def _read_csv(spark: SparkSession, path: str, fmt: str, columns: Sequence[str] | None) -> DataFrame:
    """Records may hold line breaks in quotes. A file with a line whose quotes don't pair up is read as a
    whole by one task; all other files are split as usual."""
    # an empty line inside quotes has no quote, but the lines around it have
    odd = F.pmod(F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'))), F.lit(2)) == 1
    whole = _files_where(spark.read.text(path), odd)

    def reader(multi: bool):
        r = spark.read.options(**_csv_options(fmt)).option("multiLine", str(multi).lower())
        return r.schema(_string_schema(columns)) if columns else r.option("inferSchema", "false")
    split = reader(False).csv(path)
    if not whole:
        return split
    named = lambda df: df.select(*[F.col(f"`{c}`") for c in names])
    multi = reader(True).csv(path)
    names = multi.columns
    return named(_in_files(split, whole, False)).unionByName(named(_in_files(multi, whole)))


def _read_json(spark: SparkSession, path: str, columns: Sequence[str] | None) -> DataFrame:
    """Each file is either one record a line or one JSON value (a record or an array of records). A file of the
    second kind that is anything else ends the job with an error, as do lines that are no records."""
    text = spark.read.text(path)
    blank = F.trim("value") == ""
    whole = _files_where(text, ~blank & ~F.col("value").rlike(r"^\s*\{.*\}\s*$"))
    if not columns and not whole:
        return spark.read.option("mode", "FAILFAST").json(path)
    files = spark.read.text(path, wholetext=True)

    def strict(df: DataFrame) -> DataFrame:
        bad = F.raise_error(F.concat(F.lit("not JSON: "), F.substring("value", 1, 200)))
        return df.where(F.when(~is_one_json_value(F.col("value")), bad.cast("boolean")).otherwise(True))

    one = strict(_in_files(files, whole)) if whole else None
    lines = strict((_in_files(text, whole, False) if whole else text).where(~blank))
    if not columns:
        records = F.from_json("value", T.ArrayType(T.MapType(T.StringType(), T.StringType())))
        single = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), F.col("value"), F.lit("]")))
        keys = lines.select("value").unionByName(one.select(single.alias("value"))) if one is not None else lines
        keys = keys.select(F.explode(F.coalesce(records, F.array(F.from_json("value", T.MapType(T.StringType(), T.StringType()))))).alias("m"))
        columns = sorted(r.k for r in keys.select(F.explode(F.map_keys("m")).alias("k")).distinct().collect())
    schema = T.ArrayType(_string_schema(columns))  # a single record counts as an array of one
    parts = [x.select(F.inline(F.from_json("value", schema))) for x in (lines, one) if x is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_names(spark: SparkSession, path: str, fmt: str | None = None,
               columns: Sequence[str] | None = None) -> DataFrame:
    """A1: CSV/TSV (header, all strings, NA tokens -> null; line breaks allowed in quotes), JSON lines, or JSON
    (``json``: files of one record a line, as A3 writes them, and files of one record or one array, side by side)."""
    fmt = infer_format(path, fmt)
    if fmt in ("csv", "tsv"):
        df = _read_csv(spark, path, fmt, columns)
        return df.select(*[na_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns])
    if fmt == "jsonl":
        return spark.read.json(path, schema=_string_schema(columns)) if columns else spark.read.json(path)
    if fmt == "json":
        return _read_json(spark, path, columns)
    raise ValueError(f"unsupported format {fmt}")


def _string_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def write_names(df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite") -> None:
    """A3: CSV/TSV with header, JSON lines (``json``/``jsonl``: one record per
    line, nulls kept) or parquet."""
    fmt = infer_format(path, fmt)
    w = df.write.mode(mode)
    if fmt in ("csv", "tsv"):
        # a file with line breaks in its fields is read by one task, so files stay bounded
        w = w.option("maxRecordsPerFile", CSV_RECORDS)
        w.options(**_csv_options(fmt)).option("emptyValue", "").csv(path)
    elif fmt in ("json", "jsonl"):
        w.option("ignoreNullFields", "false").json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt}")


def write_projected(df: DataFrame, path: str, columns: Sequence[str], fmt: str = "tsv") -> None:
    """A4: header + the listed fields only."""
    write_names(df.select(*columns), path, fmt)


def write_by_language(df: DataFrame, path: str, fmt: str = "parquet", lang: str = "language",
                      use_subfolders: bool | None = None) -> None:
    """The rows of each language apart, a large language in several files of even size.

    By default partition folders ``language=en``, which Spark reads back as one table. With ``use_subfolders`` True a folder
    ``<path>/en`` for each language, False ``<path>_en`` beside it (before the suffix, if any); the language then stays a
    column of the files. Those are written as partition folders first and moved, one rename a language."""
    def save(w, target: str) -> None:
        if fmt in ("csv", "tsv"):
            w.options(**_csv_options(fmt)).csv(target)
        else:
            w.format(fmt).save(target)
    if use_subfolders is None:
        save(df.hint("rebalance", lang).write.mode("overwrite").partitionBy(lang), path)
        return
    suffix = PurePath(path).suffix
    root = path.removesuffix(suffix)
    staged = f"{root}.staged"
    save(df.withColumn("_part", F.col(lang)).hint("rebalance", "_part").write.mode("overwrite").partitionBy("_part"), staged)
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    if use_subfolders:
        fs.mkdirs(place(path))
    for entry in fs.listStatus(place(staged)):
        name = entry.getPath().getName()
        if name.startswith("_part="):
            code = name.removeprefix("_part=")
            target = place(f"{path}/{code}" if use_subfolders else f"{root}_{code}{suffix}")
            fs.delete(target, True)
            fs.rename(entry.getPath(), target)
    fs.delete(place(staged), True)


def write_by_language_and_type(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One output folder per (language, type)."""
    df.hint("rebalance", "language", "type").write.mode("overwrite") \
        .partitionBy("language", "type").format(fmt).save(path)


def read_code_lookup(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object file {code: name} -> (code, name). Lookup files are
    small (one per file is read whole)."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json(F.col("value"), T.MapType(T.StringType(), T.StringType()))
    return raw.select(F.explode(m).alias("code", "name"))


def read_script_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """A10: TSV (language_code, scripts_to_keep ", "-separated) -> scripts array."""
    df = read_names(spark, path, "tsv", ["language_code", "scripts_to_keep"])
    return df.select("language_code", F.split(F.col("scripts_to_keep"), ", ").alias("scripts"))


def with_line_number(df: DataFrame, out: str = "line") -> DataFrame:
    """Exact 0-based line number in (file path, position) order for a file
    scan, JVM-side: rows are keyed by their file block
    (``_metadata.file_path``, ``file_block_start``) and their position in the
    block (monotonically increasing id minus the block's first id); one scan counts the rows of
    every block, and a running sum over the blocks (one row per block) gives each block's offset. The offsets
    are broadcast when small, so the lines themselves are not moved."""
    from pyspark.sql import Window

    from ..operators.common import measured_side
    d = df.select("*", F.col("_metadata.file_path").alias("_f"),
                  F.col("_metadata.file_block_start").alias("_s"),
                  F.monotonically_increasing_id().alias("_m"))
    blocks = d.groupBy("_f", "_s").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    w = Window.orderBy("_f", "_s").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    blocks = measured_side(blocks.select("_f", "_s", (F.col("_off") - F.col("_m0")).alias("_shift")))
    j = d.join(blocks, on=["_f", "_s"], how="inner")
    return j.withColumn(out, F.col("_shift") + F.col("_m")).drop("_f", "_s", "_m", "_shift")


def write_parallel_lines(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Parallel line files, one folder ``file=<i>`` per column, line breaks inside a value as spaces. Every task
    writes its rows to all folders, in the order it has them, so line k is the same row in each of them: the rows
    are computed once and not moved. The folder's number comes first in the sort that the writer asks for anyway.
    The files are compressed (Snappy), a file per task."""
    for i in range(len(columns)):  # the folders are there, too, if no row is
        df.sparkSession.createDataFrame([], "value string").write.mode("overwrite").text(f"{path}/file={i}")
    lines = df.select(F.monotonically_increasing_id().alias("_row"),
                      F.array(*[F.regexp_replace(c, "[\\r\\n]", " ") for c in columns]).alias("_values"))
    (lines.select("_row", F.posexplode("_values").alias("file", "value"))
     .sortWithinPartitions("file", "_row").select("file", "value")
     .write.mode("append").option("compression", "snappy").partitionBy("file").text(path))


def _indexed_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    lines = spark.read.text(path).withColumnRenamed("value", name)
    return with_line_number(lines, "line")


def language_of_source(col: str = "source") -> F.Column:
    """Language tag of a source line "<xxx> ...": the text up to the first
    '>' (up to position 5 when that is '>'), brackets removed, stripped."""
    return F.when(F.instr(F.col(col), ">") > 0, F.trim(F.translate(F.expr(
        f"substring({col}, 1, CASE WHEN substring({col}, 6, 1) = '>' THEN 5 ELSE instr({col}, '>') - 1 END)"),
        "<>", "")))


def parse_tagged_outputs(spark: SparkSession, hyp_path: str, ref_path: str, src_path: str) -> DataFrame:
    """Three parallel line files -> (language, reference, hypothesis, source)."""
    h = _indexed_lines(spark, hyp_path, "hypothesis")
    r = _indexed_lines(spark, ref_path, "reference")
    s = _indexed_lines(spark, src_path, "source")
    j = h.join(r, "line").join(s, "line")
    st = lambda c: unicode_strip(F.col(c)).alias(c)
    return j.select(language_of_source("source").alias("language"), st("reference"), st("hypothesis"), st("source"))


def parse_combined_outputs(spark: SparkSession, path: str) -> DataFrame:
    """One TSV (hyp, ref, src); language = first 5 characters of the
    source without '<' and '>', stripped."""
    df = read_names(spark, path, "tsv", ["hyp", "ref", "src"])
    return df.select(F.trim(F.translate(F.substring("src", 1, 5), "<>", "")).alias("language"),
                     F.col("ref").alias("reference"), F.col("hyp").alias("hypothesis"),
                     F.col("src").alias("source"))


def union_type_dumps(dfs: Sequence[DataFrame]) -> DataFrame:
    """A15."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def split_by_type(names: DataFrame, type_: str) -> DataFrame:
    """Rows of one entity type (equality, not a regex)."""
    return names.filter(F.col("type") == type_)


def to_json_line(cols: Sequence[str] = NAME_COLUMNS) -> F.Column:
    """One JSON object per row with the name fields (nulls kept)."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def write_jsonl(names: DataFrame, path: str) -> None:
    """JSON lines with the five name fields."""
    names.select(*NAME_COLUMNS).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's checkpoint folder."""
    import uuid
    from ..session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/namekit-io/{name}-{uuid.uuid4().hex[:12]}"
