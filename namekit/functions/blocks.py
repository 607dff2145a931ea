"""Unicode block of a character, as a Spark Column expression.

Below U+0100 the block names are finer than the Unicode standard (they follow
the block library the original resource was built with, as seen in its
recorded outputs); from U+0100 on the standard block of the JVM's Unicode
tables is used (``java.lang.Character.UnicodeBlock``), e.g. ``CYRILLIC``,
``HIRAGANA``, ``CJK_UNIFIED_IDEOGRAPHS``. Code points outside any block give
null and are skipped by the counting functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Block names of the low range (must equal the reference's).
BASIC_LATIN = "BASIC_LATIN"            # A-Z a-z
DIGIT = "DIGIT"                        # 0-9
SPACE = "SPACE"                        # U+0020
BASIC_PUNCTUATION = "BASIC_PUNCTUATION"  # other ASCII
LATIN_EXTENDED_LETTER = "LATIN_EXTENDED_LETTER"  # letters U+00C0-U+00FF
LATIN_1_PUNCTUATION = "LATIN_1_PUNCTUATION"      # other U+0080-U+00FF

_JVM_BLOCK_CLASS = "java.lang.Character$UnicodeBlock"
_STEP = 16            # standard blocks start at multiples of 16
_DENSE_LIMIT = 0x20000  # planes 0-1 by direct index, higher planes by ranges
_TABLE: dict = {}


def _jvm_block_ranges(spark) -> list[tuple[int, int, str | None]]:
    """(start, end_exclusive, name) of the JVM's Unicode blocks.

    Computed once per process by a small Spark job (69,632 rows, one per
    16-code-point chunk); ``reflect`` is kept out of the per-character
    expressions because Spark treats it as non-deterministic.
    """
    if "ranges" not in _TABLE:
        rows = (spark.range(0, 0x110000 // _STEP)
                .select("id", F.reflect(F.lit(_JVM_BLOCK_CLASS), F.lit("of"),
                                        (F.col("id") * _STEP).cast("int")).alias("b"))
                .orderBy("id").collect())
        ranges: list = []
        for r in rows:
            start, name = r["id"] * _STEP, r["b"]
            if ranges and ranges[-1][2] == name:
                ranges[-1][1] = start + _STEP
            else:
                ranges.append([start, start + _STEP, name])
        _TABLE["ranges"] = [tuple(x) for x in ranges]
    return _TABLE["ranges"]


def _high_block(cp: Column) -> Column:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    ranges = _jvm_block_ranges(spark)
    names = sorted({n for _, _, n in ranges if n is not None})
    pos = {n: i + 1 for i, n in enumerate(names)}
    dense = []
    for start, end, name in ranges:
        if start >= _DENSE_LIMIT:
            break
        dense.extend([pos.get(name, 0)] * ((min(end, _DENSE_LIMIT) - start) // _STEP))
    # both arrays are built from one string literal each and constant-folded
    idx = F.split(F.lit(",".join(map(str, dense))), ",").cast("array<int>")
    name_arr = F.split(F.lit(",".join(names)), ",")
    k = F.element_at(idx, (cp / _STEP).cast("int") + 1)
    dense_block = F.when(k > 0, F.element_at(name_arr, k))
    sparse = None
    for start, end, name in ranges:
        if start < _DENSE_LIMIT or name is None:
            continue
        cond = (cp >= start) & (cp < end)
        sparse = F.when(cond, F.lit(name)) if sparse is None else sparse.when(cond, F.lit(name))
    return F.when(cp < _DENSE_LIMIT, dense_block).otherwise(sparse)


def low_block_name(cp: int) -> str:
    """Block rule below U+0100 (the fixed names above)."""
    if cp == 32:
        return SPACE
    if 65 <= cp <= 90 or 97 <= cp <= 122:
        return BASIC_LATIN
    if 48 <= cp <= 57:
        return DIGIT
    if cp < 128:
        return BASIC_PUNCTUATION
    if 192 <= cp <= 255 and cp not in (215, 247):
        return LATIN_EXTENDED_LETTER
    return LATIN_1_PUNCTUATION


LOW_BLOCKS = [SPACE, BASIC_LATIN, DIGIT, BASIC_PUNCTUATION, LATIN_EXTENDED_LETTER,
              LATIN_1_PUNCTUATION]


def high_block(cp: Column) -> Column:
    """Block name of a code point >= U+0100 (null outside any block)."""
    return _high_block(cp)


def codepoint(c: Column) -> Column:
    """Code point of the first character (astral-safe)."""
    return F.ascii(c)


def block_of_codepoint(cp: Column) -> Column:
    return (
        F.when(cp == 32, F.lit(SPACE))
        .when(((cp >= 65) & (cp <= 90)) | ((cp >= 97) & (cp <= 122)), F.lit(BASIC_LATIN))
        .when((cp >= 48) & (cp <= 57), F.lit(DIGIT))
        .when(cp < 128, F.lit(BASIC_PUNCTUATION))
        .when((cp >= 192) & (cp <= 255) & (cp != 215) & (cp != 247), F.lit(LATIN_EXTENDED_LETTER))
        .when(cp < 256, F.lit(LATIN_1_PUNCTUATION))
        .otherwise(_high_block(cp))
    )


def unicode_block(c: Column) -> Column:
    """Block name of a one-character string column."""
    return block_of_codepoint(codepoint(c))


def block_sql(cp: str) -> str:
    """Same rule as SQL text (used by oracle queries; ASCII/Latin-1 part only)."""
    return (
        f"CASE WHEN {cp} = 32 THEN 'SPACE' "
        f"WHEN {cp} BETWEEN 65 AND 90 OR {cp} BETWEEN 97 AND 122 THEN 'BASIC_LATIN' "
        f"WHEN {cp} BETWEEN 48 AND 57 THEN 'DIGIT' "
        f"WHEN {cp} < 128 THEN 'BASIC_PUNCTUATION' "
        f"WHEN {cp} BETWEEN 192 AND 255 AND {cp} NOT IN (215, 247) THEN 'LATIN_EXTENDED_LETTER' "
        f"WHEN {cp} < 256 THEN 'LATIN_1_PUNCTUATION' ELSE 'OTHER' END"
    )
