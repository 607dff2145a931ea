"""Registered queries: each runs one operator (or a short chain) over the whole
driver tables of a scale-factor folder; the matching DuckDB SQL is the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import script as S
from ..operators import clean as C
from ..operators import script as D
from ..plans import oracle as O
from ..sources import tables as T

from .registry import ORACLES, QUERIES, register  # noqa: F401


def language_lookup(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(O.LANGUAGE_NAMES.items()), "code string, name string")


def cleaned_names(spark: SparkSession, sf_dir: str, with_position: bool = False) -> DataFrame:
    """names -> C1 -> C7, all languages."""
    n = T.names(spark, sf_dir, with_position)
    n = C.keep_item_ids(n)
    return C.remove_parentheses(n)


CLEANED_SQL = f"""
cleaned AS (
  SELECT wikidata_id, {O.strip_paren('eng')} AS eng, {O.strip_paren('alias')} AS alias,
         language, type, doc_id, line_no
  FROM names_all WHERE starts_with(wikidata_id, 'Q')
)"""


# ---------------------------------------------------------------- D19 (flagship)
@register("script_entropy", O.with_names(
    CLEANED_SQL, O.language_lookup_sql(),
    O.char_rows("cleaned", "alias", "doc_id, line_no, language"),
    O.mode_rows("ch", "doc_id, line_no, language")) + """
, cnt AS (SELECT language, block, count(*) AS n FROM md GROUP BY language, block)
, p AS (SELECT language, n * 1.0 / sum(n) OVER (PARTITION BY language) AS p FROM cnt)
SELECT p.language AS language_code, coalesce(l.name, p.language) AS language,
       round(-sum(p * log2(p)) + 0.0, 3) AS script_entropy
FROM p LEFT JOIN lookup l ON l.code = p.language
GROUP BY p.language, l.name
""")
def q_script_entropy(spark, sf_dir):
    return D.script_entropy(cleaned_names(spark, sf_dir), language_lookup(spark))


from . import q_basic, q_eval, q_io, q_kb, q_names, q_script  # noqa: E402,F401
