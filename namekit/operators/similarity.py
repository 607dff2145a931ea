"""Approximate-duplicate filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import char_jaccard, minhash_jaccard


def filter_similar(names: DataFrame, threshold: float = 0.95, exact: bool = False,
                   eng: str = "eng", alias: str = "alias") -> tuple[DataFrame, DataFrame]:
    """(kept, flagged); kept when the character-set similarity of eng and
    alias is below ``threshold`` (MinHash estimate, or exact Jaccard) or unknown,
    as one of the texts is null."""
    sim = char_jaccard(F.col(eng), F.col(alias)) if exact else minhash_jaccard(F.col(eng), F.col(alias))
    s = names.withColumn("_similar", F.coalesce(sim >= threshold, F.lit(False)))
    return s.filter(~F.col("_similar")).drop("_similar"), s.filter("_similar").drop("_similar")


def flagged_report(flagged: DataFrame, eng: str = "eng", alias: str = "alias") -> DataFrame:
    """Flagged rows whose texts are not identical."""
    return flagged.filter(F.col(eng) != F.col(alias)).select(eng, alias)
