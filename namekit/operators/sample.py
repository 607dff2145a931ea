"""Reproducible sampling and splits (H1-H9).

Randomness is a hash, not a generator: every row gets the order key
``md5(seed || '|' || row key)``, so a sample does not depend on partitioning,
retries or the engine (the same key is computed by SQL). Per-group top-k uses
two stages - top-k inside (group, hash bucket), then top-k of the survivors -
so a group holding a third of all rows is still spread over many tasks.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, measured_side

DEFAULT_SEED = 1917
BUCKETS = 64
_HEX13 = float(16 ** 13)


def row_key(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    cols = list(cols or df.columns)
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def order_key(key: Column, seed: int | str = DEFAULT_SEED) -> Column:
    """md5(seed || '|' || key), a hex string; string order = numeric order."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit("|"), key))


def uniform(key: Column, seed: int | str = DEFAULT_SEED) -> Column:
    """A number in (0, 1) from the first 13 hex digits of the order key."""
    h = F.conv(F.substring(order_key(key, seed), 1, 13), 16, 10).cast("double")
    return (h + 0.5) / _HEX13


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Column, k,
                    buckets: int = BUCKETS) -> DataFrame:
    """Rows with rank <= k inside each group, by ``order`` ascending.

    ``k`` is an int or a column of ``df`` (per-group quota). Stage 1 keeps the
    top-k of every (group, bucket); stage 2 ranks only those survivors.
    """
    kcol = F.col(k) if isinstance(k, str) else F.lit(k)
    d = df.withColumn("_ok", order).withColumn("_b", F.pmod(F.xxhash64("_ok"), F.lit(buckets)))
    w1 = Window.partitionBy(*group, "_b").orderBy("_ok")
    s1 = d.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= kcol)
    w2 = Window.partitionBy(*group).orderBy("_ok")
    s2 = s1.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= kcol)
    return s2.drop("_ok", "_b", "_r")


def sample_balanced(df: DataFrame, group_col: str, n: int, seed: int = DEFAULT_SEED,
                    key_cols: Sequence[str] | None = None) -> DataFrame:
    """H1: n // n_groups rows per group (smaller groups whole)."""
    n_groups = df.select(group_col).distinct().count() or 1   # scalar lookup
    k = n // n_groups
    return top_k_per_group(df, [group_col], order_key(row_key(df, key_cols), seed), k)


def sample_empirical(df: DataFrame, n: int, seed: int = DEFAULT_SEED,
                     key_cols: Sequence[str] | None = None) -> DataFrame:
    """H2: n rows uniformly without replacement (distributed top-n)."""
    return (df.withColumn("_ok", order_key(row_key(df, key_cols), seed))
            .orderBy("_ok").limit(n).drop("_ok"))


def sample_by_language(df: DataFrame, n: int, seed: int = DEFAULT_SEED, lang: str = "language",
                       mode: str = "empirical", key_cols: Sequence[str] | None = None) -> DataFrame:
    """H3: draw n language labels, then that many rows of each language.

    ``empirical``: labels follow the rows (the original code); ``uniform``:
    equal quota per language (what its documentation says).
    """
    if mode == "uniform":
        return sample_balanced(df, lang, n, seed, key_cols)
    labels = sample_empirical(df, n, seed, key_cols).select(lang)
    quota = labels.groupBy(lang).agg(F.count(F.lit(1)).alias("_q"))
    j = df.join(measured_side(quota), on=lang, how="inner")
    out = top_k_per_group(j, [lang], order_key(row_key(df, key_cols), f"{seed}|rows"), "_q")
    return out.drop("_q")


def sample_smoothed(df: DataFrame, n: int, factor: float = 0.7, seed: int = DEFAULT_SEED,
                    lang: str = "language", key_cols: Sequence[str] | None = None) -> DataFrame:
    """H4: n rows without replacement, row weight = (language share)^factor
    (Efraimidis-Spirakis keys -ln(u)/w, smallest n)."""
    counts = materialize(df.groupBy(lang).agg(F.count(F.lit(1)).alias("_c")))
    total = counts.agg(F.sum("_c")).first()[0] or 1          # scalar lookup
    w = counts.select(lang, F.pow(F.col("_c") / F.lit(float(total)), F.lit(factor)).alias("_w"))
    j = df.join(measured_side(w), on=lang, how="inner")
    es = -F.log(uniform(row_key(df, key_cols), seed)) / F.col("_w")
    return j.withColumn("_es", es).orderBy("_es").limit(n).drop("_es", "_w")


def min_names_after_sampling(sample: DataFrame, m: int, lang: str = "language") -> DataFrame:
    """H5: drop languages with fewer than m sampled rows."""
    from .clean import keep_above_threshold
    return keep_above_threshold(sample, m, lang)


def sample_per_language(df: DataFrame, n: int = 10000, seed: int = DEFAULT_SEED,
                        lang: str = "language", key_cols: Sequence[str] | None = None) -> DataFrame:
    """H6: up to n rows of every language."""
    return top_k_per_group(df, [lang], order_key(row_key(df, key_cols), seed), n)


def assign_split(df: DataFrame, id_col: str = "wikidata_id", train: float = 0.8,
                 dev: float = 0.1, seed: int = DEFAULT_SEED) -> DataFrame:
    """H7: train/dev/test per entity id from a hash of the id - stateless, no
    join, and all rows of an id land in the same split."""
    u = uniform(F.col(id_col).cast("string"), seed)
    return df.withColumn("split", F.when(u < train, "train").when(u < train + dev, "dev").otherwise("test"))


#: Hash buckets of the aliases in H8: at most so many, and as many aliases in each as are drawn, at least.
NOISE_BUCKETS, NOISE_BUCKET_ROWS = 65_536, 1_000


def noise_samples(names: DataFrame, n: int, seed: int = DEFAULT_SEED, lang: str = "language",
                  alias: str = "alias", hand_labelled: DataFrame | None = None) -> DataFrame:
    """H8: per language, the first n distinct aliases in the order of a hash that occur only in other
    languages, labelled anomalous (noise). A language with rows in ``hand_labelled`` (language, alias) gets those instead.

    Exact and without pairing every alias with every language: aliases fall into buckets by the leading
    bits of their hash. Prefix sums over the buckets' numbers, of all aliases and of a language's own, tell in which bucket
    its n-th alias of other languages lies; only the buckets up to there are joined, its own aliases removed, and
    the rest ranked in two stages.
    """
    own = names.select(lang, alias).distinct().withColumn("_ok", order_key(F.col(alias), seed))
    own = materialize(own)
    n_aliases = own.agg(F.count_distinct(alias)).first()[0]                # scalar
    buckets = max(1, min(NOISE_BUCKETS, n_aliases // max(n, NOISE_BUCKET_ROWS)))
    bucket = F.floor(F.conv(F.substring("_ok", 1, 8), 16, 10).cast("double") * buckets / 2.0 ** 32).cast("int")
    own = own.withColumn("_b", bucket)
    every = own.select(alias, "_ok", "_b").distinct()
    of_all = every.groupBy("_b").agg(F.count(F.lit(1)).alias("_all"))
    of_own = own.groupBy(lang, "_b").agg(F.count(F.lit(1)).alias("_own"))
    langs = own.select(lang).distinct()
    grid = langs.select(lang, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_b"))
    free = (grid.join(of_all, "_b", "left").join(of_own, [lang, "_b"], "left")
            .withColumn("_free", F.coalesce("_all", F.lit(0)) - F.coalesce("_own", F.lit(0))))
    before = Window.partitionBy(lang).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wanted = free.withColumn("_before", F.coalesce(F.sum("_free").over(before), F.lit(0))).where((F.col("_before") < n) & (F.col("_free") > 0))
    picked = wanted.select(lang, "_b").join(every, "_b").join(own.select(lang, alias), [lang, alias], "left_anti")
    out = top_k_per_group(picked.drop("_b"), [lang], F.col("_ok"), n).select(lang, alias)
    if hand_labelled is not None:
        given = hand_labelled.select(lang, alias)
        out = out.join(measured_side(given.select(lang).distinct()), lang, "left_anti").unionByName(given)
    return out.select(lang, alias, F.lit(True).alias("anomalous"), F.lit(True).alias("noise_sample"))


def extreme_examples(df: DataFrame, col: str, n: int = 30, chunk: int = 1000,
                     seed: int = DEFAULT_SEED, key_cols: Sequence[str] | None = None) -> DataFrame:
    """H9: shuffle into chunks of about ``chunk`` rows; per chunk the top n and
    bottom n rows by ``col``. Chunk = hash bucket, so no global shuffle order
    is materialised."""
    total = df.count()                                       # scalar lookup
    n_chunks = max(1, -(-total // chunk))
    d = df.withColumn("_ok", order_key(row_key(df, key_cols), seed))
    d = d.withColumn("chunk", F.pmod(F.conv(F.substring("_ok", 1, 8), 16, 10).cast("long"),
                                     F.lit(n_chunks)))
    hi = Window.partitionBy("chunk").orderBy(F.desc(col), "_ok")
    lo = Window.partitionBy("chunk").orderBy(F.asc(col), "_ok")
    d = d.withColumn("_hi", F.row_number().over(hi)).withColumn("_lo", F.row_number().over(lo))
    out = d.filter((F.col("_hi") <= n) | (F.col("_lo") <= n))
    return out.withColumn("extreme", F.when(F.col("_hi") <= n, "top").otherwise("bottom")).drop("_ok", "_hi", "_lo")


#: The samplers by name; any other function ``(df, n, seed) -> df`` serves as well.
SAMPLERS = {"balanced": lambda df, n, seed: sample_balanced(df, "language", n, seed), "empirical": sample_empirical,
            "by_language": sample_by_language, "smoothed": lambda df, n, seed: sample_smoothed(df, n, seed=seed)}


def sample(df: DataFrame, n: int, sampler="empirical", seed: int = DEFAULT_SEED, min_names: int = 0) -> DataFrame:
    """n rows by a sampler's name or function (U5); languages with fewer than ``min_names`` sampled rows go (H5)."""
    drawn = (SAMPLERS[sampler] if isinstance(sampler, str) else sampler)(df, n, seed)
    return min_names_after_sampling(drawn, min_names) if min_names else drawn
