"""Script (Unicode block) statistics and anomaly tagging.

Per-language statistics (expected block, prototype histogram) are two grouped
aggregates whose result has one row per language (or per language and block);
they are computed once, measured, and broadcast to the names, which are not moved
by their language. No per-language loop, no Python UDF, and a
skewed language only means a bigger map-side partial aggregate.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import measured_side

from ..functions import script as S
from ..functions.text import unicode_strip

ALIAS, LANG, TYPE, ID = "alias", "language", "type", "wikidata_id"

# Language codes the kana / CJK taggers look at (prefix match).
CJK_LANGUAGE_PATTERN = r"^(ja|zh-*|lzh|wuu)"
VOTE_METHODS = ("majority_vote", "all", "any", "baseline")


def with_blocks(names: DataFrame, alias: str = ALIAS) -> DataFrame:
    """D3/D4/D5 columns of the default analyzer (no strip, punctuation kept)."""
    return names.withColumn("_blocks", S.block_entries(F.col(alias)))


def language_prototype(names: DataFrame, lang: str = LANG, alias: str = ALIAS) -> DataFrame:
    """Per language, normalized block histogram of all aliases together.

    Each row contributes its own small (block, n) list; the grouped sum is a
    map-side partial aggregate. The result is (language, prototype map).
    """
    per_block = (names
                 .select(lang, F.explode(S.block_count_entries(
                     F.col(alias), strip=False, ignore_punctuation=True,
                     ignore_numbers=True)).alias("e"))
                 .groupBy(lang, F.col("e.block").alias("block"))
                 .agg(F.sum("e.n").alias("n")))
    totals = per_block.groupBy(lang).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("block", "n")))).alias("_m"),
        F.sum("n").alias("_t"))
    return totals.select(lang, F.transform_values("_m", lambda k, v: v / F.col("_t")).alias("prototype"))


def prototype_long(names: DataFrame, lang: str = LANG, alias: str = ALIAS) -> DataFrame:
    """D6 as long rows (language, block, share)."""
    return (language_prototype(names, lang, alias)
            .select(lang, F.explode("prototype").alias("block", "share")))


def expected_block(names: DataFrame, lang: str = LANG, alias: str = ALIAS) -> DataFrame:
    """Per language, the most frequent strict per-name block (ties: block asc)."""
    per = (names.select(lang, S.strict_most_common_block(F.col(alias)).alias("block"))
           .groupBy(lang, "block").agg(F.count(F.lit(1)).alias("n")))
    return per.groupBy(lang).agg(
        F.min_by("block", F.struct(-F.col("n"), F.col("block"))).alias("expected_block"))


def language_stats(names: DataFrame, lang: str = LANG, alias: str = ALIAS) -> DataFrame:
    """D6 + D7 from one pass over the names: every row contributes its strict
    mode (kind 'e', count 1) and its prototype counts (kind 'p'); one grouped
    sum over (language, kind, block) yields both. Result: (language,
    expected_block, prototype), one row per language."""
    a = F.col(alias)
    count = lambda strip: S.block_entries(a, strip=strip, ignore_punctuation=True, ignore_numbers=True)
    # nearly no name has white space at its ends; where there is none, the prototype's counts are the strict ones, too
    names = names.select(lang, alias, count(False).alias("_e"))
    strict_mode = S.mode_of_entries(F.when(unicode_strip(a) == a, F.col("_e")).otherwise(count(True)))
    proto = F.transform("_e", lambda e: F.struct(e["block"].alias("block"), e["n"].cast("long").alias("n")))
    items = F.concat(
        F.array(F.struct(F.lit("e").alias("kind"), strict_mode.alias("block"), F.lit(1).cast("long").alias("n"))),
        F.transform(proto, lambda e: F.struct(F.lit("p").alias("kind"), e["block"].alias("block"), e["n"].alias("n"))))
    per = (names.select(lang, F.explode(items).alias("x"))
           .groupBy(lang, F.col("x.kind").alias("kind"), F.col("x.block").alias("block"))
           .agg(F.sum("x.n").alias("n")))
    e = F.col("kind") == "e"
    agg = per.groupBy(lang).agg(
        F.min_by(F.when(e, F.col("block")), F.when(e, F.struct(-F.col("n"), F.col("block")))).alias("expected_block"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(~e, F.struct("block", "n"))))).alias("_m"),
        F.sum(F.when(~e, F.col("n"))).alias("_t"))
    return agg.select(lang, "expected_block",
                      F.transform_values("_m", lambda k, v: v / F.col("_t")).alias("prototype"))


def _vote(c: Column) -> Column:
    return F.coalesce(c.cast("int") * 2 - 1, F.lit(0))  # one use of the tagger: it is evaluated once


def aggregate_votes(votes: Sequence[Column], method="majority_vote",
                    compat: bool = False) -> Column:
    """Combine +1/-1/0 votes into one anomalous flag.

    majority_vote: mean > 0. ``all``/``any``: intended meaning (every / some
    non-abstaining vote says anomalous); ``compat=True`` keeps the original
    truthiness (-1 counts as true).
    """
    if callable(method):                       # custom aggregator over the vote array
        return method(F.array(*votes))
    total = votes[0]
    for v in votes[1:]:
        total = total + v
    if method == "majority_vote":
        return total > 0
    arr = F.array(*votes)
    if method == "all":
        if compat:
            return F.forall(arr, lambda v: v != 0)
        return F.exists(arr, lambda v: v != 0) & F.forall(arr, lambda v: v >= 0)
    if method == "any":
        if compat:
            return F.exists(arr, lambda v: v != 0)
        return F.exists(arr, lambda v: v == 1)
    raise ValueError(f"unknown vote method {method}")


#: Distances of a name's histogram from its language's.
MEASURES = {"jensen_shannon": S.jensen_shannon, "kullback_leibler": S.kullback_leibler}


def tag_columns(hist: Column, block: Column, language: Column, expected: Column,
                prototype: Column, critical: float = 0.1, measure: str = "jensen_shannon") -> dict:
    """The five nullable-boolean tagger columns."""
    cjk_lang = language.rlike(CJK_LANGUAGE_PATTERN)
    keys = F.map_keys(hist)
    kana = F.array_contains(keys, "HIRAGANA") | F.array_contains(keys, "KATAKANA")
    return {
        "incorrect_block": block != expected,
        "missing_block": ~F.array_contains(keys, expected),
        "divergent": MEASURES[measure](hist, prototype) >= critical,
        "kana": F.when(cjk_lang, F.when(language == "ja", ~kana).otherwise(kana)),
        "cjk": F.when(cjk_lang, F.exists(keys, lambda k: k.startswith("CJK"))),
    }


def tag_names(names: DataFrame, method="majority_vote", critical: float = 0.1,
              lang: str = LANG, alias: str = ALIAS, keep_votes: bool = False,
              compat: bool = False, extra_taggers: dict | None = None, measure: str = "jensen_shannon",
              keep_block: str | None = None) -> DataFrame:
    """Names + ``anomalous`` from five per-language taggers (and the name's most common block as column
    ``keep_block``).

    ``extra_taggers`` maps a name to a function ``DataFrame columns ->
    nullable boolean Column`` (custom tagger; null = abstain); ``method`` may
    be a function over the array of +1/-1/0 votes (custom aggregator)."""
    stats = measured_side(language_stats(names, lang, alias))
    j = names.join(stats, on=lang, how="left")
    tags = tag_columns(F.col("_hist"), F.col("_block"), F.col(lang),
                       F.col("expected_block"), F.col("prototype"), critical, measure)
    for name, fn in (extra_taggers or {}).items():
        tags[name] = fn(F.col(alias), F.col(lang))
    j = (j.withColumn("_seq", S.block_entries(F.col(alias)))
         .withColumn("_hist", S.histogram_of_entries(F.col("_seq")))
         .withColumn("_block", S.mode_of_entries(F.col("_seq"))))
    votes = [_vote(t) for t in tags.values()]
    out = j.withColumn("anomalous", aggregate_votes(votes, method, compat))
    if keep_votes:
        for name, t in tags.items():
            out = out.withColumn(f"vote_{name}", _vote(t))
    if keep_block:
        out = out.withColumn(keep_block, F.col("_block"))
    return out.drop("_seq", "_hist", "_block", "expected_block", "prototype")


def split_tagged(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, filtered)."""
    return (tagged.filter(~F.col("anomalous")), tagged.filter(F.col("anomalous")))


def apply_script_allowlist(names: DataFrame, allow: DataFrame, lang: str = LANG,
                           alias: str = ALIAS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(valid and listed, valid and unlisted, filtered).

    ``allow`` is (language_code, scripts array<string>), one row per language.
    """
    a = allow.select(F.col("language_code").alias("_lc"), F.col("scripts").alias("_scripts"))
    j = names.join(measured_side(a), F.col(lang) == F.col("_lc"), "left")
    listed = F.col("_lc").isNotNull()
    # a listed language without scripts allows none, and a null alias has no allowed script
    valid = ~listed | F.coalesce(F.array_contains(F.col("_scripts"), S.most_common_block(F.col(alias))), F.lit(False))
    j = j.withColumn("_listed", listed).withColumn("_valid", valid).drop("_lc", "_scripts")
    cols = names.columns
    return (j.filter(F.col("_valid") & F.col("_listed")).select(*cols),
            j.filter(F.col("_valid") & ~F.col("_listed")).select(*cols),
            j.filter(~F.col("_valid")).select(*cols))


def standardize_script_flagged(names: DataFrame, allow: DataFrame,
                               method: str = "majority_vote", critical: float = 0.1,
                               lang: str = LANG, alias: str = ALIAS) -> DataFrame:
    """D17 in one pass: names + ``kept`` flag.

    Listed languages keep names whose script is allowed; unlisted languages
    go through the voting taggers (their statistics only involve their own
    rows, so they are computed per language over the unlisted rows).
    """
    a = allow.select(F.col("language_code").alias("_lc"), F.col("scripts").alias("_scripts"))
    a = measured_side(a)
    j = names.join(a, F.col(lang) == F.col("_lc"), "left")
    if method == "baseline":
        anomalous = F.lit(False)
        tagged = j
    else:
        unlisted = j.filter(F.col("_lc").isNull())
        stats = measured_side(language_stats(unlisted, lang, alias))
        tagged = j.join(stats, on=lang, how="left")
        tagged = (tagged.withColumn("_seq", S.block_entries(F.col(alias)))
                  .withColumn("_hist", S.histogram_of_entries(F.col("_seq")))
                  .withColumn("_block", S.mode_of_entries(F.col("_seq"))))
        tags = tag_columns(F.col("_hist"), F.col("_block"), F.col(lang),
                           F.col("expected_block"), F.col("prototype"), critical)
        anomalous = aggregate_votes([_vote(t) for t in tags.values()], method)
    if "_block" not in tagged.columns:
        tagged = tagged.withColumn("_block", S.most_common_block(F.col(alias)))
    # as in the allow-list alone: a listed language without scripts allows none, a null alias has no allowed script
    listed_ok = F.coalesce(F.array_contains(F.col("_scripts"), F.col("_block")), F.lit(False))
    kept = F.when(F.col("_lc").isNotNull(), listed_ok).otherwise(~anomalous)
    return tagged.withColumn("kept", kept).select(*names.columns, "kept")


def standardize_script(names: DataFrame, allow: DataFrame, method: str = "majority_vote",
                       critical: float = 0.1, lang: str = LANG,
                       alias: str = ALIAS) -> tuple[DataFrame, DataFrame]:
    """Allow-list first, voting taggers on the unlisted languages.

    Returns (names, filtered); both are filters of one flagged plan, so a
    caller writing both should persist or write it once partitioned by
    ``kept``.
    """
    flagged = standardize_script_flagged(names, allow, method, critical, lang, alias)
    return (flagged.filter(F.col("kept")).drop("kept"),
            flagged.filter(~F.col("kept")).drop("kept"))


def script_counts(names: DataFrame, by: Sequence[str] = (LANG, TYPE),
                  alias: str = ALIAS) -> DataFrame:
    """Number of names per group and most common block."""
    return (names.select(*by, S.most_common_block(F.col(alias)).alias("script"))
            .groupBy(*by, "script").agg(F.count(F.lit(1)).alias("n")))


def entropy_of_counts(counts: DataFrame, keys: Sequence[str], n: str = "n",
                      base: float = 2.0, out: str = "entropy") -> DataFrame:
    """-sum p log p per group of ``keys`` from a (keys..., category, n) table."""
    import math
    w = Window.partitionBy(*keys)
    p = F.col(n) / F.sum(n).over(w)
    return (counts.withColumn("_p", p)
            .groupBy(*keys)
            .agg((-F.sum(F.col("_p") * F.log(F.col("_p"))) / math.log(base)).alias(out)))


def script_entropy(names: DataFrame, lookup: DataFrame | None = None, lang: str = LANG,
                   alias: str = ALIAS, strip: bool = False, digits: int = 3) -> DataFrame:
    """Base-2 entropy of the per-name script per language.

    Output (language_code, language, script_entropy), sorted descending;
    names without any counted character have no script and are left out.
    """
    from .clean import add_language_name
    scripts = names.select(lang, S.most_common_block(F.col(alias), strip=strip).alias("script"))
    if lookup is not None:
        scripts = add_language_name(scripts, lookup, lang, "_long")
    else:
        scripts = scripts.withColumn("_long", F.col(lang))
    counts = scripts.groupBy(lang, "_long", "script").agg(F.count(F.lit(1)).alias("n"))
    # names without script are dropped after the aggregate (a filter before it
    # would be pushed under the projection and evaluate the script twice)
    counts = counts.withColumn("n", F.when(F.col("script") != "", F.col("n")))
    ent = entropy_of_counts(counts, [lang, "_long"], base=2.0, out="_e")
    return (ent.select(F.col(lang).alias("language_code"), F.col("_long").alias("language"),
                       F.round(F.col("_e") + F.lit(0.0), digits).alias("script_entropy"))
            .orderBy(F.desc("script_entropy"), "language_code"))


def script_of_distinct_aliases(names: DataFrame, alias: str = ALIAS) -> DataFrame:
    """Infer the script once per distinct alias and join it back."""
    cache = names.select(alias).distinct().withColumn("script", S.most_common_block(F.col(alias)))
    return names.join(cache, on=alias, how="left")


def entropy_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows whose entropy changed (after - before)."""
    keys = ["language_code", "language"]
    b = before.select(*keys, F.col("script_entropy").alias("before"))
    a = after.select(*keys, F.col("script_entropy").alias("after"))
    j = b.join(a, on=keys, how="left").withColumn("change", F.col("after") - F.col("before"))
    return j.filter(F.col("change") != 0)


def describe(df: DataFrame, col: str, exact: bool = True, digits: int = 6) -> DataFrame:
    """Count, mean, std, min, quartiles, max of a numeric column.

    ``exact`` uses linear-interpolated percentiles (for bounded tables such as
    per-language reports); ``exact=False`` uses ``percentile_approx``.
    """
    c = F.col(col).cast("double")
    if exact:
        qs = [F.percentile(c, q) for q in (0.25, 0.5, 0.75)]
    else:
        qs = [F.percentile_approx(c, q, 10000).cast("double") for q in (0.25, 0.5, 0.75)]
    r = lambda x: F.round(x, digits)
    return df.agg(F.count(c).alias("count"), r(F.avg(c)).alias("mean"),
                  r(F.stddev_samp(c)).alias("std"), r(F.min(c)).alias("min"),
                  r(qs[0]).alias("p25"), r(qs[1]).alias("p50"), r(qs[2]).alias("p75"),
                  r(F.max(c)).alias("max"))


def script_purity(names: DataFrame, by: Sequence[str] = (LANG, TYPE),
                  alias: str = ALIAS, digits: int = 6) -> DataFrame:
    """Share of names written in exactly one block, per group."""
    single = F.size(S.block_entries(F.col(alias))) == 1
    agg = names.groupBy(*by).agg(F.sum(single.cast("long")).alias("n_pure"),
                                 F.count(F.lit(1)).alias("n_tot"))
    purity = F.col("n_pure") / F.col("n_tot")
    return agg.select(*by, "n_pure", "n_tot", F.round(purity, digits).alias("purity"),
                      F.round(1 - purity, digits).alias("impurity"))


def label_entropy(counts: DataFrame, weighted: bool = False, lang: str = "language",
                  script: str = "script", n: str = "count", digits: int = 4) -> DataFrame:
    """Natural-log entropy of scripts per language from a counts table.

    Unweighted (default, as the original table) every (language, script) row
    counts once.
    """
    rows = counts.groupBy(lang, script).agg(
        (F.sum(n) if weighted else F.count(F.lit(1))).alias("_n"))
    ent = entropy_of_counts(rows, [lang], n="_n", base=2.718281828459045, out="_e")
    return ent.select(lang, F.round(F.col("_e") + F.lit(0.0), digits).alias("entropy"))


def evaluate_tagging(tagged: DataFrame, gold: DataFrame, keys: Sequence[str] = (ID, LANG, ALIAS),
                     lang: str = LANG) -> DataFrame:
    """Confusion counts of predicted ``anomalous`` against gold labels.

    ``gold`` holds ``keys`` + ``gold_anomalous`` (nullable: unknown). Output per
    language and a ``global`` row: tp, fp, fn, tn, missed and false alarms.
    """
    j = tagged.join(gold, on=list(keys), how="inner")
    pred, g = F.col("anomalous"), F.col("gold_anomalous")
    agg = [F.sum((pred & g).cast("long")).alias("tp"),
           F.sum((pred & ~g).cast("long")).alias("fp"),
           F.sum((~pred & g).cast("long")).alias("fn"),
           F.sum((~pred & ~g).cast("long")).alias("tn")]
    from .common import with_global
    return with_global(j, lang, agg)


def tagging_errors(tagged: DataFrame, gold: DataFrame, keys: Sequence[str] = (ID, LANG, ALIAS)) -> DataFrame:
    """The rows that were missed (``missed``: anomalous but not tagged) or tagged for no reason (``false_alarm``:
    not anomalous but tagged; noise samples are left out), with all columns of ``tagged``."""
    j = tagged.join(gold.select(*keys, "gold_anomalous"), on=list(keys), how="inner")
    pred, g = F.col("anomalous"), F.col("gold_anomalous")
    noise = F.coalesce(F.col("noise_sample"), F.lit(False)) if "noise_sample" in tagged.columns else F.lit(False)
    kind = F.when(g & ~pred, "missed").when(~g & pred & ~noise, "false_alarm")
    return j.withColumn("error", kind).where("error IS NOT NULL").select(*tagged.columns, "error")
