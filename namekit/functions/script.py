"""Unicode-block statistics of strings (D2-D5, D10), all inside one row.

Hot path (characters below U+0100, i.e. all Latin-1 text): one ``translate``
maps every such character to a one-letter block class, so counts and first
positions come from ``replace``/``length``/``instr`` - plain string scans in
generated code. Characters from U+0100 on are cut out by one regex and only
that (usually short or empty) remainder goes through higher-order functions
with the JVM block table. Nothing is exploded, nothing is shuffled.

A row's blocks are an ``array<struct<block, n, pos>>`` ordered by first
position (``pos`` counts code points of the filtered text); counts, histogram
and mode are derived from it. Ties of the mode go to the first seen block.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .blocks import LOW_BLOCKS, block_of_codepoint, high_block, low_block_name
from .text import unicode_strip

PUNCT_OR_SYMBOL = r"^[\p{P}\p{S}]$"
NUMBER = r"^\p{N}$"

# one ASCII letter per low block class (output of translate; every character
# below U+0100 is translated, so these letters cannot be confused with text)
_SYMBOL = {b: sym for b, sym in zip(LOW_BLOCKS, "SLDPEQ")}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _low_category_dropped(cp: int, ignore_punctuation: bool, ignore_numbers: bool) -> bool:
    cat = unicodedata.category(chr(cp))
    return (ignore_punctuation and cat[0] in "PS") or (ignore_numbers and cat[0] == "N")


def _translate_table(ignore_punctuation: bool, ignore_numbers: bool) -> tuple[str, str]:
    keep_from, keep_to, drop = [], [], []
    for cp in range(1, 256):
        if _low_category_dropped(cp, ignore_punctuation, ignore_numbers):
            drop.append(chr(cp))
        else:
            keep_from.append(chr(cp))
            keep_to.append(_SYMBOL[low_block_name(cp)])
    return "".join(keep_from + drop), "".join(keep_to)


def is_punctuation(c) -> Column:
    """General category P* or S*."""
    return _c(c).rlike(PUNCT_OR_SYMBOL)


def is_number(c) -> Column:
    """General category N*."""
    return _c(c).rlike(NUMBER)


def characters(text) -> Column:
    """Code points of a string as an array of one-character strings (split
    on the empty pattern gives [''] only for the empty string)."""
    t = _c(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ""))


def _let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and bind it for ``fn`` (lambda-variable binding)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def classes(text, strip: bool = False, ignore_punctuation: bool = False,
            ignore_numbers: bool = False) -> Column:
    """The filtered text with every character < U+0100 replaced by its class letter."""
    t = unicode_strip(text) if strip else _c(text)
    src, dst = _translate_table(ignore_punctuation, ignore_numbers)
    t = F.translate(t, src, dst)
    patterns = []
    if ignore_punctuation:
        patterns.append(r"\p{P}\p{S}")
    if ignore_numbers:
        patterns.append(r"\p{N}")
    if patterns:
        pat = "[[" + "".join(patterns) + "]&&[^\\x{00}-\\x{ff}]]"
        t = _let(t, lambda v: F.when(F.length(v) < F.octet_length(v),
                                     F.regexp_replace(v, pat, "")).otherwise(v))
    return t


_ENTRY_TYPE = "array<struct<pos:int,block:string,n:int>>"


def _entry(block, n, pos) -> Column:
    return F.struct(pos.cast("int").alias("pos"), block.alias("block"), n.cast("int").alias("n"))


def _high_entries(x: Column) -> Column:
    high_text = F.regexp_replace(x, "[SLDPEQ]", "")

    def build(hs):
        return _let(F.transform(hs, lambda ch: high_block(F.ascii(ch))), lambda hb: F.transform(
            F.filter(F.array_distinct(hb), lambda b: b.isNotNull()),
            lambda b: _entry(b, F.size(F.filter(hb, lambda y: y == b)),
                             F.instr(x, F.element_at(hs, F.array_position(hb, b).cast("int"))))))
    return _let(characters(high_text), build)


def block_entries_of_classes(x: Column) -> Column:
    """array<struct<pos, block, n>> (first-seen order) of a ``classes`` string."""
    def build(v):
        nbytes = F.octet_length(v)
        low = F.array(*[
            _entry(F.lit(b), nbytes - F.octet_length(F.replace(v, F.lit(_SYMBOL[b]), F.lit(""))),
                   F.instr(v, _SYMBOL[b]))
            for b in LOW_BLOCKS])

        def combine(lw):
            n_low = F.aggregate(lw, F.lit(0), lambda acc, e: acc + e["n"])
            present = F.filter(lw, lambda e: e["n"] > 0)
            return F.when(nbytes > n_low, F.sort_array(F.concat(present, _high_entries(v)))) \
                .otherwise(F.sort_array(present))
        return _let(low, combine)
    return _let(x, build)


def block_entries(text, strip: bool = False, ignore_punctuation: bool = False,
                  ignore_numbers: bool = False) -> Column:
    """D3 in entry form: array<struct<pos, block, n>> ordered by first position."""
    return block_entries_of_classes(classes(text, strip, ignore_punctuation, ignore_numbers))


def total_of_entries(e: Column) -> Column:
    return F.aggregate(e, F.lit(0), lambda acc, x: acc + x["n"])


def counts_of_entries(e: Column) -> Column:
    return F.map_from_entries(F.transform(e, lambda x: F.struct(x["block"], x["n"])))


def histogram_of_entries(e: Column, normalize: bool = True) -> Column:
    counts = F.map_from_entries(F.transform(e, lambda x: F.struct(x["block"], x["n"].cast("double"))))
    if not normalize:
        return counts
    total = total_of_entries(e)
    return F.transform_values(counts, lambda k, v: v / total)


def mode_of_entries(e: Column) -> Column:
    best = F.array_max(F.transform(
        e, lambda x: F.struct(x["n"].alias("n"), (-x["pos"]).alias("p"), x["block"].alias("block"))))
    return F.coalesce(best["block"], F.lit(""))


def block_counts(text, strip: bool = False, ignore_punctuation: bool = False,
                 ignore_numbers: bool = False) -> Column:
    """D3: map block -> count (first-seen key order)."""
    return counts_of_entries(block_entries(text, strip, ignore_punctuation, ignore_numbers))


def block_histogram(text, strip: bool = False, ignore_punctuation: bool = False,
                    ignore_numbers: bool = False, normalize: bool = True) -> Column:
    """Map block -> share of counted characters (or count)."""
    return histogram_of_entries(block_entries(text, strip, ignore_punctuation, ignore_numbers),
                                normalize)


def most_common_block(text, strip: bool = False, ignore_punctuation: bool = False,
                      ignore_numbers: bool = False) -> Column:
    """The mode block; ties -> first seen; nothing counted -> ''."""
    return mode_of_entries(block_entries(text, strip, ignore_punctuation, ignore_numbers))


def strict_most_common_block(text) -> Column:
    """Per-name script used for expected blocks: stripped, no punctuation/digits."""
    return most_common_block(text, strip=True, ignore_punctuation=True, ignore_numbers=True)


def block_sequence(text, strip: bool = False, ignore_punctuation: bool = False,
                   ignore_numbers: bool = False) -> Column:
    """Blocks of the counted characters in text order (per-character form, for
    small inputs and tests)."""
    t = unicode_strip(text) if strip else _c(text)
    chars = characters(t)
    if ignore_punctuation:
        chars = F.filter(chars, lambda ch: ~ch.rlike(PUNCT_OR_SYMBOL))
    if ignore_numbers:
        chars = F.filter(chars, lambda ch: ~ch.rlike(NUMBER))
    blocks = F.transform(chars, lambda ch: block_of_codepoint(F.ascii(ch)))
    return F.filter(blocks, lambda b: b.isNotNull())


def block_count_entries(text, strip: bool = False, ignore_punctuation: bool = False,
                        ignore_numbers: bool = False) -> Column:
    """array<struct<block, n long>>: input for exploding small per-row histograms."""
    return F.transform(block_entries(text, strip, ignore_punctuation, ignore_numbers),
                       lambda e: F.struct(e["block"].alias("block"), e["n"].cast("long").alias("n")))


def _xlogy_term(p: Column, m: Column, log) -> Column:
    return F.when(p.isNull() | (p <= 0), F.lit(0.0)).otherwise(p * log(p / m))


def jensen_shannon(p, q, base: float | None = None) -> Column:
    """Jensen-Shannon divergence of two histograms (maps), natural log."""
    import math

    def log(x):
        return F.log(x) if base is None else F.log(x) / math.log(base)

    p, q = _c(p), _c(q)

    def term(k, a, b):
        m = (F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))) / 2
        return _xlogy_term(a, m, log) + _xlogy_term(b, m, log)

    terms = F.map_zip_with(p, q, term)
    return F.aggregate(F.map_values(terms), F.lit(0.0), lambda acc, x: acc + x) / 2


def kullback_leibler(p, q, base: float | None = None) -> Column:
    """KL(p || q); a key of p missing in q gives +infinity."""
    import math

    def log(x):
        return F.log(x) if base is None else F.log(x) / math.log(base)

    p, q = _c(p), _c(q)
    terms = F.map_zip_with(
        p, q,
        lambda k, a, b: F.when(a.isNull() | (a <= 0), F.lit(0.0))
        .when(b.isNull() | (b <= 0), F.lit(float("inf")))
        .otherwise(a * log(a / b)),
    )
    return F.aggregate(F.map_values(terms), F.lit(0.0), lambda acc, x: acc + x)
