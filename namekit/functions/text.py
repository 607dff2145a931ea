"""String cleaning columns: null tokens, Unicode strip, parentheses, commas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text tokens read as missing (the ISO code ``nan`` is kept).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "null",
]

# Python's str.strip() white space (Unicode White_Space plus U+001C..U+001F).
WS_CLASS = (r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
STRIP_PATTERN = rf"^{WS_CLASS}+|{WS_CLASS}+$"
# greedy, '.' stops only at '\n' as in Python's re (UNIX_LINES mode)
PAREN_PATTERN = r"(?d)\(.*\)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def na_to_null(c) -> Column:
    """A1: NA tokens become real nulls."""
    c = _c(c)
    return F.when(c.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


# the same white space as a character list, for Spark's trim(BOTH chars FROM s)
WS_CHARS = ("".join(chr(c) for c in range(0x09, 0x0e)) + "".join(chr(c) for c in range(0x1c, 0x21))
            + "\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200b))
            + "\u2028\u2029\u202f\u205f\u3000")


def unicode_strip(c) -> Column:
    """Python ``str.strip()``: all Unicode white space at both ends (a plain
    trim with an explicit character set, no regex)."""
    return F.trim(_c(c), F.lit(WS_CHARS))


def strip_chars(c, chars: str) -> Column:
    """Python ``str.strip(chars)``."""
    return F.trim(_c(c), F.lit(chars))


def strip_parenthesis(c) -> Column:
    """Remove greedy ``\\(.*\\)`` then strip."""
    return unicode_strip(F.regexp_replace(_c(c), PAREN_PATTERN, ""))


def permute_first_comma(c) -> Column:
    """``"Biden, Joe"`` -> ``"Joe Biden"``; no comma -> unchanged."""
    c = _c(c)
    ix = F.instr(c, ",")
    head = F.substring_index(c, ",", 1)
    tail = F.substr(c, ix + 1)
    swapped = unicode_strip(strip_chars(F.concat(tail, F.lit(" "), head), ","))
    return F.when(ix == 0, c).otherwise(swapped)


def strip_parenthesis_permute_comma(c) -> Column:
    """E1 then E2, commas stripped at the ends."""
    return strip_chars(permute_first_comma(strip_parenthesis(c)), ",")


def remove_comma(c) -> Column:
    return F.regexp_replace(_c(c), ",", "")


def tokens(c) -> Column:
    """Python ``str.split()``: runs of white space, no empty tokens."""
    s = unicode_strip(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, WS_CLASS + "+"))
