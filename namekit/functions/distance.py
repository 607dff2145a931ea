"""Edit distances of long sequences, n-gram matches and MinHash estimates as small Arrow-fed functions inside the tasks.

Spark's ``levenshtein`` visits every cell of the table of distances. Here a column of the table is a pair of whole
numbers, one bit a cell (Myers' bit vectors), so that a step works on all cells of a column at once; the distance is
the same. Many pairs of similar length are worked on together, in words of 64 cells. The functions hold nothing of this
package, so executors need not import it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import unicode_strip

#: Cells of the table of distances from which on bit vectors are faster than Spark's function.
CELLS = 1_000


def _bit_distance() -> Callable:
    def distance(a, b) -> int:
        """Levenshtein distance of two sequences (texts or lists)."""
        if len(a) < len(b):
            a, b = b, a
        # equal ends take no part
        n, x = len(b), 0
        while x < n and a[x] == b[x]:
            x += 1
        y = 0
        while y < n - x and a[-1 - y] == b[-1 - y]:
            y += 1
        a, b = a[x:len(a) - y], b[x:n - y]
        if not len(b):
            return len(a)
        where: dict = {}
        bit = 1
        for c in a:
            where[c] = where.get(c, 0) | bit
            bit <<= 1
        full = bit - 1
        up, down = full, 0  # cells one more, or one less, than the cell before
        for c in b:
            x = where.get(c, 0) | down
            same = (((x & up) + up) ^ up) | x
            more = (down | full ^ (full & (same | up))) << 1 | 1
            less = (same & up) << 1
            up = (less | full ^ (full & (same | more))) & full
            down = more & same & full
        return len(b) + up.bit_count() - down.bit_count()
    return distance


def _bit_distances(most_words: int = 64, block: int = 4096, table: int = 1 << 20, fewest: int = 8) -> Callable:
    """Function of many pairs: the longer sequence stands in up to ``most_words`` words a pair, some ``block`` words are
    worked on together; fewer than ``fewest`` pairs of similar length, or longer ones, one by one."""
    one_by_one = _bit_distance()

    def block_distances(a, m, b, n, pair_a, pair_b, k):
        """Distances of the pairs whose longer sequences a and shorter b stand one after the other as numbers below k."""
        one, last = np.uint64(1), np.uint64(63)
        pairs, words, steps = len(m), int(m.max() + 63) // 64, int(n.max())
        place = np.arange(len(a)) - (np.cumsum(m) - m)[pair_a]
        at = np.arange(len(b)) - (np.cumsum(n) - n)[pair_b]
        # where each value stands in each longer sequence: entry 0 is of values that do not
        if pairs * k * words <= table:
            slots, slot_a, slot_b = pairs * k + 1, pair_a * k + a + 1, pair_b * k + b + 1
        else:
            found, slot_a = np.unique(pair_a * k + a, return_inverse=True)
            slots, slot_a, key = len(found) + 1, slot_a + 1, pair_b * k + b
            slot_b = np.minimum(np.searchsorted(found, key), len(found) - 1)
            slot_b = np.where(found[slot_b] == key, slot_b + 1, 0)
        where = np.zeros(slots * words, np.uint64)
        np.bitwise_or.at(where, slot_a * words + (place >> 6), one << (place & 63).astype(np.uint64))
        # word v of a column is worked on v steps after word 0, with what word v - 1 handed up the step before
        entry = np.zeros((steps + 2 * words, pairs), np.int64)
        entry[at + words - 1, pair_b] = slot_b * words
        word = np.arange(words)[:, None]
        shape = (words, pairs)
        up, down = np.full(shape, ~np.uint64(0)), np.zeros(shape, np.uint64)
        plus, minus = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
        plus[0] = 1
        x, same, more, less = (np.empty(shape, np.uint64) for _ in range(4))
        index = np.empty(shape, np.int64)
        top = (m - 1) >> 6
        end, bit = top * pairs + np.arange(pairs), ((m - 1) & 63).astype(np.uint64)
        out = m.copy()
        for step in range(steps + words - 1):
            np.add(entry[step:step + words][::-1], word, out=index)
            where.take(index, out=same, mode="clip")
            np.bitwise_or(same, down, out=x)
            np.bitwise_or(same, minus, out=same)
            np.bitwise_and(same, up, out=more)
            np.add(more, up, out=more)
            np.bitwise_xor(more, up, out=more)
            np.bitwise_or(same, more, out=same)
            np.bitwise_and(up, same, out=less)
            np.bitwise_or(same, up, out=more)
            np.invert(more, out=more)
            np.bitwise_or(more, down, out=more)
            column = step - top
            delta = ((more.ravel()[end] >> bit) & one).astype(np.int64) - ((less.ravel()[end] >> bit) & one).astype(np.int64)
            out += delta * ((column >= 0) & (column < n))
            np.right_shift(more, last, out=up)  # up is made anew below
            np.left_shift(more, one, out=more)
            np.bitwise_or(more, plus, out=more)
            plus[1:] = up[:-1]
            np.right_shift(less, last, out=up)
            np.left_shift(less, one, out=less)
            np.bitwise_or(less, minus, out=less)
            minus[1:] = up[:-1]
            np.bitwise_or(x, more, out=up)
            np.invert(up, out=up)
            np.bitwise_or(up, less, out=up)
            np.bitwise_and(more, x, out=down)
        return out

    def spread(values, size, at, rows):
        """The rows' values one after the other, and the place in ``rows`` each belongs to."""
        n = size[rows]
        owner = np.repeat(np.arange(len(rows)), n)
        return values[at[rows][owner] + np.arange(len(owner)) - (np.cumsum(n) - n)[owner]], owner

    def distances(a, m, b, n, k):
        """Levenshtein distances of sequences of numbers below ``k`` that stand one after the other, of lengths m and n."""
        values = np.concatenate([a, b])
        swap = m < n
        at_a, at_b = np.cumsum(m) - m, len(a) + np.cumsum(n) - n
        m, n, at_a, at_b = np.where(swap, n, m), np.where(swap, m, n), np.where(swap, at_b, at_a), np.where(swap, at_a, at_b)
        out = m.copy()
        words = (m + 63) >> 6
        order = np.lexsort((n, words))
        order = order[n[order] > 0]
        sizes = words[order]
        i = 0
        while i < len(order):
            j = min(int(np.searchsorted(sizes, sizes[i] + sizes[i] // 4, "right")), i + max(1, block // int(sizes[i])))
            rows = order[i:j]
            if len(rows) < fewest or sizes[j - 1] > most_words:
                for r in rows.tolist():
                    out[r] = one_by_one(values[at_a[r]:at_a[r] + m[r]].tolist(), values[at_b[r]:at_b[r] + n[r]].tolist())
            else:
                (x, pair_x), (y, pair_y) = spread(values, m, at_a, rows), spread(values, n, at_b, rows)
                out[rows] = block_distances(x, m[rows], y, n[rows], pair_x, pair_y, k)
            i = j
        return out
    return distances


def _text_distances() -> Callable:
    distances = _bit_distances()

    def points(texts: list):
        n = np.array([len(x) for x in texts], np.int64)
        return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), n

    def run(a: list, b: list) -> np.ndarray:
        """Distances of texts in characters."""
        (x, m), (y, n) = points(a), points(b)
        number = np.zeros(0x110000, np.int64)
        number[x] = number[y] = 1
        some = np.flatnonzero(number)
        number[some] = np.arange(len(some))
        return distances(number[x], m, number[y], n, max(1, len(some)))
    return run


def _list_distances() -> Callable:
    distances = _bit_distances()

    def run(a: list, b: list) -> np.ndarray:
        """Distances of lists of words."""
        m, n = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        number: dict = {}
        codes = np.array([number.setdefault(w, len(number)) for side in (a, b) for x in side for w in x], np.int64)
        return distances(codes[:m.sum()], m, codes[m.sum():], n, max(1, len(number)))
    return run


def _of_pairs(many: Callable) -> Callable:
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        known = pc.and_(a.is_valid(), b.is_valid())
        some = many(a.filter(known).to_pylist(), b.filter(known).to_pylist())
        return pc.replace_with_mask(pa.nulls(len(a), pa.int32()), known, pa.array(some, pa.int32()))
    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return run


def text_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance on characters (int): Spark's function for short texts, bit vectors for long ones."""
    long = (a != b) & (F.length(a).cast("long") * F.length(b) > CELLS)
    far = F.arrow_udf(_of_pairs(_text_distances()), "int")(F.when(long, a), F.when(long, b))
    return F.when(a == b, F.lit(0)).otherwise(F.coalesce(far, F.levenshtein(F.when(~long, a), F.when(~long, b))))


def list_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of words (int)."""
    far = F.arrow_udf(_of_pairs(_list_distances()), "int")(F.when(a != b, a), F.when(a != b, b))
    return F.when(a == b, F.lit(0)).otherwise(far)


def word_error_rate(a: Column, b: Column) -> Column:
    """Levenshtein distance in words of b from a, by the number of a's words (double; null without one). Words are what
    white space separates, as in ``tokens``."""
    many = _list_distances()

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        known = pc.and_(a.is_valid(), b.is_valid())
        x, y = ([t.split() for t in side.filter(known).to_pylist()] for side in (a, b))
        n = np.array([len(t) for t in x], float)
        with np.errstate(divide="ignore", invalid="ignore"):
            rate = pa.array(many(x, y) / n, pa.float64(), mask=n == 0)
        return pc.replace_with_mask(pa.nulls(len(a), pa.float64()), known, rate)
    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    far = F.arrow_udf(run, "double")(F.when(a != b, a), F.when(a != b, b))
    return F.when(a == b, F.when(unicode_strip(a) != "", F.lit(0.0))).otherwise(far)


def equal_minima(a: Column, b: Column, perms: list[tuple[int, int]], prime: int) -> Column:
    """Number of the permutations x -> (p x + q) mod ``prime`` under which the least value of the characters of both
    texts is the same (long); the prime itself counts as the least value of an empty text."""
    factor = np.array([p for p, _ in perms], np.int64)
    shift = np.array([q for _, q in perms], np.int64)

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        import hashlib
        values: dict = {}
        held: dict = {}

        def least(text):
            chars = frozenset(text)
            if chars not in held:
                for c in chars:
                    if c not in values:
                        h = int(hashlib.md5(c.encode()).hexdigest()[:7], 16)
                        values[c] = (factor * h + shift) % prime
                held[chars] = np.min([values[c] for c in chars], axis=0) if chars else np.full(len(factor), prime)
            return held[chars]
        return pd.Series([None if x is None or y is None else int((least(x) == least(y)).sum()) for x, y in zip(a, b)], dtype="Int64")
    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "long")(a, b)
