"""Character-set similarity."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .distance import equal_minima
from .script import _let, characters

NUM_PERM = 128


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def char_set(c) -> Column:
    return F.array_distinct(characters(_c(c)))


def char_jaccard(a, b) -> Column:
    """|chars(a) & chars(b)| / |chars(a) | chars(b)| (1.0 for two empty strings)."""
    sa, sb = char_set(a), char_set(b)
    union = F.size(F.array_union(sa, sb))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(sa, sb)) / union)


#: Modulus of the permutations x -> (a x + b) mod P of 28-bit character hashes; products stay within 64 bits.
PRIME = (1 << 31) - 1


def permutations(num_perm: int = NUM_PERM, seed: int = 1) -> list[tuple[int, int]]:
    """(a, b) of each permutation: 28 bits of digests of seed and number."""
    h = lambda k, i: int(hashlib.md5(f"{seed}|{k}|{i}".encode()).hexdigest()[:7], 16)
    return [(h("a", i) + 1, h("b", i)) for i in range(num_perm)]


def minhash_signature(text, num_perm: int = NUM_PERM) -> Column:
    """MinHash signature of a string's character set: per permutation the least value of its characters (the
    prime itself for an empty string)."""
    perms = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in permutations(num_perm)])
    hashes = F.transform(char_set(text), lambda c: F.conv(F.substring(F.md5(c), 1, 7), 16, 10).cast("long"))
    return _let(hashes, lambda hs: F.transform(perms, lambda p: F.coalesce(
        F.array_min(F.transform(hs, lambda h: (p["a"] * h + p["b"]) % PRIME)), F.lit(PRIME).cast("long"))))


def minhash_jaccard(a, b, num_perm: int = NUM_PERM) -> Column:
    """G1: share of equal MinHash signature positions (estimates G2); null if one of the texts is. A character's
    values under all permutations are computed once for a batch of rows."""
    return equal_minima(_c(a), _c(b), permutations(num_perm), PRIME) / num_perm
