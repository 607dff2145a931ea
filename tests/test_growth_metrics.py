"""Edit distances of many pairs at a time, and metrics that read and split their texts no more often than needed."""

import random

import numpy as np
from pyspark.sql import functions as F

from namekit.functions import distance as D
from namekit.functions.text import tokens
from namekit.operators import evaluate as K


def brute(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
        p = q
    return p[-1]


def test_distances_of_many_pairs():
    rng = random.Random(5)
    word = lambda letters: [rng.randrange(letters) for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 100, 128, 129, 200]))]
    pairs = [(word(k), word(k)) for k in (1, 3, 300) for _ in range(60)]
    pairs += [(a, a[30:] + a[:30]) for a, _ in pairs[:60]] + [(a, [*a[:9], 7, *a[9:]]) for a, _ in pairs[60:120]]
    want = [brute(a, b) for a, b in pairs]
    a, b = (np.array([x for p in pairs for x in p[i]], np.int64) for i in (0, 1))
    m, n = (np.array([len(p[i]) for p in pairs], np.int64) for i in (0, 1))
    for kinds in ({}, {"table": 1}, {"block": 1, "fewest": 1}, {"most_words": 1}, {"block": 64, "fewest": 2}):
        assert D._bit_distances(**kinds)(a, m, b, n, 300).tolist() == want


def test_word_error_rate(spark):
    texts = [None, "", " ", "a", "a b", "b a", "a  b ", "　a\x1cb", "x y z " * 40, "z y x " * 41 + "q", "é 日本 é"]
    rows = [(a, b) for a in texts for b in texts]
    df = spark.createDataFrame(rows, "r string, h string")
    plain = F.try_divide(D.list_distance(tokens("r"), tokens("h")).cast("double"), F.size(tokens("r")))
    got = df.select("r", "h", plain.alias("x"), K.label_error_rate("r", "h").alias("y")).collect()
    for r in got:
        want = brute(r.r.split(), r.h.split()) / len(r.r.split()) if r.r and r.h is not None and r.r.split() else None
        assert r.x == r.y == want


def test_metrics_count_ngrams_once_and_words_are_not_split_by_patterns(spark):
    """K5: the global row takes no second pass over the texts, and words go to Python as texts."""
    rows = [("en", "a b, c", "c a b"), ("en", "x", "x"), ("de", None, "y"), ("de", "p q r s t", "p q r s"), (None, "u v", "u v")]
    df = spark.createDataFrame(rows, "language string, reference string, hypothesis string")
    out = K.metrics_by_language(df)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("MapInArrow") == 1 and "split(" not in text
    got = {r.language: tuple(r)[1:] for r in out.collect()}
    assert got[None] == (0.0, 100.0, 0.0, 100.0, None)
    assert got["de"][:2] == (0.2, 0.0) and got["global"][1] == 50.0 and got["global"][4] is not None
