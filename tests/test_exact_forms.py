"""BLEU counts, MinHash, noise samples, token crossings and the aligner against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from namekit.functions import similarity as G
from namekit.functions.align import crossing_count
from namekit.operators import align as FA, evaluate as K, names as E, sample as H


def test_bleu_counts(spark):
    rng = random.Random(1)
    rows = [(" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(30))), " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(30))))
            for _ in range(200)] + [("", ""), ("a a a a a", "a a a"), (None, "x y"), ("x", None), ("the " * 3000, "the cat " * 2000)]
    df = spark.createDataFrame(rows, "r string, h string").select("r", "h", K.bleu_row_stats("r", "h").alias("s")).select("r", "h", "s.*")
    for x in df.collect():
        r, h = (x.r or "").split(), (x.h or "").split()
        assert (x.hyp_len, x.ref_len) == (len(h), len(r))
        for n in range(1, 5):
            hc, rc = (Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1)) for t in (h, r))
            assert (x[f"c{n}"], x[f"t{n}"]) == (sum((hc & rc).values()), sum(hc.values()))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_minhash(spark):
    rows = [("abc", "abd"), ("", ""), ("", "a"), (None, "a"), ("日本語", "日本"), ("aaa", "a"), ("x" * 50 + "y", "yx")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(G.minhash_jaccard("a", "b")).collect()]
    def sig(t):
        hs = [int(hashlib.md5(c.encode()).hexdigest()[:7], 16) for c in set(t)]
        return [min([(a * h + b) % G.PRIME for h in hs], default=G.PRIME) for a, b in G.permutations()]
    want = [None if a is None else sum(x == y for x, y in zip(sig(a), sig(b))) / G.NUM_PERM for a, b in rows]
    assert got == want
    # an estimate of the Jaccard similarity
    pairs = [("abcdefghij"[:k], "abcdefghij") for k in range(1, 11)]
    est = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(G.minhash_jaccard("a", "b")).collect()]
    assert all(abs(e - k / 10) < 0.16 for k, e in zip(range(1, 11), est))


def test_noise_samples(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(lang, f"w{rng.randrange(400)}") for lang, n in (("a", 900), ("b", 60), ("c", 5), ("d", 3000)) for _ in range(n)] + [("e", "only")]
    df = spark.createDataFrame(rows, "language string, alias string")
    order = sorted({a for _, a in rows}, key=lambda a: hashlib.md5(f"1917|{a}".encode()).hexdigest())
    own = defaultdict(set)
    for lang, a in rows:
        own[lang].add(a)
    want = {(lang, a) for lang in own for a in [x for x in order if x not in own[lang]][:30]}
    for size in (1000, 10):
        monkeypatch.setattr(H, "NOISE_BUCKET_ROWS", size)
        got = H.noise_samples(df, 30)
        assert sorted((r.language, r.alias) for r in got.collect()) == sorted(want)
    given = spark.createDataFrame([("b", "mine"), ("b", "too")], "language string, alias string")
    got = {(r.language, r.alias) for r in H.noise_samples(df, 30, hand_labelled=given).collect()}
    assert got == {x for x in want if x[0] != "b"} | {("b", "mine"), ("b", "too")}
    text = H.noise_samples(df, 30)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text


def test_token_crossings(spark):
    rows = [("Biden, Joe", "Joe Biden"), ("a, b c d", "b c d a"), ("x x, x", "x x x"), ("same", "same"), ("a b", "a"), (None, "a"), ("a, a b", "a b a")]
    got = spark.createDataFrame(rows, "original_text string, alias string").select(crossing_count(E.token_alignment())).collect()
    assert [r[0] for r in got] == [1, 3, 0, 0, 0, 0, 1]


def brute_align(pairs, iterations, tension=4.0, p_null=0.08):
    w = Counter(pairs)
    t = None
    def rows(src, trg):
        for j, c in enumerate(trg, 1):
            y = [math.exp(-tension * abs(i * len(trg) - j * len(src)) / (len(src) * len(trg))) for i in range(1, len(src) + 1)]
            prior = [p_null] + [(1 - p_null) * v / sum(y) for v in y]
            yield j, c, [p * (t[s, c] if t else 1.0) for p, s in zip(prior, ["", *src])]
    for _ in range(iterations):
        q, total = defaultdict(float), defaultdict(float)
        for (a, b), n in w.items():
            for _, c, x in rows(a, b):
                for s, v in zip(["", *a], x):
                    q[s, c] += n * v / sum(x)
                    total[s] += n * v / sum(x)
        t = {k: v / total[k[0]] for k, v in q.items()}
    out = {}
    for a, b in w:
        links = []
        for j, _, x in rows(a, b):
            level = [math.floor(math.log(v) * 1e9) for v in x]
            i = level.index(max(level))
            if i:
                links.append(f"{i - 1}-{j - 1}")
        out[a, b] = (w[a, b], " ".join(links))
    return out


def test_aligner(spark):
    rng = random.Random(4)
    words = ["anna", "bob", "карл", "日本語", "ünal", "ana maria"]
    pairs = [(rng.choice(words), rng.choice(["anna", "bob", "karl", "nihongo", "unal", "maria ana"])) for _ in range(60)]
    odd = [("", "abc"), ("abc", ""), (None, "x"), ("x", None)]
    df = spark.createDataFrame(pairs + odd, "alias string, eng string")
    for iterations in (1, 4):
        got = {(r.alias, r.eng): (r.w, r.alignment) for r in FA.align_characters(df, iterations=iterations).collect()}
        mark = lambda s: s.replace(" ", "▁")
        want = brute_align([(mark(a), mark(b)) for a, b in pairs], iterations)
        assert {(mark(a), mark(b)): v for (a, b), v in got.items() if (a, b) not in odd} == want
        assert all(got[o] == (1, "") for o in odd)
    two = df.withColumn("language", F.lit("x")).union(df.withColumn("language", F.lit("y")).limit(20))
    by = FA.align_characters(two, iterations=2, by="language").where("language = 'x'").drop("language")
    assert sorted(map(str, by.collect())) == sorted(map(str, FA.align_characters(df, iterations=2).collect()))
