"""Cleaning columns, comma/parenthesis permuters, token reordering
against brute force, crossing counts."""

import itertools

from pyspark.sql import functions as F

from namekit.functions import align as A
from namekit.functions import permute as P
from namekit.functions import text as T


def py_strip_comma(s):
    return s.strip(",")


def py_comma(s):
    i = s.find(",")
    if i == -1:
        return s
    return f"{s[i + 1:]} {s[:i]}".strip(",").strip()


def col(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_na_tokens(spark):
    assert col(spark, ["NA", "null", "", "nan", "x"], T.na_to_null) == [None, None, None, "nan", "x"]


def test_unicode_strip(spark):
    vals = [" ab　", " \tx ", "a b"]
    assert col(spark, vals, T.unicode_strip) == [v.strip() for v in vals]


def test_parentheses_greedy(spark):
    assert col(spark, ["A (b) c (d) e", "(x)", "no paren"], T.strip_parenthesis) == ["A  e", "", "no paren"]


def test_comma_permutation(spark):
    vals = ["Biden, Joe", ",x", "a, b, c", "no comma here ", "x,", ""]
    assert col(spark, vals, T.permute_first_comma) == [py_comma(v) for v in vals]


def py_lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def py_e4(text, rom, eng):
    toks = text.replace(",", "").split()
    rtoks = rom.replace(",", "").split()
    if not 2 <= len(toks) <= 4:
        return text, True
    best, bd = text, float("inf")
    for perm, rperm in zip(itertools.permutations(toks), itertools.permutations(rtoks)):
        d = py_lev(" ".join(rperm), eng)
        if d < bd:
            bd, best = d, " ".join(perm).strip(",").strip()
    return best.strip(","), best == text


def test_permute_lowest_distance_brute_force(spark):
    rows = [("Joe Biden", "Joe Biden", "Biden Joe"), ("a b c", "x y z", "z y x"),
            ("w1 w2 w3 w4", "w1 w2 w3 w4", "w4 w3 w2 w1"), ("one", "one", "eno"),
            ("a b c d e", "a b c d e", "e d c b a"), ("Biden, Joe", "Biden, Joe", "Joe Biden"),
            ("p q", "r s t u v w", "w v u t s r"), ("p q r", "", "x"), ("m n", "only", "only")]
    df = spark.createDataFrame(rows, "t string, r string, e string")
    got = df.select(P.permute_lowest_distance(F.col("t"), F.col("r"), F.col("e")).alias("x")).collect()
    for (t, r, e), g in zip(rows, got):
        assert (g["x"]["text"], g["x"]["is_unchanged"]) == py_e4(t, r, e), (t, r, e)


def test_romanize(spark):
    assert col(spark, ["Ça été", "Ölçü", "ß"], P.romanize) == ["Ca ete", "Olcu", "ß"]


def test_crossing_count(spark):
    vals = ["0-0 1-1", "0-1 1-0", "1-0 0-1", "0-0-1 1-1 0-2", "", "   ", "2-0 0-3 1-1 1-0"]

    def py(a):
        toks = []
        for pos, t in enumerate(a.strip().split(" ")):
            p = t.split("-")
            if len(p) == 2 and all(x.isdigit() for x in p):
                toks.append((int(p[0]), int(p[1]), pos))
        toks.sort(key=lambda x: (x[0], x[2]))
        mx, n = 0, 0
        for s, t, _ in toks:
            if t < mx:
                n += 1
            mx = max(mx, t)
        return n

    assert col(spark, vals, A.crossing_count) == [py(v) for v in vals]


def test_alignment_pair(spark):
    df = spark.createDataFrame([("ab c", "x y")], "a string, e string")
    assert df.select(A.alignment_pair("a", "e")).first()[0] == "a b ▁ c ||| x ▁ y"


def test_romanization_distance_equals_levenshtein(spark):
    import random
    import unicodedata
    rnd = random.Random(7)
    letters = [chr(c) for c in range(0x20, 0x250) if unicodedata.category(chr(c))[0] in "LZP"] + list("ÅÉéßİ")
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    words += ["Ça été", "eéééé", "Åå", "İstanbul"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    rows = df.select("w", P.romanization_distance(F.col("w")).alias("d"), P.romanize(F.col("w")).alias("r")).collect()
    for r in rows:
        assert r["d"] == py_lev(r["w"].lower(), r["r"].lower()), r["w"]
