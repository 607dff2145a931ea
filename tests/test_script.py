"""Unicode blocks, per-name block statistics and Jensen-Shannon divergence,
checked against a plain-Python implementation of the same rules."""

import math
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from namekit.functions import script as S
from namekit.functions.blocks import low_block_name

TEXTS = ["Иван Петров", "東京タワー", "Hello, World 42", "", "  ", "12ab", "ab12",
         "aé€жあ漢😀 1, ", "ﺍﻟﻌﺮﺑﻴﺔ", "עברית", "!!!", "2024", "𝒜𝒷𝒸", "Ель  Ёж ", "x "]


def py_block(spark_blocks, ch):
    cp = ord(ch)
    return low_block_name(cp) if cp < 256 else spark_blocks.get(ch)


def py_counts(text, blocks, strip=False, punct=False, num=False):
    t = text.strip() if strip else text
    out = Counter()
    for ch in t:
        cat = unicodedata.category(ch)
        if punct and cat[0] in "PS":
            continue
        if num and cat[0] == "N":
            continue
        b = py_block(blocks, ch)
        if b:
            out[b] += 1
    return out


def jvm_blocks(spark):
    chars = sorted({c for t in TEXTS for c in t if ord(c) >= 256})
    rows = spark.createDataFrame([(c,) for c in chars], "c string").select(
        "c", F.element_at(S.block_entries(F.col("c")), 1)["block"].alias("b")).collect()
    return {r["c"]: r["b"] for r in rows}


def test_known_blocks(spark):
    b = jvm_blocks(spark)
    assert b["И"] == "CYRILLIC"
    assert b["東"] == "CJK_UNIFIED_IDEOGRAPHS"
    assert b["タ"] == "KATAKANA"
    assert b["ﺍ"].startswith("ARABIC")
    assert b["ע"] == "HEBREW"
    assert b["😀"] == "EMOTICONS"
    assert low_block_name(ord("é")) == "LATIN_EXTENDED_LETTER"
    assert low_block_name(ord(" ")) == "SPACE"
    assert low_block_name(ord("7")) == "DIGIT"
    assert low_block_name(ord("×")) == "LATIN_1_PUNCTUATION"


def test_counts_and_mode_match_python(spark):
    b = jvm_blocks(spark)
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for strip, punct, num in [(False, False, False), (True, True, True), (False, True, False)]:
        rows = df.select("t", S.block_counts("t", strip, punct, num).alias("c"),
                         S.most_common_block("t", strip, punct, num).alias("m")).collect()
        for r in rows:
            exp = py_counts(r["t"], b, strip, punct, num)
            assert dict(r["c"]) == dict(exp), r["t"]
            # mode: highest count, ties to the first seen block
            order = list(dict.fromkeys(
                py_block(b, ch) for ch in (r["t"].strip() if strip else r["t"])
                if py_block(b, ch) and not (punct and unicodedata.category(ch)[0] in "PS")
                and not (num and unicodedata.category(ch)[0] == "N")))
            best = max(order, key=lambda k: (exp[k], -order.index(k))) if order else ""
            assert r["m"] == best, r["t"]


def test_histogram_and_jsd(spark):
    df = spark.createDataFrame([("ab c", "abc")], "a string, b string")
    r = df.select(S.block_histogram("a").alias("p"), S.block_histogram("b").alias("q")).first()
    p, q = dict(r["p"]), dict(r["q"])
    assert math.isclose(sum(p.values()), 1.0)
    js = df.select(S.jensen_shannon(S.block_histogram("a"), S.block_histogram("b")).alias("j")).first()["j"]
    keys = set(p) | set(q)
    exp = 0.0
    for k in keys:
        a, bb = p.get(k, 0.0), q.get(k, 0.0)
        m = (a + bb) / 2
        exp += (a * math.log(a / m) if a else 0) + (bb * math.log(bb / m) if bb else 0)
    assert math.isclose(js, exp / 2, rel_tol=1e-9)


def test_empty_histogram_divergence(spark):
    df = spark.createDataFrame([("",)], "a string")
    j = df.select(S.jensen_shannon(S.block_histogram("a"),
                                   F.create_map(F.lit("BASIC_LATIN"), F.lit(1.0))).alias("j")).first()["j"]
    assert math.isclose(j, 0.5 * math.log(2))
