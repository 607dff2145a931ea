"""Line dedup, importance resampling and the divergence audit against brute force, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from namekit.llm import divergence, linededup, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, score double, rank int, h string, n int, drop string, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.5, 1, "x", 2, "y", 3) for r in rows], DOCS)


# ---- lines

LONG = "This line of forty code points or more É stands here"


def brute_lines(rows, chars, least):
    docs, top = defaultdict(set), {}
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= chars:
                docs[k].add(i if i is not None else ("null", t))
                top[k] = max(x for x in (top.get(k), i) if x is not None) if (top.get(k), i) != (None, None) else None
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(docs[key(x)]) >= least and top[key(x)] is not None and i != top[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_rows():
    rows = [(k, f"  {LONG}\t\nown line number {k} of this very document, long enough\n\n{LONG.lower()}\nshort") for k in range(30)]
    rows += [(k, f"{LONG.upper()}\nsecond boilerplate line that stands in a few documents only") for k in range(30, 36)]
    rows += [(40, None), (41, ""), (42, "\n"), (None, LONG), (None, LONG), (None, f"x\n{LONG}"), (43, "z" * 50_000 + "\n" + LONG)]
    rows += [(50, "a line that five rows have, but all of them are one document"), ] * 6
    rows += [(None, f"only rows without an id hold this long line, it stays {LONG[:0]}\n{k}") for k in range(7)]
    rows += [(60 + k, "\n".join(f"line {j} of a block that several documents repeat verbatim" for j in range(9))) for k in range(5)]
    return rows


@pytest.mark.parametrize("batches,fanout", [(4, 2), (1, 2), (7, 3)])
def test_lines_brute_force(spark, batches, fanout):
    rows = line_rows()
    df = frame(spark, [(i, t, "en", "s") for i, t in rows]).repartition(5)
    got = linededup.drop_lines(df, batches=batches, fanout=fanout).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_lines(rows, 40, 5)
    assert linededup.drop_lines(df.limit(0)).count() == 0


def test_runs_hold_each_hash_once(spark):
    keys = spark.range(5000).select(F.unhex(F.md5((F.col("id") % 700).cast("string"))).alias("h"), "id", (F.col("id") % 6).alias("b"))
    runs = linededup.SortedRuns(spark, 2)
    for k in range(6):
        runs.add(keys.where(F.col("b") == k).groupBy("h").agg(F.count("*").alias("n"), F.max("id").alias("top")))
    tables = [spark.table(t) for level in runs.levels for t in level]
    assert len(tables) == 2 and all(len(level) < 2 for level in runs.levels)
    assert sum(t.count() for t in tables) == 700
    want = keys.groupBy("h").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    assert sorted(map(tuple, runs.frequent(8).collect())) == sorted(map(tuple, want.where("n >= 8").collect()))
    runs.close()


# ---- resampling

def brute_resample(rows, target, ngrams, buckets, percent, min_words):
    def features(text):
        w = WORD.findall((text or "").translate(UPPER))
        return w, [" ".join(w[i:i + n]) for n in range(1, ngrams + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        w, f = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, f))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    order = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(order[:percent * len(order) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("ngrams", [1, 2])
def test_resample_brute_force(spark, sf_small, ngrams):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_small}/benchmark.parquet")
    odd = [(9001, None), (9002, ""), (None, "the " * 30), (None, "the " * 30), (9003, "Ünïcode 日本 " * 20), *[(9004, "one and the same row " * 9)] * 40]
    df = docs.union(spark.createDataFrame(odd, "doc_id long, text string")).withColumns({"rank": F.lit(1), "c": F.lit("x"), "n_words": F.lit(2)})
    got = resample.resample(df.repartition(4), target, ngrams=ngrams, buckets=1000, percent=30)
    want = brute_resample([tuple(r) for r in df.select("doc_id", "text").collect()], [r.text for r in target.collect()], ngrams, 1000, 30, 20)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_resample_ties_and_empty(spark, sf_small):
    target = spark.read.parquet(f"{sf_small}/benchmark.parquet")
    rows = [(k // 50, 30, 30, 5, 7) for k in range(3000)] + [(None, 30, 30, 5, 7)] * 40 + [(1, 3, 3, 99, 99)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    got = resample.draw(scored, 20, 10, accuracy=2).collect()
    ranks = sorted((r.rank, r.doc_id) for r in got if r.rank)
    assert len(got) == len(rows) and ranks == [(k + 1, k // 50) for k in range(304)]
    assert [r.rank for r in resample.draw(scored.limit(9), 20, 10).collect()] == [None] * 9
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(empty, target).count() == 0
    assert resample.resample(frame(spark, [(1, "word " * 25, "", "")]), target.limit(0), percent=100).first().rank == 1


def test_bracket_widens(spark):
    scores = spark.range(10_000).select((F.col("id") * 17 % 10_007).alias("score"))
    order = sorted((r.score for r in scores.collect()), reverse=True)
    for wanted in (1, 37, 5000, 10_000):
        for accuracy in (1, 3, 10_000):
            low, high, above = resample.bracket(scores, wanted, 10_000, accuracy)
            assert low <= order[wanted - 1] <= high and above == sum(x > high for x in order) < wanted


# ---- divergences

def brute_divergence(rows, least, top):
    rows = [(t or "", lang or "", s or "") for _, t, lang, s in rows]
    df, count, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for t, lang, s in rows:
        w = LETTERS.findall(t.translate(UPPER))
        df[lang].update(set(w))
        count[lang, s].update(w)
        sources[lang].add(s)
    out = []
    for lang in sources:
        kept = [w for w, n in df[lang].items() if n >= least]
        def shares(c):
            total = sum(c[w] for w in kept) + len(kept)
            return {w: 1 + 10**9 * (c[w] + 1) // total for w in kept}
        p = {s: shares(count[lang, s]) for s in sources[lang]}
        q = shares(sum((count[lang, s] for s in sources[lang]), Counter()))
        for s in sources[lang]:
            pair = [(-sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o.encode()) for o in sources[lang] - {s}]
            term = [(-((p[s][w] - q[w]) ** 2 // q[w]), w.encode()) for w in kept if count[lang, s][w] and p[s][w] > q[w]]
            for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, w.decode(), -v, k + 1) for k, (v, w) in enumerate(items)]
    return sorted(out)


def audit_rows():
    rows = [(k, f"Common words É日本 {'alpha ' * (k % 5)} beta{'x' * (k % 7)} it's 12a", "en" if k % 3 else "de", f"src{k % 4}") for k in range(60)]
    rows += [(100, None, "en", "src0"), (101, "", None, None), (102, "one two", None, "lonely"), (None, "common", "fr", "only"),
             (103, "rare", "it", "a"), (104, "rare", "it", "b"), (105, "w " * 40_000, "en", "src1")]
    return rows + [(200, "same row words alpha", "en", "hot")] * 90


@pytest.mark.parametrize("entries,table", [(1 << 20, 1 << 20), (20, 7)])
def test_divergence_brute_force(spark, monkeypatch, entries, table):
    monkeypatch.setattr(divergence, "MAX_ENTRIES", entries)
    monkeypatch.setattr(divergence, "TABLE_NUMBERS", table)
    monkeypatch.setattr(divergence, "MIN_BLOCKS", 3)
    rows = audit_rows()
    got = divergence.divergences(frame(spark, rows).repartition(4), top=3 if entries == 20 else 200).collect()
    assert sorted(map(tuple, got)) == brute_divergence(rows, 3, 3 if entries == 20 else 200)


def test_merge_in_small_batches(spark):
    rows = audit_rows()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = divergence.divergences(frame(spark, rows).repartition(7)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got)) == brute_divergence(rows, 3, 200)


def test_divergence_empty(spark):
    assert divergence.divergences(frame(spark, []).limit(0)).count() == 0


def test_share_is_exact_beyond_64_bits():
    import numpy as np
    count, total = 5 * 10**13, 7 * 10**13 + 11
    assert int(divergence.share(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * (count + 1) // total
