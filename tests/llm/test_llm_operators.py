"""The training-data operators against brute force, and on nulls, empty tables, ties and clashing names."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest

from namekit.llm import (
    bytebpe, chunkdedup, decontaminate, pii, probminhash, queries, sharding, tokencount, topk, toxicity, urlfilter)

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [(1, None), (2, ""), (3, "  \n"), (None, "one two"), (5, "a"), (6, "same words here and now"),
       (7, "same words here and now"), (7, "same words here and now"), (8, "x" * 60_000), (9, "naïve 日本 Été <|endoftext|> it's 12,345")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 0.5, "n", 1, [1]) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, node string, n_tokens int, spans array<int>")


@pytest.fixture(scope="module")
def docs(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/documents.parquet")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def test_topk_brute_force(spark, sf_small):
    df = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, 50, 5, shard_rows=64, block_queries=4).collect()}
    data = {r.vec_id: np.floor(256 * np.array(r.embedding, float)).astype(int) for r in df.collect()}
    for q in (i for i in data if i % 50 == 0):
        best = sorted((-int(data[q] @ v), i) for i, v in data.items() if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]


def test_topk_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]),
            (6, [float("inf"), 0.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(df, 50, 5).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 8, -65536)]
    assert topk.top_k(df.limit(0), 50).count() == 0


def test_sharding(spark, odd):
    rows = sharding.shard(odd, 40).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        assert r.grown_shard in (r.shard, 40)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    many = sharding.shard(spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text"), 40).groupBy("shard").count().collect()
    assert len(many) == 40 and all(380 < r["count"] < 620 for r in many)
    assert sharding.shard(odd.limit(0), 40).count() == 0


def test_decontaminate(spark, odd):
    bench = spark.createDataFrame([(10, "Same WORDS here"), (11, None), (12, "a"), (None, "and now"), (13, " ".join(f"w{i}" for i in range(14)))],
                                  "item_id long, text string")
    extra = spark.createDataFrame([(20, "x " + " ".join(f"w{i}" for i in range(1, 13)) + " y"), (21, " ".join(f"w{i}" for i in range(9)))], "doc_id long, text string")
    got = decontaminate.contamination(odd.select("doc_id", "text").union(extra), bench).collect()
    at = {r.doc_id: r for r in got}
    assert len(got) == 12 and at[7].n_hit == 5 and at[7].n_items == 2 and at[5].contaminated
    assert at[7].items_sha256 == hashlib.sha256(b",10").hexdigest()
    assert at[20].n_hit == 12 and at[20].longest_match == 12 and not at[21].contaminated and at[1].n_words == 0
    kept = decontaminate.remove_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == 6
    assert not decontaminate.contamination(odd, bench.limit(0)).where("contaminated").count()
    assert decontaminate.contamination(odd.limit(0), bench).count() == 0


def test_decontaminate_blocks(docs, spark, sf_small, monkeypatch):
    bench = spark.read.parquet(f"{sf_small}/benchmark.parquet")
    one = {tuple(r)[:6] for r in decontaminate.contamination(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 4_000)
    assert {tuple(r)[:6] for r in decontaminate.contamination(docs, bench).collect()} == one


def test_chunkdedup(spark, odd):
    rng = random.Random(1)
    def text(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    shared = text(55)
    rows = [(i, text(300)) for i in range(20)] + [(100 + i, f"{text(40 + i)} {shared} {text(80)}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = chunkdedup.repeated_passages(df).collect()
    assert {r.doc_id for r in got} == {100 + i for i in range(6)} and all(r.first_doc_id == 100 for r in got)
    left = {r.doc_id: r.text for r in chunkdedup.remove_repeats(df).collect()}
    assert left[100] == dict(rows)[100] and all(len(left[100 + i].split()) <= 155 + i for i in range(1, 6))
    assert chunkdedup.repeated_passages(odd).count() == 0 and chunkdedup.repeated_passages(odd.limit(0)).count() == 0
    assert chunkdedup.remove_repeats(odd).count() == len(ODD)


def brute_chunks(text):
    """(start, end, words) of the chunks of a text, one word at a time."""
    data, spans = (text or "").encode(), []
    wide = {w.decode() for w in chunkdedup.WIDE_SPACES}
    at = 0
    for ch in text or "":
        b = ch.encode()
        word = ch not in wide and (len(b) > 1 or ch.isalnum())
        alone = ch >= "\u3000"
        if word and not alone and spans and spans[-1][1] == at and not spans[-1][2]:
            spans[-1][1] += len(b)
        elif word:
            spans.append([at, at + len(b), alone])
        at += len(b)
    def gear(end):
        h = 0
        for x in (bytes(chunkdedup.GEAR_BYTES) + data)[:chunkdedup.GEAR_BYTES + end][-chunkdedup.GEAR_BYTES:]:
            h = (2 * h + int(chunkdedup.GEAR[x])) % 2 ** 32
        return h
    value = [gear(e) for _, e, _ in spans[:-1]]
    R = chunkdedup.REACH
    cut = [all(value[k] < v for v in value[max(0, i - R):i]) and all(value[k] <= v for v in value[i + 1:i + 1 + R])
           for i, k in enumerate(range(len(value)))]
    heads = [0, *(i + 1 for i, c in enumerate(cut) if c)] if spans else []
    return [(spans[a][0], spans[b][0] if b < len(spans) else len(data), b - a, data[spans[a][0]:spans[b - 1][1]])
            for a, b in zip(heads, [*heads[1:], len(spans)])]


def brute_passages(rows, least_words):
    """(doc, start, end, words) as the operator defines them."""
    where, chunks = {}, {}
    for key, (i, text) in enumerate(rows):
        doc = ("id", i) if i is not None else ("text", text)
        chunks[key] = (doc, brute_chunks(text))
        for c in chunks[key][1]:
            where.setdefault(c[3], set()).add(doc)
    out = []
    for doc, cs in chunks.values():
        run = []
        for c in [*cs, None]:
            if c is not None and len(where[c[3]]) > 1:
                run.append(c)
                continue
            if sum(x[2] for x in run) >= least_words:
                out.append((doc[1] if doc[0] == "id" else None, run[0][0], run[-1][1], sum(x[2] for x in run)))
            run = []
    return sorted(out, key=repr)


@pytest.mark.parametrize("gap", [" ", ", ", "/", "\u00a0", "\u3000", "", "\n\t "])
def test_chunkdedup_brute_force(spark, gap):
    """Passages of 50 words and more, whatever sets the words apart; without anything, of a script without spaces."""
    rng = random.Random(2)
    letters = "\u4e00\u4e8c\u5c71\u6c34\u706b\u6728" if not gap else "abcdefgh\u00e9"
    def text(n):
        return gap.join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n))
    shared = [text(60) for _ in range(3)]
    rows = [(i, gap.join([text(30 + i), shared[i % 3], text(50)])) for i in range(12)] + [(50 + i, text(200)) for i in range(5)]
    rows += [(None, gap.join([text(40), shared[0], text(20 + k)])) for k in range(3)] + [(60, None), (61, ""), (62, gap * 9), (63, "x" * 3000)]
    only = text(70)
    rows += [(None, gap.join([text(10 + k), only])) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = chunkdedup.repeated_passages(df).collect()
    assert sorted(((r.doc_id, r.start, r.end, r.n_words) for r in got), key=repr) == brute_passages(rows, chunkdedup.MIN_WORDS)
    found = {r.doc_id for r in got}
    assert set(range(12)) <= found and sum(r.doc_id is None for r in got) >= 6 and not found & {50, 51, 52, 53, 54, 60, 61, 62, 63}


def test_urlfilter(spark):
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    urls = [None, "", "nothing", "http://A.Example.ORG/es/1?x", "https://example.org/en/19#a", "http://x.com/de/", "http://notexample.org/es/",
            "http://org", "ftp://org/", "http://com/fr/a?b/c"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[4][2:] == ("example.org/en/1", "block")
    assert got[5][2:] == ("com/de/", "block") and got[6][2:] == ("org/", "allow") and got[7] == ("org", "", None, "allow")
    assert got[8][2:] == ("org/", "allow") and got[9][2:] == ("com/fr/", "allow")
    assert urlfilter.judge(pages, rules.limit(0)).where("verdict = 'allow'").count() == len(urls)


def test_toxicity(spark, odd):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(d, labels)
    got = toxicity.score(d, model).join(labels, "doc_id").where("held_out").select("predicted", "toxic").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95
    assert toxicity.score(odd, model).count() == len(ODD)
    assert toxicity.remove_toxic(odd, None).count() == len(ODD)
    assert toxicity.train(d, labels.limit(0)) is None
    best = toxicity.segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5])
    assert [(round(s), a, b) for s, a, b in best] == [(4, 0, 1), (3, 2, 3), (7, 4, 11)]


def test_token_counts(spark, docs, odd):
    path = P.path("word_bpe_49k.json")
    t = tokencount.load(open(path, encoding="utf-8").read())
    for df in (docs.limit(60), odd):
        for r in tokencount.count_tokens(df, path, 2048, chunk=700, overlap=40).collect():
            texts = [x.text or "" for x in df.where(df.doc_id.eqNullSafe(r.doc_id)).collect()]
            assert r.n_tokens in [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    assert tokencount.count_tokens(odd.limit(0), path, 1).count() == 0


def test_pii_base_spans():
    plain = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    def ok(k, s):
        d = re.sub("[^0-9]", "", s)
        return (k == 0 or k == 1 and all(int(p) <= 255 for p in s.split(".")) or k == 2 and 14 <= len(d) <= 19 and pii.luhn(d)
                or k == 3 and 10 <= len(d) <= 15)
    rng = random.Random(4)
    parts = ["a@b.com", "x@y@z.de", "1.2.3.4.5", "300.1.2.3", "4041894974608795", "4041 8949-7460 8795", "+1 (456) 555-2186", "+49", " ", "-", ".", "7", "007", "@", "é"]
    for _ in range(3_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(plain) for m in re.finditer(p, text) if ok(k, m.group()))
        assert pii.base_spans(text) == want


def test_pii(spark, odd):
    df = spark.createDataFrame([(1, "mail joe@x.org or joe [at] x [dot] org, tel 456 555-2186", "k"), (2, None, "k")], "doc_id long, text string, spans string")
    r = {x.doc_id: x for x in pii.find(df).collect()}
    assert r[1].n_email == 1 and r[1].spans.startswith("email:5:14") and r[2].spans == "" and r[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = {x.doc_id: x.text for x in pii.redact(df).collect()}
    assert masked[1].startswith("mail [EMAIL] or") and masked[2] is None
    assert pii.find(odd).count() == len(ODD) and pii.find(odd.limit(0)).count() == 0


def test_pii_added_spans(spark):
    """Spelled-out addresses, local numbers and cards in longer groups are found, look-alikes are not."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    def digits(n):
        return "".join(rng.choice("23456789") for _ in range(n))
    def card():
        while not pii.luhn(c := "4" + digits(15)):
            pass
        return c
    def filler(n):
        return " ".join(word() for _ in range(n))
    rows, want, never = [], {}, {}
    for i in range(1500):
        kind = i % 10
        name = word()
        good, bad = {
            0: (f"{name} [at] {word()} [dot] com", None), 1: (f"{name} (at) {word()}.org", None), 2: (f"({digits(3)}) {digits(3)}-{digits(4)}", None),
            3: (f"{digits(3)}-{digits(3)}-{digits(4)}", None), 4: (card(), None), 5: (None, f"{digits(3)} {digits(3)} {digits(4)}"),
            6: (None, f"{digits(3)}.{digits(3)}.{rng.randrange(300, 999)}.{rng.randrange(300, 999)}"), 7: (f"{name}@{word()}.com", None),
            8: (f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", None), 9: (None, f"9{digits(13)}")}[kind]
        cue = {0: "write to", 1: "email", 2: "call", 3: "phone", 4: "card", 5: "invoice", 6: "version", 7: "mail", 8: "tel", 9: "serial"}[kind]
        value = good or bad
        if kind == 4:  # inside a longer run of digits, which the base pattern takes whole and refuses
            value = f"{digits(16)} {good}"
        text = f"{filler(6)} {cue} {value} {filler(5)}"
        rows.append((i, text))
        if good and kind not in (7, 8):
            want[i] = (text.index(good), text.index(good) + len(good))
        if bad:
            never[i] = text
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = pii.train(df)
    got = {r.doc_id: r for r in pii.find(df, model).collect()}
    spans = {i: {tuple(map(int, x.split(":")[1:])) for x in got[i].spans.split(",") if x} for i in got}
    caught = sum(want[i] in spans[i] for i in want) / len(want)
    wrong = sum(bool(spans[i]) for i in never) / len(never)
    print(f"caught {caught:.3f}, look-alikes taken {wrong:.3f}, reliabilities {model.reliability}")
    assert caught > 0.9 and wrong < 0.05
    assert all(got[i].n_email == 1 for i in got if i % 10 == 7)
    again = pii.find(df.repartition(3), pii.train(df.repartition(7)))
    assert sorted((r.doc_id, r.spans) for r in again.collect()) == sorted((i, r.spans) for i, r in got.items())


def test_pii_overlaps():
    base = pii.base_spans("456-555-2186 101 Main St")
    loose = pii.loose_spans("456-555-2186 101 Main St", base)
    assert (0, 3, 12) in loose and (0, 2, 16) in loose  # both are judged
    assert pii.loose_spans("joe [at] example.com", []) == [(0, 0, 20)] and not pii.loose_spans("look at example.com", [])
    long = "1 " * 40_000
    assert pii.loose_spans(long, []) == [] == pii.base_spans(long)
    assert len(pii.loose_spans("123 456 7890 " * 20_000, [])) < 200_000


def test_byte_bpe(spark, docs, odd):
    import tiktoken
    path = P.path("byte_bpe_50k.tiktoken")
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})
    for df in (docs, odd):
        out = bytebpe.encode(df, path, P.PATTERN)
        texts = {}
        for x in df.collect():
            texts.setdefault(x.doc_id, x.text or "")
        rows = out.collect()
        assert all(r.ids == ref.encode_ordinary(texts[r.doc_id]) and r.round_trip for r in rows)
        back = {r.doc_id: r.text for r in bytebpe.decode(out, path).collect()}
        assert back == texts
    codec = bytebpe.Codec(bytebpe.read_ranks(path), P.PATTERN)
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", " \n", "22", "'s", "é", "日本", "!", "\x1c", "aaa", "ing", " the", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3_000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == [ref.encode_ordinary(t) for t in texts]


def test_near_duplicates(spark, docs, odd):
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(docs).collect()}
    sets = {r.doc_id: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for r in docs.collect() if (w := words(r.text))}
    up = {i: i for i in got}
    def top(x):
        return x if up[x] == x else top(up[x])
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    assert {i: top(i) for i in got} == got
    kept = probminhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0, (r.text or "")[:6]) for r in kept.collect()) == [
        (0, "one tw"), (1, ""), (2, ""), (3, "  \n"), (5, "a"), (6, "same w"), (8, "xxxxxx"), (9, "naïve ")]
    assert probminhash.near_duplicates(odd.limit(0)).count() == 0


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    x, y = {}, {}
    for e in range(60):
        w = int(rng.integers(1, 5))
        x[e] = w
        if e >= 12:
            y[e] = w if e % 3 else int(rng.integers(1, 5))
    exact = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())
    sig = [probminhash.signatures(np.zeros(len(s), np.int64), np.array(list(s), np.uint64) + np.uint64(7), np.array(list(s.values()), float), 1, 2048)[0] for s in (x, y)]
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.04
    sets = [(np.array(sorted(s)), np.array([s[e] for e in sorted(s)])) for s in (x, y)]
    plain = len(x.keys() & y.keys()) / len(x.keys() | y.keys())
    assert abs(probminhash.similarity(*sets) - max(exact, plain)) < 1e-9 or plain >= probminhash.THRESHOLD


def test_pipeline_stages(spark, odd, sf_small):
    import corpus_pipeline
    d = spark.read.parquet(f"{sf_small}/documents.parquet")
    ids = {r.doc_id for r in corpus_pipeline.run(spark, sf_small).collect()}
    classes = {r.doc_id: r.class_id for r in probminhash.near_duplicates(d).collect()}
    assert ids and len({classes[i] for i in ids}) == len(ids)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (odd, odd.limit(0)):
            assert stage(spark, rows, sf_small).columns == odd.columns
