"""Near copies among many texts of one template that are too different from each other."""

import random

import pytest

from namekit.llm import probminhash


def families(n_families, n, seed=5):
    """(id, text) and the pairs: of each template ``n`` versions with many changed words (similarity about
    0.54 to each other), and last two with few (about 0.87 to each other, 0.69 to the others)."""
    rng = random.Random(seed)
    def edited(words, k):
        out = list(words)
        for i in rng.sample(range(len(out)), k):
            out[i] = f"x{rng.randrange(10 ** 9)}"
        return " ".join(out)
    rows, pairs = [], []
    for _ in range(n_families):
        template = [f"w{rng.randrange(10 ** 6)}" for _ in range(300)]
        rows += [(len(rows) + i, edited(template, 9)) for i in range(n)]
        a = len(rows)
        rows += [(a, edited(template, 2)), (a + 1, edited(template, 2))]
        pairs.append((a, a + 1))
    return rows, pairs


@pytest.mark.parametrize(("n_families", "n"), [(40, 50), (4, 5_000)])
def test_pairs_in_a_family(spark, n_families, n):
    rows, pairs = families(n_families, n)
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = [p for p in pairs if got[p[0]] != got[p[1]]]
    print(f"recall among {n}: {1 - len(missed) / len(pairs):.3f}, classes {len(set(got.values()))} of {len(rows)} texts")
    assert not missed
    assert len(set(got.values())) > 0.9 * len(rows)


def test_same_shingles_other_counts(spark):
    """Plain Jaccard 1, probability Jaccard 0.53: 200 single shingles and a line of ten words 5 or 40 times."""
    rng, rows = random.Random(6), []
    for p in range(20):
        line = " ".join(f"l{rng.randrange(10 ** 6)}" for _ in range(10))
        rest = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(200))
        rows += [(2 * p, f"{' '.join([line] * 5)} {rest}"), (2 * p + 1, f"{' '.join([line] * 40)} {rest}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(df).collect()}
    assert got == {i: i - i % 2 for i in range(40)}


def shingle_set(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("n", [150, 300])
def test_one_bucket_puts_out_links_not_pairs(spark, n, monkeypatch):
    """A family whose pairs are close to the threshold, some above: as many rows as texts, the classes of brute force."""
    rng = random.Random(9)
    template = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(n):
        out = list(template)
        for i in rng.sample(range(len(out)), rng.choice([2, 3, 4])):
            out[i] = f"x{rng.randrange(10 ** 9)}"
        texts.append(" ".join(out))
    sets = [shingle_set(t) for t in texts]
    root = list(range(n))
    close = 0
    for i in range(n):
        for j in range(i + 1, n):
            jaccard = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            close += jaccard >= 0.75
            if jaccard >= 0.8:
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "node long, text string")
    longer = probminhash._longer(frame).cache()
    rows = frame.selectExpr("node", "7L AS key", "node AS class", f"{n}L AS n", "1L AS major")
    of = spark.createDataFrame([], "node long, class long")
    for nodes, group in ((4096, 2048), (64, 50)):  # in one piece, in blocks
        monkeypatch.setattr(probminhash, "FULL_NODES", nodes)
        monkeypatch.setattr(probminhash, "GROUP_NODES", group)
        near = probminhash._compared(rows, longer).cache()
        blocks = -(-n // nodes)
        assert near.count() < n * blocks < close
        links = probminhash._decided(near, of, frame, longer).collect()
        got = list(range(n))
        for a, b in links:
            x, y = got[a], got[b]
            got = [x if r == y else r for r in got]
        assert len(links) < n * -(-n // group)
        classes = lambda r: {frozenset(i for i in range(n) if r[i] == c) for c in set(r)}
        assert classes(got) == classes(root)


def test_classes_do_not_depend_on_the_size_of_a_block(spark, monkeypatch):
    """Each pair shares registers of one band at most with the rest of its family, in buckets of any size."""
    rows, _ = families(3, 60, seed=11)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for nodes in (4096, 4):
        monkeypatch.setattr(probminhash, "FULL_NODES", nodes)
        got.append(sorted(map(tuple, probminhash.near_duplicates(df).collect())))
    assert got[0] == got[1]


def test_a_refused_candidate_hides_no_other(spark, monkeypatch):
    """Two classes of two texts in a bucket: the first candidate is no link, another one is."""
    words = [f"w{k}" for k in range(300)]
    text = lambda *at: " ".join(f"x{k}y{i}" if i in at else w for i, w in enumerate(words) for k in [len(at)])
    texts = {1: text(20, 60, 100, 140, 180), 2: text(20), 3: text(220, 240, 260, 280, 290), 4: text(60)}
    frame = spark.createDataFrame(sorted(texts.items()), "node long, text string")
    classes = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "node long, class long")
    rows = classes.selectExpr("node", "7L AS key", "class", "4L AS n", "2L AS major")
    longer = probminhash._longer(frame).cache()
    monkeypatch.setattr(probminhash, "LEAST_HEAD", 0.1)
    monkeypatch.setattr(probminhash, "LEAST_LONG", 0.1)
    links = probminhash._decided(probminhash._compared(rows, longer), classes, frame, longer).collect()
    assert len(links) == 1
