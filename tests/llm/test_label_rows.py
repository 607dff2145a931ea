"""A label counts once, whatever the number of rows of its id."""

from namekit.llm import toxicity


def test_one_row_a_label(spark, monkeypatch):
    sizes, real = [], toxicity._logistic
    monkeypatch.setattr(toxicity, "_logistic", lambda x, *a: sizes.append(len(x)) or real(x, *a))
    rows = [(i, f"awful nasty words number {i}" if i % 2 else f"kind friendly text number {i}") for i in range(40)]
    docs = spark.createDataFrame(rows + [rows[1]] * 500 + [rows[3]] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels) is not None
    assert len(sizes) == 1 and sizes[0] <= 40


def test_topk_large_components(spark):
    """Components beyond 2^16, products beyond 2^53 and shards of both kinds; a score that no long holds is an error."""
    import math
    import random

    import numpy as np
    import pytest

    from namekit.llm import topk
    rng = random.Random(3)
    rows = [(0, [70000.0, -1.5]), (1, [80000.0, 2.25]), (2, [80000.0, 2.25]), (50, [-3e6, 0.001])]
    rows += [(k, [rng.uniform(-4e6, 4e6), rng.uniform(-1, 1)]) for k in range(51, 260)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, 50, 5, shard_rows=64, block_queries=4).collect()}
    data = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    for q in (i for i in data if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(data[q], v, strict=True)), i) for i, v in data.items() if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    wide = spark.createDataFrame([(0, [5e6, 1.0]), (1, [1e6, 3.0]), (2, [1e6, 3.0]), (3, [-9e6, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(wide, 50).orderBy("rank").collect()][:2] == [
        (i, 256 * 256 * 5 * 10**12 + 256 * 768) for i in (1, 2)]
    huge = spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(huge, 50).collect()
    assert np.iinfo(np.int64).min > topk.NONE
