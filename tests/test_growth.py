"""Work that grows no faster than the input: lines parsed once, distances of long texts, shards, cells in chunks."""

import random

import pytest
from pyspark.sql import functions as F

from namekit.functions import distance as D
from namekit.operators import align as FA, evaluate as K, kb as B
from namekit.sources import dump as DU


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dump_lines_are_built_and_parsed_once(spark):
    lines = spark.createDataFrame([("[",), ('{"id":"Q1","claims":{"P31":[]}},',), ('{"id":"Q2"} x},',), (None,)], "v string")
    lines = lines.select(F.concat(F.reverse("v").substr(F.lit(1), F.lit(0)), "v").alias("value"))
    parsed = DU.parse_entity_lines(lines)
    good = B.simplify_entities(parsed.filter(~F.col("_corrupt")))
    assert [r.id for r in good.collect()] == ["Q1"]
    assert parsed.where("_corrupt").count() == 3
    assert _plan(good).count("from_json(") == 1 and _plan(good).count("reverse(") == 1


def test_entities_of_a_class_are_read_once(spark):
    rows = [("Q1", ["a", "b"]), ("Q2", []), ("Q2", ["c"]), ("Q3", ["c"]), (None, ["a"]), ("Q4", None), ("Q5", ["b"]), ("Q5", ["d"])]
    ents = spark.createDataFrame(rows, "id string, instance_of array<string>").select(F.reverse("id").alias("id"), "instance_of")
    got = B.is_instance_of(ents, spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "class string"))
    assert sorted((r.id, tuple(r.instance_of)) for r in got.collect()) == [("1Q", ("a", "b")), ("5Q", ("b",)), ("5Q", ("d",))]
    assert _plan(got).count("reverse(") == 1


def _distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
        p = q
    return p[-1]


def test_distance_of_long_texts(spark):
    rng = random.Random(3)
    word = lambda k: "".join(rng.choice("abc é日😀") for _ in range(k))
    rows = [(word(rng.choice([0, 5, 120, 300])), word(rng.choice([0, 5, 120, 300]))) for _ in range(30)]
    long = word(300)
    rows += [(long, long[40:] + long[:40]), (long, long), (None, long), (long, None), ("", long), (long, "x" + long)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(D.text_distance(F.col("a"), F.col("b")), D.list_distance(F.split("a", " "), F.split("b", " ")), K.lcs_f1("a", "b")).collect()
    for (a, b), (text, words, f1) in zip(rows, got):
        if a is None or b is None:
            assert text is None and words is None
            continue
        assert text == _distance(a, b) and words == _distance(a.split(" "), b.split(" "))
        lcs = (len(a) + len(b) - text) / 2
        want = 2 * lcs / (len(a) + len(b)) if a and b and lcs else 0.0
        assert f1 == pytest.approx(want)


def test_alignment_does_not_depend_on_chunks_and_groups_on_rows(spark, monkeypatch):
    rows = [("abc", "abd", "x"), ("ab", "ba", "x"), ("日本", "nihon", "y"), ("", "a", "x"), (None, "b", "y"), ("c", None, "y"), ("abd", "abc", None)]
    df = spark.createDataFrame(rows, "alias string, eng string, language string")
    whole = [sorted(map(str, FA.align_characters(df, iterations=2, by=by).collect())) for by in (None, "language")]
    monkeypatch.setattr(FA, "CELLS", 3)
    monkeypatch.setattr(FA, "PAIRS_PER_TASK", 1)
    assert whole == [sorted(map(str, FA.align_characters(df, iterations=2, by=by).collect())) for by in (None, "language")]


def test_stream_shards_follow_the_rows(spark, tmp_path, monkeypatch):
    import glob

    from namekit.plans import queries  # noqa: F401  (first, as the query modules import each other)
    from namekit.plans import q_io
    from namekit.streaming import stream
    names = spark.range(0, 900, 1, 9).select(*[F.col("id").cast("string").alias(c) for c in ("wikidata_id", "eng", "alias", "language", "type")])
    seen = []

    def stop(spark, src, *rest):
        seen.append(src)
        raise KeyError
    monkeypatch.setattr(q_io.T, "names", lambda spark, d: names)
    monkeypatch.setattr(q_io.IO, "scratch_path", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(stream, "stream_language_counts", stop)
    with pytest.raises(KeyError):
        q_io.q_s2(spark, "")
    assert len(glob.glob(seen[0] + "/*.json")) == 9


def test_parallel_lines_are_written_at_once(spark, tmp_path):
    """A11's three files are written by one job whose rows are not moved; line k is the same row in each of them."""
    from namekit.sources import io as IO
    rows = [(f"h{i}\nx" if i % 7 else None, f"r{i % 5}", f"<en> {i}\r") for i in range(500)]
    df = spark.createDataFrame(rows, "hypothesis string, reference string, source string").repartition(5)
    IO.write_parallel_lines(df, f"{tmp_path}/o", ["hypothesis", "reference", "source"])
    got = IO.parse_tagged_outputs(spark, *(f"{tmp_path}/o/file={i}" for i in range(3)))
    want = [("en", f"r{i % 5}", f"h{i} x" if i % 7 else "", f"<en> {i}") for i in range(500)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    IO.write_parallel_lines(df.limit(0), f"{tmp_path}/e", ["hypothesis", "reference", "source"])
    assert IO.parse_tagged_outputs(spark, *(f"{tmp_path}/e/file={i}" for i in range(3))).count() == 0


def test_anomaly_report_tags_once(spark):
    """E10's sort reads tagged rows; neither its sample nor its report counts a name's blocks again."""
    from namekit.operators import names as E, script as D
    rows = [("Q1", "a", "abc", "en", "PER"), ("Q2", "b", "日本", "en", "LOC"), ("Q3", "c", None, "en", "ORG"), ("Q4", "d", " x1 ", None, "ORG")] * 3
    names = spark.createDataFrame(rows, "wikidata_id string, eng string, alias string, language string, type string")
    plain = E.anomaly_report(D.tag_names(names))
    kept = E.anomaly_report(D.tag_names(names, keep_block=E.BLOCK))
    assert kept.columns == plain.columns and kept.collect() == plain.collect()
    assert {(r.alias, r[E.BLOCK]) for r in kept.collect()} == {
        ("abc", "BASIC_LATIN"), ("日本", "CJK_UNIFIED_IDEOGRAPHS"), (None, ""), (" x1 ", "SPACE")}
    assert "transform" not in kept._jdf.queryExecution().executedPlan().toString()


def test_language_stats_strip_only_where_needed(spark):
    """White space at the ends counts for the prototype (D6) and not for the expected block."""
    from namekit.operators import script as D
    df = spark.createDataFrame([("en", "  　　 　　ab"), ("en", "ab "), ("fr", "ab"), ("fr", None)], "language string, alias string")
    got = {r.language: r for r in D.language_stats(df).collect()}
    want = {r.language: r.prototype for r in D.language_prototype(df).collect()}
    assert got["en"].expected_block == "BASIC_LATIN" and {k: got[k].prototype for k in got} == want


def test_bleu_sums_in_batches(spark, monkeypatch):
    """K4's sums are those of its rows, also of long texts that repeat many words, whose n-grams were copied once for
    every place before."""
    import time
    rng = random.Random(5)
    text = lambda n, words: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, text(rng.randrange(25), "abcde"), text(rng.randrange(25), "abcdef")) for k in ("x", "y", None) for _ in range(80)]
    rows += [("x", None, "a b"), ("x", "a", None), ("z", "", " "), ("y", "a a a a a a", "a a a"), ("y", "a b c d", "a b c d")]
    df = spark.createDataFrame(rows, "language string, reference string, hypothesis string")
    single = df.select("language", K.bleu_row_stats("reference", "hypothesis").alias("s")).groupBy("language").agg(
        *[F.sum(f"s.{c}").alias(c) for c in K._BLEU_SUMS])
    assert sorted(map(str, K.bleu_stats(df, ["language"]).collect())) == sorted(map(str, single.collect()))
    assert K.bleu_stats(df).first().ref_len == sum(len((r or "").split()) for _, r, _ in rows)
    assert K.bleu_stats(df.limit(0), ["language"]).count() == 0
    import pyarrow as pa
    cut = [[(r or "").split(), (h or "").split()] for _, r, h in rows]
    batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in cut], pa.list_(pa.string())) for i in (0, 1)], names=["r", "h"])
    whole = pa.Table.from_batches(K._batch_stats(iter([batch])))
    monkeypatch.setattr(K, "TOKENS", 7)
    parts = pa.Table.from_batches(K._batch_stats(iter([batch])))
    assert parts.num_rows == len(rows) and parts.combine_chunks().equals(whole.combine_chunks())
    words = [f"w{i}" for i in range(4000)]
    long = spark.createDataFrame([("x", text(30000, words), text(30000, words))], "language string, reference string, hypothesis string")
    start = time.time()
    got = K.bleu_stats(long, ["language"]).first()
    assert got.t4 == 29997 and got.c1 > 20000 and time.time() - start < 5


def test_a_tagger_is_evaluated_once(spark):
    """A vote (D13) is +1, -1 or 0 and uses its tagger's column once, not once for null and once for true."""
    from namekit.operators import script as D
    votes = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, b boolean").select("i", D._vote(F.col("b")).alias("v"))
    assert sorted(map(tuple, votes.collect())) == [(1, 1), (2, -1), (3, 0)]
    assert str(D._vote(F.reverse("b"))).count("reverse") == 1
