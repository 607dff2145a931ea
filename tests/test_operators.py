"""Operators on small inline tables: type disambiguation, knowledge-base
extraction, closure, sampling, evaluation."""

import math

from pyspark.sql import functions as F

from namekit.operators import clean as C
from namekit.operators import evaluate as K
from namekit.operators import kb as B
from namekit.operators import sample as H
from namekit.sources import dump as DU

NAMES = "wikidata_id string, eng string, alias string, language string, type string"


def test_disambiguation_rules(spark):
    rows = [("Q1", "a", "a", "en", "LOC"), ("Q1", "a", "a", "en", "ORG"),
            ("Q2", "b", "b", "en", "LOC"), ("Q2", "b", "b", "en", "ORG"), ("Q2", "b", "b", "en", "PER"),
            ("Q3", "c", "c", "en", "ORG"), ("Q3", "c", "c", "en", "PER"),
            ("Q4", "d", "d", "en", "LOC"), ("Q4", "d", "d", "en", "PER"),
            ("Q5", "e", "e", "en", "PER"), ("Q5", "e", "e", "en", "PER")]
    out = C.disambiguate_types(spark.createDataFrame(rows, NAMES))
    got = sorted((r["wikidata_id"], r["type"]) for r in out.collect())
    assert got == [("Q1", "LOC"), ("Q2", "ORG"), ("Q3", "ORG"), ("Q4", "PER"), ("Q5", "PER")]
    assert C.assert_single_type(out).count() == 0


def test_no_dedupe_without_ambiguity(spark):
    rows = [("Q5", "e", "e", "en", "PER"), ("Q5", "e", "e", "en", "PER")]
    assert C.disambiguate_types(spark.createDataFrame(rows, NAMES)).count() == 2


def test_dump_parsing(spark):
    lines = ["[",
             '{"id":"Q1","labels":{"en":{"language":"en","value":"One"},"fr":{"language":"fr","value":"Un"}},'
             '"claims":{"P31":[{"mainsnak":{"datavalue":{"value":{"id":"Q5"}}}}]}},',
             '{"id":"Q2", broken',
             '{"id":"Q3","labels":{},"claims":{"P31":[{"mainsnak":{"datavalue":{"value":{"id":"Q5"}}}},'
             '{"mainsnak":{"snaktype":"novalue"}}]}},',
             '{"id":"Q4","claims":{}},',
             "]"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    parsed = DU.parse_entity_lines(df)
    assert DU.dump_decode_errors(parsed).first()["n_errors"] == 3
    ents = B.simplify_entities(parsed.filter(~F.col("_corrupt")).drop("_corrupt"))
    got = {r["id"]: r for r in ents.collect()}
    assert got["Q1"]["name"] == "One" and sorted(got["Q1"]["languages"]) == ["en", "fr"]
    assert got["Q1"]["instance_of"] == ["Q5"]
    assert got["Q3"]["instance_of"] == []          # all-or-nothing
    assert got["Q3"]["name"] == "Q3" and got["Q4"]["name"] == "Q4"


def test_closure_chain_diamond_cycle(spark):
    edges = spark.createDataFrame(
        [("b", "a"), ("c", "b"), ("d", "c"),            # chain a<-b<-c<-d
         ("x", "r"), ("y", "r"), ("z", "x"), ("z", "y"),  # diamond
         ("p", "q"), ("q", "p")],                         # cycle
        "child string, parent string")
    roots = spark.createDataFrame([("T1", "a"), ("T2", "r"), ("T3", "p")], "type string, root string")
    got = sorted(tuple(r) for r in B.subclass_closure(edges, roots).collect())
    assert got == sorted([("T1", "a"), ("T1", "b"), ("T1", "c"), ("T1", "d"),
                          ("T2", "r"), ("T2", "x"), ("T2", "y"), ("T2", "z"),
                          ("T3", "p"), ("T3", "q")])


def test_sampling_properties(spark):
    rows = [(f"Q{i}", "e", f"a{i}", ["en", "fr", "de"][i % 3] if i < 900 else "en", "PER") for i in range(1200)]
    df = spark.createDataFrame(rows, NAMES)
    s = H.sample_per_language(df, 100)
    counts = {r["language"]: r["count"] for r in s.groupBy("language").count().collect()}
    assert counts == {"en": 100, "fr": 100, "de": 100}
    # partition invariance
    a = sorted(r["alias"] for r in H.sample_per_language(df.repartition(1), 100).collect())
    b = sorted(r["alias"] for r in H.sample_per_language(df.repartition(8), 100).collect())
    assert a == b
    assert H.sample_empirical(df, 50).count() == 50
    sp = H.assign_split(df.unionByName(df))
    assert sp.groupBy("wikidata_id").agg(F.countDistinct("split").alias("k")).filter("k > 1").count() == 0


def test_noise_samples_exact(spark):
    rows = [(f"Q{i}", "e", f"w{i % 40}", ["en", "fr"][i % 2], "PER") for i in range(200)]
    df = spark.createDataFrame(rows, NAMES)
    noise = H.noise_samples(df, 5).collect()
    own = {(r["language"], r["alias"]) for r in df.collect()}
    per = {}
    for r in noise:
        assert (r["language"], r["alias"]) not in own
        per.setdefault(r["language"], []).append(r["alias"])
    assert all(len(v) == 5 for v in per.values()) and len(per) == 2


def py_f1(ref, hyp):
    from tests.test_text_and_permute import py_lev
    lcs = 0.5 * (len(ref) + len(hyp) - py_lev(ref, hyp))
    rec = lcs / len(hyp) if hyp else 0
    prec = lcs / len(ref) if ref else 0
    return 2 * rec * prec / (rec + prec) if rec + prec else 0


def test_metrics_against_python(spark):
    rows = [("en", "John Smith", "John Smith"), ("en", "abc", ""), ("en", "abc", "xyz"),
            ("ru", "Иван", "Иванн"), ("ru", "a b c d", "a c d e")]
    df = spark.createDataFrame(rows, "language string, reference string, hypothesis string")
    got = df.select(K.lcs_f1("reference", "hypothesis").alias("f"),
                    K.label_error_rate("reference", "hypothesis").alias("w")).collect()
    for (_, r, h), g in zip(rows, got):
        assert math.isclose(g["f"], py_f1(r, h), abs_tol=1e-12)
    assert math.isclose(got[4]["w"], 0.5)
    m = {r["language"]: r for r in K.metrics_by_language(df).collect()}
    assert math.isclose(m["global"]["word_acc"], 20.0)
    assert m["en"]["bleu"] >= 0 and m["global"]["bleu"] >= 0


def test_bleu_perfect_and_disjoint(spark):
    same = spark.createDataFrame([("en", "a b c d e", "a b c d e")], "language string, reference string, hypothesis string")
    assert math.isclose(K.corpus_bleu(same, ["language"]).first()["bleu"], 100.0)
    dis = spark.createDataFrame([("en", "a b c d", "w x y z")], "language string, reference string, hypothesis string")
    # exponential smoothing: the k-th empty precision becomes 1 / (2^k * total)
    exp = 100 * math.exp(sum(math.log(p) for p in (1 / 8, 1 / 12, 1 / 16, 1 / 16)) / 4)
    assert math.isclose(K.corpus_bleu(dis, ["language"]).first()["bleu"], exp)


def test_vote_aggregation_semantics(spark):
    from namekit.operators import script as D
    rows = [(1, 1, 1), (1, -1, 0), (-1, -1, -1), (0, 0, 0), (1, 0, 0), (-1, 0, 1)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    v = [F.col("a"), F.col("b"), F.col("c")]
    got = df.select(D.aggregate_votes(v, "majority_vote").alias("m"), D.aggregate_votes(v, "all").alias("al"),
                    D.aggregate_votes(v, "any").alias("an"), D.aggregate_votes(v, "all", compat=True).alias("alc"),
                    D.aggregate_votes(v, "any", compat=True).alias("anc")).collect()
    for (a, b, c), g in zip(rows, got):
        votes = [a, b, c]
        assert g["m"] == (sum(votes) / 3 > 0)
        assert g["alc"] == all(votes) and g["anc"] == any(votes)          # original truthiness
        cast = [x for x in votes if x != 0]
        assert g["al"] == (bool(cast) and all(x == 1 for x in cast))      # intended meaning
        assert g["an"] == any(x == 1 for x in votes)


def test_nulls_lose_no_row(spark):
    """Every row is on one side, also with a null language, alias or script list."""
    from namekit.operators import clean, script, similarity
    names = spark.createDataFrame([("Q1", "en", "A", "A"), ("Q2", None, "B", "B"), ("Q3", "xx", None, "C"), ("Q4", "xx", "D", None), ("Q5", "yy", "E", "E")],
                                  "wikidata_id string, language string, alias string, eng string")
    assert [r[0] for r in clean.drop_languages(names, ["en"], "language").orderBy("wikidata_id").collect()] == ["Q2", "Q3", "Q4", "Q5"]
    kept, flagged = similarity.filter_similar(names, exact=True)
    assert kept.count() + flagged.count() == 5
    allow = spark.createDataFrame([("xx", None), ("yy", ["BASIC LATIN"])], "language_code string, scripts array<string>")
    assert sum(side.count() for side in script.apply_script_allowlist(names, allow, lang="language", alias="alias")) == 5
