"""Tables of streams: replayed batches, readers during a change, compaction, class filter; and later finds."""

import os

from pyspark.sql import functions as F

from namekit.operators import kb as B, reshape as I, sample as H, script as D
from namekit.sources import io as IO
from namekit.streaming import snapshots as SN, stream as ST

NAMES = "wikidata_id string, eng string, alias string, language string, type string"


def entities(spark, rows):
    return spark.createDataFrame(rows, "id string, name string, aliases map<string,string>, instance_of array<string>, languages array<string>")


def ingest(spark, base, batch_id, rows, closure=None):
    ST.ingest_batch(spark, ST._with_types(entities(spark, rows), closure), batch_id, base)


def test_replay_and_compaction(spark, tmp_path):
    base = str(tmp_path / "t")
    ingest(spark, base, 0, [("Q1", "old", {"en": "old"}, ["Q5"], ["en"]), ("Q2", "two", {"en": "two"}, [], ["en"])])
    before = ST.current_entities(spark, base)
    ingest(spark, base, 1, [("Q1", "new", {"en": "new", "de": "neu"}, ["Q5"], ["de", "en"])])
    want = [("Q1", "new"), ("Q2", "two")]
    rows = lambda df: sorted((r.id, r.name) for r in df.collect())
    assert rows(ST.current_entities(spark, base)) == want
    assert rows(before) == [("Q1", "old"), ("Q2", "two")]  # a reader keeps the state it began with
    files = {f for _, _, names in os.walk(base) for f in names}
    ingest(spark, base, 1, [("Q1", "replayed", {}, [], [])])
    assert {f for _, _, names in os.walk(base) for f in names} == files
    during = ST.current_entities(spark, base)
    ST.compact_entities(spark, base)
    assert rows(during) == want and rows(ST.current_entities(spark, base)) == want
    ingest(spark, base, 0, [("Q1", "replayed", {}, [], [])])
    assert rows(ST.current_entities(spark, base)) == want
    ingest(spark, base, 2, [("Q3", "three", {"en": "three"}, [], ["en"])])
    ST.compact_entities(spark, base)
    ST.compact_entities(spark, base)
    assert rows(ST.current_entities(spark, base)) == [*want, ("Q3", "three")]
    assert SN.read_manifest(spark, base)["upto"] == 2 and not os.path.exists(f"{base}/batch-0")


def test_a_batch_without_manifest_is_not_seen(spark, tmp_path):
    base = str(tmp_path / "t")
    ingest(spark, base, 0, [("Q1", "one", {"en": "one"}, [], ["en"])])
    entities(spark, [("Q9", "half", {}, [], [])]).write.parquet(f"{base}/batch-1")  # its job has not ended
    assert [r.id for r in ST.current_entities(spark, base).collect()] == ["Q1"]


def test_names_of_classes(spark, tmp_path):
    base = str(tmp_path / "t")
    closure = spark.createDataFrame([("PER", "Q5"), ("ORG", "Q7"), ("PER", "Q6")], "type string, class string")
    rows = [("Q1", "a", {"en": "a", "de": "A"}, ["Q5", "Q7", "Q6"], ["de", "en"]), ("Q2", "b", {"en": "b"}, ["Q9"], ["en"]),
            ("Q3", "c", {"de": "c"}, ["Q5"], ["de"]), ("Q4", "d", {"en": "d"}, None, ["en"])]
    ingest(spark, base, 0, rows, closure)
    got = sorted((r.wikidata_id, r.language, r.type) for r in ST.current_names(spark, base).collect())
    assert got == [("Q1", x, t) for x in ("de", "en") for t in ("ORG", "PER")]
    whole = B.dump_names(entities(spark, rows), closure)
    assert got == sorted((r.wikidata_id, r.language, r.type) for r in whole.collect())
    assert {r.language for r in ST.current_names(spark, base, languages=None, exclude=["en"]).collect()} == {"de"}


def test_counts_are_versions(spark, tmp_path):
    base = str(tmp_path / "c")
    counts = lambda n: spark.createDataFrame([("en", "PER", n)], "language string, type string, count long")
    ST.publish_counts(spark, counts(1), 0, base)
    reader = ST.current_counts(spark, base)
    ST.publish_counts(spark, counts(2), 1, base)
    assert reader.first()["count"] == 1 and ST.current_counts(spark, base).first()["count"] == 2
    ST.publish_counts(spark, counts(9), 1, base)
    assert ST.current_counts(spark, base).first()["count"] == 2


def test_closure_many_types_and_deep_cycles(spark):
    edges = [(f"c{k + 1}", f"c{k}") for k in range(100)] + [("c3", "c90"), ("c50", "x"), ("y", "y"), (None, "c1"), ("d", "c7"), ("d", "c8")]
    roots = [(f"T{k:02d}", f"c{k}") for k in range(70)] + [("Z", "alone"), ("T01", "x")]
    df = spark.createDataFrame(edges, "child string, parent string")
    got = {(r.type, r["class"]) for r in B.subclass_closure(df, spark.createDataFrame(roots, "type string, root string")).collect()}
    below = {}
    for c, p in edges:
        below.setdefault(p, set()).add(c)
    want = set()
    for t, root in roots:
        todo = [root]
        while todo:
            c = todo.pop()
            if (t, c) not in want:
                want.add((t, c))
                todo += [x for x in below.get(c, ()) if x is not None]
    assert got == want


def test_language_folders(spark, tmp_path):
    df = spark.createDataFrame([("Q1", "e", "a", "en", "PER"), ("Q2", "e", "b", "fr", "LOC"), ("Q3", "e", "c", "en", "LOC")], NAMES)
    IO.write_by_language(df, str(tmp_path / "sub"), "tsv", use_subfolders=True)
    assert sorted(os.listdir(tmp_path / "sub")) == ["en", "fr"]
    back = IO.read_names(spark, str(tmp_path / "sub" / "en"), "tsv", IO.NAME_COLUMNS)
    assert sorted(r.wikidata_id for r in back.collect()) == ["Q1", "Q3"] and {r.language for r in back.collect()} == {"en"}
    IO.write_by_language(df, str(tmp_path / "names.jsonl"), "json", use_subfolders=False)
    assert sorted(x for x in os.listdir(tmp_path) if x.startswith("names")) == ["names_en.jsonl", "names_fr.jsonl"]


def test_tagging_errors_and_measures(spark):
    rows = [(f"Q{k}", "e", "name", "en", "PER") for k in range(9)] + [("Q9", "e", "имя", "en", "PER"), ("Q10", "e", "ab имя", "en", "PER")]
    names = spark.createDataFrame(rows, NAMES)
    gold = spark.createDataFrame([("Q0", "en", "name", True), ("Q1", "en", "name", False), ("Q9", "en", "имя", False)],
                                 "wikidata_id string, language string, alias string, gold_anomalous boolean")
    got = {(r.wikidata_id, r.error) for r in D.tagging_errors(D.tag_names(names), gold).collect()}
    assert got == {("Q0", "missed"), ("Q9", "false_alarm")}
    vote = lambda m: {r.wikidata_id: r.vote_divergent for r in D.tag_names(names, keep_votes=True, measure=m, critical=0.5).collect()}
    js, kl = vote("jensen_shannon"), vote("kullback_leibler")
    assert js["Q0"] == kl["Q0"] == -1 and kl["Q9"] == 1 and kl["Q10"] == 1 and js["Q10"] == -1


def test_a_sampler_as_a_function(spark):
    df = spark.createDataFrame([(f"Q{k}", "e", f"n{k}", "en" if k % 4 else "fr", "PER") for k in range(40)], NAMES)
    mine = lambda df, n, seed: df.orderBy(F.col("alias")).limit(n)
    assert sorted(r.alias for r in H.sample(df, 3, mine).collect()) == ["n0", "n1", "n10"]
    assert H.sample(df, 10, "balanced").count() == 10 and H.sample(df, 10, "empirical").count() == 10
    got = H.sample(df, 20, "by_language", min_names=6)
    assert {r.language for r in got.groupBy("language").count().where("count < 6").collect()} == set()


def test_a_column_per_language(spark):
    df = spark.createDataFrame([("Q1", "One", "One", "en", "PER"), ("Q1", "One", "Un", "fr", "PER"), ("Q2", "Two", "Zwei", "de", "LOC")], NAMES)
    got = {r.wikidata_id: r.asDict() for r in I.compare_languages(df, "en", "fr").collect()}
    assert got["Q2"]["de"] == "Zwei" and got["Q2"]["en"] is None and got["Q1"]["fr"] == "Un" and got["Q1"]["en_is_eng"]
    assert not got["Q2"]["en_is_fr"] and I.compare_languages(df, "xx", "fr", ["fr"]).columns[3:5] == ["fr", "xx"]
