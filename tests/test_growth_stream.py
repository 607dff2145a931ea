"""S1's disk: what a stream's tables move and leave."""

import os

from pyspark.sql import functions as F

from namekit.operators import common
from namekit.streaming import snapshots as SN, stream as ST

ENTITY = "id string, name string, aliases map<string,string>, instance_of array<string>, languages array<string>"
ROWS = [("Q1", "a", {"en": "a", "de": "A"}, ["Q5", "Q7", "Q6"], ["de", "en"]), ("Q2", "b", {"en": "b"}, ["Q9"], ["en"]),
        ("Q3", "c", {"de": "c"}, ["Q5"], ["de"]), ("Q4", "d", {"en": "d"}, None, ["en"]), ("Q4", "d", {"en": "d"}, ["Q6", None], ["en"]),
        ("Q1", "a", {}, [], [])]


def closure(spark):
    return spark.createDataFrame([("PER", "Q5"), ("ORG", "Q7"), ("PER", "Q6")], "type string, class string")


def test_only_row_numbers_go_to_the_classes(spark, monkeypatch):
    """An entity is not copied for every class it has, however large the closure is."""
    want = [("Q1", "a", []), ("Q1", "a", ["ORG", "PER"]), ("Q2", "b", []), ("Q3", "c", ["PER"]), ("Q4", "d", []), ("Q4", "d", ["PER"])]
    for most in (common.MAX_BROADCAST_BYTES, 0):
        monkeypatch.setattr(common.measured_side, "__defaults__", (most,))
        typed = ST._with_types(spark.createDataFrame(ROWS, ENTITY), closure(spark))
        assert typed.columns == ["id", "name", "aliases", "instance_of", "languages", "types"]
        assert sorted((r.id, r.name, sorted(r.types)) for r in typed.collect()) == want
        plan = typed._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("Generate"):].split("Relation")[0]
        assert "aliases" not in below and "struct" not in below


def test_a_compacted_table_is_read_as_it_is(spark, tmp_path):
    base = str(tmp_path / "t")
    for k in (0, 1):
        ST.ingest_batch(spark, ST._with_types(spark.createDataFrame(ROWS[k:k + 2], ENTITY), closure(spark)), k, base)
    before = sorted(map(str, ST.current_entities(spark, base).collect()))
    ST.compact_entities(spark, base)
    after = ST.current_entities(spark, base)
    assert sorted(map(str, after.collect())) == before and len(before) == 3
    assert "Aggregate" not in after._jdf.queryExecution().optimizedPlan().toString()
    ST.ingest_batch(spark, ST._with_types(spark.createDataFrame(ROWS[:1], ENTITY).withColumn("name", F.lit("new")), None), 2, base)
    assert {r.id: r.name for r in ST.current_entities(spark, base).collect()} == {"Q1": "new", "Q2": "b", "Q3": "c"}


def test_shards_are_compressed_and_parsed_rows_go(spark, sf_small, tmp_path, monkeypatch):
    from namekit.plans import queries  # noqa: F401  (first, as the query modules import each other)
    from namekit.plans import q_io
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key)
    monkeypatch.setattr(q_io.IO, "scratch_path", lambda spark, name: str(tmp_path / name))
    assert q_io.q_s1_names(spark, sf_small).count() > 0 and spark.conf.get(key) == old
    base = tmp_path / "stream-names"
    shards = [f for f in os.listdir(base / "in") if f.startswith("part-")]
    assert shards and all(f.endswith(".txt.gz") for f in shards)
    assert not [f for f in os.listdir(base / "table") if f.startswith("parsed-")]
    assert "snapshot" in SN.read_manifest(spark, str(base / "table"))
