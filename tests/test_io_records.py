"""Reading and writing records as users' files have them: line breaks, quotes, mixed folders, bad lines, file order."""

import json

import pytest
from pyspark.sql import functions as F

from namekit.operators import clean as C, sample as H, script as D
from namekit.operators.common import measured_side
from namekit.sources import dump as DU, io as IO

COLS = ["wikidata_id", "alias"]


@pytest.mark.parametrize("fmt", ["csv", "tsv", "json", "jsonl"])
def test_round_trip(spark, tmp_path, fmt):
    rows = [("Q1", "a\nb"), ("Q2", 'say "hi"\tthere, you'), ("Q3", ' "" '), ("Q4", "x\n\n\"\ny"), ("Q5", None), ("Q6", "plain"),
            ("Q7", "back\\slash \\\" end\\"), ("Q8", "line\n\"quoted\" line"), ("Q9", "  spaces  ")]
    rows += [(f"R{k}", f"plain {k}") for k in range(200)]
    df = spark.createDataFrame(rows, "wikidata_id string, alias string").repartition(5)
    path = str(tmp_path / f"x.{fmt}")
    IO.write_names(df, path, fmt)
    got = IO.read_names(spark, path, fmt, COLS)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    assert got.count() == len(rows)
    if fmt in ("csv", "tsv"):
        assert sorted(map(tuple, IO.read_names(spark, path, fmt).select(*COLS).collect()), key=str) == sorted(rows, key=str)


def test_only_files_with_line_breaks_are_read_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text('wikidata_id,alias\nQ1,one\nQ2,"5"" disk"\n')
    (tmp_path / "b.csv").write_text('wikidata_id,alias\nQ3,"two\nlines"\nQ4,"x\n\ny"\n')
    got = IO.read_names(spark, str(tmp_path), "csv", COLS)
    assert sorted(map(tuple, got.collect())) == [("Q1", "one"), ("Q2", '5" disk'), ("Q3", "two\nlines"), ("Q4", "x\n\ny")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 2 and "file_path" in plan


def test_json_shape_per_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"wikidata_id":"Q1","alias":"x"}\n\n{"wikidata_id":"Q2","alias":null}\n')
    (tmp_path / "b.json").write_text('[{"wikidata_id":"Q3","alias":"y"},\n {"wikidata_id":"Q4","alias":"z"}]\n')
    (tmp_path / "c.json").write_text('{"wikidata_id":\n "Q5", "alias": "w"}')
    want = [("Q1", "x"), ("Q2", None), ("Q3", "y"), ("Q4", "z"), ("Q5", "w")]
    for columns in (COLS, None):
        got = IO.read_names(spark, str(tmp_path), "json", columns).select(*COLS)
        assert sorted(map(tuple, got.collect())) == want
    (tmp_path / "d.json").write_text('{"wikidata_id":"Q6","alias":"x"}\n{"wikidata_id":\n"Q7","alias":"x"}\n')
    with pytest.raises(Exception, match="not JSON"):
        IO.read_names(spark, str(tmp_path), "json", COLS).collect()


def entity(i, extra=""):
    return json.dumps({"id": i, "labels": {"en": {"language": "en", "value": i}}, "claims": {}}) + extra


def test_bad_dump_lines(spark):
    lines = [entity("Q1") + ",", entity("Q2") + entity("Q3"), entity("Q8", " trailing}"), entity("Q4", " ,"), entity("Q5", "}"),
             entity("Q6", "] }"), entity("Q7", ",") + entity("Q9"), "[", "]", "", None, entity("Q10"), "{}", "17"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = DU.parse_entity_lines(df)
    assert [r.id for r in got.filter("not _corrupt").collect()] == ["Q1", "Q4", "Q10"]
    assert tuple(DU.dump_decode_errors(got).first()) == (11, 3)


def test_dump_prefix_in_file_order(spark, tmp_path):
    (tmp_path / "a.json").write_text("[\n" + entity("A1") + ",\nbroken\n")
    (tmp_path / "b.json").write_text("".join(entity(f"B{k}") + ",\n" for k in range(400)))
    parsed = DU.read_entity_dump(spark, str(tmp_path), with_errors=True)
    got = DU.take_dump_prefix(parsed, 5)
    assert sorted((r.line_id, r.id) for r in got.collect()) == [(2, "A1"), (4, "B0"), (5, "B1")]
    assert DU.take_dump_prefix(parsed, 10_000).count() == 401 and parsed.count() == 403
    assert "Exchange hashpartitioning" not in _plan(DU.take_dump_prefix(DU.read_entity_dump(spark, str(tmp_path)), 5))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def names(spark):
    rows = [(f"Q{k}", "e", f"name {k}", "en" if k % 3 else "ru", "PER") for k in range(60)]
    return spark.createDataFrame(rows, "wikidata_id string, eng string, alias string, language string, type string")


def test_statistics_do_not_move_the_names(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = names(spark)
        allow = spark.createDataFrame([("en", ["BASIC_LATIN"])], "language_code string, scripts array<string>")
        plans = [D.tag_names(n), D.split_tagged(D.tag_names(n))[1], D.standardize_script_flagged(n, allow), C.keep_above_threshold(n, 25)]
        for df in plans:
            assert "hashpartitioning" not in _plan(df) and "SortMergeJoin" not in _plan(df), _plan(df)
        assert "hashpartitioning" not in _plan(H.sample_smoothed(n, 5))
        assert C.keep_above_threshold(n, 25).count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_large_side_is_not_broadcast(spark):
    n = names(spark)
    side = n.groupBy("language").agg(F.max("alias").alias("m"))
    plan = _plan(n.join(measured_side(side, max_bytes=10), "language")._jdf and n.join(measured_side(side, max_bytes=10).hint("merge"), "language"))
    assert "SortMergeJoin" in plan
    assert "BroadcastHashJoin" in _plan(n.join(measured_side(side), "language"))


def test_standardize_script_keeps_every_row(spark):
    n = spark.createDataFrame([("Q1", "e", "abc", "en", "PER"), ("Q2", "e", "где", "en", "PER"), ("Q3", "e", "abc", "xx", "PER"),
                               ("Q4", "e", None, "en", "PER"), ("Q5", "e", "abc", "de", "PER"), ("Q5", "e", "abd", "de", "PER"), ("Q6", "e", None, "de", "PER"),
                               ("Q7", "e", "x", None, "PER")], "wikidata_id string, eng string, alias string, language string, type string")
    allow = spark.createDataFrame([("en", ["BASIC_LATIN"]), ("xx", None)], "language_code string, scripts array<string>")
    for method in ("majority_vote", "baseline"):
        kept, filtered = D.standardize_script(n, allow, method)
        k, f = {r.wikidata_id for r in kept.collect()}, {r.wikidata_id for r in filtered.collect()}
        assert k | f == {f"Q{i}" for i in range(1, 8)} and not k & f
        assert {"Q2", "Q3", "Q4"} <= f and {"Q1", "Q5", "Q7"} <= k


def test_code_lookup_over_several_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text('{\n "en": "English",\n "de": "German"\n}\n')
    assert sorted(map(tuple, IO.read_code_lookup(spark, str(tmp_path / "x.json")).collect())) == [("de", "German"), ("en", "English")]
