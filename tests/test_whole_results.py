"""Rows and values that must not get lost: round trips, bad dump lines, blank names, missing sides, deep class trees."""

import pytest

from namekit.functions import permute as P
from namekit.operators import kb as B
from namekit.operators import names as E
from namekit.operators import reshape as I
from namekit.sources import dump, io

NAMES = "wikidata_id string, eng string, alias string, language string, type string"


@pytest.mark.parametrize("fmt", ["tsv", "csv", "json"])
def test_round_trip_keeps_rows_and_spaces(spark, tmp_path, fmt):
    rows = [(f"Q{i}", "Eng", f" a{i} ", "en", "PER") for i in range(10)]
    path = str(tmp_path / f"names.{fmt}")
    io.write_names(spark.createDataFrame(rows, NAMES), path, fmt)
    got = io.read_names(spark, path, fmt).select("wikidata_id", "eng", "alias", "language", "type")
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_text_after_an_entity_is_a_decode_error(spark):
    lines = spark.createDataFrame([('{"id":"Q1"},',), ('{"id":"Q8"} trailing',), ("[",), ("nothing",)], "value string")
    r = dump.dump_decode_errors(dump.parse_entity_lines(lines)).first()
    assert (r.n_entities, r.n_errors) == (1, 3)


def test_standard_names_have_text_and_english(spark):
    rows = [("Q1", "One", "uno", "es", "PER"), ("Q2", "Q2", "dos", "es", "PER"), ("Q3", "Three", " ", "es", "PER")]
    assert [r.wikidata_id for r in E.standardize_names(spark.createDataFrame(rows, NAMES)).collect()] == ["Q1"]


def test_comparison_with_a_missing_side_is_false(spark):
    r = I.compare_languages(spark.createDataFrame([("Q1", "One", "One", "en", "PER")], NAMES), "en", "fr").first()
    assert (r.en_is_eng, r.fr_is_eng, r.en_is_fr) == (True, False, False)


def test_romanization_distance_is_the_definition(spark):
    df = spark.createDataFrame([("K",), ("Ω",), ("Été",), ("",), ("İstanbul",), ("ẞ",)], "t string")
    for r in df.selectExpr("t").select("t", P.romanization_distance("t").alias("d"),
                                       P.edit_distance(P.F.lower("t"), P.F.lower(P.romanize("t"))).alias("l")).collect():
        assert r.d == r.l, r


def test_closure_of_a_long_chain_with_a_cycle(spark):
    edges = spark.createDataFrame([(f"Q{i + 1}", f"Q{i}") for i in range(7)] + [("Q0", "Q7")], "child string, parent string")
    roots = spark.createDataFrame([("PER", "Q0")], "type string, root string")
    assert B.subclass_closure(edges, roots).count() == 8
