"""Sources/sinks, exact line numbers, HTML extraction, streaming = batch,
and the extension hooks (custom processor, tagger, aggregator, distance)."""

import os
import tempfile

from pyspark.sql import functions as F

from namekit.functions import permute as P
from namekit.operators import names as E
from namekit.operators import script as D
from namekit.sources import html as HT
from namekit.sources import io as IO

NAMES = "wikidata_id string, eng string, alias string, language string, type string"


def _tmp():
    return tempfile.mkdtemp(prefix="namekit-test-")


def test_read_names_na_tokens(spark):
    d = _tmp()
    p = os.path.join(d, "x.tsv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("wikidata_id\teng\talias\tlanguage\ttype\n")
        f.write("Q1\tNA\tnull\tnan\tPER\n")
        f.write('Q2\t"a ""b"""\t\tfr\tLOC\n')
    rows = IO.read_names(spark, p).orderBy("wikidata_id").collect()
    assert rows[0]["eng"] is None and rows[0]["alias"] is None and rows[0]["language"] == "nan"
    assert rows[1]["eng"] == 'a "b"' and rows[1]["alias"] is None


def test_roundtrips(spark):
    df = spark.createDataFrame([("Q1", "e", "a, b", "en", "PER"), ("Q2", "é", "ж", "ru", "LOC")], NAMES)
    for fmt in ("tsv", "csv", "jsonl"):
        p = os.path.join(_tmp(), "out")
        IO.write_names(df, p, fmt)
        back = IO.read_names(spark, p, fmt, IO.NAME_COLUMNS)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    p = os.path.join(_tmp(), "bylang")
    IO.write_by_language(df, p)
    assert sorted(x for x in os.listdir(p) if x.startswith("language=")) == ["language=en", "language=ru"]


def test_line_numbers_across_partitions(spark):
    d = _tmp()
    for k in range(3):
        with open(os.path.join(d, f"part-{k:05d}.txt"), "w") as f:
            f.write("".join(f"{k}:{i}\n" for i in range(5 + k)))
    lines = IO.with_line_number(spark.read.text(d))
    got = [r["value"] for r in lines.orderBy("line").collect()]
    exp = [f"{k}:{i}" for k in range(3) for i in range(5 + k)]
    assert got == exp
    assert [r["line"] for r in lines.orderBy("line").collect()] == list(range(len(exp)))


def test_code_lookup_and_allowlist(spark):
    d = _tmp()
    with open(os.path.join(d, "l.json"), "w") as f:
        f.write('{"en": "English", "am": "Amharic"}')
    got = sorted(map(tuple, IO.read_code_lookup(spark, os.path.join(d, "l.json")).collect()))
    assert got == [("am", "Amharic"), ("en", "English")]
    with open(os.path.join(d, "a.tsv"), "w") as f:
        f.write("language_code\tscripts_to_keep\nru\tCYRILLIC, BASIC_LATIN\n")
    r = IO.read_script_allowlist(spark, os.path.join(d, "a.tsv")).first()
    assert r["scripts"] == ["CYRILLIC", "BASIC_LATIN"]


def test_language_of_source(spark):
    df = spark.createDataFrame([("<eng> abc",), ("<am> x",), ("<abcd>",), ("none",)], "source string")
    got = [r[0] for r in df.select(IO.language_of_source("source")).collect()]
    assert got == ["eng", "am", "abcd", None]


def test_html_tables(spark):
    html = ("<table><tr><th>Lang</th><th>Code</th></tr><tr><td>Amharic</td><td>am</td></tr>"
            "<tr><td>Old</td><td>xx (closed)</td></tr><tr><td>Amharic</td><td>amh</td></tr></table>")
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    cells = HT.extract_html_tables(pages)
    assert [r["cells"] for r in cells.orderBy("row_ix").collect()] == [["Amharic", "am"], ["Old", "xx (closed)"],
                                                                        ["Amharic", "amh"]]
    lk = {r["key"]: r["value"] for r in HT.table_to_lookup(cells).collect()}
    assert lk == {"Amharic": "amh", "Old": "xx"}


def test_stream_counts_equal_batch(spark):
    from namekit.streaming.stream import current_counts, stream_language_counts
    base = _tmp()
    df = spark.createDataFrame([(f"Q{i}", "e", f"a{i}", ["en", "fr"][i % 2], ["PER", "LOC"][i % 3 % 2])
                                for i in range(50)], NAMES)
    df.repartition(3).write.json(f"{base}/in")
    q = stream_language_counts(spark, f"{base}/in", f"{base}/out", f"{base}/ck")
    q.awaitTermination()
    got = sorted(map(tuple, current_counts(spark, f"{base}/out").collect()))
    exp = sorted(map(tuple, df.groupBy("language", "type").count().collect()))
    assert got == exp


def test_hooks(spark):
    df = spark.createDataFrame([("Q1", "Joe Biden", "Biden Joe", "en", "PER")], NAMES)
    # U1 custom name processor
    out = E.apply_permuter(df, lambda c: F.upper(c)).first()
    assert out["alias"] == "BIDEN JOE" and out["is_unchanged"] is False
    # U3 custom distance
    r = df.select(P.permute_lowest_distance("alias", "alias", "eng",
                                            distance=lambda a, b: F.abs(F.length(a) - F.length(b)) * 0)
                  .alias("x")).first()["x"]
    assert r["text"] == "Biden Joe"          # all ties -> first permutation
    # U2 custom tagger + U4 custom aggregator
    t = D.tag_names(df, method=lambda votes: F.exists(votes, lambda v: v == 1),
                    extra_taggers={"always": lambda alias, lang: F.lit(True)}).first()
    assert t["anomalous"] is True
