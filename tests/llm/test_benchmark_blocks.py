"""The driver holds one block of the benchmark at once."""

from namekit.llm import decontaminate


def test_benchmark_blocks_one_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    turns, real = [], decontaminate._blocks

    def read(*args):
        for block in real(*args):
            turns.append("read")
            yield block

    init = decontaminate.TestIndex.__init__
    monkeypatch.setattr(decontaminate.TestIndex, "__init__", lambda self, *args: turns.append("used") or init(self, *args))
    monkeypatch.setattr(decontaminate, "_blocks", read)
    bench = spark.createDataFrame([(i, f"item {i} text") for i in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "an item 7 text"), (2, "none")], "doc_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {1: True, 2: False}
    assert len(turns) > 4 and turns == ["read", "used"] * (len(turns) // 2)
