"""Removal of repeats against the windows of an earlier batch."""

from textloom.llm import substring_dedup

SCHEMA = "doc_id long, text string"


def test_second_batch_against_stored_first(spark, tmp_path):
    old = " ".join(f"w{i}" for i in range(30))
    new = " ".join(f"n{i}" for i in range(20))
    first = [(1, old), (9, new)]
    second = [(2, "lead in " + " ".join(old.split()[5:20]) + " tail"), (3, old), (4, new), (5, "only words of its own in this text here"), (6, "short w1 w2")]
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    cut = lambda rows, h: {r.doc_id: (r.n_removed, r.text) for r in substring_dedup.remove_repeats(frame(rows), window=8, gram=3, with_text=True, history=h).collect()}
    index = substring_dedup.WindowIndex(spark, str(tmp_path / "w"), fan_in=3)
    assert cut(first, index) == {1: (0, old), 9: (0, new)}
    index = substring_dedup.WindowIndex(spark, index.path, fan_in=3, runs=index.runs)  # as a later session finds it
    got = cut(second, index)
    assert got[2] == (15, "lead in tail") and got[3] == (30, "") and got[4] == (0, new) and got[5][0] == got[6][0] == 0
    assert cut([(7, new), (8, second[3][1])], index) == {7: (20, ""), 8: (8 + 1, "")}  # the third run: compacted
    assert len(index.runs) == 1
    whole = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(frame(first + second), window=8, gram=3).collect()}
    assert {i: n for i, (n, _) in got.items()} == {i: whole[i] for i in got}
