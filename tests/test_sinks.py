"""Names and files of Markdown documents."""

from textloom.sources import sinks

ROWS = [(1, "a", "one"), (2, "a", "two"), (3, "a_1", "three"), (None, "a", None), (4, "a_1", "four"), (5, None, "five"), (5, "a", "six"), (None, None, "seven"), (6, "", "eight"), (7, "a_3", "nine")]


def test_names_are_unique_and_no_row_is_lost(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, title string, document string")
    got = [(r.doc_id, r.title, r.file_name) for r in sinks.named(rows).collect()]
    assert sorted((str(i), str(t)) for i, t, _ in got) == sorted((str(i), str(t)) for i, t, _ in ROWS)
    assert len({f for _, _, f in got}) == len(ROWS)
    names = {(i, t): f for i, t, f in got}
    assert names[1, "a"] == "a.md" and names[3, "a_1"] == "a_1.md" and names[7, "a_3"] == "a_3.md"
    assert names[2, "a"] == "a_2.md" and names[4, "a_1"] == "a_1_1.md" and names[5, "a"] == "a_4.md" and names[None, "a"] == "a_5.md"
    assert sinks.named(rows.where("false")).collect() == []


def test_files_are_written_and_earlier_ones_stay(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "doc_id long, title string, document string")
    folder = tmp_path / "out"
    assert sinks.write_markdown(rows.where("doc_id < 4"), str(folder)) == 3
    assert {p.name: p.read_text() for p in folder.glob("*.md")} == {"a.md": "one", "a_2.md": "two", "a_1.md": "three"}
    assert sinks.write_markdown(rows.where("title = 'a' and doc_id is not null"), str(folder)) == 3
    got = {p.name: p.read_text() for p in folder.glob("*.md")}
    assert got["a.md"] == "one" and {got["a_3.md"], got["a_4.md"], got["a_5.md"]} == {"one", "two", "six"} and len(got) == 6
    assert not list(folder.glob(".*.part"))
