"""Captured answers as a table and as a stream, staged tables, and reports that are taken in passing."""

import json

from pyspark.sql import functions as F

from textloom.operators import records, supervise
from textloom.sources import captured, sinks
from textloom.streaming import jobs


def capture(folder, page, **kinds):
    (folder / page).mkdir(parents=True, exist_ok=True)
    for kind, value in kinds.items():
        (folder / page / f"{kind}.json").write_text(value if isinstance(value, str) else json.dumps(value))


def test_batch_and_stream_give_the_same_rows_and_restarts_go_on(spark, tmp_path):
    folder, out = tmp_path / "answers", str(tmp_path / "out")
    capture(folder, "BV1", info={"title": "One\ntwo", "owner": {"name": "n"}, "stat": {"view": 3}}, tags=[{"tag_name": "t"}])
    capture(folder, "BV 2+ü", info="{broken", parts="[]")
    stream = lambda: captured.arriving_answers(spark, str(folder), files_per_batch=2).drop("at")
    seen = lambda df: sorted((r.page, r.kind, r.answer) for r in df.select("page", "kind", "answer").collect())
    first = seen(jobs.drained(stream(), out))
    assert first == seen(captured.answers(spark, str(folder))) and {p for p, _, _ in first} == {"BV1", "BV 2+ü"} and len(first) == 4
    capture(folder, "BV3", info={"title": "Three"})
    again = seen(jobs.drained(stream(), out))
    assert again == seen(captured.answers(spark, str(folder))) and len(again) == 5

    rows = captured.assembled(captured.answers(spark, str(folder)))
    got = {r.page: r.r for r in rows.select("page", records.api_record(F.col("info"), F.col("tags"), F.col("parts")).alias("r")).collect()}
    assert (got["BV1"].title, got["BV1"].author, got["BV1"].view_count, got["BV1"].tags) == ("One\ntwo", "n", 3, ["t"])
    assert got["BV 2+ü"].title == "未知标题" and got["BV3"].title == "Three"


def test_the_latest_answer_counts(spark):
    rows = spark.createDataFrame([("p", "info", "old", 1), ("p", "info", "new", 2), ("p", "tags", "a", 5), ("q", "other", "x", 1)], "page string, kind string, answer string, at int")
    got = sorted(tuple(r) for r in captured.assembled(rows).select("page", "info", "tags", "parts").collect())
    assert got == [("p", "new", "a", None), ("q", None, None, None)]


def test_tables_are_staged_where_they_are(spark, tmp_path):
    rows, schema = spark.range(50).selectExpr("id AS page_id", "'t' || id AS title"), "page_id long, title string"
    sinks.stage(spark, rows, str(tmp_path / "s"), schema)
    sinks.stage(spark, [{"page_id": 99, "title": "few"}], str(tmp_path / "s"), schema)
    assert sinks.staged(spark, str(tmp_path / "s"), schema).count() == 51


def test_reports_in_passing_equal_those_of_a_second_pass(spark, tmp_path):
    std, platforms = supervise.Standards(), ("douyin", "zhihu", "none")
    rows = spark.createDataFrame([(("douyin", "zhihu", "other")[i % 3], "success" if i % 4 else "error", ("视频", "good title", None)[i % 5 % 3]) for i in range(60)], "platform string, status string, title string").repartition(3)
    rows.write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in supervise.batch_report(table.where("title is not null"), std).where("platform <> 'other'").select("platform", "quality_issues").collect()}
    made, seen = supervise.observed(table, platforms, std)
    assert made._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    made.write.parquet(str(tmp_path / "out"))
    report = supervise.report_of(spark, [seen.get], platforms).collect()
    assert {(r.platform, r.quality_issues) for r in report} == want and seen.get["total"] == 60
    totals = {r.platform: r.total for r in supervise.batch_report(table, std).collect()}
    assert {r.platform: r.total for r in report} == {p: n for p, n in totals.items() if p != "other"}

    stream = supervise.observed_stream(spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), platforms, std)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "s")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    parts = [p.observedMetrics["supervision"].asDict() for p in query.recentProgress if "supervision" in p.observedMetrics]
    assert len(parts) > 1 and sorted(map(tuple, supervise.report_of(spark, parts, platforms).collect())) == sorted(map(tuple, report))
