import json

from alphaloom.sources.reports import read_reports
from alphaloom.streaming.jobs import distinct_submissions, sessions


def test_reports_are_found_and_bad_ones_become_rows(spark, tmp_path):
    for name, text in (("a/x", json.dumps({"job": {"input_path": "/in/clip1.mp4"}})), ("b", "{bad"), ("c", "[1]")):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "processing_report.json").write_text(text)
    got = {r.sample: r.failure for r in read_reports(spark, str(tmp_path)).select("sample", "failure").collect()}
    assert got == {"clip1": None, "b": "report is not valid JSON", "c": "report is not an object"}


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:30:00"), (1, "2024-01-01 03:00:00"), (2, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "user_id long, t string").selectExpr("user_id", "cast(t as timestamp) ts", "'x' job_type", "user_id path")
    assert sorted((r.user_id, r.events) for r in sessions(df).collect()) == [(1, 1), (1, 2), (2, 1)]
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = distinct_submissions(stream, delay="10 hours").writeStream.format("memory").queryName("subs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("subs").count() == 2


def test_queue_with_one_slot(spark, tmp_path):
    from alphaloom.streaming.jobs import claims

    say = lambda q, j, action, kind="PROCESS_MEDIA", path="p", t=0: (q, j, action, kind, path, f"2024-01-01 00:00:{t:02d}")
    first = [say("a", 1, "submit", t=1), say("a", 2, "submit", "PREVIEW", t=2), say("a", 3, "submit", "PREVIEW", t=3), say("a", 4, "submit", "VERIFY", t=4), say("a", 5, "submit", "VERIFY", t=5), say("b", 9, "submit", t=1)]
    second = [say("a", 1, "finish", t=10), say("a", 3, "finish", t=11), say("a", 4, "cancel", t=12), say("a", 6, "submit", t=13), say("b", 9, "cancel", t=14)]
    schema = "queue string, job_id long, action string, job_type string, path string, t string"
    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).selectExpr("queue", "job_id", "action", "job_type", "path", "cast(t as timestamp) ts")
        out = claims(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        out.awaitTermination(120)
    got = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r.seq):
        got.setdefault(r.queue, []).append((r.job_id, r.event))
    assert got["a"] == [(1, "running"), (2, "replaced"), (5, "duplicate"), (1, "completed"), (3, "running"), (3, "failed"), (4, "running"), (4, "cancelled"), (6, "running")]
    assert got["b"] == [(9, "running"), (9, "cancelled")]
