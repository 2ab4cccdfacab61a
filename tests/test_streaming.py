"""Streams over several batches: late rows, restarts, repeated contents."""

import datetime as dt

from wardlight.streaming import jobs


def at(day, hour=12):
    return dt.datetime(2024, 1, day, hour)


def test_trend_over_two_runs_with_a_late_row(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")

    def arrive(rows):
        spark.createDataFrame(rows, "ts timestamp, scan_type string, n_findings long").coalesce(1).write.mode("append").parquet(src)
        return jobs.stream_findings_trend(jobs.stream_table(spark, src), out)

    def seen(path):
        return {(r.day.day, r.scan_type): (r.n_findings, r.n_scans) for r in jobs.latest_updates(spark, path, ["day", "scan_type"]).collect()}

    assert seen(arrive([(at(10), "sast", 3), (at(10, 14), "dast", 1)])) == {(10, "sast"): (3, 1), (10, "dast"): (1, 1)}
    # one row on time, one nine days behind a watermark of one day
    assert seen(arrive([(at(10, 13), "sast", 2), (at(1), "sast", 7)])) == {(10, "sast"): (5, 2), (10, "dast"): (1, 1)}


def test_incremental_scan_reads_a_content_once(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    text = 'api_key = "abcdefghijklmnop1234"'

    def arrive(rows):
        spark.createDataFrame(rows, "file string, content string, ts timestamp").coalesce(1).write.mode("append").parquet(src)
        return spark.read.parquet(jobs.stream_incremental_scan(jobs.stream_table(spark, src), out)).count()

    first = arrive([("a.py", text, at(1))])
    assert first > 0 and arrive([("a.py", text, at(2))]) == first
    assert arrive([("a.py", text + "\n", at(3))]) == 2 * first


def test_callback_id_in_the_body(spark, tmp_path):
    for name, rows, cols in (("p", [("id-7", at(1), 1)], "canary string, issued_at timestamp, probe_id int"), ("c", [("/x", "seen id-7 here", at(1), 5)], "path string, body string, received_at timestamp, callback_id int")):
        spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / name))
    p, c = (jobs.stream_table(spark, str(tmp_path / n)) for n in ("p", "c"))
    got = spark.read.parquet(jobs.stream_canary_join(p, c, str(tmp_path / "out"), 60)).collect()
    assert [(r.canary, r.probe_id, r.callback_id) for r in got] == [("id-7", 1, 5)]
