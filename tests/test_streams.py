"""State of streams over several batches."""

import datetime
import os

from pyspark.sql import functions as F

from tallyloom.streaming import jobs

CAPTURE = "brand string, text string, scraped_at timestamp"
EVENT = "session_id string, created_at timestamp"


def day(n, hour=0):
    return datetime.datetime(2024, 1, 1, hour) + datetime.timedelta(days=n)


def run(spark, tmp_path, schema, batches, job):
    """The rows and the last progress of the job over one file a batch."""
    files = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(files))
        for f in files.glob("part-*.parquet"):
            f.rename(files / f"batch{k}.parquet")
        os.utime(files / f"batch{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = job(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(files)))
    out = str(tmp_path / "out")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).collect(), q.recentProgress


def test_hashes_of_captures_expire(spark, tmp_path):
    batches = [[("A", f"text {k}", day(0)) for k in range(50)] + [("A", "text 1", day(1)), (None, None, day(0)), (None, None, day(0))], [("A", "text 1", day(20))], [("A", "late", day(62)), ("A", "text 2", day(62))], [("B", "text 1", day(63))], [("A", "text 3", day(64))]]
    known = spark.createDataFrame([("A", "text 7")], "brand string, text string").select("brand", F.sha2("text", 256).alias("content_hash"))
    rows, progress = run(spark, tmp_path, CAPTURE, batches, lambda d: jobs.stream_capture_dedup(d, "30 days", known))
    got = sorted((str(r["brand"]), str(r["text"]), r["scraped_at"]) for r in rows if r["text"] not in ("text 1",))
    want = sorted([("A", f"text {k}", day(0)) for k in range(50) if k not in (1, 7)] + [("None", "None", day(0)), ("A", "late", day(62)), ("A", "text 3", day(64))])  # text 2 met its state, text 3 came after that was gone
    assert got == want
    assert sorted((r["brand"] for r in rows if r["text"] == "text 1")) == ["A", "B"]  # kept while its state was
    states = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(states) >= 50 and states[-1] == 3  # the 50 hashes of the first batch are gone


def test_sessions_of_days_are_exact_over_batches(spark, tmp_path):
    batches = [
        [("a", day(0, 1)), ("a", day(0, 2)), ("b", day(0, 3)), (None, day(0, 4)), (None, day(0, 5)), ("a", day(1))],
        [("b", day(0, 6)), ("c", day(1, 5)), ("a", day(1, 7)), ("z", day(2))],
        [("y", day(9))],
    ]
    rows, progress = run(spark, tmp_path, EVENT, batches, jobs.stream_sessions_per_day)
    assert sorted(tuple(r) for r in rows) == [(day(0), 6, 3), (day(1), 3, 2), (day(2), 1, 1)]
    assert progress[-1]["stateOperators"][-1]["numRowsTotal"] + progress[-1]["stateOperators"][0]["numRowsTotal"] == 1  # day 9 is open
