"""The bounded capture over restarts, against a plain loop over the lines as they come."""

import random
from datetime import datetime, timedelta

from maskline.streaming import capture

SCHEMA = "sample_id string, raw string, ts timestamp, extra string"
BEGIN = datetime(2024, 1, 1)


def plain(batches, lines, seconds):
    """{sample: texts in the order seen}"""
    seen, start = {}, {}
    for batch in batches:
        for ts, raw, sample in sorted((r[2], r[1], r[0]) for r in batch if None not in r[:3]):
            start.setdefault(sample, ts)
            got = seen.setdefault(sample, [])
            if raw not in got and len(got) < lines and ts <= start[sample] + timedelta(seconds=seconds):
                got.append(raw)
    return seen


def captured(spark, folder, batches, lines, seconds):
    """Each batch arrives, and the stream is started again for it."""
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        found = capture.bounded(stream, lines, seconds)
        found.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out", format="parquet").awaitTermination()
    out = {}
    for r in spark.read.parquet(f"{folder}/out").orderBy("sample_id", "line_no").collect():
        out.setdefault(r.sample_id, []).append(r.raw)
        assert r.line_no == len(out[r.sample_id])
    return out


def test_three_starts_end_at_the_same_lines(spark, tmp_path):
    draw = random.Random(3)
    batches = []
    for k in range(3):
        # One sample has most rows; texts repeat within and between batches.
        rows = [(draw.choice("aaaab"), f"line {draw.randrange(60)}", BEGIN + timedelta(seconds=k * 100 + draw.randrange(100)), "x") for _ in range(300 if k else 20)]
        batches.append(rows + [(None, "n", BEGIN, "x"), ("a", None, BEGIN, "x"), ("b", "no time", None, None), ("c", "", BEGIN + timedelta(seconds=k), None)])
    assert captured(spark, tmp_path, batches, 30, 250) == plain(batches, 30, 250)


def test_time_budget_and_nothing(spark, tmp_path):
    at = lambda s: BEGIN + timedelta(seconds=s)
    batches = [[("a", "x", at(0), ""), ("a", "end", at(10), ""), ("a", "late", at(10.5), "")], [], [("a", "more", at(9), ""), ("a", "late", at(11), "")]]
    assert captured(spark, tmp_path, batches, 99, 10) == {"a": ["x", "end", "more"]}
