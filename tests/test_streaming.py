"""Windows of a stream equal the batch result once they are finished; restarts and late events."""

import datetime

from pyspark.sql import functions as F

from tracegauge.sources.attributes import EVENT_SCHEMA
from tracegauge.streaming import latency

T0 = datetime.datetime(2024, 1, 1)


def event(minute, agent="A", ms=100, kind="record_root"):
    start = T0 + datetime.timedelta(minutes=minute)
    return ("SPAN", start, start + datetime.timedelta(milliseconds=ms), None, None, f'{{"obs.agent.name":"{agent}","obs.span_type":"{kind}"}}')


def run(spark, base, files_at_once=None):
    latency.run_to_end(latency.windows(latency.event_stream(spark, f"{base}/events", files_at_once), "1 hour", "30 minutes"), f"{base}/out", f"{base}/state")
    rows = spark.read.schema(latency.WINDOW_SCHEMA).parquet(f"{base}/out").collect()
    return sorted(((r.window_start - T0).total_seconds() // 3600, r.agent_name, r.n_requests, r.sum_ms, r.max_ms) for r in rows)


def add(spark, base, rows):
    spark.createDataFrame(rows, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/events")


def test_finished_windows_equal_the_batch(spark, tmp_path):
    base = str(tmp_path)
    rows = [event(m, "AB"[m % 2], 10 * m, "record_root" if m % 5 else "eval_root") for m in range(0, 600, 7)]
    add(spark, base, rows)
    got = run(spark, base)
    batch = latency.windows(spark.read.schema(EVENT_SCHEMA).parquet(f"{base}/events"), "1 hour", "30 minutes")
    last = max(r[1] for r in rows if "record_root" in r[5]) - datetime.timedelta(minutes=30)
    want = sorted(((r.window_start - T0).total_seconds() // 3600, r.agent_name, r.n_requests, r.sum_ms, r.max_ms) for r in batch.collect() if r.window_end <= last)
    assert got == want and len(got) > 10


def test_a_restart_goes_on_and_gives_every_window_once(spark, tmp_path):
    base = str(tmp_path)
    add(spark, base, [event(5), event(50), event(70)])
    assert run(spark, base) == []  # the watermark stands at minute 40
    add(spark, base, [event(45, ms=900), event(100)])  # minute 45 comes late, but in time
    assert run(spark, base) == [(0, "A", 3, 1100, 900)]
    assert run(spark, base) == [(0, "A", 3, 1100, 900)]
    add(spark, base, [event(20), event(200)])  # minute 20 is too late
    assert run(spark, base) == [(0, "A", 3, 1100, 900), (1, "A", 2, 200, 100)]


def test_several_micro_batches(spark, tmp_path):
    base = str(tmp_path)
    for start in range(0, 300, 60):
        add(spark, base, [event(m) for m in range(start, start + 60, 10)])
    assert run(spark, base, files_at_once=1) == [(h, "A", 6, 600, 100) for h in range(4)]
