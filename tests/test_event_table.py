"""Event tables with native objects: the same spans as from text, and only the used attributes are read."""

import pytest
from pyspark.sql import functions as F

from tracegauge.operators.spans import extract_spans
from tracegauge.plans import reports as rep
from tracegauge.sources.attributes import EVENT_SCHEMA
from tracegauge.sources.scans import event_table, write_event_table
from tracegauge.sources.trace_view import trace_events


def bytes_read(spark, df):
    """Bytes that the scan of ``df`` takes from files."""
    statistics = spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics
    total = lambda: sum(s.getBytesRead() for s in statistics())
    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    base = tmp_path_factory.mktemp("events")
    events = trace_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    events.coalesce(2).write.parquet(f"{base}/text")
    write_event_table(event_table(spark, f"{base}/text"), f"{base}/native")
    return f"{base}/text", f"{base}/native"


def test_spans_equal_those_from_text(spark, tables):
    text, native = (extract_spans(event_table(spark, p)) for p in tables)
    assert text.schema == native.schema
    assert text.exceptAll(native).count() == 0 and native.exceptAll(text).count() == 0


def test_a_report_reads_its_attributes_only(spark, tables):
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")  # its reads are not counted
    try:
        used = bytes_read(spark, rep.score_buckets(extract_spans(event_table(spark, tables[1]))))
        every = bytes_read(spark, extract_spans(event_table(spark, tables[1])))
        from_text = bytes_read(spark, rep.score_buckets(extract_spans(event_table(spark, tables[0]))))
    finally:
        spark.conf.unset("parquet.hadoop.vectored.io.enabled")
    assert used < every / 2 and used < from_text / 2


def test_odd_objects(spark, tmp_path):
    key = "obs.eval.score"
    rows = [f'{{"{key}":null}}', "{}", f'{{"{key}":"0.5"}}', f'{{"{key}":1}}', f'{{"{key}":[1]}}', "not json", None, f'{{"{key}":0.25,"obs.agent.name":"a\\"b"}}', '{"obs.run.name":null,"obs.legacy.run.name":"old"}']
    events = spark.createDataFrame([("SPAN", None, None, '{"trace_id":"t"}', None, r) for r in rows], EVENT_SCHEMA)
    write_event_table(events, str(tmp_path / "e"))
    write_event_table(events.limit(0), str(tmp_path / "e"))
    order = lambda df: sorted(map(tuple, df.select("score", "has_score", "agent_name", "run_name", "trace_id").collect()), key=str)
    native = extract_spans(event_table(spark, str(tmp_path / "e")))
    got = order(native)
    assert got == order(extract_spans(events).withColumn("score", F.col("score")))
    assert (None, True, None, None, "t") in got and (0.5, True, None, None, "t") in got and (0.25, True, 'a"b', None, "t") in got


def test_a_table_without_the_columns_is_refused(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "x"))
    with pytest.raises(ValueError, match="record_type"):
        event_table(spark, str(tmp_path / "x"))
