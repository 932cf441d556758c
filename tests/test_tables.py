import gzip

import pytest
from pyspark.sql import functions as F

from tracegauge.sources import scans, tables

EVAL = 'Q,DATA\nWhat?,"{\n  ""ground_truth_output"": ""a, \'b\' and \\""c\\""""\n}"\n"Two, parts?","{""ground_truth_output"": ""x""}"\n'


@pytest.mark.parametrize("packed", [False, True])
def test_csv_with_line_breaks_in_quotes(spark, tmp_path, packed):
    path = tmp_path / ("d.csv.gz" if packed else "d.csv")
    if packed:
        with gzip.open(path, "wt") as f:
            f.write(EVAL)
    else:
        path.write_text(EVAL)
    rows = tables.eval_inputs(tables.read_csv(spark, str(path), tables.EVAL_DATA)).collect()
    assert [(r.input_query, r.ground_truth_string) for r in rows] == [("What?", "a, 'b' and \"c\""), ("Two, parts?", "x")]
    assert rows[0].query_json.messages[0].content == "What?"


def test_columns_are_mapped_by_position(spark, tmp_path):
    (tmp_path / "d.csv").write_text("OTHER,NAMES,ARE,IGNORED,HERE,X,Y\n2026-01-01,5,4,1,1.5,4.0,9.5\n")
    row = tables.read_csv(spark, str(tmp_path / "d.csv"), tables.DAILY_SUPPORT_METRICS).first()
    assert (str(row.metric_date), row.total_cases, row.avg_first_response_mins) == ("2026-01-01", 5, 9.5)


def test_bad_value_raises(spark, tmp_path):
    (tmp_path / "d.csv").write_text("a,b,c,d,e,f,g\n2026-01-01,many,4,1,1.5,4.0,9.5\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.read_csv(spark, str(tmp_path / "d.csv"), tables.DAILY_SUPPORT_METRICS).collect()


def test_table_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("2026-01-01", "5", 4, 1, 1.5, 4.0, 9.5)], tables.DAILY_SUPPORT_METRICS.fieldNames())
    tables.replace_table(rows, path, tables.DAILY_SUPPORT_METRICS)
    tables.append_table(rows, path, tables.DAILY_SUPPORT_METRICS)
    back = spark.read.parquet(path)
    assert back.count() == 2 and back.schema["total_cases"].dataType.simpleString() == "int"
    tables.replace_table(rows, path)
    assert spark.read.parquet(path).count() == 1


def test_dataset_version_is_written_once(spark, tmp_path):
    data = tables.eval_dataset(spark.createDataFrame([("q", "t")], "input string, truth string"), {"query_text": "input", "expected_tools": "truth"})
    tables.write_dataset_version(data, str(tmp_path), "v1")
    assert tables.read_dataset_version(spark, str(tmp_path), "v1").columns == ["query_text", "expected_tools"]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_dataset_version(data, str(tmp_path), "v1")


def test_case_without_resolution_stays_searchable(spark):
    df = spark.createDataFrame([("i", None), ("j", "r"), (None, "r")], "issue string, fix string")
    assert [r.corpus_text for r in tables.search_corpus(df, "issue", "fix").collect()] == ["i Resolution: ", "j Resolution: r", None]


def test_job_cap_applies_before_the_name_filter(spark):
    df = spark.range(10).select(
        F.col("id").alias("job_id"),
        F.when(F.col("id") < 5, "EVAL_x").otherwise("load").alias("name"),
        F.when(F.col("id") % 2 == 0, "FAILED").otherwise("SUCCEEDED").alias("state"),
        (F.lit("2026-01-01").cast("timestamp") + F.make_dt_interval(F.col("id").cast("int"))).alias("scheduled_time"),
    )
    now = F.lit("2026-01-10").cast("timestamp")
    got = lambda **o: [r.job_id for r in scans.job_history(df, ["%eval%"], until=now, **o).collect()]
    assert got(cap=4) == []
    assert got(cap=6) == [4]
    assert got(cap=100) == [4, 3, 2]
    assert got(cap=100, errors_only=True) == [4, 2]
    assert got(cap=100, days=30) == [4, 3, 2, 1, 0]
    assert scans.job_history(df, ["%"], days=100000).count() == 10
