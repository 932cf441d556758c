import glob
import os

import pytest
from pyspark.sql import functions as F

from tracegauge.plans.metrics import Condition, duplicate_keys, metric_query, resolve_table, verified_query
from tracegauge.plans.support_layer import SUPPORT_LAYER as LAYER
from tracegauge.sources import tables

@pytest.fixture(scope="module")
def frames(spark):
    cases = spark.sql(
        """SELECT * FROM VALUES
        ('c1','u1',date'2026-01-05','SecureVault','Billing','Low',10,1.5,2,4.0,0),
        ('c2','u1',date'2026-01-20','SecureVault','Billing','High',20,2.5,4,3.0,1),
        ('c3','u2',date'2026-02-01','AnalyticsHub','Security','High',30,3.5,6,5.0,0)
        AS t(case_id,customer_id,case_date,product,issue_category,priority,first_response_time_mins,resolution_time_hours,num_interactions,csat_score,escalated)"""
    )
    daily = spark.sql(
        """SELECT * FROM VALUES (date'2026-01-05',9,8,1,5.0,4.0,9.0),(date'2026-01-06',9,7,0,6.0,3.5,8.0),(date'2026-02-01',4,4,0,7.0,3.0,7.0)
        AS t(metric_date,total_cases,cases_resolved,cases_escalated,avg_resolution_time_hours,avg_csat_score,avg_first_response_mins)"""
    )
    reps = spark.sql(
        """SELECT * FROM VALUES ('Ann',date'2026-01-05',10,5,1.0,4.0,0.1),('Ann',date'2026-01-12',30,30,3.0,2.0,0.3),('Bob',date'2026-01-05',0,0,2.0,5.0,0.0)
        AS t(rep_name,week_start,cases_handled,cases_resolved,avg_resolution_time_hours,avg_csat_score,escalation_rate)"""
    )
    def typed(df, schema):
        return df.select(*[F.col(f.name).cast(f.dataType) for f in schema])

    return {
        "case_metrics": typed(cases, tables.CASE_METRICS),
        "daily_support_metrics": typed(daily, tables.DAILY_SUPPORT_METRICS),
        "rep_performance": typed(reps, tables.REP_PERFORMANCE),
    }


def ask(frames, **q):
    return [tuple(r) for r in metric_query(LAYER, frames, **q).collect()]


def test_every_metric(frames):
    assert ask(frames, metrics=["total_cases", "avg_first_response_time", "avg_resolution_time", "avg_csat", "escalation_rate", "avg_interactions"]) == [
        (3, 20.0, 2.5, 4.0, pytest.approx(1 / 3), 4.0)
    ]
    assert ask(frames, metrics=["sum_daily_cases", "sum_daily_resolved", "daily_avg_csat", "daily_avg_resolution_time"]) == [(22, 19, 3.5, 6.0)]
    assert ask(frames, metrics=["total_rep_cases", "total_rep_resolved", "rep_avg_csat", "rep_avg_resolution_time", "rep_avg_escalation_rate", "resolution rate"], dimensions=["rep"], order_by=[("rep", "asc")]) == [
        ("Ann", 40, 35, 3.0, 2.0, pytest.approx(0.2), 0.875),
        ("Bob", 0, 0, 5.0, 2.0, 0.0, None),
    ]


def test_synonyms_time_grain_and_filter(frames):
    got = ask(frames, metrics=["Mean CSAT"], dimensions=["opened date"], time_grain="month", filters=[Condition("severity", "in", ("Low", "High"))], order_by=[("case_date", "asc")])
    assert [(str(d), v) for d, v in got] == [("2026-01-01", 3.5), ("2026-02-01", 5.0)]


def test_busiest_day_is_the_earliest_of_equals(frames):
    got = ask(frames, metrics=["sum_daily_cases"], dimensions=["day"], order_by=[("sum_daily_cases", "desc"), ("day", "asc")], limit=1)
    assert [(str(d), n) for d, n in got] == [("2026-01-05", 9)]


def test_verified_queries(frames):
    for name in LAYER.verified:
        assert verified_query(LAYER, frames, name).count() > 0
    assert [tuple(r) for r in verified_query(LAYER, frames, "total_cases_by_product").collect()] == [("SecureVault", 2), ("AnalyticsHub", 1)]


def test_names_that_do_not_resolve(frames):
    with pytest.raises(ValueError, match="no logical table"):
        metric_query(LAYER, frames, metrics=["total_cases", "sum_daily_cases"])
    with pytest.raises(ValueError, match="ambiguous"):
        resolve_table(LAYER, [], ["date"])
    with pytest.raises(ValueError, match="no value"):
        metric_query(LAYER, frames, metrics=["total_cases"], filters=[Condition("priority", "=", "Urgent")])
    with pytest.raises(ValueError, match="grain"):
        metric_query(LAYER, frames, metrics=["total_cases"], time_grain="decade")
    with pytest.raises(ValueError, match="operator"):
        metric_query(LAYER, frames, metrics=["total_cases"], filters=[Condition("priority", "~", "Low")])


def test_operators(frames):
    for op, value, n in (("=", "c1", 1), ("<>", "c1", 2), ("<", "c2", 1), ("<=", "c2", 2), (">", "c2", 1), (">=", "c2", 2), ("between", ("c1", "c2"), 2), ("like", "c%", 3)):
        assert ask(frames, metrics=["case count"], filters=[Condition("case_id", op, value)]) == [(n,)]


def test_key_check(frames):
    assert duplicate_keys(LAYER, frames, "case_metrics").count() == 0
    twice = {**frames, "case_metrics": frames["case_metrics"].unionByName(frames["case_metrics"].limit(1))}
    assert duplicate_keys(LAYER, twice, "case_metrics").count() == 1
    with pytest.raises(ValueError):
        duplicate_keys(LAYER, frames, "rep_performance")


@pytest.fixture(scope="module")
def shipped(spark):
    """Published tables, found by their header line in the folder SUPPORT_TABLES_DIR."""
    folder = os.environ.get("SUPPORT_TABLES_DIR")
    if not folder:
        pytest.skip("SUPPORT_TABLES_DIR is not set")
    schemas = {"case_metrics": tables.CASE_METRICS, "daily_support_metrics": tables.DAILY_SUPPORT_METRICS, "rep_performance": tables.REP_PERFORMANCE, "eval_data": tables.EVAL_DATA}
    found = {}
    for path in sorted(glob.glob(f"{folder}/*.csv")):
        header = open(path).readline().strip().lower()
        for name, schema in schemas.items():
            if header == ",".join(f.name for f in schema):
                found.setdefault(name, []).append(tables.read_csv(spark, path, schema))
    return found


def two(x):
    return round(x + 1e-9, 2)


def test_published_answers(shipped):
    f = {k: v[0] for k, v in shipped.items() if k != "eval_data"}
    csat = dict(ask(f, metrics=["avg_csat"], dimensions=["product"]))
    assert {k: two(v) for k, v in csat.items()} == {"AnalyticsHub": 3.89, "SecureVault": 3.84, "API Gateway": 3.83, "DataSync Pro": 3.79, "CloudStore Platform": 3.77}
    assert [(r, two(v)) for r, v in ask(f, metrics=["rep_avg_resolution_time"], dimensions=["rep"], order_by=[("rep_avg_resolution_time", "asc")], limit=4)] == [
        ("Rachel Foster", 8.38), ("Carlos Garcia", 8.41), ("Sarah Chen", 8.65), ("Tom Martinez", 8.73),
    ]
    assert ask(f, metrics=["escalation_rate", "total_cases"], filters=[Condition("priority", "=", "Critical")]) == [(0.2, 25)]
    assert [n for _, n in ask(f, metrics=["total_cases"], dimensions=["category"], order_by=[("total_cases", "desc")])] == [32, 27, 26, 25, 25, 23, 23, 19]
    assert [n for _, n in (tuple(r) for r in verified_query(LAYER, f, "total_cases_by_product").collect())] == [47, 42, 41, 36, 34]
    assert [two(r.avg_csat) for r in verified_query(LAYER, f, "avg_csat_by_category").collect()] == [3.97, 3.92, 3.87, 3.84, 3.79, 3.78, 3.72, 3.66]
    assert [r.total_rep_cases for r in verified_query(LAYER, f, "top_reps_by_volume").collect()] == [216, 209, 206, 205, 205, 205, 197, 191, 180, 178]
    assert [(r.priority, r.escalation_rate) for r in verified_query(LAYER, f, "escalation_rate_by_priority").collect()][:2] == [("Critical", 0.2), ("High", 0.1875)]
    assert ask(f, metrics=["avg_csat", "escalation_rate", "total_cases"]) == [(pytest.approx(3.8215), pytest.approx(0.085), 200)]
    assert {k: two(v) for k, v in ask(f, metrics=["mean FRT"], dimensions=["urgency"])} == {"Low": 14.43, "Medium": 17.42, "High": 22.53, "Critical": 29.56}
    assert {k: two(v) for k, v in ask(f, metrics=["avg_interactions"], dimensions=["urgency"])} == {"Low": 2.54, "Medium": 3.20, "High": 4.16, "Critical": 5.56}
    assert [two(v) for _, v in ask(f, metrics=["rep_avg_csat"], dimensions=["rep"], order_by=[("rep_avg_csat", "desc")], limit=3)] == [4.07, 3.98, 3.90]
    assert [two(v * 100) for _, v in ask(f, metrics=["rep escalation rate"], dimensions=["rep"], order_by=[("rep_avg_escalation_rate", "desc")], limit=3)] == [17.75, 17.08, 14.92]
    assert {k: n for k, n in ask(f, metrics=["total_cases"], dimensions=["priority"])} == {"Medium": 74, "High": 64, "Low": 37, "Critical": 25}
    assert {k: v for k, v in ((k, two(v)) for k, v in ask(f, metrics=["mean TTR"], dimensions=["application"]))}["SecureVault"] == 10.60
    assert ask(f, metrics=["sum_daily_cases"], filters=[Condition("day", "between", ("2026-01-01", "2026-01-31"))]) == [(381,)]
    busiest = ask(f, metrics=["sum_daily_cases"], dimensions=["day"], order_by=[("sum_daily_cases", "desc"), ("day", "asc")], limit=1)
    assert [(str(d), n) for d, n in busiest] == [("2025-12-17", 20)]
    rates = ask(f, metrics=["resolution rate"], dimensions=["rep"], order_by=[("rep_resolution_rate", "desc")])
    assert [round(v * 100, 1) for _, v in rates] == [83.9, 82.7, 81.9, 81.5, 81.2, 80.6, 80.3, 78.9, 77.8, 76.1]


def test_published_evaluation_sets(shipped):
    sizes = []
    for frame in shipped["eval_data"]:
        inputs = tables.eval_inputs(frame).collect()
        assert all(r.ground_truth_string and r.query_json.messages[0].role == "user" for r in inputs)
        sizes.append(len(inputs))
    assert sorted(sizes) == [10, 25]
    assert shipped["case_metrics"][0].agg(F.count("csat_score")).first()[0] == 200
