"""Every registered query: name -> function of (spark, sf_dir)."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegauge.functions.exprs import AgentPair, as_bigint, range_band, round_half
from tracegauge.operators import model_scorers, pairs, rankings, scoring, search, sketches
from tracegauge.operators.ordering import extreme_rows, with_rank
from tracegauge.operators.scratch import scratch_dir
from tracegauge.operators.spans import Wanted, extract_spans, stored_spans
from tracegauge.plans import dashboard as dash
from tracegauge.plans import reports as rep
from tracegauge.plans import table_functions
from tracegauge.plans.metrics import Condition, Field, LogicalTable, Metric, MetricLayer, metric_query, verified_query, with_example
from tracegauge.sources import scans, tables
from tracegauge.sources.trace_view import trace_events
from tracegauge.streaming import latency

Query = Callable[[SparkSession, str], DataFrame]
PAIR = AgentPair()
RUN = "RUN_1"
RECORD = "rec-42"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str, once: bool = False, columns: tuple[str, ...] = (), wanted: Wanted | None = None) -> DataFrame:
    return stored_spans(table(spark, sf_dir, "events"), trace_events, once=once, columns=columns, wanted=wanted)


def _on_spans(report: Callable[..., DataFrame], once: bool = False, columns: tuple[str, ...] = (), wanted: Wanted | None = None, **options) -> Query:
    return lambda spark, sf_dir: report(spans(spark, sf_dir, once, columns, wanted), **options)


# The spans that queries go over: those their reports do not drop.
BOTH = (PAIR.a, PAIR.b)
SCORES = Wanted({"agent_name": BOTH, "span_type": ("eval_root",)})
SCORES_OF_B = Wanted({"agent_name": (PAIR.b,), "span_type": ("eval_root",)})
REQUESTS = Wanted({"agent_name": BOTH, "span_type": ("record_root",)})
REQUESTS_OF_B = Wanted({"agent_name": (PAIR.b,), "span_type": ("record_root",)})
ANSWERS = Wanted({"agent_name": BOTH, "span_type": ("record_root", "eval_root")})
TOOLS_OF_A = Wanted({"agent_name": (PAIR.a,)}, ("SPAN",), ("has_search", "has_analyst", "has_orchestration"))
TOTALS_OF_B = Wanted({"agent_name": (PAIR.b,), "span_type": rep.SPAN_TYPES_IN_TOTALS}, ("SPAN",))
OF_RECORD = Wanted({"record_id": (RECORD,)})
OF_RUN = Wanted({"run_name": (RUN,)})
EVAL_RUN = Wanted({"agent_name": (PAIR.b,), "run_name": (RUN,), "span_type": ("eval_root",)})
#: What the averages of questions read; they go over the spans twice.
ANSWER_COLUMNS = ("agent_name", "span_type", "record_id", "user_query", "metric", "score", "target_record_id", "has_score")


# --- spans and scans -------------------------------------------------------------------------

SPAN_TEXT = ["record_type", "trace_id", "agent_name", "span_type", "record_id", "metric", "run_name", "severity"]


def _extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All typed columns, straight from the event table."""
    typed = extract_spans(trace_events(table(spark, sf_dir, "events")))
    return typed.withColumn("start_us", F.unix_micros("start_ts")).drop("start_ts", "end_ts")


def _native_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with native objects, written and read back."""
    path = f"{scratch_dir(spark)}/events-{uuid.uuid4().hex}"
    scans.write_event_table(trace_events(table(spark, sf_dir, "events")), path)
    return scans.event_table(spark, path)


def _extract_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = extract_spans(_native_events(spark, sf_dir))
    return typed.withColumn("start_us", F.unix_micros("start_ts")).drop("start_ts", "end_ts")


def _buckets_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report straight over native objects: its scan reads the five attributes that the report uses."""
    return rep.score_buckets(extract_spans(_native_events(spark, sf_dir)))


def _scan_columns(df: DataFrame) -> DataFrame:
    return df.select(*SPAN_TEXT, "duration_ms")


def _src_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan_columns(scans.agent_events(spans(spark, sf_dir, wanted=Wanted({"agent_name": (PAIR.a,)})), PAIR.a, "NATIVE AGENT"))


def _src_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    return _scan_columns(scans.all_events(scans.agent_events(s, PAIR.a, "NATIVE AGENT"), scans.agent_events(s, PAIR.b, "EXTERNAL AGENT")))


def _src_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan_columns(scans.run_events(spans(spark, sf_dir, wanted=OF_RUN), RUN))


def _src_eval_run_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.eval_run_latest(spans(spark, sf_dir, wanted=EVAL_RUN), PAIR.b, RUN).select("rank", "record_id", "metric", "score", "target_record_id")


def _logs_of(agent: str) -> Wanted:
    return Wanted({"agent_name": (agent,), "run_name": ("RUN_2",)}, ("LOG",))


def _src_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.logs_by_severity(spans(spark, sf_dir, wanted=_logs_of(PAIR.a)), PAIR.a, "RUN_2").select("trace_id", "severity", "run_name", "record_id")


def _src_logs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.logs_by_severity(spans(spark, sf_dir, wanted=_logs_of(PAIR.b)), PAIR.b, "RUN_2", None).select("trace_id", "severity", "run_name", "record_id")


def _src_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.record_lookup(spans(spark, sf_dir, wanted=OF_RECORD), RECORD).select("planning", *SPAN_TEXT, "duration_ms", "tokens_total", "score")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("user_id") % 3 == 0, "AI_Evaluation_task").when(F.col("user_id") % 3 == 1, "nightly_EVAL").otherwise("load_job")
    failed = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("job_id"),
        kind.alias("name"),
        F.when(failed, "FAILED").otherwise("SUCCEEDED").alias("state"),
        F.when(failed, F.regexp_extract("props", "[0-9]+", 0)).alias("error_code"),
        F.when(failed, F.concat(F.lit("failed after "), F.col("value").cast("decimal(18,2)").cast("string"))).alias("error_message"),
        F.col("props").alias("query_text"),
        F.col("ts").cast("timestamp").alias("scheduled_time"),
        F.when(F.col("event_id") % 11 != 0, F.timestamp_add("MILLISECOND", F.round(F.col("value") * 100).cast("int"), F.col("ts").cast("timestamp"))).alias("completed_time"),
    )


def _job_query(cap: int, errors_only: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        jobs = _jobs(spark, sf_dir)
        newest = jobs.select(F.max("scheduled_time")).scalar()
        rows = scans.job_history(jobs, ["%ai_evaluation%", "%eval%"], 7, cap, errors_only, newest)
        return rows.select("name", "state", "error_code", "error_message", "query_text", F.unix_micros("scheduled_time").alias("scheduled_us"), F.unix_micros("completed_time").alias("completed_us"), "job_id")

    return run


def _eval_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the first answer on record as ground truth, as JSON text."""
    first = extreme_rows(rep.ev.roots(spans(spark, sf_dir)), ["user_query"], "end_ts", "record_id", ["agent_output"], newest=False)
    truth = F.to_json(F.create_map(F.lit("ground_truth_output"), F.col("agent_output")))
    return first.select(F.col("user_query").alias("input_query"), truth.alias("ground_truth_data"))


def _eval_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.eval_dataset(_eval_data(spark, sf_dir), {"query_text": "input_query", "expected_tools": "ground_truth_data"})


def _src_dataset_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a dataset version, read it back, show the first five rows."""
    path = f"{scratch_dir(spark)}/dataset-{uuid.uuid4().hex}"
    tables.write_dataset_version(_eval_dataset(spark, sf_dir), path, "v1")
    return scans.first_rows(tables.read_dataset_version(spark, path, "v1"), [F.col("query_text").asc()], 5)


def _eval_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = tables.eval_inputs(_eval_data(spark, sf_dir))
    spec = {"record_root_input": "query_json", "record_root_ground_truth_output": "ground_truth_string"}
    mapped = tables.apply_dataset_spec(frame.withColumn("query_json", F.to_json("query_json")), spec)
    return mapped


def _search_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).select("doc_id", "lang", "source", "corpus_text")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("resolution"))
    cases = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return tables.search_corpus(cases, "text", "resolution")


# --- casts and ordering ----------------------------------------------------------------------


def _try_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Casts of attribute text that may not fit: text, whole number, float, two-digit decimal."""
    s = spans(spark, sf_dir, wanted=Wanted({"span_type": ("eval_root",)}))
    digits = F.regexp_extract("record_id", "[0-9]+", 0)
    return s.groupBy("metric").agg(
        F.count(as_bigint(F.col("record_id"))).alias("n_record_as_number"),
        F.sum(digits.try_cast("bigint")).alias("sum_record_number"),
        F.count(F.round(F.col("score").cast("decimal(28,9)"), 2).try_cast("decimal(5,2)")).alias("n_two_digits"),
        F.sum(F.round(F.col("score").cast("decimal(28,9)"), 2).try_cast("decimal(5,2)")).cast("double").alias("sum_two_digits"),
        F.max(F.col("score").cast("string").try_cast("double")).alias("max_reparsed"),
    )


def _order_abs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions by the size of the latency difference."""
    d = pairs.response_statistics(spans(spark, sf_dir)).select("user_query", "latency_diff_ms")
    order = [F.abs("latency_diff_ms").desc_nulls_first(), F.col("user_query").asc_nulls_last()]
    return with_rank(d.withColumn("abs_diff_ms", F.abs("latency_diff_ms")), order)


def _first_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.first_rows(rep.query_delta(spans(spark, sf_dir)), [F.col("metric").asc(), F.col("delta").desc(), F.col("user_query").asc()], 20)


def _trace_latest_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeline of the trace a viewer opens for one question: agent A's latest."""
    s = spans(spark, sf_dir)
    newest = F.struct(F.col("end_ts").isNull(), "end_ts", "record_id")
    chosen = (
        rep.ev.roots(s)
        .filter((F.col("agent_name") == PAIR.a) & (F.col("user_query") == "query-5"))
        .agg(F.max_by("trace_id", newest).alias("trace_id"))
    )
    return dash.timeline_a(s.join(F.broadcast(chosen), "trace_id", "left_semi"))


def _sql(text: str, wanted: Wanted | None = None, columns: tuple[str, ...] = ()) -> Query:
    """A query in SQL over the table functions, with the agents as literals."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        called = tuple(re.findall(r"traces_(\w+)\(", text))
        table_functions.register(spark, spans(spark, sf_dir, columns=columns, wanted=wanted), only=called)
        return spark.sql(text.format(a=PAIR.a, b=PAIR.b, run=RUN, record=RECORD))

    return run


# --- metric layer ----------------------------------------------------------------------------

ORDER_LAYER = MetricLayer(
    tables=(
        LogicalTable(
            "cases",
            ("o_orderkey",),
            dimensions=(
                Field("case_id", "o_orderkey"),
                Field("customer_id", "o_custkey", ("customer", "account")),
                Field("category", "o_orderstatus", ("issue type",), values=("F", "O", "P")),
                Field("priority", "o_orderpriority", ("severity", "urgency")),
            ),
            time_dimensions=(Field("case_date", "cast(o_orderdate as date)", ("date", "opened date")),),
            facts=(Field("amount", "o_totalprice", ("value",)), Field("urgent_flag", "cast(o_orderpriority = '1-URGENT' as int)", ("urgent",))),
            metrics=(
                Metric("total_cases", "count(case_id)", ("case count", "number of cases")),
                Metric("avg_amount", "round(cast(avg(amount) as decimal(28,9)), 4)", ("average amount",)),
                Metric("max_amount", "max(amount)"),
                Metric("urgent_rate", "round(cast(avg(urgent_flag) as decimal(28,9)), 6)", ("pct urgent",)),
                Metric("avg_urgent_amount", "round(cast(avg(urgent_flag * amount) as decimal(28,9)), 4)"),
            ),
        ),
        LogicalTable(
            "daily",
            ("metric_date",),
            time_dimensions=(Field("metric_date", synonyms=("day", "report date")),),
            facts=(Field("day_cases", synonyms=("daily cases",)), Field("day_resolved"), Field("day_avg_amount")),
            metrics=(
                Metric("sum_daily_cases", "sum(day_cases)", ("total daily cases",)),
                Metric("sum_daily_resolved", "sum(day_resolved)"),
                Metric("daily_avg_amount", "round(cast(avg(day_avg_amount) as decimal(28,9)), 4)"),
                Metric("daily_max_amount", "max(day_avg_amount)"),
            ),
        ),
        LogicalTable(
            "reps",
            dimensions=(Field("rep", "l_suppkey", ("representative", "support rep")),),
            time_dimensions=(Field("week_start", synonyms=("week",)),),
            facts=(Field("handled"), Field("returned"), Field("avg_discount"), Field("avg_tax"), Field("late_rate")),
            metrics=(
                Metric("total_handled", "sum(handled)", ("total rep cases",)),
                Metric("total_returned", "sum(returned)"),
                Metric("rep_avg_discount", "round(cast(avg(avg_discount) as decimal(28,9)), 6)"),
                Metric("rep_avg_tax", "round(cast(avg(avg_tax) as decimal(28,9)), 6)"),
                Metric("rep_avg_late_rate", "round(cast(avg(late_rate) as decimal(28,9)), 6)"),
                Metric("resolution_rate", "round(cast(try_divide(sum(returned), sum(handled)) as decimal(28,9)), 6)", ("return rate",)),
            ),
        ),
    ),
    verified={
        "cases_by_category": {"metrics": ["case count"], "dimensions": ["issue type"], "order_by": [("total_cases", "desc"), ("category", "asc")]},
        "avg_by_category": {"metrics": ["average amount"], "dimensions": ["category"], "order_by": [("avg_amount", "desc"), ("category", "asc")]},
        "top_reps": {"metrics": ["total_handled"], "dimensions": ["representative"], "order_by": [("total_handled", "desc"), ("rep", "asc")]},
        "rate_by_priority": {"metrics": ["pct urgent"], "dimensions": ["severity"], "order_by": [("urgent_rate", "desc"), ("priority", "asc")]},
        "daily_trend": {"dimensions": ["metric_date"], "facts": ["day_cases", "day_avg_amount"], "order_by": [("metric_date", "asc")]},
    },
)


def layer_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    daily = orders.groupBy(F.col("o_orderdate").cast("date").alias("metric_date")).agg(
        F.count(F.lit(1)).alias("day_cases"),
        F.count_if(F.col("o_orderstatus") == "F").alias("day_resolved"),
        round_half(F.avg("o_totalprice"), 4).alias("day_avg_amount"),
    )
    reps = lines.groupBy("l_suppkey", F.date_trunc("week", F.col("l_shipdate")).cast("date").alias("week_start")).agg(
        F.sum("l_quantity").alias("handled"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("returned"),
        round_half(F.avg("l_discount"), 6).alias("avg_discount"),
        round_half(F.avg("l_tax"), 6).alias("avg_tax"),
        round_half(F.avg((F.col("l_linestatus") == "O").cast("int")), 6).alias("late_rate"),
    )
    return {"cases": orders, "daily": daily, "reps": reps}


def _as_double(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("double"))
    return df


def _verified(name: str, *doubles: str) -> Query:
    return lambda spark, sf_dir: _as_double(verified_query(ORDER_LAYER, layer_frames(spark, sf_dir), name), *doubles)


def _ml(*doubles: str, **arguments) -> Query:
    return lambda spark, sf_dir: _as_double(metric_query(ORDER_LAYER, layer_frames(spark, sf_dir), **arguments), *doubles)


def _ml_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return with_example(orders, ["o_orderpriority"], round_half(F.avg("o_totalprice"), 4).alias("avg_amount"), "o_orderkey", "o_orderdate")


# --- search, scoring -------------------------------------------------------------------------


SHOWN = ("lang", "source", "quality")


def _search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_corpus(spark, sf_dir), table(spark, sf_dir, "benchmark"), text="corpus_text", attributes=SHOWN)


def _search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir).filter((F.col("lang") == "en") & (F.col("n_chars") >= 200))
    return search.search(corpus, table(spark, sf_dir, "benchmark"), k=5, text="corpus_text", attributes=SHOWN)


def _search_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir).withColumn("text_md5", F.md5("corpus_text"))
    return search.group_hits(search.search(corpus, table(spark, sf_dir, "benchmark"), k=20, text="corpus_text", attributes=("text_md5",)), "text_md5")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def _groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_groundedness(_turns(spark, sf_dir))


def _correctness_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    truths = tables.eval_inputs(_eval_data(spark, sf_dir)).select(F.col("input_query").alias("user_query"), "ground_truth_string")
    responses = rep.ev.roots(spans(spark, sf_dir)).select("record_id", "agent_name", "run_name", "user_query", "agent_output", "end_ts")
    return scoring.score_correctness(responses, truths, "user_query", "agent_output", "ground_truth_string")


def _correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _correctness_rows(spark, sf_dir).select("record_id", "agent_name", "user_query", "score", range_band(F.col("score")).alias("band"))


def _range_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        rep.ev.scored(spans(spark, sf_dir, wanted=Wanted({"span_type": ("eval_root",)})))
        .groupBy("agent_name", "metric", range_band(F.col("score")).alias("band"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _to_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _correctness_rows(spark, sf_dir)
    events = scoring.to_event_rows(rows, F.col("agent_name"), F.col("run_name"), F.lit("token_f1"), F.col("record_id"), F.col("score"), F.col("end_ts"))
    # Read the written form back the way any report does.
    return extract_spans(events).select("record_type", "agent_name", "run_name", "span_type", "metric", "target_record_id", "score", "has_score")


def shared_letters(statement: Column, source: Column) -> Column:
    """Share of the distinct letters of a statement that the source has."""
    letters = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"\p{L}"), F.lit(0)))
    own = letters(statement)
    return F.coalesce(F.size(F.array_intersect(own, letters(source))) / F.nullif(F.size(own), F.lit(0)).cast("double"), F.lit(0.0))


def _custom_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user-supplied scorer over response sentences and the text of their question."""
    roots = rep.ev.roots(spans(spark, sf_dir)).select("record_id", "agent_name", "agent_output", "user_query")
    return scoring.score_responses(roots, "agent_output", "user_query", ("record_id", "agent_name"), shared_letters, 0.5, check_numbers=False)


def _letter_model(model: dict, statements: list, sources: list) -> list:
    """The same share as ``shared_letters``, as a model would give it: batch in, numbers out."""
    found = []
    for statement, source in zip(statements, sources):
        own = {c for c in (statement or "").lower() if model["is_letter"](c)}
        found.append(len(own & set((source or "").lower())) / len(own) if own else 0.0)
    return found


def _model_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The custom metric with a scorer that loads a model in every worker."""
    roots = rep.ev.roots(spans(spark, sf_dir)).select("record_id", "agent_name", "agent_output", "user_query")
    scorer = model_scorers.model_scorer(lambda: {"is_letter": str.isalpha}, _letter_model)
    return scoring.score_responses(roots, "agent_output", "user_query", ("record_id", "agent_name"), scorer, 0.5, check_numbers=False)


def _ranking_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings.ranking_orders(_turns(spark, sf_dir), items=rankings.sentence_openers)


def _range_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct latencies and percentiles per agent over a range of days, from daily sketches, beside the exact
    count, with whether each estimate keeps its stated error."""
    requests = rep.ev.roots(spans(spark, sf_dir))
    path = f"{scratch_dir(spark)}/sketches-{uuid.uuid4().hex}"
    sketches.write_sketches(sketches.daily_sketches(requests), path)
    span = requests.agg(F.to_date(F.min("start_ts")).alias("low"), F.to_date(F.max("start_ts")).alias("high")).first()
    first, last = F.date_add(F.lit(span.low), 1), F.date_add(F.lit(span.high), -1)
    some = sketches.merged(sketches.read_sketches(spark, path), first, last)
    guessed = sketches.estimates(some, {"p50": 0.5, "p95": 0.95})
    exact = requests.filter(F.to_date("start_ts").between(first, last)).groupBy("agent_name").agg(F.count(F.lit(1)).alias("n_exact"), F.countDistinct("duration_ms").alias("exact_distinct"))
    both = guessed.join(exact, "agent_name")
    places = requests.filter(F.to_date("start_ts").between(first, last)).join(both, "agent_name").groupBy("agent_name").agg(
        *[F.avg((F.col("duration_ms") < F.col(p)).cast("int")).alias(f"{p}_below") for p in ("p50", "p95")],
        *[F.avg((F.col("duration_ms") <= F.col(p)).cast("int")).alias(f"{p}_upto") for p in ("p50", "p95")],
    )

    def keeps(name: str, share: float) -> Column:
        return (F.col(f"{name}_below") <= share + sketches.RANK_ERROR) & (F.col(f"{name}_upto") >= share - sketches.RANK_ERROR)

    limit = round(sketches.distinct_error(), 4)
    return both.join(places, "agent_name").select(
        "agent_name",
        F.col("n_rows"),
        "exact_distinct",
        F.lit(limit).alias("distinct_error"),
        (F.abs(F.col("n_distinct") - F.col("exact_distinct")) <= limit * F.col("exact_distinct")).alias("distinct_holds"),
        keeps("p50", 0.5).alias("p50_holds"),
        keeps("p95", 0.95).alias("p95_holds"),
    )


def _stream_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event files written once, then read as a stream up to their end: the finished windows."""
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    trace_events(table(spark, sf_dir, "events")).write.parquet(f"{base}/events")
    latency.run_to_end(latency.windows(latency.event_stream(spark, f"{base}/events"), "6 hours", "1 hour"), f"{base}/windows", f"{base}/state")
    found = spark.read.schema(latency.WINDOW_SCHEMA).parquet(f"{base}/windows")
    return found.select(F.unix_seconds("window_start").alias("window_start_s"), "agent_name", "n_requests", "sum_ms", "max_ms")


def _trace_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.trace_documents(spans(spark, sf_dir))


def _trace_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents in parts of three steps, as a very long trace would be cut."""
    return scoring.trace_documents(spans(spark, sf_dir), steps_per_part=3)


def _trace_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the steps of a trace that show any text."""

    def measure(document: Column) -> dict[str, Column]:
        steps = F.filter(F.split(document, "\n"), lambda x: x.rlike(r"^\[[0-9]+\] "))
        return {"n_shown": F.size(F.filter(steps, lambda x: x.contains(" | "))).cast("bigint"), "n_steps": F.size(steps).cast("bigint")}

    return scoring.score_documents(_trace_documents(spark, sf_dir), measure, lambda s: s["n_shown"] / s["n_steps"].cast("double"))


def _root_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rep.root_input_tokens(spans(spark, sf_dir, wanted=REQUESTS_OF_B)).select("input_tokens", "record_id", "trace_id", "user_query", "agent_output", "call_return", "duration_ms")


MONTH = [Condition("day", "between", ("1998-01-01", "1998-01-31"))]

QUERIES: dict[str, Query] = {
    "r13_win_loss_tie": _on_spans(rep.win_loss_tie, wanted=ANSWERS, columns=ANSWER_COLUMNS),
    "extract_spans": _extract,
    "extract_spans_native": _extract_native,
    "r08_native_objects": _buckets_native,
    "src_agent_events": _src_agent,
    "src_all_events": _src_all,
    "src_events_of_run": _src_run,
    "src_eval_run_latest": _src_eval_run_latest,
    "src_logs_by_severity": _src_logs,
    "src_logs_of_run": _src_logs_all,
    "src_record_lookup": _src_record,
    "src_recent_failures": _job_query(50, True),
    "src_recent_jobs": _job_query(100, False),
    "src_dataset_head": _src_dataset_head,
    "eval_dataset": _eval_dataset,
    "eval_inputs": _eval_inputs,
    "search_corpus": _search_corpus,
    "try_casts": _try_casts,
    "order_abs_diff": _order_abs_diff,
    "first_20": _first_20,
    "r01_scorecard": _on_spans(rep.scorecard),
    "r02_score_distribution": _on_spans(rep.score_distribution),
    "r03_latency_percentiles": _on_spans(rep.latency_percentiles),
    "r04_span_breakdown": _on_spans(rep.span_breakdown, once=True, columns=("record_type", "agent_name", "span_type", "duration_ms")),
    "r05_tool_breakdown": _on_spans(rep.tool_breakdown, wanted=TOOLS_OF_A),
    "r06_agent_span_totals": _on_spans(rep.agent_span_totals, wanted=TOTALS_OF_B),
    "r06b_root_input_tokens": _root_tokens,
    "r07_side_by_side": _on_spans(pairs.response_statistics),
    "r07_widest_pairs": _on_spans(pairs.widest_pairs, top=100),
    "r07b_pair_averages": _on_spans(pairs.pair_averages),
    "r08_score_buckets": _on_spans(rep.score_buckets, wanted=SCORES),
    "r09_run_comparison": _on_spans(rep.run_comparison, wanted=SCORES_OF_B),
    "r10_exec_summary": _on_spans(rep.exec_summary),
    "r11_metric_comparison": _on_spans(rep.metric_comparison, wanted=SCORES),
    "r12_query_delta": _on_spans(rep.query_delta, wanted=ANSWERS, columns=ANSWER_COLUMNS),
    "sql_agent_events": _sql(f"SELECT {', '.join(SPAN_TEXT)}, duration_ms FROM traces_agent_events('{{a}}', 'NATIVE AGENT')", Wanted({"agent_name": (PAIR.a,)})),
    "sql_events_of_run": _sql(f"SELECT {', '.join(SPAN_TEXT)}, duration_ms FROM traces_run_events('{{run}}')", OF_RUN),
    "sql_record_lookup": _sql(f"SELECT planning_output AS planning, {', '.join(SPAN_TEXT)}, duration_ms, tokens_total, score FROM traces_record_events('{{record}}')", OF_RECORD),
    "sql_logs": _sql("SELECT trace_id, severity, run_name, record_id FROM traces_logs('{a}', 'RUN_2', levels => 'ERROR, WARN')", _logs_of(PAIR.a)),
    "sql_eval_run_latest": _sql("SELECT * FROM traces_eval_run('{b}', '{run}')", EVAL_RUN),
    "sql_scorecard": _sql("SELECT * FROM traces_scorecard('{a}', '{b}')"),
    "sql_latency_percentiles": _sql("SELECT * FROM traces_latency_percentiles('{a}', '{b}')"),
    "sql_span_totals": _sql("SELECT * FROM traces_span_totals('{b}')", TOTALS_OF_B),
    "sql_tool_breakdown": _sql("SELECT * FROM traces_tool_breakdown('{a}')", TOOLS_OF_A),
    "sql_score_buckets": _sql("SELECT * FROM traces_score_buckets('{a}', '{b}')", SCORES),
    "sql_run_comparison": _sql("SELECT * FROM traces_run_comparison('{b}')", SCORES_OF_B),
    "sql_metric_comparison": _sql("SELECT * FROM traces_metric_comparison('{a}', '{b}')", SCORES),
    "sql_query_delta": _sql("SELECT * FROM traces_query_delta('{a}', '{b}')", ANSWERS, ANSWER_COLUMNS),
    "sql_win_loss_tie": _sql("SELECT * FROM traces_win_loss_tie('{a}', '{b}')", ANSWERS, ANSWER_COLUMNS),
    "d01_exec_with_traces": _on_spans(dash.exec_with_traces),
    "d02_scorecard_short": _on_spans(dash.scorecard_short),
    "d03_per_query_wide": _on_spans(dash.per_query_wide),
    "d03_scores_from_text": lambda spark, sf_dir: dash.per_query_from_text(dash.exec_with_traces(spans(spark, sf_dir))),
    "d04_metric_detail": _on_spans(dash.metric_detail),
    "d05_bucket_facets": _on_spans(dash.bucket_facets, wanted=SCORES),
    "d06_root_latency": _on_spans(dash.root_latency, wanted=REQUESTS),
    "d06_latency_box": _on_spans(dash.latency_box),
    "d07_query_latency_mean": _on_spans(dash.query_latency_mean, wanted=REQUESTS),
    "d08_span_breakdown_exec": _on_spans(dash.span_breakdown_exec, once=True),
    "d09_tool_durations": _on_spans(dash.tool_durations, wanted=TOOLS_OF_A),
    "d10_trace_timeline_a": _on_spans(dash.timeline_a),
    "d10_trace_of_question": _trace_latest_question,
    "d11_trace_timeline_b": _on_spans(dash.timeline_b),
    "ml_cases_by_category": _verified("cases_by_category"),
    "ml_avg_by_category": _verified("avg_by_category", "avg_amount"),
    "ml_top_reps": _verified("top_reps"),
    "ml_rate_by_priority": _verified("rate_by_priority", "urgent_rate"),
    "ml_daily_trend": _verified("daily_trend"),
    "ml_resolution_rate": _ml("resolution_rate", metrics=["return rate"], dimensions=["support rep"], order_by=[("resolution_rate", "desc"), ("rep", "asc")]),
    "ml_busiest_day": _ml(metrics=["total daily cases"], dimensions=["day"], order_by=[("sum_daily_cases", "desc"), ("metric_date", "asc")], limit=1),
    "ml_month_total": _ml(metrics=["sum_daily_cases"], filters=MONTH),
    "ml_metric_with_example": _ml_example,
    "ml_case_metrics": _ml(
        "avg_amount",
        "urgent_rate",
        "avg_urgent_amount",
        metrics=["number of cases", "avg_amount", "max_amount", "pct urgent", "avg_urgent_amount"],
        dimensions=["category", "opened date"],
        time_grain="quarter",
        filters=[Condition("issue type", "in", ("F", "O")), Condition("amount", ">", 1000.0)],
    ),
    "ml_daily_metrics": _ml(
        "daily_avg_amount",
        metrics=["sum_daily_cases", "sum_daily_resolved", "daily_avg_amount", "daily_max_amount"],
        dimensions=["metric_date"],
        time_grain="month",
    ),
    "ml_rep_metrics": _ml(
        "rep_avg_discount",
        "rep_avg_tax",
        "rep_avg_late_rate",
        metrics=["total rep cases", "total_returned", "rep_avg_discount", "rep_avg_tax", "rep_avg_late_rate"],
        dimensions=["rep"],
    ),
    "search_topk": _search_topk,
    "search_topk_filtered": _search_filtered,
    "search_grouped": _search_grouped,
    "score_groundedness": _groundedness,
    "score_correctness": _correctness,
    "score_range_band": _range_band,
    "score_custom_metric": _custom_metric,
    "score_with_model": _model_metric,
    "score_ranking_order": _ranking_orders,
    "range_sketches": _range_sketches,
    "stream_latency": _stream_latency,
    "score_to_events": _to_events,
    "trace_documents": _trace_documents,
    "trace_document_parts": _trace_parts,
    "trace_scores": _trace_scores,
}
