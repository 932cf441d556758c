"""SQL for an independent engine, one statement per registered query that plain SQL can express.

The statements are written against the raw tables and follow the definitions of the reports, not the
way the Spark plans compute them: joins are done in full before aggregation, percentiles come from
the engine's own functions, and search scores every document.
"""

from __future__ import annotations

from tracegauge.operators import search
from tracegauge.sources import trace_view

EVENTS = f"""
src AS (SELECT *, unnest(range({trace_view.ROWS_PER_TRACE})) AS n FROM events),
core AS (SELECT {", ".join(trace_view.CORE)} FROM src),
flat AS (SELECT *, {", ".join(trace_view.FLAT)} FROM core),
trace_events AS (SELECT {", ".join(trace_view.ROW)} FROM flat)"""


def _text(name: str) -> str:
    return f"""json_extract_string(record_attributes, '$."{name}"')"""


def _whole(name: str) -> str:
    return f"CAST({_text(name)} AS BIGINT)"


def _present(name: str) -> str:
    return f"""(json_extract(record_attributes, '$."{name}"') IS NOT NULL)"""


SPANS = f"""
{EVENTS},
spans AS MATERIALIZED (SELECT
  record_type,
  t0 + n * INTERVAL 1 MILLISECOND AS start_ts,
  t0 + (n + dur_ms) * INTERVAL 1 MILLISECOND AS end_ts,
  date_diff('millisecond', t0 + n * INTERVAL 1 MILLISECOND, t0 + (n + dur_ms) * INTERVAL 1 MILLISECOND) AS duration_ms,
  json_extract_string(trace, '$.trace_id') AS trace_id,
  json_extract_string(record, '$.severity_text') AS severity,
  {_text("obs.agent.name")} AS agent_name,
  {_text("obs.agent.type")} AS agent_type,
  {_text("obs.span_type")} AS span_type,
  {_text("obs.record_id")} AS record_id,
  {_text("obs.root.input")} AS user_query,
  {_text("obs.root.output")} AS agent_output,
  {_text("obs.eval.metric_name")} AS metric,
  CAST({_text("obs.eval.score")} AS DOUBLE) AS score,
  {_text("obs.eval.target_record_id")} AS target_record_id,
  coalesce({_text("obs.run.name")}, {_text("obs.legacy.run.name")}) AS run_name,
  {_text("obs.call.return")} AS call_return,
  {_text("obs.call.function")} AS call_function,
  {_text("obs.retrieval.query_text")} AS retrieval_query,
  {_whole("obs.agent.duration")} AS orchestration_ms,
  {_text("obs.tool.search.name")} AS search_name,
  {_whole("obs.tool.search.duration")} AS search_ms,
  {_text("obs.tool.search.query")} AS search_query,
  {_text("obs.tool.search.status")} AS search_status,
  {_text("obs.tool.analyst.model")} AS analyst_model,
  {_whole("obs.tool.analyst.duration")} AS analyst_ms,
  {_text("obs.tool.analyst.sql_query")} AS analyst_sql,
  {_whole("obs.tokens.input")} AS tokens_in,
  {_whole("obs.tokens.output")} AS tokens_out,
  {_whole("obs.tokens.total")} AS tokens_total,
  {_text("obs.planning.response")} AS planning_output,
  {_present("obs.eval.score")} AS has_score,
  {_present("obs.tool.search.name")} AS has_search,
  {_present("obs.tool.analyst.model")} AS has_analyst,
  {_present("obs.agent.duration")} AS has_orchestration
FROM trace_events)"""


def on_spans(body: str) -> str:
    """``body`` may start with further CTEs (``x AS (...), ... SELECT``) or with SELECT."""
    body = body.strip()
    return f"WITH {SPANS}{' ' if body.upper().startswith('SELECT') else ', '}{body}"


def r(expr: str, digits: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(28,9)), {digits}) AS DOUBLE)"


def pct(value: str, base: str) -> str:
    return r(f"(({value}) - ({base})) / nullif(CAST({base} AS DOUBLE), 0) * 100", 1)


SCORED = "span_type = 'eval_root' AND has_score"
ROOT = "span_type = 'record_root'"
CANONICAL = "CASE WHEN metric = 'answer_correctness' THEN 'correctness' ELSE metric END"
REPLACED = "replace(metric, 'answer_correctness', 'correctness')"
LABEL = "CASE agent_name WHEN 'AGENT_A' THEN 'Agent A' WHEN 'AGENT_B' THEN 'Agent B' END"
SPAN_TEXT = "record_type, trace_id, agent_name, span_type, record_id, metric, run_name, severity"


def verdict(a: str, b: str, names: tuple[str, str] = ("A", "B")) -> str:
    return f"CASE WHEN {a} - {b} > 1e-12 THEN '{names[0]}' WHEN {a} - {b} < -1e-12 THEN '{names[1]}' ELSE 'TIE' END"


def buckets(labels: tuple[str, ...]) -> str:
    p, h, m, lo, poor = labels
    return (
        f"CASE WHEN score = 1.0 THEN '{p}' WHEN score >= 0.8 THEN '{h}' WHEN score >= 0.6 THEN '{m}' "
        f"WHEN score >= 0.4 THEN '{lo}' ELSE '{poor}' END"
    )


def band(score: str) -> str:
    s = r(score, 2)
    return f"CASE WHEN {s} BETWEEN 0 AND 0.33 THEN 'min' WHEN {s} BETWEEN 0.34 AND 0.66 THEN 'median' WHEN {s} BETWEEN 0.67 AND 1 THEN 'max' END"


def scorecard(digits: int) -> str:
    """Per-side aggregates; the full pairing of scores and latencies is checked in the tests."""
    return f"""
e AS (SELECT agent_name, count(DISTINCT metric) AS m, avg(score) AS a, min(score) AS mi FROM spans WHERE {SCORED} GROUP BY 1),
l AS (SELECT agent_name, count(DISTINCT duration_ms) AS d, count(*) AS n, avg(duration_ms) AS a, median(duration_ms) AS md, max(duration_ms) AS mx
      FROM spans WHERE {ROOT} GROUP BY 1),
card AS (SELECT coalesce(e.agent_name, l.agent_name) AS agent_name, coalesce(e.m, 0) AS num_eval_metrics,
  {r("e.a", digits)} AS avg_eval_score, {r("e.mi", digits)} AS min_eval_score, coalesce(l.d, 0) AS num_invocations, coalesce(l.n, 0) AS num_requests,
  {r("l.a", 0)} AS avg_latency_ms, {r("l.md", 0)} AS median_latency_ms, {r("l.mx", 0)} AS max_latency_ms
  FROM e FULL OUTER JOIN l ON e.agent_name = l.agent_name)"""


# Token sums of each record, then one row per response: agent A from attributes, agent B from its call logs.
def _responses(side: str, usage: str) -> str:
    agent = f"AGENT_{side.upper()}"
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {t}" for c, t in (("i", "prompt_tokens"), ("o", "completion_tokens"), ("t", "total_tokens")))
    return f"""
{side}_usage AS ({usage}),
{side}_sums AS (SELECT record_id, {sums} FROM {side}_usage GROUP BY record_id),
{side} AS (SELECT user_query, spans.record_id, agent_output, duration_ms, end_ts, prompt_tokens, completion_tokens, total_tokens
  FROM spans LEFT JOIN {side}_sums ON {side}_sums.record_id = spans.record_id WHERE {ROOT} AND agent_name = '{agent}')"""


_literal = "translate(unnest(regexp_extract_all(call_return, 'usage_metadata=(\\{[^}]+\\})', 1)), chr(39), chr(34))"
_counts = ", ".join(f"CAST(json_extract_string(j, '$.{k}_tokens') AS BIGINT) AS {c}" for k, c in (("input", "i"), ("output", "o"), ("total", "t")))
USAGE_B = ",".join(
    [
        _responses("a", "SELECT record_id, tokens_in AS i, tokens_out AS o, tokens_total AS t FROM spans WHERE agent_name = 'AGENT_A'"),
        _responses(
            "b",
            f"""SELECT record_id, {_counts} FROM (SELECT record_id, TRY_CAST(replace(lit, 'True', 'true') AS JSON) AS j FROM
  (SELECT record_id, {_literal} AS lit FROM spans WHERE agent_name = 'AGENT_B' AND span_type = 'graph_node'))""",
        ),
    ]
)

TOKENS = ("prompt_tokens", "completion_tokens", "total_tokens")

SIDE_BY_SIDE = (
    USAGE_B
    + ","
    + ",".join(
        f"""
{s}q AS (SELECT user_query, left(arg_max(agent_output, (end_ts, record_id)), 200) AS p, count(*) AS n, avg(duration_ms) AS lat,
  {", ".join(f"avg({t}) AS {t}" for t in TOKENS)} FROM {s} WHERE user_query IS NOT NULL GROUP BY 1)"""
        for s in "ab"
    )
    + f""",
sides AS (SELECT aq.user_query, aq.p AS a_response_preview, bq.p AS b_response_preview, aq.n AS a_responses, bq.n AS b_responses, aq.n * bq.n AS pairs,
  {r("aq.lat", 1)} AS a_latency_ms, {r("bq.lat", 1)} AS b_latency_ms, {r("aq.lat - bq.lat", 1)} AS latency_diff_ms, {pct("aq.lat", "bq.lat")} AS latency_diff_pct,
  {", ".join(f"{r(f'{s}q.{t}', 2)} AS {s}_{t}" for s in "ab" for t in TOKENS)},
  {r("aq.total_tokens - bq.total_tokens", 2)} AS token_diff, {pct("aq.total_tokens", "bq.total_tokens")} AS token_diff_pct
  FROM aq JOIN bq ON aq.user_query = bq.user_query)"""
)


def summary(metric: str) -> str:
    """One row per question in ``sheet``: answers by arg_max, scores from the join of all evaluation rows,
    both agents side by side through filtered aggregates."""
    sides = ", ".join(
        f"max(x.{c}) FILTER (x.agent_name = '{agent}') AS {s}_{c}"
        for s, agent in (("a", "AGENT_A"), ("b", "AGENT_B"))
        for c in ("output", "latency_ms", "scores", "trace_id")
    )
    return f"""
answers AS (SELECT agent_name, user_query, arg_max(struct_pack(o := agent_output, t := trace_id), (end_ts, record_id)) AS newest, avg(duration_ms) AS ms
  FROM spans WHERE {ROOT} GROUP BY ALL),
marks AS (SELECT q.agent_name, q.user_query, {metric} AS name, CAST(round(CAST(avg(CAST(round(CAST(e.score AS DECIMAL(28,9)), 2) AS DECIMAL(5,2))) AS DECIMAL(28,9)), 2) AS DECIMAL(5,2)) AS mark
  FROM (SELECT * FROM spans WHERE {SCORED}) e JOIN (SELECT agent_name, record_id, user_query FROM spans WHERE {ROOT}) q
  ON e.agent_name = q.agent_name AND e.target_record_id = q.record_id GROUP BY ALL),
printed AS (SELECT agent_name, user_query, chr(123) || string_agg(chr(34) || name || chr(34) || ':' || CAST(mark AS VARCHAR), ',' ORDER BY name) || chr(125) AS scores
  FROM marks GROUP BY ALL),
x AS (SELECT answers.agent_name, answers.user_query, newest.o AS output, newest.t AS trace_id, {r("ms", 0)} AS latency_ms, printed.scores
  FROM answers LEFT JOIN printed USING (agent_name, user_query)),
sheet AS (SELECT x.user_query, {sides} FROM x GROUP BY 1 HAVING count(x.scores) > 0)"""


DELTAS = f"""
sides AS (SELECT q.user_query, {CANONICAL} AS metric, avg(e.score) FILTER (q.agent_name = 'AGENT_A') AS sa, avg(e.score) FILTER (q.agent_name = 'AGENT_B') AS sb
  FROM (SELECT * FROM spans WHERE {SCORED}) e JOIN (SELECT agent_name, record_id, user_query FROM spans WHERE {ROOT}) q
  ON e.agent_name = q.agent_name AND e.target_record_id = q.record_id GROUP BY ALL
  HAVING count(e.score) FILTER (q.agent_name = 'AGENT_A') > 0 AND count(e.score) FILTER (q.agent_name = 'AGENT_B') > 0),
delta AS (SELECT user_query, metric, {r("sa", 3)} AS a_score, {r("sb", 3)} AS b_score, {r("sa - sb", 3)} AS delta, {verdict("sa", "sb")} AS winner FROM sides)"""

EVAL_DATA = f"""
eval_data AS (SELECT user_query AS input_query, arg_min(agent_output, (end_ts, record_id)) AS truth
  FROM spans WHERE {ROOT} AND user_query IS NOT NULL GROUP BY 1)"""
TRUTH_JSON = "chr(123) || '\"ground_truth_output\":\"' || truth || '\"' || chr(125)"

WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"

CORRECTNESS = (
    EVAL_DATA
    + f""",
w AS (SELECT s.record_id, s.agent_name, s.run_name, s.user_query, list_distinct({WORDS.format("s.agent_output")}) AS x, list_distinct({WORDS.format("d.truth")}) AS y
  FROM spans s LEFT JOIN eval_data d ON s.user_query = d.input_query WHERE s.{ROOT}),
f1 AS (SELECT record_id, agent_name, run_name, user_query, {r("CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN len(x) + len(y) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) END", 4)} AS score FROM w)"""
)


CORPUS = """SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, d.text || ' Resolution: ' || coalesce('quality ' || CAST(l.quality AS VARCHAR), '') AS corpus_text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def bm25(where: str, k: int) -> str:
    """Exhaustive scoring: every query against every document that shares a word with it."""
    return f"""
corpus AS ({CORPUS}),
docs AS MATERIALIZED (SELECT *, {WORDS.format("corpus_text")} AS ws FROM corpus WHERE {where}),
size AS (SELECT count(*) AS n, avg(len(ws)) AS avg_words FROM docs),
tokens AS (SELECT doc_id, len(ws) AS n_words, unnest(ws) AS term FROM docs),
postings AS (SELECT doc_id, n_words, term, count(*) AS tf FROM tokens GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
asked AS (SELECT item_id AS query_id, unnest(list_distinct({WORDS.format("text")})) AS term FROM benchmark),
scored AS (SELECT a.query_id, p.doc_id,
  {r(f"sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * (p.tf * ({search.K1} + 1) / (p.tf + {search.K1} * ({1 - search.B} + {search.B} * p.n_words / s.avg_words))))", search.SCORE_DIGITS)} AS score
  FROM asked a JOIN postings p ON a.term = p.term JOIN df d ON d.term = p.term, size s GROUP BY 1, 2),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {k})"""


LETTERS = "regexp_extract_all(lower({0}), '\\p{{L}}+')"
# A number as sign and digits, thousands separators left out; a hyphen behind a letter or digit is no sign.
NUMBERS = "regexp_extract_all(regexp_replace(replace({0}, '−', '-'), '([\\p{{L}}\\p{{N}}])-', '\\1 ', 'g'), '[-+]?(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?:\\.[0-9]+)?')"
_size = "CAST(replace(ltrim({0}, '+-'), ',', '') AS DECIMAL(38,12))"
_places = "length(rtrim(split_part({0}, '.', 2), '0'))"
# Phrases that admit a gap in the data.
_gaps = ["i don't have", "i do not have", "i don't know", "i do not know", "i cannot find", "i can't find", "no data available", "not enough information"]
_abstain = " OR ".join(f"contains(replace(lower(sentence), '’', chr(39)), {chr(39) + a.replace(chr(39), chr(39) * 2) + chr(39)})" for a in _gaps)

# Each response sentence is compared with all earlier turns of its conversation.
GROUNDED = f"""
WITH said AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10))) AS raw, generate_subscripts(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), 1) AS pos
  FROM conversations WHERE role = 'assistant'),
sents AS (SELECT conv_id, turn, pos, trim(raw) AS sentence FROM said WHERE length(trim(raw)) > 0),
src AS (SELECT * FROM conversations WHERE role IS DISTINCT FROM 'assistant'),
src_words AS (SELECT DISTINCT conv_id, turn, unnest({LETTERS.format("text")}) AS w FROM src),
src_raw AS (SELECT conv_id, turn, unnest({NUMBERS.format("text")}) AS x FROM src),
src_nums AS (SELECT DISTINCT conv_id, turn, {_size.format("x")} AS v, x LIKE '-%' AS neg, {_places.format("x")} AS places FROM src_raw),
ws AS (SELECT conv_id, turn, pos, unnest(list_distinct({LETTERS.format("sentence")})) AS w FROM sents),
ns_raw AS (SELECT conv_id, turn, pos, unnest({NUMBERS.format("sentence")}) AS x FROM sents),
ns AS (SELECT DISTINCT conv_id, turn, pos, {_size.format("x")} AS v, x LIKE '-%' AS neg, {_places.format("x")} AS places FROM ns_raw),
wc AS (SELECT conv_id, turn, pos, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM src_words s WHERE s.conv_id = ws.conv_id AND s.turn < ws.turn AND s.w = ws.w)) AS hit FROM ws GROUP BY 1, 2, 3),
nc AS (SELECT conv_id, turn, pos, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM src_nums s WHERE s.conv_id = ns.conv_id AND s.turn < ns.turn AND (ns.v = 0 OR s.neg = ns.neg)
    AND (s.v = ns.v OR (ns.places < s.places AND s.v >= ns.v - CAST('0.' || repeat('0', ns.places) || '5' AS DECIMAL(38,12)) AND s.v < ns.v + CAST('0.' || repeat('0', ns.places) || '5' AS DECIMAL(38,12)))))) AS hit FROM ns GROUP BY 1, 2, 3),
judged AS (SELECT t.conv_id, t.turn, t.pos, CASE WHEN {_abstain} THEN 1 WHEN rtrim(sentence) LIKE '%?' THEN 0
    WHEN coalesce(wc.n, 0) + coalesce(nc.n, 0) > 0 AND coalesce(wc.hit, 0) >= 0.6 * coalesce(wc.n, 0) AND coalesce(nc.hit, 0) = coalesce(nc.n, 0) THEN 1 ELSE 0 END AS supported
  FROM sents t LEFT JOIN wc ON wc.conv_id = t.conv_id AND wc.turn = t.turn AND wc.pos = t.pos LEFT JOIN nc ON nc.conv_id = t.conv_id AND nc.turn = t.turn AND nc.pos = t.pos),
totals AS (SELECT conv_id, turn, count(*) AS n_sentences, CAST(sum(supported) AS BIGINT) AS n_supported FROM judged GROUP BY 1, 2),
asked AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'assistant'),
final AS (SELECT asked.conv_id, asked.turn, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_supported, 0) AS n_supported, {r("n_supported / CAST(n_sentences AS DOUBLE)", 4)} AS score
  FROM asked LEFT JOIN totals ON totals.conv_id = asked.conv_id AND totals.turn = asked.turn)
SELECT conv_id, turn, n_sentences, n_supported, score, {band("score")} AS band FROM final"""


# Metric layer ---------------------------------------------------------------------------------

DAILY = f"""daily AS (SELECT CAST(o_orderdate AS DATE) AS metric_date, count(*) AS day_cases, count(*) FILTER (o_orderstatus = 'F') AS day_resolved,
  {r("avg(o_totalprice)", 4)} AS day_avg_amount FROM orders GROUP BY 1)"""
REPS = f"""reps AS (SELECT l_suppkey AS rep, CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start, sum(l_quantity) AS handled,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS returned, {r("avg(l_discount)", 6)} AS avg_discount, {r("avg(l_tax)", 6)} AS avg_tax,
  {r("avg(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)", 6)} AS late_rate FROM lineitem GROUP BY 1, 2)"""

URGENT = "avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)"
LONG_ENGLISH = "lang = 'en' AND n_chars >= 200"

JOBS = """jobs AS (SELECT event_id AS job_id, CASE user_id % 3 WHEN 0 THEN 'AI_Evaluation_task' WHEN 1 THEN 'nightly_EVAL' ELSE 'load_job' END AS name,
  CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END AS state,
  CASE WHEN event_type = 'error' THEN regexp_extract(props, '[0-9]+', 0) END AS error_code,
  CASE WHEN event_type = 'error' THEN 'failed after ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS error_message,
  props AS query_text, ts, CASE WHEN event_id % 11 <> 0 THEN ts + CAST(round(value * 100) AS INTEGER) * INTERVAL 1 MILLISECOND END AS done FROM events)"""


def jobs(cap: int, extra: str) -> str:
    return f"""WITH {JOBS}, newest AS (SELECT * FROM jobs WHERE ts >= (SELECT max(ts) FROM jobs) - INTERVAL 7 DAYS {extra} ORDER BY ts DESC, job_id LIMIT {cap})
SELECT name, state, error_code, error_message, query_text, epoch_us(ts) AS scheduled_us, epoch_us(done) AS completed_us, job_id FROM newest WHERE name ILIKE '%ai_evaluation%' OR name ILIKE '%eval%'"""


# Trace order ----------------------------------------------------------------------------------

PLACED = """
steps AS (SELECT trace_id, agent_name, coalesce(span_type, call_function, 'step') AS step,
  user_query, search_query, analyst_sql, retrieval_query, planning_output, call_return, agent_output,
  row_number() OVER (PARTITION BY trace_id ORDER BY start_ts) AS position FROM spans WHERE record_type = 'SPAN' AND trace_id IS NOT NULL),
lines AS (SELECT *, concat_ws(' | ', '[' || position || '] ' || step, """ + ", ".join(
    f"CASE WHEN {c} <> '' THEN '{c}: ' || {c} END" for c in ("user_query", "search_query", "analyst_sql", "retrieval_query", "planning_output", "call_return", "agent_output")
) + """) AS line FROM steps)"""


def documents(steps: int) -> str:
    return f"""SELECT trace_id, CAST(floor((position - 1) / {steps}) AS BIGINT) AS part, CAST(0 AS BIGINT) AS piece, max(agent_name) AS agent_name, count(*) AS n_steps,
  string_agg(line, chr(10) ORDER BY position) AS document FROM lines GROUP BY 1, 2"""


DETAIL_A = "coalesce(nullif(search_query, ''), nullif(analyst_sql, ''), '')"
TIMELINE_A = f"""SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY start_ts) AS step_no,
  coalesce(search_name, analyst_model, span_type, 'orchestration') AS step, search_query, analyst_sql, search_status AS status, duration_ms,
  CASE WHEN length({DETAIL_A}) > 120 THEN left({DETAIL_A}, 120) || '...' ELSE {DETAIL_A} END AS detail_preview,
  CASE WHEN upper({DETAIL_A}) LIKE '%SELECT%' THEN 'sql' ELSE 'text' END AS detail_language
  FROM spans WHERE agent_name = 'AGENT_A' AND record_type = 'SPAN'"""

TOOL = f"""SELECT 'AGENT_A' AS agent_name, CASE WHEN has_search THEN 'search' WHEN has_analyst THEN 'analyst' WHEN has_orchestration THEN 'orchestration' END AS tool_type,
  count(*) AS invocations, {r("avg(coalesce(search_ms, analyst_ms, orchestration_ms))", 0)} AS avg_duration_ms, {r("max(coalesce(search_ms, analyst_ms, orchestration_ms))", 0)} AS max_duration_ms
  FROM spans WHERE agent_name = 'AGENT_A' AND record_type = 'SPAN' AND (has_search OR has_analyst OR has_orchestration) GROUP BY 2"""

ORACLE: dict[str, str] = {
    "r13_win_loss_tie": on_spans(
        DELTAS
        + f""", outcome AS (SELECT metric, {verdict("sa", "sb", ("A_WIN", "B_WIN"))} AS o FROM sides)
SELECT metric, count(*) FILTER (o = 'A_WIN') AS a_wins, count(*) FILTER (o = 'B_WIN') AS b_wins, count(*) FILTER (o = 'TIE') AS ties, count(*) AS total_queries
FROM outcome GROUP BY 1 ORDER BY 1"""
    ),
    "extract_spans": on_spans("SELECT * EXCLUDE (start_ts, end_ts), epoch_us(start_ts) AS start_us FROM spans"),
    "src_agent_events": on_spans(f"SELECT {SPAN_TEXT}, duration_ms FROM spans WHERE agent_name = 'AGENT_A' AND agent_type = 'NATIVE AGENT'"),
    "src_all_events": on_spans(f"SELECT {SPAN_TEXT}, duration_ms FROM spans"),
    "src_events_of_run": on_spans(f"SELECT {SPAN_TEXT}, duration_ms FROM spans WHERE run_name = 'RUN_1'"),
    "src_eval_run_latest": on_spans(
        """picked AS (SELECT record_id, metric, score, target_record_id,
  row_number() OVER (ORDER BY end_ts DESC NULLS FIRST, record_id, metric, start_ts) AS rank
  FROM spans WHERE agent_name = 'AGENT_B' AND run_name = 'RUN_1' AND span_type = 'eval_root')
SELECT * FROM picked WHERE rank <= 50"""
    ),
    "src_logs_by_severity": on_spans(
        "SELECT trace_id, severity, run_name, record_id FROM spans WHERE record_type = 'LOG' AND agent_name = 'AGENT_A' AND run_name = 'RUN_2' AND severity IN ('ERROR', 'WARN')"
    ),
    "src_logs_of_run": on_spans(
        "SELECT trace_id, severity, run_name, record_id FROM spans WHERE record_type = 'LOG' AND agent_name = 'AGENT_B' AND run_name = 'RUN_2'"
    ),
    "src_record_lookup": on_spans(f"SELECT planning_output AS planning, {SPAN_TEXT}, duration_ms, tokens_total, score FROM spans WHERE record_id = 'rec-42'"),
    "src_recent_failures": jobs(50, "AND state = 'FAILED'"),
    "src_recent_jobs": jobs(100, ""),
    "src_dataset_head": on_spans(
        EVAL_DATA
        + f""", d AS (SELECT input_query AS query_text, {TRUTH_JSON} AS expected_tools, row_number() OVER (ORDER BY input_query) AS rank FROM eval_data)
SELECT * FROM d WHERE rank <= 5"""
    ),
    "eval_dataset": on_spans(EVAL_DATA + f" SELECT input_query AS query_text, {TRUTH_JSON} AS expected_tools FROM eval_data"),
    "eval_inputs": on_spans(
        EVAL_DATA
        + """ SELECT chr(123) || '"messages":[' || chr(123) || '"role":"user","content":"' || input_query || '"' || chr(125) || ']' || chr(125) AS record_root_input,
  truth AS record_root_ground_truth_output FROM eval_data"""
    ),
    "search_corpus": """SELECT d.doc_id, d.lang, d.source, d.text || ' Resolution: ' || coalesce('quality ' || CAST(l.quality AS VARCHAR), '') AS corpus_text
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "try_casts": on_spans(
        """SELECT metric, count(TRY_CAST(record_id AS BIGINT)) AS n_record_as_number,
  CAST(sum(TRY_CAST(regexp_extract(record_id, '[0-9]+', 0) AS BIGINT)) AS BIGINT) AS sum_record_number,
  count(TRY_CAST(round(CAST(score AS DECIMAL(28,9)), 2) AS DECIMAL(5,2))) AS n_two_digits,
  CAST(sum(TRY_CAST(round(CAST(score AS DECIMAL(28,9)), 2) AS DECIMAL(5,2))) AS DOUBLE) AS sum_two_digits,
  max(TRY_CAST(CAST(score AS VARCHAR) AS DOUBLE)) AS max_reparsed FROM spans WHERE span_type = 'eval_root' GROUP BY 1"""
    ),
    "order_abs_diff": on_spans(
        SIDE_BY_SIDE
        + """, ranked AS (SELECT user_query, latency_diff_ms, row_number() OVER (ORDER BY abs(latency_diff_ms) DESC NULLS FIRST, user_query) AS rank FROM sides)
SELECT user_query, latency_diff_ms, abs(latency_diff_ms) AS abs_diff_ms, rank FROM ranked"""
    ),
    "first_20": on_spans(
        DELTAS + ", ranked AS (SELECT *, row_number() OVER (ORDER BY metric, delta DESC, user_query) AS rank FROM delta) SELECT * FROM ranked WHERE rank <= 20"
    ),
    "r01_scorecard": on_spans(scorecard(4) + " SELECT * FROM card"),
    "r02_score_distribution": on_spans(
        f"""SELECT agent_name, metric, count(*) AS num_evals, {r("avg(score)", 4)} AS avg_score, {r("median(score)", 4)} AS median_score, {r("min(score)", 4)} AS min_score,
  {r("max(score)", 4)} AS max_score, {r("stddev_samp(score)", 4)} AS stddev_score, CAST(sum(CASE WHEN score = 1 THEN 1 ELSE 0 END) AS BIGINT) AS perfect_score_count,
  {r("sum(CASE WHEN score = 1 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) * 100", 1)} AS perfect_score_pct FROM spans WHERE {SCORED} GROUP BY 1, 2"""
    ),
    "r03_latency_percentiles": on_spans(
        f"""SELECT agent_name, count(*) AS num_requests, {r("avg(duration_ms)", 0)} AS avg_ms, {r("median(duration_ms)", 0)} AS p50_ms,
  {r("quantile_cont(duration_ms, 0.90)", 0)} AS p90_ms, {r("quantile_cont(duration_ms, 0.95)", 0)} AS p95_ms, {r("min(duration_ms)", 0)} AS min_ms, {r("max(duration_ms)", 0)} AS max_ms
  FROM spans WHERE {ROOT} GROUP BY 1"""
    ),
    "r04_span_breakdown": on_spans(
        f"""SELECT agent_name, span_type, count(*) AS span_count, {r("avg(duration_ms)", 0)} AS avg_duration_ms, {r("median(duration_ms)", 0)} AS median_duration_ms,
  {r("max(duration_ms)", 0)} AS max_duration_ms FROM spans WHERE record_type = 'SPAN' AND span_type IS NOT NULL GROUP BY 1, 2"""
    ),
    "r05_tool_breakdown": on_spans(TOOL),
    "r06_agent_span_totals": on_spans(
        f"""SELECT 'AGENT_B' AS agent_name, span_type, count(*) AS span_count, {r("avg(duration_ms)", 0)} AS avg_duration_ms, {r("max(duration_ms)", 0)} AS max_duration_ms,
  {r("sum(duration_ms)", 0)} AS total_duration_ms FROM spans WHERE agent_name = 'AGENT_B' AND record_type = 'SPAN'
  AND span_type IN ('retrieval', 'tool', 'graph_node', 'MCP', 'generation', 'record_root', 'unknown') GROUP BY 2"""
    ),
    "r06b_root_input_tokens": on_spans(
        f"""SELECT TRY_CAST(regexp_extract(call_return, 'input_tokens.: (\\d+)', 1) AS BIGINT) AS input_tokens, record_id, trace_id, user_query, agent_output, call_return, duration_ms
  FROM spans WHERE agent_name = 'AGENT_B' AND {ROOT}"""
    ),
    "r07_side_by_side": on_spans(SIDE_BY_SIDE + " SELECT * FROM sides"),
    "r07_widest_pairs": on_spans(
        USAGE_B
        + f""", ranked AS (SELECT row_number() OVER (ORDER BY abs(a.duration_ms - b.duration_ms) DESC, a.user_query, a.record_id, b.record_id) AS rank,
  a.user_query, a.record_id AS a_record_id, b.record_id AS b_record_id, left(a.agent_output, 200) AS a_response_preview, left(b.agent_output, 200) AS b_response_preview,
  a.duration_ms AS a_latency_ms, b.duration_ms AS b_latency_ms, a.duration_ms - b.duration_ms AS latency_diff_ms, {pct("a.duration_ms", "b.duration_ms")} AS latency_diff_pct,
  {", ".join(f"{s}.{t} AS {s}_{t}" for s in "ab" for t in TOKENS)}, a.total_tokens - b.total_tokens AS token_diff, {pct("a.total_tokens", "b.total_tokens")} AS token_diff_pct
  FROM a JOIN b ON a.user_query = b.user_query)
SELECT * FROM ranked WHERE rank <= 100"""
    ),
    "r07b_pair_averages": on_spans(
        USAGE_B
        + f""" SELECT {r("avg(a.duration_ms)", 4)} AS a_latency_ms, {r("avg(b.duration_ms)", 4)} AS b_latency_ms, {r("avg(a.duration_ms - b.duration_ms)", 4)} AS latency_diff_ms,
  {pct("avg(a.duration_ms)", "avg(b.duration_ms)")} AS latency_diff_pct, {", ".join(f"{r(f'avg({s}.{t})', 4)} AS avg_{s}_{t}" for s in "ab" for t in TOKENS)},
  {pct("avg(a.total_tokens)", "avg(b.total_tokens)")} AS token_diff_pct FROM a JOIN b ON a.user_query = b.user_query"""
    ),
    "r08_score_buckets": on_spans(
        f"""SELECT agent_name, metric, {buckets(("1.0 (Perfect)", "0.8-0.99", "0.6-0.79", "0.4-0.59", "< 0.4 (Poor)"))} AS score_bucket, count(*) AS count
  FROM spans WHERE {SCORED} GROUP BY 1, 2, 3"""
    ),
    "r09_run_comparison": on_spans(
        f"""SELECT run_name, metric, count(*) AS num_evals, {r("avg(score)", 4)} AS avg_score, {r("min(score)", 4)} AS min_score, count(*) FILTER (score = 1) AS perfect_count
  FROM spans WHERE agent_name = 'AGENT_B' AND {SCORED} GROUP BY 1, 2"""
    ),
    "r10_exec_summary": on_spans(
        summary("e.metric") + " SELECT user_query, a_output, b_output, a_latency_ms, b_latency_ms, a_scores AS a_eval_scores, b_scores AS b_eval_scores FROM sheet"
    ),
    "r11_metric_comparison": on_spans(
        f"""m AS (SELECT {CANONICAL} AS normalized_metric, avg(CASE WHEN agent_name = 'AGENT_A' THEN score END) AS sa, avg(CASE WHEN agent_name = 'AGENT_B' THEN score END) AS sb,
  count(*) FILTER (agent_name = 'AGENT_A') AS a_n, count(*) FILTER (agent_name = 'AGENT_B') AS b_n FROM spans WHERE {SCORED} GROUP BY 1)
SELECT normalized_metric, {r("sa", 4)} AS a_avg, {r("sb", 4)} AS b_avg, {r("sa - sb", 4)} AS delta, {verdict("sa", "sb")} AS winner, a_n, b_n FROM m"""
    ),
    "r12_query_delta": on_spans(DELTAS + " SELECT * FROM delta"),
    "d01_exec_with_traces": on_spans(
        summary(REPLACED.replace("metric", "e.metric", 1))
        + " SELECT user_query, a_latency_ms, b_latency_ms, a_scores AS a_eval_scores, b_scores AS b_eval_scores, a_output, b_output, a_trace_id, b_trace_id FROM sheet"
    ),
    "d02_scorecard_short": on_spans(
        scorecard(3)
        + f" SELECT coalesce({LABEL}, agent_name) AS label, agent_name, avg_eval_score, min_eval_score, avg_latency_ms, median_latency_ms, num_invocations FROM card"
    ),
    "d03_per_query_wide": on_spans(
        summary(REPLACED.replace("metric", "e.metric", 1))
        + " SELECT user_query, a_latency_ms, b_latency_ms, "
        + ", ".join(
            f"CAST(json_extract_string({s}_scores, '$.{m}') AS DOUBLE) AS {s}_{m}" for s in "ab" for m in ("coherence", "correctness", "groundedness", "logical_consistency")
        )
        + " FROM sheet"
    ),
    "d04_metric_detail": on_spans(
        f"""SELECT {LABEL} AS agent, {REPLACED} AS metric, {r("avg(score)", 3)} AS avg_score, {r("median(score)", 3)} AS median_score, {r("min(score)", 3)} AS min_score,
  count(*) AS num_evals, {r("sum(CASE WHEN score = 1 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) * 100", 1)} AS perfect_pct FROM spans WHERE {SCORED} GROUP BY agent_name, 2"""
    ),
    "d05_bucket_facets": on_spans(
        f"""c AS (SELECT {LABEL} AS label, {REPLACED} AS metric, {buckets(("1.0 Perfect", "0.8 - 0.99", "0.6 - 0.79", "0.4 - 0.59", "< 0.4"))} AS score_bucket, count(*) AS cnt
  FROM spans WHERE {SCORED} GROUP BY 1, 2, 3),
o AS (SELECT * FROM (VALUES ('1.0 Perfect', 1), ('0.8 - 0.99', 2), ('0.6 - 0.79', 3), ('0.4 - 0.59', 4), ('< 0.4', 5)) AS t(score_bucket, bucket_order))
SELECT label, metric, label || ' / ' || metric AS facet, c.score_bucket, bucket_order, cnt FROM c JOIN o ON c.score_bucket = o.score_bucket"""
    ),
    "d06_root_latency": on_spans(f"SELECT agent_name, {LABEL} AS label, user_query, duration_ms AS latency_ms FROM spans WHERE {ROOT}"),
    "d06_latency_box": on_spans(
        f"""SELECT {LABEL} AS label, CAST(min(duration_ms) AS DOUBLE) AS low, {r("quantile_cont(duration_ms, 0.25)", 2)} AS q1, {r("median(duration_ms)", 2)} AS median,
  {r("quantile_cont(duration_ms, 0.75)", 2)} AS q3, CAST(max(duration_ms) AS DOUBLE) AS high FROM spans WHERE {ROOT} GROUP BY 1"""
    ),
    "d07_query_latency_mean": on_spans(
        f"""l AS (SELECT user_query, {LABEL} AS label, duration_ms FROM spans WHERE {ROOT})
SELECT user_query, label, {r("avg(duration_ms)", 4)} AS latency_ms FROM l WHERE user_query IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2"""
    ),
    "d08_span_breakdown_exec": on_spans(
        f"""SELECT {LABEL} AS label, span_type, count(*) AS span_count, {r("avg(duration_ms)", 0)} AS avg_duration_ms, {r("max(duration_ms)", 0)} AS max_duration_ms
  FROM spans WHERE record_type = 'SPAN' AND span_type IS NOT NULL AND span_type NOT IN ('eval', 'eval_root') GROUP BY 1, 2"""
    ),
    "d09_tool_durations": on_spans(
        f"""t AS ({TOOL}) SELECT CASE tool_type WHEN 'search' THEN 'Case Search' WHEN 'analyst' THEN 'Analyst' ELSE 'Agent Orchestration' END AS tool,
  invocations AS calls, avg_duration_ms AS avg_ms, max_duration_ms AS max_ms FROM t"""
    ),
    "d10_trace_timeline_a": on_spans(TIMELINE_A),
    "d10_trace_of_question": on_spans(
        TIMELINE_A
        + f""" AND trace_id = (SELECT trace_id FROM spans WHERE agent_name = 'AGENT_A' AND {ROOT} AND user_query = 'query-5' ORDER BY end_ts DESC NULLS FIRST, record_id DESC LIMIT 1)"""
    ),
    "d11_trace_timeline_b": on_spans(
        """SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY start_ts) AS step_no, coalesce(span_type, call_function, 'step') AS step, retrieval_query,
  call_function AS function_call, left(call_return, 500) AS call_return, duration_ms, coalesce(nullif(retrieval_query, ''), nullif(call_function, ''), '') AS detail,
  left(coalesce(nullif(left(call_return, 500), ''), ''), 300) AS return_preview
  FROM spans WHERE agent_name = 'AGENT_B' AND record_type = 'SPAN' AND span_type IS NOT NULL AND span_type NOT IN ('eval', 'eval_root')"""
    ),
    "ml_cases_by_category": "SELECT o_orderstatus AS category, count(*) AS total_cases FROM orders GROUP BY 1",
    "ml_avg_by_category": f"SELECT o_orderstatus AS category, {r('avg(o_totalprice)', 4)} AS avg_amount FROM orders GROUP BY 1",
    "ml_top_reps": f"WITH {REPS} SELECT rep, sum(handled) AS total_handled FROM reps GROUP BY 1",
    "ml_rate_by_priority": f"SELECT o_orderpriority AS priority, {r(URGENT, 6)} AS urgent_rate FROM orders GROUP BY 1",
    "ml_daily_trend": f"WITH {DAILY} SELECT metric_date, day_cases, day_avg_amount FROM daily",
    "ml_resolution_rate": f"WITH {REPS} SELECT rep, {r('sum(returned) / nullif(sum(handled), 0)', 6)} AS resolution_rate FROM reps GROUP BY 1",
    "ml_busiest_day": "SELECT CAST(o_orderdate AS DATE) AS metric_date, count(*) AS sum_daily_cases FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "ml_month_total": f"WITH {DAILY} SELECT CAST(sum(day_cases) AS BIGINT) AS sum_daily_cases FROM daily WHERE metric_date BETWEEN DATE '1998-01-01' AND DATE '1998-01-31'",
    "ml_metric_with_example": f"SELECT o_orderpriority, {r('avg(o_totalprice)', 4)} AS avg_amount, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS example FROM orders GROUP BY 1",
    "ml_case_metrics": f"""WITH c AS (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS u FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 1000)
SELECT o_orderstatus AS category, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS case_date, count(*) AS total_cases, {r("avg(o_totalprice)", 4)} AS avg_amount,
  max(o_totalprice) AS max_amount, {r("avg(u)", 6)} AS urgent_rate, {r("avg(u * o_totalprice)", 4)} AS avg_urgent_amount FROM c GROUP BY 1, 2""",
    "ml_daily_metrics": f"""WITH {DAILY} SELECT CAST(date_trunc('month', metric_date) AS DATE) AS metric_date, CAST(sum(day_cases) AS BIGINT) AS sum_daily_cases,
  CAST(sum(day_resolved) AS BIGINT) AS sum_daily_resolved, {r("avg(day_avg_amount)", 4)} AS daily_avg_amount, max(day_avg_amount) AS daily_max_amount FROM daily GROUP BY 1""",
    "ml_rep_metrics": f"""WITH {REPS} SELECT rep, sum(handled) AS total_handled, sum(returned) AS total_returned, {r("avg(avg_discount)", 6)} AS rep_avg_discount,
  {r("avg(avg_tax)", 6)} AS rep_avg_tax, {r("avg(late_rate)", 6)} AS rep_avg_late_rate FROM reps GROUP BY 1""",
    "search_topk": f"WITH {bm25('TRUE', 10)} SELECT h.query_id, h.rank, h.doc_id, h.score, d.lang, d.source, d.quality FROM hits h JOIN docs d ON d.doc_id = h.doc_id",
    "search_topk_filtered": f"WITH {bm25(LONG_ENGLISH, 5)} SELECT h.query_id, h.rank, h.doc_id, h.score, d.lang, d.source, d.quality FROM hits h JOIN docs d ON d.doc_id = h.doc_id",
    "search_grouped": f"""WITH {bm25('TRUE', 20)}, g AS (SELECT h.query_id, md5(d.corpus_text) AS text_md5, h.rank, h.doc_id FROM hits h JOIN docs d ON d.doc_id = h.doc_id)
SELECT query_id, text_md5, count(*) AS n_hits, min(rank) AS best_rank, min(doc_id) AS first_id, array_to_string(list_slice(list_sort(list_distinct(list(doc_id))), 1, 3), ',') AS example_ids
FROM g GROUP BY 1, 2""",
    "score_groundedness": GROUNDED,
    "score_correctness": on_spans(CORRECTNESS + f" SELECT record_id, agent_name, user_query, score, {band('score')} AS band FROM f1"),
    "score_range_band": on_spans(f"SELECT agent_name, metric, {band('score')} AS band, count(*) AS n FROM spans WHERE {SCORED} GROUP BY 1, 2, 3"),
    "score_custom_metric": on_spans(
        f"""said AS (SELECT record_id, agent_name, user_query, trim(unnest(string_split(regexp_replace(agent_output, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)))) AS sentence FROM spans WHERE {ROOT}),
  sets AS (SELECT *, list_distinct(regexp_extract_all(lower(sentence), '\\p{{L}}')) AS x, list_distinct(regexp_extract_all(lower(coalesce(user_query, '')), '\\p{{L}}')) AS y FROM said WHERE length(sentence) > 0),
  judged AS (SELECT record_id, agent_name, CASE WHEN {_abstain} THEN 1 WHEN rtrim(sentence) LIKE '%?' THEN 0 WHEN len(x) > 0 AND len(list_intersect(x, y)) / CAST(len(x) AS DOUBLE) >= 0.5 THEN 1 ELSE 0 END AS ok FROM sets),
  asked AS (SELECT DISTINCT record_id, agent_name FROM spans WHERE {ROOT}),
  f AS (SELECT a.record_id, a.agent_name, {r("avg(ok)", 4)} AS score FROM asked a
        LEFT JOIN judged j ON j.record_id IS NOT DISTINCT FROM a.record_id AND j.agent_name IS NOT DISTINCT FROM a.agent_name GROUP BY 1, 2)
SELECT *, {band("score")} AS band FROM f"""
    ),
    "score_to_events": on_spans(
        CORRECTNESS
        + """ SELECT 'SPAN' AS record_type, agent_name, run_name, 'eval_root' AS span_type, 'token_f1' AS metric, record_id AS target_record_id, score, TRUE AS has_score FROM f1"""
    ),
    "trace_documents": on_spans(f"{PLACED} {documents(100)}"),
    "trace_document_parts": on_spans(f"{PLACED} {documents(3)}"),
    "trace_scores": on_spans(
        f"""{PLACED} SELECT trace_id, {r("avg(CASE WHEN contains(line, ' | ') THEN 1 ELSE 0 END)", 4)} AS score, count(*) FILTER (contains(line, ' | ')) AS n_shown, count(*) AS n_steps FROM lines GROUP BY 1"""
    ),
}
ORACLE["d03_scores_from_text"] = ORACLE["d03_per_query_wide"]

ORACLE["score_with_model"] = ORACLE["score_custom_metric"]
ORACLE["score_ranking_order"] = f"""
WITH cut AS (SELECT conv_id, turn, role, string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)) AS pieces FROM conversations),
sents AS (SELECT conv_id, turn, role, trim(unnest(pieces)) AS sentence, generate_subscripts(pieces, 1) AS pos FROM cut),
items AS (SELECT conv_id, turn, role, pos, lower(regexp_extract(sentence, '[\\p{{L}}\\p{{N}}]+')) AS label, list_extract({NUMBERS.format("sentence")}, -1) AS x FROM sents WHERE length(sentence) > 0),
named AS (SELECT *, {_size.format("x")} * CASE WHEN x LIKE '-%' THEN -1 ELSE 1 END AS number FROM items WHERE label <> ''),
sources AS (SELECT *, lag(number) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS before FROM named WHERE role IS DISTINCT FROM 'assistant'),
runs AS (SELECT *, count(*) FILTER (before IS NULL OR number IS NULL OR before <> number) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS place FROM sources),
first AS (SELECT conv_id, label, min((turn, place)) AS place, min(turn) AS turn FROM runs GROUP BY 1, 2),
said AS (SELECT n.conv_id, n.turn, n.pos, f.place FROM named n LEFT JOIN first f ON f.conv_id = n.conv_id AND f.label = n.label AND f.turn < n.turn WHERE n.role = 'assistant'),
known AS (SELECT *, lag(place) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS before FROM said WHERE place IS NOT NULL),
counted AS (SELECT conv_id, turn, count(*) AS n_ranked, count_if(place < before) AS n_backwards FROM known GROUP BY 1, 2),
asked AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'assistant'),
listed AS (SELECT conv_id, turn, count(*) AS n_items FROM said GROUP BY 1, 2)
SELECT a.conv_id, a.turn, coalesce(n_items, 0) AS n_items, coalesce(n_ranked, 0) AS n_ranked, CAST(coalesce(n_backwards, 0) AS BIGINT) AS n_backwards,
       CASE WHEN n_ranked >= 2 THEN n_backwards = 0 END AS order_kept
FROM asked a LEFT JOIN listed l ON l.conv_id = a.conv_id AND l.turn = a.turn LEFT JOIN counted c ON c.conv_id = a.conv_id AND c.turn = a.turn"""
ORACLE["range_sketches"] = on_spans(
    f"""days AS (SELECT CAST(min(start_ts) AS DATE) + 1 AS low, CAST(max(start_ts) AS DATE) - 1 AS high FROM spans WHERE {ROOT})
SELECT agent_name, count(*) AS n_rows, count(DISTINCT duration_ms) AS exact_distinct, CAST(round(3 * 1.04 / sqrt(4096), 4) AS DOUBLE) AS distinct_error,
       TRUE AS distinct_holds, TRUE AS p50_holds, TRUE AS p95_holds
FROM spans, days WHERE {ROOT} AND CAST(start_ts AS DATE) BETWEEN low AND high GROUP BY agent_name"""
)
# A window is finished once the latest event is past its end by the delay.
ORACLE["stream_latency"] = on_spans(
    f"""mark AS (SELECT max(start_ts) - INTERVAL 1 HOUR AS w FROM spans WHERE {ROOT}),
w AS (SELECT time_bucket(INTERVAL 6 HOURS, start_ts, TIMESTAMP '1970-01-01') AS s, agent_name, duration_ms FROM spans WHERE {ROOT})
SELECT CAST(epoch(s) AS BIGINT) AS window_start_s, agent_name, count(*) AS n_requests, CAST(sum(duration_ms) AS BIGINT) AS sum_ms, max(duration_ms) AS max_ms
FROM w, mark WHERE s + INTERVAL 6 HOURS <= mark.w GROUP BY 1, 2"""
)

#: The same questions asked another way: through SQL table functions, or over native objects.
SAME_AS = {
    "extract_spans_native": "extract_spans",
    "r08_native_objects": "r08_score_buckets",
    "sql_agent_events": "src_agent_events",
    "sql_events_of_run": "src_events_of_run",
    "sql_record_lookup": "src_record_lookup",
    "sql_logs": "src_logs_by_severity",
    "sql_eval_run_latest": "src_eval_run_latest",
    "sql_scorecard": "r01_scorecard",
    "sql_latency_percentiles": "r03_latency_percentiles",
    "sql_span_totals": "r06_agent_span_totals",
    "sql_tool_breakdown": "r05_tool_breakdown",
    "sql_score_buckets": "r08_score_buckets",
    "sql_run_comparison": "r09_run_comparison",
    "sql_metric_comparison": "r11_metric_comparison",
    "sql_query_delta": "r12_query_delta",
    "sql_win_loss_tie": "r13_win_loss_tie",
}
ORACLE |= {name: ORACLE[other] for name, other in SAME_AS.items()}
