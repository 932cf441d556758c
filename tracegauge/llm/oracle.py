"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP1 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (
  SELECT r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered USING (r)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         100 * n_symbols > 10 * word_chars AS symbols_failed, 100 * n_dup_lines > 30 * n_lines AS dup_failed
  FROM m),
long AS (
  SELECT source, rule, CAST(bad AS INTEGER) AS bad FROM f,
  LATERAL (SELECT unnest(['base', 'symbols', 'dup']) AS rule, unnest([base_failed, symbols_failed, dup_failed]) AS bad)
  WHERE source IS NOT NULL),
h AS (SELECT source, rule, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS f FROM long GROUP BY ALL),
p AS (
  SELECT rule, sum(n) AS docs, count(*) AS hosts, sum(n * n) AS nn, sum(f) / sum(n) AS mean,
         (sum(f * f / n) - sum(f) * sum(f) / sum(n)) / nullif(count(*) - 1, 0) AS between_,
         (sum(f) - sum(f * f / n)) / nullif(sum(n) - count(*), 0) AS within_
  FROM h GROUP BY rule),
a AS (
  SELECT *, (between_ - within_) / nullif(between_ + ((docs - nn / docs) / nullif(hosts - 1, 0) - 1) * within_, 0) AS alike FROM p),
v AS (
  SELECT source, bool_or(CASE WHEN alike >= 1 THEN f / n
                              WHEN alike > 0 THEN (f + (1 / alike - 1) * mean) / (n + 1 / alike - 1)
                              ELSE mean END > 0.8 AND f / n > mean) AS host_rejected
  FROM h JOIN a USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(host_rejected, false) AS kept, coalesce(host_rejected, false) AS host_rejected
FROM f LEFT JOIN v USING (source)
"""



def _way(state: str, letters: str, cost: str, lines: str, condition: str) -> str:
    return f"CASE WHEN {state} IS NOT NULL AND {condition} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || {letters}, 'o': list_concat({state}.o, {lines})}} END"


def _best(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"


def _stay(state: str, initial: str, inserted: str = "") -> str:
    """The row stays with this role, after an inserted one if that is named."""
    role = {"u": "user", "a": "assistant"}[initial]
    fits, insert = f"r.initial = '{initial}'", f"'{inserted}:', " if inserted else ""
    line = f"[{insert}CASE WHEN {fits} THEN r.role ELSE '{role}' END || ':' || r.text]"
    letters = f"'{'I' if inserted else ''}' || CASE WHEN {fits} THEN 'K' ELSE 'R' END"
    return _way(state, letters, f"CASE WHEN {fits} THEN 0 ELSE 2 END + r.broken + {2 if inserted else 0}", line, "NOT r.gone")


def _drop(state: str) -> str:
    return _way(state, "'D'", "3", "[]", "true")


_STATE = "STRUCT(c BIGINT, a VARCHAR, o VARCHAR[])"

OP11 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same, CAST(list_dot_product(a.q, v.q) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.r <> v.r AND len(a.q) = len(v.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS k FROM s WHERE same QUALIFY k <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.vec_id) AS rank,
         s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same
  WHERE 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

OP12 = rf"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS nm
  FROM conversations),
drawn AS (
  SELECT *, xor(list_reduce(
           list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, len(nm) + 1), lambda i: [CAST(ascii(nm[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), CAST(4294967295 AS BIGINT)) % 20 AS draw
  FROM named),
damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM drawn WHERE draw <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         regexp_replace(text, '[ 	-
]+$', '') AS body, left(role, 1) AS initial
  FROM damaged),
r AS (
  SELECT *, body = '' AS blank, body <> '' AND nth > 1 AS twice, body = '' OR nth > 1 AS gone,
         CAST(body <> '' AND nth = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS BIGINT) AS broken,
         CAST(i > 1 AND lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS BIGINT) AS unlawful
  FROM placed),
v AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, CAST({{'c': 0, 'a': '', 'o': []}} AS {_STATE}) AS s0,
         CAST(NULL AS {_STATE}) AS s1, CAST(NULL AS {_STATE}) AS s2, CAST(NULL AS {_STATE}) AS s3
  FROM conversations
  UNION ALL
  SELECT v.conv_id, r.i, {_best(_drop("s0"))},
         {_best(_drop("s1"), _way("s0", "'K'", "r.broken", "[r.role || ':' || r.text]", "NOT r.gone AND r.initial = 's'"))},
         {_best(_drop("s2"), _stay("s0", "u"), _stay("s1", "u"), _stay("s3", "u"), _stay("s2", "u", "assistant"))},
         {_best(_drop("s3"), _stay("s2", "a"), _stay("s0", "a", "user"), _stay("s1", "a", "user"), _stay("s3", "a", "user"))}
  FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i + 1),
ends AS (
  SELECT conv_id, i, {_best("s0", "s3", _way("s2", "'I'", "2", "['assistant:']", "true"), _way("s1", "'II'", "4", "['user:', 'assistant:']", "true"))} AS best
  FROM v),
last AS (SELECT conv_id, arg_max(best, i) AS best FROM ends GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(twice) AS duplicate,
         sum(broken) AS truncated, sum(unlawful) AS illegal
  FROM r GROUP BY conv_id)
SELECT last.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit,
       sha256(array_to_string(best.o, chr(10))) AS repaired_sha256
FROM last LEFT JOIN counts ON last.conv_id IS NOT DISTINCT FROM counts.conv_id
"""

OP13 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, payload_bytes >= 100 AND row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) > 1 AS again,
             first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS original FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN original END AS refers_to
FROM f
"""

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": OP1, "op11_hard_negatives": OP11, "op12_conversation_repair": OP12, "op13_warc": OP13}
