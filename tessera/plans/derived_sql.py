"""DuckDB twins of ``derived`` as CTE text, prepended to oracle queries."""

WS = r"[\t\n\x0B\f\r ]+"


def fold(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


ATTEMPTS = """attempts AS (
  SELECT event_type AS arm, user_id AS question_id, event_id, ts, value >= 30 AS ok, value AS seconds,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
         CASE WHEN user_id % 10 < 3 THEN 'simple' WHEN user_id % 10 < 8 THEN 'moderate' ELSE 'challenging' END AS difficulty,
         concat('db', CAST(user_id % 11 AS VARCHAR)) AS db_id,
         concat(event_type, ':', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 4 AS VARCHAR)) AS sql,
         CASE WHEN value >= 30 THEN NULL
              ELSE concat('no such column: c', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 5 AS VARCHAR)) END AS error,
         CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS INTEGER) AS attempt_no
  FROM events)"""

RUNS = ATTEMPTS + """,
runs0 AS (
  SELECT arm, question_id, difficulty, db_id,
         min_by(ok, attempt_no) AS draft_correct, max_by(ok, attempt_no) AS correct,
         min_by(sql, attempt_no) AS draft_sql, max_by(sql, attempt_no) AS sql,
         max_by(k, attempt_no) AS last_k, count(*) AS calls, sum(seconds) AS seconds, max(ts) AS finished_at,
         list_sort(list(DISTINCT CASE k % 3 WHEN 0 THEN 'writer' WHEN 1 THEN 'critic' ELSE 'fixer' END)) AS agents
  FROM attempts GROUP BY arm, question_id, difficulty, db_id),
runs AS (
  SELECT *, calls > 1 AS repaired,
         CASE WHEN correct THEN 'match'
              WHEN last_k % 4 = 0 THEN concat('crashed: worker timed out while grading question group ', CAST(question_id % 7 AS VARCHAR))
              WHEN last_k % 4 = 1 THEN concat('query failed to execute: no such column: c', CAST(last_k % 5 AS VARCHAR))
              WHEN last_k % 4 = 2 THEN 'row count differs'
              ELSE 'same row count, different values' END AS reason,
         CASE arm WHEN 'error' THEN 'none' WHEN 'click' THEN 'execution' WHEN 'purchase' THEN 'critique'
                  WHEN 'signup' THEN 'both' ELSE 'direct' END AS mode,
         CASE question_id % 3 WHEN 0 THEN '1.5B' WHEN 1 THEN '3B' ELSE '7B' END AS model_size
  FROM runs0)"""

QUESTIONS = """questions AS (
  SELECT q.question_id, coalesce(trim(regexp_replace(d.text, '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g')), '') AS question,
         CASE WHEN q.question_id % 10 < 3 THEN 'simple' WHEN q.question_id % 10 < 8 THEN 'moderate' ELSE 'challenging' END AS difficulty,
         concat('db', CAST(q.question_id % 11 AS VARCHAR)) AS db_id,
         concat('gold:', CAST(q.question_id % 4 AS VARCHAR)) AS gold_sql,
         CASE WHEN q.question_id % 7 = 0 THEN 'self_reference' WHEN q.question_id % 7 = 1 THEN 'nullable_reference' END AS trap
  FROM (SELECT DISTINCT user_id AS question_id FROM events) q LEFT JOIN documents d ON d.doc_id = q.question_id)"""

SPANS = """spans AS (
  SELECT *, CAST(seq // 2 AS INTEGER) AS parent_seq FROM (
    SELECT concat(CAST(user_id AS VARCHAR), '-', CAST(CAST(floor(epoch(ts) / 518400) AS BIGINT) AS VARCHAR)) AS run_id,
           event_id AS span_id, ts, event_type AS agent, value AS elapsed,
           CASE WHEN value >= 30 THEN 'ok' ELSE 'failed' END AS status,
           CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
           concat(event_type, '|', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 3 AS VARCHAR)) AS signature,
           CAST(row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 518400) ORDER BY ts, event_id) AS INTEGER) AS seq
    FROM events) s)"""

CALLS = """calls AS (
  SELECT user_id AS run_id, event_id, ts, event_type AS model,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 3 = 0 AS cached,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS prompt_tokens,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 10 AS completion_tokens,
         value AS seconds,
         CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 5 = 0 THEN 0.7 ELSE 0.0 END AS temperature
  FROM events)"""

ROUNDS = """rounds AS (
  SELECT l_orderkey AS question_id, l_linenumber AS round,
         CAST(x.l_quantity AS INTEGER) % 4 AS c1, l_linenumber % 4 AS c2,
         CAST(round(x.l_discount * 100) AS INTEGER) % 4 AS c3, CAST(round(x.l_tax * 100) AS INTEGER) % 4 AS c4,
         CASE WHEN x.l_returnflag = 'R' THEN 1 ELSE 0 END AS schema_errors,
         concat('q', CAST(l_orderkey AS VARCHAR), ':', CAST(x.l_partkey AS VARCHAR)) AS sql
  FROM (SELECT l_orderkey, l_linenumber,
               max_by({'l_quantity': l_quantity, 'l_discount': l_discount, 'l_tax': l_tax,
                       'l_returnflag': l_returnflag, 'l_partkey': l_partkey},
                      {'l_shipdate': l_shipdate, 'l_partkey': l_partkey, 'l_suppkey': l_suppkey}) AS x
        FROM lineitem GROUP BY l_orderkey, l_linenumber) t)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"

REGRADE = """graded AS (
  SELECT r.arm, r.question_id, r.correct, r.draft_correct, g.gold_sql IS NULL AS skipped,
         r.question_id % 17 = 0 AS ungradable,
         coalesce(split_part(r.sql, ':', 2) = split_part(g.gold_sql, ':', 2), false) AS final_now,
         coalesce(r.question_id % 17 <> 0 AND split_part(r.draft_sql, ':', 2) = split_part(g.gold_sql, ':', 2), false) AS draft_now
  FROM runs r LEFT JOIN (SELECT question_id, gold_sql FROM questions WHERE question_id % 19 <> 0) g
    ON r.question_id = g.question_id)"""


def _query_log_sql() -> str:
    from .derived import QUERY_TEMPLATES
    vals = ",\n    ".join("(%d, '%s')" % (i, t.replace("'", "''")) for i, t in enumerate(QUERY_TEMPLATES))
    return f"""tpl(tpl_id, tpl) AS (VALUES {vals}),
query_log AS (
  SELECT p_partkey AS query_id, t.tpl_id,
         replace(replace(replace(replace(replace(t.tpl, '{{brand}}', p_brand), '{{size}}', CAST(p_size AS VARCHAR)),
                 '{{type}}', p_type), '{{name}}', p_name), '{{key}}', CAST(p_partkey AS VARCHAR)) AS sql
  FROM part JOIN tpl t ON t.tpl_id = CAST(p_partkey % {len(QUERY_TEMPLATES)} AS INTEGER))"""


QUERY_LOG = _query_log_sql()

VOTES = """votes AS (
  SELECT l_orderkey AS question_id, l_linenumber AS reviewer,
         CASE WHEN l_linenumber % 3 = 0 THEN 'joins' WHEN l_linenumber % 3 = 1 THEN 'filters' ELSE 'aggregates' END AS focus,
         CASE WHEN x.l_linestatus = 'O' AND x.l_quantity < 5 THEN NULL ELSE x.l_quantity > 25 END AS approved,
         CASE WHEN x.l_quantity > 25 THEN '' WHEN x.l_returnflag = 'N' THEN ''
              ELSE concat('line ', CAST(l_linenumber AS VARCHAR), ' total looks wrong') END AS issue,
         x.l_discount = 0 AS schema_error
  FROM (SELECT l_orderkey, l_linenumber,
               max_by({'l_quantity': l_quantity, 'l_returnflag': l_returnflag, 'l_linestatus': l_linestatus, 'l_discount': l_discount},
                      {'l_shipdate': l_shipdate, 'l_partkey': l_partkey, 'l_suppkey': l_suppkey}) AS x
        FROM lineitem GROUP BY l_orderkey, l_linenumber) t)"""

REPLIES = """replies AS (
  SELECT conv_id, turn, role, text,
         CASE turn % 6 WHEN 0 THEN concat('```sql' || chr(10), text, chr(10) || '```') WHEN 1 THEN concat('SQL: ', text)
                       WHEN 2 THEN concat('Query:', text) WHEN 3 THEN concat(' ' || chr(10), text, chr(10) || ' ')
                       WHEN 4 THEN concat('Here you go: {"score": ', CAST(turn AS VARCHAR), ', "note": "ok"} thanks')
                       ELSE text END AS reply
  FROM conversations)"""
