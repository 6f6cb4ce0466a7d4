"""SMP, VOT, TXT and OPS keys."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import attempts as W
from ..operators import forest as FO
from ..operators import ops as O
from ..operators import profile as P
from ..operators import querylog as L
from ..operators import sampling as S
from ..operators import text as TX
from ..operators import values as VA
from ..operators import voting as V
from ..sources.tables import tables
from . import derived as D
from .derived_sql import ATTEMPTS, CALLS, QUERY_LOG, QUESTIONS, REPLIES, ROUNDS, RUNS, SPANS, VOTES, WS, fold, with_
from .keys_agg import ACTIONS_SQL, REQUESTED_ARMS
from .registry import register


def lit(s):
    return "'" + s.replace("'", "''") + "'"


def strip_sql(x):
    return f"regexp_replace({x}, {lit('^' + WS + '|' + WS + '$')}, '', 'g')"


# ---------------------------------------------------------------- SMP
N_SAMPLE, SEED, AUDIT_N, AUDIT_SEEDS, EDGE = 100, 7, 1000, list(range(1, 21)), 50


def apportion_sql(n):
    return f"""s AS (SELECT o_orderpriority AS stratum, count(*) AS size FROM orders GROUP BY o_orderpriority),
u AS (SELECT *, sum(size) OVER () AS tot, least({n}, sum(size) OVER ()) AS n FROM s),
f AS (SELECT *, CASE WHEN n <= 0 THEN 0 ELSE (n * size) // tot END AS fl, (n * size) % tot AS rem FROM u),
q AS (SELECT stratum, size, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, stratum) <= n - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS seats FROM f)"""


@register("smp_apportion", f"WITH {apportion_sql(N_SAMPLE)} SELECT * FROM q")
def smp_apportion(spark, d):
    o = tables(spark, d).orders
    return S.apportion(o.groupBy(F.col("o_orderpriority").alias("stratum")).agg(F.count(F.lit(1)).alias("size")), N_SAMPLE)


@register("smp_stratified", f"""WITH {apportion_sql(N_SAMPLE)},
r AS (SELECT o_orderkey AS key, o_orderpriority AS stratum, md5(concat('{SEED}:', CAST(o_orderkey AS VARCHAR))) AS h FROM orders)
SELECT key, stratum FROM (SELECT r.*, q.seats, row_number() OVER (PARTITION BY r.stratum ORDER BY h, key) AS rn
                          FROM r JOIN q ON q.stratum = r.stratum) x WHERE rn <= seats""")
def smp_stratified(spark, d):
    return S.stratified_sample(tables(spark, d).orders, "o_orderpriority", "o_orderkey", N_SAMPLE, SEED)


@register("smp_inclusion_audit", f"""WITH {apportion_sql(AUDIT_N)},
seeds(seed) AS (VALUES {', '.join('(' + str(s) + ')' for s in AUDIT_SEEDS)}),
r AS (SELECT s.seed, o_orderkey AS key, o_orderpriority AS stratum,
             md5(concat(CAST(s.seed AS VARCHAR), ':', CAST(o_orderkey AS VARCHAR))) AS h FROM orders, seeds s),
draws AS (SELECT key FROM (SELECT r.*, q.seats, row_number() OVER (PARTITION BY r.seed, r.stratum ORDER BY h, key) AS rn
                           FROM r JOIN q ON q.stratum = r.stratum) x WHERE rn <= seats),
low AS (SELECT o_orderkey AS key FROM orders ORDER BY o_orderkey LIMIT {EDGE}),
high AS (SELECT o_orderkey AS key FROM orders ORDER BY o_orderkey DESC LIMIT {EDGE}),
c AS (SELECT count(*) FILTER (WHERE key IN (SELECT key FROM low)) AS lo, count(*) FILTER (WHERE key IN (SELECT key FROM high)) AS hi FROM draws)
SELECT round(lo / {float(EDGE * len(AUDIT_SEEDS))}, 4) AS low_rate, round(hi / {float(EDGE * len(AUDIT_SEEDS))}, 4) AS high_rate,
       round(CASE WHEN lo = 0 THEN NULL ELSE CAST(hi AS DOUBLE) / lo END, 4) AS ratio FROM c""")
def smp_inclusion_audit(spark, d):
    return S.inclusion_audit(tables(spark, d).orders, "o_orderpriority", "o_orderkey", AUDIT_N, AUDIT_SEEDS, EDGE)


# ---------------------------------------------------------------- VOT
SAMPLES_SQL = """samples AS (SELECT question_id, event_id AS sample_no, concat(arm, ':', CAST(k % 4 AS VARCHAR)) AS sql, ok,
                           concat('fp', CAST(k % 3 AS VARCHAR)) AS fingerprint FROM attempts)"""


def _samples(spark, d):
    a = D.tries(tables(spark, d).events)
    return a.select("question_id", F.col("event_id").alias("sample_no"),
                    F.concat(F.col("arm"), F.lit(":"), (F.col("k") % 4).cast("string")).alias("sql"), "ok",
                    F.concat(F.lit("fp"), (F.col("k") % 3).cast("string")).alias("fingerprint"))


@register("vot_majority", with_(ATTEMPTS, SAMPLES_SQL) + """,
g AS (SELECT question_id, fingerprint, count(*) AS votes, min(sample_no) AS first, arg_min(sql, sample_no) AS sql
      FROM samples WHERE ok GROUP BY question_id, fingerprint),
w AS (SELECT question_id, arg_max(sql, (votes, -first)) AS sql, max(votes) AS votes, count(*) AS distinct_answers FROM g GROUP BY question_id),
p AS (SELECT question_id, count(*) AS samples, arg_min(sql, sample_no) AS first_draft FROM samples GROUP BY question_id)
SELECT p.question_id, p.samples, coalesce(w.sql, p.first_draft) AS sql, coalesce(w.votes, 0) AS agreement,
       coalesce(w.distinct_answers, 0) AS distinct_answers, coalesce(w.distinct_answers, 0) = 1 AS unanimous
FROM p LEFT JOIN w ON w.question_id = p.question_id""".replace(")\n,\ng AS", "),\ng AS"))
def vot_majority(spark, d):
    return V.majority(_samples(spark, d))


QUORUM_SQL = """SELECT v.question_id, v.objections, coalesce(e.n, 0) AS schema_errors, v.objections + coalesce(e.n, 0) >= 2 AS repair, v.issues
FROM (SELECT question_id,
             count(*) FILTER (WHERE approved IS NOT NULL AND NOT approved AND trim(coalesce(issue, '')) <> '') AS objections,
             coalesce(array_to_string(list_sort(list(concat(focus, ': ', issue)) FILTER (WHERE approved IS NOT NULL AND NOT approved
                      AND trim(coalesce(issue, '')) <> '')), '; '), '') AS issues
      FROM votes GROUP BY question_id) v
LEFT JOIN (SELECT question_id, count(*) AS n FROM votes WHERE schema_error GROUP BY question_id) e ON e.question_id = v.question_id"""


@register("vot_quorum", with_(VOTES) + QUORUM_SQL)
def vot_quorum(spark, d):
    v = D.votes(tables(spark, d).lineitem)
    errs = v.where("_schema_error").groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    return V.quorum(v.drop("_schema_error"), errs)


@register("vot_rubric", with_(ROUNDS) + """
SELECT question_id, round, c1 + c2 + c3 + c4 AS total,
       CASE least(c1, c2, c3, c4) WHEN c1 THEN 'correctness' WHEN c2 THEN 'completeness' WHEN c3 THEN 'schema_fit' ELSE 'clarity' END AS weakest,
       c1 = 3 AND c2 = 3 AND c3 = 3 AND c4 = 3 AS passes FROM rounds""")
def vot_rubric(spark, d):
    return V.rubric(D.rounds(tables(spark, d).lineitem))


def _review_input(spark, d):
    r = D.rounds(tables(spark, d).lineitem)
    return r.select("question_id", "round", "schema_errors", (F.col("round") % 2 == 0).alias("has_critique"),
                    F.when(F.col("c3") < 2, F.lit("join condition looks wrong")).alias("issue"))


@register("vot_review_clean", with_(ROUNDS) + """
SELECT question_id, round, schema_errors = 0 AND (NOT (round % 2 = 0) OR c3 >= 2) AS clean,
       concat_ws(chr(10), CASE WHEN schema_errors > 0 THEN concat('Schema errors: ', CAST(schema_errors AS VARCHAR)) END,
                 CASE WHEN round % 2 = 0 AND c3 < 2 THEN 'Reviewer: join condition looks wrong' END) AS feedback
FROM rounds""")
def vot_review_clean(spark, d):
    return V.review(_review_input(spark, d))


@register("vot_feedback_fork", with_(ATTEMPTS) + """
SELECT arm, question_id, attempt_no,
  CASE WHEN mode = 'none' THEN NULL
       WHEN NOT ok AND mode IN ('execution', 'both') THEN concat('The query failed: ', error, chr(10) || 'Hint: check table and column names.', chr(10) || 'Schema: unknown column ', replace(error, 'no such column: ', ''), ' (in scope)')
       WHEN ok AND mode IN ('critique', 'both') AND k % 3 = 1 THEN concat('Reviewer: result looks incomplete (', CAST(k AS VARCHAR), ')')
  END AS feedback
FROM (SELECT *, CASE arm WHEN 'error' THEN 'none' WHEN 'click' THEN 'execution' WHEN 'purchase' THEN 'critique'
                         WHEN 'signup' THEN 'both' ELSE 'direct' END AS mode FROM attempts) a""")
def vot_feedback_fork(spark, d):
    a = D.attempts(tables(spark, d).events)
    a = a.select("arm", "question_id", "attempt_no", "ok", "error", D.mode_of(F.col("arm")).alias("mode"),
                 (F.col("k") % 3 != 1).alias("review_clean"),
                 F.concat(F.lit("Reviewer: result looks incomplete ("), F.col("k").cast("string"), F.lit(")")).alias("review_text"))
    # What a failed query named is checked against the events table it asked.
    failed = a.where(~F.col("ok")).select("arm", "question_id", "attempt_no", F.concat_ws("|", "arm", "question_id", "attempt_no").alias("query_id"),
                                          F.replace("error", F.lit("no such column: "), F.lit("")).alias("name"))
    refs = failed.select("query_id", F.lit("table").alias("kind"), F.lit(None).cast("string").alias("qualifier"), F.lit("events").alias("name")).unionByName(
        failed.select("query_id", F.lit("column").alias("kind"), F.lit(None).cast("string").alias("qualifier"), "name"))
    known = P.catalog(spark, {"events": tables(spark, d).events})
    hints = failed.join(V.schema_hints(VA.check_refs(refs, known)), "query_id").select("arm", "question_id", "attempt_no", "hint")
    return V.feedback(a, hints)


# ---------------------------------------------------------------- TXT
def _replies(spark, d):
    return D.replies(tables(spark, d).conversations)


def fences_sql(x):
    t = strip_sql(x)
    inner = f"regexp_replace(regexp_replace({t}, '^```[^\\n]*(\\n|$)', ''), '(^|\\n)[ \\t\\x0B\\f\\r]*```[^\\n]*$', '')"
    return f"CASE WHEN starts_with({t}, '```') THEN {strip_sql(inner)} ELSE {t} END"


def labels_sql(x):
    t = strip_sql(fences_sql(x))
    for label in X.SQL_LABELS:
        t = f"CASE WHEN starts_with({t}, {lit(label)}) THEN {strip_sql(f'substr({t}, {len(label) + 1})')} ELSE {t} END"
    return t


@register("txt_strip_fences", with_(REPLIES) + f"SELECT conv_id, turn, {fences_sql('reply')} AS cleaned FROM replies")
def txt_strip_fences(spark, d):
    return _replies(spark, d).select("conv_id", "turn", X.strip_fences(F.col("reply")).alias("cleaned"))


@register("txt_strip_sql", with_(REPLIES) + f"SELECT conv_id, turn, {labels_sql('reply')} AS cleaned FROM replies")
def txt_strip_sql(spark, d):
    return _replies(spark, d).select("conv_id", "turn", X.strip_sql(F.col("reply")).alias("cleaned"))


@register("txt_one_line", with_(REPLIES) + f"SELECT conv_id, turn, {fold('reply')} AS cleaned FROM replies")
def txt_one_line(spark, d):
    return _replies(spark, d).select("conv_id", "turn", X.one_line(F.col("reply")).alias("cleaned"))


JSON_SQL = """json_extract_string(coalesce(try_cast(reply AS JSON),
    try_cast(CASE WHEN strpos(reply, '{') > 0 AND strpos(reverse(reply), '}') > 0
                   AND length(reply) - strpos(reverse(reply), '}') + 1 > strpos(reply, '{')
              THEN substr(reply, strpos(reply, '{'), length(reply) - strpos(reverse(reply), '}') + 1 - strpos(reply, '{') + 1) END AS JSON)), '$.score')"""


@register("txt_json_loose", with_(REPLIES) + f"SELECT conv_id, turn, {JSON_SQL} AS json_score FROM replies")
def txt_json_loose(spark, d):
    return _replies(spark, d).select("conv_id", "turn",
                                     F.try_variant_get(X.json_loose(F.col("reply")), "$.score", "string").alias("json_score"))


@register("txt_tool_calls", with_(REPLIES) + """
SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN concat('<tool_call>{"name": "run_sql", "arguments": {"sql": "', role, '"}}</tool_call>')
                           ELSE concat('```json' || chr(10) || '[{"function": {"name": "find_values", "arguments": "{\\"column\\": \\"', role, '\\"}"}}]' || chr(10) || '```') END AS reply,
       CAST(0 AS INTEGER) AS call_no, CASE WHEN turn % 4 = 0 THEN 'run_sql' ELSE 'find_values' END AS tool,
       CASE WHEN turn % 4 = 0 THEN concat('{"sql":"', role, '"}') ELSE concat('{"column":"', role, '"}') END AS arguments
FROM replies WHERE turn % 4 < 2""")
def txt_tool_calls(spark, d):
    r = _replies(spark, d)
    m = F.col("turn") % 4
    calls = r.select("conv_id", "turn", F.when(m == 0, F.concat(F.lit('<tool_call>{"name": "run_sql", "arguments": {"sql": "'),
                                                                  F.col("role"), F.lit('"}}</tool_call>')))
                     .when(m == 1, F.concat(F.lit('```json\n[{"function": {"name": "find_values", "arguments": "{\\"column\\": \\"'),
                                            F.col("role"), F.lit('\\"}"}}]\n```')))
                     .when(m == 2, F.lit('{"arguments": {"x": 1}}'))
                     .otherwise(F.col("text")).alias("reply"))
    return TX.tool_calls(calls)


@register("txt_unit_interval", """
SELECT event_id,
       round(least(greatest(CASE WHEN value / 3 > 1 AND value / 3 <= 100 THEN value / 3 / 100.0 ELSE value / 3 END, 0.0), 1.0), 6) AS score,
       CASE WHEN value >= 30 THEN 1.0 ELSE 0.0 END AS flag_score FROM events""")
def txt_unit_interval(spark, d):
    e = tables(spark, d).events
    return e.select("event_id", F.round(X.unit_interval(F.col("value") / 3), 6).alias("score"),
                    X.unit_interval(F.col("value") >= 30, is_bool=True).alias("flag_score"))


@register("txt_first_line", f"""
SELECT conv_id, turn, coalesce(nullif({strip_sql(f"split_part({strip_sql('coalesce(text, chr(0))')}, chr(10), 1)")}, ''), 'EmptyReply') AS first_line
FROM conversations""".replace("chr(0)", "''"))
def txt_first_line(spark, d):
    c = tables(spark, d).conversations
    return c.select("conv_id", "turn", X.first_line(F.col("text"), F.lit("EmptyReply")).alias("first_line"))


@register("txt_prompt_hint", f"""
SELECT conv_id, turn, CASE WHEN {strip_sql("CASE WHEN role = 'user' THEN '' ELSE concat('speaker is ', role) END")} = '' THEN text
                           ELSE concat(text, chr(10) || chr(10) || 'Hint: ', {strip_sql("CASE WHEN role = 'user' THEN '' ELSE concat('speaker is ', role) END")}) END AS prompt
FROM conversations""")
def txt_prompt_hint(spark, d):
    c = tables(spark, d).conversations
    ev = F.when(F.col("role") == "user", F.lit("")).otherwise(F.concat(F.lit("speaker is "), F.col("role")))
    return c.select("conv_id", "turn", X.prompt_hint(F.col("text"), ev).alias("prompt"))


@register("txt_signature", with_(QUERY_LOG) + f"""
SELECT query_id, concat_ws('|', 'try_sql',
  array_to_string(list_sort(list_transform(regexp_extract_all(upper(regexp_replace(sql, {lit(L.LITERAL_OR_COMMENT)}, ' ', 'g')), {lit(L.P_TABLE)}, 1), lambda x: lower(x))), ','),
  lower({fold('sql')})) AS signature FROM query_log""")
def txt_signature(spark, d):
    log = D.query_log(spark, tables(spark, d).part)
    tabs = F.regexp_extract_all(L.cleaned(F.col("sql")), F.lit(L.P_TABLE), 1)
    return log.select("query_id", X.signature(F.lit("try_sql"), tabs, F.col("sql")).alias("signature"))


@register("txt_clean_replies", with_(REPLIES) + f"""
SELECT conv_id, turn, role, text, reply, {fences_sql('reply')} AS no_fences, {labels_sql('reply')} AS sql, {fold('reply')} AS one_line,
       {JSON_SQL} AS json_score,
       coalesce(nullif({strip_sql(f"split_part({strip_sql('reply')}, chr(10), 1)")}, ''), 'EmptyReply') AS first_line
FROM replies""")
def txt_clean_replies(spark, d):
    return TX.clean_replies(_replies(spark, d))


# ---------------------------------------------------------------- OPS
CACHE_CUTOFF = "2024-01-10"  # ops_cache_split: what came before is the cache, the rest is asked of it


def _requests(spark, d):
    c = D.calls_log(tables(spark, d).events)
    key = O.request_key(F.col("model"), F.lit("sql-writer"), F.concat(F.lit("q"), F.col("run_id").cast("string")),
                        F.col("temperature"), F.lit("none"))
    return c.select(F.col("event_id").alias("request_id"), "ts", "temperature", key.alias("key"),
                    F.concat(F.lit("rows:"), F.col("prompt_tokens").cast("string")).alias("response"))


KEY_SQL = """sha256(concat('{"model":"', model, '","schema":"none","system":"sql-writer","temperature":', CAST(temperature AS VARCHAR),
                          ',"user":"q', CAST(run_id AS VARCHAR), '"}'))"""
REQ_SQL = f"""requests AS (SELECT event_id AS request_id, ts, temperature, {KEY_SQL} AS key,
                                concat('rows:', CAST(prompt_tokens AS VARCHAR)) AS response FROM calls),
cache AS (SELECT key, max(response) AS response FROM requests WHERE ts < TIMESTAMP '{CACHE_CUTOFF}' AND temperature = 0 GROUP BY key)"""


def _cache(reqs):
    return (reqs.where((F.col("ts") < F.lit(CACHE_CUTOFF).cast("timestamp_ntz")) & (F.col("temperature") == 0))
            .groupBy("key").agg(F.max("response").alias("response")))


@register("ops_request_key", with_(CALLS) + f"SELECT event_id AS request_id, {KEY_SQL} AS key FROM calls")
def ops_request_key(spark, d):
    return _requests(spark, d).select("request_id", "key")


@register("ops_cache_split", with_(CALLS, REQ_SQL) + f""",
live AS (SELECT * FROM requests WHERE ts >= TIMESTAMP '{CACHE_CUTOFF}')
SELECT request_id, key, CASE WHEN temperature <> 0 THEN 'uncached' WHEN key IN (SELECT key FROM cache) THEN 'hit'
                             WHEN request_id = min(request_id) OVER (PARTITION BY key) THEN 'dispatch' ELSE 'wait' END AS status
FROM (SELECT l.*, l.temperature = 0 AND l.key NOT IN (SELECT key FROM cache) AS is_miss FROM live l) x
WHERE temperature <> 0 OR NOT is_miss
UNION ALL
SELECT request_id, key, CASE WHEN request_id = min(request_id) OVER (PARTITION BY key) THEN 'dispatch' ELSE 'wait' END
FROM live WHERE temperature = 0 AND key NOT IN (SELECT key FROM cache)""".replace(")\n,\nlive", "),\nlive"))
def ops_cache_split(spark, d):
    reqs = _requests(spark, d)
    live = reqs.where(F.col("ts") >= F.lit(CACHE_CUTOFF).cast("timestamp_ntz"))
    return O.cache_split(live, _cache(reqs))


@register("ops_cache_stats", with_(CALLS, REQ_SQL) + """
SELECT coalesce(shard, '*') AS shard, count(*) AS entries, CAST(sum(strlen(response)) AS BIGINT) AS bytes
FROM (SELECT substr(key, 1, 2) AS shard, max(response) AS response FROM requests WHERE temperature = 0 GROUP BY key) c GROUP BY ROLLUP (shard)""")
def ops_cache_stats(spark, d):
    every = _requests(spark, d).where(F.col("temperature") == 0)
    return O.cache_stats(every.groupBy("key").agg(F.max("response").alias("response")))


@register("ops_usage", with_(CALLS) + """,
per AS (SELECT run_id, count(*) AS calls, count(*) FILTER (WHERE cached) AS cached,
               CAST(sum(CASE WHEN NOT cached THEN prompt_tokens ELSE 0 END) AS BIGINT) AS prompt_tokens,
               CAST(sum(CASE WHEN NOT cached THEN completion_tokens ELSE 0 END) AS BIGINT) AS completion_tokens,
               round(sum(seconds), 4) AS seconds FROM calls GROUP BY run_id),
bm AS (SELECT run_id, array_to_string(list_sort(list(concat(model, ':', CAST(n AS VARCHAR)))), ',') AS by_model
       FROM (SELECT run_id, model, count(*) AS n FROM calls GROUP BY run_id, model) m GROUP BY run_id)
SELECT per.*, round(cached / calls, 4) AS hit_rate, bm.by_model FROM per JOIN bm ON bm.run_id = per.run_id""".replace(")\n,\nper", "),\nper"))
def ops_usage(spark, d):
    return O.usage(D.calls_log(tables(spark, d).events))


def _spans(spark, d):
    return D.spans(tables(spark, d).events)


@register("ops_spans_flat", "WITH RECURSIVE " + SPANS + """,
t(run_id, seq, depth, path) AS (
  SELECT run_id, seq, 0, lpad(CAST(seq AS VARCHAR), 10, '0') FROM spans s
  WHERE NOT EXISTS (SELECT 1 FROM spans p WHERE p.run_id = s.run_id AND p.seq = s.parent_seq)
  UNION ALL
  SELECT c.run_id, c.seq, t.depth + 1, concat(t.path, '/', lpad(CAST(c.seq AS VARCHAR), 10, '0'))
  FROM spans c JOIN t ON c.run_id = t.run_id AND c.parent_seq = t.seq)
SELECT run_id, seq, depth, path FROM t""")
def ops_spans_flat(spark, d):
    return O.spans_flat(D.span_tree(tables(spark, d).events))


@register("ops_spans_preorder", "WITH RECURSIVE " + SPANS + """,
t(run_id, seq, depth, path) AS (
  SELECT run_id, seq, 0, lpad(CAST(seq AS VARCHAR), 10, '0') FROM spans s
  WHERE NOT EXISTS (SELECT 1 FROM spans p WHERE p.run_id = s.run_id AND p.seq = s.parent_seq)
  UNION ALL
  SELECT c.run_id, c.seq, t.depth + 1, concat(t.path, '/', lpad(CAST(c.seq AS VARCHAR), 10, '0'))
  FROM spans c JOIN t ON c.run_id = t.run_id AND c.parent_seq = t.seq)
SELECT run_id, seq, CAST(row_number() OVER (PARTITION BY run_id ORDER BY path) AS BIGINT) AS position, CAST(depth AS BIGINT) AS depth,
       (SELECT count(*) FROM t u WHERE u.run_id = t.run_id AND starts_with(u.path, concat(t.path, '/'))) AS below FROM t""")
def ops_spans_preorder(spark, d):
    return FO.preorder(D.span_tree(tables(spark, d).events))[0]


@register("ops_agents_used", with_(SPANS) + """
SELECT run_id, string_agg(agent, ',' ORDER BY s, agent) AS agents FROM (
  SELECT run_id, agent, min(seq) AS s FROM spans WHERE seq > 1 GROUP BY run_id, agent) x GROUP BY run_id""")
def ops_agents_used(spark, d):
    return O.agents_used(_spans(spark, d))


@register("ops_span_stats", with_(SPANS) + """
SELECT agent, count(*) AS spans, round(sum(elapsed), 4) AS total, round(quantile_cont(elapsed, 0.5), 4) AS p50,
       round(quantile_cont(elapsed, 0.95), 4) AS p95, count(*) FILTER (WHERE status = 'failed') AS failures
FROM spans GROUP BY agent""")
def ops_span_stats(spark, d):
    return O.span_stats(D.span_log(tables(spark, d).events))


@register("ops_pending", with_(RUNS, QUESTIONS) + f""",
arms(arm) AS (VALUES {', '.join('(' + lit(a) + ')' for a in REQUESTED_ARMS)})
SELECT a.arm, q.question_id FROM questions q, arms a
WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.arm = a.arm AND r.question_id = q.question_id)""".replace(")\n,\narms", "),\narms"))
def ops_pending(spark, d):
    t = tables(spark, d)
    arms = spark.createDataFrame([(a,) for a in REQUESTED_ARMS], "arm string")
    return O.pending(D.questions(t.events, t.documents), arms, D.runs(t.events))


@register("ops_arm_isolation", with_(RUNS, ACTIONS_SQL) + f""",
lessons AS (
  SELECT p.arm, p.question_id, r.db_id FROM (
    SELECT arm, question_id, min_by(sql, attempt_no) AS broken_sql, max_by(sql, attempt_no) AS fixed_sql,
           max_by(ok, attempt_no) AS final_ok, count_if(action = 'repairing') AS repairs
    FROM chain GROUP BY arm, question_id) p JOIN runs r ON r.arm = p.arm AND r.question_id = p.question_id
  WHERE final_ok AND repairs > 0 AND {fold('broken_sql')} <> {fold('fixed_sql')}),
per_scope AS (SELECT arm, db_id, count(*) AS n FROM lessons GROUP BY arm, db_id),
own AS (SELECT arm, question_id, count(*) AS n FROM lessons GROUP BY arm, question_id)
SELECT r.arm, r.question_id, coalesce(s.n, 0) - coalesce(o.n, 0) AS visible_lessons
FROM runs r LEFT JOIN per_scope s ON s.arm = r.arm AND s.db_id = r.db_id
LEFT JOIN own o ON o.arm = r.arm AND o.question_id = r.question_id""".replace(")\n,\nlessons", "),\nlessons"))
def ops_arm_isolation(spark, d):
    att = D.attempts(tables(spark, d).events)
    runs = D.runs_from_attempts(att)
    lessons = W.verified_lessons(att).join(runs.select("arm", "question_id", "db_id"), ["arm", "question_id"])
    return O.arm_isolation(runs, lessons)
