"""AGG and WIN keys over the derived run log, attempts, spans and rounds."""

from pyspark.sql import functions as F

from ..operators import attempts as W
from ..operators import board as B
from ..operators.carried import bounded_notes
from ..sources.tables import tables
from . import derived as D
from .derived_sql import ATTEMPTS, CALLS, QUESTIONS, ROUNDS, RUNS, SPANS, fold, with_
from .registry import register


def _runs(spark, d):
    return D.runs(tables(spark, d).events)


def _questions(spark, d):
    t = tables(spark, d)
    return D.questions(t.events, t.documents)


def reg(key, sql=None):
    return register(key, sql)


BOARD_SQL = """board AS (
  SELECT arm,
         round(100.0 * avg(CASE WHEN draft_correct THEN 1.0 ELSE 0.0 END), 4) AS draft_acc,
         round(100.0 * avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 4) AS final_acc,
         count_if(correct AND NOT draft_correct) AS rescued, count_if(repaired) AS repaired, count(*) AS n,
         round(avg(calls), 4) AS calls_per_q, round(avg(seconds), 4) AS seconds_per_q
  FROM runs GROUP BY arm)"""


@reg("agg_leaderboard", with_(RUNS, BOARD_SQL) + "SELECT * FROM board")
def agg_leaderboard(spark, d):
    return B.leaderboard(_runs(spark, d))


@reg("agg_difficulty_pivot", with_(RUNS) + """
SELECT arm, round(100.0 * avg(CASE WHEN difficulty = 'simple' THEN CAST(correct AS DOUBLE) END), 4) AS simple,
       round(100.0 * avg(CASE WHEN difficulty = 'moderate' THEN CAST(correct AS DOUBLE) END), 4) AS moderate,
       round(100.0 * avg(CASE WHEN difficulty = 'challenging' THEN CAST(correct AS DOUBLE) END), 4) AS challenging
FROM runs GROUP BY arm""")
def agg_difficulty_pivot(spark, d):
    return B.difficulty_pivot(_runs(spark, d))


@reg("agg_delta_baseline", with_(RUNS, BOARD_SQL) + """
SELECT b.*, CASE WHEN arm = 'view' THEN NULL
                 ELSE round(final_acc - (SELECT final_acc FROM board WHERE arm = 'view'), 4) END AS delta_view
FROM board b""")
def agg_delta_baseline(spark, d):
    return B.delta_vs(B.leaderboard(_runs(spark, d)), D.BASELINE_ARM)


@reg("agg_delta_two_baselines", with_(RUNS, BOARD_SQL) + """
SELECT b.*, CASE WHEN arm = 'view' THEN NULL
                 ELSE round(final_acc - (SELECT final_acc FROM board WHERE arm = 'view'), 4) END AS delta_view,
            CASE WHEN arm = 'click' THEN NULL
                 ELSE round(final_acc - (SELECT final_acc FROM board WHERE arm = 'click'), 4) END AS delta_click
FROM board b""")
def agg_delta_two_baselines(spark, d):
    return B.delta_vs(B.leaderboard(_runs(spark, d)), [D.BASELINE_ARM, D.CONTROL_ARM])


@reg("agg_by_dimension", with_(RUNS, QUESTIONS) + """
SELECT 'difficulty' AS dimension, r.difficulty AS value, count_if(correct) AS correct, count(*) AS total,
       round(100.0 * count_if(correct) / count(*), 4) AS pct
FROM runs r JOIN questions q ON r.question_id = q.question_id GROUP BY r.difficulty
UNION ALL
SELECT 'trap', q.trap, count_if(correct), count(*), round(100.0 * count_if(correct) / count(*), 4)
FROM runs r JOIN questions q ON r.question_id = q.question_id WHERE q.trap IS NOT NULL GROUP BY q.trap""")
def agg_by_dimension(spark, d):
    return B.accuracy_by(_runs(spark, d), _questions(spark, d))


@reg("agg_failed_to_run", with_(RUNS) + """
SELECT arm, count_if(NOT correct AND contains(reason, 'failed to execute')) AS n_failed_to_run FROM runs GROUP BY arm""")
def agg_failed_to_run(spark, d):
    return B.failed_to_run(_runs(spark, d))


@reg("agg_contested", with_(RUNS) + """
SELECT question_id,
       CASE WHEN bool_and(correct) THEN 'always' WHEN NOT bool_or(correct) THEN 'never' ELSE 'contested' END AS status,
       coalesce(array_to_string(list_sort(list(DISTINCT arm) FILTER (WHERE correct)), ','), '') AS winners
FROM runs GROUP BY question_id""")
def agg_contested(spark, d):
    return B.contested(_runs(spark, d))


@reg("agg_top_reasons", with_(RUNS) + """
SELECT reason, n FROM (
  SELECT reason, count(*) AS n FROM runs WHERE starts_with(reason, 'crashed') GROUP BY reason) s
ORDER BY n DESC, reason LIMIT 5""")
def agg_top_reasons(spark, d):
    return B.top_reasons(_runs(spark, d))


FOUND_DBS_SQL = "SELECT DISTINCT concat('db', CAST(n_nationkey AS VARCHAR)) AS db_id FROM nation WHERE n_regionkey <> 4"


def found_dbs(nation):
    """Databases present: one per nation outside region 4 (so db4 and db9 are missing)."""
    return (nation.where(F.col("n_regionkey") != 4)
            .select(F.concat(F.lit("db"), F.col("n_nationkey").cast("string")).alias("db_id")).distinct())


@reg("agg_missing_db", with_(RUNS) + f"""
SELECT db_id, count_if(NOT correct) AS failures, count(*) AS runs FROM runs
WHERE db_id NOT IN ({FOUND_DBS_SQL}) GROUP BY db_id""")
def agg_missing_db(spark, d):
    t = tables(spark, d)
    return B.missing(D.runs(t.events), found_dbs(t.nation))


@reg("agg_mode_comparison", with_(RUNS) + """,
m AS (SELECT mode, round(100.0 * avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 4) AS accuracy,
             count_if(correct) AS correct, count_if(repaired) AS repaired, CAST(sum(calls) AS BIGINT) AS attempts,
             round(avg(calls), 4) AS calls_per_q FROM runs GROUP BY mode)
SELECT m.*, CASE WHEN mode = 'none' THEN NULL
                 ELSE round(accuracy - (SELECT accuracy FROM m WHERE mode = 'none'), 4) END AS delta FROM m""".replace(
    "WITH ", "WITH ", 1).replace(")\n,\nm AS", "),\nm AS"))
def agg_mode_comparison(spark, d):
    return B.mode_comparison(_runs(spark, d))


@reg("agg_routing_outcomes", with_(RUNS) + """
SELECT arm, round(100.0 * avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 4) AS accuracy,
       count_if(difficulty <> 'simple' OR mode IN ('critique', 'both')) AS verified,
       round(avg(calls), 4) AS calls_per_q, count_if(NOT correct) AS n_missed
FROM runs GROUP BY arm""")
def agg_routing_outcomes(spark, d):
    return B.routing_outcomes(_runs(spark, d))


@reg("agg_routing_missed", with_(RUNS) + "SELECT arm, question_id FROM runs WHERE NOT correct")
def agg_routing_missed(spark, d):
    return B.routing_missed(_runs(spark, d))


@reg("agg_overlap", with_(RUNS) + """
SELECT count_if(coalesce(a.correct, false) AND coalesce(b.correct, false)) AS both,
       count_if(coalesce(a.correct, false) AND NOT coalesce(b.correct, false)) AS only_a,
       count_if(NOT coalesce(a.correct, false) AND coalesce(b.correct, false)) AS only_b,
       count_if(coalesce(a.correct, false) OR coalesce(b.correct, false)) AS either
FROM (SELECT question_id, correct FROM runs WHERE arm = 'view') a
FULL OUTER JOIN (SELECT question_id, correct FROM runs WHERE arm = 'click') b ON a.question_id = b.question_id""")
def agg_overlap(spark, d):
    return B.overlap(_runs(spark, d), D.BASELINE_ARM, D.CONTROL_ARM)


@reg("agg_gap_by_size", with_(RUNS) + """,
acc AS (SELECT arm, model_size, avg(CAST(correct AS DOUBLE)) AS acc FROM runs GROUP BY arm, model_size),
g AS (SELECT a.arm, a.model_size, 100.0 * (b.acc - a.acc) AS gap,
             CASE a.model_size WHEN '1.5B' THEN 0 WHEN '3B' THEN 1 ELSE 2 END AS ord
      FROM acc a JOIN acc b ON b.arm = 'view' AND b.model_size = a.model_size WHERE a.arm <> 'view'),
h AS (SELECT *, gap - lag(gap) OVER (PARTITION BY arm ORDER BY ord) AS change,
             first_value(gap) OVER (PARTITION BY arm ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
             - last_value(gap) OVER (PARTITION BY arm ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total
      FROM g)
SELECT arm, model_size, round(gap, 4) AS gap, round(change, 4) AS change,
       round(CASE WHEN total = 0 THEN NULL ELSE -change / total END, 4) AS share FROM h""".replace(")\n,\nacc", "),\nacc"))
def agg_gap_by_size(spark, d):
    return B.gap_by_size(_runs(spark, d), D.BASELINE_ARM, D.SIZES)


@reg("agg_submitted", with_(RUNS) + """
SELECT arm, count_if(list_contains(agents, 'critic')) AS n_with, count(*) AS n,
       round(100.0 * count_if(list_contains(agents, 'critic')) / count(*), 4) AS pct FROM runs GROUP BY arm""")
def agg_submitted(spark, d):
    return B.submitted(_runs(spark, d), "critic")


@reg("agg_action_counts", with_(RUNS) + """
SELECT action, count(*) AS n FROM (SELECT unnest(agents) AS action FROM runs) s GROUP BY action""")
def agg_action_counts(spark, d):
    return B.action_counts(_runs(spark, d))


@reg("agg_failures", with_(RUNS, QUESTIONS) + """
SELECT r.arm, r.question_id,
       concat_ws(' | ', concat('q', CAST(r.question_id AS VARCHAR), ': ', q.question), concat('reason: ', r.reason),
                 concat('got: ', r.sql), concat('gold: ', q.gold_sql)) AS line
FROM runs r JOIN questions q ON r.question_id = q.question_id WHERE NOT r.correct""")
def agg_failures(spark, d):
    return B.failures(_runs(spark, d), _questions(spark, d))


REQUESTED_ARMS = ["view", "click", "error", "purchase", "signup", "react"]


@reg("agg_progress", with_(RUNS, QUESTIONS) + """,
arms AS (SELECT * FROM (VALUES ('view'), ('click'), ('error'), ('purchase'), ('signup'), ('react')) v(arm)),
done AS (SELECT arm, count(*) AS done FROM runs GROUP BY arm)
SELECT a.arm, coalesce(d.done, 0) AS done, (SELECT count(*) FROM questions) AS total,
       coalesce(d.done, 0) >= (SELECT count(*) FROM questions) AS complete
FROM arms a LEFT JOIN done d ON a.arm = d.arm""".replace(")\n,\narms", "),\narms"))
def agg_progress(spark, d):
    t = tables(spark, d)
    arms = spark.createDataFrame([(a,) for a in REQUESTED_ARMS], "arm string")
    return B.progress(D.runs(t.events), D.questions(t.events, t.documents), arms)


@reg("agg_describe", with_(QUESTIONS) + """
SELECT count(*) AS n_questions, count(DISTINCT db_id) AS n_databases,
       count_if(difficulty = 'simple') AS simple, count_if(difficulty = 'moderate') AS moderate,
       count_if(difficulty = 'challenging') AS challenging FROM questions""")
def agg_describe(spark, d):
    return B.describe(_questions(spark, d))


# ---------------------------------------------------------------- WIN

def _attempts(spark, d):
    return D.attempts(tables(spark, d).events)


@reg("win_first_last", with_(ATTEMPTS) + """
SELECT arm, question_id, min_by(sql, attempt_no) AS draft_sql, max_by(sql, attempt_no) AS final_sql,
       min_by(ok, attempt_no) AS draft_ok, max_by(ok, attempt_no) AS final_ok, count(*) > 1 AS repaired
FROM attempts GROUP BY arm, question_id""")
def win_first_last(spark, d):
    return W.first_last(D.tries(tables(spark, d).events))


ACTIONS_SQL = f"""l AS (
  SELECT arm, question_id, attempt_no, ok, sql, error,
         max(attempt_no) OVER (PARTITION BY arm, question_id) AS last_no,
         lead(sql) OVER (PARTITION BY arm, question_id ORDER BY attempt_no) AS next_sql
  FROM attempts WHERE attempt_no <= 3),
a AS (
  SELECT *, CASE WHEN ok THEN 'accepted' WHEN attempt_no = last_no THEN 'exhausted'
                 WHEN {fold('next_sql')} = {fold('sql')} THEN 'no-change' ELSE 'repairing' END AS action FROM l),
chain AS (
  SELECT * FROM (SELECT *, min(CASE WHEN action <> 'repairing' THEN attempt_no END)
                           OVER (PARTITION BY arm, question_id) AS end_no FROM a) e
  WHERE attempt_no <= end_no)"""


@reg("win_actions", with_(ATTEMPTS, ACTIONS_SQL) + "SELECT arm, question_id, attempt_no, sql, action FROM chain")
def win_actions(spark, d):
    return W.attempt_actions(_attempts(spark, d))


@reg("win_verified_lessons", with_(ATTEMPTS, ACTIONS_SQL) + f"""
SELECT arm, question_id, broken_sql, error, fixed_sql FROM (
  SELECT arm, question_id, min_by(sql, attempt_no) AS broken_sql, max_by(sql, attempt_no) AS fixed_sql,
         max_by(ok, attempt_no) AS final_ok, min_by(error, attempt_no) AS error,
         count_if(action = 'repairing') AS repairs
  FROM chain GROUP BY arm, question_id) p
WHERE final_ok AND repairs > 0 AND {fold('broken_sql')} <> {fold('fixed_sql')}""")
def win_verified_lessons(spark, d):
    return W.verified_lessons(_attempts(spark, d))


@reg("win_calls_delta", with_(CALLS) + """
SELECT run_id, event_id, running_total,
       running_total - coalesce(lag(running_total) OVER (PARTITION BY run_id ORDER BY ts, event_id), 0) AS delta
FROM (SELECT run_id, event_id, ts,
             CAST(sum(prompt_tokens) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_total
      FROM calls) s""")
def win_calls_delta(spark, d):
    return W.calls_delta(D.calls_log(tables(spark, d).events))


@reg("win_best_round", with_(ROUNDS) + """,
r AS (SELECT *, c1 + c2 + c3 + c4 - 10 * schema_errors AS score,
             c1 = 3 AND c2 = 3 AND c3 = 3 AND c4 = 3 AND schema_errors = 0 AS passes FROM rounds),
s AS (SELECT question_id, min(CASE WHEN passes THEN round END) AS stop FROM r GROUP BY question_id),
c AS (SELECT r.* FROM r JOIN s USING (question_id) WHERE s.stop IS NULL OR r.round <= s.stop),
g AS (SELECT question_id, max(score) AS mx,
             arg_max(round, score * 1000000 - round) AS best_round, arg_max(sql, score * 1000000 - round) AS best_sql,
             arg_min(sql, round) AS draft_sql, min(round) AS first_round,
             max(round) AS last_round, arg_max(sql, round) AS last_sql, arg_max(schema_errors, round) AS last_err
      FROM c GROUP BY question_id),
h AS (SELECT *, CASE WHEN mx > -1 THEN mx ELSE -1 END AS best_score FROM g)
SELECT question_id, best_score,
       CASE WHEN last_err = 0 AND best_score < 0 THEN last_round
            WHEN mx > -1 THEN best_round ELSE first_round END AS final_round,
       CASE WHEN last_err = 0 AND best_score < 0 THEN last_sql
            WHEN mx > -1 THEN best_sql ELSE draft_sql END AS final_sql
FROM h""".replace(")\n,\nr AS", "),\nr AS"))
def win_best_round(spark, d):
    return W.best_round(D.rounds(tables(spark, d).lineitem))


@reg("win_latest_per_key", with_(ATTEMPTS) + """
SELECT arm, question_id, event_id, seconds FROM attempts
QUALIFY row_number() OVER (PARTITION BY arm, question_id ORDER BY ts DESC, event_id DESC) = 1""")
def win_latest_per_key(spark, d):
    return W.latest_per_key(D.tries(tables(spark, d).events), ["arm", "question_id"], ["ts", "event_id"], ["event_id", "seconds"])


@reg("win_running_accuracy", with_(RUNS) + """
SELECT arm, question_id, CAST(row_number() OVER w AS INTEGER) AS n_done,
       round(100.0 * sum(CAST(correct AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) / row_number() OVER w, 4) AS running_acc
FROM runs WINDOW w AS (PARTITION BY arm ORDER BY finished_at, question_id)""")
def win_running_accuracy(spark, d):
    return W.running_accuracy(_runs(spark, d))


@reg("win_stalls", with_(SPANS) + """,
s AS (SELECT run_id, seq, signature, seq > min(seq) OVER (PARTITION BY run_id, signature) AS is_repeat FROM spans),
i AS (SELECT *, sum(CASE WHEN is_repeat THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT run_id, seq, signature, is_repeat, CAST(seq - min(seq) OVER (PARTITION BY run_id, island) AS INTEGER) AS stalled,
       seq - min(seq) OVER (PARTITION BY run_id, island) >= 2 AS flagged FROM i""".replace(")\n,\ns AS", "),\ns AS"))
def win_stalls(spark, d):
    return W.stalls(D.spans(tables(spark, d).events))


def notes_from_spans(spans):
    return spans.select("run_id", F.col("agent").alias("slot"), "seq",
                        F.concat(F.lit("note "), (F.col("k") % 11).cast("string")).alias("note"))


# The rule note by note: at most one round for each note of the longest slot.
NOTES_SQL = with_(SPANS).replace("WITH ", "WITH RECURSIVE ", 1) + """,
n AS (SELECT run_id, slot, note, row_number() OVER (PARTITION BY run_id, slot ORDER BY seq, note) AS i
      FROM (SELECT run_id, agent AS slot, seq, concat('note ', CAST(k % 11 AS VARCHAR)) AS note FROM spans) x),
held AS (SELECT run_id, slot, i, [note] AS kept FROM n WHERE i = 1
         UNION ALL
         SELECT n.run_id, n.slot, n.i, CASE WHEN list_contains(h.kept, n.note) THEN h.kept ELSE list_append(h.kept, n.note)[-8:] END
         FROM held h JOIN n ON n.run_id = h.run_id AND n.slot = h.slot AND n.i = h.i + 1),
ends AS (SELECT run_id, slot, arg_max(kept, i) AS kept FROM held GROUP BY run_id, slot)
SELECT run_id, slot, CAST(position AS INTEGER) AS position, kept[position] AS note
FROM (SELECT run_id, slot, kept, unnest(range(1, len(kept) + 1)) AS position FROM ends) e""".replace(")\n,\nn AS", "),\nn AS")


@reg("win_bounded_notes", NOTES_SQL)
def win_bounded_notes(spark, d):
    return bounded_notes(notes_from_spans(D.spans(tables(spark, d).events)), 8)
