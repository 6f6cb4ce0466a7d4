"""OPS — request keys and cache joins, usage rollups, span analytics, pending work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import bounded
from ..plans.ordered import ordered_scan


def request_key(model, system, user, temperature, schema) -> F.Column:
    """SHA-256 of the request as JSON with keys in sorted order."""
    return F.sha2(F.to_json(F.struct(model.alias("model"), schema.alias("schema"), system.alias("system"),
                                     temperature.alias("temperature"), user.alias("user"))), 256)


def cache_split(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests(request_id, key, temperature); cache(key, response).
    Only temperature 0 may hit or be stored: such a request is a ``hit`` when
    the key is cached; misses are dispatched once per key (the first request
    id) and the rest ``wait`` for it; any other temperature is ``uncached``
    and always dispatched."""
    cacheable = requests.where(F.col("temperature") == 0)
    hit = cacheable.join(cache.select("key").distinct(), "key", "left_semi").select("request_id", "key", F.lit("hit").alias("status"))
    miss = cacheable.join(cache.select("key"), "key", "left_anti")
    first = miss.groupBy("key").agg(F.min("request_id").alias("_first"))
    miss = miss.join(first, "key").select("request_id", "key", F.when(F.col("request_id") == F.col("_first"), "dispatch")
                                          .otherwise("wait").alias("status"))
    other = requests.where(F.col("temperature") != 0).select("request_id", "key", F.lit("uncached").alias("status"))
    return hit.unionByName(miss).unionByName(other)


def cache_stats(cache: DataFrame) -> DataFrame:
    """Entries and bytes per shard (first two hex digits of the key) and in total."""
    c = cache.select(F.substring("key", 1, 2).alias("shard"), F.octet_length("response").alias("_b"))
    g = c.rollup("shard").agg(F.count(F.lit(1)).alias("entries"), F.sum("_b").cast("long").alias("bytes"))
    return g.select(F.coalesce("shard", F.lit("*")).alias("shard"), "entries", "bytes")


def usage(calls: DataFrame) -> DataFrame:
    """Per run: calls, cached, tokens spent on misses only, seconds, hit rate and
    calls per model (per-model counts first, so the list is bounded by #models)."""
    per = calls.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("cached").alias("cached"),
        F.sum(F.when(~F.col("cached"), F.col("prompt_tokens")).otherwise(0)).cast("long").alias("prompt_tokens"),
        F.sum(F.when(~F.col("cached"), F.col("completion_tokens")).otherwise(0)).cast("long").alias("completion_tokens"),
        F.round(F.sum("seconds"), 4).alias("seconds"))
    per = per.withColumn("hit_rate", F.round(F.col("cached") / F.col("calls"), 4))
    by_model = (calls.groupBy("run_id", "model").agg(F.count(F.lit(1)).alias("_n"))
                .groupBy("run_id").agg(F.array_join(F.sort_array(F.collect_list(
                    F.concat(F.col("model"), F.lit(":"), F.col("_n").cast("string")))), ",").alias("by_model")))
    return per.join(by_model, "run_id")


def spans_flat(spans: DataFrame) -> DataFrame:
    """Tree of spans (run_id, seq, parent_seq) → rows with depth and a path
    whose text order is depth-first order. Level by level, to any depth: each
    round joins the children of the current frontier (one equi-join per tree
    level); the loop ends when a level is empty, and each level is checkpointed,
    so neither lineage nor the plan grows with the depth."""
    # Materialise the node table once (reliable checkpoint in spark.checkpoint.dir),
    # so each level's emptiness test does not replay the span derivation.
    nodes = spans.select("run_id", "seq", "parent_seq").checkpoint()
    pad = lambda c: F.lpad(c.cast("string"), 10, "0")
    roots = nodes.join(nodes.select("run_id", F.col("seq").alias("parent_seq")), ["run_id", "parent_seq"], "left_anti")
    level = roots.select("run_id", "seq", F.lit(0).alias("depth"), pad(F.col("seq")).alias("path"))
    out = level
    d = 0
    while True:
        d += 1
        nxt = (nodes.join(level.select("run_id", F.col("seq").alias("parent_seq"), F.col("path").alias("_pp")),
                          ["run_id", "parent_seq"])
               .select("run_id", "seq", F.lit(d).alias("depth"), F.concat("_pp", F.lit("/"), pad(F.col("seq"))).alias("path")))
        nxt = nxt.checkpoint()
        if nxt.isEmpty():
            break
        out = out.unionByName(nxt)
        if d % 16 == 0:
            out = out.checkpoint()
        level = nxt
    return out


def agents_used(spans: DataFrame) -> DataFrame:
    """Distinct agents per run in first-appearance order, root span excluded.
    The first sighting is a grouped ``min``; each run's list is bounded by the
    number of agents."""
    first = spans.where(F.col("seq") > 1).groupBy("run_id", "agent").agg(F.min("seq").alias("_s"))
    return first.groupBy("run_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("_s", "agent"))), lambda x: x["agent"]), ",").alias("agents"))


def span_stats(spans: DataFrame) -> DataFrame:
    """Spans, total and failures per agent, with exact interpolated percentiles.
    Ranks come from the skew-safe ordered scan over the elapsed times that are
    known, so no aggregate holds an agent's values; only the (at most two) rows
    around each percentile's position are joined back."""
    agg = spans.groupBy("agent").agg(
        F.count(F.lit(1)).alias("spans"), F.round(F.sum("elapsed"), 4).alias("total"),
        F.count("elapsed").alias("_n"), F.count_if(F.col("status") == "failed").alias("failures"))
    ranked = ordered_scan(spans.where(F.col("elapsed").isNotNull()).select("agent", "elapsed", "span_id"), ["agent"], ["elapsed", "span_id"], seq="_rank")
    near = ranked.alias("r").join(agg.select(F.col("agent").alias("_a"), "_n").alias("n"), F.col("r.agent").eqNullSafe(F.col("n._a")))
    picked = {}
    for name, q in (("p50", 0.5), ("p95", 0.95)):
        at = (F.col("_n") - 1) * F.lit(q)
        share = F.lit(1.0) - F.abs(F.col("_rank") - 1 - at)
        picked[name] = F.round(F.sum(F.when(share > 0, F.col("elapsed") * share)), 4).alias(name)
    mid = near.groupBy("_a").agg(*picked.values())
    return agg.alias("g").join(mid.alias("m"), F.col("g.agent").eqNullSafe(F.col("m._a")), "left").select(
        "agent", "spans", "total", "p50", "p95", "failures")


def pending(questions: DataFrame, arms: DataFrame, runs: DataFrame) -> DataFrame:
    """Arm × question pairs not yet in the log (a crashed row counts as done).
    The arms side is a short list, broadcast behind a row bound."""
    todo = questions.select("question_id").crossJoin(bounded(arms.select("arm"), 10_000))
    return todo.join(runs.select("arm", "question_id"), ["arm", "question_id"], "left_anti")


def arm_isolation(runs: DataFrame, lessons: DataFrame) -> DataFrame:
    """Lessons visible to each (arm, question): those of the same arm and scope
    (db), from other questions. Counted per (arm, db) first, then joined, so no
    pairs are formed."""
    per_scope = lessons.groupBy("arm", "db_id").agg(F.count(F.lit(1)).alias("_n"))
    own = lessons.groupBy("arm", "question_id").agg(F.count(F.lit(1)).alias("_own"))
    j = runs.select("arm", "question_id", "db_id").join(per_scope, ["arm", "db_id"], "left").join(own, ["arm", "question_id"], "left")
    return j.select("arm", "question_id",
                    (F.coalesce("_n", F.lit(0)) - F.coalesce("_own", F.lit(0))).alias("visible_lessons"))
