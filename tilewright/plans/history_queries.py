"""Queries over metric histories, trials and run parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators import runs, series
from tilewright.plans import fixtures as fx
from tilewright.registry import register

R = lambda e, n=6: F.round(e, n)
ROLES = {"view": "val", "click": "train", "error": "mae", "signup": "iou", "purchase": "baseline"}
WIDE = ", w AS (SELECT run_id, step, " + ", ".join(f"max(value) FILTER (metric = '{m}') AS {a}" for m, a in ROLES.items()) + " FROM h GROUP BY 1, 2)"


def wide(spark, sf):
    return series.pivoted(fx.history(spark, sf), ROLES)


def val(spark, sf):
    return fx.history(spark, sf).filter("metric = 'view'").select("run_id", "step", "value")


def numbered_trials(spark, sf):
    return fx.trials(spark, sf).withColumn("value", F.col("value").try_cast("double"))


@register("w1_best_so_far", fx.TRIALS + " SELECT study_name, mode, trial_number, v AS value, min(v) OVER (PARTITION BY study_name, mode ORDER BY trial_number) AS best FROM t WHERE state = 'COMPLETE' AND v IS NOT NULL")
def w1_best_so_far(spark, sf):
    return series.best_so_far(numbered_trials(spark, sf), ["study_name", "mode"]).select("study_name", "mode", "trial_number", "value", "best")


COUNTER = """, v AS (SELECT run_id, step, value, row_number() OVER (PARTITION BY run_id ORDER BY step) AS n, min(value) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM h WHERE metric = 'view'),
k AS (SELECT run_id, step, value, n - max(CASE WHEN prior IS NULL OR value < prior THEN n END) OVER (PARTITION BY run_id ORDER BY step) AS counter FROM v)"""


@register("w2_stop_counter", fx.HISTORY + COUNTER + " SELECT run_id, step, counter FROM k")
def w2_stop_counter(spark, sf):
    return series.stop_counters(val(spark, sf)).select("run_id", "step", "counter")


@register("w2_stop_counter_delta", fx.HISTORY.replace("WITH", "WITH RECURSIVE") + """, v AS (SELECT run_id, step, value, row_number() OVER (PARTITION BY run_id ORDER BY step) AS n FROM h WHERE metric = 'view'),
k AS (SELECT run_id, n, step, value AS best, CAST(0 AS BIGINT) AS counter FROM v WHERE n = 1 UNION ALL
 SELECT v.run_id, v.n, v.step, CASE WHEN v.value < k.best - 5.0 THEN v.value ELSE k.best END, CASE WHEN v.value < k.best - 5.0 THEN 0 ELSE k.counter + 1 END FROM k JOIN v ON v.run_id = k.run_id AND v.n = k.n + 1)
SELECT run_id, step, counter FROM k""")
def w2_stop_counter_delta(spark, sf):
    return series.stop_counters(val(spark, sf), min_delta=5.0).select("run_id", "step", "counter")


@register("w3_stop_step", fx.HISTORY + COUNTER + " SELECT run_id, min(step) FILTER (counter >= 4) AS stop_step FROM k GROUP BY 1")
def w3_stop_step(spark, sf):
    return series.stop_steps(series.stop_counters(val(spark, sf)), 4)


@register("w4_overfit_gap", fx.HISTORY + WIDE + " SELECT run_id, min(step) FILTER (step >= 5 AND train > 0 AND (val - train) / train > 0.5) AS stop_step FROM w GROUP BY 1")
def w4_overfit_gap(spark, sf):
    return series.overfit_stops(wide(spark, sf), 0.5)


@register("w5_best_epoch", fx.HISTORY + WIDE + ", n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY val, step) AS k FROM w WHERE val IS NOT NULL) SELECT run_id, step, val, mae, iou FROM n WHERE k = 1")
def w5_best_epoch(spark, sf):
    return series.best_steps(wide(spark, sf)).select("run_id", "step", "val", "mae", "iou")


@register("w6_improvement", fx.HISTORY + WIDE + ", f AS (SELECT run_id, baseline FROM (SELECT run_id, baseline, row_number() OVER (PARTITION BY run_id ORDER BY step) AS k FROM w WHERE baseline IS NOT NULL) WHERE k = 1) SELECT w.run_id, step, round((f.baseline - mae) / CASE WHEN f.baseline <> 0 THEN f.baseline END * 100, 6) AS improvement FROM w LEFT JOIN f ON w.run_id = f.run_id")
def w6_improvement(spark, sf):
    return series.improvements(wide(spark, sf)).select("run_id", "step", R("improvement").alias("improvement"))


@register("w7_latest", fx.HISTORY + " SELECT run_id, metric, value, step FROM (SELECT *, row_number() OVER (PARTITION BY run_id, metric ORDER BY step DESC, ts DESC) AS k FROM h) WHERE k = 1")
def w7_latest(spark, sf):
    return series.latest(fx.history(spark, sf))


@register("w8_epoch_series", fx.HISTORY + " SELECT run_id, step, printf('T%d E%d', run_id, step) AS label, value FROM h WHERE metric = 'view'")
def w8_epoch_series(spark, sf):
    """Epochs of runs by trial, labelled; sorted by the reader."""
    v = val(spark, sf)
    return v.select("run_id", "step", F.format_string("T%d E%d", "run_id", "step").alias("label"), "value")


@register("w9_axis_limits", fx.HISTORY + ", q AS (SELECT metric, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM h GROUP BY 1) SELECT metric, round(greatest(0.0, a - (b - a) * 0.1), 6) AS low, round(b + (b - a) * 0.1, 6) AS high FROM q")
def w9_axis_limits(spark, sf):
    return series.axis_limits(fx.history(spark, sf), ["metric"]).select("metric", R("low").alias("low"), R("high").alias("high"))


@register("w10_paired", fx.HISTORY + ", a AS (SELECT run_id, value, row_number() OVER (PARTITION BY run_id ORDER BY step) AS nth FROM h WHERE metric = 'click'), b AS (SELECT run_id, value, row_number() OVER (PARTITION BY run_id ORDER BY step) AS nth FROM h WHERE metric = 'view') SELECT a.run_id, a.nth, a.value AS train, b.value AS val FROM a JOIN b ON a.run_id = b.run_id AND a.nth = b.nth")
def w10_paired(spark, sf):
    h = fx.history(spark, sf)
    return series.paired(h.filter("metric = 'click'"), h.filter("metric = 'view'"))


@register("r1_best_trial", fx.TRIALS + " SELECT study_name, mode, trial_number, value FROM (SELECT study_name, mode, trial_number, coalesce(v, 'inf'::DOUBLE) AS value, row_number() OVER (PARTITION BY study_name, mode ORDER BY coalesce(v, 'inf'::DOUBLE), trial_number) AS k FROM t WHERE state = 'COMPLETE') WHERE k = 1")
def r1_best_trial(spark, sf):
    return runs.best_trials(fx.trials(spark, sf), ["study_name", "mode"]).drop("session_id")


@register("r2_row_time", fx.TRIALS + " SELECT trial_number, strftime(CASE WHEN started <> '' THEN CAST(started AS TIMESTAMP) WHEN trial_number % 3 <> 0 THEN CAST(session_id || '-01' AS TIMESTAMP) ELSE TIMESTAMP '0001-01-01' END, '%Y-%m-%d') AS at FROM t")
def r2_row_time(spark, sf):
    t = fx.trials(spark, sf).withColumn("month", F.when(F.col("trial_number") % 3 != 0, F.concat("session_id", F.lit("-01"))).otherwise(F.lit("unknown")))
    return t.select("trial_number", F.coalesce(F.date_format(runs.row_time(["session_started_at", "month"]), "yyyy-MM-dd"), F.lit("0001-01-01")).alias("at"))


@register("r3_mismatches", fx.TRIALS + " SELECT trial_number, concat_ws(',', CASE WHEN study_name IS DISTINCT FROM '1-URGENT' THEN 'study_name' END, CASE WHEN mode IS DISTINCT FROM 'O' THEN 'mode' END, CASE WHEN session_id IS DISTINCT FROM '1995-03' THEN 'session_id' END) AS mismatches FROM t")
def r3_mismatches(spark, sf):
    now = spark.range(1).select(F.lit("1-URGENT").alias("study_name"), F.lit("O").alias("mode"), F.lit("1995-03").alias("session_id"))
    return runs.mismatches(fx.trials(spark, sf), now, ["study_name", "mode", "session_id"]).select("trial_number", F.concat_ws(",", "mismatches").alias("mismatches"))


@register("r4_seed_choice", fx.TRIALS + """, c AS (SELECT *, coalesce(v, 'inf'::DOUBLE) AS x, trial_number % 4 <> 1 AS ok FROM t WHERE state = 'COMPLETE'),
l AS (SELECT study_name, mode, max(session_id) AS last FROM c GROUP BY 1, 2),
a AS (SELECT c.study_name, c.mode, trial_number, ok, row_number() OVER (PARTITION BY c.study_name, c.mode ORDER BY x, trial_number) AS k FROM c JOIN l ON c.study_name = l.study_name AND c.mode = l.mode AND c.session_id = l.last),
b AS (SELECT study_name, mode, trial_number, row_number() OVER (PARTITION BY study_name, mode ORDER BY x, trial_number) AS k FROM c WHERE ok)
SELECT l.study_name, l.mode, CASE WHEN a.ok THEN 'recent' WHEN b.trial_number IS NOT NULL THEN 'compatible' ELSE 'none' END AS strategy, CASE WHEN a.ok THEN a.trial_number ELSE b.trial_number END AS trial_number
FROM l LEFT JOIN a ON a.study_name = l.study_name AND a.mode = l.mode AND a.k = 1 LEFT JOIN b ON b.study_name = l.study_name AND b.mode = l.mode AND b.k = 1""")
def r4_seed_choice(spark, sf):
    return runs.seeds(fx.trials(spark, sf), ["study_name", "mode"], F.col("trial_number") % 4 != 1, F.col("session_id"))


@register("r5_seed_params", fx.TRIALS + " SELECT trial_number, 'session_id' AS key, 'text' AS kind, NULL::DOUBLE AS as_number, session_id AS as_text FROM t UNION ALL SELECT trial_number, 'value', 'float', v, NULL FROM t WHERE v IS NOT NULL UNION ALL SELECT trial_number, 'session_started_at', 'text', NULL, started FROM t WHERE started <> ''")
def r5_seed_params(spark, sf):
    return runs.typed_params(fx.trials(spark, sf), ["trial_number"], {"session_id": "text", "value": "float", "session_started_at": "text"})


@register("r6_best_params", fx.TRIALS + " SELECT study_name, trial_number, value, session_id FROM (SELECT study_name, trial_number, coalesce(v, 'inf'::DOUBLE) AS value, session_id, row_number() OVER (PARTITION BY study_name ORDER BY coalesce(v, 'inf'::DOUBLE), trial_number) AS k FROM t WHERE state = 'COMPLETE') WHERE k = 1")
def r6_best_params(spark, sf):
    return runs.best_trials(fx.trials(spark, sf), ["study_name"])


@register("r7_state_counts", fx.TRIALS + " SELECT study_name, state, count(*) AS n FROM t GROUP BY 1, 2")
def r7_state_counts(spark, sf):
    return runs.state_counts(fx.trials(spark, sf), ["study_name"])


@register("r8_compared_metrics", fx.HISTORY + """, l AS (SELECT run_id, metric, value FROM (SELECT *, row_number() OVER (PARTITION BY run_id, metric ORDER BY step DESC, ts DESC) AS k FROM h) WHERE k = 1),
j AS (SELECT coalesce(a.metric, b.metric) AS metric, a.value AS a, b.value AS b, b.value - a.value AS change FROM (SELECT * FROM l WHERE run_id = 1) a FULL JOIN (SELECT * FROM l WHERE run_id = 2) b ON a.metric = b.metric)
SELECT metric, a, b, round(change, 6) AS change, round(change / CASE WHEN a <> 0 THEN abs(a) END * 100, 6) AS change_pct, CASE WHEN change IS NULL THEN NULL WHEN change = 0 THEN 'same' WHEN (change > 0) = (metric = 'signup') THEN 'better' ELSE 'worse' END AS verdict FROM j""")
def r8_compared_metrics(spark, sf):
    c = runs.compared_metrics(series.latest(fx.history(spark, sf)), 1, 2, ("signup",))
    return c.select("metric", "a", "b", R("change").alias("change"), R("change_pct").alias("change_pct"), "verdict")


@register("r8_compared_params", fx.PARAMS + " SELECT coalesce(a.key, b.key) AS key, a.value AS a, b.value AS b, a.value IS DISTINCT FROM b.value AS differs FROM (SELECT * FROM p WHERE run_id = 1) a FULL JOIN (SELECT * FROM p WHERE run_id = 2) b ON a.key = b.key")
def r8_compared_params(spark, sf):
    return runs.compared_params(fx.params(spark, sf), 1, 2)


@register("r9_comparison_table", fx.PARAMS + ' SELECT key, max(value) FILTER (run_id = 1) AS "1", max(value) FILTER (run_id = 2) AS "2", max(value) FILTER (run_id = 3) AS "3" FROM p WHERE run_id IN (1, 2, 3) GROUP BY 1')
def r9_comparison_table(spark, sf):
    return runs.comparison_table(fx.params(spark, sf), [1, 2, 3])


@register("r10_changes", fx.PARAMS + """, o AS (SELECT run_id FROM p WHERE run_id <> 1 AND end_time IS NOT NULL ORDER BY end_time DESC, run_id DESC LIMIT 1),
j AS (SELECT coalesce(a.key, b.key) AS key, a.value AS new, b.value AS old FROM (SELECT * FROM p WHERE run_id = 1) a FULL JOIN (SELECT * FROM p WHERE run_id = (SELECT run_id FROM o)) b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value)
SELECT (SELECT run_id FROM o) AS other, string_agg(key || '=' || coalesce(new, '-'), ', ' ORDER BY key || '=' || coalesce(new, '-')) AS changes FROM j""")
def r10_changes(spark, sf):
    return runs.changes_against_latest(fx.params(spark, sf), 1)


@register("r11_aliased_params", fx.PARAMS + """, a AS (SELECT * FROM (VALUES ('segment', 'group', 1), ('nation', 'group', 2), ('nation', 'place', 1), ('balance', 'money', 1)) v(key, name, priority)),
b AS (SELECT run_id, name, arg_min(value, priority) AS value FROM p JOIN a ON p.key = a.key GROUP BY 1, 2)
SELECT run_id, name, value, CASE WHEN lower(value) IN ('true', 'false') THEN 'bool' WHEN regexp_full_match(value, '-?[0-9]+') THEN 'int' WHEN try_cast(value AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'text' END AS kind FROM b""")
def r11_aliased_params(spark, sf):
    aliases = spark.createDataFrame([("segment", "group", 1), ("nation", "group", 2), ("nation", "place", 1), ("balance", "money", 1)], "key string, name string, priority int")
    return runs.aliased_params(fx.params(spark, sf), aliases)


@register("r12_batch_summary", fx.HISTORY + " SELECT run_id, min(value) FILTER (metric = 'view') AS best_loss, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7, 6) AS minutes, CASE WHEN count(*) FILTER (metric = 'view') = 0 THEN 'failed' ELSE 'finished' END AS status FROM h GROUP BY 1")
def r12_batch_summary(spark, sf):
    return runs.summary(fx.history(spark, sf)).withColumn("minutes", R("minutes"))


@register("b14_recent_runs", "SELECT user_id AS run_id, max(epoch_us(ts)) // 1000 AS start_ms FROM events WHERE user_id <> 7 GROUP BY 1 HAVING CAST(max(ts) AS DATE) >= (SELECT CAST(max(ts) AS DATE) - 9 FROM events)")
def b14_recent_runs(spark, sf):
    e = fx.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    today = str(e.agg(F.max(F.to_date("ts"))).first()[0])  # one value
    return runs.last_days(e.groupBy(F.col("user_id").alias("run_id")).agg(F.max(F.unix_millis("ts")).alias("start_ms")), today, 10, exclude=7)


@register("b15_named_runs", "SELECT c_custkey AS run_id, c_name AS name, c_acctbal AS start FROM customer WHERE starts_with(c_name, 'Customer#0000001') ORDER BY c_acctbal DESC, c_name LIMIT 20")
def b15_named_runs(spark, sf):
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("start"))
    return runs.newest(c, 20, prefix="Customer#0000001")


@register("a12_append_trials", fx.TRIALS + " SELECT trial_number, CASE WHEN trial_number % 2 = 0 THEN session_id ELSE 's-42' END AS session_id, study_name, CASE WHEN trial_number % 2 = 0 THEN mode END AS mode FROM t")
def a12_append_trials(spark, sf):
    """Trials of another file appended: absent columns stay null, a blank session gets the caller's id."""
    from tilewright.sources import trials as source

    t = fx.trials(spark, sf).select("trial_number", "session_id", "study_name", "mode")
    other = t.filter("trial_number % 2 <> 0").select("trial_number", F.lit("").alias("session_id"), "study_name")
    return source.appended(t.filter("trial_number % 2 = 0"), other, {"session_id": "s-42", "study_name": "none"})
