"""Trials and runs: best rows, seeds for the next session, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def number(text: Column) -> Column:
    """A trial's value; what is no number counts as infinite."""
    return F.coalesce(text.try_cast("double"), F.lit(INF))


def best_trials(trials: DataFrame, by: list[str]) -> DataFrame:
    """The COMPLETE trial with the least value, the first by number of equals; groups without one are absent."""
    t = trials.filter("state = 'COMPLETE'").withColumn("_v", number(F.col("value")))
    best = F.min_by(F.struct("trial_number", F.col("_v").alias("value"), "session_id"), F.struct("_v", "trial_number"))
    return t.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def row_time(columns: list[str], form: str = "yyyy-MM-dd") -> Column:
    """The first of the columns that parses; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(F.nullif(F.col(c), F.lit("")), F.lit(form)) for c in columns])


def mismatches(rows: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the keys whose text differs from the current settings (one row); a missing value differs from any."""
    now = current.select(*[F.col(k).cast("string").alias(f"_now_{k}") for k in keys])
    differs = lambda k: F.when(~F.col(k).cast("string").eqNullSafe(F.col(f"_now_{k}")), F.lit(k))
    found = F.filter(F.array(*[differs(k) for k in keys]), lambda x: x.isNotNull())
    return rows.crossJoin(F.broadcast(now)).withColumn("mismatches", found).drop(*[f"_now_{k}" for k in keys])


def seeds(trials: DataFrame, by: list[str], compatible: Column, time: Column) -> DataFrame:
    """Where the next session starts: the best of the latest session if it is compatible, else the best compatible trial, else none."""
    t = trials.filter("state = 'COMPLETE'").withColumn("_v", number(F.col("value"))).withColumn("_ok", compatible).withColumn("_t", time)
    last = t.groupBy(*by).agg(F.max_by("session_id", F.struct("_t", "session_id")).alias("_last"))
    j = t.join(last, by)
    pick = lambda cond: F.min_by(F.when(cond, F.struct("trial_number", F.col("_v").alias("value"), F.col("_ok").alias("ok"))), F.when(cond, F.struct("_v", "trial_number")))
    one = j.groupBy(*by).agg(pick(F.col("session_id") == F.col("_last")).alias("recent"), pick(F.col("_ok")).alias("any"))
    use = F.when(F.col("recent.ok"), "recent").when(F.col("any").isNotNull(), "compatible").otherwise("none")
    chosen = F.when(use == "recent", F.col("recent.trial_number")).when(use == "compatible", F.col("any.trial_number"))
    return one.select(*by, use.alias("strategy"), chosen.alias("trial_number"))


def typed_params(rows: DataFrame, ident: list[str], kinds: dict[str, str]) -> DataFrame:
    """key, kind, as_number, as_text of the filled parameters of each row; what does not parse is dropped."""
    pairs = F.explode(F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(k).cast("string"))])).alias("key", "text")
    long = rows.select(*ident, pairs).filter("text IS NOT NULL AND trim(text) <> ''")
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("key")]
    long = long.withColumn("kind", kind).withColumn("as_number", F.when(F.col("kind") != "text", F.col("text").try_cast("double")))
    return long.filter("kind = 'text' OR as_number IS NOT NULL").withColumn("as_text", F.when(F.col("kind") == "text", F.col("text"))).drop("text")


def compared_params(params: DataFrame, a, b) -> DataFrame:
    side = lambda run, n: params.filter(F.col("run_id") == run).select("key", F.col("value").alias(n))
    return side(a, "a").join(side(b, "b"), "key", "full").withColumn("differs", ~F.col("a").eqNullSafe(F.col("b")))


def compared_metrics(latest: DataFrame, a, b, rising: tuple[str, ...]) -> DataFrame:
    """Values of two runs with change, change in percent and whether that is better; metrics of ``rising`` are better when they grow."""
    side = lambda run, n: latest.filter(F.col("run_id") == run).select("metric", F.col("value").alias(n))
    j = side(a, "a").join(side(b, "b"), "metric", "full").withColumn("change", F.col("b") - F.col("a"))
    up = F.col("metric").isin(*rising)
    better = F.when(F.col("change").isNull(), None).when(F.col("change") == 0, "same").when((F.col("change") > 0) == up, "better").otherwise("worse")
    return j.withColumn("change_pct", F.col("change") / F.when(F.col("a") != 0, F.abs("a")) * 100).withColumn("verdict", better)


def comparison_table(params: DataFrame, runs: list) -> DataFrame:
    """A row per key with a column for each run; keys that no run has are left out."""
    return params.filter(F.col("run_id").isin(runs)).groupBy("key").pivot("run_id", runs).agg(F.max("value"))


def changes_against_latest(params: DataFrame, run) -> DataFrame:
    """Differences of a run from the run that finished last among the others: other run and a text of changed keys by short name."""
    others = params.filter((F.col("run_id") != run) & F.col("end_time").isNotNull())
    latest = others.agg(F.max_by("run_id", F.struct("end_time", "run_id")).alias("other"))
    theirs = others.join(F.broadcast(latest), F.col("run_id") == F.col("other")).select("key", F.col("value").alias("old"), "other")
    mine = params.filter(F.col("run_id") == run).select("key", F.col("value").alias("new"))
    j = mine.join(theirs, "key", "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    short = F.element_at(F.split("key", r"\."), -1)
    text = F.concat(short, F.lit("="), F.coalesce("new", F.lit("-")))
    return j.agg(F.max("other").alias("other"), F.concat_ws(", ", F.sort_array(F.collect_list(text))).alias("changes"))


def aliased_params(params: DataFrame, aliases: DataFrame) -> DataFrame:
    """Parameters under their own names: of the keys that a run has for a name the first by priority, with the type its text shows.

    aliases: key, name, priority.
    """
    best = params.join(F.broadcast(aliases), "key").groupBy("run_id", "name").agg(F.min_by("value", "priority").alias("value"))
    v = F.lower("value")
    kind = F.when(v.isin("true", "false"), "bool").when(v.rlike(r"^-?\d+$"), "int").when(v.try_cast("double").isNotNull(), "float").otherwise("text")
    return best.withColumn("kind", kind)


def newest(runs: DataFrame, n: int, names: list[str] | None = None, prefix: str | None = None, name: str = "name", time: str = "start") -> DataFrame:
    """Runs by name list or prefix, newest first, at most n; the filter comes before the limit."""
    if names is not None:
        runs = runs.filter(F.col(name).isin(names))
    if prefix is not None:
        runs = runs.filter(F.col(name).startswith(prefix))
    return runs.orderBy(F.desc(time), name).limit(n)


def last_days(runs: DataFrame, today: str, n: int, exclude=None, ms: str = "start_ms") -> DataFrame:
    """Runs that began within the last n calendar days, without one, newest first."""
    keep = F.to_date(F.timestamp_millis(ms)) >= F.date_sub(F.lit(today).cast("date"), n - 1)
    if exclude is not None:
        keep = keep & (F.col("run_id") != exclude)
    return runs.filter(keep).orderBy(F.desc(ms), "run_id")


def summary(history: DataFrame, losses: str = "view") -> DataFrame:
    """Per run: status, best loss, minutes between its first and last row."""
    return history.groupBy("run_id").agg(
        F.min(F.when(F.col("metric") == losses, F.col("value"))).alias("best_loss"), ((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 6e7).alias("minutes"),
    ).withColumn("status", F.when(F.col("best_loss").isNull(), "failed").otherwise("finished"))


def state_counts(trials: DataFrame, by: list[str]) -> DataFrame:
    return trials.groupBy(*by, "state").agg(F.count("*").alias("n"))


