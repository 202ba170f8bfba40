"""Ordered series of metrics: best so far, early stopping, over-fit gaps, latest values."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.operators import quantiles


def best_so_far(trials: DataFrame, by: list[str], order: str = "trial_number", value: str = "value") -> DataFrame:
    """Running minimum over COMPLETE rows with a value."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return trials.filter((F.col("state") == "COMPLETE") & F.col(value).isNotNull()).withColumn("best", F.min(value).over(w))


def stop_counters(history: DataFrame, by: str = "run_id", order: str = "step", value: str = "value", min_delta: float = 0.0) -> DataFrame:
    """Steps since the value last fell below the best by more than min_delta; 0 at the first step.

    Without a delta this is a window; with one the best moves only on improvement, which is a fold over
    each run's steps in order: rows sorted by run and step go by in batches, and the state of the run
    that a batch ends in is carried to the next.
    """
    if min_delta <= 0:
        w = Window.partitionBy(by).orderBy(order)
        upto = w.rowsBetween(Window.unboundedPreceding, -1)
        before = F.min(value).over(upto)
        improved = before.isNull() | (F.col(value) < before)
        h = history.withColumn("_n", F.row_number().over(w)).withColumn("_i", improved)
        last = F.max(F.when(F.col("_i"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return h.withColumn("counter", (F.col("_n") - last).cast("long")).drop("_n", "_i")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, best, counter = object(), None, 0
        for batch in batches:
            out = []
            for key, v in zip(batch.column(by).to_pylist(), batch.column(value).to_pylist(), strict=True):
                if key != run:
                    run, best, counter = key, None, -1
                # NaN is larger than any number.
                if best is None or (v is not None and v == v and (best != best or v < best - min_delta)):
                    best, counter = v, 0
                else:
                    counter += 1
                out.append(counter)
            yield batch.append_column("counter", pa.array(out, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in history.schema) + ", counter bigint"
    return history.repartition(by).sortWithinPartitions(by, order).mapInArrow(fold, schema)


def stop_steps(counters: DataFrame, patience: int | None, by: str = "run_id", order: str = "step") -> DataFrame:
    """First step whose counter reaches the patience; null if none does, and for no patience at all."""
    hit = F.lit(False) if patience is None else F.col("counter") >= patience
    return counters.groupBy(by).agg(F.min(F.when(hit, F.col(order))).alias("stop_step"))


def pivoted(history: DataFrame, names: dict[str, str], by: str = "run_id", order: str = "step") -> DataFrame:
    """One row per run and step with a column for each named metric."""
    return history.groupBy(by, order).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(a) for m, a in names.items()])


def overfit_stops(wide: DataFrame, ratio: float, first: int = 5, by: str = "run_id", order: str = "step") -> DataFrame:
    """First step from ``first`` on where (val - train) / train exceeds the ratio (train > 0)."""
    over = (F.col(order) >= first) & (F.col("train") > 0) & ((F.col("val") - F.col("train")) / F.when(F.col("train") > 0, F.col("train")) > ratio)
    return wide.groupBy(by).agg(F.min(F.when(over, F.col(order))).alias("stop_step"))


def best_steps(wide: DataFrame, by: str = "run_id", order: str = "step") -> DataFrame:
    """Step of the least val, the first of equals, with its other metrics."""
    others = [c for c in wide.columns if c not in (by, order)]
    best = F.min_by(F.struct(order, *others), F.struct("val", order))
    return wide.filter("val IS NOT NULL").groupBy(by).agg(best.alias("b")).select(by, *[F.col(f"b.{c}").alias(c) for c in (order, *others)])


def improvements(wide: DataFrame, by: str = "run_id", order: str = "step") -> DataFrame:
    """Improvement in percent over the first baseline on record."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.first("baseline", ignorenulls=True).over(w)
    return wide.withColumn("first_baseline", base).withColumn("improvement", (F.col("first_baseline") - F.col("mae")) / F.when(F.col("first_baseline") != 0, F.col("first_baseline")) * 100)


def latest(history: DataFrame) -> DataFrame:
    return history.groupBy("run_id", "metric").agg(F.max_by("value", F.struct("step", "ts")).alias("value"), F.max("step").alias("step"))


def axis_limits(history: DataFrame, by: list[str], pad: float = 0.1, accuracy: int | None = None) -> DataFrame:
    """5th and 95th percentiles (exact, by sketches and the values near them, or with ranks off by 1 / accuracy at most), padded, not below 0; (0, 1) without values."""
    if accuracy is None:
        q = quantiles.exact(history, by, {"_a": 0.05, "_b": 0.95}).select(*by, F.array("_a", "_b").alias("q"))
        counts = history.groupBy(*by).agg(F.count("value").alias("n"))
        a = counts.join(q.select(*[F.col(c).alias(f"_{c}") for c in by], "q"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] or F.lit(True), "left")
    else:
        a = history.groupBy(*by).agg(F.percentile_approx("value", [0.05, 0.95], accuracy).alias("q"), F.count("value").alias("n"))
    gap = (F.col("q")[1] - F.col("q")[0]) * pad
    return a.select(*by, F.when(F.col("n") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("q")[0] - gap)).alias("low"), F.when(F.col("n") == 0, 1.0).otherwise(F.col("q")[1] + gap).alias("high"))


def paired(a: DataFrame, b: DataFrame, by: str = "run_id", order: str = "step") -> DataFrame:
    """nth values of two series side by side, as far as the shorter goes."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(order))
    x, y = (d.select(by, nth.alias("nth"), F.col("value").alias(n)) for d, n in ((a, "train"), (b, "val")))
    return x.join(y, [by, "nth"])
