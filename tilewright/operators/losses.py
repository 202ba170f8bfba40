"""Losses and overlap measures as aggregates over predictions and targets; no gradients."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMOOTH = 1e-6


def ratio(num: Column, den: Column, empty: float) -> Column:
    return F.when(den == 0, F.lit(float(empty))).otherwise(num / F.when(den != 0, den))


def clamped(p: Column, eps: float = 1e-7) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))


def bce(p: Column, t: Column, pos_weight: float = 1.0) -> Column:
    q = clamped(p)
    return F.avg(-(t * F.ln(q) + (1 - t) * F.ln(1 - q)) * F.when(t >= 0.5, float(pos_weight)).otherwise(1.0))


def bce_smoothed(p: Column, t: Column, smoothing: float = 0.0) -> Column:
    """Smoothed targets t (1 - s) + s / 2; without smoothing logs stop at -100."""
    if smoothing <= 0:
        log = lambda x: F.when(x <= 0, -100.0).otherwise(F.greatest(F.lit(-100.0), F.ln(F.when(x > 0, x).otherwise(1.0))))
        return F.avg(-(t * log(p) + (1 - t) * log(1 - p)))
    q, s = clamped(p), t * (1 - smoothing) + 0.5 * smoothing
    return F.avg(-(s * F.ln(q) + (1 - s) * F.ln(1 - q)))


def smooth_l1_cell(p: Column, t: Column, beta: float = 1.0) -> Column:
    d = F.abs(p - t)
    return F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)


def smooth_l1(p: Column, t: Column, beta: float = 1.0) -> Column:
    return F.avg(smooth_l1_cell(p, t, beta))


def weighted_smooth_l1(p: Column, t: Column, threshold: float = 5.0, weight: float = 5.0, beta: float = 1.0) -> Column:
    return F.avg(smooth_l1_cell(p, t, beta) * F.when(t >= threshold, float(weight)).otherwise(1.0))


def _overlap(p: Column, t: Column, threshold: float) -> tuple[Column, Column, Column]:
    a, b = p >= threshold, t >= threshold
    return F.count_if(a & b).cast("double"), F.count_if(a).cast("double"), F.count_if(b).cast("double")


def dice(p: Column, t: Column, threshold: float = 5.0) -> Column:
    i, a, b = _overlap(p, t, threshold)
    return 1 - (2 * i + SMOOTH) / (a + b + SMOOTH)


def iou_loss(p: Column, t: Column, threshold: float = 5.0) -> Column:
    i, a, b = _overlap(p, t, threshold)
    return 1 - (i + SMOOTH) / (a + b - i + SMOOTH)


def soft_iou(p: Column, t: Column, threshold: float = 5.0, steep: float = 1.0) -> Column:
    soft = lambda x: 1 / (1 + F.exp(-(x - threshold) * steep))
    a, b = soft(p), soft(t)
    i = F.sum(a * b)
    return 1 - (i + SMOOTH) / (F.sum(a) + F.sum(b) - i + SMOOTH)


def encouragement(p: Column, t: Column, threshold: float = 5.0, weight: float = 2.0) -> Column:
    """Mean square error on positives plus the weighted mean square shortfall of those under the threshold; 0 without positives."""
    pos = t >= threshold
    under = pos & (p < threshold)
    return F.coalesce(F.avg(F.when(pos, (p - t) * (p - t))), F.lit(0.0)) + weight * F.coalesce(F.avg(F.when(under, (threshold - p) * (threshold - p))), F.lit(0.0))


def focal_cell(p: Column, t: Column, group_max: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """alpha * (scaled error)^gamma * error, the error scaled by the group's greatest target, 20 at least."""
    e = F.abs(p - t)
    return alpha * F.pow(e / F.greatest(group_max, F.lit(20.0)), F.lit(gamma)) * e


def focal(p: Column, t: Column, alpha: float = 0.25, gamma: float = 2.0, reduction: str = "mean") -> Column:
    """The scale is constant in a group, so it leaves the sum: one pass does."""
    e = F.abs(p - t)
    total = F.avg(F.pow(e, F.lit(gamma + 1))) if reduction == "mean" else F.sum(F.pow(e, F.lit(gamma + 1)))
    return alpha * total / F.pow(F.greatest(F.max(t), F.lit(20.0)), F.lit(gamma))


def combined(p: Column, t: Column, threshold: float = 5.0, iou_weight: float = 0.5, l1_weight: float = 0.5, soft: bool = False) -> Column:
    return iou_weight * (soft_iou if soft else iou_loss)(p, t, threshold) + l1_weight * weighted_smooth_l1(p, t, threshold)


def acl(p: Column, t: Column, threshold: float = 5.0, balance: float = 0.5) -> Column:
    return balance * dice(p, t, threshold) + (1 - balance) * focal(p, t)


LOSSES: dict[str, Callable[..., Column]] = {
    "bce": bce, "bce_smoothed": bce_smoothed, "smooth_l1": smooth_l1, "weighted_smooth_l1": weighted_smooth_l1, "dice": dice, "iou": iou_loss,
    "soft_iou": soft_iou, "encouragement": encouragement, "focal": focal, "combined": combined, "acl": acl,
}


def loss_agg(name: str | None, p: Column, t: Column, binary: bool = False, **options) -> Column:
    """The aggregate of a named loss. Dice on binary data cuts at 0.5; a positive weight and smoothing exclude each other."""
    if not name:
        raise ValueError("a loss must be named")
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name!r}; known: {', '.join(sorted(LOSSES))}")
    if name.startswith("bce") and options.get("pos_weight", 1.0) != 1.0 and options.get("smoothing", 0.0) > 0:
        raise ValueError("a positive weight and label smoothing exclude each other")
    if binary and name == "dice":
        options.setdefault("threshold", 0.5)
    return LOSSES[name](p, t, **options)


def losses_by(df: DataFrame, by: list[str], names: list[str], p: str = "pred", t: str = "target", **options) -> DataFrame:
    return df.groupBy(*by).agg(*[loss_agg(n, F.col(p), F.col(t), **options.get(n, {})).alias(n) for n in names])


def mae(p: Column, t: Column) -> Column:
    return F.avg(F.abs(p - t))


def rmse(p: Column, t: Column) -> Column:
    return F.sqrt(F.avg((p - t) * (p - t)))


def iou(p: Column, t: Column, threshold: float = 5.0, empty: float = 1.0) -> Column:
    i, a, b = _overlap(p, t, threshold)
    return ratio(i, a + b - i, empty)


def expected_iou(p: float, f: Column) -> Column:
    """IoU that predicting at random with rate p expects where a share f is positive."""
    return p * f / F.when(p + f - p * f > 0, p + f - p * f)
