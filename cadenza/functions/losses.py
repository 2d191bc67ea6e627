"""Training losses as expressions by row, and their weighted sum over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import clip, dot, let, mean_of, resample_labels, waveform_l1


def mean_size(a: Column) -> Column:
    return mean_of(F.transform(a, lambda v: F.abs(v.cast("double"))))


def scale_sensitive_l1(estimate: Column, reference: Column, least: float) -> Column:
    """Mean difference, or the estimate's own mean size where the reference's is below ``least`` (as good as silent)."""
    return F.when(mean_size(reference) < least, mean_size(estimate)).otherwise(waveform_l1(estimate, reference))


def mixture_gap(target: Column, residual: Column, mixture: Column) -> Column:
    """Struct (gap, whole): mean size of what target and residual leave of the mixture, and of the mixture."""
    sum_ = F.zip_with(target, residual, lambda x, y: x.cast("double") + y.cast("double"))
    return F.struct(waveform_l1(mixture, sum_).alias("gap"), mean_size(mixture).alias("whole"))


def mixture_consistency(gap: Column, whole: Column, eps: float = 1e-8) -> Column:
    """Aggregate over the parts of ``mixture_gap``."""
    return F.sum(gap) / (F.sum(whole) + eps)


def absent_energy(target: Column) -> Column:
    return F.try_divide(dot(target, target), F.size(target))


def activity_cross_entropy(activity: Column, labels: Column, *, logits: bool = False, eps: float = 1e-7) -> Column:
    """Mean over frames; labels of another length are first brought to the nearest frames.  Logits are taken without a
    sigmoid, so that large ones stay exact."""

    def of(pair: Column) -> Column:
        def one(x: Column, y: Column) -> Column:
            x, y = x.cast("double"), y.cast("double")
            if logits:
                return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
            p = clip(x, eps, 1 - eps)
            return -(y * F.ln(p) + (1 - y) * F.ln(1 - p))

        return mean_of(F.zip_with(pair["p"], pair["y"], one))

    same = F.size(activity) == F.size(labels)
    fitted = F.when(same, labels).otherwise(resample_labels(labels, F.size(activity)))
    return let(F.struct(activity.alias("p"), fitted.alias("y")), of)


def weighted_losses(rows: DataFrame, weights: dict[str, float], *, absent_scale: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """Terms and their total for each group.

    Rows: absent (boolean), si_sdr_db, wav_l1, mrstft, act_bce, res_l1, gap, whole.  Decibels count for present rows only (and
    enter the total with a minus); the next three weigh absent rows by ``absent_scale``; a term without any weight is 0.
    Names in ``weights``: the terms, mix among them."""
    if not 0.0 <= absent_scale <= 1.0:
        raise ValueError(f"absent_scale must lie in [0, 1], not {absent_scale}")
    scaled, here = F.when(F.col("absent"), absent_scale).otherwise(1.0), F.when(F.col("absent"), 0.0).otherwise(1.0)
    mean = lambda name, w: F.when(F.sum(w) > 0, F.sum(F.when(w > 0, F.col(name) * w)) / F.sum(w)).otherwise(0.0).alias(name)
    terms = rows.groupBy(*(by or [])).agg(mean("si_sdr_db", here), *[mean(c, scaled) for c in ("wav_l1", "mrstft", "act_bce")], F.avg("res_l1").alias("res_l1"), mixture_consistency(F.col("gap"), F.col("whole")).alias("mix"))
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(name) * (-weight if name == "si_sdr_db" else weight)
    return terms.withColumn("total", total)
