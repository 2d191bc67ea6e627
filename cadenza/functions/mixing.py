"""Mixtures at a power ratio: what is summed, over which samples power is taken, and how the result is scaled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import dot, let, peak, power_on_mask


def looped(a: Column, n: Column) -> Column:
    """n values, from the start again after the end."""
    return F.when(F.size(a) >= n, F.slice(a, 1, n)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get(a, i % F.size(a))))


def _power(a: Column) -> Column:
    return F.try_divide(dot(a, a), F.size(a))


def _gain(target: Column, other: Column, decibels: Column) -> Column:
    return F.sqrt(target / (other * F.pow(F.lit(10.0), decibels / 10)))


def _sum(target: Column, other: Column, gain: Column) -> Column:
    return let(gain, lambda g: F.zip_with(target, other, lambda x, y: x.cast("double") + g * y.cast("double")))


def mixed(target: Column, other: Column, decibels: Column, eps: float = 1e-12) -> Column:
    """Target and other (looped or cut to its length), both powers widened by ``eps``; the result keeps its scale."""
    return let(looped(other, F.size(target)), lambda o: _sum(target, o, _gain(_power(target) + eps, _power(o) + eps, decibels)))


def mixed_to_peak(target: Column, other: Column, decibels: Column, top: float = 0.9, eps: float = 1e-12) -> Column:
    """As ``mixed`` with the target's own power, scaled so that the peak is ``top``."""
    raw = let(looped(other, F.size(target)), lambda o: _sum(target, o, _gain(_power(target), _power(o) + eps, decibels)))
    return let(raw, lambda m: let(F.greatest(peak(m), F.lit(1e-9)), lambda p: F.transform(m, lambda v: v / p * top)))


def scaled_by_activity(target: Column, other: Column, decibels: Column, level: float = 1e-4, eps: float = 1e-8) -> Column:
    """Other, scaled by levels over the active samples of each; unchanged if either has none."""
    loud = lambda a: F.filter(a, lambda v: F.abs(v.cast("double")) > level)
    size = lambda a: F.sqrt(_power(a)) + eps

    def of(pair: Column) -> Column:
        gain = F.when((F.size(pair["t"]) > 0) & (F.size(pair["o"]) > 0), size(pair["t"]) / size(pair["o"]) * F.pow(F.lit(10.0), -decibels / 20)).otherwise(1.0)
        return let(gain, lambda g: F.transform(other, lambda v: v.cast("double") * g))

    return let(F.struct(loud(target).alias("t"), loud(other).alias("o")), of)


def scaled_jointly(target: Column, other: Column, target_mask: Column, other_mask: Column, decibels: Column, least: float = 1e-12) -> Column:
    """Other, scaled by powers over the samples at which both are active; null if either has no power there."""
    joint = F.zip_with(target_mask, other_mask, lambda x, y: ((x > 0.5) & (y > 0.5)).cast("int"))

    def of(mask: Column) -> Column:
        t, o = power_on_mask(target, mask), power_on_mask(other, mask)
        return let(F.when((t > least) & (o > least), _gain(t, o, decibels)), lambda g: F.when(g.isNotNull(), F.transform(other, lambda v: v.cast("double") * g)))

    return let(joint, of)


def overlap_ratio(target_mask: Column, other_mask: Column) -> Column:
    """Share of the target's active samples at which the other is active too; null without any."""
    hit = F.zip_with(target_mask, other_mask, lambda x, y: F.when((x > 0.5) & (y > 0.5), 1.0).otherwise(0.0))
    count = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(count(hit), count(F.transform(target_mask, lambda v: F.when(v > 0.5, 1.0).otherwise(0.0))))
