"""Vector and scalar expressions over arrays of float; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where body uses it for each element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, eps: float = 1e-9) -> Column:
    return let(norm(a) + eps, lambda size: F.transform(a, lambda v: v.cast("double") / size))


def cosine_of_units(a: Column, b: Column, eps: float = 1e-9) -> Column:
    """Product of the two vectors over their sizes, each size widened by ``eps``."""
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


def cosine_or_zero(a: Column, b: Column, least: float = 1e-8) -> Column:
    """0 where the product of sizes is below ``least`` or not finite."""
    return let(norm(a) * norm(b), lambda size: F.when((size >= least) & ~F.isnan(size) & (size < float("inf")), dot(a, b) / size).otherwise(0.0))


def cosine_checked(a: Column, b: Column, least: float = 1e-10) -> Column:
    """0 where either size is below ``least``."""
    return F.when((norm(a) < least) | (norm(b) < least), 0.0).otherwise(F.try_divide(dot(a, b), norm(a) * norm(b)))


def cosine_widened(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + eps)


def sigmoid(x: Column) -> Column:
    """Without overflow on either side."""
    z = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + z)).otherwise(z / (1 + z))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def adaptive_duration(seconds: Column) -> Column:
    return clip(seconds * 0.1, 0.3, 3.0)


def entropy(p: Column, eps: float = 1e-8) -> Column:
    """Of a binary variable, in nats."""
    q = clip(p, eps, 1 - eps)
    return -(q * F.ln(q) + (1 - q) * F.ln(1 - q))


def mean_of(a: Column) -> Column:
    return F.try_divide(_sum(a), F.size(a))


def rms(a: Column, eps: float = 1e-10) -> Column:
    return F.sqrt(F.try_divide(dot(a, a), F.size(a)) + eps)


def peak(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda v: F.abs(v.cast("double"))))


def clipping_ratio(a: Column, share: float = 0.95) -> Column:
    """Part of the samples within ``share`` of the peak; 0 for silence."""
    hit = lambda top: F.size(F.filter(a, lambda v: F.abs(v.cast("double")) >= top * share)).cast("double")
    return let(peak(a), lambda top: F.when(top >= 1e-6, F.try_divide(hit(top), F.size(a))).otherwise(0.0))


def clipped_ratio(a: Column, level: float = 0.99) -> Column:
    return F.try_divide(F.size(F.filter(a, lambda v: F.abs(v.cast("double")) >= level)).cast("double"), F.size(a))


def activity_mask(a: Column, level: float = 1e-4) -> Column:
    return F.transform(a, lambda v: F.when(F.abs(v.cast("double")) > level, 1).otherwise(0))


def delta_score(target: Column, residual: Column, target_ok: Column, residual_ok: Column) -> Column:
    return F.when(target_ok & residual_ok, target - residual)


def si_sdr_parts(estimate: Column, reference: Column, eps: float = 1e-8) -> Column:
    """Struct (signal, error) energies of the projection, means removed first (two passes, no cancellation)."""
    centred = lambda x: let(mean_of(x), lambda m: F.transform(x, lambda v: v.cast("double") - m))

    def parts(pair: Column) -> Column:
        e, r = pair["e"], pair["r"]

        def at(scale: Column) -> Column:
            error = _sum(F.zip_with(e, r, lambda x, y: (x - scale * y) * (x - scale * y)))
            return F.struct((scale * scale * dot(r, r)).alias("signal"), error.alias("error"))

        return let(dot(e, r) / (dot(r, r) + eps), at)

    return let(F.struct(centred(estimate).alias("e"), centred(reference).alias("r")), parts)


def decibel(signal: Column, error: Column, eps: float = 1e-8) -> Column:
    return 10 * F.log10(signal / (error + eps) + eps)


def si_sdr_loss(estimate: Column, reference: Column, eps: float = 1e-6) -> Column:
    """The training form: no means removed."""

    def at(scale: Column) -> Column:
        error = _sum(F.zip_with(estimate, reference, lambda x, y: (x.cast("double") - scale * y.cast("double")) * (x.cast("double") - scale * y.cast("double"))))
        return 10 * F.log10(scale * scale * dot(reference, reference) / (error + eps) + eps)

    return let(dot(estimate, reference) / (dot(reference, reference) + eps), at)


def waveform_l1(a: Column, b: Column) -> Column:
    return mean_of(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def energy_ratio(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, a) / (dot(b, b) + eps)


def activity_ratio(p: Column, level: float = 0.5) -> Column:
    return F.try_divide(F.size(F.filter(p, lambda v: v.cast("double") > level)).cast("double"), F.size(p))


def si_sdr_gain(estimate: Column, mixture: Column, reference: Column) -> Column:
    """Decibels that the estimate is nearer to the reference than the mixture was."""
    of = lambda x: let(si_sdr_parts(x, reference), lambda s: decibel(s["signal"], s["error"]))
    return of(estimate) - of(mixture)


def frames(a: Column, size: int, hop: int) -> Column:
    """Array of windows of ``size`` every ``hop``; one shorter window if the series is shorter."""
    n = F.size(a)
    starts = F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(hop))
    return F.when(n > 0, F.transform(starts, lambda s: F.slice(a, s + 1, size)))


def windows_with_tail(a: Column, size: int, hop: int) -> Column:
    """``frames`` and always the last ``size`` values once more."""
    n = F.size(a)
    tail = F.array(F.slice(a, F.greatest(n - size, F.lit(0)) + 1, size))
    return F.when(n > size, F.concat(frames(a, size, hop), tail)).otherwise(F.array(a))


def window_starts(n: Column, size: int, hop: int) -> Column:
    """Start positions with a final window that reaches the end."""
    return F.array_union(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(hop)), F.array(F.greatest(n - size, F.lit(0))))


def equal_parts(a: Column, k: int) -> Column:
    """k slices of equal length, the remainder on the last."""
    step = F.floor(F.size(a) / k).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i < k - 1, F.slice(a, i * step + 1, step)).otherwise(F.slice(a, i * step + 1, F.size(a) - i * step)))


def resample_labels(a: Column, m: Column) -> Column:
    """m labels, each the one nearest to its middle."""
    n = F.size(a)
    return F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.get(a, F.least(F.floor((i + 0.5) * n / m).cast("int"), n - 1)))


def crop_or_pad(a: Column, n: int) -> Column:
    return F.slice(F.concat(a, F.array_repeat(F.lit(0).cast("float"), n)), 1, n)


def tile_to(a: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(a, i % F.size(a)))


def place_at(a: Column, start: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.when(i >= start, F.get(a, F.greatest(i - start, F.lit(0)).cast("int"))), F.lit(0).cast("float")))


def weighted_median(pairs: Column) -> Column:
    """Of an array of structs (score, weight): the first score at which half the weight is reached; 0 if empty."""
    ordered = F.array_sort(pairs)
    total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["weight"].cast("double"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("hit"))

    def walk(all_: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            now = acc["sum"] + p["weight"].cast("double")
            return F.struct(now.alias("sum"), F.coalesce(acc["hit"], F.when(now >= all_ / 2, p["score"].cast("double"))).alias("hit"))

        return F.aggregate(ordered, start, step)["hit"]

    return F.coalesce(let(total, walk), F.lit(0.0))


def power_on_mask(a: Column, mask: Column) -> Column:
    held = F.zip_with(a, mask, lambda v, m: F.when(m > 0, v.cast("double") * v.cast("double")).otherwise(0.0))
    return F.coalesce(F.try_divide(_sum(held), _sum(F.transform(mask, lambda m: F.when(m > 0, 1.0).otherwise(0.0)))), F.lit(0.0))


def learning_rate(step: Column, base: float, warmup: int, total: int, shape: str = "cosine") -> Column:
    """Linear warm-up, then cosine, linear or constant."""
    import math

    rest = clip((step - warmup) / float(max(1, total - warmup)), 0.0, 1.0)
    after = {"cosine": 0.5 * (1 + F.cos(rest * math.pi)), "linear": 1 - rest, "constant": F.lit(1.0)}[shape]
    return F.when(step < warmup, base * (step + 1) / float(max(1, warmup))).otherwise(base * after)
