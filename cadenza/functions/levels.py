"""Levels of framed audio as expressions: noise estimate, speech share, activity by level, quality of an enrolment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import clip, clipping_ratio, cosine_widened, let, rms

# Fixed values of the published estimate: ratios told for silence, for too few frames, and for frames without noise.
SILENT_DB, UNKNOWN_DB, CLEAN_DB = 0.0, 10.0, 20.0
SILENCE = 1e-6


def quantile(values: Column, share: float) -> Column:
    """Of an array, with linear interpolation; null if it is empty."""

    def at(ordered: Column) -> Column:
        place = (F.size(ordered) - 1) * F.lit(share)
        low = F.floor(place).cast("int")
        below, above = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
        return below + (above - below) * (place - low)

    return let(F.array_sort(values), at)


def frame_levels(a: Column, size: int, eps: float = 1e-10) -> Column:
    """Root mean squares of the whole frames of ``size`` samples, side by side; what is left over at the end isn't used."""
    n = F.floor(F.size(a) / size).cast("int")
    levels = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: rms(F.slice(a, i * size + 1, size), eps))
    return F.when(n > 0, levels).when(n.isNotNull(), F.array().cast("array<double>"))


def signal_to_noise(a: Column, size: int = 400, least_frames: int = 4) -> Column:
    """Decibels of the whole over the tenth percentile of its frames.  Null audio gives null, empty audio the value for too
    few frames."""
    own = rms(a)

    def of(levels: Column) -> Column:
        noise = F.coalesce(quantile(F.filter(levels, lambda v: v > 1e-8), 0.1), F.lit(SILENCE))
        told = F.when(own < SILENCE, SILENT_DB).when(F.size(levels) < least_frames, UNKNOWN_DB)
        return let(noise, lambda x: told.when(x < SILENCE, CLEAN_DB).otherwise(20 * F.log10(own / x)))

    return F.when(a.isNotNull(), let(frame_levels(a, size), of))


def speech_ratio(a: Column, size: int = 400, share: float = 0.1) -> Column:
    """Part of the frames above ``share`` of the whole's level; 0 without a frame."""

    def of(floor: Column) -> Column:
        levels = frame_levels(a, size)
        return F.coalesce(F.try_divide(F.size(F.filter(levels, lambda v: v > floor)).cast("double"), F.size(levels)), F.lit(0.0))

    return F.when(a.isNotNull(), let(rms(a) * share, of))


def level_activity(a: Column, size: int = 400, hop: int = 160, share: float = 0.01, least: int = 3, gap: int = 2) -> Column:
    """0/1 by sample: frames (the last ones cut short) of at least ``share`` of the loudest, without active runs shorter than
    ``least``, inner gaps of up to ``gap`` frames filled.  All 0 for silence, empty for empty audio."""
    n = F.size(a)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(hop))
    levels = F.transform(starts, lambda s: rms(F.slice(a, s + 1, size), 1e-20))
    on = let(levels, lambda xs: let(F.array_max(xs), lambda top: F.transform(xs, lambda v: (top > 1e-10) & (v >= top * share))))
    at = lambda xs, i: F.coalesce(F.get(xs, i), F.lit(False))
    both = lambda terms: reduce(lambda p, q: p & q, terms)
    some = lambda terms: reduce(lambda p, q: p | q, terms)
    # A frame lies in a long enough run if one of the windows of ``least`` frames around it is active throughout.
    long_ = let(on, lambda xs: F.transform(xs, lambda _, i: some([both([at(xs, i - k + j) for j in range(least)]) for k in range(least)])))
    sides = [(left, right) for left in range(1, gap + 1) for right in range(1, gap + 2 - left)]
    full = let(long_, lambda xs: F.transform(xs, lambda v, i: some([v, *[at(xs, i - left) & at(xs, i + right) for left, right in sides]])))

    def spread(xs: Column) -> Column:
        def sample(t: Column) -> Column:
            first = F.greatest(F.floor((t - size) / hop) + 1, F.lit(0)).cast("int")
            last = F.floor(t / hop).cast("int")
            return F.array_contains(F.slice(xs, first + 1, F.greatest(last - first + 1, F.lit(0))), True).cast("int")

        return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), sample)

    return F.when(n > 0, let(full, spread)).when(a.isNotNull(), F.array().cast("array<int>"))


def window_consistency(windows: Column) -> Column:
    """Median cosine of all pairs of window vectors, less where their quartiles lie apart; null for fewer than two."""
    pairs = F.flatten(F.transform(windows, lambda a, i: F.transform(F.slice(windows, i + 2, F.size(windows)), lambda b: cosine_widened(a, b, 1e-10))))
    return let(pairs, lambda p: quantile(p, 0.5) * F.greatest(F.lit(0.0), 1 - (quantile(p, 0.75) - quantile(p, 0.25))))


def enrolment_parts(a: Column, rate: int = 16_000, windows: Column | None = None, valid: Column | None = None) -> dict[str, Column]:
    """The five components, for ``audit.quality_score``.  ``windows``: vectors of the audio's windows, ``valid``: how many of
    them count (all, by default); without two valid ones consistency is unknown and counts as 0.8."""
    size = max(1, int(0.025 * rate))
    steady = F.lit(0.8)
    if windows is not None:
        enough = (F.size(windows) > 1) & ((F.size(windows) if valid is None else valid) >= 2)
        steady = F.coalesce(F.when(enough, window_consistency(windows)), steady)
    return {
        "duration": F.least(F.size(a) / (3.0 * rate), F.lit(1.0)), "speech": speech_ratio(a, size), "clipping": F.greatest(F.lit(0.0), 1 - clipping_ratio(a) * 10),
        "noise": clip(signal_to_noise(a, size) / 20, 0.0, 1.0), "consistency": steady,
    }
