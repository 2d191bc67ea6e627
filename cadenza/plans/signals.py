"""Queries on short signals: vectors of the test tables stand for audio, their neighbours for references and other speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import levels, losses, mixing, signal
from ..functions import vectors as V
from ..operators import audit
from ..workspace import table
from .catalog import query
from .series import _NEIGHBOURS, _neighbours

_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_LEVELS = f"""{_E}, l AS (SELECT *, sqrt(list_inner_product(e, e) / len(e) + 1e-10) AS level, list_transform(range(0, len(e) // 8), lambda i: sqrt(list_inner_product(e[i * 8 + 1:i * 8 + 8], e[i * 8 + 1:i * 8 + 8]) / 8 + 1e-10)) AS fr FROM e),
s AS (SELECT *, 20 * log10(level / list_aggregate(fr, 'quantile_cont', 0.1)) AS snr, len(list_filter(fr, lambda x: x > 0.8 * level)) / len(fr) AS speech, len(list_filter(fr, lambda x: x > 0.1 * level)) / len(fr) AS speech_all FROM l)"""


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("e"))


def _rounded(digits: int = 6, **columns: Column) -> list[Column]:
    return [F.round(c, digits).alias(k) for k, c in columns.items()]


@query("V1 V3 V4", f"""WITH {_NEIGHBOURS}, p AS (SELECT vec_id, list_inner_product(e, r) AS er, sqrt(list_inner_product(e, e)) AS a, sqrt(list_inner_product(r, r)) AS b FROM nb)
SELECT vec_id, round(er / ((a + 1e-9) * (b + 1e-9)), 6) AS of_units, round(CASE WHEN a < 1e-10 OR b < 1e-10 THEN 0 ELSE er / (a * b) END, 6) AS checked, round(er / (a * b + 1e-8), 6) AS widened FROM p""")
def cosine_forms(spark: SparkSession, sf: str) -> DataFrame:
    e, r = F.col("e"), F.col("r")
    return _neighbours(spark, sf).select("vec_id", *_rounded(of_units=V.cosine_of_units(e, r), checked=V.cosine_checked(e, r), widened=V.cosine_widened(e, r)))


@query("V10 V12 W9", f"WITH {_LEVELS} SELECT vec_id, round(snr, 6) AS snr, round(speech, 6) AS speech FROM s")
def speech_levels(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("e")
    return _rows(spark, sf).select("vec_id", *_rounded(snr=levels.signal_to_noise(e, 8), speech=levels.speech_ratio(e, 8, 0.8)))


@query("V11 V13", f"""WITH {_LEVELS}, w AS (SELECT *, list_max(list_transform(e, lambda x: abs(x))) AS top, list_transform(range(0, 4), lambda i: e[i * 16 + 1:i * 16 + 16]) AS w FROM s),
p AS (SELECT *, len(list_filter(e, lambda x: abs(x) >= top * 0.95)) / len(e) AS clip, flatten(list_transform(range(1, 4), lambda i: list_transform(range(i + 1, 5), lambda j: list_inner_product(w[i], w[j]) / (sqrt(list_inner_product(w[i], w[i])) * sqrt(list_inner_product(w[j], w[j])) + 1e-10)))) AS c FROM w),
q AS (SELECT vec_id, [least(len(e) / 960.0, 1), speech_all, greatest(0, 1 - clip * 10), greatest(least(snr / 20, 1), 0), list_aggregate(c, 'quantile_cont', 0.5) * greatest(0, 1 - (list_aggregate(c, 'quantile_cont', 0.75) - list_aggregate(c, 'quantile_cont', 0.25)))] AS parts FROM p)
SELECT vec_id, round(exp(list_avg(list_transform(parts, lambda x: ln(greatest(least(x, 1), 0.01))))), 6) AS quality, round(parts[5], 6) AS consistency FROM q""")
def enroll_quality_score(spark: SparkSession, sf: str) -> DataFrame:
    parts = levels.enrolment_parts(F.col("e"), 320, V.equal_parts(F.col("e"), 4))
    return _rows(spark, sf).select("vec_id", *_rounded(quality=audit.quality_score(list(parts.values())), consistency=parts["consistency"]))


@query("W9 W8", f"""WITH {_E}, f AS (SELECT vec_id, len(e) AS n, unnest(range(0, len(e) // 4)) AS i, unnest(list_transform(range(0, len(e), 4), lambda s: sqrt(list_inner_product(e[s + 1:s + 8], e[s + 1:s + 8]) / len(e[s + 1:s + 8]) + 1e-20))) AS x FROM e),
a AS (SELECT *, CAST(x >= 0.7 * max(x) OVER (PARTITION BY vec_id) AS INT) AS a FROM f), g AS (SELECT *, i - row_number() OVER (PARTITION BY vec_id, a ORDER BY i) AS run FROM a),
b AS (SELECT vec_id, n, i, CASE WHEN a = 1 AND count(*) OVER (PARTITION BY vec_id, a, run) < 3 THEN 0 ELSE a END AS a FROM g), h AS (SELECT *, i - row_number() OVER (PARTITION BY vec_id, a ORDER BY i) AS run FROM b),
k AS (SELECT *, count(*) OVER w AS size, min(i) OVER w AS lo, max(i) OVER w AS hi, max(i) OVER (PARTITION BY vec_id) AS last FROM h WINDOW w AS (PARTITION BY vec_id, a, run)),
m AS (SELECT vec_id, n, i, CASE WHEN a = 0 AND size <= 2 AND lo > 0 AND hi < last THEN 1 ELSE a END AS a FROM k), t AS (SELECT vec_id, i * 4 + unnest(range(0, 8)) AS t, n FROM m WHERE a = 1),
c AS (SELECT vec_id, count(DISTINCT t) AS active, min(t) AS first FROM t WHERE t < n GROUP BY vec_id) SELECT vec_id, coalesce(active, 0) AS active, coalesce(first, -1) AS first FROM e LEFT JOIN c USING (vec_id)""")
def voice_activity(spark: SparkSession, sf: str) -> DataFrame:
    masks = _rows(spark, sf).select("vec_id", levels.level_activity(F.col("e"), 8, 4, 0.7).alias("m"))
    return masks.select("vec_id", F.size(F.filter("m", lambda v: v == 1)).cast("long").alias("active"), (F.array_position("m", 1) - 1).alias("first"))


_WEIGHTS = {"si_sdr_db": 0.5, "wav_l1": 2.0, "mrstft": 0.25, "act_bce": 0.5, "res_l1": 1.0, "mix": 0.1}
_LOSSES = f"""{_NEIGHBOURS}, k AS (SELECT *, list_inner_product(e, r) / (list_inner_product(r, r) + 1e-6) AS a, list_avg(list_transform(r, lambda x: abs(x))) AS size, list_avg(list_transform(e, lambda x: abs(x))) AS own,
  list_avg(list_transform(range(1, len(e) + 1), lambda i: abs(e[i] - r[i]))) AS gap, list_avg(list_transform(range(1, len(e) + 1), lambda i: abs(r[i] - e[i] - e[i] / 2))) AS left_, label % 3 = 0 AS absent FROM nb),
v AS (SELECT *, 10 * log10(a * a * list_inner_product(r, r) / (list_sum(list_transform(range(1, len(e) + 1), lambda i: (e[i] - a * r[i]) * (e[i] - a * r[i]))) + 1e-6) + 1e-6) AS si_sdr_db, CASE WHEN size < 0.1 THEN own ELSE gap END AS wav_l1, list_inner_product(e, e) / len(e) AS absent_energy,
  list_avg(list_transform(range(0, len(e)), lambda i: CASE WHEN r[i // 2 + 1] > 0 THEN -ln(least(greatest(abs(e[i + 1]), 1e-7), 1 - 1e-7)) ELSE -ln(1 - least(greatest(abs(e[i + 1]), 1e-7), 1 - 1e-7)) END)) AS act_bce,
  list_avg(list_transform(range(0, len(e)), lambda i: ln(1 + exp(e[i + 1])) - CASE WHEN r[i // 2 + 1] > 0 THEN e[i + 1] ELSE 0 END)) AS act_logits FROM k)"""


def _losses(spark: SparkSession, sf: str) -> DataFrame:
    e, r = F.col("e"), F.col("r")
    labels = F.transform(F.slice(r, 1, F.ceil(F.size(r) / 2).cast("int")), lambda v: F.when(v > 0, 1).otherwise(0))
    return _neighbours(spark, sf).select(
        "vec_id", "label", (F.col("label") % 3 == 0).alias("absent"), V.si_sdr_loss(e, r).alias("si_sdr_db"), losses.scale_sensitive_l1(e, r, 0.1).alias("wav_l1"), losses.absent_energy(e).alias("absent_energy"), losses.mean_size(e).alias("mrstft"),
        losses.activity_cross_entropy(F.transform(e, lambda v: F.abs(v)), labels).alias("act_bce"), losses.activity_cross_entropy(e, labels, logits=True).alias("act_logits"), V.waveform_l1(e, r).alias("res_l1"), losses.mixture_gap(e, F.transform(e, lambda v: v.cast("double") / 2), r).alias("g"),
    ).select("*", "g.*")


@query("V15 V18", f"WITH {_LOSSES} SELECT vec_id, round(si_sdr_db, 5) AS si_sdr_db, round(wav_l1, 6) AS wav_l1, round(absent_energy, 6) AS absent_energy, round(act_bce, 6) AS act_bce, round(act_logits, 6) AS act_logits, round(left_, 6) AS gap FROM v")
def vector_losses(spark: SparkSession, sf: str) -> DataFrame:
    return _losses(spark, sf).select("vec_id", F.round("si_sdr_db", 5).alias("si_sdr_db"), *[F.round(c, 6).alias(c) for c in ("wav_l1", "absent_energy", "act_bce", "act_logits", "gap")])


@query("V19 V18", f"""WITH {_LOSSES}, w AS (SELECT label // 2 AS fold, coalesce(sum(si_sdr_db) FILTER (NOT absent) / nullif(count(*) FILTER (NOT absent), 0), 0) AS sdr, sum(CASE WHEN absent THEN 0.25 ELSE 1 END) AS n, sum(wav_l1 * CASE WHEN absent THEN 0.25 ELSE 1 END) AS l, sum(own * CASE WHEN absent THEN 0.25 ELSE 1 END) AS m,
  sum(act_bce * CASE WHEN absent THEN 0.25 ELSE 1 END) AS b, avg(gap) AS res, sum(left_) / (sum(size) + 1e-8) AS mix FROM v GROUP BY label // 2)
SELECT fold, round(sdr, 5) AS si_sdr_db, round(l / n, 6) AS wav_l1, round(mix, 6) AS mix, round(-0.5 * sdr + 2 * l / n + 0.25 * m / n + 0.5 * b / n + res + 0.1 * mix, 5) AS total FROM w""")
def loss_composition(spark: SparkSession, sf: str) -> DataFrame:
    rows = _losses(spark, sf).withColumn("fold", F.floor(F.col("label") / 2).cast("int"))
    out = losses.weighted_losses(rows, _WEIGHTS, absent_scale=0.25, by=["fold"])
    return out.select("fold", F.round("si_sdr_db", 5).alias("si_sdr_db"), F.round("wav_l1", 6).alias("wav_l1"), F.round("mix", 6).alias("mix"), F.round("total", 5).alias("total"))


_MIX = f"""{_NEIGHBOURS}, o AS (SELECT vec_id, e, list_transform(range(0, len(e)), lambda i: r[i % 40 + 1]) AS o, r, list_filter(e, lambda x: abs(x) > 0.1) AS el, list_filter(r, lambda x: abs(x) > 0.1) AS rl, list_filter(range(1, len(e) + 1), lambda i: abs(e[i]) > 0.1 AND abs(r[i]) > 0.1) AS j FROM nb),
p AS (SELECT *, list_inner_product(e, e) / len(e) AS pe, list_inner_product(o, o) / len(o) AS po, list_sum(list_transform(j, lambda i: e[i] * e[i])) / len(j) AS je, list_sum(list_transform(j, lambda i: r[i] * r[i])) / len(j) AS jr FROM o),
m AS (SELECT *, list_transform(range(1, len(e) + 1), lambda i: e[i] + sqrt(pe / ((po + 1e-12) * 10 ** 0.5)) * o[i]) AS raw FROM p)"""


@query("V20 V21", f"""WITH {_MIX} SELECT vec_id, round(e[50] + sqrt((pe + 1e-12) / ((po + 1e-12) * 10 ** 0.5)) * o[50], 6) AS mixed, round(raw[50] / greatest(list_max(list_transform(raw, lambda x: abs(x))), 1e-9) * 0.9, 6) AS to_peak,
  round(r[7] * CASE WHEN len(el) > 0 AND len(rl) > 0 THEN (sqrt(list_inner_product(el, el) / len(el)) + 1e-8) / (sqrt(list_inner_product(rl, rl) / len(rl)) + 1e-8) * 10 ** -0.25 ELSE 1 END, 6) AS by_activity, round(CASE WHEN je > 1e-12 AND jr > 1e-12 THEN r[7] * sqrt(je / (jr * 10 ** 0.5)) END, 6) AS jointly FROM m""")
def mixtures(spark: SparkSession, sf: str) -> DataFrame:
    e, r, db = F.col("e"), F.col("r"), F.lit(5.0)
    at = lambda a, i: F.get(a, F.lit(i))
    return _neighbours(spark, sf).select("vec_id", *_rounded(
        mixed=at(mixing.mixed(e, F.slice(r, 1, 40), db), 49), to_peak=at(mixing.mixed_to_peak(e, F.slice(r, 1, 40), db), 49), by_activity=at(mixing.scaled_by_activity(e, r, db, 0.1), 6),
        jointly=at(mixing.scaled_jointly(e, r, V.activity_mask(e, 0.1), V.activity_mask(r, 0.1), db), 6),
    ))


_LAG = f"""{_NEIGHBOURS}, k AS (SELECT vec_id, list_transform(e, lambda x: CAST(abs(x) > 0.1 AS INT)) AS t, list_transform(r, lambda x: CAST(abs(x) > 0.1 AS INT)) AS o FROM nb),
c AS (SELECT vec_id, lag, list_sum(list_transform(range(0, len(t)), lambda i: CASE WHEN i - lag BETWEEN 0 AND len(o) - 1 THEN t[i + 1] * o[i - lag + 1] ELSE 0 END)) / list_sum(t) AS share, list_sum(t) * list_sum(o) > 0 AS some_ FROM k, range(-63, 64) x(lag)),
b AS (SELECT vec_id, arg_min(lag, (round(abs(least(greatest(share, 0), 1) - 0.3), 12), lag)) AS lag, min(round(abs(least(greatest(share, 0), 1) - 0.3), 12)) AS away FROM c WHERE some_ GROUP BY vec_id),
z AS (SELECT vec_id, list_sum(list_transform(range(1, len(t) + 1), lambda i: t[i] * o[i])) / nullif(list_sum(t), 0) AS overlap FROM k)"""


@query("V22 V29", f"WITH {_LAG} SELECT vec_id, round(overlap, 6) AS overlap, CASE WHEN away <= 0.01 THEN CAST(lag AS INTEGER) END AS lag FROM z LEFT JOIN b USING (vec_id)")
def overlap_lags(spark: SparkSession, sf: str) -> DataFrame:
    masks = _neighbours(spark, sf).select("vec_id", V.activity_mask(F.col("e"), 0.1).alias("t"), V.activity_mask(F.col("r"), 0.1).alias("o"))
    return masks.select("vec_id", *_rounded(overlap=mixing.overlap_ratio(F.col("t"), F.col("o"))), signal.best_lag("t", "o", F.lit(0.3)).alias("lag"))


_ROOM = f"""{_NEIGHBOURS}, k AS (SELECT *, list_position(list_transform(r, lambda x: abs(x)), list_max(list_transform(r, lambda x: abs(x)))) - 1 AS d FROM nb), c AS (SELECT *, r[d + 1:] AS h FROM k),
v AS (SELECT vec_id, list_sum(list_transform(range(0, least(len(h), 12)), lambda j: e[12 - j] * h[j + 1])) / (sqrt(list_inner_product(h, h)) + 1e-12) AS direct,
  list_sum(list_transform(range(0, len(r)), lambda j: CASE WHEN 11 + d - j BETWEEN 0 AND len(e) - 1 THEN e[12 + d - j] * r[j + 1] ELSE 0 END)) / (sqrt(list_inner_product(r, r)) + 1e-8) AS aligned FROM c)"""


@query("V23", f"WITH {_ROOM} SELECT vec_id, round(direct, 4) AS direct, round(aligned, 4) AS aligned FROM v")
def room_responses(spark: SparkSession, sf: str) -> DataFrame:
    direct, aligned = signal.convolve_room("e", "r"), signal.convolve_room_aligned(80)("e", "r")
    return _neighbours(spark, sf).select("vec_id", direct.alias("d"), aligned.alias("a")).select("vec_id", *_rounded(4, direct=F.get("d", F.lit(11)).cast("double"), aligned=F.get("a", F.lit(11)).cast("double")))


@query("V24 W11 W12", f"""WITH {_E} SELECT vec_id, round(list_sum(e[1:40]), 6) AS cropped, 80 AS padded, round(list_sum(e) + list_sum(e[1:36]), 6) AS tiled, round(list_sum(e[1:60]), 6) AS placed, round(e[3], 6) AS first_placed, '0,16,32,40' AS starts, '21,21,22' AS parts FROM e""")
def cut_and_place(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("e")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double"))
    joined = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ",")
    placed = V.place_at(e, F.lit(4), 64)
    return _rows(spark, sf).select("vec_id", *_rounded(cropped=total(V.crop_or_pad(e, 40)), tiled=total(V.tile_to(e, 100)), placed=total(placed), first_placed=F.get(placed, F.lit(6)).cast("double")), F.size(V.crop_or_pad(e, 80)).alias("padded"), joined(V.window_starts(F.size(e), 24, 16)).alias("starts"), joined(F.transform(V.equal_parts(e, 3), lambda p: F.size(p))).alias("parts"))


@query("V16", f"""WITH {_NEIGHBOURS}, z AS (SELECT vec_id, list_transform(e, lambda x: x - list_avg(e)) AS e, list_transform(r, lambda x: x - list_avg(r)) AS r, len(list_filter(e, lambda x: x > 0.05)) / len(e) AS active, list_avg(list_transform(range(1, len(e) + 1), lambda i: abs(e[i] - r[i]))) AS l1, len(list_filter(e, lambda x: abs(x) >= 0.2)) / len(e) AS clipped FROM nb),
k AS (SELECT *, list_transform(range(1, len(e) + 1), lambda i: e[i] + r[i]) AS s FROM z), a AS (SELECT *, list_inner_product(s, r) / (list_inner_product(r, r) + 1e-8) AS a, list_inner_product(e, r) / (list_inner_product(r, r) + 1e-8) AS b FROM k)
SELECT vec_id, round(10 * log10(a * a * list_inner_product(r, r) / (list_sum(list_transform(range(1, len(r) + 1), lambda i: (s[i] - a * r[i]) * (s[i] - a * r[i]))) + 1e-8) + 1e-8) - 10 * log10(b * b * list_inner_product(r, r) / (list_sum(list_transform(range(1, len(r) + 1), lambda i: (e[i] - b * r[i]) * (e[i] - b * r[i]))) + 1e-8) + 1e-8), 4) AS gain,
  round(active, 6) AS active, round(l1, 6) AS l1, round(clipped, 6) AS clipped FROM a""")
def separation_gain(spark: SparkSession, sf: str) -> DataFrame:
    e, r = F.col("e"), F.col("r")
    estimate = F.zip_with(e, r, lambda x, y: x.cast("double") + y.cast("double"))
    rows = _neighbours(spark, sf).select("vec_id", F.round(V.si_sdr_gain(estimate, e, r), 4).alias("gain"), *_rounded(active=V.activity_ratio(e, 0.05), l1=V.waveform_l1(e, r), clipped=V.clipped_ratio(F.transform(e, lambda v: v.cast("double")), 0.2)))
    return rows


@query("W10 W14", f"""WITH {_E}, w AS (SELECT vec_id, e, [0, 20, 40, len(e) - 24] AS starts FROM e)
SELECT vec_id, round(list_max(list_transform(starts, lambda s: list_sum(e[s + 1:s + 24]))), 6) AS loudest, 4 AS windows, array_to_string(list_transform(range(0, 10), lambda i: CAST(e[CAST(floor((i + 0.5) * 64 / 10) AS INTEGER) + 1] > 0 AS INTEGER)), '') AS labels FROM w""")
def windows_and_labels(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("e")
    cut = V.windows_with_tail(e, 24, 20)
    sums = F.transform(cut, lambda w: F.aggregate(w, F.lit(0.0), lambda s, v: s + v.cast("double")))
    labels = V.resample_labels(F.transform(e, lambda v: F.when(v > 0, 1).otherwise(0)), F.lit(10))
    return _rows(spark, sf).select("vec_id", *_rounded(loudest=F.array_max(sums)), F.size(cut).alias("windows"), F.array_join(F.transform(labels, lambda v: v.cast("string")), "").alias("labels"))
