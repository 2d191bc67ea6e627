"""Queries on field rules, decisions over trials, joins with scored items, reports and delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, corpus, metrics, paired, policy, relational, sequences
from ..sources import documents, readers, sinks
from ..workspace import table
from . import views
from .audits import _AUDIT, _EVIDENCE, _evidence
from .catalog import query
from .decisions import _ITEMS, _RATES, _SWEEP, _items, _sweep, policy_simulation

# Fixed values of this file's own reading dictionary: one reading for each digit and unit.
READINGS = {"零": "ling", "一": "yi", "二": "er", "三": "san", "四": "si", "五": "wu", "六": "liu", "七": "qi", "八": "ba", "九": "jiu", "十": "shi"}


@query("D16", f"""WITH {_EVIDENCE} SELECT event_id, q_enroll, round(activity_mean, 6) AS activity_mean, event_id % 40 / 10.0 AS target_activity_duration, CASE WHEN valid_tgt_sv THEN round(s_tgt, 6) END AS s_tgt, NOT valid_tgt_sv AS s_tgt_missing, energy_ratio AS target_energy_ratio, valid_tgt_sv FROM ev""")
def identity_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = _evidence(spark, sf).withColumns({"activity_seconds": F.col("event_id") % 40 / 10.0, "s_tgt": F.when(F.col("valid_tgt_sv"), F.round("s_tgt", 6)), "activity_mean": F.round("activity_mean", 6)})
    return rows.select("event_id", audit.identity_vector().alias("v")).select("event_id", "v.*")


_WINDOWED = _AUDIT.replace("event_id % 3 AS valid_window_count", "least(event_id % 3, event_id % 4 + 1) AS valid_window_count")


@query("D19 D17", f"""WITH {_WINDOWED}, r AS (SELECT event_id, audit_state, CASE WHEN event_id % 9 = 0 THEN 'ASR_EMPTY' WHEN identity_score IS NULL THEN 'IDENTITY_SCORE_MISSING' WHEN identity_score < 0.5 THEN 'IDENTITY_BELOW_FLOOR' WHEN identity_score = 0.5 THEN 'IDENTITY_AT_FLOOR_EQUALITY' ELSE 'IDENTITY_ABOVE_FLOOR' END AS reason FROM a)
SELECT event_id, audit_state, CASE audit_state WHEN 'PRESENT' THEN 'EMIT' WHEN 'GRAY' THEN CASE WHEN reason = 'IDENTITY_ABOVE_FLOOR' THEN 'EMIT' ELSE 'EMPTY' END ELSE 'EMPTY' END AS decided_action, CASE WHEN audit_state = 'GRAY' THEN reason END AS decided_reason FROM r""")
def audit_then_decide(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    windows = F.transform(F.sequence(F.lit(1).cast("bigint"), i % 4 + 1), lambda w: F.struct(F.lit(0.5).alias("score"), (w <= i % 3).alias("valid")))
    rows = _evidence(spark, sf).drop("window_count", "valid_window_count").withColumns({"windows": windows, "asr_text": F.when(i % 9 == 0, " ").otherwise("x")})
    return audit.audit_and_decide(rows).select("event_id", "audit_state", "decided_action", "decided_reason")


_SCENES = ["single", "absent", "enroll_swap_absent", "enroll_swap_target_1", "overlap"]


@query("P8 P9 P7", f"""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN {_SCENES}[CAST(o_orderkey % 5 AS INTEGER) + 1] END AS scenario, [NULL, '1', 'True', '0'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS flag, CASE WHEN o_orderkey % 7 = 0 THEN 'a.wav' WHEN o_orderkey % 7 = 1 THEN '' END AS wav, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus <> 'F' END AS present FROM orders),
k AS (SELECT o_orderkey, present, coalesce(contains(scenario, 'enroll_swap'), false) OR coalesce(flag IN ('true', 'True', '1'), false) OR coalesce(wav, '') <> '' AS swap, coalesce(scenario IN ('absent', 'enroll_swap_absent'), false) AS absent FROM s)
SELECT o_orderkey, swap, CASE WHEN present IS NOT NULL THEN NOT present ELSE absent OR swap END AS zero FROM k""")
def swap_and_zero(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    scenario = F.when(key % 6 != 0, corpus.scenario_by_position(key, _SCENES))
    flag, wav = corpus.scenario_by_position(key, [None, "1", "True", "0"]), F.when(key % 7 == 0, "a.wav").when(key % 7 == 1, "")
    rows = table(spark, sf, "orders").select("o_orderkey", scenario.alias("scenario"), flag.alias("flag"), wav.alias("wav"), F.when(key % 3 == 0, F.col("o_orderstatus") != "F").alias("present"))
    swap = corpus.is_swap(F.col("scenario"), F.col("flag"), F.col("wav"))
    absent = corpus.kind_of_entry(F.lit(None).cast("boolean"), F.col("scenario"), F.lit(None).cast("boolean"), F.lit(1))
    return rows.select("o_orderkey", swap.alias("swap"), corpus.force_zero(F.col("present"), absent, swap).alias("zero"))


_SCORED = f"{_SWEEP}, sc AS (SELECT threshold, round(40 * (1 - frr) + 40 * (1 - far), 6) AS score_80, round(1 - far, 6) AS rr, round(frr, 6) AS cer FROM rates)"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    rr = 1 - F.col("far")
    return _sweep(spark, sf).select("threshold", F.round(policy.objective_80(F.col("frr"), rr), 6).alias("score_80"), F.round(rr, 6).alias("rr"), F.round("frr", 6).alias("cer"))


@query("O3", f"WITH {_SCORED} SELECT * FROM sc ORDER BY score_80 DESC, rr DESC, threshold LIMIT 10")
def threshold_table(spark: SparkSession, sf: str) -> DataFrame:
    return policy.threshold_table(_scored(spark, sf))


@query("O6", f"WITH {_SCORED} SELECT * FROM sc ORDER BY cer DESC, score_80 DESC, threshold DESC LIMIT 7")
def tuple_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return policy.by_tuple(_scored(spark, sf), ["cer", "score_80", "threshold"]).limit(7)


@query("O5 D4", f"""WITH {_ITEMS}, x AS (SELECT *, sim >= sv AND intent_dist <= it AS ok FROM items, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]) AS sv), (SELECT unnest([0.3, 0.5, 0.7, 0.9]) AS it)), p AS (SELECT sv, it AS intent, {_RATES} FROM x GROUP BY sv, it)
SELECT CAST(sv AS DOUBLE) AS sv, CAST(intent AS DOUBLE) AS intent, round(40 * (1 - cer) + 40 * rr, 4) AS score FROM p ORDER BY score DESC, sv, intent LIMIT 12""")
def top_policies(spark: SparkSession, sf: str) -> DataFrame:
    rows = policy_simulation(spark, sf).select("sv", "intent", F.round(policy.objective_80(F.col("cer"), F.col("rr")), 4).alias("score"))
    return policy.top_policies(rows, "score", ["sv", "intent"])


@query("D6 P13", f"WITH {_ITEMS} SELECT vec_id, split, sim >= 0.4 AS hard, sim >= 0.4 AND intent_dist <= 0.7 AS filtered, sim - 0.7 * intent_dist >= 0.1 AS fused, 1 / (1 + exp(-sim)) >= 0.55 AS gated, sim <= 0.3 AS purify FROM items")
def gate_decisions(spark: SparkSession, sf: str) -> DataFrame:
    s, d = F.col("sim"), F.col("intent_dist")
    rules = {"hard": policy.decision(s, d, threshold=0.4), "filtered": policy.decision(s, d, threshold=0.4, intent_limit=0.7), "fused": policy.decision(s, d, threshold=0.1, fusion_weight=0.7, intent_limit=0.7)}
    gated = policy.decision(s, d, threshold=0.9, gate_probability=1 / (1 + F.exp(-s)), gate_threshold=0.55)
    return _items(spark, sf).select("vec_id", "split", *[c.alias(k) for k, c in rules.items()], gated.alias("gated"), policy.should_purify(s, 0.3).alias("purify"))


_PRICED = "i AS (SELECT o_custkey AS c_custkey, arg_max(CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END, o_orderkey) AS a, max(o_orderkey) AS last FROM orders GROUP BY o_custkey), s AS (SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice AS score FROM orders JOIN i ON i.c_custkey = o_custkey AND last = o_orderkey WHERE o_orderkey % 4 <> 0)"


@query("J6 S9", f"WITH {_PRICED} SELECT c_custkey, score FROM customer LEFT JOIN s USING (c_custkey)")
def scored_items(spark: SparkSession, sf: str) -> DataFrame:
    items = readers.read_cache(spark, f"{sf}/orders.parquet", "o_custkey bigint, o_orderkey bigint, o_totalprice double").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("score"))
    rows = table(spark, sf, "customer").select("c_custkey")
    args = (rows, items, ["c_custkey"], "score", "o_orderkey")
    return relational.scored(*args).select("c_custkey", "score").unionByName(relational.unscored(*args).select("c_custkey", F.lit(None).cast("double").alias("score")))


@query("J10", "WITH p AS (SELECT l_orderkey AS sample_id, string_agg(['B0', 'B1', 'B2'][CAST(l_linenumber % 3 AS INTEGER) + 1], ',' ORDER BY ['B0', 'B1', 'B2'][CAST(l_linenumber % 3 AS INTEGER) + 1]) AS conditions FROM lineitem GROUP BY l_orderkey) SELECT * FROM p WHERE conditions <> 'B0,B1,B2'")
def incomplete_samples(spark: SparkSession, sf: str) -> DataFrame:
    names = ["B0", "B1", "B2"]
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_id"), corpus.scenario_by_position(F.col("l_linenumber"), names).alias("condition"))
    return paired.incomplete(rows, names).select("sample_id", F.array_join("conditions", ",").alias("conditions"))


@query("J16", "SELECT o_custkey, count(DISTINCT coalesce(o_orderstatus, '') || '|' || coalesce(o_orderpriority, '')) <= 1 AS agreed FROM orders GROUP BY o_custkey")
def summaries_agree(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders")
    return rows.groupBy("o_custkey").agg(relational.agree(rows, ["o_orderstatus", "o_orderpriority"]).alias("agreed"))


@query("A8 A10", """SELECT o_custkey, count(o_totalprice) AS n, min(o_totalprice) AS least, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr, max(o_totalprice) AS most FROM orders GROUP BY o_custkey""")
def value_profiles(spark: SparkSession, sf: str) -> DataFrame:
    got = table(spark, sf, "orders").groupBy("o_custkey").agg(*metrics.profile("o_totalprice"))
    return got.select("o_custkey", "n", "least", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), F.round(F.col("q3") - F.col("q1"), 4).alias("iqr"), "most")


@query("P3", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 10")
def manifest_page(spark: SparkSession, sf: str) -> DataFrame:
    return relational.page(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 10, 25)


@query("P2", "SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END, ''), nullif(CASE WHEN p_size % 2 = 0 THEN p_type END, ''), p_name) AS label, coalesce(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END, p_name) AS kept_empty FROM part")
def coalesced_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").withColumns({"a": F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")), "b": F.when(F.col("p_size") % 2 == 0, F.col("p_type"))})
    return rows.select("p_partkey", relational.aliased("a", "b", "p_name").alias("label"), relational.aliased("a", "p_name", empty_counts=True).alias("kept_empty"))


_PREFIX = ["", "/", "../", "a/../", "C:", "a..b/", "x/.."]


@query("P12", f"""WITH p AS (SELECT p_partkey, {_PREFIX}[CAST(p_partkey % 7 AS INTEGER) + 1] || CASE WHEN p_partkey % 7 = 6 THEN '' ELSE p_brand END AS path FROM part)
SELECT p_partkey, path, path LIKE '/%' OR path LIKE '\\%' OR regexp_matches(path, '^[A-Za-z]:') OR list_contains(regexp_split_to_array(path, '[/\\\\]'), '..') AS unsafe FROM p""")
def unsafe_paths(spark: SparkSession, sf: str) -> DataFrame:
    rest = F.when(F.col("p_partkey") % 7 == 6, "").otherwise(F.col("p_brand"))
    rows = table(spark, sf, "part").select("p_partkey", F.concat(corpus.scenario_by_position(F.col("p_partkey"), _PREFIX), rest).alias("path"))
    return rows.select("p_partkey", "path", T.unsafe_path(F.col("path")).alias("unsafe"))


@query("F8 F15 F19", r"""WITH c AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '[\s\p{Z}\x{85}\x0B]', '', 'g') AS t FROM conversations) SELECT conv_id, turn, sha256(t) AS sha, md5(t) AS md5, length(t) AS n, '{"turn":' || turn || ',"role":"' || role || '"}' AS json FROM c""")
def compact_digests(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").withColumn("t", T.compact(F.col("text")))
    sent = F.from_json(F.to_json(F.struct("turn", "role")), "turn bigint, role string")
    return rows.select("conv_id", "turn", F.sha2("t", 256).alias("sha"), F.md5("t").alias("md5"), F.length("t").cast("long").alias("n"), F.to_json(sent).alias("json"))


_SAID = "string_split('" + ",".join(READINGS.values()) + "', ',')"


@query("F9 F5", f"SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size >= 20 THEN {_SAID}[p_size // 10 + 1] END, CASE WHEN p_size >= 10 THEN 'shi' END, CASE WHEN p_size < 10 OR p_size % 10 > 0 THEN {_SAID}[p_size % 10 + 1] END], lambda x: x IS NOT NULL), ' ') AS said FROM part")
def readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.syllables(T.num_to_zh(F.col("p_size").cast("string")), READINGS).alias("said"))


@query("W18", """SELECT user_id, event_id, row_number() OVER w AS step, CAST(sum(event_id % 10) OVER w AS BIGINT) AS seen, row_number() OVER w % 4 = 0 AS save, row_number() OVER w % 7 = 0 AS evaluate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def step_triggers(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", (F.col("event_id") % 10).alias("k"))
    return sequences.counted_steps(rows, ["user_id"], ["ts", "event_id"], {"save": 4, "evaluate": 7}, {"seen": "k"}).drop("ts", "k")


_HEX = "CAST(('0x' || substr(sha256('{}:' || o_orderkey), 1, 12)) AS BIGINT) / 281474976710656"


@query("D24", f"""WITH u AS (SELECT o_orderkey, CAST(floor({_HEX.format('sir/bucket')} * 3) AS INTEGER) AS b, {_HEX.format('sir/value')} AS v FROM orders) SELECT o_orderkey, round([-5.0, 0.0, 5.0][b + 1] + v * ([0.0, 5.0, 15.0][b + 1] - [-5.0, 0.0, 5.0][b + 1]), 6) AS sir FROM u""")
def bucketed_draws(spark: SparkSession, sf: str) -> DataFrame:
    draw = corpus.bucketed_draw(F.col("o_orderkey"), "sir", [(-5, 0), (0, 5), (5, 15)])
    return table(spark, sf, "orders").select("o_orderkey", F.round(draw, 6).alias("sir"))


@query("U2", "SELECT c_custkey AS key, 'train' AS split FROM customer UNION ALL SELECT -1 - s_suppkey, 'test' FROM supplier")
def combined_manifests(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.lit("train").alias("split"))
    return relational.combined([a, table(spark, sf, "supplier").select((-1 - F.col("s_suppkey")).alias("key"), F.lit("test").alias("split"))], "key")


@query("S14", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'b/' || p_partkey || '.wav' WHEN p_partkey % 3 = 1 THEN 'a/' || p_partkey END AS resolved FROM part")
def resolved_paths(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("p_partkey").cast("string")
    rows = table(spark, sf, "part").select("p_partkey", name.alias("path"))
    there = rows.select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("b/"), "path", F.lit(".wav"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("a/"), "path")).alias("path")).filter("path IS NOT NULL")
    listing = there.unionByName(rows.filter("p_partkey % 3 = 1").select(F.concat(F.lit("b/"), "path").alias("path")))
    return readers.resolve_paths(rows, "path", ["a/", "b"], listing).select("p_partkey", "resolved")


_FILES = "f AS (SELECT 'd/' || doc_id || '.txt' AS path, sha256(coalesce(text, '')) AS sha256, doc_id FROM documents)"


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("root/d/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return sinks.ledger(table(spark, sf, "documents").select(name.alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")), root="root")


@query("K9", f"WITH {_FILES} SELECT path, sha256 FROM f")
def file_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return _ledger(spark, sf)


@query("K12", f"WITH {_FILES} SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'missing' ELSE 'differs' END AS problem FROM f WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def delivery_problems(spark: SparkSession, sf: str) -> DataFrame:
    number = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    got = _ledger(spark, sf).withColumn("n", number)
    present = got.filter("n % 5 <> 0").select("path", F.when(F.col("n") % 7 == 0, "0").otherwise(F.col("sha256")).alias("sha256"))
    return sinks.missing_files(got.drop("n"), present)


@query("K10", f"WITH {_FILES}, n AS (SELECT *, (row_number() OVER (ORDER BY path) - 1) // 4096 AS g FROM f), d AS (SELECT g, sha256(string_agg(sha256 || '  ' || path, chr(10) ORDER BY path)) AS d FROM n GROUP BY g) SELECT unnest(['VERSION', 'SCHEMA', 'FROZEN']) AS name, unnest(['v1', 'doc_id: bigint' || chr(10) || 'lang: string', (SELECT CASE WHEN count(*) = 1 THEN min(d) ELSE sha256(string_agg(d, chr(10) ORDER BY g)) END FROM d)]) AS value")
def release_notes(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.provenance(table(spark, sf, "documents").select("doc_id", "lang"), "v1", _ledger(spark, sf))


@query("D10", """WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('split:7:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, r <= greatest(1, least(n - 1, CAST(round_even(n * CAST(0.8 AS DOUBLE), 0) AS BIGINT))) AS train FROM r""")
def class_split(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.shuffled_split(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id", 0.8, 7)


@query("D26", """SELECT * FROM (SELECT unnest(['ratio', 'share', 'price']) AS term, unnest([count(*) FILTER (p_size % 7 = 0 OR p_size % 5 = 0), count(*) FILTER (p_size % 3 = 0), 0]) AS n FROM part) WHERE n > 0""")
def non_finite_terms(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    ratio = F.when(size % 7 == 0, F.lit(float("inf"))).when(size % 5 == 0, F.lit(float("nan"))).otherwise(1.0)
    terms = table(spark, sf, "part").select(ratio.alias("ratio"), F.when(size % 3 != 0, 0.5).alias("share"), F.col("p_retailprice").alias("price"))
    return documents.non_finite_terms(terms, ["ratio", "share", "price"])


@query("K7 K8", "SELECT 'wav.scp' AS file, p_partkey || ' wav/' || p_brand AS value FROM part UNION ALL SELECT 'text', p_partkey || ' ' || p_name FROM part UNION ALL SELECT 'predictions', '{\"id\":' || p_partkey || ',\"content\":\"' || CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END || '\"}' FROM part")
def delivered_lines(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    paths, texts = sinks.kaldi_lines(part.select(F.col("p_partkey").alias("utt"), F.concat(F.lit("wav/"), "p_brand").alias("path"), F.col("p_name").alias("text")))
    free = sinks.label_free(part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("content"), "p_brand")).select(F.to_json(F.struct("id", "content")).alias("value"))
    named = [f.select(F.lit(n).alias("file"), "value") for n, f in (("wav.scp", paths), ("text", texts), ("predictions", free))]
    return named[0].unionByName(named[1]).unionByName(named[2])
