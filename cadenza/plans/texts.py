"""Queries on text: alignment, normalisation, phrases and commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import matching, metrics
from ..workspace import table
from . import views
from .catalog import query

_BANK = "bank AS (SELECT phrase, min(ord) AS ord FROM (SELECT p_partkey AS ord, p_name AS phrase FROM part WHERE p_size <= 10) GROUP BY phrase)"
_HYPS = "hyps AS (SELECT DISTINCT replace(replace(p_name, 'e', ''), 'i', '') || CASE WHEN p_size % 3 = 0 THEN 'x' ELSE '' END AS text FROM part)"
_NEAREST = f"""{_BANK}, {_HYPS}, near AS (SELECT text, arg_min(phrase, (score, ord)) AS phrase, min(score) AS distance FROM (
  SELECT text, phrase, ord, CAST(levenshtein(text, phrase) AS DOUBLE) / greatest(length(text), length(phrase)) AS score FROM hyps, bank WHERE text <> '') GROUP BY text)"""


def _bank(spark: SparkSession, sf: str) -> DataFrame:
    return matching.phrase_bank(table(spark, sf, "part").filter("p_size <= 10"), "p_partkey", "p_name")


def _hyps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr("replace(replace(p_name, 'e', ''), 'i', '') || CASE WHEN p_size % 3 = 0 THEN 'x' ELSE '' END AS text").distinct()


@query("F2 A1 A2", f"""WITH {views.ALIGNED} SELECT split, count(*) AS pairs, CAST(sum(s) AS BIGINT) AS substitutions, CAST(sum(d) AS BIGINT) AS deletions, CAST(sum(i) AS BIGINT) AS insertions, CAST(sum(n) AS BIGINT) AS reference_chars,
  round(CAST(sum(errors) AS DOUBLE) / sum(n), 6) AS corpus_cer, round(avg(round_even(CAST(errors AS DOUBLE) / n, 4)), 4) AS sentence_cer FROM pairs JOIN sdi USING (ref, hyp) GROUP BY split""")
def corpus_cer_by_split(spark: SparkSession, sf: str) -> DataFrame:
    *sums, ratio = metrics.corpus_cer(F.col("s"), F.col("d"), F.col("i"), F.col("n"))
    return views.aligned(spark, sf).groupBy("split").agg(F.count("*").alias("pairs"), *sums, F.round(ratio, 6).alias("corpus_cer"), F.round(metrics.sentence_cer(F.col("errors"), F.col("n")), 4).alias("sentence_cer"))


@query("F1 F10", f"WITH {views.PAIRS} SELECT id, levenshtein(ref, hyp) AS distance, round(CAST(levenshtein(ref, hyp) AS DOUBLE) / greatest(length(ref), length(hyp)), 6) AS scaled FROM pairs")
def edit_distance_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return views.pairs(spark, sf).select("id", F.levenshtein("ref", "hyp").cast("long").alias("distance"), F.round(T.scaled_distance(F.col("ref"), F.col("hyp")), 6).alias("scaled"))


@query("F3 O1", f"WITH {views.PAIRS} SELECT id, ref, hyp, round(CAST(levenshtein(ref, hyp) AS DOUBLE) / length(ref), 6) AS cer FROM pairs ORDER BY levenshtein(ref, hyp) / length(ref) DESC, id LIMIT 20")
def cer_worst_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.pairs(spark, sf).withColumn("c", T.cer(F.col("ref"), F.col("hyp")))
    return rows.orderBy(F.desc("c"), "id").limit(20).select("id", "ref", "hyp", F.round("c", 6).alias("cer"))


_NORMAL = "regexp_replace(regexp_replace(regexp_replace(text, '[啊啦吧呢哦哟哈嘛的了]', '', 'g'), '[，。、？！?!,.；;：:\"''‘’（）()\\[\\]【】<>《》~·…—\\-_+=*/|@#$%^&{}]', '', 'g'), '\\s', '', 'g')"


# A number of up to seven digits after each text, read out as F5 has it; runs of digits in the texts themselves go the same way.
_DIGIT = "['零', '一', '二', '三', '四', '五', '六', '七', '八', '九'][CAST(c AS INTEGER) + 1]"
_READ = f"""CASE WHEN NOT regexp_matches(t, '^[0-9]') THEN t WHEN length(ltrim(t, '0')) > 5 THEN array_to_string(list_transform(string_split(t, ''), lambda c: {_DIGIT}), '') WHEN length(ltrim(t, '0')) <= 1 THEN ['零', '一', '二', '三', '四', '五', '六', '七', '八', '九'][CAST(right(t, 1) AS INTEGER) + 1]
  ELSE regexp_replace(regexp_replace(array_to_string(list_transform(string_split(ltrim(t, '0'), ''), lambda c, i: CASE WHEN c = '0' THEN '零' ELSE CASE WHEN c = '1' AND length(ltrim(t, '0')) = 2 AND i = 1 THEN '' ELSE {_DIGIT} END || ['', '十', '百', '千', '万'][length(ltrim(t, '0')) - i + 1] END), ''), '零+', '零', 'g'), '零+$', '') END"""
_NUMBERED = f"SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text || ' ' || conv_id * 1009, '[0-9]+|[^0-9]+'), lambda t: {_READ}), '') AS text FROM conversations"


@query("F4 F6 F7", f"SELECT conv_id, turn, md5(lower({_NORMAL})) AS normalized, CAST(length({_NORMAL}) AS BIGINT) AS n FROM ({_NUMBERED})")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    n = T.normalize(F.col("text"))
    numbered = F.concat("text", F.lit(" "), (F.col("conv_id") * 1009).cast("string"))
    return table(spark, sf, "conversations").withColumn("text", numbered).select("conv_id", "turn", F.md5(n).alias("normalized"), F.length(n).cast("long").alias("n"))


_ZH = "split('零,一,二,三,四,五,六,七,八,九', ',')"


@query("F5", f"""SELECT p_partkey, CASE WHEN p_size < 10 THEN {_ZH}[p_size + 1] ELSE CASE WHEN p_size // 10 = 1 THEN '' ELSE {_ZH}[p_size // 10 + 1] END || '十' || CASE WHEN p_size % 10 = 0 THEN '' ELSE {_ZH}[p_size % 10 + 1] END END AS reading FROM part""")
def num_to_zh_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.num_to_zh(F.col("p_size").cast("string")).alias("reading"))


@query("J7 O4", f"WITH {_NEAREST} SELECT text, phrase, round(distance, 6) AS distance FROM near")
def nearest_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return matching.nearest_phrase(_hyps(spark, sf), "text", _bank(spark, sf)).select("text", "phrase", F.round("distance", 6).alias("distance"))


@query("F11", f"""WITH {views.PAIRS} SELECT id, round(CASE WHEN contains(b, a) OR contains(a, b) THEN CAST(abs(length(a) - length(b)) AS DOUBLE) / greatest(length(a), length(b)) ELSE CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b)) END, 6) AS distance
  FROM (SELECT id, ref AS a, CASE WHEN size % 2 = 0 THEN split_part(ref, ' ', 2) ELSE hyp END AS b FROM pairs)""")
def substring_intent(spark: SparkSession, sf: str) -> DataFrame:
    b = F.when(F.col("size") % 2 == 0, F.split_part("ref", F.lit(" "), F.lit(2))).otherwise(F.col("hyp"))
    return views.pairs(spark, sf).select("id", F.round(T.containment_distance(F.col("ref"), b), 6).alias("distance"))


@query("F12 J8", """WITH cmds AS (SELECT phrase, min(ord) AS ord FROM (SELECT r_regionkey AS ord, r_name AS phrase FROM region) GROUP BY phrase),
texts AS (SELECT DISTINCT upper(p_type) || '.' || upper(p_name) AS text FROM part), body AS (SELECT text, translate(text, '，。、？！?!,. ', '') AS b FROM texts),
win AS (SELECT text, phrase, ord, b, unnest([length(phrase) - 1, length(phrase), length(phrase) + 1]) AS w FROM body, cmds),
sc AS (SELECT text, phrase, ord, list_min(list_transform(range(1, greatest(length(b) - w + 1, 1) + 1), lambda i: CAST(levenshtein(substr(b, i, w), phrase) AS DOUBLE) / greatest(length(substr(b, i, w)), length(phrase)))) AS s FROM win),
best AS (SELECT text, arg_min(phrase, (s, ord)) AS command, min(s) AS score FROM sc GROUP BY text)
SELECT text, CASE WHEN score <= 0.7 THEN command END AS command, round(least(score, 1.0), 6) AS score FROM best""")
def sliding_command_match(spark: SparkSession, sf: str) -> DataFrame:
    cmds = matching.phrase_bank(table(spark, sf, "region"), "r_regionkey", "r_name")
    texts = table(spark, sf, "part").selectExpr("upper(p_type) || '.' || upper(p_name) AS text")
    return matching.match_commands(texts, "text", cmds, threshold=0.7).withColumn("score", F.round("score", 6))


@query("F13", f"WITH {_NEAREST} SELECT text, CASE WHEN distance <= 0.25 THEN phrase ELSE text END AS final_text FROM near")
def phrase_correct(spark: SparkSession, sf: str) -> DataFrame:
    near = matching.nearest_phrase(_hyps(spark, sf), "text", _bank(spark, sf))
    return near.select("text", T.corrected(F.col("text"), F.col("phrase"), F.col("distance"), 0.25).alias("final_text"))


@query("P10", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND length(lower(replace(text, ' ', ''))) > 0 AND lower(replace(role, ' ', '')) IN ('user')")
def wake_guard_filter(spark: SparkSession, sf: str) -> DataFrame:
    bare = lambda c: F.lower(F.replace(F.col(c), F.lit(" "), F.lit("")))
    return table(spark, sf, "conversations").filter((F.col("role") == "user") & (F.length(bare("text")) > 0) & bare("role").isin("user")).select("conv_id", "turn")


@query("F14 P15", r"SELECT page_id, regexp_extract(url, '([^/]+)$', 1) AS tail, regexp_replace(regexp_extract(url, '([^/]+)$', 1), '[^A-Za-z0-9_-]', '_', 'g') AS safe FROM pages")
def path_names(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.regexp_extract("url", "([^/]+)$", 1)
    return table(spark, sf, "pages").select("page_id", tail.alias("tail"), T.safe_name(tail).alias("safe"))
