"""Queries on manifests: joins, validation, splits, leakage, resuming, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, relational
from ..streaming import matcher
from ..workspace import table
from .catalog import query


@query("J1 P1 P4 P5 A15", "SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE coalesce(o_orderpriority, '') <> '' GROUP BY c_mktsegment, o_orderstatus")
def manifest_join_validate(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").filter(relational.present(F.col("o_orderpriority"))).withColumnRenamed("o_custkey", "c_custkey").select("c_custkey", "o_orderstatus")
    joined = relational.referenced(orders, table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    return joined.groupBy("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"))


@query("P4 P5", "SELECT 'repeated' AS rule, CAST(l_orderkey AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def manifest_violations(spark: SparkSession, sf: str) -> DataFrame:
    return relational.violations(table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag"), "l_orderkey", ["l_returnflag"])


@query("J3 J13 J14", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def cache_miss_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return corpus.to_do(table(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("J2 J4", "SELECT e.vec_id, e.label AS left_label, b.label AS right_label FROM embeddings e JOIN embeddings b ON b.vec_id = e.vec_id + 7")
def double_lookup(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    rows = e.select("vec_id", F.col("vec_id").alias("left"), (F.col("vec_id") + 7).alias("right"))
    return relational.with_pair(rows, e, "left", "right", "vec_id", "label").select("vec_id", F.col("left_value").alias("left_label"), F.col("right_value").alias("right_label"))


@query("J5", "SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS at FROM orders GROUP BY o_custkey")
def last_write_wins(spark: SparkSession, sf: str) -> DataFrame:
    last = relational.latest(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")
    return last.select("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("at"))


@query("J9", "SELECT a.l_orderkey, a.l_linenumber, a.l_suppkey, (SELECT min(b.l_partkey) FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey AND b.l_quantity > 10) AS partner FROM lineitem a")
def wrong_enrollment_selfjoin(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity")
    return relational.wrong_partner(rows, "l_orderkey", "l_partkey", "l_suppkey", F.col("l_quantity") > 10).select("l_orderkey", "l_linenumber", "l_suppkey", "partner")


_PART = "CASE WHEN h < 80 THEN 'train' WHEN h < 90 THEN 'dev' ELSE 'test' END"


@query("F16", f"SELECT split, count(*) AS n, min(page_id) AS first_page FROM (SELECT page_id, {_PART} AS split FROM (SELECT page_id, CAST(concat('0x', substr(sha256(url), 1, 8)) AS BIGINT) % 100 AS h FROM pages)) GROUP BY split")
def hash_partition_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").groupBy(corpus.hash_partition(F.col("url")).alias("split")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("F17", "SELECT c_custkey, CAST(CAST(concat('0x', substr(sha256('sample:' || c_custkey || ':v1'), 1, 16)) AS UBIGINT) AS DECIMAL(20, 0)) AS seed FROM customer")
def derived_seed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", corpus.derived_seed(F.col("c_custkey"), "v1").alias("seed"))


_SPLIT = f"sp AS (SELECT o_orderkey, o_custkey, {_PART} AS split FROM (SELECT *, CAST(concat('0x', substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 100 AS h FROM orders))"


def _split_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", corpus.hash_partition(F.col("o_orderkey").cast("string")).alias("split"))


@query("J12 U3", f"WITH {_SPLIT}, k AS (SELECT DISTINCT o_custkey, split FROM sp) SELECT a.split AS left_split, b.split AS right_split, count(*) AS shared FROM k a JOIN k b ON a.o_custkey = b.o_custkey AND a.split < b.split GROUP BY a.split, b.split")
def leakage_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.leakage(_split_orders(spark, sf), "split", "o_custkey")


@query("A16 A26", f"WITH {_SPLIT}, k AS (SELECT DISTINCT o_custkey, split FROM sp), s AS (SELECT count(*) AS c FROM k a JOIN k b ON a.o_custkey = b.o_custkey AND a.split < b.split) SELECT (SELECT count(*) FROM orders) AS rows, (SELECT count(*) FROM orders WHERE o_totalprice > 400000) AS tolerance_failures, CAST(0 AS BIGINT) AS duplicate_ids, (SELECT c FROM s) AS shared_o_custkey, 'FAIL' AS verdict")
def corpus_acceptance(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.acceptance(_split_orders(spark, sf), "split", "o_orderkey", ["o_custkey"], F.col("o_totalprice") > 400000)


_CYCLE = ["single", "overlap", "absent", "enroll_swap_target_1"]


@query("D24 A15", f"SELECT scenario, count(*) AS n FROM (SELECT {_CYCLE}[CAST(o_orderkey % 4 AS INTEGER) + 1] AS scenario FROM orders) GROUP BY scenario")
def scenario_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(corpus.scenario_by_position(F.col("o_orderkey"), _CYCLE).alias("scenario")).agg(F.count("*").alias("n"))


@query("P6 P7", f"""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN {_CYCLE}[CAST(o_orderkey % 4 AS INTEGER) + 1] END AS scenario, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus <> 'F' END AS present FROM orders)
SELECT count(*) FILTER (coalesce(present, true)) AS b1, count(*) FILTER (scenario IS NULL OR scenario IN ('absent', 'enroll_swap_absent')) AS b2, count(*) FILTER (coalesce(NOT present, CASE WHEN scenario IS NOT NULL THEN scenario IN ('absent', 'enroll_swap_absent') END, false)) AS absent FROM s""")
def scene_filters(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.when(key % 5 != 0, corpus.scenario_by_position(key, _CYCLE)).alias("scenario"), F.when(key % 3 == 0, F.col("o_orderstatus") != "F").alias("present"))
    absent = corpus.kind_of_entry(F.col("present"), F.col("scenario"), F.lit(None).cast("boolean"), F.lit(1))
    return rows.agg(F.count_if(corpus.scene_filter("b1", F.col("present"), F.col("scenario"))).alias("b1"), F.count_if(corpus.scene_filter("b2", F.col("present"), F.col("scenario"))).alias("b2"), F.count_if(absent).alias("absent"))


@query("P14", "SELECT l_orderkey, l_linenumber, 'overlap_' || CAST(round_even(l_discount * 1000, 0) AS BIGINT) || '_sir_' || CASE WHEN l_tax > 0.04 THEN 'minus' ELSE '' END || CAST(round_even(l_tax * 100, 0) AS BIGINT) AS label FROM lineitem")
def scenario_labels(spark: SparkSession, sf: str) -> DataFrame:
    sir = F.when(F.col("l_tax") > 0.04, -F.col("l_tax") * 100).otherwise(F.col("l_tax") * 100)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", corpus.overlap_label(F.col("l_discount") * 10, sir).alias("label"))


@query("P11", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def usable_speakers(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.usable(table(spark, sf, "orders"), "o_custkey", 12)


@query("D25", "WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY sha256(CAST(s_suppkey AS VARCHAR)), s_suppkey) - 1 AS r, count(*) OVER () AS n FROM supplier), k AS (SELECT *, greatest(2, CAST(floor(n * 0.125) AS BIGINT)) AS side FROM r) SELECT s_suppkey, CASE WHEN r < n - 2 * side THEN 'train' WHEN r < n - side THEN 'dev' ELSE 'test' END AS split FROM k")
def disjoint_speakers(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.disjoint_split(table(spark, sf, "supplier"), "s_suppkey")


@query("J11 U6", "SELECT o_orderkey, o_orderstatus, side FROM (SELECT o_orderkey, o_orderstatus, 'left' AS side FROM orders WHERE o_orderkey % 100 = 0 AND o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'X', 'right' FROM orders WHERE o_orderkey % 100 = 0 AND o_orderstatus = 'F')")
def determinism_diff(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    right = left.withColumn("o_orderstatus", F.when((F.col("o_orderkey") % 100 == 0) & (F.col("o_orderstatus") == "F"), "X").otherwise(F.col("o_orderstatus")))
    return relational.differences(left, right)


@query("U1 U4", "SELECT key, min(ord) AS ord FROM (SELECT o_custkey AS key, o_orderkey AS ord FROM orders UNION ALL SELECT c_custkey, c_custkey + 1000000000 FROM customer) GROUP BY key")
def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "orders").selectExpr("o_custkey AS key", "o_orderkey AS ord").unionByName(table(spark, sf, "customer").selectExpr("c_custkey AS key", "c_custkey + 1000000000 AS ord"))
    return both.groupBy("key").agg(F.min("ord").alias("ord"))


@query("U5", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def without_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("P16", "SELECT 'p_brand' AS field, count(*) FILTER (p_brand IN (SELECT p_type FROM part)) AS present, count(*) FILTER (p_brand NOT IN (SELECT p_type FROM part)) AS missing FROM part UNION ALL SELECT 'p_type', count(*), 0 FROM part")
def path_readiness(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return relational.readiness(part, ["p_brand", "p_type"], part.select(F.col("p_type").alias("path"))).select("field", "present", "missing")


@query("stream S17 S3")
def streaming_command_match(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of each conversation, in order, against a few commands; a test holds it against a batch version."""
    columns = {"session": "conv_id", "seq": "turn", "text": "text"}
    return matcher.run_once(spark, f"{sf}/conversations.parquet", columns, ["licensed under", "ignore previous", "andthe", "derdie"], threshold=0.15)
