"""The test tables as offer records.

One SELECT that Spark and DuckDB read alike; record_id is a label, not a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

OFFERS_SQL = """
SELECT
  l.l_orderkey * 10 + l.l_linenumber AS record_id,
  CASE WHEN l.l_partkey % 17 = 0 THEN NULL ELSE CONCAT('REQ-', CAST(l.l_partkey AS VARCHAR(20))) END AS requirement_id,
  CASE WHEN l.l_suppkey % 11 = 0 THEN NULL ELSE s.s_name END AS recruiter,
  CASE r.r_regionkey WHEN 0 THEN '上海' WHEN 1 THEN '广州' WHEN 2 THEN '杭州' WHEN 3 THEN '其他' ELSE '未知' END AS city,
  p.p_brand AS position, p.p_type AS job_family, c.c_mktsegment AS department,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN '官网' WHEN '2-HIGH' THEN 'Boss' WHEN '3-MEDIUM' THEN '实习僧' WHEN '5-LOW' THEN '内推' ELSE '其他' END AS channel,
  CASE l.l_suppkey % 4 WHEN 0 THEN '内推' WHEN 1 THEN 'HR推' WHEN 2 THEN '其他' ELSE '未知' END AS referral_type,
  CASE l.l_orderkey % 5 WHEN 0 THEN '新增招聘' WHEN 1 THEN '替补' WHEN 2 THEN '替换' WHEN 3 THEN '替补替换未拆分' ELSE '未知' END AS requirement_type,
  CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE CAST(2020 + c.c_custkey % 8 AS INT) END AS graduation_year,
  CASE c.c_custkey % 5 WHEN 0 THEN '专科' WHEN 1 THEN '本科' WHEN 2 THEN '硕士' WHEN 3 THEN '博士' ELSE '未知' END AS education,
  CASE WHEN c.c_nationkey % 6 = 0 THEN NULL ELSE n.n_name END AS school,
  CASE WHEN l.l_returnflag = 'A' THEN '已入职'
       WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'F' THEN '拒绝offer'
       WHEN l.l_returnflag = 'R' AND o.o_orderstatus = 'P' THEN '拒绝口头offer'
       WHEN l.l_returnflag = 'R' AND o.o_orderstatus = 'O' THEN '其他'
       WHEN l.l_returnflag = 'R' THEN '未知'
       WHEN l.l_linestatus = 'O' THEN '待入职' ELSE 'offer审批中' END AS offer_status,
  CAST(o.o_orderdate AS DATE) AS start_date,
  CASE WHEN l.l_partkey % 13 = 0 THEN NULL ELSE CAST(l.l_shipdate AS DATE) END AS join_date,
  CASE WHEN l.l_quantity = 1 THEN NULL ELSE p.p_retailprice END AS salary_amount,
  CASE l.l_partkey % 4 WHEN 0 THEN NULL ELSE 'CNY' END AS currency,
  CASE l.l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '元/天' ELSE '元/月' END AS salary_unit,
  CASE p.p_size % 5 WHEN 0 THEN '无补贴' WHEN 1 THEN '现金房补' WHEN 2 THEN '提供住宿' WHEN 3 THEN '其他' ELSE '未知' END AS housing_type,
  CASE WHEN p.p_size % 5 = 1 AND p.p_size % 10 <> 1 THEN l.l_quantity * 10 WHEN p.p_size % 5 = 0 THEN 0.0 ELSE NULL END AS housing_amount,
  CASE p.p_size % 3 WHEN 0 THEN '月' WHEN 1 THEN '天' ELSE NULL END AS housing_period,
  CASE c.c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS is_gpt,
  CASE WHEN l.l_linenumber % 4 = 0 THEN NULL WHEN l.l_linenumber % 4 = 1 THEN '薪 资' WHEN l.l_linenumber % 4 = 2 THEN '其他Offer' ELSE 'free text' END AS rejection_reason,
  CASE WHEN l.l_orderkey % 19 = 0 THEN 'removedAsDuplicate' WHEN l.l_orderkey % 19 = 1 THEN 'pendingUserConfirmation' ELSE 'kept' END AS dedup_action,
  CAST(l.l_orderkey % 1000000 AS INT) AS source_row
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
"""


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def offers(spark: SparkSession, sf_dir: str, places: bool = False) -> DataFrame:
    """Offer records over the test tables; with places, where each stands in the list as `place`: record_id is no key, so orders by it need one."""
    register(spark, sf_dir)
    if not places:
        return spark.sql(OFFERS_SQL)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place")).createOrReplaceTempView("lineitem")
    return spark.sql(OFFERS_SQL.replace("\nFROM lineitem l", ", l.place\nFROM lineitem l", 1))
