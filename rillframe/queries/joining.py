"""Queries for joins (J rows), subqueries (Q rows) and set operations (U rows)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.operators import joins as J
from rillframe.queries.registry import Registry
from rillframe.sources.tables import Tables

R = Registry()

R.sql("j01_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
R.add("j01_using", lambda t: t["nation"].withColumnRenamed("n_regionkey", "k").join(t["region"].withColumnRenamed("r_regionkey", "k"), "k").select("k", "n_name", "r_name"), "SELECT r_regionkey AS k, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
R.sql("j02_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 150000")
R.sql("j03_right", "SELECT l_orderkey, l_linenumber, p_partkey FROM (SELECT * FROM lineitem WHERE l_quantity > 49) l RIGHT JOIN part ON l_partkey = p_partkey")
R.sql("j04_full", "SELECT a.k AS a, b.k AS b FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9500) a FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) b ON a.k = b.k")
R.sql("j05_left_semi", "SELECT p_partkey, p_name FROM part LEFT SEMI JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) l ON p_partkey = l_partkey", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
R.sql("j06_semi_theta", "SELECT n_nationkey FROM nation LEFT SEMI JOIN region ON n_nationkey + r_regionkey > 24", "SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE n_nationkey + r_regionkey > 24)")
R.sql("j07_anti", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-03-01 00:00:00')")
R.sql("j07_not_in", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
R.sql("j08_cross", "SELECT r_regionkey, n_nationkey, r_regionkey * 100 + n_nationkey AS pair FROM region CROSS JOIN nation")
R.sql("j09_star", "SELECT n_name, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND c_nationkey = n_nationkey GROUP BY n_name")
R.sql(
    "j10_offset_self_join",
    """WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1),
    r AS (SELECT month, total, row_number() OVER (ORDER BY month) AS rn FROM m)
    SELECT CAST(a.month AS STRING) AS month, a.total AS this, b.total AS before, c.total AS after FROM r a JOIN r b ON a.rn = b.rn + 1 JOIN r c ON a.rn = c.rn - 1""",
)


@R.query(
    "j11_windowed_join",
    """WITH e AS (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS w FROM events)
    SELECT a.user_id, a.event_id AS click, b.event_id AS purchase, strftime(least(a.ts, b.ts), '%Y-%m-%d %H:%M:%S') AS ts FROM e a JOIN e b ON a.user_id = b.user_id AND a.w = b.w
    WHERE a.event_type = 'click' AND b.event_type = 'purchase'""",
)
def windowed_join(t: Tables) -> DataFrame:
    side = lambda kind, name: t["events"].where(F.col("event_type") == kind).select("user_id", "ts", F.col("event_id").alias(name))
    joined = J.windowed_join(side("click", "click"), side("purchase", "purchase"), ["user_id"], "ts", "1 day")
    return joined.select("user_id", "click", F.col("right_purchase").alias("purchase"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@R.query(
    "j11_sliding_windowed_join",
    """WITH e AS (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS w FROM events)
    SELECT a.user_id, a.event_id AS click, b.event_id AS purchase, strftime(a.w, '%Y-%m-%d %H:%M:%S') AS w FROM e a JOIN e b ON a.user_id = b.user_id AND a.w = b.w
    WHERE a.event_type = 'click' AND b.event_type = 'purchase'""",
)
def sliding_windowed_join(t: Tables) -> DataFrame:
    side = lambda kind, name: t["events"].where(F.col("event_type") == kind).select("user_id", "ts", F.col("event_id").alias(name))
    joined = J.windowed_join(side("click", "click"), side("purchase", "purchase"), ["user_id"], "ts", "1 day", "12 hours")
    return joined.select("user_id", "click", F.col("right_purchase").alias("purchase"), F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("w"))


INTERVAL = """SELECT a.user_id, a.event_id AS purchase, b.event_id AS view FROM events a JOIN events b ON a.user_id = b.user_id AND a.ts >= b.ts AND a.ts <= b.ts + INTERVAL 1 DAY
    WHERE a.event_type = 'purchase' AND b.event_type = 'view'"""


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    events = t["events"]
    purchase = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("purchase"))
    return purchase, events.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view"))


R.add("j12_interval_join", lambda t: J.interval_join(*_sides(t), "user_id", "at", "seen", "0 SECONDS", "1 DAY").select("user_id", "purchase", "view"), INTERVAL)  # the form that streams take
R.add("j12_bucketed_interval_join", lambda t: J.bucketed_interval_join(*_sides(t), "user_id", "at", "seen", 86_400).select("user_id", "purchase", "view"), INTERVAL)
R.add("j13_broadcast_rules", lambda t: J.join_rules(t["supplier"], t["nation"].select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), ["s_nationkey"]).select("s_suppkey", "n_name"), "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")


@R.query("j14_connected", "SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks, round(sum(CASE WHEN event_type = 'purchase' THEN value END), 4) AS spent FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id")
def connected(t: Tables) -> DataFrame:
    events = t["events"].select("user_id", "event_type", "value")
    both = J.connect(events.where("event_type = 'click'").drop("value"), events.where("event_type = 'purchase'"))
    return both.groupBy("user_id").agg(F.count_if(F.col("side") == "left").alias("clicks"), F.round(F.sum(F.when(F.col("side") == "right", F.col("value"))), 4).alias("spent"))


@R.query(
    "j15_co_group",
    "SELECT k, CAST(count(c) AS BIGINT) AS customers, CAST(count(s) AS BIGINT) AS suppliers FROM (SELECT c_nationkey AS k, c_custkey AS c, NULL AS s FROM customer UNION ALL SELECT s_nationkey, NULL, s_suppkey FROM supplier) GROUP BY k",
)
def co_group(t: Tables) -> DataFrame:
    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        k = (a if len(a) else b)["k"].iloc[0]
        return pd.DataFrame({"k": [k], "customers": [a["n"].sum()], "suppliers": [b["n"].sum()]})

    count = lambda df, k: df.groupBy(F.col(k).alias("k")).agg(F.count("*").alias("n"))  # noqa: E731  a row a key: a hot key stays small
    return J.co_group(count(t["customer"], "c_nationkey"), count(t["supplier"], "s_nationkey"), "k", both, "k int, customers bigint, suppliers bigint")


@R.query("j16_outer_by_co_group", "SELECT r_regionkey AS k, n_nationkey FROM region LEFT JOIN nation ON r_regionkey = n_regionkey AND n_nationkey > 20")
def outer_by_co_group(t: Tables) -> DataFrame:
    """A left join made of groups: a region without nations has an empty right group."""

    def left(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return a.merge(b, on="k", how="left")[["k", "n_nationkey"]].astype({"n_nationkey": "Int64"})

    nations = t["nation"].where("n_nationkey > 20").select(F.col("n_regionkey").alias("k"), "n_nationkey")
    return J.co_group(t["region"].select(F.col("r_regionkey").alias("k")), nations, "k", left, "k int, n_nationkey int")


R.sql("q01_with", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), b AS (SELECT avg(total) AS mean FROM a) SELECT o_custkey, round(total, 2) AS total FROM a, b WHERE total > mean * 1.2")
R.sql("q02_scalar", "SELECT CASE WHEN (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) > 1000 THEN (SELECT round(avg(l_extendedprice), 4) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) ELSE (SELECT round(avg(l_discount), 4) FROM lineitem) END AS bucket, CAST(count(*) AS BIGINT) AS n FROM region HAVING count(*) > (SELECT min(r_regionkey) FROM region)")
R.sql("q03_correlated_scalar", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 120000) AS n FROM customer")
R.sql("q03_above_group_mean", "SELECT c_custkey FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) * 1.2 FROM customer d WHERE d.c_nationkey = c.c_nationkey)")
R.sql("q04_in", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey + 1 > 2))")
R.sql("q05_correlated_in", "SELECT n_nationkey FROM nation WHERE 1 IN (SELECT count(*) FROM region WHERE r_regionkey = n_regionkey)")
R.sql("q06_exists", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48) OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.095)")
R.sql("q07_derived_table", "SELECT k, n FROM (SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY o_orderpriority)")

R.sql("u01_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
R.sql("u02_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
R.sql("u03_intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0 INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey < 4")
R.add("u04_intersect_all", lambda t: t["customer"].select(F.col("c_nationkey").alias("k")).intersectAll(t["supplier"].select("s_nationkey")), "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
R.sql("u05_except", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
R.add("u06_except_all", lambda t: t["customer"].select(F.col("c_nationkey").alias("k")).exceptAll(t["supplier"].select("s_nationkey")), "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")

QUERIES, ORACLES = R.queries, R.oracles
