"""Queries for aggregation (A rows) and for ranking and order (W rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillframe.operators import aggregates as A
from rillframe.operators import ranking as K
from rillframe.operators.columns import tokenize
from rillframe.queries.registry import Registry
from rillframe.sources.tables import Tables

R = Registry()

R.sql("a01_group_by", "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, min(l_tax) AS least, max(l_tax) AS most, round(avg(l_discount), 6) AS mean, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
R.sql("a02_global", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderkey) AS first FROM orders")
R.add("a03_aggregate_chain", lambda t: A.aggregate(t["part"], ("sum", "p_size"), ("min", "p_retailprice"), ("max", "p_size"), by=["p_brand"]), "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS sum_p_size, min(p_retailprice) AS min_p_retailprice, max(p_size) AS max_p_size FROM part GROUP BY p_brand")
R.add("a04_min_by", lambda t: A.extreme_row(t["lineitem"], ["l_quantity", "l_discount"], ["l_orderkey", "l_linenumber"], ["l_suppkey"]).select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity"), "SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_discount, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
R.add("a04_max_by", lambda t: A.extreme_row(t["lineitem"], ["l_quantity", "l_discount"], ["l_orderkey", "l_linenumber"], ["l_suppkey"], largest=True).select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity"), "SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_discount DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
R.sql("a05_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
R.sql("a06_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(l_partkey) AS n FROM lineitem GROUP BY l_returnflag")
R.sql("a07_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n > 10 AND avg(o_totalprice) < 240000", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10 AND avg(o_totalprice) < 240000")
R.sql("a08_group_by_constant", "SELECT 'all' AS what, CAST(NULL AS STRING) AS nothing, count(*) AS n FROM nation GROUP BY 'all', CAST(NULL AS STRING)")
R.add("a09_rollup", lambda t: t["part"].rollup("p_brand", "p_size").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total")), "SELECT p_brand, p_size, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY ROLLUP (p_brand, p_size)")
R.sql("a10_grouping", "SELECT n_regionkey, n_nationkey, CAST(grouping(n_regionkey) + grouping(n_nationkey) AS BIGINT) AS level, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
R.add("a11_deviation_ratio", lambda t: t["lineitem"].groupBy("l_suppkey").agg(F.round(F.stddev_samp("l_quantity"), 6).alias("deviation"), F.round(A.deviation_ratio(F.col("l_quantity")), 6).alias("ratio")), "SELECT l_suppkey, round(stddev_samp(l_quantity), 6) AS deviation, round(CASE WHEN avg(l_quantity) <> 0 THEN stddev_samp(l_quantity) / avg(l_quantity) END, 6) AS ratio FROM lineitem GROUP BY l_suppkey")
R.add("a12_pivot", lambda t: t["events"].groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).agg(F.round(F.sum("value"), 4)), "SELECT user_id, round(sum(CASE WHEN event_type = 'click' THEN value END), 4) AS click, round(sum(CASE WHEN event_type = 'purchase' THEN value END), 4) AS purchase, round(sum(CASE WHEN event_type = 'view' THEN value END), 4) AS \"view\" FROM events GROUP BY user_id")
R.sql("a13_ratio", "SELECT CAST(CAST(count(CASE WHEN o_orderpriority LIKE '1%' THEN 1 END) AS DECIMAL(15, 4)) / CAST(count(*) AS DECIMAL(15, 4)) AS DOUBLE) AS share FROM orders", "SELECT round(CAST(count(CASE WHEN o_orderpriority LIKE '1%' THEN 1 END) AS DOUBLE) / count(*), 20) AS share FROM orders")
R.sql("a14_bucket", "SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS bucket, count(*) AS n FROM orders GROUP BY 1")
R.sql("a15_collect_list", "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
R.add("a16_percentile", lambda t: A.percentiles(t["lineitem"], "l_extendedprice", [0.5, 0.95], ["l_returnflag"]).select("l_returnflag", F.round("p0", 4).alias("median"), F.round("p1", 4).alias("p95")), "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY l_returnflag")


@R.query("a16_percentile_approx", "SELECT l_returnflag, count(*) AS n, true AS near, true AS seen FROM lineitem GROUP BY 1")
def percentile_approx(t: Tables) -> DataFrame:
    """A sketch of 1,000 marks for middle fractions and the ends: the ranks of what it gives are counted, and
    lie within a thousandth of the rows; what it gives is a value of the table."""
    rows, fractions = t["lineitem"].select("l_returnflag", "l_extendedprice"), [0.0, 0.1, 0.5, 0.75, 0.99, 1.0]
    sketch = rows.groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", F.array(*map(F.lit, fractions)), 1000).alias("q"))
    ranks = rows.join(F.broadcast(sketch), "l_returnflag").groupBy("l_returnflag").agg(F.count("*").alias("n"), *(c for k in range(len(fractions)) for c in (F.count_if(F.col("l_extendedprice") < F.col("q")[k]).alias(f"below{k}"), F.count_if(F.col("l_extendedprice") == F.col("q")[k]).alias(f"same{k}"))))
    near, seen = F.lit(True), F.lit(True)
    for k, f in enumerate(fractions):
        rank, slack = f * F.col("n"), F.ceil(F.col("n") / 1000) + 1
        near = near & (F.col(f"below{k}") <= rank + slack) & (F.col(f"below{k}") + F.col(f"same{k}") >= rank - slack)
        seen = seen & (F.col(f"same{k}") > 0)
    return ranks.select("l_returnflag", "n", near.alias("near"), seen.alias("seen"))


R.add("a17_first_n", lambda t: A.first_n(t["orders"], 3, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey"), "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
R.add("a18_reduce", lambda t: t["nation"].groupBy("n_regionkey").agg(F.reduce(F.sort_array(F.collect_list("n_nationkey")), F.lit(1).cast("bigint"), lambda a, x: (a * 31 + x) % 1_000_003).alias("folded")), "SELECT n_regionkey, list_reduce(list_prepend(CAST(1 AS BIGINT), list(CAST(n_nationkey AS BIGINT) ORDER BY n_nationkey)), lambda a, x: (a * 31 + x) % 1000003) AS folded FROM nation GROUP BY n_regionkey")
R.add("a19_histogram", lambda t: A.histogram(t["part"], "p_size").select(F.explode("histogram").alias("p_size", "n")), "SELECT p_size, count(*) AS n FROM part GROUP BY p_size")


@R.query("a20_accumulators", "SELECT count(*) AS n, min(p_size) AS least, max(p_size) AS most FROM part")
def accumulators(t: Tables) -> DataFrame:
    watched, seen = A.observed(t["part"], "parts", "p_size")
    watched.write.format("noop").mode("overwrite").save()
    got = seen.get
    return t.spark.range(1).select(F.lit(got["n"]).cast("bigint").alias("n"), F.lit(got["least"]).alias("least"), F.lit(got["most"]).alias("most"))


R.add("a21_column_summary", lambda t: A.summary(t["events"].select("event_id", "value", F.expr("nullif(event_type, 'click')").alias("event_type"))), "SELECT 'event_id' AS column_name, count(*) AS total, count(*) - count(event_id) AS nulls, count(event_id) AS non_nulls, count(event_id) < count(*) AS has_nulls FROM events UNION ALL SELECT 'value', count(*), count(*) - count(value), count(value), count(value) < count(*) FROM events UNION ALL SELECT 'event_type', count(*), count(*) - count(nullif(event_type, 'click')), count(nullif(event_type, 'click')), count(nullif(event_type, 'click')) < count(*) FROM events")
DRAW = "CAST('0x' || substr(md5('42:' || {}), 1, 8) AS BIGINT)"
R.add("a22_sample_fraction", lambda t: A.sample_fraction(t["lineitem"].select("l_orderkey", "l_linenumber"), 0.1, 42, key=["l_orderkey", "l_linenumber"]), f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {DRAW.format('l_orderkey || chr(58) || l_linenumber')} < 429496729")
R.add("a22_sample_size", lambda t: A.sample_size(t["orders"].select("o_orderkey"), 100, 42, "o_orderkey"), f"SELECT o_orderkey FROM orders ORDER BY {DRAW.format('o_orderkey')}, o_orderkey LIMIT 100")
STEPS = [int(x * (1 << 32)) for x in A.poisson_steps(0.3)]
R.add("a22_sample_fraction_replaced", lambda t: A.sample_fraction(t["lineitem"].select("l_orderkey", "l_linenumber"), 0.3, 42, True, ["l_orderkey", "l_linenumber"]), f"SELECT l_orderkey, l_linenumber FROM (SELECT *, unnest(range(len(list_filter({STEPS}, lambda s: {DRAW.format('l_orderkey || chr(58) || l_linenumber')} >= s)))) FROM lineitem)")
PICK = DRAW.replace("42:", "43:").format("k")
R.add("a22_sample_size_replaced", lambda t: A.sample_size(t["orders"].select("o_orderkey"), 5000, 42, "o_orderkey", True), f"WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY {DRAW.format('o_orderkey')}, o_orderkey) - 1 AS place FROM orders), p AS (SELECT CAST(floor({PICK} * (SELECT count(*) FROM orders) / 4294967296) AS BIGINT) AS place FROM range(5000) r(k)) SELECT o_orderkey FROM p JOIN o USING (place)")
R.add("a22_sample_weighted", lambda t: A.sample_weighted(t["customer"].select("c_custkey", "c_acctbal"), 50, 42, "c_custkey", "c_acctbal"), f"SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 ORDER BY -ln(({DRAW.format('c_custkey')} + 0.5) / 4294967296) / c_acctbal, c_custkey LIMIT 50")
R.sql("a23_running_sum", "SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 3) AS total FROM events")
R.add("a24_word_count", lambda t: tokenize(t["documents"].select("text"), "text").groupBy("word").agg(F.count("*").alias("n")), "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
# Sums of decimals are exact, so both engines divide the same number.
R.add("a25_energy", lambda t: t["lineitem"].rollup("l_suppkey", "l_partkey").agg(A.energy_kwh(F.col("l_extendedprice").cast("decimal(12,2)"), (F.col("l_quantity") * 60).cast("decimal(8,0)")).alias("kwh")), "SELECT l_suppkey, l_partkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * CAST(l_quantity * 60 AS DECIMAL(8, 0))) AS DOUBLE) / 3600000 AS kwh FROM lineitem GROUP BY ROLLUP (l_suppkey, l_partkey)")
R.sql("a25_running_energy", "SELECT event_id, round(sum(value * 60) OVER (PARTITION BY user_id ORDER BY event_id) / 3600000, 8) AS kwh FROM events")

R.sql("w01_rank", "SELECT o_custkey, o_orderpriority, n, rank() OVER (PARTITION BY o_orderpriority ORDER BY n DESC) AS r FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)", "SELECT o_custkey, o_orderpriority, n, CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY n DESC) AS INTEGER) AS r FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)")
R.sql("w02_row_number", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS BIGINT) AS rn FROM orders")
R.sql("w03_partition_average", "SELECT k, m, round(total, 2) AS total, round(avg(total) OVER (PARTITION BY k), 2) AS mean FROM (SELECT o_orderpriority AS k, CAST(extract(month FROM o_orderdate) AS BIGINT) AS m, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)")
R.sql("w04_cumulative", "SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, max(o_totalprice) OVER w AS highest FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
R.add("w05_top_n", lambda t: K.top_n(t["lineitem"], 3, ["l_suppkey"], [F.desc("l_extendedprice")]).select("l_suppkey", "l_orderkey", "l_linenumber"), "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS r FROM lineitem) WHERE r <= 3")
R.add("w06_keep_first", lambda t: K.keep_first(t["events"], ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id"), "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
R.add("w06_keep_last", lambda t: K.keep_last(t["events"], ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id"), "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
R.add("w07_order_by", lambda t: K.numbered(t["part"].select("p_partkey", "p_type", "p_size"), F.split("p_type", " ")[0], F.desc("p_size"), "p_partkey").select("at", "p_partkey"), "SELECT row_number() OVER (ORDER BY string_split(p_type, ' ')[1], p_size DESC, p_partkey) AS at, p_partkey FROM part")
R.sql("w09_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 10")


@R.query("w10_cluster_by", "SELECT l_suppkey, count(*) AS n, CAST(1 AS BIGINT) AS partitions, true AS ordered FROM lineitem GROUP BY l_suppkey")
def cluster_by(t: Tables) -> DataFrame:
    """Each key in one partition, and rows within it in order."""
    rows = K.cluster_by(t["lineitem"].select("l_suppkey", "l_orderkey"), "l_suppkey", ["l_suppkey", "l_orderkey"])
    placed = rows.select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at"))
    before = F.lag("l_orderkey").over(Window.partitionBy("l_suppkey").orderBy("at"))
    checked = placed.select("l_suppkey", "p", (F.coalesce(before, "l_orderkey") <= F.col("l_orderkey")).alias("fine"))
    return checked.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.countDistinct("p").alias("partitions"), F.every("fine").alias("ordered"))


@R.query("w11_custom_partitioner", "SELECT CAST(n_regionkey % 4 AS INTEGER) AS p, count(*) AS n FROM nation GROUP BY 1")
def custom_partitioner(t: Tables) -> DataFrame:
    return K.partition_by(t["nation"], 4, F.col("n_regionkey") % 4).select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n"))


R.add("w12_reused_partitioning", lambda t: K.partitioned_once(t["lineitem"].select("l_orderkey", "l_quantity"), "l_orderkey").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity")), "SELECT l_orderkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey")

QUERIES, ORACLES = R.queries, R.oracles
