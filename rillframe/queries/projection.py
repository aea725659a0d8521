"""Queries for projection, filters and columns (P rows) and scalar functions (F rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.functions import scalars
from rillframe.operators import columns as C
from rillframe.queries.registry import Registry
from rillframe.sources.tables import Tables

R = Registry()

R.sql("p01_select", "SELECT o_orderkey, o_totalprice * 2 AS twice, upper(o_orderpriority) AS priority FROM orders")
R.add("p02_project", lambda t: C.project(t["lineitem"], 3, 0, 4), "SELECT l_linenumber, l_orderkey, l_quantity FROM lineitem")
R.add("p03_add_columns", lambda t: C.add_columns(t["part"].select("p_partkey", "p_size"), bigger=F.col("p_size") + 1), "SELECT p_partkey, p_size, p_size + 1 AS bigger FROM part")
R.add("p04_add_or_replace_columns", lambda t: C.add_or_replace_columns(t["part"].select("p_partkey", "p_size"), p_size=F.col("p_size") * 10, p_key2=F.col("p_partkey") * 2), "SELECT p_partkey, p_size * 10 AS p_size, p_partkey * 2 AS p_key2 FROM part")
R.add("p05_rename_columns", lambda t: C.rename_columns(t["region"], r_name="name", r_regionkey="key"), "SELECT r_regionkey AS key, r_name AS name FROM region")
R.add("p06_drop_columns", lambda t: C.drop_columns(t["customer"], "c_acctbal", "c_name"), "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
R.add("p07_regex_columns", lambda t: C.select_matching(t["nation"], "n_.*key"), "SELECT n_nationkey, n_regionkey FROM nation")
R.sql("p08_where", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02")


@R.query("p09_typed_filter", "SELECT p_partkey, p_size, p_retailprice, p_brand FROM part WHERE p_size >= 20 AND p_retailprice < 1500 AND starts_with(p_brand, 'B')")
def typed_filter(t: Tables) -> DataFrame:
    part = t["part"].select("p_partkey", "p_size", "p_retailprice", "p_brand")
    return C.compare(C.compare(C.compare(part, "p_size", ">=", 20), "p_retailprice", "<", 1500.0), "p_brand", "startsWith", "B")


R.add("p10_map", lambda t: t["lineitem"].select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net")), "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
R.add("p11_flat_map", lambda t: t["part"].select("p_partkey", F.explode(F.split("p_type", " ")).alias("word")), "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
R.add("p12_tokenizer", lambda t: C.tokenize(t["benchmark"], "text").groupBy("item_id", "word").agg(F.count("*").alias("n")), "SELECT item_id, word, count(*) AS n FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS word FROM benchmark) WHERE word <> '' GROUP BY ALL")


@R.query(
    "p13_sensor_lines",
    """SELECT CAST(event_id AS INTEGER) AS epoch, CAST(user_id AS INTEGER) AS mote, value AS temperature, value * 2 AS humidity, 1.5 AS light, 2.5 AS voltage,
    CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS ts FROM events WHERE event_id % 3 <> 0 AND value IS NOT NULL""",
)
def sensor_lines(t: Tables) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSS")
    cells = [stamp, F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("value").cast("string"), (F.col("value") * 2).cast("string"), F.lit("1.5")]
    lines = t["events"].where("value IS NOT NULL").select(F.concat_ws(" ", *cells, F.when(F.col("event_id") % 3 != 0, "2.5")).alias("value"))
    return C.parse_sensor_lines(lines)[0]


R.sql("p14_predicates", "SELECT o_orderkey FROM orders WHERE (o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 1000 AND 50000) OR (o_orderpriority LIKE '1%' AND o_custkey IS NOT NULL AND NOT o_totalprice < 90000)")


@R.query("p15_side_output", "SELECT CASE WHEN event_type IN ('purchase', 'error') THEN event_type ELSE 'main' END AS output, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def side_output(t: Tables) -> DataFrame:
    outputs = C.split_by_tag(t["events"], F.col("event_type"), ["purchase", "error"])
    parts = [df.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.lit(tag or "main").alias("output"), "n", "total") for tag, df in outputs.items()]
    return C.union_same(*parts)


R.add("p16_union", lambda t: C.union_same(t["customer"].select(F.col("c_nationkey").alias("k")), t["supplier"].select(F.col("s_nationkey").alias("k"))), "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
R.add("p17_flatten_record", lambda t: C.flatten_struct(t["customer"].select("c_custkey", F.struct(F.struct(F.col("c_name").alias("first")).alias("name"), F.col("c_acctbal").alias("balance")).alias("who"))), "SELECT c_custkey, c_name AS who_name_first, c_acctbal AS who_balance FROM customer")


@R.query("p18_key_value_lines", "SELECT event_type AS kind, CAST(user_id AS BIGINT) AS who, value AS latency FROM events WHERE value IS NOT NULL")
def key_value_lines(t: Tables) -> DataFrame:
    lines = t["events"].where("value IS NOT NULL").select(F.format_string("{name=%s-%s, latency=%s}", "event_type", F.col("user_id").cast("string"), F.col("value").cast("string")).alias("value"))
    pairs = C.parse_pairs(lines)
    name = F.split(F.col("pairs")["name"], "-")
    return pairs.select(name[0].alias("kind"), name[1].try_cast("bigint").alias("who"), F.col("pairs")["latency"].try_cast("double").alias("latency"))


R.sql("f01_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE CAST(o_custkey AS STRING) END AS state, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS class FROM orders")
R.sql("f02_if", "SELECT l_orderkey, l_linenumber, if(l_quantity > 25, 1, 0) AS many FROM lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS many FROM lineitem")
R.sql("f03_coalesce", "SELECT event_id, coalesce(CAST(nullif(event_type, 'view') AS STRING), CAST(user_id AS STRING)) AS v FROM events")
R.sql("f04_cast", "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS s, CAST(floor(o_totalprice) AS BIGINT) AS whole, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM orders")
R.add("f04_try_cast", lambda t: t["events"].select("event_id", F.substring("event_type", 1, 1).try_cast("int").alias("digit"), scalars.strict_boolean(F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise((F.col("event_id") % 2).cast("string"))).cast("int").alias("flag")), "SELECT event_id, TRY_CAST(substr(event_type, 1, 1) AS INTEGER) AS digit, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 2 AS INTEGER) END AS flag FROM events")
R.sql("f05_substr", "SELECT c_custkey, substr(c_name, 2, 5) AS part FROM customer")
R.sql("f06_upper_lower", "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l FROM nation")
R.sql("f07_concat", "SELECT event_id, event_type || '-' || CAST(user_id AS STRING) AS k, nullif(event_type, 'click') || 'x' AS nothing FROM events")
R.sql("f08_split", "SELECT p_partkey, split(p_type, ' ')[0] AS first FROM part", "SELECT p_partkey, string_split(p_type, ' ')[1] AS first FROM part")
R.sql("f09_length", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents")
R.sql("f10_abs_round", "SELECT c_custkey, abs(c_acctbal) AS a, round(abs(c_acctbal), -2) AS hundreds, round(c_acctbal / 7, 2) AS cents FROM customer")
R.sql("f11_bround", "SELECT c_custkey, bround(CAST(c_custkey AS DOUBLE) * 5, -1) AS tens FROM customer", "SELECT c_custkey, round_even(CAST(c_custkey AS DOUBLE) * 5 / 10, 0) * 10 AS tens FROM customer")
R.add("f12_half_up", lambda t: t["lineitem"].select("l_orderkey", "l_linenumber", scalars.half_up(F.col("l_extendedprice") / 8).alias("eighth")), "SELECT l_orderkey, l_linenumber, floor(l_extendedprice / 8 * 100 + 0.5) / 100 AS eighth FROM lineitem")
R.sql("f13_sha2", "SELECT n_nationkey, sha2(n_name, 256) AS h, sha2(nullif(n_name, n_name), 256) AS nothing FROM nation", "SELECT n_nationkey, sha256(n_name) AS h, CAST(NULL AS VARCHAR) AS nothing FROM nation")
R.sql("f14_arithmetic", "SELECT l_orderkey, l_linenumber, round(l_extendedprice + l_tax, 4) AS gross, l_linenumber % 3 AS third FROM lineitem")
R.sql("f15_date_interval", "SELECT o_orderkey, CAST(CAST(o_orderdate + INTERVAL '3' MONTH AS DATE) AS STRING) AS later, CAST(CAST(o_orderdate - INTERVAL '10' DAY AS DATE) AS STRING) AS sooner FROM orders WHERE o_orderdate >= DATE '1996-01-01'")
R.sql(
    "f16_interval_arithmetic",
    "SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL '2-2' YEAR TO MONTH AS DATE) AS STRING) AS later, INTERVAL '2-2' YEAR TO MONTH > INTERVAL '1-11' YEAR TO MONTH AS longer FROM orders",
    "SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 26 MONTH AS DATE) AS STRING) AS later, true AS longer FROM orders",
)
R.add("f17_interval_from_string", lambda t: t["orders"].select("o_orderkey", F.date_format(F.col("o_orderdate").cast("timestamp") + scalars.day_time_interval(F.lit("1 2:02:00.123")), "yyyy-MM-dd HH:mm:ss.SSS").alias("later"), F.date_format((F.col("o_orderdate").cast("date") + scalars.year_month_interval(F.lit("10-11"))), "yyyy-MM-dd").alias("far")), "SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY + INTERVAL 2 HOUR + INTERVAL 2 MINUTE + INTERVAL 123 MILLISECOND, '%Y-%m-%d %H:%M:%S.%g') AS later, strftime(CAST(o_orderdate AS DATE) + INTERVAL 131 MONTH, '%Y-%m-%d') AS far FROM orders")
R.sql("f18_day_interval", "SELECT o_orderkey, CAST(CAST(o_orderdate + INTERVAL 1 DAY + INTERVAL 2 DAYS AS DATE) AS STRING) AS later FROM orders")
R.sql("f19_array_map", "SELECT p_partkey, array(p_brand, p_type)[1] AS second, map('a', p_size, 'b', p_size + 1)['b'] AS b FROM part", "SELECT p_partkey, p_type AS second, p_size + 1 AS b FROM part")
R.sql("f20_explode", "SELECT n_nationkey, k, v FROM nation LATERAL VIEW explode(map('key1', n_regionkey, 'key2', n_nationkey)) m AS k, v", "SELECT n_nationkey, 'key1' AS k, n_regionkey AS v FROM nation UNION ALL SELECT n_nationkey, 'key2', n_nationkey FROM nation")
R.sql("f21_stack", "SELECT s_suppkey, what, v FROM (SELECT s_suppkey, stack(2, 'balance', s_acctbal, 'nation', CAST(s_nationkey AS DOUBLE)) AS (what, v) FROM supplier)", "SELECT s_suppkey, 'balance' AS what, s_acctbal AS v FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier")
R.add("f22_json_value", lambda t: t["events"].select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k")), "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
R.add("f23_json_update", lambda t: t["events"].select("event_id", scalars.json_increment(F.col("props"), "k", "k BIGINT").alias("props")).where(F.get_json_object("props", "$.k") > "3"), "SELECT event_id, '{\"k\":' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS VARCHAR) || '}' AS props FROM events WHERE CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS VARCHAR) > '3'")


@R.query(
    "f24_window_times",
    "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND, '%Y-%m-%d %H:%M:%S.%g') AS rowtime, count(*) AS n FROM events GROUP BY ALL",
)
def window_times(t: Tables) -> DataFrame:
    counted = t["events"].groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return counted.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.date_format(scalars.rowtime(F.col("w")), "yyyy-MM-dd HH:mm:ss.SSS").alias("rowtime"), "n")


# All rows of a batch are read at one time, so there is one group.
R.add("f25_processing_time", lambda t: t["events"].withColumn("read", F.current_timestamp()).groupBy("read").agg(F.count("*").alias("n"), F.count_if(F.col("ts") + F.expr("INTERVAL 1 DAY") < F.col("read")).alias("past")).select("n", "past"), "SELECT count(*) AS n, count(CASE WHEN ts + INTERVAL 1 DAY < now()::TIMESTAMP THEN 1 END) AS past FROM events")
R.add("f26_nested_access", lambda t: t["customer"].select("c_custkey", F.struct(F.col("c_acctbal").alias("balance"), (F.col("c_acctbal") > 0).alias("fine")).alias("r")).select("c_custkey", F.col("r.balance").cast("string").try_cast("double").alias("balance"), "r.fine"), "SELECT c_custkey, c_acctbal AS balance, c_acctbal > 0 AS fine FROM customer")

QUERIES, ORACLES = R.queries, R.oracles
