"""Queries for patterns and graphs (C, G rows), Python functions (X rows) and observation (O rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.functions import python_functions as U
from rillframe.operators import aggregates as A
from rillframe.operators import graph as G
from rillframe.operators import observing as O
from rillframe.operators.joins import windowed_join
from rillframe.operators.patterns import Step, next_match, strict_sequence
from rillframe.queries.registry import Registry
from rillframe.queries.streams import out_of_order
from rillframe.sources.tables import Tables
from rillframe.streaming.drains import run_in_parts
from rillframe.streaming.matching import match_stream

R = Registry()

STRICT = [Step("view", "event_type = 'view'"), Step("click", "event_type = 'click'"), Step("purchase", "event_type = 'purchase' AND value > 10")]
RELAXED = [Step("click", "event_type = 'click'"), Step("purchase", "event_type = 'purchase'", strict=False)]
MIXED = [Step("click", "event_type = 'click'"), Step("view", "event_type = 'view'", strict=False), Step("purchase", "event_type = 'purchase'")]

R.add(
    "c01_strict_sequence",
    lambda t: strict_sequence(t["events"], "user_id", ["ts", "event_id"], STRICT, "event_id"),
    """SELECT user_id, event_id AS "view", c AS click, p AS purchase FROM (SELECT *, lead(event_id) OVER w AS c, lead(event_id, 2) OVER w AS p, lead(event_type) OVER w AS t1, lead(event_type, 2) OVER w AS t2, lead(value, 2) OVER w AS v2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE event_type = 'view' AND t1 = 'click' AND t2 = 'purchase' AND v2 > 10""",
)
R.add(
    "c01_relaxed_sequence",
    lambda t: next_match(t["events"], "user_id", ["ts", "event_id"], RELAXED, "event_id", "ts", 86_400),
    """WITH n AS (SELECT *, first(CASE WHEN event_type = 'purchase' THEN {'id': event_id, 'ts': ts} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS p FROM events)
    SELECT user_id, event_id AS click, CASE WHEN p.ts - ts <= INTERVAL 1 DAY THEN p.id END AS purchase, NOT coalesce(p.ts - ts <= INTERVAL 1 DAY, false) AS timed_out FROM n WHERE event_type = 'click'""",
)



def matched(t: Tables, steps: list[Step], within: int | None = None, ends: bool = True) -> DataFrame:
    """Events in two parts that overlap in time, and a row that closes the stream."""
    return run_in_parts(out_of_order(t), lambda df, _: match_stream(df, "user_id", "ts", "event_id", steps, within, ends, "1 day")).drop("batch")


R.add("c01_strict_sequence_stream", lambda t: matched(t, STRICT, ends=False).drop("timed_out"), R.oracles["c01_strict_sequence"])
R.add("c01_relaxed_sequence_stream", lambda t: matched(t, RELAXED, 86_400), R.oracles["c01_relaxed_sequence"])
#: A strict step behind a relaxed one: a view counts only if a purchase is the next row.
FOLLOWED = """WITH r AS (SELECT *, CASE WHEN event_type = 'view' AND lead(event_type) OVER w = 'purchase' THEN {'view': event_id, 'purchase': lead(event_id) OVER w, 'ts': lead(ts) OVER w} END AS pair FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    n AS (SELECT *, first(pair IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS p FROM r)
    SELECT user_id, event_id AS click, CASE WHEN p.ts - ts <= INTERVAL 2 DAY THEN p.view END AS "view", CASE WHEN p.ts - ts <= INTERVAL 2 DAY THEN p.purchase END AS purchase, NOT coalesce(p.ts - ts <= INTERVAL 2 DAY, false) AS timed_out FROM n WHERE event_type = 'click'"""
R.add("c01_mixed_sequence", lambda t: next_match(t["events"], "user_id", ["ts", "event_id"], MIXED, "event_id", "ts", 172_800), FOLLOWED)
R.add("c01_mixed_sequence_stream", lambda t: matched(t, MIXED, 172_800), FOLLOWED)

EDGES = "(SELECT DISTINCT l_suppkey AS src, CAST(l_partkey % 100 AS BIGINT) AS dst, CAST(l_suppkey + l_partkey AS DOUBLE) AS value FROM lineitem)"


def edges(t: Tables) -> DataFrame:
    return t["lineitem"].select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).cast("bigint").alias("dst"), (F.col("l_suppkey") + F.col("l_partkey")).cast("double").alias("value")).distinct()


def vertices(t: Tables) -> DataFrame:
    return t["supplier"].select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value"))


R.add("g01_reverse", lambda t: G.reverse(edges(t)), f"SELECT dst AS src, src AS dst, value FROM {EDGES}")
R.add("g02_triplets", lambda t: G.triplets(vertices(t), edges(t)), f"SELECT src, dst, a.s_acctbal AS src_value, b.s_acctbal AS dst_value, e.value AS edge_value FROM {EDGES} e JOIN supplier a ON src = a.s_suppkey JOIN supplier b ON dst = b.s_suppkey")
R.add("g03_edge_order", lambda t: G.edge_orders(edges(t)), f"SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(bit_or(CASE WHEN src <= dst THEN 2 ELSE 1 END) AS INTEGER) AS direction FROM {EDGES} GROUP BY ALL")
KINDS = "(SELECT DISTINCT l_suppkey AS src, CAST(l_partkey % 100 AS BIGINT) AS dst, l_returnflag AS kind FROM lineitem)"


def kinds_of_edges(t: Tables) -> DataFrame:
    return t["lineitem"].select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).cast("bigint").alias("dst"), F.col("l_returnflag").alias("kind")).distinct()


R.add("g04_neighbour_aggregation_by_kind", lambda t: G.gather_messages(vertices(t), kinds_of_edges(t), "mean", ["A", "R"]).select("id", F.round("value", 6).alias("value")), f"SELECT s_suppkey AS id, round(s_acctbal + coalesce(m, 0), 6) AS value FROM supplier LEFT JOIN (SELECT dst, avg(m) AS m FROM (SELECT dst, kind, avg(s_acctbal) AS m FROM {KINDS} JOIN supplier ON src = s_suppkey WHERE kind IN ('A', 'R') GROUP BY dst, kind) GROUP BY dst) ON s_suppkey = dst")
R.add("g04_neighbour_aggregation", lambda t: G.gather_messages(vertices(t), edges(t), "max"), f"SELECT s_suppkey AS id, s_acctbal + coalesce(m, 0) AS value FROM supplier LEFT JOIN (SELECT dst, max(s_acctbal) AS m FROM {EDGES} JOIN supplier ON src = s_suppkey GROUP BY dst) ON s_suppkey = dst")
R.add("g04_two_rounds", lambda t: G.iterate_messages(vertices(t), edges(t), "min", 2), f"WITH e AS {EDGES}, a AS (SELECT s_suppkey AS id, s_acctbal + coalesce(m, 0) AS value FROM supplier LEFT JOIN (SELECT dst, min(s_acctbal) AS m FROM e JOIN supplier ON src = s_suppkey GROUP BY dst) ON s_suppkey = dst) SELECT a.id, a.value + coalesce(m, 0) AS value FROM a LEFT JOIN (SELECT dst, min(a.value) AS m FROM e JOIN a ON src = a.id GROUP BY dst) n ON a.id = n.dst")

R.add("x01_scalar_udf", lambda t: t["part"].select("p_partkey", U.add_one(F.col("p_size")).alias("more")), "SELECT p_partkey, CAST(p_size + 1 AS BIGINT) AS more FROM part")
R.add("x02_vectorised_udf", lambda t: t["lineitem"].select("l_orderkey", "l_linenumber", F.round(U.net_price(F.col("l_extendedprice"), F.col("l_discount")), 4).alias("net")), "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
R.add("x03_udf_with_setup", lambda t: t["part"].select("p_partkey", U.with_model(F.col("p_size")).alias("scored")), "SELECT p_partkey, CAST(p_size * 3 + 7 AS BIGINT) AS scored FROM part")


@R.query("x04_table_function", "SELECT p_partkey, word, CAST(generate_subscripts(string_split(p_type, ' '), 1) - 1 AS INTEGER) AS place FROM (SELECT p_partkey, p_type, unnest(string_split(p_type, ' ')) AS word FROM part) WHERE false UNION ALL SELECT p_partkey, w.word, CAST(w.place AS INTEGER) FROM (SELECT p_partkey, unnest(list_zip(string_split(p_type, ' '), range(0, len(string_split(p_type, ' '))))) AS z FROM part), LATERAL (SELECT z[1] AS word, z[2] AS place) w")
def table_function(t: Tables) -> DataFrame:
    t.spark.udtf.register("split_words", U.SplitWords)
    return t.sql("SELECT p_partkey, w.word, w.place FROM part, LATERAL split_words(p_type) w")


R.add("x05_aggregate_function", lambda t: t["part"].groupBy("p_brand").agg(F.round(U.mean_of(F.col("p_size").cast("double")), 4).alias("mean")), "SELECT p_brand, round(avg(p_size), 4) AS mean FROM part GROUP BY p_brand")
R.add("x06_table_aggregate", lambda t: U.top_two(t["supplier"]), "SELECT s_nationkey, s_suppkey, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier) WHERE place <= 2")


@R.query("x07_registered_function", "SELECT n_nationkey, CAST(n_regionkey + 1 AS BIGINT) AS more FROM nation")
def registered(t: Tables) -> DataFrame:
    t.spark.udf.register("add_one", U.add_one)
    return t.sql("SELECT n_nationkey, add_one(n_regionkey) AS more FROM nation")


@R.query("x08_raw_function", "SELECT p_partkey, CAST(p_size + 1 AS BIGINT) AS more FROM part")
def raw_function(t: Tables) -> DataFrame:
    """The Python function behind the registered one, called on plain values."""
    raw = U.add_one.func

    def rows(frames):
        for frame in frames:
            yield frame.assign(more=[raw(x) for x in frame["p_size"]])[["p_partkey", "more"]]

    return t["part"].select("p_partkey", "p_size").mapInPandas(rows, "p_partkey bigint, more bigint")


R.add("x09_key_by", lambda t: t["orders"].groupBy((F.col("o_orderkey") % 7).alias("k")).agg(F.count("*").alias("n")), "SELECT o_orderkey % 7 AS k, count(*) AS n FROM orders GROUP BY 1")


@R.query("x10_sql_function", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def sql_function(t: Tables) -> DataFrame:
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION net_of(price DOUBLE, discount DOUBLE) RETURNS DOUBLE RETURN price * (1 - discount)")
    return t.sql("SELECT l_orderkey, l_linenumber, round(net_of(l_extendedprice, l_discount), 4) AS net FROM lineitem")


@R.query("x11_shipped_file", "SELECT n_nationkey, CAST(n_regionkey * 11 AS BIGINT) AS scaled FROM nation")
def shipped_file(t: Tables) -> DataFrame:
    return U.scale_by_file(t["nation"].select("n_nationkey", "n_regionkey"), 11)


PREDICTIONS = "(SELECT 'node.' || CAST(l_orderkey % 5 AS VARCHAR) || '-t' || CAST(l_suppkey % 3 AS VARCHAR) || '-' || CAST(l_orderkey AS VARCHAR) AS name, l_extendedprice AS label, l_quantity * 1500 AS pred FROM lineitem)"


def predictions(t: Tables) -> DataFrame:
    name = F.concat(F.lit("node."), (F.col("l_orderkey") % 5).cast("string"), F.lit("-t"), (F.col("l_suppkey") % 3).cast("string"), F.lit("-"), F.col("l_orderkey").cast("string"))
    return t["lineitem"].select(name.alias("name"), F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("pred"))


def with_gaps(t: Tables) -> DataFrame:
    return t["lineitem"].select("l_orderkey", "l_quantity", F.expr("nullif(l_returnflag, 'A')").alias("flag"))


GAPS = "(SELECT l_orderkey, l_quantity, nullif(l_returnflag, 'A') AS flag FROM lineitem)"


@R.query("o01_observed_step", f"SELECT 'large' AS step, count(*) AS rows_in, count(CASE WHEN l_quantity > 40 THEN 1 END) AS rows_out, round(count(CASE WHEN l_quantity > 40 THEN 1 END) / count(*), 6) AS selectivity, round(2 + count(flag) / count(*), 6) AS width_in, round(1 + count(CASE WHEN l_quantity > 40 THEN flag END) / count(CASE WHEN l_quantity > 40 THEN 1 END), 6) AS width_out, true AS rated FROM {GAPS}")
def observed_step(t: Tables) -> DataFrame:
    got = O.observe_step(with_gaps(t), lambda df: df.where("l_quantity > 40").select("l_orderkey", "flag"), "large")
    rated = 0 < got["rate_out"] < got["rate_in"]
    row = (got["step"], got["rows_in"], got["rows_out"], round(got["selectivity"], 6), round(got["width_in"], 6), round(got["width_out"], 6), rated)
    return t.spark.createDataFrame([row], "step string, rows_in bigint, rows_out bigint, selectivity double, width_in double, width_out double, rated boolean")


R.add("o04_feature_encoding", lambda t: O.encode_features(t["orders"], ["o_totalprice"], ["o_orderstatus", "o_orderdate"]).groupBy("o_orderstatus_F").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderdate_index").alias("last")), "SELECT CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS \"o_orderstatus_F\", count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(max(r) AS DOUBLE) AS last FROM (SELECT *, dense_rank() OVER (ORDER BY o_orderdate) - 1 AS r FROM orders) GROUP BY 1")
R.add("o05_q_error", lambda t: A.percentiles(predictions(t).select(O.q_error(F.col("label"), F.col("pred")).alias("e")), "e", [0.5, 0.95]).select(F.round("p0", 6).alias("median"), F.round("p1", 6).alias("p95")), f"SELECT round(quantile_cont(greatest(label / pred, pred / label), 0.5), 6) AS median, round(quantile_cont(greatest(label / pred, pred / label), 0.95), 6) AS p95 FROM {PREDICTIONS}")
R.add("o06_rmse_mape", lambda t: predictions(t).agg(F.round(O.rmse(F.col("label"), F.col("pred")), 4).alias("rmse"), F.round(O.mape(F.col("label"), F.col("pred")), 6).alias("mape")), f"SELECT round(sqrt(avg((label - pred) * (label - pred))), 4) AS rmse, round(avg(abs((label - pred) / label)), 6) AS mape FROM {PREDICTIONS}")
R.add("o07_q_loss", lambda t: predictions(t).withColumn("pred", F.when(F.col("label") > 60_000, 0.0).otherwise(F.col("pred"))).agg(F.round(O.q_loss(F.col("label"), F.col("pred")), 6).alias("loss")), f"SELECT round(avg(CASE WHEN p < 0.001 THEN (1 - p) * 100 ELSE greatest(label / p, p / label) END), 6) AS loss FROM (SELECT label, CASE WHEN label > 60000 THEN 0.0 ELSE pred END AS p FROM {PREDICTIONS})")
R.add("o08_best_so_far", lambda t: O.best_so_far(t["events"].where("value IS NOT NULL").select("user_id", "event_id", "value"), "event_id", "value", False, "user_id"), "SELECT user_id, event_id, value, min(value) OVER w AS best, coalesce(value < min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")


@R.query("o09_prediction_summary", f"SELECT split_part(name, '-', 2) AS template, round(quantile_cont(greatest(label / pred, pred / label), 0.5), 6) AS median, round(quantile_cont(greatest(label / pred, pred / label), 0.95), 6) AS p95 FROM {PREDICTIONS} GROUP BY 1")
def prediction_summary(t: Tables) -> DataFrame:
    parts = F.split(F.regexp_replace("name", r"^node\.\d*-", ""), "-")
    error = O.q_error(F.col("label"), F.col("pred"))
    return A.percentiles(predictions(t).select(parts[0].alias("template"), error.alias("e")), "e", [0.5, 0.95], ["template"]).select("template", F.round("p0", 6).alias("median"), F.round("p1", 6).alias("p95"))


R.add("o10_relative_deviation", lambda t: predictions(t).groupBy(F.split("name", "-")[1].alias("template")).agg(F.round(F.avg((F.col("pred") - F.col("label")) / F.col("label")), 6).alias("deviation")), f"SELECT split_part(name, '-', 2) AS template, round(avg((pred - label) / label), 6) AS deviation FROM {PREDICTIONS} GROUP BY 1")
R.add("o11_label_histogram", lambda t: O.label_histogram(t["orders"].withColumn("price", F.expr("nullif(cast(o_totalprice as string), 'null')").try_cast("double")), "o_orderpriority", "price", 0.0, 300000.0).select("o_orderpriority", "bin", "n"), "SELECT o_orderpriority, CAST(floor(o_totalprice / 10000) + 1 AS BIGINT) AS bin, count(*) AS n FROM orders WHERE o_totalprice >= 0 AND o_totalprice < 300000 GROUP BY ALL")
R.add("o12_merged_sets", lambda t: O.merge_sets({"c": t["customer"].select(F.col("c_custkey").alias("id")), "s": t["supplier"].select(F.col("s_suppkey").alias("id"))}, "id", 120), "WITH b AS (SELECT c_custkey AS id, 'c' AS origin FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier), k AS (SELECT CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN origin || '-' || CAST(id AS VARCHAR) ELSE CAST(id AS VARCHAR) END AS id, origin FROM b) SELECT id, origin FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY id) AS rn FROM k) WHERE rn <= 120")
R.add("o13_rows_per_template", lambda t: O.keep_per_group(t["orders"].select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 25, 3), "SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY CAST('0x' || substr(md5('3:' || o_orderkey), 1, 8) AS BIGINT), o_orderkey) <= 25")
R.add("o14_box_statistics", lambda t: O.box_statistics(t["lineitem"].select("l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice"), "WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1) SELECT l_returnflag, q1, median, q3, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem JOIN q USING (l_returnflag) WHERE l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL")



@R.query(
    "o02_features_by_kind",
    """WITH p AS (SELECT column_type AS c FROM (DESCRIBE part))
    SELECT 'source' AS kind, 'numString' AS feature, CAST(count(CASE WHEN c = 'VARCHAR' THEN 1 END) AS DOUBLE) AS value FROM p
    UNION ALL SELECT 'source', 'numDouble', count(CASE WHEN c = 'DOUBLE' THEN 1 END) FROM p
    UNION ALL SELECT 'source', 'numInteger', count(CASE WHEN c IN ('INTEGER', 'BIGINT') THEN 1 END) FROM p
    UNION ALL SELECT 'source', 'tupleWidthOut', count(*) FROM p
    UNION ALL SELECT 'filter', unnest(['tupleWidthIn', 'tupleWidthOut']), count(*) FROM p
    UNION ALL SELECT 'filter', 'avgRealSelectivity', round(count(CASE WHEN p_size > 10 THEN 1 END) / count(*), 6) FROM part
    UNION ALL SELECT 'windowedAggregate', 'tupleWidthIn', count(*) FROM p UNION ALL SELECT 'windowedAggregate', 'tupleWidthOut', 2
    UNION ALL SELECT 'windowedAggregate', 'avgRealSelectivity', round(count(DISTINCT p_type) / count(*), 6) FROM part WHERE p_size > 10""",
)
def features_by_kind(t: Tables) -> DataFrame:
    """The features that each operator of a plan has by its kind: from the plan, and from observing its steps."""
    part = t["part"]
    some = part.where("p_size > 10")
    grouped = some.groupBy("p_type").agg(F.max("p_retailprice").alias("m"))
    seen = {"filter": O.observe_step(part, lambda df: df.where("p_size > 10"), "filter"), "windowedAggregate": O.observe_step(some, lambda df: df.groupBy("p_type").agg(F.max("p_retailprice").alias("m")), "aggregate")}
    rows = []
    for step in O.plan_steps(grouped):
        kind = step["type"]
        if kind in seen:
            step |= {"tupleWidthIn": seen[kind]["width_in"], "tupleWidthOut": seen[kind]["width_out"], "avgRealSelectivity": seen[kind]["selectivity"]}
        elif kind == "source":
            step |= {"tupleWidthOut": seen["filter"]["width_in"]}
        rows += [(kind, name, round(float(step[name]), 6)) for name in O.FEATURES[kind] if isinstance(step.get(name), int | float)]
    return t.spark.createDataFrame(rows, "kind string, feature string, value double")


@R.query(
    "o02_join_features",
    """WITH c AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS w FROM events WHERE event_type = 'click'), v AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS w FROM events WHERE event_type = 'view'),
    j AS (SELECT count(*) / ((SELECT count(*) FROM c) * (SELECT count(*) FROM v)) AS s FROM c JOIN v USING (user_id, w))
    SELECT 'all' AS template, unnest(['joinKeyClass', 'windowType', 'windowPolicy', 'slidingLength', 'windowLength', 'tupleWidthIn', 'tupleWidthOut', 'avgRealSelectivity']) AS feature, unnest(['bigint', 'tumbling', 'time', '86400', '86400', '6.0', '6.0', format('{:.9f}', (SELECT s FROM j))]) AS value""",
)
def join_features(t: Tables) -> DataFrame:
    """The features of a windowed join, from its description and from observing it; none in plans without joins."""
    side = lambda kind: t["events"].where(F.col("event_type") == kind).select("user_id", "ts", "event_id")
    clicks, views = side("click"), side("view")
    seen = O.observe_join(clicks, views, lambda a, b: windowed_join(a, b, ["user_id"], "ts", "1 day").drop("right_ts"), "join")
    step = O.join_step(clicks, ["user_id"], 86_400) | {"tupleWidthIn": seen["width_in"], "tupleWidthOut": seen["width_out"], "avgRealSelectivity": f"{seen['selectivity']:.9f}"}
    rows = [(template, name, str(value)) for template, none in (("all", False), ("filters", True)) for name, value in O.features("join", step, none).items()]
    return t.spark.createDataFrame(rows, "template string, feature string, value string")


@R.query(
    "o03_plan_nodes",
    """SELECT 0 AS id, 'source' AS operator_type, CAST(NULL AS BIGINT) AS window_length, CAST(NULL AS BIGINT) AS sliding_length, CAST(NULL AS VARCHAR) AS literal, count(*) AS n FROM events
    UNION ALL SELECT 1, 'filter', NULL, NULL, 'click', count(*) FROM events WHERE event_type = 'click'
    UNION ALL SELECT 2, 'windowedAggregate', 7200, 3600, NULL, count(*) FROM (SELECT DISTINCT user_id, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events WHERE event_type = 'click')""",
)
def plan_nodes(t: Tables) -> DataFrame:
    """The node table of a query's own plan, with the rows that each node puts out."""
    events = t["events"].select("user_id", "ts", "event_type", "value")
    clicks = events.where("event_type = 'click'")
    windowed = clicks.groupBy("user_id", F.window("ts", "2 hours", "1 hour")).agg(F.sum("value").alias("total"))
    nodes = O.plan_nodes(t.spark, O.plan_steps(windowed))
    sizes = [events, clicks, windowed]
    counts = None
    for k, df in enumerate(sizes):
        one = df.agg(F.count("*").alias("n")).select(F.lit(k).cast("bigint").alias("id"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return nodes.join(counts, "id").select(F.col("id").cast("int").alias("id"), "operator_type", "window_length", "sliding_length", "literal", "n")


QUERIES, ORACLES = R.queries, R.oracles
