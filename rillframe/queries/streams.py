"""Queries for event time, windows, triggers and state (T rows), in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from rillframe.operators.joins import bucketed_interval_join, connect, interval_join
from rillframe.plans.scratch import fresh_path
from rillframe.queries.registry import Registry
from rillframe.sources.tables import Tables
from rillframe.streaming import changelog as L
from rillframe.streaming import metrics as M
from rillframe.streaming import state as S
from rillframe.streaming import triggers as G
from rillframe.streaming import windows as W
from rillframe.streaming.drains import drain, run_in_parts, run_to_end
from rillframe.streaming.lateness import windows_with_lateness
from rillframe.streaming.rules import RuleBook

R = Registry()
STAMP = "yyyy-MM-dd HH:mm:ss"


def rows_():
    return F.count("*").alias("n")


def total_():
    return F.round(F.sum("value"), 4).alias("total")


def ids_():
    return rows_(), F.sum("event_id").alias("ids")


def rounded_():
    return "key", "at", F.round("total", 4).alias("total")


def start(column: str = "window.start"):
    return F.date_format(column, STAMP).alias("start")


HOURLY = "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type = 'purchase' GROUP BY ALL"


def hourly(events: DataFrame) -> DataFrame:
    return W.tumbling(events.where("event_type = 'purchase'"), "ts", "1 hour", ["user_id"], rows_(), total_()).select(start(), "user_id", "n", "total")


def latest(df: DataFrame, *keys: str) -> DataFrame:
    """The newest update of each key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in (*keys, "batch")]), "batch").alias("r")).select(*keys, "r.*")


R.add("t04_tumbling_window", lambda t: hourly(t["events"]), HOURLY)
R.add("t04_tumbling_window_stream", lambda t: latest(drain(hourly(t.stream("events")), "update"), "start", "user_id"), HOURLY)


@R.query("t01_watermark", "SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS n FROM events GROUP BY 1) WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 5 SECOND FROM events)")
def watermark(t: Tables) -> DataFrame:
    """Append mode puts out the windows that the watermark has passed."""
    events = W.bounded_out_of_orderness(t.stream("events").select("ts"), "ts", "5 seconds")
    return drain(W.tumbling(events, "ts", "1 hour", [], rows_()).select(start(), "n")).drop("batch")


@R.query("t02_monotonous", "SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS n FROM events GROUP BY 1) WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)")
def monotonous(t: Tables) -> DataFrame:
    return drain(W.tumbling(W.monotonous(t.stream("events").select("ts"), "ts"), "ts", "1 hour", [], rows_()).select(start(), "n")).drop("batch")


@R.query("t03_event_time_column", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts + INTERVAL 1 HOUR), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events GROUP BY 1")
def event_time_column(t: Tables) -> DataFrame:
    shifted = W.with_event_time(t["events"], "rowtime", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    return W.tumbling(shifted, "rowtime", "1 day", [], rows_()).select(start(), "n")


R.add("t05_sliding_window", lambda t: W.sliding(t["events"], "ts", "6 hours", "2 hours", ["event_type"], rows_(), total_()).select(start(), "event_type", "n", "total"), "SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 2 HOUR, ts), time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 2 HOUR, time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 4 HOUR]) AS w FROM events) GROUP BY ALL")
R.add("t05_sliding_without_slide", lambda t: W.sliding(t["events"], "ts", "6 hours", None, [], rows_()).select(start(), "n"), "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events GROUP BY 1")
SESSIONS = """WITH e AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
    s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 4 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
    SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k"""
R.add("t06_session_window", lambda t: W.session(t["events"], "ts", "4 hours", ["user_id"], rows_()).select(start(), "user_id", "n"), SESSIONS)
GAPS = """WITH e AS (SELECT *, max(ts + CASE event_type WHEN 'purchase' THEN INTERVAL 1 HOUR WHEN 'view' THEN INTERVAL 8 HOUR ELSE INTERVAL 4 HOUR END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_until FROM events),
    s AS (SELECT *, sum(CASE WHEN open_until IS NULL OR ts >= open_until THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
    SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k"""
R.add("t07_session_dynamic_gap", lambda t: W.session(t["events"], "ts", F.when(F.col("event_type") == "purchase", "1 hour").when(F.col("event_type") == "view", "8 hours").otherwise("4 hours"), ["user_id"], rows_()).select(start(), "user_id", "n"), GAPS)
R.add("t08_processing_time_window", lambda t: W.processing_time(t["events"], "1 day", ["event_type"], rows_()).select("event_type", "n", F.current_timestamp().between(F.col("window.start"), F.col("window.end")).alias("now"), ((F.unix_seconds("window.end") - F.unix_seconds("window.start")) / 3600).cast("bigint").alias("hours")), "SELECT event_type, count(*) AS n, true AS now, CAST(24 AS BIGINT) AS hours FROM events GROUP BY 1")

COUNTS = "SELECT user_id AS key, max(event_id) AS at, round(sum(value), 4) AS total FROM (SELECT *, floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 5) AS w FROM events) GROUP BY user_id, w HAVING count(*) = 5"
SLIDES = "SELECT user_id AS key, event_id AS at, round(total, 4) AS total FROM (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS total, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn % 2 = 0"


def keyed(t: Tables) -> DataFrame:
    """A file a batch, at most: what a batch holds of a key doesn't grow with the table."""
    return t.stream("events", 1).select("user_id", "event_id", "ts", "event_type", "value")


R.add("t09_count_window", lambda t: W.count_tumbling(t["events"], 5, ["user_id"], ["event_id"], F.max("event_id").alias("at"), F.round(F.sum("value"), 4).alias("total")).select(F.col("user_id").alias("key"), "at", "total"), COUNTS)
R.add("t09_count_window_stream", lambda t: drain(S.process(keyed(t), "user_id", S.CountWindow("value", "event_id", 5), "key bigint, at bigint, total double")).select(*rounded_()), COUNTS)
R.add("t10_sliding_count_window", lambda t: W.count_sliding(t["events"], 5, 2, ["user_id"], ["event_id"], total=F.sum("value")).select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), F.round("total", 4).alias("total")), SLIDES)
R.add("t10_sliding_count_window_stream", lambda t: drain(S.process(keyed(t), "user_id", S.CountWindow("value", "event_id", 5, 2), "key bigint, at bigint, total double")).select(*rounded_()), SLIDES)
R.add("t11_global_window_trigger", lambda t: drain(S.process(keyed(t), "user_id", S.CountTrigger("value", "event_id", 10), "key bigint, at bigint, total double")).select(*rounded_()), "SELECT user_id AS key, event_id AS at, round(total, 4) AS total FROM (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn % 10 = 0")
R.add("t12_purging_count_trigger", lambda t: drain(S.process(keyed(t), "user_id", S.CountWindow("value", "event_id", 5, 5, purge=True), "key bigint, at bigint, total double")).select(*rounded_()), COUNTS)
R.add("t12_continuous_trigger", lambda t: drain(S.process(keyed(t), "user_id", S.ContinuousTrigger("value", "ts", "event_id", 14_400), "key bigint, at bigint, total double")).select(*rounded_()), "WITH b AS (SELECT user_id, CAST(floor(epoch(ts) / 14400) AS BIGINT) AS b, sum(coalesce(value, 0)) AS s FROM events GROUP BY ALL) SELECT user_id AS key, (b + 1) * 14400 AS at, round(sum(s) OVER (PARTITION BY user_id ORDER BY b), 4) AS total FROM b QUALIFY b < max(b) OVER (PARTITION BY user_id)")
R.add("t13_window_function", lambda t: W.tumbling(t["events"], "ts", "1 day", ["user_id"], F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds")).select(start(), "user_id", "kinds"), "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY ALL")
R.add("t14_windowed_aggregate", lambda t: W.tumbling(t["events"], "ts", "12 hours", ["event_type"], F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 3).alias("mean"), total_()).select(start(), "event_type", "least", "most", "mean", "total"), "SELECT strftime(time_bucket(INTERVAL 12 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, min(value) AS least, max(value) AS most, round(avg(value), 3) AS mean, round(sum(value), 4) AS total FROM events GROUP BY ALL")
LATE = "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY event_id % 97, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE before - ts > INTERVAL 3 DAY"


def shuffled(events: DataFrame) -> DataFrame:
    return events.withColumn("arrival", (F.col("event_id") % 97) * 10_000_000_000 + F.col("event_id"))


R.add("t15_late_side_output", lambda t: W.split_late(shuffled(t["events"]), "ts", "arrival", ["user_id"], 3 * 86_400)[1].agg(*ids_()), LATE)
R.add("t15_late_side_output_stream", lambda t: drain(S.process(shuffled(t.stream("events", 1)), "user_id", S.LateTag("ts", "arrival", 3 * 86_400), "key bigint, at bigint, late boolean")).where("late").select((F.col("at") % 10_000_000_000).alias("event_id")).agg(*ids_()), LATE)
R.add("t16_stream_group_aggregate", lambda t: latest(drain(t.stream("events").groupBy("event_type").agg(rows_(), total_()), "update"), "event_type"), "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")


@R.query("t17_stream_distinct", "SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events")
def stream_distinct(t: Tables) -> DataFrame:
    """Distinct within days of event time: the watermark lets go of the days that it has passed. Days
    arrive in two parts, and rows of the first part come again with the second."""
    events = t["events"].select("user_id", "event_type", "ts")
    early = F.dayofmonth("ts") <= 15
    days = lambda df, _: df.withWatermark("ts", "2 days").select("user_id", "event_type", F.window("ts", "1 day").alias("day")).dropDuplicates(["user_id", "event_type", "day"])
    found = run_in_parts([events.where(early), events.where(~early).unionByName(events.where(early))], days)
    return found.select("user_id", "event_type", F.date_format("day.start", "yyyy-MM-dd").alias("day"))


RUNNING = "SELECT user_id AS key, event_id AS at, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS total FROM events"
R.add("t18_keyed_process", lambda t: drain(S.process(keyed(t), "user_id", S.RunningSum("value", "event_id"), "key bigint, at bigint, total double")).select(*rounded_()), RUNNING)
R.add("t19_value_state", lambda t: drain(S.process(keyed(t), "user_id", S.KeepLast("ts", "event_id"), "key bigint, id bigint", "update"), "update").groupBy("key").agg(F.max_by("id", "batch").alias("id")), "SELECT user_id AS key, arg_max(event_id, (ts, event_id)) AS id FROM events GROUP BY 1")
R.add("t20_list_state", lambda t: drain(S.process(keyed(t), "user_id", S.CountWindow("value", "event_id", 3, 1), "key bigint, at bigint, total double")).select(*rounded_()), "SELECT user_id AS key, event_id AS at, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS total FROM events")
R.add("t21_map_state", lambda t: latest(drain(S.process(keyed(t), "user_id", S.CountsByValue("event_type"), "key bigint, value string, n bigint", "update"), "update"), "key", "value"), "SELECT user_id AS key, event_type AS value, count(*) AS n FROM events GROUP BY ALL")
R.add("t22_aggregating_state", lambda t: drain(S.process(keyed(t), "user_id", S.Accumulator("value", "event_id"), "key bigint, at bigint, total double, n bigint")).select(*rounded_(), "n"), "SELECT user_id AS key, event_id AS at, round(sum(coalesce(value, 0)) OVER w, 4) AS total, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")


def halves(t: Tables) -> list[DataFrame]:
    events = t["events"].select("user_id", "event_id", "ts", "event_type", "value")
    return [events.where(F.col("event_id") % 2 == k) for k in (0, 1)]


@R.query("t23_state_ttl", "SELECT user_id AS key, event_id AS at, round(sum(value) OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id), 4) AS total FROM events")
def state_ttl(t: Tables) -> DataFrame:
    """Sums that expire between two runs begin anew in the second."""
    summed = lambda df, _: S.process(df, "user_id", S.RunningSum("value", "event_id", ttl_ms=2_000), "key bigint, at bigint, total double", time_mode="ProcessingTime")
    return run_in_parts(halves(t), summed, pause=3.0, idle_batches=False).select(*rounded_())


@R.query("t25_idle_retention", "SELECT user_id AS key, event_type AS value, coalesce(nullif(count(CASE WHEN event_id % 2 = 1 THEN 1 END), 0), count(*)) AS n FROM events GROUP BY ALL")
def idle_retention(t: Tables) -> DataFrame:
    """Counts of keys that were idle for longer than the retention begin anew."""
    counted = lambda df, _: S.process(df, "user_id", S.CountsByValue("event_type", ttl_ms=2_000), "key bigint, value string, n bigint", "update", "ProcessingTime")
    return latest(run_in_parts(halves(t), counted, "update", pause=3.0, idle_batches=False), "key", "value")


@R.query("t24_timers", "SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 1 HOUR < (SELECT date_trunc('millisecond', max(ts)) FROM events)")
def timers(t: Tables) -> DataFrame:
    """Keys whose last row lies an hour behind the watermark when the input ends."""
    rows = keyed(t).select("user_id", "ts").withWatermark("ts", "0 seconds")
    return drain(S.process(rows, "user_id", S.InactivityTimer("ts", 3_600_000), "key bigint, n bigint", time_mode="EventTime")).drop("batch")


@R.query("t26_resume", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def resume(t: Tables) -> DataFrame:
    """A second run goes on from the checkpoint of the first, over input that came in between and
    reading it with another parallelism; its sums hold what the first run has seen."""
    summed = lambda df, k: df.repartition(2 + 3 * k).groupBy("event_type").agg(rows_(), total_())
    return latest(run_in_parts(halves(t), summed, "update"), "event_type")


@R.query("t27_state_evolution", "SELECT user_id AS key, round(sum(coalesce(value, 0)), 4) AS total, CAST(count(CASE WHEN event_id % 2 = 1 THEN 1 END) AS BIGINT) AS n FROM events GROUP BY 1")
def state_evolution(t: Tables) -> DataFrame:
    """A first version runs over half of the rows; a second, with one more field in its state, goes
    on from its checkpoint over the other half."""
    t.spark.conf.set("spark.sql.streaming.stateStore.encodingFormat", "avro")
    summed = lambda df, k: S.process(df, "user_id", S.EvolvingTotal("value", counted=k == 1), "key bigint, total double, n bigint", "update")
    rows = run_in_parts(halves(t), summed, "update")
    t.spark.conf.unset("spark.sql.streaming.stateStore.encodingFormat")
    return latest(rows, "key").select("key", F.round("total", 4).alias("total"), "n")


@R.query("t28_read_state", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def read_state(t: Tables) -> DataFrame:
    _, _, checkpoint = run_to_end(t.stream("events").groupBy("event_type").agg(rows_()), "update")
    return t.spark.read.format("statestore").load(checkpoint).select("key.event_type", F.col("value.count").alias("n"))


@R.query(
    "t29_tumble_join_tumble",
    """WITH a AS (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL),
    b AS (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY ALL)
    SELECT strftime(time_bucket(INTERVAL 1 DAY, a.w), '%Y-%m-%d %H:%M:%S') AS start, CAST(sum(a.n * b.n) AS BIGINT) AS n FROM a JOIN b ON a.user_id = b.user_id AND a.w >= b.w AND a.w <= b.w + INTERVAL 6 HOUR GROUP BY 1""",
)
def tumble_join_tumble(t: Tables) -> DataFrame:
    def side(kind: str, ts: str, n: str) -> DataFrame:
        return W.tumbling(t["events"].where(F.col("event_type") == kind), "ts", "1 hour", ["user_id"], F.count("*").alias(n)).select("user_id", F.col("window.start").alias(ts), n)

    joined = bucketed_interval_join(side("click", "at", "clicks"), side("view", "seen", "views"), "user_id", "at", "seen", 6 * 3600)
    return W.tumbling(joined, "at", "1 day", [], F.sum(F.col("clicks") * F.col("views")).alias("n")).select(start(), "n")


@R.query("t30_metrics", "SELECT count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(avg(value), 4) AS mean, count(*) AS metered, true AS rated FROM events")
def metrics(t: Tables) -> DataFrame:
    """Counter, gauge and distribution (number, sum, extremes, mean) beside a running stream, and a
    meter: rows and rows a second from its progress."""
    seen = Observation("events")
    t["events"].observe(seen, rows_(), total_(), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 4).alias("mean")).write.format("noop").mode("overwrite").save()
    got = seen.get
    query, _, _ = run_to_end(t.stream("events").select("event_id"))
    progress = query.recentProgress
    metered, rated = sum(p.numInputRows for p in progress), any(p.processedRowsPerSecond > 0 for p in progress)
    return t.spark.createDataFrame([(got["n"], got["total"], got["least"], got["most"], got["mean"], metered, rated)], "n bigint, total double, least double, most double, mean double, metered bigint, rated boolean")


@R.query("t31_job_handle", "SELECT count(*) AS n, count(*) AS read, true AS was_active, false AS active, true AS same_id FROM events")
def job_handle(t: Tables) -> DataFrame:
    """Id, status, progress and cancelling: a query that would wait for more input is stopped, and
    the next run on its checkpoint has its id."""
    rows = t.stream("events").select("event_id")
    out, checkpoint = fresh_path(t.spark, "handled"), fresh_path(t.spark, "checkpoint")
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()
    query.processAllAvailable()
    was_active, read = query.isActive, sum(p.numInputRows for p in query.recentProgress)
    query.stop()
    again = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    again.awaitTermination()
    return t.spark.read.parquet(out).agg(rows_()).select("n", F.lit(read).cast("bigint").alias("read"), F.lit(was_active).alias("was_active"), F.lit(query.isActive).alias("active"), F.lit(query.id == again.id).alias("same_id"))


@R.query("j14_connected_stream", "SELECT user_id AS key, event_id AS at, seen FROM (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen FROM events WHERE event_type IN ('click', 'purchase')) WHERE event_type = 'purchase'")
def connected_stream(t: Tables) -> DataFrame:
    """Clicks and purchases are two inputs of one processor: a purchase finds its user's last click."""
    side = lambda kind: t.stream("events").where(F.col("event_type") == kind).select("user_id", "ts", "event_id")
    return drain(S.process(connect(side("click"), side("purchase")), "user_id", S.Connected("ts", "event_id"), "key bigint, at bigint, seen bigint")).drop("batch")


@R.query("j12_interval_join_stream", "SELECT a.event_id AS purchase, b.event_id AS seen_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.ts >= b.ts AND a.ts <= b.ts + INTERVAL 1 DAY WHERE a.event_type = 'purchase' AND b.event_type = 'view'")
def interval_join_stream(t: Tables) -> DataFrame:
    side = lambda kind, ts, name: t.stream("events").where(F.col("event_type") == kind).select("user_id", F.col("ts").alias(ts), F.col("event_id").alias(name)).withWatermark(ts, "1 day")
    joined = interval_join(side("purchase", "at", "purchase"), side("view", "seen", "seen_id"), "user_id", "at", "seen", "0 SECONDS", "1 DAY")
    return drain(joined.select("purchase", "seen_id")).drop("batch")


@R.query("w06_keep_first_stream", "SELECT user_id || ':' || event_type AS key, arg_min(event_id, (ts, event_id)) AS id FROM events GROUP BY 1")
def keep_first_stream(t: Tables) -> DataFrame:
    """The earliest row of each key, whichever part of the input it comes with."""
    first = lambda df, _: S.process(df.withColumn("k", F.concat_ws(":", "user_id", "event_type")), "k", S.KeepLast("ts", "event_id", first=True), "key string, id bigint", "update")
    return run_in_parts(halves(t)[::-1], first, "update").groupBy("key").agg(F.max_by("id", "batch").alias("id"))


@R.query("w08_stream_order", "SELECT row_number() OVER (ORDER BY n DESC, event_type) AS place, event_type, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def stream_order(t: Tables) -> DataFrame:
    """Complete mode sorts what an aggregation holds; the last batch is the whole result."""
    ordered = drain(t.stream("events").groupBy("event_type").agg(rows_()).orderBy(F.desc("n"), "event_type"), "complete")
    last = ordered.where(F.col("batch") == ordered.agg(F.max("batch")).first()[0])
    return last.select(F.row_number().over(Window.orderBy(F.desc("n"), "event_type")).cast("bigint").alias("place"), "event_type", "n")


@R.query("w08_event_time_order", "SELECT user_id AS key, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events WHERE ts < (SELECT date_trunc('millisecond', max(ts)) FROM events)")
def event_time_order(t: Tables) -> DataFrame:
    """Rows in the order of their times, as far as the watermark has come when the input ends."""
    rows = keyed(t).select("user_id", "event_id", "ts").withWatermark("ts", "0 seconds")
    return drain(S.process(rows, "user_id", S.EventTimeSort("ts", "event_id"), "key bigint, id bigint, place bigint", time_mode="EventTime")).drop("batch")


NOBODY = -1
MIDDLE = "TIMESTAMP '2024-01-16 00:00:00'"


def closing(t: Tables) -> DataFrame:
    """One row far ahead, of a user of its own, that brings the watermark past all others."""
    last = {"ts": F.lit("2100-01-01"), "user_id": F.lit(NOBODY), "event_id": F.lit(NOBODY)}
    events = keyed_batch(t)
    return t.spark.range(1).select(*[last.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields])


def keyed_batch(t: Tables) -> DataFrame:
    return t["events"].select("user_id", "event_id", "ts", "event_type", "value")


def out_of_order(t: Tables) -> list[DataFrame]:
    """Events in two parts: rows of a quarter of a day behind the middle come in either, and behind
    all of them a row that closes the stream."""
    first = F.expr(f"ts < {MIDDLE} OR (ts < {MIDDLE} + INTERVAL 6 HOURS AND event_id % 2 = 1)")
    events = keyed_batch(t)
    return [events.where(first), events.where(~first).unionByName(closing(t))]


@R.query(
    "t15_allowed_lateness",
    f"""WITH e AS (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS s, event_id % 5 <> 0 OR ts >= {MIDDLE} AS in_time FROM events),
    w AS (SELECT date_trunc('millisecond', max(ts)) AS w FROM events WHERE ts < {MIDDLE} AND event_id % 5 <> 0),
    g AS (SELECT user_id, s, count(CASE WHEN in_time THEN 1 END) AS n, sum(CASE WHEN in_time THEN coalesce(value, 0) ELSE 0 END) AS v, count(*) AS n_all, sum(coalesce(value, 0)) AS v_all, s + INTERVAL 1 DAY <= (FROM w) AS passed, s + INTERVAL 4 DAY <= (FROM w) AS gone FROM e GROUP BY user_id, s)
    SELECT user_id, strftime(s, '%Y-%m-%d') AS day, 'first' AS kind, CASE WHEN passed THEN n ELSE n_all END AS n, round(CASE WHEN passed THEN v ELSE v_all END, 4) AS total FROM g WHERE n > 0 OR NOT passed
    UNION ALL SELECT user_id, strftime(s, '%Y-%m-%d'), 'corrected', n_all, round(v_all, 4) FROM g WHERE passed AND NOT gone AND n_all > n
    UNION ALL SELECT user_id, strftime(s, '%Y-%m-%d'), 'rejected', n_all - n, round(v_all - v, 4) FROM g WHERE gone AND n_all > n""",
)
def allowed_lateness(t: Tables) -> DataFrame:
    """Days of each user that wait three days for late rows: a fifth of the rows of the first half come
    with the second half, when the watermark has passed their days or their days' lateness."""
    events = keyed_batch(t)
    in_time = F.expr(f"ts < {MIDDLE} AND event_id % 5 <> 0")
    parts = [events.where(in_time), events.where(~in_time).unionByName(closing(t))]
    found = run_in_parts(parts, lambda df, _: windows_with_lateness(df, "user_id", "ts", "value", 86_400, 3 * 86_400), "update")
    return found.where(F.col("key") != NOBODY).select(F.col("key").alias("user_id"), F.date_format(F.timestamp_seconds("start"), "yyyy-MM-dd").alias("day"), "kind", "n", F.round("total", 4).alias("total"))


@R.query("t12_event_time_trigger", "WITH b AS (SELECT user_id, CAST(floor(epoch(ts) / 14400) AS BIGINT) AS b, sum(coalesce(value, 0)) AS s FROM events GROUP BY ALL) SELECT user_id AS key, (b + 1) * 14400 AS at, round(sum(s) OVER (PARTITION BY user_id ORDER BY b), 4) AS total FROM b")
def event_time_trigger(t: Tables) -> DataFrame:
    """Every stretch fires, a key's last as well: timers need no later row of the key."""
    fired = lambda df, _: S.process(df.withWatermark("ts", "1 day").where("ts IS NOT NULL"), "user_id", G.EventTimeTrigger("value", "ts", 14_400_000), "key bigint, at bigint, total double", time_mode="EventTime")
    return run_in_parts(out_of_order(t), fired).where(F.col("key") != NOBODY).select(*rounded_())


@R.query("t12_event_time_purging_trigger", "SELECT user_id AS key, (CAST(floor(epoch(ts) / 14400) AS BIGINT) + 1) * 14400 AS at, round(sum(coalesce(value, 0)), 4) AS total FROM events GROUP BY ALL")
def event_time_purging_trigger(t: Tables) -> DataFrame:
    fired = lambda df, _: S.process(df.withWatermark("ts", "1 day").where("ts IS NOT NULL"), "user_id", G.EventTimeTrigger("value", "ts", 14_400_000, purge=True), "key bigint, at bigint, total double", time_mode="EventTime")
    return run_in_parts(out_of_order(t), fired).where(F.col("key") != NOBODY).select(*rounded_())


@R.query(
    "t12_processing_time_trigger",
    """WITH g AS (SELECT user_id, event_id % 2 AS part, count(*) AS n, sum(coalesce(value, 0)) AS v FROM events WHERE event_id % 2 = 0 OR user_id % 3 = 0 GROUP BY ALL)
    SELECT user_id AS key, CAST(sum(n) AS BIGINT) AS n, round(sum(v), 4) AS total FROM g GROUP BY 1""",
)
def processing_time_trigger(t: Tables) -> DataFrame:
    """Two parts and a last one without rows of theirs, each a pause behind the one before: keys that are quiet in the
    second part fire in it nevertheless, those that have rows in it fire with them, and keys that are
    new in it fire in the last."""
    first, second = halves(t)
    fired = lambda df, _: S.process(df, "user_id", G.ProcessingTimeTrigger("value", 1_000), "key bigint, n bigint, total double", time_mode="ProcessingTime")
    found = run_in_parts([first, second.where("user_id % 3 = 0"), closing(t)], fired, pause=2.0, idle_batches=False)
    return found.where(F.col("key") != NOBODY).select("key", "n", F.round("total", 4).alias("total"))


@R.query("t12_never_trigger", "SELECT user_id AS key, count(*) AS n, round(sum(coalesce(value, 0)), 4) AS total, CAST(0 AS BIGINT) AS fired FROM events GROUP BY 1")
def never_trigger(t: Tables) -> DataFrame:
    """Nothing comes out; what has been added up is in the state, which is read as a table."""
    df = S.process(keyed(t), "user_id", G.NeverTrigger("value"), "key bigint, n bigint, total double")
    _, out, checkpoint = run_to_end(df)
    fired = t.spark.read.schema(df.schema).parquet(out).count()
    state = t.spark.read.format("statestore").option("stateVarName", "held").load(checkpoint)
    return state.select(F.col("key.user_id").alias("key"), F.col("value.n").alias("n"), F.round("value.total", 4).alias("total"), F.lit(fired).cast("bigint").alias("fired"))


SESSION = "key bigint, began bigint, n bigint, total double, closed boolean"


@R.query("t08_processing_time_sessions", "SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2) AS place, count(*) AS n, round(sum(coalesce(value, 0)), 4) AS total FROM events GROUP BY user_id, event_id % 2")
def processing_time_sessions(t: Tables) -> DataFrame:
    """Two parts that lie further apart than the gap: two sessions of each key that has rows in both,
    closed by timers, the last ones in a batch that has no rows of theirs."""
    sessions = lambda df, _: S.process(df, "user_id", G.ProcessingTimeSession("value", 1_500), SESSION, "update", "ProcessingTime")
    found = run_in_parts([*halves(t), closing(t)], sessions, "update", pause=2.5, idle_batches=False).where(F.col("closed") & (F.col("key") != NOBODY))
    return found.select("key", F.row_number().over(Window.partitionBy("key").orderBy("began")).cast("bigint").alias("place"), "n", F.round("total", 4).alias("total"))


@R.query("t08_processing_time_one_session", "SELECT user_id AS key, count(*) AS n, round(sum(coalesce(value, 0)), 4) AS total FROM events GROUP BY 1")
def processing_time_one_session(t: Tables) -> DataFrame:
    """Two parts within the gap: one session a key, which holds the rows of both."""
    sessions = lambda df, _: S.process(df, "user_id", G.ProcessingTimeSession("value", 7_200_000), SESSION, "update", "ProcessingTime")
    return latest(run_in_parts(halves(t), sessions, "update", idle_batches=False), "key", "began").select("key", "n", F.round("total", 4).alias("total"))


@R.query("t08_processing_time_sliding", "SELECT event_type, place, count(*) AS n FROM (SELECT *, unnest([2 * (event_id % 2) + 1, 2 * (event_id % 2) + 2]) AS place FROM events) GROUP BY ALL")
def processing_time_sliding(t: Tables) -> DataFrame:
    """Windows of two seconds of reading time every second over two parts that are read further apart: each
    part lies in two windows of its own."""
    counted = lambda df, _: W.processing_time(df, "2 seconds", ["event_type"], rows_(), slide="1 second")
    found = latest(run_in_parts(halves(t), counted, "update", pause=3.0), "window", "event_type")
    return found.select("event_type", F.dense_rank().over(Window.partitionBy("event_type").orderBy("window.start")).cast("bigint").alias("place"), "n")


@R.query(
    "t25_lazy_clean_up",
    f"""WITH p AS (SELECT user_id, count(CASE WHEN ts < {MIDDLE} THEN 1 END) AS n0, count(CASE WHEN ts >= {MIDDLE} THEN 1 END) AS n1, epoch_ms(max(CASE WHEN ts < {MIDDLE} THEN ts END)) AS l0, epoch_ms(max(CASE WHEN ts >= {MIDDLE} THEN ts END)) AS l1 FROM events GROUP BY 1),
    w AS (SELECT epoch_ms(max(CASE WHEN ts < {MIDDLE} THEN ts END)) AS w0, epoch_ms(max(ts)) AS w1 FROM events),
    q AS (SELECT *, n0 > 0 AND l0 + 259200000 < w0 AS gone0 FROM p, w),
    r AS (SELECT *, n1 + CASE WHEN gone0 THEN 0 ELSE n0 END AS n, CASE WHEN n1 = 0 OR (n0 > 0 AND NOT gone0 AND l0 + 259200000 >= l1 + 172800000) THEN l0 ELSE l1 END + 259200000 AS due FROM q)
    SELECT user_id AS key, n0 AS n, false AS gone FROM r WHERE n0 > 0 UNION ALL SELECT user_id, n0, true FROM r WHERE gone0
    UNION ALL SELECT user_id, n, false FROM r WHERE n1 > 0 UNION ALL SELECT user_id, n, true FROM r WHERE (n1 > 0 OR NOT gone0) AND due < w1""",
)
def lazy_clean_up(t: Tables) -> DataFrame:
    """Counts that go when a user has been idle for two to three days of event time: a row within a day of the
    one that has set the timer leaves the timer where it is."""
    events = keyed_batch(t)
    counted = lambda df, _: S.process(df.withWatermark("ts", "0 seconds").where("ts IS NOT NULL"), "user_id", G.IdleRetention(172_800_000, "ts"), "key bigint, n bigint, gone boolean", "update", "EventTime")
    return run_in_parts([events.where(f"ts < {MIDDLE}"), events.where(f"ts >= {MIDDLE}")], counted, "update").drop("batch")


def changes(t: Tables) -> list[DataFrame]:
    """Two parts of a changelog of events: the second takes back all that the first has put in of every
    fifth user, and has no rows of them."""
    first, second = halves(t)
    taken = first.where("user_id % 5 = 0").withColumn("kind", F.lit(L.DELETE))
    return [first.withColumn("kind", F.lit(L.INSERT)), second.where("user_id % 5 <> 0").withColumn("kind", F.lit(L.INSERT)).unionByName(taken)]


def changelog(t: Tables) -> DataFrame:
    return run_in_parts(changes(t), lambda df, _: L.changelog_aggregate(df, "user_id", "value", "kind"), "update")


R.add("t16_changelog", lambda t: L.applied(changelog(t).drop("batch"), "key").select("key", "n", F.round("total", 4).alias("total")), "SELECT user_id AS key, count(*) AS n, round(sum(coalesce(value, 0)), 4) AS total FROM events WHERE user_id % 5 <> 0 GROUP BY 1")
R.add(
    "t16_changelog_kinds",
    lambda t: changelog(t).groupBy("kind").agg(rows_(), F.sum(F.col("n")).alias("rows")),
    """WITH g AS (SELECT user_id, count(CASE WHEN event_id % 2 = 0 THEN 1 END) AS n0, count(CASE WHEN event_id % 2 = 1 AND user_id % 5 <> 0 THEN 1 END) AS n1 FROM events GROUP BY 1)
    SELECT '+I' AS kind, count(*) AS n, CAST(sum(CASE WHEN n0 > 0 THEN n0 ELSE n1 END) AS BIGINT) AS rows FROM g WHERE n0 + n1 > 0 UNION ALL SELECT unnest(['-U', '+U']), count(*), CAST(unnest([sum(n0), sum(n0 + n1)]) AS BIGINT) FROM g WHERE n0 > 0 AND n1 > 0
    UNION ALL SELECT '-D', count(*), CAST(sum(n0) AS BIGINT) FROM g WHERE n0 > 0 AND user_id % 5 = 0 HAVING count(*) > 0""",
)


@R.query("t16_counts_of_counts", "SELECT n, count(*) AS users FROM (SELECT user_id, count(*) AS n FROM events WHERE user_id % 5 <> 0 GROUP BY 1) GROUP BY 1")
def counts_of_counts(t: Tables) -> DataFrame:
    """How many users have how many rows: a second aggregate over the changes of the first, some files
    at a time. Each user is taken from the group that it leaves."""
    first = changelog(t).drop("batch")
    path = fresh_path(t.spark, "changelog")
    first.write.parquet(path)
    stream = t.spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 3).parquet(path)
    second = drain(L.changelog_aggregate(stream.withColumn("one", F.lit(1.0)), "n", "one", "kind"), "update")
    return L.applied(second.drop("batch"), "key").select(F.col("key").alias("n"), F.col("n").alias("users"))


@R.query("t30_listener", "SELECT count(*) AS metered, count(*) AS total, true AS ended FROM events")
def metered_by_listener(t: Tables) -> DataFrame:
    """A meter per query, which a listener marks with every progress report, and metric rows as a table."""
    listener = M.MeterListener()
    t.spark.streams.addListener(listener)
    try:
        query, _, _ = run_to_end(t.stream("events", 1).select("event_id"))
        ended = listener.wait_for_end(str(query.id))
    finally:
        t.spark.streams.removeListener(listener)
    return listener.rows(t.spark).where(F.col("query") == str(query.id)).agg(F.sum("rows").alias("metered"), F.max("total").alias("total"), F.lit(ended).alias("ended"))


def rules(t: Tables, *versions: tuple[str | None, str, float]) -> DataFrame:
    """Versions of rules for the event types that the table has; None stands for each of them but views."""
    given = t.spark.createDataFrame(versions, "of string, at string, rate double")
    kinds = t["events"].select("event_type").distinct().where("event_type <> 'view'")
    return kinds.join(given, F.coalesce("of", "event_type") == F.col("event_type")).select("event_type", F.col("at").cast("timestamp").alias("valid_from"), "rate")


RULE = "event_type string, valid_from timestamp, rate double"
FIRST = ((None, "2000-01-01", 1.0),)
LATER = (("purchase", "2024-01-16", 9.0), ("purchase", "2024-01-21", 4.0), ("click", "2024-01-16", 2.5))
CORRECTED = (("purchase", "2024-01-16", 3.0),)
RATES = """CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-21 00:00:00' THEN 4.0 WHEN event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-16 00:00:00' THEN 3.0
    WHEN event_type = 'click' AND ts >= TIMESTAMP '2024-01-16 00:00:00' THEN 2.5 ELSE 1.0 END"""


@R.query("j13_valid_rules", f"SELECT event_id, CAST({RATES} AS DOUBLE) AS rate FROM events")
def valid_rules(t: Tables) -> DataFrame:
    """Each row with the version of its rule that held at its time; of two versions for one time the later counts."""
    book = RuleBook(t.spark, RULE, "event_type", "valid_from")
    for versions in (FIRST, LATER, CORRECTED):
        book.publish(rules(t, *versions))
    return book.look_up(t["events"].select("event_id", "event_type", "ts"), "ts").select("event_id", "rate")


@R.query("j13_changing_rules", f"SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_type <> 'view' THEN 1.0 END ELSE {RATES} END AS DOUBLE) AS rate, CAST(event_id % 2 AS BIGINT) AS run FROM events")
def changing_rules(t: Tables) -> DataFrame:
    """A stream that runs before and after new versions are published. Rows of the first part get the
    rules known then; those of the second, old and new ones, the version of their own time."""
    book = RuleBook(t.spark, RULE, "event_type", "valid_from")
    source, out, checkpoint = (fresh_path(t.spark, x) for x in ("rows", "ruled", "checkpoint"))
    book.publish(rules(t, *FIRST))
    for k, part in enumerate(halves(t)):
        part.write.mode("append").parquet(source)
        book.stream(t.spark.readStream.schema(part.schema).parquet(source), "ts", out, checkpoint)
        if k == 0:
            book.publish(rules(t, *LATER))
            book.publish(rules(t, *CORRECTED))
    return t.spark.read.parquet(out).select("event_id", "rate", (F.col("event_id") % 2).alias("run"))


QUERIES, ORACLES = R.queries, R.oracles
