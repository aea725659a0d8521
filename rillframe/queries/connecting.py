"""Queries for sources, sinks, formats and the catalog (S rows), and star-schema reports."""

from __future__ import annotations

import contextlib
import io
import re
import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from rillframe.operators.aggregates import summary
from rillframe.plans.scratch import fresh_path
from rillframe.queries.registry import Registry
from rillframe.sources import connectors as S
from rillframe.sources import streams as ST
from rillframe.sources.tables import Tables
from rillframe.streaming.drains import run_live, run_to_end

R = Registry()
NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
PART = "SELECT p_partkey, p_name, p_size, p_retailprice FROM part"


def part(t: Tables) -> DataFrame:
    return t["part"].select("p_partkey", "p_name", "p_size", "p_retailprice")


R.add("s01_from_elements", lambda t: S.from_elements(t.spark, [(0, "a"), (1, "b"), (2, None)], "r_regionkey int, letter string").join(t["region"], "r_regionkey").select("r_regionkey", "letter", "r_name"), "SELECT r_regionkey, ['a', 'b', NULL][r_regionkey + 1] AS letter, r_name FROM region WHERE r_regionkey < 3")
R.sql("s02_values", "SELECT r_regionkey, v.b FROM region JOIN (VALUES (0, 'x'), (1, 'y')) AS v(a, b) ON a = r_regionkey")
R.add("s03_number_sequence", lambda t: S.number_sequence(t.spark, 1, 24).join(t["nation"], F.col("id") == F.col("n_nationkey")).select("id", "n_name"), "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name FROM nation WHERE n_nationkey BETWEEN 1 AND 24")
BITS = "CAST('0x' || substr(md5('7:{}:' || i), 1, 8) AS BIGINT)"
R.add("s04_generated", lambda t: S.generated(t.spark, t["events"].count(), 7, k=lambda h: h % 10, v=lambda h: (h % 1000) / 1000.0), f"SELECT i AS id, {BITS.format('k')} % 10 AS k, ({BITS.format('v')} % 1000) / 1000.0 AS v FROM (SELECT unnest(range(count(*))) AS i FROM events)")


@R.query("s05_csv", PART)
def csv(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "csv")
    rows = part(t).select(F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")).alias("value"))
    rows.unionByName(t.spark.createDataFrame([("# a comment",)], "value string")).write.text(path)
    return S.read_csv(t.spark, path, "p_partkey bigint, p_name string, p_size int, p_retailprice double")


@R.query("s06_typed_csv_fields", "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS p_size FROM part")
def typed_csv(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "csv")
    size = F.when(F.col("p_partkey") % 3 == 0, "oops").otherwise(F.col("p_size").cast("string"))
    part(t).select(F.concat_ws("|", F.col("p_partkey").cast("string"), size).alias("value")).write.text(path)
    return S.read_csv(t.spark, path, "p_partkey bigint, p_size int")


def _lines(t: Tables) -> str:
    path = fresh_path(t.spark, "lines")
    t["nation"].select(F.col("n_name").alias("value")).write.text(path)
    return path


R.add("s07_text_lines", lambda t: S.read_lines(t.spark, _lines(t)), "SELECT n_name AS value FROM nation")


@R.query("s08_watched_lines", "SELECT n_name AS value, CAST(n_nationkey % 2 AS BIGINT) AS run FROM nation")
def watched_lines(t: Tables) -> DataFrame:
    """Files that appear between two runs are the second run's input."""
    folder, paths, runs = fresh_path(t.spark, "watched"), {}, []
    for k in (0, 1):
        t["nation"].where(F.col("n_nationkey") % 2 == k).select(F.col("n_name").alias("value")).write.mode("append").text(folder)
        _, out, checkpoint = run_to_end(S.watch_lines(t.spark, folder), out=fresh_path(t.spark, "run"), **paths)
        paths = {"checkpoint": checkpoint}
        runs.append(t.spark.read.schema("value string, batch int").parquet(out).select("value", F.lit(k).cast("bigint").alias("run")))
    return runs[0].unionByName(runs[1])


@R.query("s09_file_filter", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 0")
def file_filter(t: Tables) -> DataFrame:
    """A folder that also holds a hidden file and one that is being copied, all of them named."""
    root = fresh_path(t.spark, "mixed")
    path = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration())
    named = []
    for k, name in enumerate(("part.parquet", "_hidden.parquet", ".dot.parquet", "part.parquet._COPYING_")):
        t["nation"].where(F.col("n_regionkey") == k).select("n_nationkey", "n_name", "n_regionkey").coalesce(1).write.parquet(f"{root}/{k}")
        written = next(x.getPath() for x in system.listStatus(path(f"{root}/{k}")) if x.getPath().getName().startswith("part-"))
        system.rename(written, path(f"{root}/{name}"))
        named.append(f"{root}/{name}")
    return S.without_hidden_files(t.spark.read.schema("n_nationkey int, n_name string, n_regionkey int").parquet(*named))


R.add("s10_json_rows", lambda t: t["nation"].select(S.json_encode(F.struct("n_nationkey", F.expr("nullif(n_regionkey, 1)").alias("r"))).alias("j")).select("j", S.json_decode(F.col("j"), "n_nationkey int, missing string, r int").alias("d")).select("d.n_nationkey", "d.missing", "d.r", F.col("j").contains("null").alias("kept_null")), "SELECT n_nationkey, CAST(NULL AS VARCHAR) AS missing, nullif(n_regionkey, 1) AS r, n_regionkey = 1 AS kept_null FROM nation")
R.add("s11_csv_rows", lambda t: t["nation"].select(S.csv_encode(F.struct("n_nationkey", "n_name", "n_regionkey"), ";").alias("line")).select("line", S.csv_decode(F.col("line"), "k int, name string, r int", ";").alias("d")).select("line", "d.k", "d.name"), "SELECT CAST(n_nationkey AS VARCHAR) || ';' || n_name || ';' || CAST(n_regionkey AS VARCHAR) AS line, n_nationkey AS k, n_name AS name FROM nation")
R.add("s12_parquet", lambda t: S.round_trip(t["customer"].select("c_custkey", F.struct("c_name", "c_acctbal").alias("who")), "parquet").select("c_custkey", "who.c_name", "who.c_acctbal"), "SELECT c_custkey, c_name, c_acctbal FROM customer")
R.add("s13_orc", lambda t: S.round_trip(part(t), "orc"), PART)


@R.query("s14_csv_sink", "SELECT n_nationkey, n_name, n_regionkey, true AS refused FROM nation")
def csv_sink(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "csv")
    nation = t["nation"].select("n_nationkey", "n_name", "n_regionkey")
    S.write_csv(nation.limit(3), path)
    try:
        S.write_csv(nation, path)
        refused = False
    except Exception as error:
        refused = "EXISTS" in str(error).upper()
    S.write_csv(nation, path, files=2, overwrite=True)
    return t.spark.read.schema("n_nationkey int, n_name string, n_regionkey int").csv(path).withColumn("refused", F.lit(refused))


@R.query("s15_file_sink", "SELECT event_id, event_type FROM events")
def file_sink(t: Tables) -> DataFrame:
    """Spark's own file sink, which writes each row exactly once; files roll by records."""
    out, checkpoint = fresh_path(t.spark, "sink"), fresh_path(t.spark, "checkpoint")
    query = t.stream("events").select("event_id", "event_type").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", 50_000).trigger(availableNow=True).start()
    query.awaitTermination()
    return t.spark.read.parquet(out)


@R.query("s16_discard", "SELECT count(*) AS n FROM lineitem")
def discard(t: Tables) -> DataFrame:
    S.discard(t["lineitem"])
    return t["lineitem"].agg(F.count("*").alias("n"))


R.add("s18_collect", lambda t: t.spark.createDataFrame(t["region"].collect(), t["region"].schema), "SELECT * FROM region")
R.add("s19_from_pandas", lambda t: t.spark.createDataFrame(t["nation"].toPandas(), t["nation"].schema), "SELECT * FROM nation")


@R.query("s20_multi_sink", "SELECT CAST(n_nationkey AS BIGINT) AS k, 'a' AS sink FROM nation UNION ALL SELECT CAST(n_regionkey AS BIGINT), 'b' FROM nation")
def multi_sink(t: Tables) -> DataFrame:
    a, b = fresh_path(t.spark, "a"), fresh_path(t.spark, "b")
    S.write_all(t["nation"], lambda df: df.select(F.col("n_nationkey").cast("bigint").alias("k")).write.parquet(a), lambda df: df.select(F.col("n_regionkey").cast("bigint").alias("k")).write.parquet(b))
    return t.spark.read.parquet(a).withColumn("sink", F.lit("a")).unionByName(t.spark.read.parquet(b).withColumn("sink", F.lit("b")))


R.add(
    "s21_hybrid_source",
    lambda t: S.hybrid(t["events"].drop("props"), t.stream("events").drop("props"), "ts", F.lit("2024-01-15").cast("timestamp")).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids")),
    "SELECT CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'history' ELSE 'live' END AS source, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1",
)


@R.query("s22_custom_source", "SELECT CAST(n_nationkey AS BIGINT) AS n, CAST(n_nationkey * n_nationkey AS BIGINT) AS square FROM nation")
def custom_source(t: Tables) -> DataFrame:
    t.spark.dataSource.register(S.SequenceSource)
    squares = t.spark.read.format("squares").option("rows", t["nation"].count()).option("splits", 3).load()
    return squares.join(t["nation"], F.col("n") == F.col("n_nationkey")).select("n", "square")


def in_log(t: Tables) -> DataFrame:
    return t["events"].select("event_id", "event_type", "ts", F.concat(F.lit("s"), F.col("user_id") % 4).alias("split"))


LOG = "event_id bigint, event_type string, ts timestamp"


@R.query("s22_stream_source", "SELECT event_id, 's' || (user_id % 4) AS split, CAST(CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 0 ELSE 1 END AS BIGINT) AS run FROM events")
def stream_source(t: Tables) -> DataFrame:
    """A source with offsets by split, read some rows of each split at a time: a run that stops and one
    that goes on from its checkpoint, over what has come in between, read no record twice."""
    ST.register(t.spark)
    log, out, checkpoint = (fresh_path(t.spark, x) for x in ("log", "from-log", "checkpoint"))
    found = []
    for k, part in enumerate(("ts < '2024-01-16'", "ts >= '2024-01-16'")):
        ST.append_to_log(in_log(t).where(part), log, "split", k)
        share = max(1, t["events"].count() // 12)  # some batches, however large the table
        rows = ST.read_log(t.spark, log, LOG, "ts", "1 day", share).select("event_id", "split", "offset")
        _, out, checkpoint = run_live(rows, checkpoint=checkpoint, out=out)
        found.append(t.spark.read.parquet(out).select("event_id", "split", "offset"))
    before, after = found
    once = after.groupBy("event_id", "split", "offset").count().where("count = 1")
    return once.join(before.withColumn("run", F.lit(0).cast("bigint")), ["event_id", "split", "offset"], "left").select("event_id", "split", F.coalesce("run", F.lit(1).cast("bigint")).alias("run"))


@R.query("s22_stream_source_watermark", "SELECT strftime(w, '%Y-%m-%d') AS day, n FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS w, count(*) AS n FROM events GROUP BY 1) WHERE w + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 DAY FROM events)")
def stream_source_watermark(t: Tables) -> DataFrame:
    """The records' own times move the watermark: days come out once it has passed them."""
    ST.register(t.spark)
    log = fresh_path(t.spark, "log")
    ST.append_to_log(in_log(t), log, "split", 0)
    daily = ST.read_log(t.spark, log, LOG, "ts", "2 days").groupBy(F.window("record_ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    _, out, _ = run_live(daily.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n"))
    return t.spark.read.parquet(out).select("day", "n")


@R.query("s23_two_phase_sink", "SELECT event_id FROM events")
def two_phase_sink(t: Tables) -> DataFrame:
    sink, rows = S.TwoPhaseSink(t.spark), t.stream("events").select("event_id")
    query = rows.writeStream.option("checkpointLocation", fresh_path(t.spark, "checkpoint")).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    sink(t["events"].select("event_id"), 0)  # a batch that comes again is left alone
    sink.write(t["events"].select("event_id"), 1)  # one that was never committed isn't seen
    return sink.read(rows.schema).select("event_id")


def until_done(start) -> int:
    """Starts a stream anew until it ends without an error; the number of errors."""
    failures = 0
    while True:
        try:
            start(failures).awaitTermination()
            return failures
        except StreamingQueryException:
            failures += 1
            if failures > 3:
                raise


@R.query("s23_stream_writer", "SELECT event_id, CAST(event_id % 2 AS BIGINT) AS batch FROM events")
def stream_writer(t: Tables) -> DataFrame:
    """A sink with a commit protocol of its own. Each of two batches fails the first time, when some of
    its tasks have written: the batch is aborted, and its second run is committed. A batch that is
    committed again changes nothing, and files of which no commit tells aren't seen."""
    ST.register(t.spark)
    path, source, checkpoint = (fresh_path(t.spark, x) for x in ("committed", "source", "checkpoint"))
    events = t["events"].select("event_id")
    for k in (0, 1):
        events.where(F.col("event_id") % 2 == k).repartition(4).write.mode("append").parquet(source)

        def start(failures: int):
            rows = t.spark.readStream.schema(events.schema).parquet(source)
            broken = F.raise_error(F.lit("lost on the way")).cast("bigint")
            rows = rows.select(F.when(F.lit(failures == 0) & (F.col("event_id") % 1000 < 3), broken).otherwise(F.col("event_id")).alias("event_id"))
            return rows.writeStream.format("committed_folder").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

        until_done(start)
    writer = ST.FolderWriter(path, events.schema)
    again = [Row(event_id=-1)]
    writer.commit([writer.write(iter(again))], 0)  # a batch that is committed already
    writer.abort([writer.write(iter(again)), None], 2)
    writer.write(iter(again))  # the driver is lost before it commits
    return ST.committed(t.spark, path, events.schema)


@R.query("s24_delivery", "SELECT 'at least once' AS kind, 2 * count(*) AS n, count(DISTINCT event_id) AS ids FROM events UNION ALL SELECT 'exactly once', count(*), count(DISTINCT event_id) FROM events")
def delivery(t: Tables) -> DataFrame:
    """Sinks that are lost once each, when a batch has been written and before the stream knows of it: the
    batch comes again. One that appends then has it twice, one that overwrites the batch's own folder once."""
    rows = t.stream("events").select("event_id")

    def run(write) -> None:
        checkpoint, lost = fresh_path(t.spark, "checkpoint"), []

        def sink(batch: DataFrame, number: int) -> None:
            write(batch, number)
            if number not in lost:
                lost.append(number)
                raise RuntimeError("lost behind the write")

        until_done(lambda _: rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start())

    appended, once = fresh_path(t.spark, "appended"), fresh_path(t.spark, "once")
    run(lambda batch, _: batch.write.mode("append").parquet(appended))
    run(lambda batch, number: batch.write.mode("overwrite").parquet(f"{once}/batch={number}"))
    count = lambda path, kind: t.spark.read.parquet(path).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))
    return count(appended, "at least once").unionByName(count(once, "exactly once"))


@R.query("s25_insert", "SELECT n_nationkey AS x, CAST(NULL AS INTEGER) AS y FROM nation WHERE n_regionkey = 2")
def insert(t: Tables) -> DataFrame:
    name = f"dest_{uuid.uuid4().hex[:8]}"
    t.spark.sql(f"CREATE TABLE {name} (x INT, y INT) USING parquet")
    t.sql(f"INSERT INTO {name} (y, x) SELECT n_regionkey, n_nationkey FROM nation")
    t.sql(f"INSERT OVERWRITE {name} (x) SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
    return t.spark.table(name)


@R.query("s26_partitioned_insert", "SELECT n_nationkey AS x, 'p' || CAST(n_regionkey AS VARCHAR) AS p FROM nation WHERE n_regionkey IN (1, 2) UNION ALL SELECT 7, 'fixed'")
def partitioned_insert(t: Tables) -> DataFrame:
    name = f"destp_{uuid.uuid4().hex[:8]}"
    t.spark.sql(f"CREATE TABLE {name} (x INT, p STRING) USING parquet PARTITIONED BY (p)")
    t.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    t.sql(f"INSERT INTO {name} PARTITION (p) SELECT n_nationkey, 'p' || CAST(n_regionkey AS STRING) FROM nation WHERE n_regionkey = 1")
    t.spark.sql(f"INSERT INTO {name} PARTITION (p = 'fixed') SELECT 6")
    t.spark.sql(f"INSERT OVERWRITE {name} PARTITION (p = 'fixed') SELECT 7")
    t.sql(f"INSERT INTO {name} PARTITION (p) SELECT n_nationkey, 'p' || CAST(n_regionkey AS STRING) FROM nation WHERE n_regionkey = 2")
    return t.spark.table(name)


@R.query("s27_ctas", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def ctas(t: Tables) -> DataFrame:
    name = f"ctas_{uuid.uuid4().hex[:8]}"
    t.sql(f"CREATE TABLE {name} USING parquet AS WITH a AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) SELECT * FROM a")
    return t.spark.table(name)


@R.query("s28_load_partition", "SELECT n_nationkey, 'a' AS p FROM nation")
def load_partition(t: Tables) -> DataFrame:
    root = fresh_path(t.spark, "loaded")
    for _ in range(2):
        t["nation"].select("n_nationkey").write.mode("overwrite").parquet(f"{root}/p=a")
    return t.spark.read.parquet(root).select("n_nationkey", F.col("p").cast("string").alias("p"))


@R.query("s29_catalog", "SELECT n_regionkey, true AS listed FROM nation GROUP BY 1")
def catalog(t: Tables) -> DataFrame:
    name = f"listed_{uuid.uuid4().hex[:8]}"
    t["nation"].write.partitionBy("n_regionkey").saveAsTable(name)
    listed = any(x.name == name for x in t.spark.catalog.listTables())
    shown = t.spark.sql(f"SHOW PARTITIONS {name}").select(F.split("partition", "=")[1].cast("int").alias("n_regionkey"))
    return shown.withColumn("listed", F.lit(listed))


@R.query("s30_explain", "SELECT detail, c AS column_name, p_brand FROM (SELECT unnest(['cost', 'extended', 'formatted', 'json', 'simple']) AS detail) JOIN (SELECT unnest(['p_brand', 'p_size']) AS c) ON true JOIN (SELECT DISTINCT p_brand FROM part WHERE p_size > 45) ON true")
def explain(t: Tables) -> DataFrame:
    """Plans in every detail tell the columns that the scan reads, which are those of the query's result and filter."""
    query = t["part"].where("p_size > 45").select("p_brand").distinct()
    mark = {"cost": "sizeInBytes", "extended": "Analyzed Logical Plan", "formatted": "PushedFilters", "json": "AttributeReference", "simple": "Physical Plan"}
    rows = [(detail, c) for detail, what in mark.items() for text in [S.explained(query, detail)] for c in t["part"].columns if what in text and c in _read(text)]
    return t.spark.createDataFrame(rows, "detail string, column_name string").crossJoin(F.broadcast(query))  # some brands


def _read(plan: str) -> set[str]:
    """Columns that a plan's scan reads, as its text has them; in JSON those of its filters and results."""
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan)
    if schema:
        return {x.split(":")[0] for x in schema[1].split(",")}
    return set(re.findall(r'"name":"(\w+)"', plan.split("LogicalRelation")[0]))


@R.query("s31_schema", "SELECT column_name, column_type FROM (DESCRIBE SELECT p_brand, count(*) AS n, max(p_retailprice) AS dearest, max(p_size) AS largest FROM part GROUP BY p_brand)")
def schema(t: Tables) -> DataFrame:
    """Names and types after an aggregation, as the other engine calls them."""
    names = {"string": "VARCHAR", "int": "INTEGER"}
    grouped = t["part"].groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_retailprice").alias("dearest"), F.max("p_size").alias("largest"))
    return t.spark.createDataFrame([(f.name, names.get(f.dataType.simpleString(), f.dataType.simpleString().upper())) for f in grouped.schema], "column_name string, column_type string")


@R.query(
    "s31_schema_read_back",
    """SELECT column_name, column_type, n AS non_nulls FROM (DESCRIBE SELECT o_orderpriority, CAST(sum(o_totalprice) AS DECIMAL(18, 2)) AS spent, CAST(max(o_orderdate) AS DATE) AS latest, count(*) > 10 AS many, CAST(avg(o_totalprice) AS FLOAT) AS mean, count(*) AS n FROM orders GROUP BY 1)
    JOIN (SELECT count(DISTINCT o_orderpriority) AS n FROM orders) ON true""",
)
def schema_read_back(t: Tables) -> DataFrame:
    """Names and types after casts, as a table that was written has them, and the values that it has of each."""
    name = f"typed_{uuid.uuid4().hex[:8]}"
    typed = t["orders"].groupBy("o_orderpriority").agg(
        F.sum("o_totalprice").cast("decimal(18,2)").alias("spent"), F.max("o_orderdate").cast("date").alias("latest"), (F.count("*") > 10).alias("many"), F.avg("o_totalprice").cast("float").alias("mean"), F.count("*").alias("n")
    )
    typed.write.saveAsTable(name)
    table = t.spark.table(name)
    names = {"string": "VARCHAR", "int": "INTEGER"}
    types = t.spark.createDataFrame([(f.name, names.get(f.dataType.simpleString(), f.dataType.simpleString().upper())) for f in table.schema], "column_name string, column_type string")
    return types.join(summary(table), "column_name").select("column_name", "column_type", "non_nulls")


@R.query("s17_print", "SELECT 'nation> ' AS prefix, n_nationkey, n_name, n_regionkey FROM nation")
def printed(t: Tables) -> DataFrame:
    """Rows as the printing sink writes them, read from what it has printed."""
    nation, out = t["nation"].select("n_nationkey", "n_name", "n_regionkey"), io.StringIO()
    with contextlib.redirect_stdout(out):
        S.show_rows(nation, nation.count(), "nation> ")
    lines = t.spark.createDataFrame([(line,) for line in out.getvalue().splitlines()], "line string")
    parts = F.split("line", "(?<=> )", 2)
    return lines.select(parts[0].alias("prefix"), F.from_json(parts[1], nation.schema).alias("r")).select("prefix", "r.*")


@R.query("s32_views", "SELECT count(*) AS n FROM nation WHERE n_regionkey = 3")
def views(t: Tables) -> DataFrame:
    t["nation"].where("n_regionkey = 3").createOrReplaceTempView("third_region")
    return t.spark.table("third_region").agg(F.count("*").alias("n"))


@R.query("s33_not_null", "SELECT n_nationkey, n_regionkey <> 2 AS fine, true AS refused FROM nation")
def not_null(t: Tables) -> DataFrame:
    """Rows that break the constraint fail the write, or go to an output of their own."""
    nation = t["nation"].select("n_nationkey", F.expr("nullif(n_regionkey, 2)").alias("r"))
    try:
        S.discard(S.not_null(nation, "r"))
        refused = False
    except Exception as error:
        refused = "null in r" in str(error)
    good, bad = S.split_nulls(nation, "r")
    both = good.withColumn("fine", F.lit(True)).unionByName(bad.withColumn("fine", F.lit(False)))
    return both.select("n_nationkey", "fine", F.lit(refused).alias("refused"))


@R.query("s34_upsert", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def upsert(t: Tables) -> DataFrame:
    changes = t["events"].select("user_id", "event_id", "ts")
    version = F.struct("ts", "event_id")
    _, path = S.upsert(t.spark, None, changes.where("event_id % 2 = 0"), "user_id", version)
    _, path = S.upsert(t.spark, path, changes, "user_id", version)
    table, _ = S.upsert(t.spark, path, changes, "user_id", version)  # the same batch again
    return table.select("user_id", "event_id")


R.sql("star_brand_revenue", "SELECT p_brand, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 ORDER BY revenue DESC, p_brand, y LIMIT 50")
R.sql("star_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00' GROUP BY 1, 2")
R.sql("star_forecast_revenue", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
R.sql("star_large_orders", "SELECT c_custkey, o_orderkey, round(sum(l_quantity), 2) AS quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) GROUP BY 1, 2")
R.sql("star_regional_volume", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY n_name")
R.sql("star_rollup_rank", "SELECT k, s, total, CAST(rank() OVER (PARTITION BY lvl, CASE WHEN lvl = 0 THEN k END ORDER BY total DESC) AS INTEGER) AS place FROM (SELECT p_brand AS k, p_size AS s, CAST(grouping(p_brand) + grouping(p_size) AS BIGINT) AS lvl, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ROLLUP (p_brand, p_size))")
R.sql("star_class_share", "SELECT p_brand, p_size, round(total * 100 / sum(total) OVER (PARTITION BY p_brand), 4) AS share FROM (SELECT p_brand, p_size, sum(l_extendedprice) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)")
R.sql(
    "star_neighbour_months",
    """WITH m AS (SELECT p_brand, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(extract(month FROM o_orderdate) AS BIGINT) AS mo, sum(CAST(l_extendedprice AS DECIMAL(12, 2))) AS total
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
    r AS (SELECT p_brand, y, mo, total, rank() OVER (PARTITION BY p_brand ORDER BY y, mo) AS rn FROM m)
    SELECT a.p_brand, a.y, a.mo, CAST(a.total AS DOUBLE) AS total, CAST(b.total AS DOUBLE) AS month_before, CAST(c.total AS DOUBLE) AS month_after
    FROM r a JOIN r b ON a.p_brand = b.p_brand AND a.rn = b.rn + 1 JOIN r c ON a.p_brand = c.p_brand AND a.rn = c.rn - 1 WHERE a.y = 1997""",
)
R.sql(
    "star_cumulative_channels",
    """WITH a AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d, sum(sum(l_quantity)) OVER (PARTITION BY l_suppkey ORDER BY CAST(l_shipdate AS DATE)) AS total FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey, CAST(l_shipdate AS DATE)),
    b AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d, sum(sum(l_quantity)) OVER (PARTITION BY l_suppkey ORDER BY CAST(l_shipdate AS DATE)) AS total FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_suppkey, CAST(l_shipdate AS DATE)),
    j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.d, b.d) AS d, a.total AS returned, b.total AS new FROM a FULL JOIN b ON a.k = b.k AND a.d = b.d),
    c AS (SELECT k, d, max(returned) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS returned, max(new) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS new FROM j)
    SELECT k, CAST(d AS STRING) AS d, returned, new FROM c WHERE returned > new""",
)
R.sql(
    "star_channel_rollup",
    """WITH s AS (SELECT l_suppkey AS id, sum(CAST(l_extendedprice AS DECIMAL(12, 2))) AS sales FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
    r AS (SELECT l_suppkey AS id, sum(CAST(l_extendedprice AS DECIMAL(12, 2))) AS back FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1),
    c AS (SELECT o_custkey AS id, sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS sales FROM orders GROUP BY 1),
    u AS (SELECT 'supplier' AS channel, s.id, s.sales, coalesce(r.back, 0) AS back FROM s LEFT JOIN r ON s.id = r.id UNION ALL SELECT 'customer', c.id, c.sales, 0 FROM c)
    SELECT channel, id, CAST(sum(sales) AS DOUBLE) AS sales, CAST(sum(back) AS DOUBLE) AS back FROM u GROUP BY ROLLUP (channel, id)""",
)
R.sql(
    "star_variation_pairs",
    # Of n, the sum and the sum of squares, which are exact for whole quantities: stddev_samp / avg itself is on either side of 0.5 by rounding.
    """WITH m AS (SELECT l_suppkey AS k, CAST(extract(year FROM l_shipdate) * 12 + extract(month FROM l_shipdate) AS BIGINT) AS mo, CAST(count(l_quantity) AS DOUBLE) AS n, sum(l_quantity) AS s, sum(l_quantity * l_quantity) AS q FROM lineitem GROUP BY 1, 2),
    f AS (SELECT k, mo, sqrt(n * (n * q - s * s) / ((n - 1) * s * s)) AS ratio FROM m WHERE n > 1 AND s > 0 AND 4 * n * (n * q - s * s) > (n - 1) * s * s)
    SELECT a.k, a.mo, round(a.ratio, 6) AS ratio, round(b.ratio, 6) AS next_ratio FROM f a JOIN f b ON a.k = b.k AND b.mo = a.mo + 1""",
)

QUERIES, ORACLES = R.queries, R.oracles
