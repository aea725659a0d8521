"""Small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from rillframe.functions import scalars
from rillframe.operators import aggregates as A
from rillframe.operators import columns as C
from rillframe.operators import observing as O
from rillframe.operators.patterns import Step, next_match
from rillframe.sources import connectors as S
from rillframe.streaming import windows as W


def values(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def foo(spark):
    return spark.createDataFrame([(k, k) for k in range(1, 6)], "x int, y int")


@pytest.fixture(scope="module")
def bar(spark):
    return spark.createDataFrame([(1, "a"), (1, "aa"), (2, "b")], "i int, s string")


def test_joins_and_sets(foo, bar):
    left = foo.join(bar, F.col("y") == F.col("i"), "left").orderBy("x", "s")
    assert [(r.x, r.s) for r in left.collect()] == [(1, "a"), (1, "aa"), (2, "b"), (3, None), (4, None), (5, None)]
    assert values(foo.join(bar, F.col("x") + F.col("i") > 4, "left_semi")) == [(3, 3), (4, 4), (5, 5)]
    assert values(foo.select("x").intersect(bar.select("i"))) == [(1,), (2,)]


def test_count_windows(spark):
    rows = [(1, "hi"), (2, "hello"), (3, "hi"), (4, "hello"), (5, "hi"), (6, "hello"), (6, "hello")]
    df = spark.createDataFrame([(k, n, w) for k, (n, w) in enumerate(rows)], "k int, n int, w string")
    assert values(W.count_tumbling(df, 2, ["w"], ["k"], F.sum("n").alias("total")).select("w", "total")) == [("hello", 6), ("hello", 12), ("hi", 4)]
    one = spark.createDataFrame([("a", n) for n in range(1, 8)], "key string, n int")
    assert [r.total for r in W.count_sliding(one, 3, 2, ["key"], ["n"], total=F.sum("n")).orderBy("n").collect()] == [3, 9, 15]


def test_sensor_lines(spark):
    lines = ["2004-02-28 00:59:16.02785 3 1 19.9884 37.0933 45.08 2.69964", "2004-02-28 00:59:16.02785 3 1 19.9884 37.0933 45.08", "2004-02-28 00:59:16.02785 x 1 19.9884 37.0933 45.08 2.69964"]
    good, bad = C.parse_sensor_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [tuple(r) for r in good.collect()] == [(3, 1, 19.9884, 37.0933, 45.08, 2.69964, 1077929956)]
    assert bad.count() == 2


def test_json(spark):
    contacts = spark.createDataFrame([(1, '{"name":"Ada","tel":123,"addr":{"country":"Germany","city":"Berlin"}}')], "id int, info string")
    schema = "name string, tel bigint, addr struct<country string, city string>"
    assert '"tel":124' in contacts.select(scalars.json_increment(F.col("info"), "tel", schema)).first()[0]
    row = contacts.select(S.json_encode(S.json_decode(F.lit('{"svt":"x"}'), "svt string, ops struct<id string>, ids array<int>"))).first()[0]
    assert row == '{"svt":"x","ops":null,"ids":null}'


def test_column_rules(spark, foo):
    with pytest.raises(ValueError):
        C.add_columns(foo, x=F.lit(1))
    with pytest.raises(TypeError):
        C.union_same(foo, spark.createDataFrame([("a", 1)], "x string, y int"))
    with pytest.raises(ValueError):
        C.split_by_tag(foo, F.lit("a"), [""])
    assert C.project(foo, 1, 0).columns == ["y", "x"]


def test_scalars(spark):
    one = spark.range(1)
    got = one.select(F.bround(F.lit(55.0), -1), F.round(F.lit(123.45), -2), scalars.half_up(F.lit(-0.125)), scalars.strict_boolean(F.lit("TRUE")), scalars.strict_boolean(F.lit("yes"))).first()
    assert tuple(got) == (60.0, 100.0, -0.12, True, None)


def test_energy_and_extremes(spark):
    readings = spark.createDataFrame([(1, 1000.0, 3600)], "house int, load double, seconds bigint")
    assert readings.agg(A.energy_kwh(F.col("load"), F.col("seconds"))).first()[0] == 1.0
    rows = spark.createDataFrame([("a", 2, 1), ("a", 1, 2), ("a", 1, 3)], "k string, v int, id int")
    assert values(A.extreme_row(rows, ["v"], ["id"], ["k"])) == [("a", 1, 2)]
    assert values(A.extreme_row(rows, ["v"], ["id"], ["k"], largest=True)) == [("a", 2, 1)]


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (4.0, 2.0), (1.0, 0.0)], "l double, p double")
    assert sorted(r[0] for r in df.select(O.q_error(F.col("l"), F.col("p"))).collect()) == [2.0, 2.0, float("inf")]
    assert df.agg(O.q_loss(F.col("l"), F.col("p"))).first()[0] == pytest.approx((2 + 2 + 100) / 3)
    with pytest.raises(ValueError):
        O.encode_features(df, ["absent"], [])


def test_pattern_times_out(spark):
    rows = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "x", "2024-01-01 00:00:01"), (3, "b", "2024-01-01 00:01:00"), (4, "a", "2024-01-01 00:02:00")], "id int, kind string, at string")
    rows = rows.withColumn("ts", F.col("at").cast("timestamp")).withColumn("k", F.lit(1))
    found = next_match(rows, "k", ["ts"], [Step("a", "kind = 'a'"), Step("b", "kind = 'b'", strict=False)], "id", "ts", 600)
    assert values(found.select("a", F.coalesce("b", F.lit(-1)), "timed_out")) == [(1, 3, False), (4, -1, True)]
    strict = next_match(rows, "k", ["ts"], [Step("a", "kind = 'a'"), Step("b", "kind = 'b'")], "id", "ts")
    assert all(r.timed_out for r in strict.collect())


def test_not_null_fails(spark):
    with pytest.raises(Exception, match="null in x"):
        S.not_null(spark.createDataFrame([(None,)], "x int"), "x").collect()
