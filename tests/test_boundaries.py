"""Values that lie exactly on a query's limit."""

import datetime

import duckdb
import numpy as np

from rillframe.queries.connecting import ORACLES, QUERIES


def test_variation_of_exactly_a_half(spark, tmp_path):
    """Quantities whose deviation is just half their mean are not above it, in whatever order they are
    added; others are."""
    draw, rows = np.random.default_rng(2), []
    for k in range(400):
        for month in (1, 2):
            if k % 4 == 0:
                quantities = [1.0, 9.0]
            else:  # d * 1, 2, 3 has the mean 2d and the deviation d; so have such rows with others of half
                d = float(k % 16 + 1)
                quantities = [d, 2 * d, 3 * d]
            draw.shuffle(quantities)
            rows += [(k, datetime.datetime(1995, month, 3), q) for q in quantities]
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows, "l_suppkey bigint, l_shipdate timestamp_ntz, l_quantity double").repartition(7).write.parquet(path)
    got = {(r.k, r.ratio, r.next_ratio) for r in QUERIES["star_variation_pairs"](spark, str(tmp_path)).collect()}
    assert {k for k, _, _ in got} == {k for k in range(400) if k % 4 == 0}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/*.parquet'")
    assert got == {(k, a, b) for k, _, a, b in con.sql(ORACLES["star_variation_pairs"]).fetchall()}
