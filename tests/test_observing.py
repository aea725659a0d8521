"""Features of joins and hosts."""

import os

from rillframe.operators import observing as O


def test_hosts(spark):
    (host,) = O.physical_nodes(spark).collect()
    assert host.physicalCPUCores == os.cpu_count() and host.totalMemory > 1 << 30


def test_features_by_kind(spark):
    step = O.join_step(spark.range(1), ["id"], 60, 30) | {"avgRealSelectivity": 0.5, "filterClass": "int", "tupleWidthIn": None}
    assert O.features("join", step) == {"joinKeyClass": "bigint", "windowType": "sliding", "windowPolicy": "time", "slidingLength": 30, "windowLength": 60, "avgRealSelectivity": 0.5}
    assert O.features("join", step, no_joins=True) == {} and O.features("filter", step) == {"filterClass": "int", "avgRealSelectivity": 0.5}


def test_observed_join_of_nothing(spark):
    none = spark.range(0)
    got = O.observe_join(none, spark.range(3), lambda a, b: a.join(b, "id"), "join")
    assert (got["rows_left"], got["rows_right"], got["rows_out"], got["selectivity"], got["width_in"], got["width_out"]) == (0, 3, 0, None, None, None)
