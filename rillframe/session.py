"""Sessions, and the shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings that the library is tested with."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rillframe")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session.

    Functions that run in Python workers are pickled by reference, so the workers must be able to
    import the package, wherever the driver has found it. Matrix products in a worker keep to the one
    core of its task: threads of their own would take cores from other tasks, mostly to wait.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    context.environment.setdefault("OPENBLAS_NUM_THREADS", "1")
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="rillframe-"), "rillframe.zip")
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(Path("rillframe") / path.relative_to(root)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
