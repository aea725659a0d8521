"""Disk that operators hold while they run."""

import os
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from rillframe.llm import lattice
from rillframe.plans import scratch


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p for f in folders for p in Path(str(f)).rglob("shuffle_*.data")}


def test_saved_tables_let_their_shuffles_go(spark):
    before, setting = shuffle_files(spark), spark.conf.get(scratch.LET_GO, None)
    held = spark.range(50_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n"))
    assert scratch.Scratch(spark).save(held, "held").count() == 1000
    left = {p for p in shuffle_files(spark) - before if p.exists()}
    assert len(left) <= 1, left  # the count's own
    assert spark.conf.get(scratch.LET_GO, None) == setting


def test_lattice_disk_in_proportion(spark, tmp_path, monkeypatch):
    """Scratch tables and shuffles of op3 against a table of single and near vectors."""
    draw = np.random.default_rng(5)
    centres = draw.standard_normal((250, 64))
    spread = centres[draw.integers(0, 250, 3_000)] + 0.25 * draw.standard_normal((3_000, 64))
    rows = [(k, [float(x) for x in v], k % 3) for k, v in enumerate(spread.astype(np.float32))]
    path = str(tmp_path / "vectors")
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(4).write.parquet(path)
    most, saved = [0], lattice.Scratch.save

    def save(self, df, name, *options):
        out = saved(self, df, name, *options)
        root = Path(scratch.scratch_root(spark).removeprefix("file://"))
        mine = [root / Path(p).name for p in self.paths.values()]
        most[0] = max(most[0], sum(os.path.getsize(f) for folder in mine for f in folder.rglob("*.parquet")))
        return out

    monkeypatch.setattr(lattice.Scratch, "save", save)
    got = lattice.near_vectors(spark.read.parquet(path)).toPandas()
    assert len(got) == 3_000 and got.n_links.sum() > 3_000
    assert most[0] < 3 * sum(os.path.getsize(f) for f in Path(path).rglob("*.parquet"))
