"""Session construction and the settings every plan relies on."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.showConsoleProgress": "false",
}

_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "lodequery", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the one the session names, else a private one (local mode only)."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lodequery-ckpt-")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame, free: bool = False) -> DataFrame:
    """Materialize ``df`` in the shared checkpoint folder, so that a lost executor loses nothing.

    ``free``: the files of its exchanges go at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not free:
        return df.checkpoint(eager=True)
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan takes the setting when it is made
    finally:
        spark.conf.set(_FREE, before)


def default_parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))


def cpu_count() -> int:
    return os.cpu_count() or 1


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, for workers that don't find it by themselves."""
    sc = spark.sparkContext
    if getattr(sc, "_lodequery_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="lodequery-")
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "lodequery"), "zip", os.path.dirname(here), os.path.basename(here)))
    sc._lodequery_shipped = True
