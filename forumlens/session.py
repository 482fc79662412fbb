"""Spark session and cluster-level settings.

On a cluster the session is created by the platform; ``configure`` only fills in
settings that are still unset, so a cluster's own choices (shuffle partitions,
checkpoint directory, broadcast threshold) always win.
"""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings this library relies on. AQE re-plans joins from runtime sizes (a join
# side is broadcast only when its measured size is under the threshold), splits
# skewed shuffle partitions, and coalesces small ones.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Rows handed to Python at once are bounded by bytes, whatever the length of their texts and vectors.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    conf = spark.conf
    for key, value in DEFAULTS.items():
        if key == "spark.sql.session.timeZone":
            conf.set(key, value)  # results are defined in UTC wall time
        elif conf.get(key, None) is None:
            conf.set(key, value)
    ship_package(spark)
    return spark


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (as ``--py-files`` would):
    the grouped-map and pandas UDF functions are pickled by reference."""
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    import shutil
    from pathlib import Path

    pkg = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="forumlens-pyfiles-")) / "forumlens"
    archive = shutil.make_archive(str(out), "zip", root_dir=str(pkg.parent), base_dir=pkg.name)
    sc.addPyFile(archive)
    _SHIPPED.add(key)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session for tests and the bench (local mode, no UI)."""
    builder = SparkSession.builder
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = (
        builder.master(f"local[{cores}]")
        .appName("forumlens")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("FORUMLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Read from ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets a
    scratch folder; on a cluster, whose machines share no local folder, that is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        current = tempfile.mkdtemp(prefix="forumlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
        spark.sparkContext.setCheckpointDir(current)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written intermediate tables."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet to the shared checkpoint folder and read it from there.

    Used where several readers need the same rows in the same place, or a DataFrame with
    shuffles upstream feeds branches that cannot share an exchange: the work is done once,
    and a lost executor does not recompute the lineage.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
