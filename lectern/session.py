"""Session helpers.

Cluster settings are read from the session; local defaults are applied only where a
setting is unset (tests, bench).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # last value wins when a key repeats in map_from_entries (attribute maps)
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def get_session(master: str | None = None, partitions: int | None = None,
                app: str = "lectern") -> SparkSession:
    """Return the active session or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in _LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("LECTERN_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


_CHOSEN: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must already be set to a shared (distributed) file system path;
    only when it is unset (local tests) is one scratch folder created per application.
    The value is stable for the application (``setCheckpointDir`` nests a fresh folder
    each time it is called, so it is called once)."""
    app = spark.sparkContext.applicationId
    if app not in _CHOSEN:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not configured:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="lectern-ckpt-")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        _CHOSEN[app] = configured
    return _CHOSEN[app]


def run_dir(spark: SparkSession) -> str:
    """This application's folder below the shared checkpoint folder: stand-ins, stages and
    sink tables of concurrent applications never overwrite each other."""
    return f"{checkpoint_dir(spark).rstrip('/')}/lectern-{spark.sparkContext.applicationId}"


def kept(df):
    """``df`` written once below this application's folder and read back: its lineage ends on
    shared storage, as columns (a checkpoint holds whole rows, not compressed), and its size is known."""
    import uuid
    path = f"{run_dir(df.sparkSession)}/lectern-kept/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
