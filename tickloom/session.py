"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_OWN: dict[str, tempfile.TemporaryDirectory] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tickloom") -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    It is set here only when the session leaves it open *and* runs on one
    machine; on a cluster an unset folder is an error, since a machine-local
    path would be lost with its executor.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _OWN:     # one folder per application, gone when the program ends
        _OWN[application] = tempfile.TemporaryDirectory(prefix="tickloom-", ignore_cleanup_errors=True)
    return _OWN[application].name


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables a job writes and reads back."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Used before a frame is read twice (for its chunk totals and for its
    rows), and to cut the lineage of chained scans.
    """
    path = new_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
