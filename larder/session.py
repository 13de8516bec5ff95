"""SparkSession construction and shared-storage helpers.

Every job in the library is a plain ``DataFrame -> DataFrame`` function; the
session only fixes the settings the results depend on (ANSI mode, UTC) and
the runtime settings that matter at scale (AQE, skew-join splitting).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session of the library gets.  Results depend on the first
# two (ANSI arithmetic and the session time zone); the rest are runtime.
BASE_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str | None = None, app: str = "larder",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Return a session with the library settings.

    ``master`` is only given for local runs (tests, bench); on a cluster the
    launcher decides.  ``shuffle_partitions`` should be sized so one shuffle
    partition stays around 128-256 MB at the target scale.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        b = b.config("spark.ui.enabled", "false")
        b = b.config("spark.ui.showConsoleProgress", "false")
        b = b.config("spark.driver.memory", os.environ.get("LARDER_DRIVER_MEM", "8g"))
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    for k, v in BASE_CONF.items():
        spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, sub: str = "") -> str:
    """Folder on shared storage for checkpoints and intermediate tables.

    It is the session's ``spark.checkpoint.dir``; a folder of one machine would
    not survive the loss of an executor, so an unset value is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/") + ("/" + sub.strip("/") if sub else "")


def stored_dir(spark: SparkSession, sub: str) -> str:
    """Folder for tables that later jobs read again, such as an index.

    Under the shared folder where the session names one.  Only where none is named and the
    master is one machine (tests, bench), a folder of that machine is made and named.
    """
    if not spark.conf.get("spark.checkpoint.dir", None) and (spark.sparkContext.master or "").startswith("local["):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="larder-stored-"))
    return shared_dir(spark, sub)
