"""Scans of the source tables (op A5, A9).

Scans are lazy; callers ``select`` the columns they need right after the scan
so Catalyst prunes the Parquet read schema and pushes filters to the reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one source table under ``sf_dir`` (a file or folder glob)."""
    if name not in TABLES:
        raise KeyError(name)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def by_name(spark: SparkSession, name: str) -> DataFrame:
    """Catalog table scan (op A9)."""
    return spark.read.table(name)


def state(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Name of a table's present state: a hash of its files' paths, sizes and times.  Reads no column."""
    meta = F.struct(*[F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_size", "file_modification_time")])
    files = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(meta.alias("m")).distinct()
    one = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("m").cast("decimal(38,0)")).alias("h")).first()
    return f"{name}-{one['n']}-{format(int(one['h'] or 0) % (1 << 64), '016x')}"
