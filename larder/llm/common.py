"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def importable(spark: SparkSession) -> None:
    """Let Python workers on machines that have this package where the driver has it import it.

    On other clusters it is handed over as any package is (``--py-files``).
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back from it.

    The folder is the session's ``spark.checkpoint.dir``; one is made only
    where that is unset (tests on one machine).
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="larder-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint()


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model learns from: crc32(id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def learning_rows(df: DataFrame, doc_id: str, limit: int) -> DataFrame:
    """About ``limit`` of the rows of ``df``, picked by a hash of their id.

    ``df`` holds the labelled rows that may be learnt from.  The bound is a
    documented parameter of each classifier; where there are no more rows than
    that, all are taken.  Rows are kept by a threshold on the hash, so no task
    sorts or gathers them.
    """
    n = df.count()
    if n <= limit:
        return df
    cut = int((2 * limit / n - 1) * (2**63 - 1)) if limit < n else 2**63 - 1
    return df.filter(F.xxhash64(F.lit("learn"), F.col(doc_id)) <= F.lit(cut))


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def computed_once(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, joined) -> Column:
    """Running results of an associative ``joined`` over an array without nulls, by doubling: n log n steps, no growing array."""

    def doubled(a: Column, k: Column) -> Column:
        return F.transform(a, lambda x, i: F.coalesce(joined(F.get(a, i - F.call_function("shiftleft", F.lit(1), k)), x), x))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))
    return F.aggregate(steps, values, doubled)


def turn_id(role: Column, text: Column) -> Column:
    """Hex MD5 of a turn; the role's length keeps ("ab", "c") and ("a", "bc") apart."""
    return F.md5(F.encode(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"))


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of an ASCII text expression, bit by bit."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]),
        lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END)), 4294967295::BIGINT)"""
