"""Column-expression helpers (all JVM-side built-ins, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def money_text(x: Column) -> Column:
    """Double amount -> 'D.CC' text via integer cents (never via DECIMAL)."""
    cents = F.floor(x * F.lit(1e2) + F.lit(5e-1))
    units = F.floor(cents / F.lit(1e2)).cast("bigint")
    return F.concat(units.cast("string"), F.lit("."),
                    F.lpad((cents.cast("bigint") % 100).cast("string"), 2, "0"))


def ship_day_text(ts: Column) -> Column:
    """Timestamp -> 'yyyy-MM-dd'."""
    return ts.cast("date").cast("string")


def safe_ratio(num: Column, den: Column, default: float | None) -> Column:
    """``num/den`` when ``den > 0``; otherwise ``default`` (op B10)."""
    out = F.when(den > 0, F.try_divide(num, den))
    return out if default is None else out.otherwise(F.lit(default))


def round_half_up(c: Column, digits: int = 4) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d``: the same IEEE steps in every engine.

    ``round()`` rounds the decimal text of a double in Spark but its binary
    value elsewhere, so exact halves differ; this form does not.
    """
    scale = F.lit(float(10 ** digits))
    return F.floor(c * scale + F.lit(5e-1)) / scale


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every float column, so results compare exactly across engines."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(round_half_up(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def ordered(df: DataFrame, *cols) -> DataFrame:
    """Total order with NULLs placed explicitly (last on ascending)."""
    return df.orderBy(*[c if isinstance(c, Column) else F.col(c).asc_nulls_last() for c in cols])


def money_sum(c: Column) -> Column:
    """Exact total of money values: summed as DECIMAL(38,10), returned as DOUBLE.

    A floating sum depends on the order rows arrive in, so totals of millions
    of rows would change with the partitioning; a decimal sum does not.
    """
    return F.sum(c.cast("decimal(38,10)")).cast("double")
