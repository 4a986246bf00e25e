"""Robust outliers: distance from the median in median absolute deviations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Modified z-score from which a value is an outlier; the factor makes deviations of a normal sample count like its standard deviation.
THRESHOLD, FACTOR = 3.5, 0.6745


def long(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value) of the numeric fields, nulls left out."""
    return df.select(key, *(F.col(f).cast("double").alias(f) for f in fields)).unpivot(key, fields, "field", "value").filter("value is not null")


def outliers(values: DataFrame, group: str = "field", value: str = "value", threshold: float = THRESHOLD, exact: bool = False, least: int = 5) -> DataFrame:
    """Rows whose modified z-score exceeds ``threshold``, with median, mad and z. Groups of equal values or under ``least`` rows have none.

    Medians and deviations are two aggregations joined back; groups are fields, so both tables are small.
    Medians come from mergeable quantile sketches (a rank within a ten-thousandth), whose size does not follow the data;
    ``exact`` asks for the very median, which holds every distinct value of a field in one task.
    """
    middle = F.median if exact else (lambda c: F.percentile_approx(c, 0.5, 10_000))
    med = values.groupBy(group).agg(middle(value).alias("median"), F.count(value).alias("_n"))
    with_med = values.join(F.broadcast(med), group)
    mad = with_med.groupBy(group).agg(middle(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    z = F.try_divide(FACTOR * (F.col(value) - F.col("median")), F.col("mad"))
    return with_med.join(F.broadcast(mad), group).filter(F.col("_n") >= least).withColumn("z", z).filter(F.abs("z") > threshold).drop("_n")
