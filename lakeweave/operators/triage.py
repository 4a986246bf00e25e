"""Triage of measurements by thresholds: impossible values apart, the rest by direction and severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values

#: What ``triage`` expects of a row beside the columns it passes on.
ROLES = ("value", "low", "high", "critical_low", "critical_high", "plausible_low", "plausible_high")


def triage(rows: DataFrame, bounds: DataFrame | None = None, on: str = "code", multiple: float = 5.0, **roles: Column | str) -> DataFrame:
    """Each row with outcome: skipped, implausible, in_range or finding; and way, out_by, relative, critical, severity, queue, sla_hours.

    ``roles`` bind value, low, high, critical_low, critical_high, plausible_low, plausible_high to columns; what is not
    bound and no column is null. ``bounds`` is a rule table by ``on`` (bounded by the rules written, so broadcast).
    One projection: no shuffle.
    """
    df = rows if bounds is None else rows.join(F.broadcast(bounds), on, "left")
    found = {r: (F.col(roles[r]) if isinstance(roles[r], str) else roles[r]) if r in roles else F.col(r) if r in df.columns else F.lit(None) for r in ROLES}
    v, low, high, cl, ch, pl, ph = (found[r].cast("double") for r in ROLES)
    v = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    bad = values.implausible(v, low, high, pl, ph, multiple)
    way = values.direction(v, low, high)
    df = df.select("*", v.alias("_v"), bad.alias("_bad"), way.alias("way"), values.out_of_range_by(v, low, high).alias("out_by"), values.relative_distance(v, low, high).alias("relative"), values.beyond_critical(v, cl, ch, way).alias("critical"))
    outcome = F.when(F.col("_v").isNull(), "skipped").when(F.col("_bad"), "implausible").when(F.col("way").isNull(), "in_range").otherwise("finding")
    df = df.withColumn("outcome", outcome)
    hit = F.col("outcome") == "finding"
    severity = F.when(hit, values.severity(F.col("critical"), F.col("relative"))).when(F.col("outcome") == "implausible", "data-quality")
    df = df.withColumn("severity", severity)
    return df.withColumns({"queue": F.when(hit, values.queue(F.col("severity"))).when(F.col("severity") == "data-quality", "data-quality"), "sla_hours": F.when(hit, values.sla_hours(F.col("severity")))}).drop("_v", "_bad")


def findings(triaged: DataFrame) -> DataFrame:
    return triaged.filter(F.col("outcome") == "finding")


def data_quality(triaged: DataFrame) -> DataFrame:
    return triaged.filter(F.col("outcome") == "implausible")


def ranked(found: DataFrame, *ties: str) -> DataFrame:
    """By urgency, then distance out of range, then ``ties`` (an explicit order stands for a stable sort)."""
    return found.orderBy(values.rank(F.col("severity")), F.desc("out_by"), *ties)
