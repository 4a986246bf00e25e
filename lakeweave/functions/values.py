"""Numbers: plausibility, severity, comparison, cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities by urgency with their queues and hours.
ROUTES = {"critical": ("clinical-urgent", 4), "moderate": ("clinical-routine", 24), "mild": ("clinical-routine", 72)}
# Order of tickets by severity; what is unknown comes last.
RANKS = {"critical": 0, "moderate": 1, "mild": 2, "care-gap": 3, "med-recon": 4, "data-quality": 5}
UNKNOWN_RANK = 9


def _choose(key: Column, table: dict, default) -> Column:
    """A literal table by ``key``."""
    out = F
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def rank(severity: Column) -> Column:
    return _choose(F.coalesce(severity, F.lit("")), RANKS, UNKNOWN_RANK)


def queue(severity: Column) -> Column:
    """The queue of a severity; an unknown one goes where mild goes."""
    return _choose(F.coalesce(severity, F.lit("")), {k: v[0] for k, v in ROUTES.items()}, ROUTES["mild"][0])


def sla_hours(severity: Column) -> Column:
    return _choose(F.coalesce(severity, F.lit("")), {k: v[1] for k, v in ROUTES.items()}, ROUTES["mild"][1])


def width(low: Column, high: Column, at_least: float = 1e-9) -> Column:
    """Of a range; of a one-sided one the size of its bound, or 1 for a bound of zero."""
    one = F.abs(F.coalesce(low, high))
    return F.when(low.isNotNull() & high.isNotNull(), F.greatest(high - low, F.lit(at_least))).otherwise(F.greatest(one, F.lit(1.0)))


def implausible(value: Column, low: Column, high: Column, plausible_low: Column, plausible_high: Column, multiple: float = 5.0) -> Column:
    """Outside of governed bounds, or where there are none too far outside of the reference or of the wrong sign."""
    governed = plausible_low.isNotNull() | plausible_high.isNotNull()
    outside = F.coalesce(value < plausible_low, F.lit(False)) | F.coalesce(value > plausible_high, F.lit(False))
    far = multiple * width(low, high)
    generic = F.coalesce(value < low - far, F.lit(False)) | F.coalesce(value > high + far, F.lit(False)) | F.coalesce((low >= 0) & (value < 0), F.lit(False))
    return F.when(governed, outside).otherwise(generic)


def direction(value: Column, low: Column, high: Column) -> Column:
    return F.when(value < low, "low").when(value > high, "high")


def out_of_range_by(value: Column, low: Column, high: Column) -> Column:
    return F.when(value < low, low - value).when(value > high, value - high)


def beyond_critical(value: Column, critical_low: Column, critical_high: Column, way: Column) -> Column:
    return F.coalesce(F.when(way == "low", value < critical_low).when(way == "high", value > critical_high), F.lit(False))


def relative_distance(value: Column, low: Column, high: Column) -> Column:
    """Distance from the reference by its width; null where there is no positive width."""
    span = F.when(low.isNotNull() & high.isNotNull(), high - low).otherwise(F.when(F.coalesce(low, high) == 0, F.lit(1.0)).otherwise(F.abs(F.coalesce(low, high))))
    return F.try_divide(out_of_range_by(value, low, high), F.when(span > 0, span))


def severity(critical: Column, relative: Column) -> Column:
    return F.when(critical, "critical").when(relative > 0.5, "moderate").otherwise("mild")


def same_value(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Numbers within a tolerance, or equal text; null equals null only."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) < tolerance).otherwise(a.cast("string").eqNullSafe(b.cast("string")))


def fixed(value: Column, digits: int) -> Column:
    """Rounded for show."""
    return F.round(value, digits)


def token_cost(rate_in: Column, rate_out: Column, tokens_in: Column, tokens_out: Column, cached: Column | None = None, cache_rate: float = 0.1, batch: Column | None = None, batch_rate: float = 0.5) -> Column:
    """Price of a model call by rates for a million tokens; cached input and batches are cheaper."""
    fresh = tokens_in if cached is None else tokens_in - cached
    total = fresh * rate_in + tokens_out * rate_out
    if cached is not None:
        total = total + cached * rate_in * cache_rate
    if batch is not None:
        total = total * F.when(batch, batch_rate).otherwise(1.0)
    return total / 1e6
