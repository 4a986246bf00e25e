"""Payloads for an outside system. Nothing is ever sent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reshape import project

# Priorities by severity; others get P3.
PRIORITY = {"critical": "P1", "moderate": "P2", "mild": "P3", "care-gap": "P3", "med-recon": "P3", "data-quality": "P4"}
# The payload's keys, each with the columns of which the first that a ticket has gives it.
COPIED = {"external_id": ("id",), "queue": ("queue",), "patient_ref": ("patient_id",), "source": ("source",)}
# What a ticket is about, and what is said of it: columns that may hold either, in order, with what stands between.
SUBJECT = ("component", "expected_test", "expected_code", "medication", "checker")
SAID = (("value", " = "), ("gap_type", ": "), ("discrepancy", ": "))


def default_payload(tickets: DataFrame) -> DataFrame:
    """(external_id, summary, priority, queue, patient_ref, description, source) of each ticket; columns that it lacks count as null."""
    row = tickets.select("*", *(F.lit(None).cast("string").alias(c) for c in dict.fromkeys(("severity", "unit", *SUBJECT, *(c for c, _ in SAID), *(c for own in COPIED.values() for c in own))) if c not in tickets.columns))
    known = lambda columns: F.coalesce(*(F.col(c).cast("string") for c in columns))
    unit = F.when(F.col("value").isNotNull() & F.col("unit").isNotNull(), F.concat(F.lit(" "), F.col("unit"))).otherwise("")
    more = F.coalesce(*(F.concat(F.lit(between), F.col(c).cast("string")) for c, between in SAID))
    made = {key: known(columns) for key, columns in COPIED.items()}
    made["summary"] = F.concat(known(SUBJECT), F.lit(" — "), F.col("severity"))
    made["description"] = F.concat(known(SUBJECT), F.coalesce(F.concat(more, unit), F.lit("")))
    made["priority"] = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in PRIORITY.items() for x in pair)), F.coalesce("severity", F.lit(""))), F.lit("P3"))
    return row.select(*(made[c].alias(c) for c in ("external_id", "summary", "priority", "queue", "patient_ref", "description", "source")))


def publish(tickets: DataFrame, field_map: dict[str, str] | None = None, target: str = "dry-run") -> DataFrame:
    """(target, dry_run, payload json) of each ticket, by a field map or the default payload. Always a dry run."""
    made = project(tickets, field_map) if field_map else default_payload(tickets)
    return made.select(F.lit(target).alias("target"), F.lit(True).alias("dry_run"), F.to_json(F.struct(*made.columns)).alias("payload"))
