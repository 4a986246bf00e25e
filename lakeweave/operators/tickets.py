"""Tickets from findings: stable ids, one ticket each, order, summary, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from ..functions.text import slug


def ticket_id(prefix: str, *parts: Column) -> Column:
    """PREFIX-part-part; a null part is left out."""
    return F.concat_ws("-", F.lit(prefix), *(p.cast("string") for p in parts))


def finding_id(checker: Column, patient: Column, subject: Column) -> Column:
    """Id of a finding of any checker: its slug, the patient or x, and the subject's slug or the patient."""
    return F.concat_ws("-", slug(checker), F.coalesce(patient.cast("string"), F.lit("x")), F.coalesce(slug(subject), patient.cast("string"), F.lit("x")))


def union(*found: DataFrame) -> DataFrame:
    """Findings of several checkers in one table; columns that one lacks are null."""
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def first_of_each(df: DataFrame, key: str | list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in ``order``."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def with_patient(tickets: DataFrame, patients: DataFrame, key: str) -> DataFrame:
    """Adds patient {id, name, age, sex}; the name is first and last, whichever are there. Tickets without a patient stay."""
    name = F.nullif(F.concat_ws(" ", F.nullif(F.trim("first"), F.lit("")), F.nullif(F.trim("last"), F.lit(""))), F.lit(""))
    return tickets.join(patients.select(key, name.alias("patient_name"), *[c for c in ("age", "sex") if c in patients.columns]), key, "left")


def ordered(tickets: DataFrame, *ties: str) -> DataFrame:
    """By severity rank, open loops before missing orders, distance out of range, then ``ties``."""
    order = [values.rank(F.col("severity"))]
    if "gap_type" in tickets.columns:
        order.append(F.when(F.col("gap_type") == "ordered-not-resulted", 0).when(F.col("gap_type") == "never-ordered", 1).otherwise(2))
    if "out_by" in tickets.columns:
        order.append(F.desc(F.coalesce(F.col("out_by"), F.lit(0.0))))
    return tickets.orderBy(*order, *ties)


def summary(tickets: DataFrame) -> DataFrame:
    """Counts by queue, by severity and in all, in one pass: (dimension, value, n)."""
    return tickets.groupingSets([["queue"], ["severity"], []], "queue", "severity").agg(F.count("*").alias("n"), F.grouping_id().alias("g")).select(F.when(F.col("g") == 1, "queue").when(F.col("g") == 2, "severity").otherwise("total").alias("dimension"), F.when(F.col("g") == 1, F.col("queue")).when(F.col("g") == 2, F.col("severity")).alias("value"), "n")


def page(tickets: DataFrame, queue: str | None = None, severity: str | None = None, limit: int = 200) -> DataFrame:
    """A page of tickets for show, 2,000 at most."""
    if queue:
        tickets = tickets.filter(F.col("queue") == queue)
    if severity:
        tickets = tickets.filter(F.col("severity") == severity)
    return tickets.limit(max(0, min(limit, 2000)))


def write(tickets: DataFrame, folder: str, form: str = "parquet") -> None:
    tickets.write.mode("overwrite").format(form).save(f"{folder}/tickets")
    summary(tickets).write.mode("overwrite").format(form).save(f"{folder}/summary")
