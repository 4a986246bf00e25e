"""The services as functions: discover, load, analyze, publish, and what pages show. No web server, no network."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import manifest, publish, tickets, triage
from ..operators.analyzers import Registry
from ..sources import delimited
from ..sources.files import safe_name

#: Bytes that an upload may have.
UPLOAD = 8 << 20
SHOWN = 400


def sources(folder: str) -> list[str]:
    """Names of the delimited files in a folder."""
    return sorted(p.name for p in Path(folder).iterdir() if p.suffix == ".csv")


def ingest(spark: SparkSession, folder: str, name: str, rows: int = 20) -> dict:
    """{source, columns, rows, anomalies} of a file in a folder."""
    cells = delimited.cells(spark, f"{folder}/{safe_name(name)}")
    columns = delimited.header(cells)
    shown = delimited.repaired(cells, columns).orderBy("record_index").limit(rows)
    return {"source": name, "columns": columns, "rows": [r.asDict() for r in shown.collect()], "anomalies": {r.kind: r["count"] for r in delimited.anomalies(cells, len(columns)).groupBy("kind").count().collect()}}


def discover(df: DataFrame, source: str, entity: str, key: str, inducer=None, check_rows: int = 25) -> dict:
    """{manifest, validation, report} of a proposed mapping, checked on a few rows."""
    raw = inducer(df) if inducer else manifest.induce(df, source, entity)
    checked = manifest.validate(raw)
    return {"manifest": raw, "validation": checked, "report": None if checked["errors"] else manifest.report(df.limit(check_rows), manifest.Manifest.read(raw), key)}


def load(df: DataFrame, key: str, source: str, entity: str, supplied: dict | None = None, inducer=None) -> tuple[DataFrame, dict]:
    """Canonical rows and the report on all of them; a mapping that fails is asked for again, a supplied one is not."""
    made, found = manifest.with_repair(df, key, inducer or (lambda told: manifest.induce(df, source, entity)), supplied=supplied)
    return manifest.apply(df, made), found


def canonical(df: DataFrame, raw: dict, rows: int = 50) -> list[dict]:
    """Canonical rows for a page; none for a manifest with errors."""
    return [] if manifest.validate(raw)["errors"] else [r.asDict() for r in manifest.apply(df, manifest.Manifest.read(raw)).limit(rows).collect()]


def analyze(dataset: dict[str, DataFrame], registry: Registry) -> DataFrame | None:
    return registry.run_all(dataset)


def analyze_upload(spark: SparkSession, path: str, entity: str, key: str, bounds: DataFrame | None = None, on: str = "loinc", raw: dict | None = None) -> dict:
    """{summary, tickets, report} of an uploaded file, 400 tickets at most. Verification is reported, not enforced; only lab results are triaged."""
    if Path(path).exists() and Path(path).stat().st_size > UPLOAD:
        raise ValueError("the file is larger than an upload may be")
    cells = delimited.cells(spark, path)
    df = delimited.repaired(cells, delimited.header(cells))
    proposal = raw or manifest.induce(df, Path(path).name, entity)
    checked = manifest.validate(proposal)
    if checked["errors"]:
        return {"errors": checked["errors"], "tickets": [], "summary": []}
    made = manifest.Manifest.read(proposal)
    out = {"report": manifest.report(df, made, key), "tickets": [], "summary": []}
    if entity == "lab_result":
        rows = manifest.apply(df, made)
        roles = {"low": "reference_low", "high": "reference_high"}
        found = triage.triage(rows, bounds, on, **{k: v for k, v in roles.items() if v in rows.columns})
        found = found.filter(F.col("outcome").isin("finding", "implausible")).withColumn("id", tickets.ticket_id("AR", F.col("id")))
        out |= {"tickets": [r.asDict() for r in tickets.ordered(found, "id").limit(SHOWN).collect()], "summary": [r.asDict() for r in tickets.summary(found).collect()]}
    return out


def ticket_page(found: DataFrame, queue: str | None = None, severity: str | None = None, limit: int = 200) -> list[dict]:
    return [r.asDict() for r in tickets.page(found, queue, severity, limit).collect()]


def publish_dry(found: DataFrame, field_map: dict[str, str] | None = None, target: str = "dry-run") -> DataFrame:
    return publish.publish(found, field_map, target)


def health() -> dict:
    return {"status": "ok"}
