"""Services and contract."""

import __spark_entry__
import pytest
from pyspark.sql import functions as F

from lakeweave.plans import api, registry


def test_upload_becomes_tickets(spark, tmp_path):
    (tmp_path / "labs.csv").write_text("ID;LOINC;VALUE;REFERENCE_LOW;REFERENCE_HIGH\n1;a;7;5;10\n2;a;30;5;10\n3;a;N/A;5;10\n4;a;9000;5;10\n")
    got = api.analyze_upload(spark, str(tmp_path / "labs.csv"), "lab_result", "ID")
    assert [(t["id"], t["severity"]) for t in got["tickets"]] == [("AR-2", "moderate"), ("AR-4", "data-quality")]
    assert {(s["dimension"], s["value"]): s["n"] for s in got["summary"]}["total", None] == 2
    assert api.sources(str(tmp_path)) == ["labs.csv"]
    shown = api.ingest(spark, str(tmp_path), "labs.csv")
    assert shown["columns"][0] == "ID" and len(shown["rows"]) == 4 and shown["anomalies"] == {}
    with pytest.raises(ValueError):
        api.ingest(spark, str(tmp_path), "../labs.csv")


def test_discover_and_load(spark):
    df = spark.createDataFrame([("1", "2.5"), ("2", "x")], "id string, value string")
    found = api.discover(df, "s", "lab_result", "id")
    assert found["validation"]["errors"] == [] and found["report"]["loss_fields"] == ["value"]
    rows, report = api.load(df.filter("id = '1'"), "id", "s", "lab_result")
    assert report["passed"] and rows.first().value == 2.5
    assert len(api.canonical(df, found["manifest"])) == 2


def test_pages_and_payloads(spark, sf):
    t = registry.all_tickets(spark, sf)
    assert len(api.ticket_page(t, severity="critical", limit=5)) <= 5
    assert api.publish_dry(t).filter(~F.col("dry_run")).count() == 0 and api.health() == {"status": "ok"}


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and registry.FLAGSHIP in names
