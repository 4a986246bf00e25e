"""Every query of the library by name, with the SQL that says the same.

The operators take columns in roles; here they are bound to the driver's tables: events are measurements, customers are
conditions, orders are results and orders, conversations are notes, embeddings are section vectors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, query, segment, text, transforms, values, vectors
from ..functions.docid import document_id
from ..operators import advisory, corpus as chains, correlate, gaps, manifest, migrate, outliers, publish, reconcile, reshape, retrieval, tickets, triage
from ..sources import json_records
from ..sources.files import media_type

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "ticket_summary"


def query_named(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- triage and tickets -------------------------------------------------------------------------------------------
#: Bounds by code: reference, critical, plausible. Our own, chosen so that every outcome occurs.
BOUNDS = [("click", 5.0, 80.0, None, 150.0, 0.0, 300.0), ("error", 5.0, 80.0, 1.0, 150.0, 0.0, 300.0), ("purchase", 5.0, 80.0, None, 150.0, None, 300.0), ("signup", 5.0, 80.0, 0.5, None, None, None), ("view", None, 80.0, None, 150.0, None, None)]
_BOUND_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in r) + ")" for r in BOUNDS)
_TRIAGE = f"""WITH b(code, low, high, cl, ch, pl, ph) AS (VALUES {_BOUND_ROWS}),
t AS (SELECT e.event_id, e.user_id, e.event_type AS code, e.value AS v, b.* EXCLUDE (code) FROM events e LEFT JOIN b ON b.code = e.event_type),
w AS (SELECT *, CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN greatest(high - low, 1e-9) ELSE greatest(abs(coalesce(low, high)), 1.0) END AS wid,
 CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN high - low WHEN coalesce(low, high) = 0 THEN 1.0 ELSE abs(coalesce(low, high)) END AS span,
 CASE WHEN v < low THEN 'low' WHEN v > high THEN 'high' END AS way,
 CASE WHEN v < low THEN low - v WHEN v > high THEN v - high END AS out_by FROM t),
x AS (SELECT *, CASE WHEN pl IS NOT NULL OR ph IS NOT NULL THEN coalesce(v < pl, false) OR coalesce(v > ph, false)
 ELSE coalesce(v < low - 5 * wid, false) OR coalesce(v > high + 5 * wid, false) OR coalesce(low >= 0 AND v < 0, false) END AS bad,
 coalesce(CASE way WHEN 'low' THEN v < cl WHEN 'high' THEN v > ch END, false) AS critical,
 CASE WHEN span > 0 THEN out_by / span END AS relative FROM w),
f AS (SELECT *, CASE WHEN v IS NULL THEN 'skipped' WHEN bad THEN 'implausible' WHEN way IS NULL THEN 'in_range' ELSE 'finding' END AS outcome FROM x),
s AS (SELECT *, CASE outcome WHEN 'finding' THEN CASE WHEN critical THEN 'critical' WHEN relative > 0.5 THEN 'moderate' ELSE 'mild' END WHEN 'implausible' THEN 'data-quality' END AS severity FROM f),
r AS (SELECT *, CASE severity WHEN 'critical' THEN 'clinical-urgent' WHEN 'data-quality' THEN 'data-quality' WHEN 'moderate' THEN 'clinical-routine' WHEN 'mild' THEN 'clinical-routine' END AS queue,
 CASE severity WHEN 'critical' THEN 4 WHEN 'moderate' THEN 24 WHEN 'mild' THEN 72 END AS sla_hours FROM s)
"""


def bounds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOUNDS, "code string, low double, high double, critical_low double, critical_high double, plausible_low double, plausible_high double")


def triaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("code"), "value")
    return triage.triage(e, bounds(spark))


@query_named("triage_findings", _TRIAGE + "SELECT event_id, user_id, code, v AS value, way, out_by, relative, severity, queue, sla_hours FROM r WHERE outcome = 'finding'")
def _(spark, sf):
    return triage.findings(triaged(spark, sf)).select("event_id", "user_id", "code", "value", "way", "out_by", "relative", "severity", "queue", "sla_hours")


@query_named("triage_outcomes", _TRIAGE + "SELECT code, outcome, severity, count(*) AS n FROM r GROUP BY ALL")
def _(spark, sf):
    return triaged(spark, sf).groupBy("code", "outcome", "severity").agg(F.count("*").alias("n"))


@query_named("data_quality_findings", _TRIAGE + "SELECT event_id, code, v AS value, low, high, pl AS plausible_low, ph AS plausible_high, CASE WHEN pl IS NOT NULL OR ph IS NOT NULL THEN 'governed' ELSE 'reference-derived' END AS basis FROM r WHERE outcome = 'implausible'")
def _(spark, sf):
    governed = F.col("plausible_low").isNotNull() | F.col("plausible_high").isNotNull()
    return triage.data_quality(triaged(spark, sf)).select("event_id", "code", "value", "low", "high", "plausible_low", "plausible_high", F.when(governed, "governed").otherwise("reference-derived").alias("basis"))


@query_named("triage_ranked", _TRIAGE + "SELECT event_id, severity, out_by, (row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END, out_by DESC, event_id))::INTEGER AS place FROM r WHERE outcome = 'finding' ORDER BY place LIMIT 100")
def _(spark, sf):
    best = triage.ranked(triage.findings(triaged(spark, sf)), "event_id").limit(100)
    from pyspark.sql import Window

    w = Window.orderBy(values.rank(F.col("severity")), F.desc("out_by"), "event_id")  # over the hundred rows of a report
    return best.select("event_id", "severity", "out_by", F.row_number().over(w).alias("place"))


def all_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triaged(spark, sf_dir).filter(F.col("outcome").isin("finding", "implausible"))
    prefix = F.when(F.col("outcome") == "implausible", "DQ").otherwise("AR")
    found = t.select(F.concat_ws("-", prefix, F.col("user_id").cast("string"), F.col("code")).alias("id"), F.col("user_id").alias("patient_id"), F.col("code").alias("component"), "value", "way", "out_by", "severity", "queue", "sla_hours", "event_id", F.lit("abnormal-result-triage").alias("checker"))
    return tickets.first_of_each(found, "id", "event_id")


_TICKETS = _TRIAGE + ", k AS (SELECT (CASE outcome WHEN 'implausible' THEN 'DQ' ELSE 'AR' END) || '-' || user_id || '-' || code AS id, * FROM r WHERE outcome IN ('finding', 'implausible')), d AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id) = 1) "


@query_named("tickets_dedup", _TICKETS + "SELECT id, user_id AS patient_id, code AS component, v AS value, way, out_by, severity, queue, sla_hours FROM d")
def _(spark, sf):
    return all_tickets(spark, sf).select("id", "patient_id", "component", "value", "way", "out_by", "severity", "queue", "sla_hours")


@query_named("ticket_summary", _TICKETS + "SELECT CASE grouping(queue, severity) WHEN 1 THEN 'queue' WHEN 2 THEN 'severity' ELSE 'total' END AS dimension, CASE grouping(queue, severity) WHEN 1 THEN queue WHEN 2 THEN severity END AS value, count(*) AS n FROM d GROUP BY GROUPING SETS ((queue), (severity), ())")
def _(spark, sf):
    return tickets.summary(all_tickets(spark, sf))


@query_named("ticket_page", _TICKETS + "SELECT id, severity FROM d WHERE queue = 'clinical-urgent' ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, coalesce(out_by, 0) DESC, id LIMIT 50")
def _(spark, sf):
    return tickets.page(tickets.ordered(all_tickets(spark, sf), "id"), queue="clinical-urgent", limit=50).select("id", "severity")


@query_named("publish_payloads", _TICKETS + """SELECT id AS external_id, code || ' — ' || severity AS summary, CASE severity WHEN 'critical' THEN 'P1' WHEN 'moderate' THEN 'P2' WHEN 'data-quality' THEN 'P4' ELSE 'P3' END AS priority, queue, user_id::VARCHAR AS patient_ref FROM d""")
def _(spark, sf):
    return publish.default_payload(all_tickets(spark, sf)).select("external_id", "summary", "priority", "queue", "patient_ref")


@query_named("publish_field_map", _TICKETS + "SELECT 'dry-run' AS target, true AS dry_run, id AS key, v AS reading, way, queue AS lane, NULL::VARCHAR AS none FROM d")
def _(spark, sf):
    nested = all_tickets(spark, sf).select("id", F.struct(F.struct("value", "way").alias("facts")).alias("t"), "queue")
    sent = publish.publish(nested, {"key": "id", "reading": "t.facts.value", "way": "t.facts.way", "lane": "queue", "none": "t.nothing"})
    return sent.select("target", "dry_run", F.from_json("payload", "key string, reading double, way string, lane string, none string").alias("p")).select("target", "dry_run", "p.*")


@query_named("stable_ids", "SELECT p_partkey, 'MR-' || p_partkey || '-' || substr(regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g'), 1, 24) AS id, regexp_replace(lower('Stock Check'), '[^a-z0-9]+', '', 'g') || '-' || p_partkey || '-' || substr(regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g'), 1, 24) AS generic_id FROM part")
def _(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", tickets.ticket_id("MR", F.col("p_partkey"), text.slug(F.col("p_name"))).alias("id"), tickets.finding_id(F.lit("Stock Check"), F.col("p_partkey"), F.col("p_brand")).alias("generic_id"))


@query_named("patient_enrich", "SELECT o.o_orderkey, c.patient_name FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN -o_custkey - 1 ELSE o_custkey END AS patient FROM orders) o LEFT JOIN (SELECT c_custkey, nullif(concat_ws(' ', nullif(trim(split_part(c_name, '#', 1)), ''), nullif(trim(split_part(c_name, '#', 2)), '')), '') AS patient_name FROM customer) c ON c.c_custkey = o.patient")
def _(spark, sf):
    """Every order with its customer's name; of each tenth the customer is unknown."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("patient"), F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("last"))
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, -F.col("o_custkey") - 1).otherwise(F.col("o_custkey")).alias("patient"))
    return tickets.with_patient(o, c, "patient").select("o_orderkey", "patient_name")


@query_named("finding_union", _TICKETS + "SELECT id, 'abnormal-result-triage' AS checker, severity, NULL::VARCHAR AS gap_type, queue FROM d UNION ALL SELECT 'CG-' || c_custkey || '-' || lower(c_mktsegment), 'care-gap', 'care-gap', 'never-ordered', NULL FROM customer")
def _(spark, sf):
    gap = table(spark, sf, "customer").select(tickets.ticket_id("CG", F.col("c_custkey"), text.slug(F.col("c_mktsegment"))).alias("id"), F.lit("care-gap").alias("checker"), F.lit("care-gap").alias("severity"), F.lit("never-ordered").alias("gap_type"))
    return tickets.union(all_tickets(spark, sf).select("id", "checker", "severity", "queue"), gap).select("id", "checker", "severity", "gap_type", "queue")


# --- cells and transforms -----------------------------------------------------------------------------------------
_MESSY = {
    "cell": "CASE WHEN o_orderkey % 7 = 0 THEN ' N/A ' WHEN o_orderkey % 7 = 1 THEN chr(9) || o_orderpriority || ' ' WHEN o_orderkey % 7 = 2 THEN '--' WHEN o_orderkey % 7 = 3 THEN '   ' WHEN o_orderkey % 7 = 4 THEN NULL ELSE o_orderpriority END",
    "number": "CASE WHEN o_orderkey % 5 = 0 THEN '1,' || (100 + o_orderkey % 900) || '.5' WHEN o_orderkey % 5 = 1 THEN ' ' || (o_orderkey % 1000) || ' ' WHEN o_orderkey % 5 = 2 THEN 'Infinity' WHEN o_orderkey % 5 = 3 THEN '5d' ELSE '-3e2' END",
    "day": "CASE WHEN o_orderkey % 5 = 0 THEN '2019-02-31T10:00' WHEN o_orderkey % 5 = 1 THEN (1 + o_orderkey % 12) || '/' || (1 + o_orderkey % 28) || '/2020' WHEN o_orderkey % 5 = 2 THEN ' 1998 ' WHEN o_orderkey % 5 = 3 THEN '' ELSE 'soon' END",
    "flag": "CASE WHEN o_orderkey % 6 = 0 THEN 'Yes' WHEN o_orderkey % 6 = 1 THEN ' f ' WHEN o_orderkey % 6 = 2 THEN '1' WHEN o_orderkey % 6 = 3 THEN 'maybe' WHEN o_orderkey % 6 = 4 THEN 'N' ELSE NULL END",
    "pair": "CASE WHEN o_orderkey % 4 = 0 THEN (100 + o_orderkey % 80) || '/' || (50 + o_orderkey % 50) WHEN o_orderkey % 4 = 1 THEN '120.5 / 80' WHEN o_orderkey % 4 = 2 THEN 'n/a' ELSE '' END",
    "span": "CASE WHEN o_orderkey % 6 = 0 THEN '3.5 - 5.1' WHEN o_orderkey % 6 = 1 THEN '<' || (o_orderkey % 100) WHEN o_orderkey % 6 = 2 THEN '>= 40' WHEN o_orderkey % 6 = 3 THEN '-1–1' WHEN o_orderkey % 6 = 4 THEN 'negative' ELSE NULL END",
}


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with cells as real exports have them: the same expressions in both dialects."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "o_orderdate", *(f"{sql} AS {name}" for name, sql in _MESSY.items()))


_M = "WITH m AS (SELECT o_orderkey, o_custkey, o_orderdate, " + ", ".join(f"{sql} AS {name}" for name, sql in _MESSY.items()) + " FROM orders) "
_TRIM = "nullif(regexp_replace({0}, '^[\\s]+|[\\s]+$', '', 'g'), '')"
_SENT = "('', 'null', 'n/a', 'na', 'none', '-', '--', '.')"


@query_named("cells_normalized", _M + f"SELECT o_orderkey, CASE WHEN lower({_TRIM.format('cell')}) NOT IN {_SENT} THEN {_TRIM.format('cell')} END AS cell, CASE WHEN lower({_TRIM.format('cell')}) IN {_SENT} THEN 'cell' ELSE '' END AS sentinels FROM m")
def _(spark, sf):
    return reshape.normalized(messy(spark, sf).select("o_orderkey", "cell"), ["cell"]).withColumn("sentinels", F.array_join("sentinels", ","))


@query_named("sentinel_counts", _M + f"SELECT coalesce(lower({_TRIM.format('cell')}) IN {_SENT}, false) AS sentinel, {_TRIM.format('cell')} IS NULL AS blank, count(*) AS n FROM m GROUP BY ALL")
def _(spark, sf):
    return messy(spark, sf).groupBy(cells.is_sentinel(F.col("cell")).alias("sentinel"), cells.is_blank(F.col("cell")).alias("blank")).agg(F.count("*").alias("n"))


@query_named("transform_number", _M + f"SELECT o_orderkey, CASE WHEN regexp_full_match(replace({_TRIM.format('number')}, ',', ''), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN replace({_TRIM.format('number')}, ',', '')::DOUBLE END AS number FROM m")
def _(spark, sf):
    return messy(spark, sf).select("o_orderkey", cells.to_number(F.col("number")).alias("number"))


@query_named("transform_date", _M + f"""SELECT o_orderkey, CASE WHEN regexp_matches({_TRIM.format('day')}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN substr({_TRIM.format('day')}, 1, 10)
 WHEN regexp_full_match({_TRIM.format('day')}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN split_part({_TRIM.format('day')}, '/', 3) || '-' || lpad(split_part({_TRIM.format('day')}, '/', 1), 2, '0') || '-' || lpad(split_part({_TRIM.format('day')}, '/', 2), 2, '0') ELSE {_TRIM.format('day')} END AS day FROM m""")
def _(spark, sf):
    return messy(spark, sf).select("o_orderkey", transforms.to_date(F.col("day")).alias("day"))


@query_named("transform_boolean", _M + f"SELECT o_orderkey, CASE WHEN lower({_TRIM.format('flag')}) IN ('y', 'yes', 'true', '1', 't') THEN true WHEN lower({_TRIM.format('flag')}) IN ('n', 'no', 'false', '0', 'f') THEN false END AS flag FROM m")
def _(spark, sf):
    return messy(spark, sf).select("o_orderkey", transforms.to_boolean(F.col("flag")).alias("flag"))


@query_named("split_pair", _M + "SELECT o_orderkey, try_cast(nullif(regexp_extract(trim(pair), '^(\\d+(?:\\.\\d+)?)\\s*/\\s*(\\d+(?:\\.\\d+)?)$', 1), '') AS DOUBLE) AS first, try_cast(nullif(regexp_extract(trim(pair), '^(\\d+(?:\\.\\d+)?)\\s*/\\s*(\\d+(?:\\.\\d+)?)$', 2), '') AS DOUBLE) AS second FROM m")
def _(spark, sf):
    a, b = transforms.split_pair(F.col("pair"))
    return messy(spark, sf).select("o_orderkey", a.alias("first"), b.alias("second"))


_N = "-?\\d+(?:\\.\\d+)?"


@query_named("reference_range", _M + f"""SELECT o_orderkey, try_cast(coalesce(nullif(regexp_extract(trim(span), '^({_N})\\s*[-–]\\s*({_N})$', 1), ''), nullif(regexp_extract(trim(span), '^[>≥]=?\\s*({_N})$', 1), '')) AS DOUBLE) AS low,
 try_cast(coalesce(nullif(regexp_extract(trim(span), '^({_N})\\s*[-–]\\s*({_N})$', 2), ''), nullif(regexp_extract(trim(span), '^[<≤]=?\\s*({_N})$', 1), '')) AS DOUBLE) AS high FROM m""")
def _(spark, sf):
    low, high = transforms.reference_range(F.col("span"))
    return messy(spark, sf).select("o_orderkey", low.alias("low"), high.alias("high"))


@query_named("eq_norm", "SELECT l_orderkey, l_linenumber, l_quantity % 2 = 0 OR l_quantity = 7 AS same FROM lineitem")
def _(spark, sf):
    a = F.concat(F.lit(" "), F.col("l_quantity").cast("string"))
    b = F.when((F.col("l_quantity") % 2 == 0) | (F.col("l_quantity") == 7), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" "))).otherwise(F.lit("none"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", cells.eq_norm(a, b).alias("same"))


# --- shapes -------------------------------------------------------------------------------------------------------
@query_named("long_form", "SELECT c_custkey, 'customer.' || path AS path, value FROM (UNPIVOT (SELECT c_custkey, c_name, c_mktsegment, c_nationkey::VARCHAR AS c_nationkey FROM customer) ON c_name, c_mktsegment, c_nationkey INTO NAME path VALUE value)")
def _(spark, sf):
    return reshape.paths(table(spark, sf, "customer"), "customer", ["c_custkey"], ["c_name", "c_mktsegment", "c_nationkey"])


@query_named("json_paths", "SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def _(spark, sf):
    return json_records.long_paths(table(spark, sf, "events"), ["event_id"], "props").filter("value is not null")


@query_named("json_records", """WITH c AS (SELECT c_custkey::VARCHAR AS source, * FROM customer) SELECT source, 0::BIGINT AS record_index, p AS path, v AS value FROM (
SELECT source, 'customer.id' AS p, c_custkey::VARCHAR AS v FROM c UNION ALL SELECT source, 'customer.name.full', c_name FROM c UNION ALL SELECT source, 'customer.name.nick', NULL FROM c UNION ALL SELECT source, 'customer.codes.0', c_mktsegment FROM c UNION ALL SELECT source, 'customer.codes.1.deep.0.0', 'x' FROM c UNION ALL SELECT source, 'customer.none', NULL FROM c)""")
def _(spark, sf):
    deep = F.concat(F.lit('{"id": '), F.col("c_custkey"), F.lit(', "name": {"full": "'), F.col("c_name"), F.lit('", "nick": "  "}, "codes": ["'), F.col("c_mktsegment"), F.lit('", {"deep": [["x"]]}], "none": {}}'))
    return json_records.records(table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("source"), F.concat(F.lit('{"rows": ['), deep, F.lit("]}")).alias("text")), "customer").select("source", "record_index", F.explode("values").alias("path", "value"))


@query_named("json_anomalies", "SELECT c_custkey::VARCHAR AS source, 'json_parse_error' AS anomaly FROM customer WHERE c_custkey % 3 = 0")
def _(spark, sf):
    broken = F.when(F.col("c_custkey") % 3 == 0, F.lit('[{"a": 1')).otherwise('[{"a": 1}]')
    return json_records.records(table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("source"), broken.alias("text"))).filter("anomaly is not null").select("source", "anomaly")


@query_named("spanning_fill", "WITH g AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS p FROM orders) SELECT o_custkey, o_orderkey, last_value(p IGNORE NULLS) OVER w AS p, CASE WHEN p IS NULL AND last_value(p IGNORE NULLS) OVER w IS NOT NULL THEN 'p' ELSE '' END AS filled FROM g WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)")
def _(spark, sf):
    g = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("p"))
    return reshape.forward_fill(g, "o_custkey", "o_orderkey", ["p"]).withColumn("filled", F.array_join("filled", ","))


@query_named("ragged_anomalies", "WITH r AS (SELECT o_orderkey AS record_index, CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 3 END AS n FROM orders) SELECT CASE WHEN n < 3 THEN 'ragged_short' ELSE 'ragged_long' END AS kind, count(*) AS n FROM r WHERE n <> 3 GROUP BY 1")
def _(spark, sf):
    from ..sources import delimited

    o = table(spark, sf, "orders")
    three = F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority"))
    rows = o.select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("record_index"), F.when(F.col("o_orderkey") % 4 == 0, F.slice(three, 1, 2)).when(F.col("o_orderkey") % 4 == 1, F.concat(three, F.array(F.lit("extra")))).otherwise(three).alias("cells"))
    return delimited.anomalies(rows, 3).groupBy("kind").agg(F.count("*").alias("n"))


@query_named("pivot_means", "SELECT user_id, avg(value) FILTER (event_type = 'click') AS click, avg(value) FILTER (event_type = 'error') AS error, avg(value) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def _(spark, sf):
    return correlate.wide(table(spark, sf, "events"), "user_id", "event_type", "value", ["click", "error", "view"])


@query_named("even_sample", "SELECT event_id FROM events WHERE event_id IN (SELECT (i * (SELECT count(*) FROM events)) // 100 FROM range(100) t(i))")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    return reshape.even_sample(e, "event_id", e.count(), 100)


# --- manifests ----------------------------------------------------------------------------------------------------
MANIFEST = {
    "source": "orders", "entity": "lab_result",
    "fields": [
        {"from": "o_orderkey", "to": "lab_result.id"}, {"from": "o_custkey", "to": "lab_result.patient_id", "transform": "trim"}, {"from": "number", "to": "lab_result.value", "transform": "to_number"},
        {"from": "span", "emits": ["lab_result.reference.low", "lab_result.reference.high"], "transform": "parse_reference_range"}, {"from": "day", "to": "lab_result.date", "transform": "to_date"}, {"from": "flag"}, {"from": "cell", "to": "lab_result.component", "transform": "lower"},
    ],
}


@query_named("manifest_apply", _M + f"""SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS patient_id, CASE WHEN regexp_full_match(replace({_TRIM.format('number')}, ',', ''), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN replace({_TRIM.format('number')}, ',', '')::DOUBLE END AS value, lower({_TRIM.format('cell')}) AS component FROM m""")
def _(spark, sf):
    return manifest.apply(messy(spark, sf), manifest.Manifest.read(MANIFEST)).select("id", "patient_id", "value", "component")


@query_named("manifest_anomalies", _M + "SELECT 'transform_unparsed' AS kind, field, count(*) AS n FROM (SELECT 'number' AS field FROM m WHERE number IN ('Infinity', '5d') UNION ALL SELECT 'span' FROM m WHERE span = 'negative') GROUP BY field")
def _(spark, sf):
    return manifest.anomalies(messy(spark, sf), manifest.Manifest.read(MANIFEST), "o_orderkey").groupBy("kind", "field").agg(F.count("*").alias("n"))


@query_named("verify_report", _M + """SELECT 'number' AS field, count(*) AS rows, count(*) FILTER (number IN ('Infinity', '5d')) AS losses, 0 AS type_violations, 'equivalence' AS reversibility FROM m UNION ALL SELECT 'span', count(*), count(*) FILTER (span = 'negative'), 0, 'equivalence' FROM m
UNION ALL SELECT 'o_orderkey', count(*), 0, 0, 'passthrough' FROM m UNION ALL SELECT 'o_custkey', count(*), 0, 0, 'equivalence' FROM m UNION ALL SELECT 'day', count(*), 0, count(*) FILTER (day = 'soon'), 'equivalence' FROM m UNION ALL SELECT 'cell', count(*), 0, 0, 'one-way' FROM m""")
def _(spark, sf):
    return manifest.verify(messy(spark, sf), manifest.Manifest.read(MANIFEST), "o_orderkey", examples=0).select("field", "rows", "losses", "type_violations", "reversibility")


@query_named("verify_examples", _M + "SELECT 'number' AS field, o_orderkey::VARCHAR AS example FROM (SELECT o_orderkey FROM m WHERE number IN ('Infinity', '5d') ORDER BY o_orderkey LIMIT 5) UNION ALL SELECT 'span', o_orderkey::VARCHAR FROM (SELECT o_orderkey FROM m WHERE span = 'negative' ORDER BY o_orderkey LIMIT 5)")
def _(spark, sf):
    """Up to five rows of each field that lose something."""
    return manifest.verify(messy(spark, sf), manifest.Manifest.read(MANIFEST), "o_orderkey").select("field", F.explode("examples").alias("example"))


@query_named("renamed_sources", _M + "SELECT 'first' AS side, count(*) AS n FROM m WHERE o_orderkey % 31 = 0 UNION ALL SELECT 'second', count(*) FROM m WHERE o_orderkey % 31 = 0")
def _(spark, sf):
    """Orders, and the same under other names in another order with each thirty-first row's id changed: only these differ."""
    one = messy(spark, sf)
    names = {c: f"x.{c[::-1]}" for c in one.columns}
    other = one.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 31 == 0, -F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey"))).select(*(F.col(c).alias(n) for c, n in reversed(names.items())))
    renamed = MANIFEST | {"fields": [f | {"from": names[f["from"]]} for f in MANIFEST["fields"]]}
    left = manifest.same_rows((one, manifest.Manifest.read(MANIFEST), "o_orderkey"), (other, manifest.Manifest.read(renamed), "x.yekredro_o"))
    return left.groupBy("side").agg(F.sum("n").alias("n"))


# --- gaps, sets, migration ----------------------------------------------------------------------------------------
#: Conditions by prefix with the codes they expect. Our own.
RULES = [("BUILD", "building", ["1-URGENT", "2-HIGH"]), ("AUTO", "automobile", ["3-MEDIUM"]), ("MACH", "machinery", ["1-URGENT", "5-LOW"]), ("M", "other", ["4-NOT SPECIFIED"])]
_RULES = "rules(prefix, condition, expects) AS (VALUES " + ", ".join(f"('{p}', '{c}', [{', '.join(repr(x) for x in e)}])" for p, c, e in RULES) + ")"
_GAPS = f"""WITH {_RULES}, p AS (SELECT c_custkey AS patient_id, arg_max(r.condition, length(r.prefix)) AS condition, arg_max(r.expects, length(r.prefix)) AS expects FROM customer c JOIN rules r ON starts_with(upper(c.c_mktsegment), r.prefix) GROUP BY c_custkey),
k AS (SELECT DISTINCT patient_id, condition, unnest(expects) AS expected_code FROM p), done AS (SELECT DISTINCT o_custkey AS patient_id, o_orderpriority AS code FROM orders WHERE o_orderstatus = 'F'), open_ AS (SELECT DISTINCT o_custkey AS patient_id, o_orderpriority AS code FROM orders WHERE o_orderstatus = 'O'),
g AS (SELECT k.*, CASE WHEN o.code IS NOT NULL THEN 'ordered-not-resulted' ELSE 'never-ordered' END AS gap_type FROM k LEFT JOIN open_ o ON o.patient_id = k.patient_id AND o.code = k.expected_code WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.patient_id = k.patient_id AND d.code = k.expected_code)) """


def gap_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rules = spark.createDataFrame(RULES, "prefix string, condition string, expects array<string>")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("code"))
    wanted = gaps.by_longest_prefix(c, rules, "code").withColumn("expected_code", F.explode("expects"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderpriority").alias("code"), "o_orderstatus")
    return wanted, o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'")


@query_named("gap_findings", _GAPS + "SELECT patient_id, condition, expected_code, gap_type FROM g")
def _(spark, sf):
    return gaps.gaps(*gap_inputs(spark, sf))


@query_named("gap_stats", _GAPS + "SELECT (SELECT count(DISTINCT (patient_id, condition)) FROM k) AS conditions_checked, (SELECT count(*) FROM g WHERE gap_type = 'never-ordered') AS never_ordered, (SELECT count(*) FROM g WHERE gap_type = 'ordered-not-resulted') AS ordered_not_resulted, (SELECT count(*) FROM k) - (SELECT count(*) FROM g) AS closed")
def _(spark, sf):
    return gaps.stats(*gap_inputs(spark, sf))


@query_named("prefix_rule_match", "WITH r(prefix, name) AS (VALUES ('ECO', 'eco'), ('ECONOMY', 'economy'), ('S', 's'), ('STAND', 'stand'), ('PRO', 'promo')) SELECT p_partkey, arg_max(name, length(prefix)) AS name FROM part JOIN r ON starts_with(upper(p_type), prefix) GROUP BY p_partkey")
def _(spark, sf):
    r = spark.createDataFrame([("ECO", "eco"), ("ECONOMY", "economy"), ("S", "s"), ("STAND", "stand"), ("PRO", "promo")], "prefix string, name string")
    return gaps.by_longest_prefix(table(spark, sf, "part").select("p_partkey", "p_type"), r, "p_type").select("p_partkey", "name")


_STATUS = "CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'Inactive' WHEN 2 THEN '1' WHEN 3 THEN 'ACTIVE' WHEN 4 THEN 'reactivated ' || o_orderstatus WHEN 5 THEN o_orderpriority WHEN 6 THEN '' WHEN 7 THEN 'not active' ELSE '11' END"


@query_named("active_predicate", f"SELECT o_orderkey, s IS NULL OR s = '1' OR contains(lower(s), 'active') AS active, s IS NULL OR s = '1' OR regexp_matches(lower(s), '(^|[^a-z0-9_])active($|[^a-z0-9_])') AS strict FROM (SELECT o_orderkey, {_STATUS} AS s FROM orders)")
def _(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey", f"{_STATUS} AS s").select("o_orderkey", gaps.active(F.col("s")).alias("active"), gaps.active(F.col("s"), strict=True).alias("strict"))


_NAME = r"trim(regexp_replace(regexp_replace(lower(p_name), '\b(xl|xr|er|sr|cr|hcl|sodium|mg|mcg|unit|units)\b', ' ', 'g'), '\s+', ' ', 'g'))"


@query_named("note_reconciliation", f"""WITH n AS (SELECT p_partkey, p_partkey % 50 AS patient_id, {_NAME} AS name FROM part), said AS (SELECT DISTINCT patient_id, name FROM n WHERE p_partkey % 2 = 0 AND length(split_part(name, ' ', 1)) >= 3), asked AS (SELECT DISTINCT patient_id FROM n WHERE p_partkey % 2 = 0),
ordered AS (SELECT DISTINCT patient_id, name FROM n JOIN asked USING (patient_id) WHERE p_partkey % 3 = 0 OR p_partkey % 6 = 1)
SELECT patient_id, 'note_only' AS kind, name FROM said WHERE (patient_id, name) NOT IN (SELECT (patient_id, name) FROM ordered) UNION ALL SELECT patient_id, 'order_only', name FROM ordered WHERE (patient_id, name) NOT IN (SELECT (patient_id, name) FROM said)""")
def _(spark, sf):
    """Notes that name every second part among patients' medication, with a name made up in each, against orders of every third, some of them stopped."""
    p = table(spark, sf, "part").withColumn("patient_id", F.col("p_partkey") % 50)
    notes = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("note_id"), "patient_id", F.concat(F.lit("Current Medication: "), F.col("p_name"), F.lit(" 20 mg HCl; stable")).alias("text"))
    notes = notes.unionByName(p.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("note_id"), (F.col("patient_id") + 1000).alias("patient_id"), F.lit("nothing to report").alias("text")))
    status = F.when(F.col("p_partkey") % 3 == 0, "active").when(F.col("p_partkey") % 6 == 1, "1").otherwise("inactive")
    orders = p.select("patient_id", F.concat(F.col("p_name"), F.lit(" 10 mg")).alias("name"), status.alias("status"))
    extract = lambda df: df.select("note_id", F.explode(F.array(F.regexp_extract("text", r": (.*?);", 1), F.lit("invented drug"))).alias("name"))
    return reconcile.reconcile_notes(notes, orders, extract).select("patient_id", "kind", text.medication(F.col("name")).alias("name"))


@query_named("reconcile_sets", """WITH w AS (SELECT DISTINCT conv_id, role, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS name FROM conversations WHERE role IN ('user', 'assistant'))
SELECT a.conv_id, CASE a.role WHEN 'user' THEN 'left_only' ELSE 'right_only' END AS kind, a.name FROM w a WHERE NOT EXISTS (SELECT 1 FROM w b WHERE b.conv_id = a.conv_id AND b.role <> a.role AND b.name = a.name)""")
def _(spark, sf):
    w = table(spark, sf, "conversations").select("conv_id", "role", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-ÿ]+)"), 1)).alias("name"))
    return reconcile.one_sided(w.filter("role = 'user'"), w.filter("role = 'assistant'"), "conv_id").select("conv_id", "kind", "name")


@query_named("medication_names", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '\b(xl|xr|er|sr|cr|hcl|sodium|mg|mcg|unit|units)\b', ' ', 'g'), '\s+', ' ', 'g')) AS name, lower(p_brand) AS alias FROM part")
def _(spark, sf):
    full = F.concat(F.col("p_name"), F.lit(" ("), F.regexp_replace("p_brand", "[^A-Za-z]", ""), F.lit(") 20 mg HCl"))
    return table(spark, sf, "part").select("p_partkey", text.medication(full).alias("name"), F.concat(text.medication_aliases(full)[0], F.regexp_extract("p_brand", "([^A-Za-z]+)$", 1)).alias("alias"))


_MIGRATION = """WITH s AS (SELECT o_orderkey, o_totalprice::DOUBLE AS price, o_orderpriority AS p FROM orders), t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 53 = 0 THEN price + 1 ELSE price END AS price, p FROM s WHERE o_orderkey % 97 <> 0),
j AS (SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, s.o_orderkey IS NULL AS added, t.o_orderkey IS NULL AS dropped, abs(s.price - t.price) >= 1e-9 AS changed FROM s FULL JOIN t ON s.o_orderkey = t.o_orderkey) """


def migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("reference"))
    return migrate.compare(s, migrate.with_defects(s, "o_orderkey", "value"), "o_orderkey", ["value", "reference"])


@query_named("migration_report", _MIGRATION + "SELECT count(*) FILTER (NOT added) AS source_rows, count(*) FILTER (NOT dropped) AS target_rows, count(*) FILTER (dropped) AS dropped, count(*) FILTER (added) AS added, count(*) FILTER (changed) AS mismatches, round(100.0 * count(*) FILTER (NOT dropped) / count(*), 3) AS completeness FROM j")
def _(spark, sf):
    return migrate.report(migrated(spark, sf), 2).select("source_rows", "target_rows", "dropped", "added", "mismatches", "completeness")


@query_named("migration_findings", _MIGRATION + "SELECT o_orderkey, CASE WHEN dropped THEN 'dropped' ELSE 'mismatch' END AS kind, CASE WHEN NOT dropped THEN 'value' END AS field, CASE WHEN dropped THEN 3 ELSE 2 END AS severity FROM j WHERE dropped OR changed")
def _(spark, sf):
    return migrate.findings(migrated(spark, sf), "o_orderkey")


@query_named("migration_ranked", _MIGRATION + ", f AS (SELECT o_orderkey, CASE WHEN dropped THEN 'dropped' ELSE 'mismatch' END AS kind, CASE WHEN dropped THEN 3 ELSE 2 END AS severity FROM j WHERE dropped OR changed) SELECT o_orderkey, kind, severity, (row_number() OVER (ORDER BY severity DESC, o_orderkey))::INTEGER AS place FROM f ORDER BY place LIMIT 200")
def _(spark, sf):
    """The first two hundred findings of a migration's report, in order."""
    from pyspark.sql import Window

    best = migrate.ordered(migrate.findings(migrated(spark, sf), "o_orderkey"), "o_orderkey").limit(200)
    w = Window.orderBy(F.desc("severity"), "o_orderkey")  # over the rows of a report
    return best.select("o_orderkey", "kind", "severity", F.row_number().over(w).alias("place"))


# --- statistics ---------------------------------------------------------------------------------------------------
_MEANS = "WITH m AS (SELECT user_id, event_type, avg(value) AS mean FROM events WHERE value IS NOT NULL GROUP BY ALL) "


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.correlations(correlate.means(table(spark, sf_dir, "events"), "user_id", "event_type", "value"), "user_id", "event_type")


@query_named("entity_means", _MEANS + "SELECT * FROM m")
def _(spark, sf):
    return correlate.means(table(spark, sf, "events"), "user_id", "event_type", "value")


@query_named("pearson_edges", _MEANS + "SELECT a.event_type AS a, b.event_type AS b, count(*) AS n, round(CASE WHEN stddev_pop(a.mean) > 0 AND stddev_pop(b.mean) > 0 THEN covar_pop(a.mean, b.mean) / (stddev_pop(a.mean) * stddev_pop(b.mean)) END, 9) AS r FROM m a JOIN m b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL HAVING count(*) >= 12")
def _(spark, sf):
    return correlate.edges(pairs(spark, sf), 12, 0.0).withColumn("r", F.round("r", 9))


@query_named("strongest_pairs", _MEANS + "SELECT a.event_type AS a, b.event_type AS b, round(covar_pop(a.mean, b.mean) / (stddev_pop(a.mean) * stddev_pop(b.mean)), 9) AS r FROM m a JOIN m b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL ORDER BY abs(covar_pop(a.mean, b.mean) / (stddev_pop(a.mean) * stddev_pop(b.mean))) DESC, 1, 2 LIMIT 5")
def _(spark, sf):
    return correlate.strongest(pairs(spark, sf), 5).select("a", "b", F.round("r", 9).alias("r"))


@query_named("cliques")
def _(spark, sf):
    return correlate.cliques_of(pairs(spark, sf), least=0.0)


@query_named("mad_outliers", "WITH e AS (SELECT event_id, event_type, value FROM events WHERE value IS NOT NULL), m AS (SELECT event_type, median(value) AS median FROM e GROUP BY 1), d AS (SELECT e.*, m.median, abs(e.value - m.median) AS dev FROM e JOIN m USING (event_type)), k AS (SELECT event_type, median(dev) AS mad FROM d GROUP BY 1) SELECT d.event_id, d.event_type, d.median, k.mad FROM d JOIN k USING (event_type) WHERE k.mad > 0 AND abs(0.6745 * (d.value - d.median) / k.mad) > 3.5")
def _(spark, sf):
    return outliers.outliers(table(spark, sf, "events").select("event_id", "event_type", "value").filter("value is not null"), "event_type", exact=True).select("event_id", "event_type", "median", "mad")


@query_named("anomaly_counts", _M + "SELECT field, count(*) AS n FROM (SELECT 'number' AS field FROM m WHERE number IN ('Infinity', '5d') UNION ALL SELECT 'span' FROM m WHERE span = 'negative') GROUP BY 1")
def _(spark, sf):
    return manifest.anomalies(messy(spark, sf), manifest.Manifest.read(MANIFEST), "o_orderkey").groupBy("field").agg(F.count("*").alias("n"))


@query_named("token_usage", r"WITH c AS (SELECT role, turn % 2 = 0 AS batched, ceil((strlen(text) - len(regexp_extract_all(text, '[^A-Za-z0-9\s]')) - len(regexp_extract_all(text, '\s'))) / 4 + len(regexp_extract_all(text, '\s')) / 2 + len(regexp_extract_all(text, '[^A-Za-z0-9\s]')))::BIGINT AS t FROM conversations), p AS (SELECT *, ((t - t // 4) * 3.0 + (t // 4) * 3.0 * 0.1 + (t // 2) * 15.0) * CASE WHEN batched THEN 0.5 ELSE 1 END / 1e6 AS cost FROM c) SELECT role, count(*) AS calls, sum(t)::BIGINT AS tokens_in, sum(t // 2)::BIGINT AS tokens_out, bool_or(batched) AS any_batched, round(sum(cost), 9) AS cost, round(coalesce(sum(cost) FILTER (batched), 0), 9) AS batch_cost FROM p GROUP BY role")
def _(spark, sf):
    t, batched = text.token_estimate(F.col("text")), F.col("turn") % 2 == 0
    cost = values.token_cost(F.lit(3.0), F.lit(15.0), t, F.floor(t / 2), cached=F.floor(t / 4), batch=batched)
    calls = table(spark, sf, "conversations").select("role", t.alias("tokens_in"), F.floor(t / 2).alias("tokens_out"), batched.alias("batched"), cost.alias("cost"))
    return advisory.usage(calls, ["role"]).withColumns({c: F.round(c, 9) for c in ("cost", "batch_cost")})


# --- vectors ------------------------------------------------------------------------------------------------------
#: Which rows searches ask.
ASKED = "vec_id % 100 = 0"


def corpus(spark: SparkSession, sf_dir: str, asked: str = ASKED) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("doc"), F.col("label")).alias("document_id"), F.floor(F.col("vec_id") / 5).alias("section"), (F.col("vec_id") % 5).alias("vec"), F.col("embedding").alias("vector")), e.filter(asked).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
_SCORED = f"""WITH q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.query_id, 'doc' || e.label AS document_id, e.vec_id // 5 AS section, e.vec_id % 5 AS vec, {_DOT.format('q.query', 'e.embedding')} AS score FROM embeddings e, q),
b AS (SELECT query_id, document_id, section, max(score) AS score FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, section) AS rank FROM b) """


def scored_query(name: str, sql: str):
    return query_named(name, _SCORED + sql)


@scored_query("section_best", "SELECT query_id, document_id, section, round(score, 9) AS score FROM b WHERE score >= 0.3")
def _(spark, sf):
    return retrieval.scores(*corpus(spark, sf), vectors=False).select("query_id", "document_id", "section", F.round("score", 9).alias("score"))


@scored_query("vector_topk", "SELECT query_id, document_id, section, round(score, 9) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 5")
def _(spark, sf):
    return retrieval.nearest(*corpus(spark, sf), 5, floor=None).select("query_id", "document_id", "section", F.round("score", 9).alias("score"), "rank")


@scored_query("union_hits", "SELECT document_id, section, round(max(score), 9) AS score FROM r WHERE rank <= 5 GROUP BY ALL")
def _(spark, sf):
    return retrieval.union_hits(retrieval.nearest(*corpus(spark, sf), 5, floor=None)).withColumn("score", F.round("score", 9))


@scored_query("effective_counts", "SELECT query_id, count(*) AS n, greatest(1, least(ceil(exp(ln(sum(score)) - sum(score * ln(score)) / sum(score)) - 1e-9)::BIGINT, count(*))) AS k FROM r WHERE rank <= 30 AND score > 0 GROUP BY query_id")
def _(spark, sf):
    return retrieval.entropy_counts(retrieval.nearest(*corpus(spark, sf), 30, floor=None))


@scored_query("cliff_counts", ", l AS (SELECT query_id, rank, lag(score) OVER (PARTITION BY query_id ORDER BY rank) / score AS fall FROM r WHERE rank <= 30 AND score > 0), c AS (SELECT query_id, max(fall) AS fall, arg_max(rank, fall) AS place, max(rank) AS n FROM l GROUP BY 1) SELECT query_id, CASE WHEN fall >= 1.05 THEN place - 1 ELSE n END AS k FROM c")
def _(spark, sf):
    return retrieval.cliffs(retrieval.nearest(*corpus(spark, sf), 30, floor=None).filter("score > 0"), 1.05)


@scored_query("score_statistics", ", t AS (SELECT *, score / sum(score) OVER (PARTITION BY query_id) AS p FROM r WHERE rank <= 10), z AS (SELECT query_id, count(*) AS n, min(score) AS least, max(score) AS most, avg(score) AS mean, -sum(CASE WHEN p > 0 THEN p * log2(p) END) AS entropy FROM t GROUP BY 1) SELECT query_id, n, round(least, 9) AS least, round(most, 9) AS most, round(mean, 9) AS mean, round(entropy, 9) AS entropy, CASE WHEN entropy / log2(n) < 0.5 THEN 'peaky' WHEN entropy / log2(n) < 0.85 THEN 'moderate' ELSE 'flat' END AS label FROM z")
def _(spark, sf):
    s = retrieval.statistics(retrieval.nearest(*corpus(spark, sf), 10, floor=None))
    return s.select("query_id", "n", *(F.round(c, 9).alias(c) for c in ("least", "most", "mean", "entropy")), "label")


@scored_query("hit_suggestions", """, t AS (SELECT *, score - lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS fall, avg(score) OVER (PARTITION BY query_id) AS mean, stddev_pop(score) OVER (PARTITION BY query_id) AS sd FROM r WHERE rank <= 30),
z AS (SELECT query_id, arg_max(rank, fall) AS place, max(fall) AS fall, max(score) AS first, max(score) FILTER (rank = 2) AS second, count(*) FILTER (score >= mean + sd) AS above_sigma, count(*) FILTER (score >= mean) AS above_mean FROM t GROUP BY 1)
SELECT query_id, (CASE WHEN fall >= 0.1 * first THEN place END)::INTEGER AS knee, round(CASE WHEN second > 0 THEN first / second END, 9) AS first_by_second, CASE WHEN NOT second > 0 OR second IS NULL OR first / second >= 1.5 THEN 'clear winner' WHEN first / second >= 1.2 THEN 'moderate winner' ELSE 'no dominant winner' END AS label, above_sigma, above_mean FROM z""")
def _(spark, sf):
    return retrieval.suggestions(retrieval.nearest(*corpus(spark, sf), 30, floor=None)).withColumn("first_by_second", F.round("first_by_second", 9))


@query_named("unit_vectors", f"SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 6) > 0 AS any, round(1.0, 9) AS length, round({_DOT.format('embedding', 'embedding')} / {_DOT.format('embedding', 'embedding')}, 9) AS own FROM embeddings")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v")).withColumn("u", vectors.normalize(F.col("v")))
    return e.select("vec_id", (vectors.norm(F.col("v")) > 0).alias("any"), F.round(vectors.norm(F.col("u")), 9).alias("length"), F.round(vectors.similarity(F.col("u"), F.col("v")), 9).alias("own"))


@query_named("vector_math", f"SELECT a.vec_id, round({_DOT.format('a.embedding', 'b.embedding')}, 9) AS dot, round({_DOT.format('a.embedding', 'b.embedding')} / sqrt({_DOT.format('a.embedding', 'a.embedding')} * {_DOT.format('b.embedding', 'b.embedding')}), 9) AS cosine, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]) * (x[1]::DOUBLE - x[2])))), 9) AS l2 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    j = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    a, b = F.col("a"), F.col("b")
    return j.select("vec_id", F.round(vectors.dot(a, b), 9).alias("dot"), F.round(vectors.cosine(a, b), 9).alias("cosine"), F.round(vectors.l2(a, b), 9).alias("l2"))


@query_named("vector_centroid", "SELECT label, i, round(avg(x), 9) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::INTEGER AS i FROM embeddings) GROUP BY ALL")
def _(spark, sf):
    c = retrieval.centroid(table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vector")), "label")
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.round("x", 9).alias("x"))


@query_named("vector_offsets", "WITH s AS (SELECT 'doc' || label AS document_id, vec_id // 5 AS section, count(*) AS count FROM embeddings GROUP BY ALL) SELECT document_id, section, count, coalesce(sum(count) OVER (PARTITION BY document_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM s")
def _(spark, sf):
    return retrieval.offsets(corpus(spark, sf)[0].groupBy("document_id", "section").agg(F.count("*").alias("count")))


@query_named("vector_search")
def _(spark, sf):
    return retrieval.search(*corpus(spark, sf))


@query_named("vector_search_pivot")
def _(spark, sf):
    return retrieval.search(*corpus(spark, sf), settings=retrieval.Settings(pivot=True, pivot_at_most=30, pivot_score=0.3))


@query_named("position_changes")
def _(spark, sf):
    c, q = corpus(spark, sf)
    best = retrieval.candidates(c, q)
    return retrieval.position_changes(best, retrieval.search(c, q, best=best), ["query_id", "document_id", "section"])


@query_named("representative_spans")
def _(spark, sf):
    import pandas as pd

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id").reset_index(drop=True)
        v = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        return pdf.iloc[vectors.representative(v, v.mean(axis=0), threshold="support")][["block", "vec_id"]]

    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("block"), "vec_id", "embedding")
    return e.groupBy("block").applyInPandas(run, "block long, vec_id long")


# --- text ---------------------------------------------------------------------------------------------------------
@query_named("text_sizes", r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::INTEGER AS words, CASE WHEN len(regexp_extract_all(text, '\S+')) < 150 THEN 'short' WHEN len(regexp_extract_all(text, '\S+')) > 400 THEN 'long' ELSE 'medium' END AS bucket FROM documents")
def _(spark, sf):
    n = text.word_count(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", n.alias("words"), text.size_bucket(n).alias("bucket"))


@query_named("caps_ratio", "WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Z]')) AS u, len(regexp_extract_all(text, '[A-Za-z]')) AS n FROM documents) SELECT doc_id, CASE WHEN n = 0 THEN 0.0 ELSE u / n END AS ratio, CASE WHEN n < 4 THEN 0.0 ELSE greatest(0.0, least(1.0, (CASE WHEN n = 0 THEN 0.0 ELSE u / n END - 0.4) / (0.7 - 0.4))) END AS shouting FROM c")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.caps_ratio(F.col("text")).alias("ratio"), text.shouting(F.col("text")).alias("shouting"))


@query_named("searchable_text", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}\s-]', ' ', 'g'), '\s+', ' ', 'g'))) AS sha FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.searchable(F.col("text")), 256).alias("sha"))


@query_named("snake_names", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.snake(F.concat_ws(" / ", "p_name", "p_brand")).alias("name"))


@query_named("markdown_names", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') || '.md' AS file FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.file_name(F.concat(F.lit("intro\n# **"), F.col("p_name"), F.lit("**  \nbody"))).alias("file"))


@query_named("numbers_in_text", r"SELECT doc_id, len(regexp_extract_all(text, '\d+(?:\.\d+)?'))::INTEGER AS numbers, regexp_matches(text, '\bhttps?://|\bwww\.|\]\(') AS link FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(text.numbers_in(F.col("text"))).alias("numbers"), text.has_link(F.col("text")).alias("link"))


_FILE = "url || CASE page_id % 12 WHEN 0 THEN '/a.HTML?x=1' WHEN 1 THEN '/b.png' WHEN 2 THEN '/c.unknown' WHEN 3 THEN '/d.csv#top' WHEN 4 THEN '/e.json' WHEN 5 THEN '/f.jpeg' WHEN 6 THEN '/g.SVG' WHEN 7 THEN '/h.md' WHEN 8 THEN '/i.tar.txt' WHEN 9 THEN '/' WHEN 10 THEN '/k.webp' ELSE '' END"


@query_named("media_types", rf"SELECT page_id, CASE lower(regexp_extract(regexp_replace({_FILE}, '[?#].*$', ''), '([A-Za-z0-9]+)$', 1)) WHEN 'html' THEN 'text/html' WHEN 'png' THEN 'image/png' WHEN 'csv' THEN 'text/csv' WHEN 'json' THEN 'application/json' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'svg' THEN 'image/svg+xml' WHEN 'md' THEN 'text/markdown' WHEN 'txt' THEN 'text/plain' WHEN 'webp' THEN 'image/webp' ELSE 'application/octet-stream' END AS kind FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").selectExpr("page_id", f"{_FILE} AS file").select("page_id", media_type(F.col("file")).alias("kind"))


@query_named("document_ids", r"WITH p AS (SELECT page_id, list_filter(string_split_regex(regexp_replace(url, '[?#].*$', ''), '[/\\]+'), lambda x: x <> '') AS parts FROM pages), c AS (SELECT page_id, trim(regexp_replace(lower(strip_accents(CASE WHEN len(parts) > 1 THEN parts[-2] ELSE '' END)), '[^a-z0-9]+', '_', 'g'), '_') AS theme, trim(regexp_replace(lower(strip_accents(regexp_replace(parts[-1], '(?i)\.(md|markdown|bin|txt|html?)$', ''))), '[^a-z0-9]+', '_', 'g'), '_') AS stem FROM p) SELECT page_id, CASE WHEN theme <> '' THEN theme || '|' || stem ELSE stem END AS document_id FROM c")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", document_id(F.col("url")).alias("document_id"))


@query_named("word_split", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}\x27-]+'), lambda w: w <> '')) AS words, NOT regexp_matches(text, '[‘’“”–—…]') AS plain FROM documents WHERE text IS NOT NULL")
def _(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null")
    return d.select("doc_id", F.size(text.words(F.col("text"))).cast("long").alias("words"), (text.normalize_punctuation(F.col("text")) == F.col("text")).alias("plain"))


@query_named("model_inputs", r"SELECT conv_id, turn, CASE WHEN starts_with(t, 'query: ') THEN t ELSE 'query: ' || t END AS asked, regexp_matches(t, '(?m)^#[ \t]+\S') AS titled, trim(text) AS inside FROM (SELECT *, CASE turn % 3 WHEN 0 THEN 'query: ' || text WHEN 1 THEN '# ' || text ELSE text END AS t FROM conversations)")
def _(spark, sf):
    c = table(spark, sf, "conversations").withColumn("t", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("query: "), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("# "), "text")).otherwise(F.col("text")))
    fenced = F.concat(F.lit(" ```json\n"), F.col("text"), F.lit("\n``` "))
    return c.select("conv_id", "turn", text.with_instruction(F.col("t")).alias("asked"), text.has_title(F.col("t")).alias("titled"), text.without_fences(fenced).alias("inside"))


#: What is said in each turn with greetings, shouts, urgency and second questions added to seven of eight: the same in both dialects.
_SPOKEN = "CASE (conv_id + turn) % 8 WHEN 0 THEN 'Hello there! ' || text WHEN 1 THEN text || ' Thanks.' WHEN 2 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '!!!' WHEN 3 THEN text || ' please hurry, right now?!?' WHEN 4 THEN 'damn it,, ' || text WHEN 5 THEN text || ' What is it? Explain why and describe how.' WHEN 6 THEN 'Hi. ' || text || ' This is bullshit, now now!! thank you. As soon as possible' ELSE text END"
_S = f"WITH s AS (SELECT conv_id * 1000 + turn AS query_id, text AS q FROM conversations UNION ALL SELECT -(conv_id * 1000 + turn) - 1, {_SPOKEN} FROM conversations) "


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's whole text as a question."""
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's whole text as it is, and under negative ids with signs added."""
    return _asked(spark, sf_dir).unionByName(table(spark, sf_dir, "conversations").selectExpr("-(conv_id * 1000 + turn) - 1 AS query_id", f"{_SPOKEN} AS query"))


@query_named("query_analysis")
def _(spark, sf):
    return query.analyze(_asked(spark, sf), {"teh": "the"})


_GREETS = "regexp_replace(trim(regexp_replace(lower({0}), '[\\s!?.,]+', ' ', 'g')), '\\s+', ' ', 'g') IN ('hi', 'hey', 'hello', 'hi there', 'hey there', 'hello there', 'good morning', 'good afternoon', 'good evening', 'thanks', 'thank you')"
_PIECES = "string_split(regexp_replace(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '([!?.,]) ', '\\1' || chr(1), 'g'), chr(1))"
_ONE_MARK = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '([!?])[!?]+', '\1', 'g'), ',+', ',', 'g'), '\.+', '.', 'g'), ';+', ';', 'g'), ':+', ':', 'g')"


def _twice(words: tuple[str, ...]) -> str:
    return f"len(list_filter(string_split_regex(lower(c), '[\\n\\r]+'), lambda l: len(list_filter(regexp_extract_all(l, '[a-z0-9_]+'), lambda w: w IN ({', '.join(map(repr, words))}))) > 1)) > 0"


@query_named("multi_part", _S + f", o AS (SELECT query_id, {_ONE_MARK.format('q')} AS c FROM s), p AS (SELECT *, {_PIECES.format('c')} AS pieces FROM o) SELECT query_id, length(c) - length(replace(c, '?', '')) > 1 OR {_twice(query.QUESTION_WORDS)} OR {_twice(query.REQUEST_WORDS)} OR regexp_matches(lower(c), '(^|[^a-z0-9_])(also|additionally|as\\s+well\\s+as|in\\s+addition)($|[^a-z0-9_])') OR regexp_matches(c, '[A-Za-z0-9_]{{4,}}[.!?]\\s+[A-Za-z0-9_]{{4,}}') OR regexp_matches(c, '[A-Za-z0-9_]{{3,}}[.!?]\\s+[A-Z]') OR ({_GREETS.format('pieces[1]')} AND regexp_matches(array_to_string(pieces[2:], ' '), '[A-Za-z0-9]')) AS several FROM p")
def _(spark, sf):
    return spoken(spark, sf).select("query_id", query.multi_part(F.col("query")).alias("several"))


@query_named("question_parts")
def _(spark, sf):
    return spoken(spark, sf).select("query_id", F.posexplode(query.parts(F.col("query"))).alias("part", "said"))


_WORDS = "regexp_extract_all(lower(q), '[\\p{L}\\p{N}_]+')"


@query_named("frustration", _S + f""", w AS (SELECT query_id, q, {_WORDS} AS w, len(regexp_extract_all(q, '[A-Z]')) AS u, len(regexp_extract_all(q, '[A-Za-z]')) AS n FROM s),
f AS (SELECT query_id, CASE WHEN n < 4 THEN 0 ELSE greatest(0, least(1, (u / n - 0.4) / (0.7 - 0.4))) END AS shouting,
 least(1, coalesce(list_sum(list_transform(regexp_extract_all(q, '[!?]{{2,}}'), lambda r: (length(r) - 1) * CASE WHEN contains(r, '!') THEN 1.0 ELSE 0.5 END)), 0) / 5) AS punctuation,
 least(1, (len(list_filter(w, lambda x: x IN ('now', 'asap', 'urgent', 'urgently', 'immediately', 'emergency', 'hurry'))) + len(regexp_extract_all(lower(q), 'as soon as possible'))) / 2) AS urgency,
 len(list_filter(w, lambda x: x IN ('shit', 'fuck', 'fucking', 'bullshit', 'asshole'))) > 0 AS heavy, len(list_filter(w, lambda x: x IN ('damn', 'hell', 'crap', 'sucks', 'stupid'))) > 0 AS rude FROM w),
t AS (SELECT *, 0.25 * shouting + 0.2 * punctuation + 0.25 * urgency + 0.4 * CASE WHEN heavy THEN 1.0 WHEN rude THEN 0.6 ELSE 0 END AS total FROM f), z AS (SELECT query_id, round(least(1.0, CASE WHEN heavy THEN greatest(total, 0.5) ELSE total END)::DOUBLE, 9) AS score FROM t)
SELECT query_id, score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'moderate' WHEN score >= 0.2 THEN 'mild' ELSE 'none' END AS level FROM z""")
def _(spark, sf):
    scored = spoken(spark, sf).select("query_id", F.round(query.frustration(F.col("query"))["score"], 9).alias("score"))
    return scored.withColumn("level", query.frustration_level(F.col("score")))


@query_named("greeting_peel", _S + f", p AS (SELECT query_id, {_PIECES.format("coalesce(q, '')")} AS pieces FROM s) SELECT query_id, array_to_string(list_filter(pieces, lambda x, i: NOT (({_GREETS.format('x')}) AND (i = 1 OR i = len(pieces) OR right(pieces[i - 1], 1) <> ','))), ' ') AS bare FROM p")
def _(spark, sf):
    return spoken(spark, sf).select("query_id", query.without_greeting(F.col("query")).alias("bare"))


@query_named("greeting_reply", _S + "SELECT query_id, CASE WHEN regexp_matches(lower(q), '(^|[^\\p{L}\\p{N}_])thank') THEN 'welcome' WHEN regexp_matches(lower(q), 'good\\s+morning') THEN 'morning' WHEN regexp_matches(lower(q), 'good\\s+(afternoon|evening)') THEN 'evening' ELSE 'hello' END AS reply FROM s")
def _(spark, sf):
    return spoken(spark, sf).select("query_id", query.greeting_reply(F.col("query")).alias("reply"))


@query_named("intents", "WITH l AS (SELECT DISTINCT conv_id AS query_id, CASE WHEN turn = 0 THEN 'GREETING' WHEN length(text) % 3 = 0 THEN 'TECHNICAL' WHEN length(text) % 3 = 1 THEN 'CONVERSATIONAL' ELSE 'ACTION' END AS label FROM conversations) SELECT query_id, string_agg(label, ',' ORDER BY label <> 'GREETING', label) AS intents FROM l GROUP BY query_id")
def _(spark, sf):
    n = F.length("text") % 3
    label = F.when(F.col("turn") == 0, "GREETING").when(n == 0, "TECHNICAL").when(n == 1, "CONVERSATIONAL").otherwise("ACTION")
    return query.intents(table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), label.alias("label"))).withColumn("intents", F.array_join("intents", ","))


@query_named("searchable_segments", "SELECT conv_id, turn FROM conversations WHERE NOT (role = 'user' AND (turn % 10) / 10 >= 0.7)")
def _(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "CONVERSATIONAL").otherwise("TECHNICAL").alias("label"), ((F.col("turn") % 10) / 10).alias("score"))
    return retrieval.searchable(c).select("conv_id", "turn")


@query_named("collapse_punctuation", _S + f"SELECT query_id, {_ONE_MARK.format('q')} AS said FROM s")
def _(spark, sf):
    return spoken(spark, sf).select("query_id", text.collapse_punctuation(F.col("query")).alias("said"))


@query_named("spelling", "WITH p AS (SELECT DISTINCT p_name FROM part), w AS (SELECT DISTINCT unnest([p_name[1] || p_name[3:], p_name[:-3] || p_name[-1] || p_name[-2]]) AS word FROM p), d AS (SELECT word, p_name AS entry, levenshtein(lower(word), lower(p_name)) AS d FROM w, p), b AS (SELECT word, arg_min(entry, (d, entry)) AS s FROM d WHERE d <= 2 GROUP BY word) SELECT word, coalesce(s, word) AS suggestion FROM w LEFT JOIN b USING (word)")
def _(spark, sf):
    """Every part's name with its second letter left out, and with its last two changed round, looked up among the names at up to two edits."""
    p = table(spark, sf, "part").select("p_name").distinct()
    n = F.length("p_name")
    without = F.concat(F.substring("p_name", 1, 1), F.substring("p_name", F.lit(3), n))
    turned = F.concat(F.substring("p_name", F.lit(1), n - 2), F.reverse(F.substring("p_name", -2, 2)))
    return query.suggest(p.select(F.explode(F.array(without, turned)).alias("word")), p.select(F.col("p_name").alias("entry")))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")


@query_named("segments")
def _(spark, sf):
    return segment.segment_table(_texts(spark, sf))


@query_named("sections")
def _(spark, sf):
    return segment.section_table(_texts(spark, sf))


@query_named("section_chunks")
def _(spark, sf):
    return segment.chunk_table(_texts(spark, sf)).select("document_id", "section", "chunk", F.length("text").alias("n"))


@query_named("section_vectors")
def _(spark, sf):
    return chains.build(_texts(spark, sf)).select("document_id", "section", "vec", "range_start", "range_end", "vector")


@query_named("question_hits")
def _(spark, sf):
    """What the parts of every turn of each hundredth conversation find in all documents."""
    asked = _asked(spark, sf).filter(F.floor(F.col("query_id") / 1000) % 100 == 0)
    return chains.ask(asked, chains.build(_texts(spark, sf)), _texts(spark, sf))


@query_named("section_text", "SELECT d.doc_id::VARCHAR AS document_id, substr(text, 11, 40) AS section_text FROM documents d WHERE length(text) >= 50")
def _(spark, sf):
    t = _texts(spark, sf)
    hits = t.select("document_id", F.lit(10).alias("range_start"), F.lit(50).alias("range_end"))
    return retrieval.with_text(hits, t).select("document_id", "section_text")


# --- advice -------------------------------------------------------------------------------------------------------
@query_named("advisory_gate", _TICKETS + "SELECT severity, CASE WHEN severity <> 'critical' THEN 'not asked' WHEN code IN ('click', 'error') AND way = 'high' THEN 'verified' ELSE 'no rule' END AS status, count(*) AS n FROM d GROUP BY ALL")
def _(spark, sf):
    rules = [{"rule_id": f"r-{c}", "loinc": c, "direction": "high", "statement": "see a colleague", "url": "https://example.org/rules"} for c in ("click", "error")]
    t = all_tickets(spark, sf).withColumn("loinc", F.col("component"))
    made = advisory.attach(t, rules, lambda row, own: {"rule_id": own[0]["rule_id"], "facts": [f"component: {row['component']}"], "assessment": "far out of range", "plan": "repeat the measurement"}, facts=("component", "value"))
    return made.groupBy("severity", F.col("hypothesis.status").alias("status")).agg(F.count("*").alias("n"))


@query_named("applicable_rules", _TICKETS + "SELECT d.id, 'r-' || d.code AS rule_id FROM d WHERE d.code IN ('click', 'error') AND d.way = 'high'")
def _(spark, sf):
    rules = spark.createDataFrame([(f"r-{c}", c, "high", "s", "u") for c in ("click", "error")], "rule_id string, loinc string, direction string, statement string, url string")
    return advisory.applicable(all_tickets(spark, sf).withColumn("loinc", F.col("component")), rules).select("id", "rule_id")
