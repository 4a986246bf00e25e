"""Cells, transforms, sources, manifests, checks."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeweave.functions import cells, records, transforms
from lakeweave.functions.docid import derive, sanitize
from lakeweave.operators import advisory, correlate, gaps, manifest, migrate, model, outliers, reconcile, reshape, tickets, triage
from lakeweave.operators.analyzers import Analyzer, Registry
from lakeweave.sources import delimited, files, json_records, vector_file


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_trim_takes_all_white_space(spark):
    assert column(spark, ["\t a ", "﻿b", " 　 ", None, "c d"], cells.trim) == ["a", "b", None, None, "c d"]


def test_numbers_are_plain_and_finite(spark):
    assert column(spark, ["1,234.5", " -3e2 ", "Infinity", "5d", "0x1A", "", "1e999", ".5", "NaN"], cells.to_number) == [1234.5, -300.0, None, None, None, None, None, 0.5, None]


def test_dates_keep_what_they_cannot_read(spark):
    assert column(spark, ["2020-01-31T10:00", "3/4/2019", "1998", "soon ", None], transforms.to_date) == ["2020-01-31", "2019-03-04", "1998", "soon", None]


def test_sentinels(spark):
    assert column(spark, ["N/A", " none ", "-", "x", ""], cells.normalize) == [None, None, None, "x", None]
    assert column(spark, ["N/A", "x", "  "], cells.is_sentinel) == [True, False, False]


@pytest.mark.parametrize("name", list(transforms.REGISTRY))
def test_every_transform_agrees_with_its_contract(spark, name):
    t = transforms.REGISTRY[name]
    raw = {"to_number": ["1", "2.50", "", None], "to_date": ["2020-01-02", "1/2/2020", ""], "to_boolean": ["yes", "N", None], "split_bp": ["120/80", "", "1.5 / 2"], "parse_reference_range": ["1-2", "<5", ">=7", ""]}.get(name, [" a ", "B", None, ""])

    def check(c):
        out = t.apply(c)
        return t.check(c, out if isinstance(out, list) else [out])

    assert all(column(spark, raw, check))


@given(st.lists(st.lists(st.text(alphabet='ab,"\n\r ', max_size=5), min_size=1, max_size=4), max_size=6))
@settings(max_examples=200, deadline=None)
def test_what_is_written_with_quotes_reads_back(rows):
    text = "".join(",".join('"' + c.replace('"', '""') + '"' for c in r) + "\n" for r in rows)
    assert list(delimited.tokenize(text)) == rows


def test_tokenizer_corners():
    assert list(delimited.tokenize("a,b\r\n\r\nc,d")) == [["a", "b"], [""], ["c", "d"]]
    assert list(delimited.tokenize('a"b,"c""d"x\re')) == [['a"b', 'c"dx'], ["e"]]
    assert list(delimited.tokenize("a,")) == [["a", ""]]
    assert list(delimited.tokenize("")) == []


def test_sniffing():
    assert delimited.sniff("id|name|full\n1|x, y|z\n2|z|w\n")["delimiter"] == "|"
    assert delimited.sniff("id,n\n1,2\n")["has_header"] and not delimited.sniff("1,2\n3,4\n")["has_header"]


def test_ragged_rows_are_repaired_and_logged(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,x\n1,"two\nlines"\n2,b,c,d\n3,e,f\n')
    rows = delimited.cells(spark, str(tmp_path / "a.csv"))
    names = delimited.header(rows)
    assert names == ["id", "name", "x"]
    fixed = {r.id: (r.name, r.x) for r in delimited.repaired(rows, names).collect()}
    assert fixed == {"1": ("two\nlines", None), "2": ("b", "c"), "3": ("e", "f")}
    log = {r.record_index: (r.kind, r.detail) for r in delimited.anomalies(rows, 3).collect()}
    assert log == {0: ("ragged_short", "2 of 3"), 1: ("ragged_long", '["d"]')}


def test_json_records(spark):
    assert json_records.flatten({"a": {"b": " x "}, "c": [1, {"d": True}], "e": [], "f": " "}) == {"a.b": "x", "c.0": 1, "c.1.d": True, "e": None, "f": None}
    df = spark.createDataFrame([("s", '{"n": 1, "rows": [{"k": 1}, {"k": 2}]}'), ("bad", "{"), ("scalar", "3")], "source string, text string")
    got = [(r.source, r.record_index, r["values"], r.anomaly) for r in json_records.records(df).collect()]
    assert got == [("s", 0, {"k": "1"}, None), ("s", 1, {"k": "2"}, None), ("bad", -1, None, "json_parse_error")]


def test_vector_files(spark, tmp_path):
    raw = vector_file.encode("theme|dóc", [(0, 5, [[1.0, 0.0]]), (5, 9, [[0.0, 1.0], [0.5, 0.5]])])
    (tmp_path / "a.bin").write_bytes(raw)
    rows = vector_file.read(spark, str(tmp_path))
    assert [(r.document_id, r.section, r.range_start, r.range_end, r.vec, list(r.vector)) for r in rows.orderBy("section", "vec").collect()] == [("theme|dóc", 0, 0, 5, 0, [1, 0]), ("theme|dóc", 1, 5, 9, 0, [0, 1]), ("theme|dóc", 1, 5, 9, 1, [0.5, 0.5])]
    assert vector_file.one_length(rows) == 2
    assert bytes(vector_file.files(rows).first().content) == raw
    with pytest.raises(ValueError):
        vector_file.decode(b"\0" * 40)


def test_markdown_source_and_maintenance(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "One-Two.md").write_text("# T\n\nbody")
    docs = files.markdown(spark, str(tmp_path), theme="t")
    assert [r.document_id for r in docs.collect()] == ["t|one_two"]
    with pytest.raises(ValueError):
        files.add(docs, docs)
    assert files.remove(docs, docs.select("document_id")).count() == 0
    assert files.unknown(docs, spark.createDataFrame([("x",)], "document_id string")).count() == 1


def test_document_ids():
    assert sanitize("Élan Vital! (2)") == "elan_vital_2"
    assert derive("/a/Big Theme/My File.md") == "big_theme|my_file"
    assert derive("big_theme|my_file|md_123") == "big_theme|my_file"
    with pytest.raises(ValueError):
        derive("a|b", theme="c", conflict="throw")


def test_safe_names():
    assert files.safe_name("a.csv") == "a.csv"
    for bad in ("../a.csv", "a.txt", ".csv"):
        with pytest.raises(ValueError):
            files.safe_name(bad)


def test_canonical_model():
    assert len(model.PATHS) == 11 and sum(map(len, model.PATHS.values())) == 118
    assert model.schema("lab_result")["reference_low"].metadata["path"] == "lab_result.reference.low"


MANIFEST = {"source": "s", "entity": "vital", "fields": [{"from": "ID", "to": "vital.id"}, {"from": "bp", "emits": ["vital.bp.systolic", "vital.bp.diastolic"], "transform": "split_bp"}, {"from": "gone", "to": "vital.name"}, {"from": "skip"}]}


def test_manifest_validation():
    assert manifest.validate(MANIFEST)["errors"] == [] and manifest.validate(MANIFEST)["dropped"] == ["skip"]
    bad = {"source": "", "entity": "x", "fields": [{"to": "vital.id"}, {"from": "a", "to": "vital.no", "transform": "nope"}, {"from": "b", "emits": ["vital.id"], "transform": "trim"}]}
    assert len(manifest.validate(bad)["errors"]) >= 5
    assert manifest.validate([])["errors"] == ["not an object"]


def test_manifest_applies_and_reports(spark):
    df = spark.createDataFrame([("1", "120/80", "x"), ("2", "high", "y"), ("3", None, "z")], "`v.ID` string, `v.bp` string, `v.skip` string")
    m = manifest.Manifest.read(MANIFEST)
    assert [tuple(r) for r in manifest.apply(df, m).orderBy("id").collect()] == [("1", 120.0, 80.0, None), ("2", None, None, None), ("3", None, None, None)]
    found = manifest.report(df.withColumnRenamed("v.ID", "key"), manifest.Manifest.read({**MANIFEST, "fields": [{"from": "key", "to": "vital.id"}, *MANIFEST["fields"][1:]]}), "key")
    assert not found["passed"] and found["loss_fields"] == ["bp"] and found["unresolved"] == ["gone"]
    kinds = {(r.kind, r.field) for r in manifest.anomalies(df.withColumnRenamed("v.ID", "key"), m, "key").collect()}
    assert ("transform_unparsed", "bp") in kinds and ("unresolved_source", "gone") in kinds


def test_resolver():
    assert manifest.resolve("b", ["x.a.b", "c"]) == "x.a.b"
    assert manifest.resolve("n.b", ["m.b", "b"]) == "m.b"
    assert manifest.resolve("q", ["a"]) is None


def test_repair_loop(spark, tmp_path):
    df = spark.createDataFrame([("1", "2.5")], "id string, value string")
    good = manifest.induce(df, "s.csv", "lab_result")
    turns = iter([{"source": "s.csv", "entity": "nope", "fields": []}, good])
    m, found = manifest.with_repair(df, "id", lambda told: next(turns))
    assert found["passed"] and found["attempts"] == 1
    manifest.save(m, str(tmp_path))
    assert manifest.load("s.csv", str(tmp_path)) == m
    with pytest.raises(ValueError):
        manifest.with_repair(df, "id", lambda told: {}, supplied={"entity": "nope", "fields": []})


def test_renamed_sources_give_equal_rows(spark):
    a = spark.createDataFrame([("1", "5"), ("2", "x")], "RESULT_ID string, VAL string")
    b = a.toDF("obs_id", "reading")
    field = lambda i, v: {"source": "s", "entity": "lab_result", "fields": [{"from": i, "to": "lab_result.id"}, {"from": v, "to": "lab_result.value", "transform": "to_number"}]}
    rows = [manifest.apply(df, manifest.Manifest.read(field(*df.columns))).orderBy("id").collect() for df in (a, b)]
    assert rows[0] == rows[1]


def test_triage(spark):
    rows = [(1, 7.0), (2, 11.0), (3, 14.0), (4, 25.0), (5, 500.0), (6, None), (7, float("nan")), (8, -1.0)]
    df = spark.createDataFrame(rows, "id int, value double").select("*", F.lit(5.0).alias("low"), F.lit(10.0).alias("high"), F.lit(20.0).alias("critical_high"), F.lit(100.0).alias("plausible_high"))
    got = {r.id: (r.outcome, r.severity) for r in triage.triage(df).collect()}
    assert got == {1: ("in_range", None), 2: ("finding", "mild"), 3: ("finding", "moderate"), 4: ("finding", "critical"), 5: ("implausible", "data-quality"), 6: ("skipped", None), 7: ("skipped", None), 8: ("finding", "moderate")}


def test_generic_plausibility(spark):
    df = spark.createDataFrame([(1, 36.0), (2, 34.0), (3, -0.1)], "id int, value double").select("*", F.lit(5.0).alias("low"), F.lit(10.0).alias("high"))
    assert {r.id: r.outcome for r in triage.triage(df).collect()} == {1: "implausible", 2: "finding", 3: "implausible"}


def test_gaps(spark):
    rules = spark.createDataFrame([("E11", "diabetes", ["a1c", "lipids"]), ("E", "other", ["x"])], "prefix string, condition string, expects array<string>")
    people = spark.createDataFrame([("p1", "e11.9"), ("p1", "E 11.9"), ("p2", "E20"), ("p3", "Z"), (None, "E11")], "patient_id string, code string")
    wanted = gaps.by_longest_prefix(people, rules, "code").withColumn("expected_code", F.explode("expects"))
    done = spark.createDataFrame([("p1", "a1c")], "patient_id string, code string")
    ordered = spark.createDataFrame([("p1", "lipids")], "patient_id string, code string")
    got = {(r.patient_id, r.condition, r.expected_code, r.gap_type) for r in gaps.gaps(wanted, done, ordered).collect()}
    assert got == {("p1", "diabetes", "lipids", "ordered-not-resulted"), ("p2", "other", "x", "never-ordered")}
    assert tuple(gaps.stats(wanted, done, ordered).first()) == (2, 1, 1, 1)
    assert [r.x for r in people.select(gaps.longest_prefix(F.col("code"), {"E11": "d", "E": "o"}).alias("x")).collect()] == ["d", "d", "o", None, "d"]


def test_reconciliation_by_alias(spark):
    orders = spark.createDataFrame([("p", "tiotropium 18 mcg (Spiriva)"), ("p", "metformin ER 500 mg")], "patient_id string, name string")
    notes = spark.createDataFrame([("p", "Spiriva"), ("p", "aspirin"), ("p", "Aspirin 81 mg"), ("p", "(")], "patient_id string, name string")
    got = {(r.kind, r.aliases[0]) for r in reconcile.medication_reconciliation(orders, notes).collect()}
    assert got == {("left_only", "metformin"), ("right_only", "aspirin")}


def test_migration(spark):
    s = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "k int, name string, value double")
    t = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.5), (4, "d", 4.0)], "k int, name string, value double")
    c = migrate.compare(s, t, "k", ["name", "value"])
    r = migrate.report(c, 2).first()
    assert (r.dropped, r.added, r.mismatches, r.passed, r.completeness, r.fidelity) == (1, 1, 1, False, 66.667, 75.0)
    assert {(x.k, x.kind, x.field, x.severity) for x in migrate.findings(c, "k").collect()} == {(3, "dropped", None, 3), (2, "mismatch", "value", 2)}
    assert migrate.report(migrate.compare(s, s, "k", ["value"]), 1).first().passed


def test_cliques():
    w = np.zeros((5, 5))
    for a, b, v in ((0, 1, 0.9), (0, 2, 0.8), (1, 2, 0.85), (3, 4, 0.5)):
        w[a, b] = w[b, a] = v
    assert [sorted(c) for c, _ in correlate.cliques(w)] == [[0, 1, 2], [3, 4]]
    assert correlate.cohesion(w, np.array([3, 4])) == 0.5
    assert correlate.cliques(np.zeros((3, 3))) == []


def test_cliques_go_on_past_a_loose_set():
    w = np.zeros((5, 5))
    for a, b, v in ((0, 1, 0.29), (0, 2, 0.29), (1, 2, 0.29), (3, 4, 0.4)):
        w[a, b] = w[b, a] = v
    assert [sorted(c) for c, _ in correlate.cliques(w)] == [[3, 4]]


def test_cliques_against_all_subsets():
    """The first set peeled off is at least as close by its own weights as any set of which none of its members is part."""
    from itertools import combinations

    r = np.random.default_rng(3)
    for _ in range(30):
        w = np.triu(r.uniform(0, 1, (7, 7)), 1)
        w = w + w.T
        found = correlate.cliques(w, least=0.0)
        members = [set(c) for c, _ in found]
        assert all(not a & b for a, b in combinations(members, 2))
        for own, close in found:
            assert close == pytest.approx(np.mean([w[a, b] for a, b in combinations(own, 2)]))
        # by Motzkin and Straus a dominant set's weighted cohesion is a local maximum: no single key outside supports it more than its members do
        first = correlate.dominant_set(w)
        x = np.full(7, 1 / 7)
        for _ in range(2000):
            x = x * (w @ x) / (x @ w @ x)
        assert all((w @ x)[k] <= x @ w @ x + 1e-6 for k in range(7)) and set(first.tolist()) == set(np.flatnonzero(x > 1 / 21).tolist()) == members[0]


def test_notes_against_orders(spark):
    notes = spark.createDataFrame([(1, 7, "Medication: Lipitor (atorvastatin) daily, aspirin"), (2, 8, "medication: none known but zocor"), (3, 9, "nothing"), (4, None, "medication: aspirin")], "note_id int, patient_id int, text string")
    orders = spark.createDataFrame([(7, "Atorvastatin 20 mg", "active"), (7, "metformin", "1"), (7, "aspirin", "inactive"), (9, "aspirin", "active")], "patient_id int, name string, status string")
    made = spark.createDataFrame([(1, "Lipitor (atorvastatin)"), (1, "aspirin"), (1, "made up"), (2, "zocor"), (4, "aspirin")], "note_id int, name string")
    got = reconcile.reconcile_notes(notes, orders, lambda df: made.join(df.select("note_id"), "note_id")).collect()
    assert {(r.patient_id, r.kind, r.name) for r in got} == {(7, "note_only", "aspirin"), (7, "order_only", "metformin"), (8, "note_only", "zocor")}


def test_calls_run_in_turn_and_few_at_a_time():
    import threading
    import time as clock

    slots, order, now, most = records.Slots(2), [], [0], [0]

    def call(i):
        now[0] += 1
        most[0] = max(most[0], now[0])
        order.append(i)
        clock.sleep(0.02)
        now[0] -= 1

    threads = [threading.Thread(target=slots.run, args=(lambda i=i: call(i),)) for i in range(8)]
    for t in threads:
        t.start()
        clock.sleep(0.004)
    for t in threads:
        t.join()
    assert order == list(range(8)) and most[0] == 2
    with pytest.raises(ZeroDivisionError):
        slots.run(lambda: 1 / 0)
    assert slots.run(lambda: 5) == 5


def test_outliers(spark):
    df = spark.createDataFrame([("f", float(100 + i % 3)) for i in range(12)] + [("f", 900.0), ("flat", 1.0)], "field string, value double")
    assert [r.value for r in outliers.outliers(df).collect()] == [900.0]


def test_registry_runs_what_has_its_entities(spark):
    r = Registry()
    one = r.register(Analyzer("a", "A", ("x",), lambda d: d["x"].select(F.lit("mild").alias("severity"))))
    r.register(Analyzer("b", "B", ("y",), lambda d: d["y"]))
    assert r.register(Analyzer("a", "again", "*", print)) is one
    out = r.run_all({"x": spark.range(2), "y": spark.range(0)})
    assert out.count() == 2 and out.first().checker == "a" and r.list() == [("a", "A"), ("b", "B")]
    with pytest.raises(ValueError):
        r.register(Analyzer("", "", (), print))


def test_first_of_each_and_order(spark):
    df = spark.createDataFrame([("a", "mild", 1.0, 2), ("a", "critical", 2.0, 1), ("b", "moderate", 1.0, 1), ("c", "odd", 1.0, 1)], "id string, severity string, out_by double, n int")
    assert {(r.id, r.severity) for r in tickets.first_of_each(df, "id", "n").collect()} == {("a", "critical"), ("b", "moderate"), ("c", "odd")}
    assert [r.severity for r in tickets.ordered(df, "n").collect()] == ["critical", "moderate", "mild", "odd"]


def test_paths_in_structs(spark):
    df = spark.range(1).select(F.struct(F.struct(F.lit(5).alias("c")).alias("b")).alias("a"))
    assert tuple(reshape.project(df, {"x": "a.b.c", "y": "a.q"}).first()) == (5, None)


RULES = [{"rule_id": "r1", "loinc": "k", "direction": "high", "statement": "s", "url": "u"}]
FACTS = {"value": 42.0, "reference": {"high": 5.0}, "unit": "g"}


@pytest.mark.parametrize(
    "change, ok",
    [({}, True), ({"rule_id": "zz"}, False), ({"facts": ["value: 1"]}, False), ({"plan": "see https://x.org"}, False), ({"plan": "give 2.5"}, False), ({"plan": "from 42 down"}, False), ({"plan": "in 3 days"}, True), ({"facts": ["VALUE:  42.0", "bogus: 1"]}, True)],
)
def test_advice_is_let_through_only_if_backed(change, ok):
    got = advisory.check({"rule_id": "r1", "facts": ["unit: g"], "assessment": "high", "plan": "repeat"} | change, FACTS, RULES)
    assert got["verified"] is ok and bool(got["reasons"]) is not ok


def test_replies():
    assert records.parse_reply('so:\n```json\n{"a": "}", "b": [1]}\n``` bye') == {"a": "}", "b": [1]}
    with pytest.raises(ValueError):
        records.parse_reply("none")
    assert records.answer_errors({"answer": [{"text": "x", "source": {"documentId": "d", "range": [0, 3]}}], "followUpQuestions": []}) == []
    assert len(records.answer_errors({"answer": [{"text": ""}], "followUpQuestions": [1]})) == 2
    assert records.theme_errors({"theme": "a", "confidence": 2, "rationale": ""}, {"a"}) == ["confidence is not from 0 to 1", "no rationale"]
    assert records.row_texts([{"question": "q", "anchors": ["a", " "], "variants": None}]) == ["q", "a"]
    assert records.deep_assign({"a": {"b": 1}}, {"a": {"c": 2}}) == {"a": {"b": 1, "c": 2}}


def test_retry_and_rate():
    seen = []

    def call(errors):
        seen.append(list(errors))
        return len(seen)

    assert records.with_retry(call, lambda n: [] if n == 2 else ["no"]) == 2 and seen == [[], ["no"]]
    assert records.with_retry(lambda e: 0, lambda n: ["bad"], fallback=lambda e: e) == ["bad"]
    now = [0.0]
    limit = records.RateLimit(2, 1, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(3):
        limit.take()
    assert now[0] == pytest.approx(1.0)


def test_queue_handles_each_item_once(spark, tmp_path):
    from lakeweave.streaming import queue

    folder = str(tmp_path / "q")
    for i in range(3):
        queue.enqueue(folder, {"n": i})
    handle = lambda df: df.withColumn("ok", F.get_json_object("payload", "$.n") != "1")
    for _ in range(4):
        queue.run(spark, folder, str(tmp_path / "c"), str(tmp_path / "dead"), str(tmp_path / "done"), handle, most=2).awaitTermination()
    done = [json.loads(r.payload)["n"] for r in spark.read.schema(queue.ITEM).option("recursiveFileLookup", True).json(str(tmp_path / "done")).collect()]
    dead = spark.read.schema(queue.ITEM).option("recursiveFileLookup", True).json(str(tmp_path / "dead")).collect()
    assert sorted(done) == [0, 2] and [(json.loads(r.payload)["n"], r.retries) for r in dead] == [(1, 2)]


def test_migration_is_dealt_before_it_is_grouped(spark):
    """No task sorts what it reads, both sides are grouped at once, and null keys equal nothing."""
    schema = "k long, value double, reference string, at int"
    s = spark.createDataFrame([(1, 1.0, "a", 1), (1, 2.0, "a", 2), (2, 5.0, "b", 1), (None, 1.0, "n", 1)], schema)
    t = spark.createDataFrame([(1, 2.0, "a", 1), (2, 6.0, "c", 1), (3, 1.0, "d", 1), (None, 1.0, "n", 1)], schema)
    both = migrate.compare(s, t, "k", ["value", "reference"], "at")
    got = sorted((r.k or 0, r.state, r.fields, r.s_rows, r.t_rows) for r in both.collect())
    assert got == [(0, "added", [], None, 1), (0, "dropped", [], 1, None), (1, "both", [], 2, 1), (2, "both", ["value", "reference"], 1, 1), (3, "added", [], None, 1)]
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.index("Aggregate") < plan.index("RepartitionByExpression")


def test_loose_equality_squeezes_each_side_once(spark):
    rows = [(0, " 7", "7.0"), (1, "1 000", "1,000.0"), (2, "a b", "ab"), (3, "﻿", None), (4, None, "x"), (5, "1e999", "1e998"), (6, " x　", "x"), (7, "7", "8")]
    df = spark.createDataFrame(rows, "i int, a string, b string").select("i", cells.eq_norm(F.col("a"), F.col("b")).alias("same"))
    assert [r.same for r in df.orderBy("i").collect()] == [True, True, True, True, False, False, True, False]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 2 and plan.count("RLIKE") == 2 and "regexp_replace" not in plan
