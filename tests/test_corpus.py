"""Chains around retrieval, with models that are plain functions."""

import json

import numpy as np

from lakeweave.operators import corpus

DOCS = [("a|cats", "# Cats\n\nCats purr softly at night.\n\n## Food\n\nFish is what cats like best."), ("a|dogs", "# Dogs\n\nDogs bark loudly at strangers.")]


def docs(spark):
    return spark.createDataFrame(DOCS, "document_id string, text string")


def test_sections_are_found_again(spark):
    vectors = corpus.build(docs(spark))
    assert vectors.count() == 3 and np.isclose(np.linalg.norm(vectors.first().vector), 1)
    q = spark.createDataFrame([(1, "Hello! what do dogs bark at? Fish is what cats like best"), (2, "thanks")], "query_id long, query string")
    found = corpus.ask(q, vectors, docs(spark)).collect()
    assert {r.query_id for r in found} == {1} and {"Dogs bark loudly at strangers.", "Fish is what cats like best."} <= {r.section_text for r in found}
    good = {"answer": [{"text": "strangers"}], "followUpQuestions": []}
    turns = corpus.answers(q, corpus.ask(q, vectors, docs(spark)), lambda prompt, told: json.dumps(good) if told else "no json")
    got = {r.query_id: (r.kind, r.answer) for r in turns.collect()}
    assert got[2] == ("greeting", None) and got[1][0] == "answer" and json.loads(got[1][1]) == good
    bad = {r.query_id: r.kind for r in corpus.answers(q, corpus.ask(q, vectors, docs(spark)), lambda prompt, told: "never").collect()}
    assert bad == {1: "fallback", 2: "greeting"}


def test_augmented_rows_are_embedded_too(spark):
    reply = 'sure: [{"question": "who purrs?", "anchors": ["purring"], "variants": []}]'
    assert corpus.build(docs(spark), augment=lambda t: reply).count() == 9
    assert corpus.build(docs(spark), augment=lambda t: "nothing").count() == 3


def test_generated_markdown(spark):
    raw = spark.createDataFrame([("s1", "cats"), ("s2", "bad")], "source string, text string")
    write = lambda t: f"```markdown\n# About {t}\n\nx\n```" if t == "cats" else "untitled"
    classify = lambda m, told: {"theme": "pets", "confidence": 0.9, "rationale": "r"} if told else {"theme": "none"}
    got = {r.source: (r.file, r.theme, r.error) for r in corpus.generate(raw, write, classify, {"pets"}).collect()}
    assert got == {"s1": ("about_cats.md", "pets", None), "s2": (None, None, "no title")}
