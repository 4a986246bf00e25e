"""Retrieval, segmentation and query analysis."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeweave.functions import query, segment, text, vectors
from lakeweave.operators import retrieval
from lakeweave.plans import registry


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_effective_counts():
    assert vectors.entropy_count(np.array([1.0, 1.0, 1.0])) == 3
    assert vectors.entropy_count(np.array([1.0, 1e-6])) == 2 and vectors.entropy_count(np.array([])) == 0
    assert vectors.ratio_count(np.array([9.0, 8.0, 2.0, 1.9])) == 2
    assert vectors.ratio_count(np.array([3.0, 2.9, 2.8])) == 3
    assert vectors.ratio_count(np.array([1.0])) == 1
    assert vectors.ratio_count(np.array([9.0, 3.0, 1.0])) == 1  # the earlier of equal falls


def corpus(spark, rows):
    return spark.createDataFrame(rows, "document_id string, section long, vec int, vector array<float>")


def test_scores_take_the_best_vector_of_a_section(spark):
    c = corpus(spark, [("d", 0, 0, [1.0, 0.0]), ("d", 0, 1, [0.0, 1.0]), ("d", 1, 0, [0.6, 0.8]), ("e", 0, 0, [-1.0, 0.0])])
    q = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, query array<float>")
    got = {(r.document_id, r.section): (round(r.score, 6), list(r.best_vec)) for r in retrieval.scores(c, q).collect()}
    assert got == {("d", 0): (1.0, [0.0, 1.0]), ("d", 1): (0.8, [0.6000000238418579, 0.800000011920929])}


def test_search_keeps_three_at_least_and_twelve_at_most(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    c = corpus(spark, [("d", i, 0, x.tolist()) for i, x in enumerate(v)])
    q = spark.createDataFrame([(7, v[0].tolist())], "query_id long, query array<float>")
    got = retrieval.search(c, q).orderBy("rank").collect()
    assert 3 <= len(got) <= 12 and got[0].section == 0 and [r.rank for r in got] == list(range(1, len(got) + 1))
    assert retrieval.search(c, q, retrieval.Settings(max_rows=2)).count() == 2
    far = spark.createDataFrame([(8, [0.0] * 8)], "query_id long, query array<float>")
    assert retrieval.search(c, far).count() == 0


def test_rerank_is_skipped_when_the_query_and_its_hits_disagree():
    q, v = np.array([1.0, 0.0, 0.0, 0.0]), np.eye(4)
    kept, own, skipped = retrieval.rerank(q, v, v @ q, [0, 1])
    assert skipped and kept == [0, 1]


def test_rails():
    assert retrieval.rails([1], [1, 2, 3, 4]) == [1, 2, 3] and len(retrieval.rails(list(range(20)), [])) == 12


def test_principal_direction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)) * [5, 1, 0.5]
    w = vectors.first_component(x)
    assert abs(w[0]) > 0.98


def test_text_functions(spark):
    assert one(spark, text.medication, "Metformin HCl 500 mg (Glucophage) daily", None) == ["metformin", None]
    assert one(spark, text.medication_aliases, "tiotropium (Spiriva)") == [["spiriva", "tiotropium"]]
    assert one(spark, text.collapse_punctuation, "what???!! no,,, way", "a?!") == ["what? no, way", "a?"]
    assert one(spark, text.file_name, "x\n# The *Big* One  \ny", "none") == ["the_big_one.md", None]
    assert one(spark, text.plain, "a [link](http://x) **b**") == ["a link b"]
    assert one(spark, text.without_fences, "```json\n{}\n```") == ["{}"]
    assert one(spark, lambda c: text.cut_at_word(c, 8), "abc_defg_hij", "short") == ["abc", "short"]
    assert one(spark, text.token_estimate, "abcd", "", "a b!") == [1, 0, 2]
    assert one(spark, text.normalize_punctuation, "“a” – b…") == ['"a" - b...']


@pytest.mark.parametrize("q, several", [("what is it? why?", True), ("explain a and describe b", True), ("what is it", False), ("thanks!!!", False), ("Hello! What is biofilm?", True), ("thanks for explaining it", False), ("L. pneumophila is dangerous", False), ("it builds there. explain how", True), ("do a, also b", True)])
def test_multi_part(spark, q, several):
    assert one(spark, query.multi_part, q) == [several]


def test_greetings(spark):
    assert one(spark, query.without_greeting, "Hello! where?", "thanks for it", "thanks!!", "it works. Thank you!", "one. thanks. two.", "") == ["where?", "thanks for it", "", "it works.", "one. two.", ""]


def test_parts(spark):
    got = one(spark, query.parts, "What is it? Why! ok", "Ask Dr. Brown now", "It builds there. Explain how", "a is b, also c", "tell me x and why y", "")
    assert got == [["What is it?", "Why!", "ok"], ["Ask Dr. Brown now"], ["It builds there.", "Explain how"], ["a is b,", "also c"], ["tell me x", "why y"], []]


def test_frustration(spark):
    got = one(spark, lambda c: F.round(query.frustration(c)["score"], 4), "fine", "WHY IS THIS", "what???", "do it right now", "damn", "bullshit", None)
    assert got == [0.0, 0.25, 0.04, 0.125, 0.24, 0.5, 0.0]


def test_spelling(spark):
    assert one(spark, lambda c: query.corrected(c, {"teh": "the"}), "Teh end, teh") == ["the end, the"]
    words = spark.createDataFrame([("helo",), ("zzzzzz",), ("word",)], "word string")
    entries = spark.createDataFrame([("hello",), ("word",), ("help",)], "entry string")
    assert {r.word: r.suggestion for r in query.suggest(words, entries).collect()} == {"helo": "hello", "zzzzzz": "zzzzzz", "word": "word"}


TEXT = "# Title\n\nFirst one. See v1.2 of e.g. x.md here. Done!\n\nSecond par.\n\n## Sub\n\nInner text.\n\n# Next\nLast"


@pytest.mark.parametrize("text", ["a" * 200_000, "a-" * 100_000, "." * 200_000, "a@" * 100_000, "1." * 100_000, "\n" * 200_000, "One two.\n\n" * 20_000])
def test_segmentation_of_very_long_words_and_texts_is_linear(text):
    start = time.time()
    found = segment.content(segment.sections(text))
    masked, kept = segment.protect_dots(text)
    assert segment.restore(masked, kept) == text and time.time() - start < 20
    assert [c["paragraph"] for c in found] == (list(range(20_000)) if text.startswith("One") else [None] * len(found))


def test_deep_sections():
    deep = "".join("1." * n + "1 Abc\n\nText here.\n\n" for n in range(1500))
    found = segment.content(segment.sections(deep))
    assert [len(c["ancestors"]) for c in found] == list(range(1, 1501)) and len(segment.sections(deep).flatten()) == 3000


def test_segments_and_sections():
    got = [(s.text(TEXT), s.level) for s in segment.segments(TEXT)]
    assert got == [("# Title", 1), ("First one.", 0), ("See v1.2 of e.g. x.md here.", 0), ("Done!", 0), ("Second par.", 0), ("## Sub", 2), ("Inner text.", 0), ("# Next", 1), ("Last", 0)]
    rows = [(TEXT[c["start"] : c["end"]], [TEXT[h.title : h.end] for h in c["ancestors"]], c["paragraph"]) for c in segment.content(segment.sections(TEXT))]
    assert rows == [("First one. See v1.2 of e.g. x.md here. Done!", ["Title"], 0), ("Second par.", ["Title"], 1), ("Inner text.", ["Title", "Sub"], None), ("Last", ["Next"], None)]
    masked, kept = segment.protect_dots("see www.a.b and J. K. at 1.5")
    assert segment.restore(masked, kept) == "see www.a.b and J. K. at 1.5" and "1.5" not in masked


def test_chunks_and_spans():
    assert segment.chunks("a b. c d.") == ["a b. c d."] and segment.chunks(" ") == []
    medium = " ".join(f"w{i} x yy zz." for i in range(60))
    assert all(len(c.split()) <= 80 for c in segment.chunks(medium)) and len(segment.chunks(medium)) == 3
    t = "the big dog, of course"
    assert [t[a:b] for a, b in segment.spans(t)] == ["big", "big dog", "dog", "course"]


def test_tables(spark):
    docs = spark.createDataFrame([("a", TEXT), ("b", None)], "document_id string, text string")
    assert segment.segment_table(docs).count() == 9 and segment.section_table(docs).count() == 4
    assert {r.breadcrumb for r in segment.chunk_table(docs).collect()} == {"Title", "Title > Sub", "Next"}


def test_analysis(spark):
    df = spark.createDataFrame([(1, "Hello! what is it?? Why?"), (2, "thanks"), (3, None)], "query_id int, query string")
    got = {r.query_id: (r.greeting, r.segments) for r in query.analyze(df).collect()}
    assert got == {1: (True, ["what is it?", "Why?"]), 2: (True, []), 3: (False, [])}


def test_searches_ask_every_hundredth_vector(spark, sf):
    asked = {0, 100, 200, 300, 400}
    for name in ("vector_search", "vector_search_pivot", "hit_suggestions", "position_changes", "vector_topk"):
        assert {r.query_id for r in registry.QUERIES[name](spark, sf).select("query_id").collect()} == asked, name


def test_scores_in_blocks_miss_no_pair(spark):
    r = random.Random(1)
    rows = [("d", i // 3, i % 3, [r.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    corpus = spark.createDataFrame(rows, "document_id string, section long, vec long, vector array<double>").repartition(3)
    asked = [(100 * i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(25)]
    scored = retrieval.scores(corpus, spark.createDataFrame(asked, "query_id long, query array<double>"), floor=None)
    assert "BroadcastNestedLoopJoin" not in scored._jdf.queryExecution().executedPlan().toString()
    want = {(q, s): max(sum(x * y for x, y in zip(v, w, strict=True)) for _, t, _, w in rows if t == s) for q, v in asked for s in range(20)}
    got = {(x.query_id, x.section): x.score for x in scored.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.fixture
def spoken(spark, tmp_path):
    """A folder of conversations whose signs stand late in their texts or in a turn of any number."""
    late = "the report of last week is still not there " * 4
    said = [(0, 0, late + "when is it done? And why so late?"), (0, 1, late + "hurry, damn!!! Thank you!"), (1, 2, "Hello! where is it"), (1, 3, late + "fine. Thanks."), (100, 0, late + "WHY IS THIS SO LATE,, AND WHO DOES IT?!"), (100, 2, None)]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in said], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path), {c * 1000 + t: x for c, t, x in said}


def test_questions_are_read_to_their_end_in_every_turn(spark, spoken):
    folder, said = spoken
    got = {r.query_id: r for r in registry.QUERIES["query_analysis"](spark, folder).collect()}
    assert {k: r.query for k, r in got.items()} == said
    assert [got[k].greeting for k in (0, 1, 1002, 1003, 100000, 100002)] == [False, True, True, True, False, False]
    assert got[0].segments[-2:] == [said[0][:-17].strip(), "And why so late?"] and got[1].frustration > 0.2 and got[1002].bare == "where is it"
    several = {r.query_id: r.several for r in registry.QUERIES["multi_part"](spark, folder).collect()}
    parts = Counter(r.query_id for r in registry.QUERIES["question_parts"](spark, folder).collect())
    assert (several[0], parts[0]) == (True, 2) and (several[1002], parts[1002]) == (True, 2) and (several[100002], parts[100002]) == (False, 0)


def test_question_hits_asks_whole_hundredth_conversations(spark, spoken):
    folder, _ = spoken
    body = "# Lateness\n\nwhy is this so late, and who does it. The report of last week is still not there. Thus why so late, and why.\n\n# Other\n\nA quite different thing is told about here, with other words in every line."
    spark.createDataFrame([(1, body)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = registry.QUERIES["question_hits"](spark, folder).collect()
    assert {r.query_id for r in got} == {0, 1, 100000}


def test_whole_texts_are_scored(spark, spoken):
    folder, said = spoken
    rows = lambda name, c: {r.query_id: r[c] for r in registry.QUERIES[name](spark, folder).collect()}
    bare = rows("greeting_peel", "bare")
    assert bare[1] == said[1][: -len(" Thank you!")] and bare[1002] == "where is it" and bare[1003] == said[1003][: -len(" Thanks.")] and bare[100002] == ""
    score = rows("frustration", "score")  # 0.2 for marks in excess by five, 0.25 for two urgent words, 0.4 for a heavy word
    assert score[0] == 0 and score[1] == round(0.2 * 2 / 5 + 0.25 / 2 + 0.4 * 0.6, 9) and score[100002] == 0
    assert rows("collapse_punctuation", "said")[100000] == said[100000].replace(",,", ",").replace("?!", "?")


def test_spelling_errors_are_put_right(spark, sf):
    names = {r.p_name for r in spark.read.parquet(f"{sf}/part.parquet").select("p_name").distinct().collect()}
    got = {r.word: r.suggestion for r in registry.QUERIES["spelling"](spark, sf).collect()}
    assert got.keys() == {w for n in names for w in (n[:1] + n[2:], n[:-2] + n[-2:][::-1])}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a.lower(), 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b.lower(), 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for word in sorted(got)[:40]:
        d, entry = min((edits(word, n), n) for n in names)
        assert got[word] == (entry if d <= 2 else word)
    assert any(w != s for w, s in got.items())


def test_searches_join_blocks_and_cut_each_query_where_pairs_are_made(spark):
    """Few rows cross, and tasks leave only what can be among the k best; ties, nulls, odd lengths and NaN as one by one."""
    r = np.random.default_rng(5)
    v = r.integers(-2, 3, size=(400, 6)).astype(float)  # many equal scores
    rows = [(f"d{i % 7}", i // 3, i % 3, x.tolist()) for i, x in enumerate(v)]
    rows += [("d9", 900, 0, None), ("d9", 901, 0, [1.0, None, 0.0, 0.0, 0.0, 0.0]), ("d9", 902, 0, [1.0, 2.0]), ("d9", 903, 0, [float("nan")] + [0.0] * 5), (None, 904, 0, v[0].tolist())]
    c = spark.createDataFrame(rows, "document_id string, section long, vec int, vector array<double>").repartition(3)
    asked = [(i, v[i].tolist()) for i in range(40)] + [(50, None), (51, [1.0, 1.0])]
    q = spark.createDataFrame(asked, "query_id long, query array<double>")

    def dot(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        s = 0.0
        for x, y in zip(a, b, strict=True):
            s += x * y
        return s

    rank = lambda s: (2, 0.0) if s is None else (0, 0.0) if s != s else (1, -s)
    for k, floor in ((5, None), (5, 3.0), (None, 3.0)):
        want = {}
        for i, a in asked:
            best = {}
            for d, s, n, b in rows:
                x = dot(a, b)
                if (d, s) not in best or rank(x) < rank(best[d, s][0]):
                    best[d, s] = (x, b)
            kept = [(key, *b) for key, b in best.items() if floor is None or b[0] is not None and (b[0] != b[0] or b[0] >= floor)]
            want |= {(i, n): row for n, row in enumerate(sorted(kept, key=lambda x: (rank(x[1]), x[0][0] is not None, x[0][0] or "", x[0][1]))[:k], 1)}
        found = retrieval.scores(c, q, floor, k)
        ranked = retrieval.top(found, k or 10_000).collect()
        got = {(x.query_id, x.rank): ((x.document_id, x.section), x.score, x.best_vec) for x in ranked}
        assert repr(sorted(got.items())) == repr(sorted(want.items())), (k, floor)
        if k:
            assert found.count() <= 64 * k * len(asked)
    joined = found._jdf.queryExecution().optimizedPlan().toString()
    assert "own#" in joined.split("Join")[0] and "transform" not in joined  # whole blocks cross, not rows


def test_analysis_reads_tokens_once_for_each_use(spark):
    """A value that several expressions are made of is bound to a name or a column: it stands in the plan once."""
    df = spark.createDataFrame([(1, "Hello! what is it?? Why? right now, fine")], "query_id int, query string")
    plan = query.analyze(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(\\s*(?:\\w+|[^\\w\\s]))") == 2  # of the signs of several questions, and of the parts
    assert plan.count("(?:as soon as possible)") == 2  # counted, and taken out
    got = one(spark, lambda c: query.frustration(c)["score"], "NOW? asap, right now", "snow")
    assert got == [0.25, 0.0]


def test_segments_are_handed_on_in_small_frames():
    """A worker holds the rows of a text or less, not those of a whole batch."""
    import pyarrow as pa

    class Docs:
        def selectExpr(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    batch = pa.RecordBatch.from_pydict({"document_id": ["a", "b", None], "text": ["One two. " * 20_000, None, "# T\n\nx y. Z."]})
    for table, n in ((segment.segment_table, 20_002), (segment.section_table, 2), (segment.chunk_table, 20_001)):
        frames = list(table(Docs())(iter([batch])))
        assert sum(f.num_rows for f in frames) == n and max(f.num_rows for f in frames) <= 8192


def test_sections_and_their_ranges_are_made_in_one_pass(spark):
    docs = spark.createDataFrame([("a", TEXT), ("b", None)], "document_id string, text string")
    from lakeweave.operators import corpus

    built = corpus.build(docs)
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    rows = {(r.document_id, r.section): (r.range_start, r.range_end) for r in built.collect()}
    assert rows == {(r.document_id, r.section): (r.start, r.end) for r in segment.section_table(docs).collect()}
