"""From markdown to section vectors, and from a question to an answer: the chains around retrieval, models injected."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import query, segment, text
from ..functions.records import answer_errors, parse_reply, row_texts, theme_errors, with_retry
from . import retrieval

Embed = Callable[[list[str]], np.ndarray]


def hash_embed(texts: list[str], dim: int = 64) -> np.ndarray:
    """Unit vectors of hashed words: stands in for a model where there is none."""
    out = np.zeros((len(texts), dim), dtype=np.float32)
    words = [t.lower().split() for t in texts]
    kinds = {w: n for n, w in enumerate(dict.fromkeys(w for own in words for w in own))}
    h = np.fromiter((zlib.crc32(w.strip(".,;:!?").encode()) for w in kinds), np.int64, len(kinds))
    if len(kinds):
        at = np.fromiter((kinds[w] for own in words for w in own), np.int64)
        row = np.repeat(np.arange(len(texts)), [len(own) for own in words])
        signs = np.where(h >> 16 & 1, 1.0, -1.0)[at]
        out[:] = np.bincount(row * dim + (h % dim)[at], signs, len(texts) * dim).reshape(len(texts), dim)
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n > 0, n, 1)


#: Texts that a model is given at a time.
TEXTS = 1_000


def with_vectors(df: DataFrame, column: str, embed: Embed = hash_embed, name: str = "vector") -> DataFrame:
    """Adds a text column's vectors, a batch at a time on the executors."""

    def made(texts: pa.Array) -> pa.Array:
        out = np.asarray(embed(texts.fill_null("").to_pylist()), dtype=np.float32)
        width = out.shape[1] if out.ndim == 2 else 0
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * width), pa.array(out.reshape(-1)))

    @F.arrow_udf("array<float>")
    def run(s: pa.Array) -> pa.Array:
        if not len(s):
            return pa.array([], pa.list_(pa.float32()))
        return pa.concat_arrays([made(s.slice(a, TEXTS)) for a in range(0, len(s), TEXTS)])

    return df.withColumn(name, run(column))


def build(docs: DataFrame, embed: Embed = hash_embed, augment: Callable[[str], str] | None = None) -> DataFrame:
    """(document_id, section, range_start, range_end, vec, text, vector): each section's chunks, and what a model adds to them, embedded.

    ``augment`` answers a section's text with JSON rows {question, anchors, variants}; a reply that cannot be read adds nothing.
    """
    rows = segment.chunk_table(docs).select("document_id", "section", F.col("chunk").alias("vec"), "text", "range_start", "range_end")
    if augment:

        @F.pandas_udf("array<string>")
        def more(s: pd.Series) -> pd.Series:
            def one(t):
                try:
                    return row_texts(parse_reply(augment(t)))
                except ValueError:
                    return []

            return s.map(one)

        first = rows.filter("vec = 0").select("document_id", "section", F.posexplode(more("text")).alias("vec", "text"), "range_start", "range_end")
        rows = rows.unionByName(first.withColumn("vec", F.col("vec") + 1_000))
    return with_vectors(rows, "text", embed).select("document_id", "section", "vec", "text", "vector", "range_start", "range_end")


def generate(sources: DataFrame, write: Callable[[str], str], classify: Callable[[str, list[str]], dict], themes: set[str], attempts: int = 3) -> DataFrame:
    """(source, file, theme, markdown, error) of raw texts: written by a model, named by its title, put under a theme by another; both are asked again with what was wrong."""

    @F.pandas_udf("markdown string, theme string, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for t in s:
            try:
                made = with_retry(lambda told, t=t: write(t), lambda m: [] if m.lstrip().startswith(("# ", "```")) else ["no title"], attempts)
                theme = with_retry(lambda told, m=made: classify(m, told), lambda v: theme_errors(v, themes), attempts)["theme"]
                out.append((made, theme, None))
            except ValueError as e:
                out.append((None, None, str(e)))
        return pd.DataFrame(out, columns=["markdown", "theme", "error"])

    made = sources.select("source", run("text").alias("m")).select("source", text.without_fences(F.col("m.markdown")).alias("markdown"), "m.theme", "m.error")
    return made.select("source", text.file_name(F.col("markdown")).alias("file"), "theme", "markdown", "error")


#: More than a text has parts: a part's id is its question's times this and its place.
PARTS = 1 << 20


def ask(queries: DataFrame, vectors: DataFrame, docs: DataFrame, embed: Embed = hash_embed, settings: retrieval.Settings = retrieval.Settings(), labels: DataFrame | None = None) -> DataFrame:
    """(query_id, place, document_id, section, score, section_text): what each question's parts find, united, with text; twelve at most a question.

    Bare greetings find nothing. ``labels``: (query_id, part, label, score) of parts; surely small talk is not searched.
    """
    parts = query.analyze(queries).select("query_id", F.posexplode("segments").alias("part", "segment")).filter("segment <> ''")
    if labels is not None:
        parts = retrieval.searchable(parts.join(labels, ["query_id", "part"], "left").fillna({"label": "", "score": 0.0})).select("query_id", "part", "segment")
    asked = with_vectors(parts, "segment", embed, "query").withColumn("part_id", F.col("query_id") * PARTS + F.col("part"))
    hits = retrieval.search(vectors.select("document_id", "section", "vec", "vector"), asked.select(F.col("part_id").alias("query_id"), "query"), settings)
    own = hits.withColumn("query_id", F.shiftright("query_id", 20)).groupBy("query_id", "document_id", "section").agg(F.max("score").alias("score"))
    ranges = vectors.select("document_id", F.col("section").cast("long").alias("section"), "range_start", "range_end").distinct()
    found = retrieval.with_text(own.join(ranges, ["document_id", "section"]), docs)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "section")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= settings.largest).select("query_id", "place", "document_id", "section", "score", "section_text")


def answers(queries: DataFrame, found: DataFrame, model: Callable[[str, list[str]], str], attempts: int = 3) -> DataFrame:
    """(query_id, kind, answer): greeting for a bare greeting, answer for a reply of the right shape, fallback with the best section otherwise."""
    known = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "section_text"))).alias("hits"))  # twelve at most
    rows = query.analyze(queries).join(known, "query_id", "left").select("query_id", "query", "greeting", "segments", F.concat_ws("\n", F.transform("hits", lambda h: h["section_text"])).alias("context"))

    @F.pandas_udf("kind string, answer string")
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import json

        out = []
        for row in pdf.to_dict("records"):
            if row["greeting"] and not len(row["segments"]):
                out.append(("greeting", None))
                continue
            prompt = f"{row['query']}\n\n{row['context'] or ''}"
            got = with_retry(lambda told, p=prompt: parse_reply(model(p, told)), answer_errors, attempts, lambda errors: None)
            out.append(("answer", json.dumps(got)) if got else ("fallback", (row["context"] or "").split("\n")[0]))
        return pd.DataFrame(out, columns=["kind", "answer"])

    return rows.select("query_id", run(F.struct("query", "greeting", "segments", "context")).alias("a")).select("query_id", "a.kind", "a.answer")
