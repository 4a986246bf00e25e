"""Vector retrieval: scores, best sections, adaptive pruning, pivots, rerank, rails and unions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.vectors import entropy_count, ratio_count
from . import pairs

#: Least number of parts into which each side of a search is dealt; each part meets each of the other side in a task of its own.
BLOCKS = 8


@dataclass(frozen=True)
class Settings:
    """Fixed values of a search, each of which a caller may change."""

    floor: float = 0.3
    gap: float = 1.5
    candidates: int = 30
    smallest: int = 3
    largest: int = 12
    pivot: bool = False
    pivot_at_most: int = 5
    pivot_score: float = 0.7
    pivot_rows: int = 10
    rerank: bool = True
    weak_share: float = 0.5
    extension: int = 12
    extension_ratio: float = 0.7
    max_rows: int | None = None


def scores(corpus: DataFrame, queries: DataFrame, floor: float | None = 0.3, k: int | None = None, vectors: bool = True) -> DataFrame:
    """(query_id, document_id, section, score, best_vec): of each section its vector nearest to the query, the first of equal ones.

    ``corpus``: (document_id, section, vec, vector). ``queries``: (query_id, query), any number: both sides are packed into
    blocks of about a MB, one row each, and only blocks are joined; they are never broadcast. With ``k``, each task leaves
    out what cannot be among a query's k best, so that few pairs leave it. ``vectors``: whether best_vec is wanted.
    """
    side = max(BLOCKS, math.isqrt(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    own = corpus.select("document_id", "section", "vec", "vector").repartition("document_id", "section").sortWithinPartitions("document_id", "section", F.asc_nulls_last("vec"), F.desc("vector"))
    asked = queries.select("query_id", "query")
    left = own.mapInArrow(pairs.packed(["document_id", "section"]), "name string, data binary").select(F.col("data").alias("own")).repartition(side)
    right = asked.repartition(side).mapInArrow(pairs.packed([]), "name string, data binary").select("name", F.col("data").alias("asked")).repartition(side)
    of = lambda df, name, to: StructField(to, df.schema[name].dataType)
    schema = StructType([of(asked, "query_id", "query_id"), of(own, "document_id", "document_id"), of(own, "section", "section"), StructField("score", DoubleType()), *([of(own, "vector", "best_vec")] if vectors else [])])
    return left.join(right.hint("shuffle_replicate_nl")).mapInArrow(pairs.scored(floor, k, vectors), schema)


def top(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best of each query with rank; ties by document and section. Tasks cut their own rows to k before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "document_id", "section")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(corpus: DataFrame, queries: DataFrame, k: int, floor: float | None = 0.3, vectors: bool = False) -> DataFrame:
    """The k best sections of each query with rank, of those that reach the floor."""
    return top(scores(corpus, queries, floor, k, vectors), k)


def entropy_counts(scored: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, n, k): effective count of each query's positive scores by entropy, as one aggregation."""
    s, v = F.sum("score"), F.sum(F.col("score") * F.log("score"))
    return scored.filter("score > 0").groupBy(by).agg(F.count("*").alias("n"), F.ceil(F.exp(F.log(s) - v / s) - 1e-9).cast("long").alias("k")).withColumn("k", F.greatest(F.lit(1), F.least("k", "n")))


def cliffs(ranked: DataFrame, gap: float = 1.5, by: str = "query_id") -> DataFrame:
    """(by, k): rows before the steepest ratio of neighbouring scores, all rows if it is under ``gap``."""
    w = Window.partitionBy(by).orderBy("rank")
    fall = ranked.withColumn("fall", F.try_divide(F.lag("score").over(w), F.when(F.col("score") > 0, F.col("score"))))
    steepest = fall.groupBy(by).agg(F.max_by(F.struct("fall", F.col("rank").alias("at")), F.struct("fall", -F.col("rank"))).alias("c"), F.max("rank").alias("n"))
    return steepest.select(by, F.when(F.col("c.fall") >= gap, F.col("c.at") - 1).otherwise(F.col("n")).cast("long").alias("k"))


def prune_count(own: np.ndarray, s: Settings = Settings()) -> int:
    """Rows to keep of descending scores: the entropy count, or the cliff within it."""
    k = entropy_count(own, s.candidates)
    return min(k, ratio_count(own, s.gap, cap=k)) if k else 0


def rerank(query: np.ndarray, vectors: np.ndarray, own: np.ndarray, kept: list[int], s: Settings = Settings()) -> tuple[list[int], np.ndarray, bool]:
    """(rows in their new order, all scores, skipped): candidates and what is nearly as good, scored on the dimensions in which the query and their centroid agree."""
    centroid = vectors[kept].mean(axis=0)
    w = np.maximum(query * centroid, 0)
    if int((w <= 0).sum()) >= int(len(query) * s.weak_share):
        return kept, own, True
    limit = own[kept[-1]] * s.extension_ratio
    inside = set(kept)
    more = [i for i in np.argsort(-own, kind="stable").tolist() if i not in inside and own[i] >= limit][: s.extension]
    rows = kept + more
    weighted = vectors[rows] * w
    length = np.linalg.norm(weighted, axis=1)
    new = own.copy()
    new[rows] = np.where(length > 0, weighted @ query / np.where(length > 0, length, 1), 0)
    order = [rows[i] for i in np.argsort(-new[rows], kind="stable")]
    return order[: max(prune_count(new[order], s), 0)], new, False


def rails(kept: list, snapshot: list, s: Settings = Settings()) -> list:
    """At least ``smallest`` rows, else the snapshot's best; at most ``largest``."""
    return (snapshot[: s.smallest] if len(kept) < s.smallest else kept)[: s.largest]


def refine(own: np.ndarray, vectors: np.ndarray, query: np.ndarray, s: Settings = Settings()) -> tuple[list[int], np.ndarray, dict]:
    """Rows of a query's hits, sorted by score, that a search returns; their scores; and the counts of each stage."""
    everything = list(range(len(own)))
    kept = everything[: prune_count(own, s)] or everything[: s.smallest]
    trace = {"scored": len(own), "pruned": len(kept)}
    new, skipped = own, True
    snapshot = everything
    if s.rerank and kept:
        before = kept
        kept, new, skipped = rerank(query, vectors, own, kept, s)
        snapshot = before if skipped else everything
    out = rails(kept, snapshot, s)
    restored = len(kept) < s.smallest
    trace |= {"reranked": 0 if skipped else len(kept), "out": len(out)}
    return out[: s.max_rows], (own if restored else new), trace


HITS = "query_id long, rank int, document_id string, section long, score double"


def candidates(corpus: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """What a search starts from: each query's best sections with rank and vector, as many as some stage can use."""
    return nearest(corpus, queries, settings.candidates + settings.extension, settings.floor, vectors=True)


def search(corpus: DataFrame, queries: DataFrame, settings: Settings = Settings(), best: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, document_id, section, score) of each query by the whole chain.

    Scoring is distributed; a query's best few dozen sections are then pruned, reranked and railed by one call a query.
    Only rows that some stage can use are kept: candidates, and those that extend them for the rerank. ``best``: the
    candidates, where a caller has them.
    """
    s = settings
    need = s.candidates + s.extension
    best = candidates(corpus, queries, s) if best is None else best
    if s.pivot:
        best = top(with_pivots(best, corpus, s), need)
    q = queries.select("query_id", "query")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        own, v = pdf["score"].to_numpy(), np.stack(pdf["best_vec"].to_numpy()).astype(np.float64)
        rows, new, _ = refine(own, v, np.asarray(pdf["query"].iloc[0], dtype=np.float64), s)
        out = pdf.iloc[rows][["query_id", "document_id", "section"]].copy()
        out["score"] = new[rows]
        out["rank"] = np.arange(1, len(rows) + 1)
        return out[["query_id", "rank", "document_id", "section", "score"]]

    typed = best.withColumns({"document_id": F.col("document_id").cast("string"), "section": F.col("section").cast("long"), "query_id": F.col("query_id").cast("long")})
    return typed.join(q.withColumn("query_id", F.col("query_id").cast("long")), "query_id").groupBy("query_id").applyInPandas(run, HITS)


def with_pivots(best: DataFrame, corpus: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Hits and, for queries with few but good ones, what is nearest to their best hit: its score times that hit's."""
    w = Window.partitionBy("query_id")
    anchor = best.withColumn("n", F.count("*").over(w)).filter((F.col("rank") == 1) & (F.col("n") <= s.pivot_at_most) & (F.col("score") >= s.pivot_score))
    again = nearest(corpus, anchor.select("query_id", F.col("best_vec").alias("query")), s.pivot_rows, s.floor, vectors=True)
    scaled = again.join(anchor.select("query_id", F.col("score").alias("by")), "query_id").withColumn("score", F.col("score") * F.col("by")).drop("by")
    fresh = scaled.join(best.select("query_id", "document_id", "section"), ["query_id", "document_id", "section"], "left_anti")
    return best.drop("rank").unionByName(fresh.drop("rank"))


def union_hits(hits: DataFrame) -> DataFrame:
    """Hits of several parts of a question: each section once with its best score."""
    return hits.groupBy("document_id", "section").agg(F.max("score").alias("score"))


def statistics(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """(n, least, most, mean, stddev, entropy, label) of each query's scores: peaky under half of the greatest entropy, flat from 0.85."""
    total = hits.groupBy(by).agg(F.sum("score").alias("s"))
    p = F.col("score") / F.col("s")
    sums = hits.join(total, by).groupBy(by).agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("stddev"), F.coalesce(-F.sum(F.when(p > 0, p * F.log2(p))), F.lit(0.0)).alias("entropy"))
    share = F.coalesce(F.try_divide(F.col("entropy"), F.log2("n")), F.lit(0.0))
    return sums.withColumn("label", F.when(share < 0.5, "peaky").when(share < 0.85, "moderate").otherwise("flat"))


def suggestions(ranked: DataFrame, by: str = "query_id") -> DataFrame:
    """(knee, first_by_second, label, above_sigma, above_mean): where else a query's hits might be cut."""
    w = Window.partitionBy(by)
    row = ranked.withColumns({"drop": F.col("score") - F.lead("score").over(w.orderBy("rank")), "mean": F.avg("score").over(w), "sd": F.stddev_pop("score").over(w)})
    sums = row.groupBy(by).agg(F.max_by("rank", F.struct("drop", -F.col("rank"))).alias("at"), F.max("drop").alias("fall"), F.max("score").alias("first"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.count_if(F.col("score") >= F.col("mean") + F.col("sd")).alias("above_sigma"), F.count_if(F.col("score") >= F.col("mean")).alias("above_mean"))
    ratio = F.try_divide("first", F.when(F.col("second") > 0, F.col("second")))
    return sums.select(by, F.when(F.col("fall") >= 0.1 * F.col("first"), F.col("at")).alias("knee"), ratio.alias("first_by_second"), F.when(ratio.isNull() | (ratio >= 1.5), "clear winner").when(ratio >= 1.2, "moderate winner").otherwise("no dominant winner").alias("label"), "above_sigma", "above_mean")


def position_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, before, after, change) of hits in both orders."""
    return before.select(*keys, F.col("rank").alias("before")).join(after.select(*keys, F.col("rank").alias("after")), keys).withColumn("change", F.col("before") - F.col("after"))


def centroid(vectors: DataFrame, by: str, column: str = "vector") -> DataFrame:
    """(by, centroid): element-wise mean."""
    each = vectors.select(by, F.posexplode(column).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("x"))
    return each.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centroid"))


def offsets(sections: DataFrame) -> DataFrame:
    """(document_id, section, count, offset): where each section's vectors start within its document."""
    w = Window.partitionBy("document_id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    return sections.withColumn("offset", F.coalesce(F.sum("count").over(w), F.lit(0)))


def with_text(hits: DataFrame, texts: DataFrame, start: str = "range_start", end: str = "range_end") -> DataFrame:
    """Hits with the text of their range; those whose document or range is not there fall away."""
    a, b = F.col(start), F.col(end)
    cut = F.when((a >= 0) & (b > a) & (b <= F.length("text")), F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    return hits.join(texts.select("document_id", "text"), "document_id").withColumn("section_text", cut).filter("section_text is not null").drop("text")


def searchable(segments: DataFrame) -> DataFrame:
    """All but what is surely small talk."""
    return segments.filter(~((F.col("label") == "CONVERSATIONAL") & (F.col("score") >= 0.7)))


def anchor_labels(queries: DataFrame, anchors: DataFrame, margin: float = 0.1, least: float = 0.4) -> DataFrame:
    """(query_id, label, score, low_confidence): the class of the nearest anchor; TECHNICAL wins within ``margin``.

    ``anchors``: (label, anchor), a fixed list of examples. Low confidence: the two best classes are within ``margin``,
    or none reaches ``least``.
    """
    from ..functions.vectors import cosine

    best = queries.join(F.broadcast(anchors)).groupBy("query_id", "label").agg(F.max(cosine(F.col("query"), F.col("anchor"))).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "label")
    row = best.withColumns({"n": F.row_number().over(w), "top": F.max("score").over(Window.partitionBy("query_id")), "tech": F.max(F.when(F.col("label") == "TECHNICAL", F.col("score"))).over(Window.partitionBy("query_id")), "second": F.lead("score").over(w)}).filter("n = 1")
    tech = F.coalesce(F.col("tech") >= F.col("top") - margin, F.lit(False))
    return row.select("query_id", F.when(tech, "TECHNICAL").otherwise(F.col("label")).alias("label"), F.when(tech, F.col("tech")).otherwise(F.col("score")).alias("score"), (F.coalesce(F.col("top") - F.col("second") < margin, F.lit(False)) | (F.col("top") < least)).alias("low_confidence"))
