"""Vector arithmetic as column expressions, and the small dense kernels in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """In double precision; null if the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """The dot product by both norms; the dot product itself where a norm is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), dot(a, b))


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def normalize(a: Column) -> Column:
    """Of length one; a zero vector stays zeros."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def similarity(a: Column, b: Column, kind: str = "cosine") -> Column:
    return {"cosine": cosine, "dot": dot}[kind](a, b)


def entropy_count(scores: np.ndarray, cap: int | None = None) -> int:
    """Effective number of scores: e to their entropy, rounded up, over the positive head; 0 without one."""
    own = np.asarray(scores, dtype=np.float64)[: cap or len(scores)]
    stop = np.flatnonzero(own <= 0)
    own = own[: stop[0]] if len(stop) else own
    if not len(own):
        return 0
    s = own.sum()
    return int(np.clip(np.ceil(np.exp(np.log(s) - (own * np.log(own)).sum() / s) - 1e-9), 1, len(own)))


def ratio_count(scores: np.ndarray, gap: float = 3.0, eps: float = 1e-10, cap: int | None = None) -> int:
    """How many scores stand before the steepest fall by ``gap`` times or more (the first of equal ones), or before the noise floor."""
    own = np.asarray(scores, dtype=np.float64)
    if len(own) < 2:
        return len(own)
    limit = max(1, min(cap or len(own), len(own)))
    quiet = np.flatnonzero(own[:limit] <= eps)
    last = max(1, int(quiet[0])) if len(quiet) else limit
    with np.errstate(divide="ignore", invalid="ignore"):
        falls = own[: min(last, limit - 1)] / own[1 : min(last, limit - 1) + 1]
    if len(falls) and (k := int(np.argmax(falls))) >= 0 and falls[k] >= gap:
        return min(k + 1, last + (last < limit))
    return max(1, min(last, limit))


def entropy_threshold(values: np.ndarray) -> float:
    """The smallest of the values that the entropy count keeps."""
    own = np.sort(np.asarray(values, dtype=np.float64))[::-1]
    k = entropy_count(own)
    return float(own[k - 1]) if k else 0.0


def ratio_threshold(values: np.ndarray, log_gap: float = 1.0) -> float:
    """The smallest of the values that the ratio count keeps."""
    own = np.sort(np.asarray(values, dtype=np.float64))[::-1]
    k = ratio_count(own, float(np.exp(log_gap)))
    return float(own[k - 1]) if k else 0.0


def first_component(rows: np.ndarray, rate: float = 0.5, settle: float = 0.01, rounds: int = 50) -> np.ndarray:
    """The first principal direction by streaming updates in row order, until it moves little twice running."""
    own = np.asarray(rows, dtype=np.float64)
    own = own - own.mean(axis=0)
    start = own[np.argmax((own**2).sum(axis=1))]
    w = start / (np.linalg.norm(start) or 1)
    calm = 0
    for r in range(rounds):
        before = w.copy()
        for n, x in enumerate(own, 1):
            w = w + rate / (n + r * len(own)) * x * (x @ w)
            w /= np.linalg.norm(w) or 1
        calm = calm + 1 if min(np.linalg.norm(w - before), np.linalg.norm(w + before)) < settle else 0
        if calm == 2:
            break
    return w


def reconstruct(rows: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Rows put together again from their mean and one direction."""
    mean = rows.mean(axis=0)
    return mean + np.outer((rows - mean) @ component, component)


def representative(vectors: np.ndarray, whole: np.ndarray, rounds: int = 500, threshold: str = "ratio", log_gap: float = 1.0) -> list[int]:
    """Spans that stand for a text: relevant to the whole and unlike each other, by replicator dynamics on both."""
    v = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    relevance = np.maximum(v @ (whole / (np.linalg.norm(whole) or 1)), 0)
    m = np.outer(relevance, relevance) * (1 - np.clip(v @ v.T, 0, 1)) + np.diag(relevance * 1e-3)
    x = np.full(len(v), 1 / len(v))
    for _ in range(rounds):
        gain = m @ x
        if (total := x @ gain) <= 0:
            break
        x = x * gain / total
    order = np.argsort(-x, kind="stable")
    k = ratio_count(x[order], float(np.exp(log_gap))) if threshold == "ratio" else entropy_count(x[order]) if threshold == "entropy" else int((x > 1 / (3 * len(x))).sum())
    return sorted(order[:k].tolist())
