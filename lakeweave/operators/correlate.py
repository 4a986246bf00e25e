"""Correlation of keys over entities, strongest edges, dominant sets and cliques."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def means(rows: DataFrame, entity: str, key: str, value: str) -> DataFrame:
    """Mean of repeats by entity and key (long form)."""
    return rows.filter(F.col(value).isNotNull()).groupBy(entity, key).agg(F.avg(value).alias("mean"))


def wide(rows: DataFrame, entity: str, key: str, value: str, keys: list[str]) -> DataFrame:
    """A row for each entity with a column for each of the given keys; repeats are averaged."""
    return rows.groupBy(entity).pivot(key, keys).agg(F.avg(value))


def correlations(long: DataFrame, entity: str, key: str, least: int = 3) -> DataFrame:
    """(a, b, n, r) of each pair of keys that ``least`` entities have both of; r is null without variance.

    The pairs of an entity are those of its keys, of which there are few; sums are combined before the shuffle.
    """
    a = long.select(entity, F.col(key).alias("a"), F.col("mean").alias("x"))
    b = long.select(entity, F.col(key).alias("b"), F.col("mean").alias("y"))
    pairs = a.join(b, entity).filter("a < b").groupBy("a", "b")
    sums = pairs.agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")).filter(F.col("n") >= least)
    return sums.select("a", "b", "n", F.try_divide("c", F.col("sx") * F.col("sy")).alias("r"))


def edges(found: DataFrame, least: int = 12, strength: float = 0.3) -> DataFrame:
    return found.filter((F.col("n") >= least) & (F.abs("r") >= strength))


def strongest(found: DataFrame, k: int = 12) -> DataFrame:
    """The k strongest pairs, for show."""
    return found.filter(F.col("r").isNotNull()).orderBy(F.desc(F.abs("r")), "a", "b").limit(k)


def dominant_set(weights: np.ndarray, members: np.ndarray | None = None, rounds: int = 2000, tolerance: float = 1e-10) -> np.ndarray:
    """Members of the set that replicator dynamics ends in: weights grow in proportion to their support, until they settle."""
    own = np.arange(len(weights)) if members is None else np.asarray(members)
    if not len(own):
        return own
    m = weights[np.ix_(own, own)]
    x = np.full(len(own), 1 / len(own))
    for _ in range(rounds):
        gain = m @ x
        total = x @ gain
        if total <= 0:
            break
        new = x * gain / total
        moved = np.abs(new - x).sum()
        x = new
        if moved < tolerance:
            break
    return own[x > 1 / (3 * len(own))]


def cohesion(weights: np.ndarray, members: np.ndarray) -> float:
    """Mean weight between members; 0 for fewer than two."""
    n = len(members)
    return float(weights[np.ix_(members, members)].sum() / (n * (n - 1))) if n > 1 else 0.0


def cliques(weights: np.ndarray, smallest: int = 2, least: float = 0.3, most: int = 10) -> list[tuple[list[int], float]]:
    """Dominant sets peeled off one by one, of which those that are large and close enough count, ``most`` of them at most.

    A set that is too small or too loose is taken away like others, and what is left is looked at again.
    """
    left, out = np.flatnonzero(weights.sum(axis=1) > 0), []
    while len(left) >= smallest and len(out) < most:
        own = dominant_set(weights, left)
        if not len(own):
            break
        close = cohesion(weights, own)
        if len(own) >= smallest and close >= least:
            out.append((own.tolist(), close))
        left = np.setdiff1d(left, own)
        left = left[weights[np.ix_(left, left)].sum(axis=1) > 0]
    return out


def cliques_of(found: DataFrame, **options) -> DataFrame:
    """(clique, key, cohesion) from pairs (a, b, r). Keys are the few kinds of measurement, so their matrix fits the driver."""
    rows = found.select("a", "b", F.abs("r").alias("w")).filter("w is not null").collect()
    names = sorted({n for r in rows for n in (r.a, r.b)})
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[at[r.a], at[r.b]] = m[at[r.b], at[r.a]] = r.w
    out = [(i, str(names[k]), c) for i, (own, c) in enumerate(cliques(m, **options)) for k in own]
    return found.sparkSession.createDataFrame(out, "clique int, key string, cohesion double")
