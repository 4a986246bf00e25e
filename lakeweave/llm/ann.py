"""Approximate nearest neighbours by an inverted multi-index (operator 8)."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, ragged

#: Vectors that the two codebooks are fitted on: a bounded sample by hash of the id.
SAMPLE = 16_384
#: Rows of the sample that are asked to find the share of entries that a query walks through.
TRIED = 256
#: Centroids of a half at most, and entries of a block at least and at most.
MOST, LEAST_BLOCK, BLOCK = 1024, 1024, 8192
FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Not null or zero, and every component a finite number."""
    wrong = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(F.exists(vector, lambda x: x != 0) & ~F.exists(vector, wrong), F.lit(False))


def codebook(rows: np.ndarray, k: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct rows."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(rows, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        own = nearest(rows, centres)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * rows @ centres.T, axis=1)


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells by falling sum of the query's products with both halves' centroids, until they hold ``wanted`` entries.

    The multi-sequence walk: both lists sorted, a heap of pairs, each pair followed by its two neighbours.
    """
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    fa, fb = (-first[a]).tolist(), (-second[b]).tolist()
    order_a, order_b, k = a.tolist(), b.tolist(), len(second)
    sizes = counts.tolist()
    heap, out, held = [(fa[0] + fb[0], 0, 0)], [], 0
    reached = [0] * len(fa)  # pairs of each row that were pushed
    reached[0] = 1
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = order_a[i] * k + order_b[j]
        if sizes[cell]:
            out.append(cell)
            held += sizes[cell]
        if reached[i] == j + 1 and j + 1 < k and (i == 0 or reached[i - 1] > j + 1):
            reached[i] += 1
            heapq.heappush(heap, (fa[i] + fb[j + 1], i, j + 1))
        if i + 1 < len(fa) and reached[i + 1] == j:
            reached[i + 1] += 1
            heapq.heappush(heap, (fa[i + 1] + fb[j], i + 1, j))
    return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)



def one_each(df: DataFrame) -> DataFrame:
    """A row for each id: (vec_id, embedding), of usable vectors the least where an id has several."""
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


@dataclass
class Index:
    """Both halves' centroids, how many entries each pair of them (a cell) has, and the blocks that cells lie in.

    Cells follow one another in blocks of about ``size`` entries; a cell with more than that has several blocks of its own.
    """

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray
    size: int

    def __post_init__(self):
        self.half = self.first.shape[1]
        before = np.cumsum(self.counts) - self.counts
        large = self.counts > self.size
        self.width = np.where(large, -(-self.counts // self.size), 1)
        steps = np.where(large, self.width + 1, 0)  # those after a large cell begin a block anew
        self.block = (before - np.cumsum(np.where(large, self.counts, 0)) + np.where(large, self.counts, 0)) // self.size + np.cumsum(steps) - np.where(large, self.width, 0)

    def products(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return queries[:, : self.half] @ self.first.T, queries[:, self.half :] @ self.second.T

    def cells(self, rows: np.ndarray) -> np.ndarray:
        return nearest(rows[:, : self.half], self.first) * len(self.second) + nearest(rows[:, self.half :], self.second)

    def reached(self, queries: np.ndarray, wanted: int) -> tuple[list[list[int]], list[float]]:
        """Of each query the blocks of the cells that the walk reaches, and the least summed product among these cells."""
        a, b = self.products(queries)
        blocks, bars = [], []
        for i in range(len(queries)):
            found = np.array(traverse(a[i], b[i], self.counts, wanted), dtype=np.int64)
            blocks.append(np.unique(ragged(self.block[found], self.width[found])).tolist())
            bars.append(float(a[i, found[-1] // len(self.second)] + b[i, found[-1] % len(self.second)]) if len(found) else np.inf)
        return blocks, bars


def share_for(recall: float, sample: np.ndarray, index: Index, k: int) -> float:
    """The share of entries, nearest cells first, among which a query finds ``recall`` of its ``k`` nearest: measured within the sample.

    The nearest of a larger table stand out more from the rest than those of its sample, so there the share finds as much or more.
    """
    asked = sample[:TRIED]
    cell = index.cells(sample)
    a, b = index.products(asked)
    needed = []
    for i in range(len(asked)):
        score = sample @ asked[i]
        score[i] = -np.inf
        best = np.argsort(-score)[: min(k, len(sample) - 1)]
        guess = a[i, cell // len(index.second)] + b[i, cell % len(index.second)]
        needed.append(np.searchsorted(np.sort(-guess), -guess[best], side="right") / len(sample))
    return float(np.quantile(np.concatenate(needed), recall)) if needed and len(sample) > 1 else 1.0


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.93, centroids: int | None = None) -> DataFrame:
    """Each query's ``k`` nearest by inner product: query_id, rank, vec_id, score (double, from the original vectors).

    ``vectors`` and ``queries``: (vec_id, embedding). Both halves of the vectors are quantised, by default with a quarter
    as many centroids as the square root of the rows (8 to 1,024), so that a cell holds about sixteen entries; the
    centroids are fitted on a sample of at most 16,384 rows and every row is indexed. A query walks the centroid pairs
    by summed product until they hold a share of all entries; the share is what 256 rows of the sample need for
    ``recall`` of their nearest, so it falls with finer cells and with vectors that lie in clusters. Entries lie in
    blocks of neighbouring cells, each in one; a query goes only to blocks with cells that it reaches, and is scored
    there with the entries of these cells alone.

    Equal vectors are one entry that keeps its k + 1 smallest ids, so a vector that stands in a third of all rows costs
    no more than another. Rows that repeat an id count once, with the least of its vectors. Ties go to the smaller
    vec_id. Queries are no candidates of their own. Vectors that are null, zero, of another length than most, or hold
    null or non-finite components take no part; nor do null ids. An empty table gives no rows; fewer than ``k``
    candidates are all returned. Columns besides vec_id and embedding, whatever their names, are not looked at.
    """
    spark = vectors.sparkSession
    rows = one_each(vectors)
    dim = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dim:
        return empty
    dim = dim[0].dim
    # of equal vectors the k + 1 smallest ids suffice: one may be the query itself
    same = Window.partitionBy("embedding").orderBy("vec_id")
    distinct = cut(rows.filter(F.size("embedding") == dim).withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("vec_ids")))
    n = distinct.count()
    sample = matrix(distinct.orderBy(F.xxhash64("vec_ids"), "vec_ids").select("embedding").limit(SAMPLE).toArrow().column("embedding").combine_chunks(), dim)
    half = dim // 2
    each = centroids or min(max(8, round(n**0.5 / 4)), MOST)
    books = codebook(sample[:, :half], each), codebook(sample[:, half:], each)
    bare = Index(*books, np.zeros(len(books[0]) * len(books[1]), dtype=np.int64), 1)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"cell": pa.array(bare.cells(matrix(batch.column("embedding"), dim)), pa.int32()), "vec_ids": batch.column("vec_ids"), "embedding": batch.column("embedding")})

    entries = cut(distinct.mapInArrow(assign, "cell int, vec_ids array<long>, embedding array<double>"))
    held = entries.groupBy("cell").count().toArrow()  # centroids squared at most
    bare.counts[held.column("cell").to_numpy()] = held.column("count").to_numpy()
    width = partitions(spark)
    index = Index(*books, bare.counts, min(max(LEAST_BLOCK, n // (2 * width)), BLOCK))
    wanted = min(n, max(int(np.ceil(share_for(recall, sample, index, k) * n)), 2 * (k + 1)))

    def walk(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                blocks, bars = index.reached(matrix(some.column("embedding"), dim), wanted)
                yield pa.RecordBatch.from_pydict({"vec_ids": pa.array([[i] for i in some.column("vec_id").to_pylist()], pa.list_(pa.int64())), "embedding": some.column("embedding"), "blocks": pa.array(blocks, pa.list_(pa.int32())), "bar": pa.array(bars, pa.float64())})

    asked = one_each(queries).filter(F.size("embedding") == dim).mapInArrow(walk, "vec_ids array<long>, embedding array<double>, blocks array<int>, bar double")
    asked = asked.select(F.explode("blocks").alias("block"), F.lit(-1).alias("cell"), "vec_ids", "embedding", "bar")

    def place(batches):
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            spread = np.array([ids[0] % 1_000_003 for ids in batch.column("vec_ids").to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"block": pa.array(index.block[cell] + spread % index.width[cell], pa.int32())} | {c: batch.column(c) for c in ("cell", "vec_ids", "embedding")})

    placed = entries.mapInArrow(place, "block int, cell int, vec_ids array<long>, embedding array<double>").withColumn("bar", F.lit(None).cast("double"))
    # a block's entries, then its queries as they come
    met = placed.unionByName(asked).repartition(width, "block").sortWithinPartitions("block", F.col("bar").isNotNull())
    found = met.mapInArrow(lambda batches: _score(batches, index, dim, k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _score(batches, index: Index, dim: int, k: int):
    """The best of each block's entries for the queries that reach it. Memory follows a block and a batch, not the queries."""
    now, entries, ready = None, [], None
    for batch in batches:
        block = batch.column("block").to_numpy()
        asks = batch.column("bar").is_valid().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if i == j:
                continue
            if block[i] != now:
                now, entries, ready = block[i], [], None
            if not asks[i]:
                entries.append(batch.slice(i, j - i))
                continue
            if not entries:
                continue  # a large cell's entries may leave one of its blocks empty
            if ready is None:
                ready = _entries(entries, dim)
            for at in range(i, j, 512):
                yield _best(ready, batch.slice(at, min(512, j - at)), index, dim, k)


def _entries(batches: list[pa.RecordBatch], dim: int) -> tuple:
    table = pa.Table.from_batches(batches).sort_by("cell").combine_chunks()
    cell = table.column("cell").to_numpy()
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    return matrix(table.column("embedding").combine_chunks(), dim), table.column("vec_ids").to_pylist(), cell[first], first, np.r_[first[1:], len(cell)]


def _best(entries: tuple, some: pa.RecordBatch, index: Index, dim: int, k: int) -> pa.RecordBatch:
    own, ids, cells, first, stop = entries
    asked = matrix(some.column("embedding"), dim)
    names = [x[0] for x in some.column("vec_ids").to_pylist()]
    a, b = index.products(asked)
    bar = some.column("bar").to_numpy()
    reached = a[:, cells // len(index.second)] + b[:, cells % len(index.second)] >= (bar - 1e-9 * np.maximum(1, np.abs(bar)))[:, None]
    score = np.full((len(asked), len(own)), -np.inf)
    for c, (i, j) in enumerate(zip(first.tolist(), stop.tolist(), strict=True)):
        who = np.flatnonzero(reached[:, c])
        if len(who):
            score[who, i:j] = asked[who] @ own[i:j].T
    enough = min(k + 1, score.shape[1])
    least = np.partition(score, -enough, axis=1)[:, -enough]
    out: list[list] = [[], [], []]
    for q in range(len(asked)):
        near = np.flatnonzero(score[q] >= least[q] - 1e-9 * max(1.0, abs(least[q]))) if np.isfinite(least[q]) else np.flatnonzero(np.isfinite(score[q]))
        exact = (own[near] * asked[q]).sum(axis=1).tolist()
        best = sorted((-s, v) for s, e in zip(exact, near.tolist(), strict=True) for v in ids[e] if v != names[q])[:k]
        out[0] += [names[q]] * len(best)
        out[1] += [v for _, v in best]
        out[2] += [-s for s, _ in best]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])
