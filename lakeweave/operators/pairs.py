"""Dot products of every query with every vector: blocks of both as matrices, one row a block, so that few rows cross."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of vectors in a block, unless one section has more.
BLOCK = 1 << 20
#: Products that are held at a time.
CELLS = 1 << 20
#: Rows that a task holds before it gives some of them on.
HELD = 100_000
#: Numbers above this are left to the slow way, since their products can overflow.
HUGE = 1e150


def changes(batch: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Places at which a row's keys differ from those of the row before; 0 first. Nulls are equal."""
    n = batch.num_rows
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for k in keys:
        c = batch.column(k)
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        a, b = c.slice(1), c.slice(0, max(n - 1, 0))
        new[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.flatnonzero(new)


def _sealed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table.combine_chunks())
    return out.getvalue().to_pybytes()


def opened(data: bytes | pa.Buffer) -> pa.RecordBatch:
    t = pa.ipc.open_stream(data).read_all().combine_chunks()
    return t.to_batches()[0]


def packed(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a task as blocks (name, data) of about BLOCK bytes; rows of equal ``keys``, which stand together, stay together."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def blocks(last: bool):
            nonlocal held, size
            t = pa.Table.from_batches(held).combine_chunks()
            ends = np.r_[changes(t, keys)[1:], t.num_rows] if keys else np.arange(1, t.num_rows + 1)
            step = max(1, BLOCK * t.num_rows // max(size, 1))
            at = 0
            while at < t.num_rows:
                stop = int(ends[max(np.searchsorted(ends, at + step, side="right") - 1, np.searchsorted(ends, at, side="right"))])
                if stop == t.num_rows and not last:
                    break  # its last section may go on
                yield pa.RecordBatch.from_pydict({"name": [uuid.uuid4().hex], "data": pa.array([_sealed(t.slice(at, stop - at))], pa.binary())})
                at = stop
            held = pa.Table.from_batches([b for b in t.slice(at).to_batches() if b.num_rows], t.schema).to_batches()
            size = sum(b.nbytes for b in held)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
                if size >= 2 * BLOCK:
                    yield from blocks(False)
        if held:
            yield from blocks(True)

    return run


def _by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and matrices of a column of vectors by their length; vectors that are null or hold nulls are left out."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    out = {}
    for n in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        own = column if len(rows) == len(column) else column.take(pa.array(rows))
        flat = own.flatten()
        if flat.null_count:
            ok = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(len(rows), n)
            rows = rows[ok.all(axis=1)]
            flat = column.take(pa.array(rows)).flatten()
        out[n] = rows, flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), n)
    return out


def _in_order(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Dot products of rows with rows, added up from the first component to the last as an expression does it."""
    out = np.zeros(len(q))
    for i in range(q.shape[1]):
        out += q[:, i] * v[:, i]
    return out


def _section_best(q: np.ndarray, v: np.ndarray, starts: np.ndarray, bar: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, section, row, score) of pairs that reach ``bar``, at most k of a query: by query, then falling score, then place.

    A matrix product tells which pairs can count; what is returned is added up in order, so that equal vectors have equal scores.
    """
    plain = all(not m.size or np.abs(m).max() < HUGE for m in (q, v))  # false for NaN too
    if plain:
        s = q @ v.T
        slack = 8 * (q.shape[1] + 1) * np.finfo(float).eps * np.linalg.norm(q, axis=1) * (np.linalg.norm(v, axis=1).max() if len(v) else 0)
    else:
        with np.errstate(invalid="ignore", over="ignore"):
            s = np.zeros((len(q), len(v)))
            for i in range(q.shape[1]):
                s += q[:, i, None] * v[None, :, i]
        slack = np.zeros(len(q))
    best = np.maximum.reduceat(s, starts, axis=1)
    high = best if plain else np.where(np.isnan(best), np.inf, best)
    least = bar
    if k is not None and len(starts) > k:
        least = np.maximum(bar, np.partition(high, len(starts) - k, axis=1)[:, len(starts) - k])
    qi, si = np.nonzero(high >= (least - slack)[:, None])
    if not len(qi):
        return qi, si, qi, np.zeros(0)
    lengths = np.diff(np.r_[starts, len(v)])
    n = lengths[si]
    pair = np.repeat(np.arange(len(qi)), n)
    row = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + starts[si][pair]
    found, top = s[qi[pair], row], best[qi, si][pair]
    near = (found >= top - 2 * slack[qi[pair]]) | np.isnan(found)
    pair, row = pair[near], row[near]
    exact = _in_order(q[qi[pair]], v[row]) if plain else s[qi[pair], row]
    value = exact if plain else np.where(np.isnan(exact), np.inf, exact)
    order = np.lexsort((row, -value, ~np.isnan(exact), pair))  # the first row of a section's best
    order = order[np.r_[True, pair[order][1:] != pair[order][:-1]]]
    row, exact, value = row[order], exact[order], value[order]
    ok = value >= bar[qi]
    qi, si, row, exact, value = qi[ok], si[ok], row[ok], exact[ok], value[ok]
    order = np.lexsort((si, -value, ~np.isnan(exact), qi))
    qi, si, row, exact = qi[order], si[order], row[order], exact[order]
    if k is not None and len(qi):
        first = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
        place = np.arange(len(qi)) - np.repeat(first, np.diff(np.r_[first, len(qi)]))
        qi, si, row, exact = (x[place < k] for x in (qi, si, row, exact))
    return qi, si, row, exact


class _Best:
    """What a task has found for one block of queries so far: rows, and of each query its k best scores."""

    def __init__(self, n: int, k: int | None, floor: float | None):
        self.k, self.rows, self.held = k, [], 0
        self.bar = np.full(n, -np.inf if floor is None else floor)
        self.best = np.full((n, k), -np.inf) if k is not None else None

    def add(self, at: np.ndarray, score: np.ndarray, rows: pa.RecordBatch) -> None:
        """``at``: each row's query, ascending; no more than k of one."""
        self.rows.append((at, score, rows))
        self.held += len(at)
        if self.k is None or not len(at):
            return
        value = np.where(np.isnan(score), np.inf, score)
        own, first = np.unique(at, return_index=True)
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        new = np.full((len(own), self.k), -np.inf)
        new[np.searchsorted(own, at), place] = value
        both = np.hstack([self.best[own], new])
        self.best[own] = np.partition(both, self.k, axis=1)[:, self.k :]
        self.bar[own] = np.maximum(self.bar[own], self.best[own].min(axis=1))

    def taken(self) -> Iterator[pa.RecordBatch]:
        """The rows that can still be among the k best; they are held no longer."""
        for at, score, rows in self.rows:
            if self.k is not None:
                rows = rows.filter(pa.array(~(score < self.bar[at])))
            if rows.num_rows:
                yield rows
        self.rows, self.held = [], 0


def scored(floor: float | None, k: int | None, vectors: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(query_id, document_id, section, score, best_vec) from rows (own, name, asked) of a block of sections and one of queries.

    With ``k``, only rows that can be among a query's k best by score, then by the order of sections in their block.
    Scores are null where no vector of a section can be compared; without a floor these rows are there too, last in order.
    """

    def run(batches):
        state: dict[str, _Best] = {}

        def rows_of(c, q, at, places, score) -> pa.RecordBatch:
            own = pa.array(places)
            out = [q.column("query_id").take(pa.array(at)), c.column("document_id").take(own), c.column("section").take(own), score]
            names = ["query_id", "document_id", "section", "score"]
            return pa.RecordBatch.from_arrays(out + ([c.column("vector").take(own)] if vectors else []), names + (["best_vec"] if vectors else []))

        for batch in batches:
            for own, name, asked in zip(batch.column("own"), batch.column("name").to_pylist(), batch.column("asked"), strict=True):
                c, q = opened(own.as_buffer()), opened(asked.as_buffer())
                first = changes(c, ["document_id", "section"])
                section_of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, c.num_rows]))
                sides, asks = _by_length(c.column("vector")), _by_length(q.column("query"))
                s = state.setdefault(name, _Best(q.num_rows, k, floor))
                bare = np.ones(q.num_rows, dtype=bool)  # queries that nothing can be compared with
                lacking: list[tuple[np.ndarray, np.ndarray]] = []
                for n, (which, m) in asks.items():
                    rows, v = sides.get(n, (np.zeros(0, dtype=np.int64), None))
                    if not len(rows):
                        continue
                    bare[which] = False
                    present = section_of[rows]
                    starts = np.flatnonzero(np.r_[True, present[1:] != present[:-1]])
                    if floor is None and len(starts) < (len(first) if k is None else min(k, len(first))):
                        lacking.append((which, np.setdiff1d(np.arange(len(first)), present)))
                    step = max(1, CELLS // len(rows))
                    for a in range(0, len(which), step):
                        to = which[a : a + step]
                        qi, _, row, exact = _section_best(m[a : a + step], v, starts, s.bar[to], k)
                        if len(qi):
                            s.add(to[qi], exact, rows_of(c, q, to[qi], rows[row], pa.array(exact)))
                        if k is None:
                            yield from s.taken()
                if floor is None and bare.any():
                    lacking.append((np.flatnonzero(bare), np.arange(len(first))))
                for which, gone in lacking:
                    gone = gone[:k]
                    step = max(1, HELD // max(len(gone), 1))
                    for a in range(0, len(which), step):
                        at = np.repeat(which[a : a + step], len(gone))
                        if len(at):
                            yield rows_of(c, q, at, np.tile(first[gone], len(which[a : a + step])), pa.nulls(len(at), pa.float64()))
                if sum(x.held for x in state.values()) > HELD:
                    for x in state.values():
                        yield from x.taken()
        for x in state.values():
            yield from x.taken()

    return run
