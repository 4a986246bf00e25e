"""Packing token sequences into windows of a fixed length (operator 4)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import cut, keep_only, rows_of, texts

#: Partitions whose leftover windows one task merges.
MERGED_TOGETHER = 64
PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
SPARK = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = 2048, open_windows: int = 16, with_ids: bool = True) -> DataFrame:
    """Pieces of documents and where they lie: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (, ids).

    Bounded-space online packing. A partition keeps ``open_windows`` windows. A document's whole windows stand
    alone; what remains goes to the open window that it fits best. Where none fits and all are in use, the fullest
    is filled up with the piece's head and emitted, and the tail is placed anew. The windows left open are merged
    for every 64 partitions; their last tokens go to sequences whose lengths are powers of two, so no padding
    arises at all. ``ids``: little-endian unsigned 32-bit integers.

    Null and empty texts are the end id alone; repeated rows and null doc_ids are packed like others; of windows that a
    piece fits equally well the oldest takes it; an empty table gives no rows; columns besides doc_id and text, whatever
    their names, are not looked at.
    """
    schema = SPARK + ", part int, ids binary"
    placed = cut(texts(docs).mapInArrow(lambda batches: _pack(batches, path, end_id, window, open_windows, with_ids), schema))
    closed = placed.filter("part is null").drop("part")
    merged = placed.filter("part is not null").groupBy((F.col("part") / MERGED_TOGETHER).cast("int").alias("bundle")).applyInArrow(lambda key, table: _merge(key, table, window, with_ids), SPARK + ", ids binary")
    out = closed.unionByName(merged)
    return out if with_ids else out.drop("ids")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
    fields = [*PIECE, ("part", pa.int32()), ("ids", pa.binary())]
    return pa.RecordBatch.from_pydict({name: pa.array(c, kind) for (name, kind), c in zip(fields, columns, strict=True)})


def _pack(batches, path, end_id, window, open_windows, with_ids):
    keep_only("packing", bpe.forget)
    encode = bpe.spaced_encoder(path)
    part = TaskContext.get().partitionId()
    end = np.array([end_id], dtype="<u4").tobytes()
    serial = part << 35
    free: list[int] = []  # of each open window
    held: list[list[tuple]] = []  # its pieces: doc_id, start, length, doc_tokens, ids
    rows: list[tuple] = []

    def emit(pieces: list[tuple]) -> None:
        nonlocal serial
        at = 0
        for doc, start, length, total, ids in pieces:
            rows.append((doc, start, length, zlib.crc32(ids), total, serial << 1, at, None, ids if with_ids else None))
            at += length
        serial += 1

    for docs, run in rows_of(batches, 1 << 20):
        for doc, ids in zip(docs, encode(run), strict=True):
            ids += end
            total, start = len(ids) // 4, 0
            while total - start >= window:
                emit([(doc, start, window, total, ids[4 * start : 4 * (start + window)])])
                start += window
            while start < total:
                length = total - start
                best = min((i for i, f in enumerate(free) if f >= length), key=free.__getitem__, default=-1)
                if best < 0 and len(free) < open_windows:
                    free.append(window)
                    held.append([])
                    best = len(free) - 1
                if best < 0:
                    best = min(range(len(free)), key=free.__getitem__)
                    length = free[best]
                held[best].append((doc, start, length, total, ids[4 * start : 4 * (start + length)]))
                free[best] -= length
                start += length
                if not free[best]:
                    emit(held.pop(best))
                    free.pop(best)
        yield _batch(rows)
        rows.clear()
    yield _batch([(doc, start, length, None, total, None, None, part, ids) for pieces in held for doc, start, length, total, ids in pieces])


def _merge(key, table: pa.Table, window: int, with_ids: bool) -> pa.Table:
    """Leftover pieces one after the other, cut at window ends and at last at falling powers of two."""
    pieces = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "doc_id", "start", "length", "doc_tokens", "ids")), strict=True), key=lambda p: (p[0], p[1] is not None, p[1] or 0, p[2]))
    left = sum(p[3] for p in pieces)
    rows: list[tuple] = []
    serial, at, room = key[0].as_py() << 35, 0, 0
    for _, doc, start, length, total, ids in pieces:
        done = 0
        while done < length:
            if not room:
                room = window if left >= window else 1 << (left.bit_length() - 1)
                left -= room
                at, serial = 0, serial + 1
            n = min(room, length - done)
            own = ids[4 * done : 4 * (done + n)]
            rows.append((doc, start + done, n, zlib.crc32(own), total, serial << 1 | 1, at, None, own if with_ids else None))
            done, at, room = done + n, at + n, room - n
    return pa.Table.from_batches([_batch(rows)]).drop_columns(["part"])
