"""Token ids in directly addressable codes: written in document order, read back, any id without decoding others (operator 10)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import NULL_ID, keep_only, partitions, rows_of, texts

#: Bits whose ones one directory entry counts.
BLOCK = 512
#: Ids that a segment holds, unless a single document has more.
SEGMENT = 1 << 20
SEGMENTS = "part int, serial int, before long, doc_ids array<long>, counts array<int>, code binary"


def encode(ids: np.ndarray) -> bytes:
    """Levels of eight bits each. Every level but the last has a bitmap of the ids that go on, and a directory of its ones.

    Layout, little-endian: number of ids and of levels (u4), the levels' sizes (u4 each), then for each level its
    bytes, bitmap and directory (u4 for every 512 bits).
    """
    ids = np.asarray(ids, dtype=np.uint32)
    sizes, body, n = [], [], len(ids)
    while True:
        more = ids > 255
        sizes.append(len(ids))
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(ids), BLOCK), dtype=np.uint32) if len(ids) else np.zeros(0, np.uint32)
        body += [(ids & 255).astype(np.uint8).tobytes(), bits.tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
        ids = ids[more] >> 8
        if not len(ids):
            return b"".join([np.array([n, len(sizes), *sizes], dtype="<u4").tobytes(), *body])


class Codes:
    """Reads what ``encode`` made."""

    def __init__(self, code: bytes):
        self.n, levels = (int(x) for x in np.frombuffer(code, "<u4", 2))
        sizes = np.frombuffer(code, "<u4", levels, 8).tolist()
        at, self.levels = 8 + 4 * levels, []
        for n in sizes:
            blocks = -(-n // BLOCK)
            low = np.frombuffer(code, np.uint8, n, at)
            bits = np.frombuffer(code, np.uint8, -(-n // 8), at + n)
            ranks = np.frombuffer(code[at + n + len(bits) : at + n + len(bits) + 4 * blocks], "<u4")
            self.levels.append((low, bits, ranks))
            at += n + len(bits) + 4 * blocks

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """The i-th id: a byte a level, and one block of a bitmap to find its place in the next."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for low, bits, ranks in self.levels:
            value |= int(low[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            own = bits[block * BLOCK // 8 : (i >> 3) + 1].copy()
            own[-1] &= (1 << (i & 7)) - 1
            i = int(ranks[block]) + int(np.bitwise_count(own).sum())
            shift += 8
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """ids start to stop; only these are touched, at every level."""
        out = np.zeros(stop - start, dtype=np.uint32)
        at, shift = np.arange(stop - start), 0
        for low, bits, ranks in self.levels:
            out[at] |= low[start:stop].astype(np.uint32) << shift
            first = start // 8
            more = np.unpackbits(bits[first : -(-stop // 8)], bitorder="little")[start - 8 * first : stop - 8 * first].astype(bool)
            if not more.any():
                break
            block = start // BLOCK
            own = np.unpackbits(bits[block * BLOCK // 8 : -(-start // 8)], bitorder="little")[: start - block * BLOCK]
            start = int(ranks[block]) + int(own.sum())
            at, shift = at[more], shift + 8
            stop = start + len(at)
        return out


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 1) -> None:
    """Writes every document's ids and the end id to ``folder``, in ascending doc_id order (null first, equal ids side by side).

    Parquet holds the segments; ``code`` is the format above. Null and empty texts are the end id alone; repeated rows
    are written as often as they stand; an empty table gives no segment; columns besides doc_id and text, whatever their
    names, are not looked at. A segment holds about SEGMENT ids or one longer document.
    """
    n = partitions(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null")
    # bounds from the ids alone: a range partitioning of its own would read the texts twice
    bounds = np.array(sorted(set(ids.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else [])
    own = texts(docs).withColumn("range", range_of(bounds)(F.coalesce("doc_id", F.lit(NULL_ID))))
    order = own.repartitionById(n, "range").sortWithinPartitions("doc_id", F.xxhash64("text"))
    order.mapInArrow(lambda batches: _segments(batches, path, end_id), SEGMENTS).write.mode("overwrite").parquet(folder)


def range_of(bounds: np.ndarray):
    """Column function: the number of bounds up to an id, so that ranges follow one another as ids do."""

    @F.pandas_udf("int")
    def run(ids):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right").astype(np.int32))

    return run


def _segments(batches, path, end_id):
    keep_only("token files", bpe.word_encoder.cache_clear)
    tokens = bpe.word_encoder(path)
    end = np.array([end_id], dtype="<u4").tobytes()
    part, serial, before = TaskContext.get().partitionId(), 0, 0
    docs: list = []
    held: list[bytes] = []
    size = 0

    def segment() -> pa.RecordBatch:
        nonlocal serial, before, docs, held, size
        counts = [len(x) // 4 for x in held]
        code = encode(np.frombuffer(b"".join(held), "<u4"))
        out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "serial": pa.array([serial], pa.int32()), "before": pa.array([before], pa.int64()), "doc_ids": pa.array([docs], pa.list_(pa.int64())), "counts": pa.array([counts], pa.list_(pa.int32())), "code": pa.array([code], pa.binary())})
        serial, before = serial + 1, before + sum(counts)
        docs, held, size = [], [], 0
        return out

    for ids, run in rows_of(batches, 1 << 20):
        for doc, own in zip(ids, tokens(run), strict=True):
            docs.append(doc)
            held.append(own + end)
            size += len(own) // 4 + 1
            if size >= SEGMENT:
                yield segment()
    if docs:
        yield segment()


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (, ids) of each document in the files."""
    files = spark.read.schema(SEGMENTS).parquet(folder)
    sums = files.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()  # a row a partition
    ahead = np.cumsum([0, *(r.n for r in sums)])[:-1].tolist()
    base = spark.createDataFrame([(r.part, a) for r, a in zip(sums, ahead, strict=True)], "part int, base long")
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return files.join(F.broadcast(base), "part").select("doc_ids", "counts", "code", (F.col("base") + F.col("before")).alias("before")).mapInArrow(lambda batches: _read(batches, with_ids), kind)


def _read(batches, with_ids):
    for batch in batches:
        for row in batch.to_pylist():
            codes = Codes(row["code"])
            every = codes.slice(0, len(codes)).astype("<u4")
            counts = np.array(row["counts"], dtype=np.int64)
            stops = np.cumsum(counts).tolist()
            raw = memoryview(every.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip([0, *stops[:-1]], stops, strict=True)]
            ids = [every[a:b].astype(np.int32) for a, b in zip([0, *stops[:-1]], stops, strict=True)] if with_ids else []
            out = {"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(row["before"] + np.cumsum(counts) - counts), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crc, pa.int64())}
            yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}))
