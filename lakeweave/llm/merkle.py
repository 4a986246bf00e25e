"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections (operator 3)."""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, partitions, rows_of, small_batches

#: A piece ends where the hash of its last eight bytes has as many low zero bits: 32 bytes on average.
PIECE_BITS = 5
#: A section ends with a paragraph whose hash has as many low zero bits: 8 paragraphs on average.
SECTION_BITS = 3
ODD = np.uint64(0x9E3779B97F4A7C15)
UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    """A fixed 64-bit value for each byte."""
    return np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=8).digest() for i in range(256)), "<u8")


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, x)]) for x in (ODD, UNDO))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all; one to one."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def fingerprints(texts: list[str]) -> list[str]:
    """Of each text: ``root/section/section...``, a section being ``hash:leaf,leaf...`` of fixed-width hex numbers.

    Leaves are pieces cut by content within paragraphs (lines); a paragraph hashes its leaves, a section hashes its
    paragraphs and ends by content too, the root hashes the sections, all with BLAKE2b of 128 bits, so that roots test
    equality. Equal texts give equal strings; a local edit changes the leaves it touches and their ancestors only. The
    empty text has a root alone. Leaves are written with 32 bits and sections with 64, which only ``likeness`` reads.
    """
    raw = [t.encode() for t in texts]
    whole = b"".join(raw)
    data = np.frombuffer(whole, dtype=np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    n = len(data)
    if not n:
        return [_hash(b"")] * len(texts)
    value = _byte_values()[data]
    power, undo = _powers(1 << max(12, (n + 1).bit_length()))
    prefix = np.r_[np.uint64(0), np.cumsum(value * power[:n])]
    # a rolling hash says where pieces end, and nothing else
    back = np.maximum(np.arange(1, n + 1) - 8, 0)
    stop = mixed((prefix[1:] - prefix[back]) * undo[back]) & np.uint64((1 << PIECE_BITS) - 1) == 0
    # near a text's start the eight bytes would reach into the text before: no cut there
    for e in ends[:-1]:
        stop[e : e + 7] = False
    stop[:7] = False
    line = data == 10
    stop |= line
    stop[ends[ends > 0] - 1] = True
    leaf_end = np.flatnonzero(stop) + 1
    leaf = [_digest(whole[a:b]) for a, b in zip([0, *leaf_end[:-1].tolist()], leaf_end.tolist(), strict=True)]
    closes = line[leaf_end - 1]
    text_end = np.searchsorted(leaf_end, ends, side="right")  # leaves up to each text's end
    closes[text_end[text_end > 0] - 1] = True
    para_stop = (np.flatnonzero(closes) + 1).tolist()  # in leaves
    para = [_digest(b"P" + b"".join(leaf[a:b])) for a, b in zip([0, *para_stop], para_stop, strict=False)]
    shown = [x.hex() for x in [d[:4] for d in leaf]]
    out, p, l = [], 0, 0
    for own, stop_leaf in zip(raw, text_end.tolist(), strict=True):
        parts, hashes, first = [], [], p
        while p < len(para) and para_stop[p] <= stop_leaf:
            p += 1
            if para[p - 1][0] < 256 >> SECTION_BITS or para_stop[p - 1] == stop_leaf:
                hashes.append(_digest(b"S" + b"".join(para[first:p])))
                parts.append(f"{hashes[-1][:8].hex()}:{','.join(shown[l : para_stop[p - 1]])}")
                first, l = p, para_stop[p - 1]
        out.append("/".join([_hash(b"R" + b"".join(hashes)) if hashes else _hash(b""), *parts]))
    return out


def _digest(of: bytes) -> bytes:
    return hashlib.blake2b(of, digest_size=16).digest()


def _hash(of: bytes) -> str:
    return hashlib.blake2b(of, digest_size=16).hexdigest()


def likeness(a: str, b: str) -> float:
    """0 to 1: twice the leaves that both trees have over all leaves. Equal roots are 1; equal sections are not opened."""
    root_a, *own_a = a.split("/")
    root_b, *own_b = b.split("/")
    if root_a == root_b:
        return 1.0
    total = a.count(",") + len(own_a) + b.count(",") + len(own_b)
    rest_a, rest_b, both = Counter(own_a), Counter(own_b), 0
    for section in rest_a.keys() & rest_b.keys():
        n = min(rest_a[section], rest_b[section])
        both += n * (section.count(",") + 1)
        rest_a[section] -= n
        rest_b[section] -= n
    left_a, left_b = (Counter(x for s, n in rest.items() if n for x in s[17:].split(",") * n) for rest in (rest_a, rest_b))
    both += sum((left_a & left_b).values())
    return min(2 * both / total, 1.0) if total else 0.0


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """Where a's tree differs from b's: (section, leaf within it) of each leaf of ``a`` in no branch of ``b``."""
    if a.split("/")[0] == b.split("/")[0]:
        return []
    own_b = Counter(b.split("/")[1:])
    leaves_b = Counter(x for s in own_b for x in s[17:].split(",") * own_b[s])
    out = []
    for i, section in enumerate(a.split("/")[1:]):
        if own_b[section] > 0:
            own_b[section] -= 1
            leaves_b.subtract(section[17:].split(","))
    own_b = Counter(b.split("/")[1:])
    for i, section in enumerate(a.split("/")[1:]):
        if own_b[section] > 0:
            own_b[section] -= 1
            continue
        for j, leaf in enumerate(section[17:].split(",")):
            if leaves_b[leaf] > 0:
                leaves_b[leaf] -= 1
            else:
                out.append((i, j))
    return out


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each document. Null texts count as empty; nothing is shuffled."""

    def run(batches):
        for ids, run in rows_of(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "fingerprint": fingerprints(run)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and its successor in descending doc_id order (the last's is the first).

    The edited text has the last third of its code points replaced by as many first ones of the successor. Texts are
    shuffled once, into ranges of doc_id; each range also gets the head of the one that follows, so neighbours meet
    without a second shuffle. Null texts are empty; a null doc_id comes last; rows with one doc_id follow each other
    by their texts' hash, repeated rows too; a lone row is its own successor; an empty table gives no rows; columns
    besides doc_id and text, whatever their names, are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = 3 * partitions(spark)
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"))
    cuts = sorted(set(keys.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    bounds = np.array(cuts)

    @F.pandas_udf("int")
    def bucket(ids):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right").astype(np.int32))

    heads = keys.groupBy(bucket("doc_id").alias("bucket")).agg(F.max("doc_id").alias("doc_id")).orderBy("bucket").collect()  # a row a range
    follows = spark.createDataFrame([(r.doc_id, heads[(i + 1) % len(heads)].bucket) for i, r in enumerate(heads)], "doc_id long, bucket int")
    extra = base.join(F.broadcast(follows), "doc_id").select("bucket", F.lit(1).alias("extra"), "doc_id", "text")
    both = base.select(bucket("doc_id").alias("bucket"), F.lit(0).alias("extra"), "doc_id", "text").unionByName(extra)
    dealt = both.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "extra", F.desc("doc_id"), F.xxhash64("text"))
    return dealt.mapInArrow(_neighbours, OUT).withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))


def _neighbours(batches):
    held: list[tuple] = []  # rows of one range whose successors are still to come, the last alone

    def out(rows: list[tuple]) -> pa.RecordBatch:
        """All rows but the last, whose successor is not there yet."""
        texts = [r[3] for r in rows]
        edited = []
        for text, following in zip(texts, texts[1:], strict=False):
            third = len(text) // 3
            edited.append(text[: len(text) - third] + following[:third])
        own, other = fingerprints(texts), fingerprints(edited)
        columns = [[r[2] for r in rows[:-1]], [len(t) for t in texts[:-1]], [hashlib.sha256(t.encode()).hexdigest() for t in edited], own[:-1], other, list(map(likeness, own, other)), list(map(likeness, own, own[1:]))]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split(" ")[0] for x in OUT.split(", ")])

    for batch in batches:
        size = 0
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "extra", "doc_id", "text")), strict=True):
            if held and row[0] != held[-1][0]:
                yield out(held)
                held, size = [], 0
            if row[1] and held and held[-1][1]:
                continue  # rows that share the head's doc_id; its first is the successor
            held.append(row)
            size += len(row[3])
            if size > 2 << 20:
                yield out(held)
                held, size = held[-1:], 0
    if held:
        yield out(held)
