"""Near-duplicate documents by SimHash and covering locality-sensitive hashing (operator 5)."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, cut, partitions, rows_of, texts
from .components import components

#: A-Z to a-z, byte by byte.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, shingle: int = 3) -> int:
    """64 bits, each set if it is in more than half of the shingles' XXH64 values (seed 42), repeats included."""
    hashes = _hashes(text, shingle)
    return int(_majority(np.array(hashes, dtype=np.uint64), np.array([len(hashes)]))[0])


def _hashes(text: str, shingle: int) -> list[int]:
    words = text.encode().translate(LOWER).split()
    if not words:
        return []
    if len(words) < shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    return list(map(_XXH, map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))))


_XXH = partial(xxhash.xxh64_intdigest, seed=42)


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each run of hashes, the bits that are set in more than half of it."""
    out = np.zeros(len(counts), dtype=np.uint64)
    at = 0
    for i, n in enumerate(counts.tolist()):
        if n:
            own = hashes[at : at + n]
            total = np.zeros(64, dtype=np.int64)
            for j in range(0, n, 1 << 16):
                total += np.unpackbits(own[j : j + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * total > n, bitorder="little").view("<u8")[0]
            at += n
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of each document. Texts without words have zero."""

    def run(batches):
        for ids, run in rows_of(batches, 2 << 20):
            found, counts = [], []
            for text in run:
                own = _hashes(text, shingle)
                found += own
                counts.append(len(own))
            bits = _majority(np.array(found, dtype=np.uint64), np.array(counts, dtype=np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "fp": pa.array(bits.view(np.int64))})

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """Bit masks of which, for any set of ``radius`` bits, one leaves the whole set out.

    Each bit gets a vector of radius + 1 bits; mask v holds the bits whose vectors have an odd product with v. The
    vectors of any ``radius`` bits leave some v other than zero with even products only.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.integers(1, 1 << (radius + 1), 64)
    return [sum(1 << i for i in range(64) if bin(int(vectors[i]) & v).count("1") % 2) for v in range(1, 1 << (radius + 1))]


#: Shares of all rows from which a fingerprint's documents are not shuffled to one task.
HOT_SHARE = 1024
#: Values of a bucket from which the bucket is dealt anew, by the parts of the bits in which its values can differ.
SPLIT = 50_000
#: Values that are compared one by one; more are first told apart by parts of their free bits.
COMPARED = 1024


def parts_of(free: int, radius: int) -> list[int]:
    """The bits of ``free`` dealt to radius + 1 parts: values that differ in ``radius`` of them agree in one part."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    return [sum(bits[i :: radius + 1]) for i in range(radius + 1)]


def linked(values: np.ndarray, radius: int, free: int, compared: int = COMPARED) -> list[tuple[int, int]]:
    """Links that connect exactly those of the distinct ``values`` that steps of ``radius`` differing bits connect.

    ``free``: the bits in which they can differ. A tree for each connected set, not all of its pairs. What is more than
    ``compared`` is split by each of radius + 1 parts of the free bits, in one of which any two near values agree, so
    that the work follows the number of values and not its square.
    """
    if len(values) > compared and bin(free).count("1") > radius:
        out = []
        for part in parts_of(free, radius):
            key = values & np.uint64(part)
            order = np.argsort(key, kind="stable")
            own, key = values[order], key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(own)], strict=True):
                if j - i > 1:
                    out += linked(own[i:j], radius, free & ~part, compared)
        return out
    out = []
    rest = np.sort(values)
    while len(rest) > 1:
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            hit = np.zeros(len(rest), dtype=bool)
            for i in range(0, len(front), 64):
                hit |= (np.bitwise_count(front[i : i + 64, None] ^ rest[None, :]) <= radius).any(axis=0)
            out += [(int(root), int(x)) for x in rest[hit]]
            front, rest = rest[hit], rest[~hit]
    return out


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def links(distinct: DataFrame, radius: int = 3, split: int = SPLIT) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect what differs in ``radius`` bits or fewer.

    One table for each mask; fingerprints that agree under it meet, and are compared there. Buckets come sorted out
    of the shuffle and are worked off one by one. A bucket of more than ``split`` fingerprints (or a 2048th of all, so
    that the broadcast list of them has 32,000 rows at most) is dealt to radius + 1 times as many, by parts of the bits
    that its mask leaves free; any two near ones still meet in one of these.
    """
    spark = distinct.sparkSession
    masks = covering_masks(radius)
    tables = F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for i, m in enumerate(masks)))
    dealt = distinct.select("fp", F.explode(tables).alias("t")).select("t.mask", "t.key", "fp")
    n = distinct.count()
    large = max(split, n // 2048)
    hot = cut(dealt.groupBy("mask", "key").count().filter(F.col("count") > large).select("mask", "key", F.lit(True).alias("hot"))) if n > large else None
    if hot is not None and hot.limit(1).count():
        keys = F.array(*(F.array(*(F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(p)).cast("long")).alias("more")) for k, p in enumerate(parts_of(2**64 - 1 & ~m, radius)))) for m in masks))
        whole = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("more")))
        dealt = dealt.join(F.broadcast(hot), ["mask", "key"], "left").select("mask", "key", F.explode(F.when(F.col("hot"), F.element_at(keys, F.col("mask") + 1)).otherwise(whole)).alias("p"), "fp").select("mask", "key", "p.part", "p.more", "fp")
    else:
        dealt = dealt.select("mask", "key", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("more"), "fp")
    names = ("mask", "key", "part", "more", "fp")
    dealt = dealt.repartition(partitions(spark), "mask", "key", "part", "more").sortWithinPartitions(*names)

    def run(batches):
        held = [np.zeros(0, dtype=np.int64) for _ in names]
        for batch in batches:
            held = [np.r_[old, batch.column(c).to_numpy()] for old, c in zip(held, names, strict=True)]
            first = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in held[:4]], axis=0)]) if len(held[0]) else np.zeros(0, dtype=np.int64)
            if len(first) > 1:  # the last bucket may go on
                yield _within(held, first, radius, masks)
                held = [c[first[-1] :] for c in held]
        if len(held[0]):
            yield _within(held, np.array([0, len(held[0])]), radius, masks)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _within(held, first, radius, masks) -> pa.RecordBatch:
    mask, _, part, _, fp = held
    found = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i > 1:
            free = 2**64 - 1 & ~masks[mask[i]]
            if part[i] >= 0:
                free &= ~parts_of(free, radius)[part[i]]
            found += linked(fp[i:j].view(np.uint64), radius, free)
    pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp, fingerprint (hex) and component_id: the smallest doc_id that links of ``radius`` bits or fewer reach.

    Null and empty texts, and those without words, have fingerprint zero and are linked like any other. Repeated
    rows, and rows of one doc_id with several texts, stay; a null doc_id is reached like others but names a component
    only if that holds no other id (component_id is null then). An empty table gives no rows. Columns besides doc_id
    and text, whatever their names, are not looked at.
    """
    found = cut(fingerprints(docs, shingle))
    # a class is known by its least id, a null one last, then by its fingerprint: so no two classes are alike
    name = F.struct(F.min("doc_id").isNull().alias("no_id"), F.coalesce(F.min("doc_id"), F.lit(0)).alias("id"), F.col("fp"))
    classes = cut(found.groupBy("fp").agg(F.count("*").alias("n"), name.alias("name")))
    edges = links(classes.select("fp"), radius)
    one, other = (classes.select(F.col("fp").alias(c), F.col("name").alias(f"name_{c}")) for c in "ab")
    labels = components(edges.join(one, "a").join(other, "b").select(F.col("name_a").alias("a"), F.col("name_b").alias("b")))
    labels = labels.select(F.col("node.fp").alias("fp"), F.col("component").alias("label"))
    known = classes.join(labels, "fp", "left").select("fp", F.coalesce("label", "name").alias("label"), "n")
    known = cut(known.select("fp", F.when(~F.col("label.no_id"), F.col("label.id")).alias("component_id"), "n"))
    # fingerprints that more than a 1024th of the rows have: 1023 of them at most, so they are broadcast and not gathered
    large = found.count() // HOT_SHARE
    hot = F.broadcast(known.filter(F.col("n") > large).drop("n"))
    rest = found.join(hot.select("fp"), "fp", "left_anti").join(known.filter(F.col("n") <= large).drop("n"), "fp")
    return found.join(hot, "fp").unionByName(rest).select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
