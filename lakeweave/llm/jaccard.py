"""Near copies by the exact Jaccard similarity of word shingles, among what SimHash fingerprints, bands of minima or windows bring together.

A SimHash of 64 bits differs in about ten bits at a similarity of 0.8, which no covering tables of a bearable number
reach (2**(radius + 1) - 1 masks). So the covering tables of ``simhash`` give the close candidates, and bands of minima
most of the others. What both miss is found by windows, of which any two similar sets share one for certain. For all
candidates the shingles themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, keep_only, partitions, ragged, rows_of, slices, texts
from .components import components
from .simhash import _hashes, _majority, links

#: Independent fingerprints of a text, each of so many minima. At a similarity of 0.8, 0.9996 of the pairs share one; windows find the rest.
BANDS, MINIMA = 20, 5
_RNG = np.random.default_rng(11)
_A = (_RNG.integers(0, 1 << 31, BANDS * MINIMA, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * MINIMA, dtype=np.uint32)


def shingles(text: str, shingle: int = 5) -> np.ndarray:
    """The distinct shingles' hashes, sorted. Fewer words than a shingle are one; no words, none."""
    return np.unique(np.array(_hashes(text, shingle), dtype=np.uint64))


def bands(own: np.ndarray) -> list[int]:
    """A signed long for each band: of the minima of the hashes under the band's functions."""
    if not len(own):
        return []
    low = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * MINIMA, 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(least, (_A[:, None] * low[None, i : i + 2048] + _B[:, None]).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(x.tobytes()) - 2**63 for x in least.reshape(BANDS, MINIMA)]


def parity(own: np.ndarray) -> bytes:
    """One bit for each remainder of the hashes, set where their number is odd: as many bits as hashes, up to a power of two.

    Each hash that only one of two sets has changes one bit, so the sets differ in no fewer hashes than in bits.
    """
    bits = max(64, 1 << max(0, len(own) - 1).bit_length())
    return np.packbits((np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, words: int) -> np.ndarray:
    """The parity of fewer remainders: ``words`` times 64."""
    out = np.frombuffer(bits, dtype="<u8")
    while len(out) > words:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def width(least: float) -> int:
    """Hashes in a window: two, or one where a similarity of ``least`` does not warrant a shared pair."""
    return 2 if least > 0.5 else 1


def windows(own: np.ndarray, least: float = 0.8) -> np.ndarray:
    """Keys of which any two different sets share one if their similarity is ``least`` or more.

    Let the hashes lie on a circle in ascending order, and a window be w that follow each other. Where two sets of a
    and b hashes share I and differ in D = a + b - 2 I, each of the D spoils w - 1 windows at most, so I - (w - 1) D
    are shared. I >= least (a + b) / (1 + least) and b >= least a make that (w least - w + 1) a or more. Of the a
    windows in the order of their keys, so many can then be left out but one, and the rests still share a key.
    """
    w = width(least)
    keys = own
    for k in range(1, w):
        keys = _mixed(keys) + np.roll(own, -k)
    keys = np.sort(_mixed(keys))
    return keys[: len(own) - int(np.ceil((w * least - w + 1) * len(own) - 1e-6)) + 1]


def handle(own: np.ndarray) -> int:
    """A signed long for a set; sets that share one are told apart later."""
    return xxhash.xxh64_intdigest(own.tobytes()) - 2**63


def sketches(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """Of each row doc_id, digest (of the text), content (a digest of its shingles' set), handle, size and parity of that
    set, fp (the shingles' SimHash, repeats included) and bands."""

    def run(batches):
        keep_only()
        for batch in batches:
            digests = batch.column("digest").to_pylist()
            at = 0
            for ids, run in rows_of(iter([batch]), 2 << 20):
                sets, handles, sizes, odd, prints, found = [], [], [], [], [], []
                for text in run:
                    every = np.array(_hashes(text, shingle), dtype=np.uint64)
                    own = np.unique(every)
                    sets.append(xxhash.xxh3_128_digest(own.tobytes()))
                    handles.append(handle(own))
                    sizes.append(len(own))
                    odd.append(parity(own))
                    prints.append(_majority(every, np.array([len(every)]))[0])
                    found.append(bands(own))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "digest": pa.array(digests[at : at + len(run)], pa.string()), "content": pa.array(sets, pa.binary()), "handle": pa.array(handles, pa.int64()), "size": pa.array(sizes, pa.int64()), "parity": pa.array(odd, pa.binary()), "fp": pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), "bands": pa.array(found, pa.list_(pa.int64()))})
                at += len(run)

    return texts(docs).withColumn("digest", F.md5("text")).mapInArrow(run, "doc_id long, digest string, content binary, handle long, size long, parity binary, fp long, bands array<long>")


#: Windows that one task sorts at a time, about; sets of a window that are compared in one task, larger ones are dealt in blocks.
SORTED, MET = 1 << 20, 4096


def sharing(docs: DataFrame, shingle: int, least: float, buckets: int) -> DataFrame:
    """(key, handle): windows that several sets have, a row for each of these.

    Windows go to ``buckets`` by their keys, packed: six bytes of the key and two that name one of the run's sets.
    """
    n = partitions(docs.sparkSession)

    def deal(batches):
        keep_only()
        for batch in batches:
            column = batch.column("text")
            for start, stop in slices(column, 8 << 20):
                sets: dict[int, np.ndarray] = {}
                for text in column.slice(start, stop - start).to_pylist():
                    own = shingles(text, shingle)
                    if len(own):
                        sets.setdefault(handle(own), own)
                names = list(sets)
                for i in range(0, len(names), 1 << 16):
                    own = np.array(names[i : i + (1 << 16)], dtype=np.int64)
                    keys = [windows(sets[x], least) for x in own.tolist()]
                    at = np.repeat(np.arange(len(own), dtype=np.uint16), [len(k) for k in keys])
                    keys = np.concatenate(keys)
                    bucket = ((keys & np.uint64(0xFFFF)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int32)
                    order = np.argsort(bucket, kind="stable")
                    keys, at, bucket = keys[order] >> np.uint64(16), at[order], bucket[order]
                    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                    packed = keys.view(np.uint8).reshape(-1, 8)[:, :6]
                    out = {"bucket": bucket[first].tolist(), "keys": [], "at": [], "sets": []}
                    for j, k in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
                        used, local = np.unique(at[j:k], return_inverse=True)
                        out["keys"].append(packed[j:k].tobytes())
                        out["at"].append(local.astype(np.uint16).tobytes())
                        out["sets"].append(own[used].tobytes())
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array(out["bucket"], pa.int32()), **{c: pa.array(out[c], pa.binary()) for c in ("keys", "at", "sets")}})

    def meet(batches):
        for (bucket,), rows in grouped(batches, ["bucket"]):
            keys = np.zeros((sum(len(r[1]) for r in rows) // 2, 8), dtype=np.uint8)
            keys[:, :6] = np.frombuffer(b"".join(r[0] for r in rows), dtype=np.uint8).reshape(-1, 6)
            keys = keys.view("<u8").ravel()
            own = np.concatenate([np.frombuffer(r[2], dtype=np.int64)[np.frombuffer(r[1], dtype=np.uint16)] for r in rows])
            order = np.lexsort((own, keys))
            keys, own = keys[order], own[order]
            new = np.r_[True, (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])]
            keys, own = keys[new], own[new]
            same = keys[1:] == keys[:-1]
            several = np.r_[same, False] | np.r_[False, same]
            named = (keys[several] << np.uint64(16)) | np.uint64(bucket)
            for i in range(0, len(named), 1 << 16):
                yield pa.RecordBatch.from_pydict({"key": pa.array(named[i : i + (1 << 16)].view(np.int64)), "handle": pa.array(own[several][i : i + (1 << 16)])})

    dealt = texts(docs).select("text").mapInArrow(deal, "bucket int, keys binary, at binary, sets binary")
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "key long, handle long")


def missed(docs: DataFrame, classes: DataFrame, met: DataFrame, shingle: int, least: float, most: int = MET) -> DataFrame:
    """(a, b): sets of different candidates (``met``: set, candidate; a set alone is one) that can be ``least`` similar.

    Similar sets share a window; by size and parity nearly all others that share one go. A window of more than ``most``
    sets is dealt in blocks, each of which meets each other.
    """
    n = partitions(docs.sparkSession)
    total = classes.agg(F.sum("size")).first()[0] or 0
    share = 1 - (width(least) * least - width(least) + 1)
    buckets = min(1 << 16, max(n, int(total * share) // SORTED + 1))
    known = classes.select("handle", "set").join(met, "set", "left").select("handle", "set", F.coalesce("candidate", "set").alias("candidate"))
    rows = cut(sharing(docs, shingle, least, buckets).join(known, "handle").select("key", "set", "candidate"))
    mixed = rows.groupBy("key").agg(F.min("candidate").alias("one"), F.max("candidate").alias("other"), F.ceil(F.count("*") / most).cast("int").alias("parts")).filter("one <> other").select("key", "parts")
    own = F.pmod(F.xxhash64("set"), F.col("parts")).cast("int")
    dealt = rows.join(mixed, "key").withColumn("own", own).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.join(classes.select("set", "size", "parity"), "set").select("key", F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"), "own", "set", "candidate", "size", "parity")

    def within(batches):
        for (_, i, j), rows in grouped(batches, ["key", "i", "j"]):
            yield _pairs(*bounded(rows, least, across=i != j), names="ab")

    return dealt.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(within, "a long, b long").distinct()


def bounded(rows: list[tuple], least: float, across: bool = False) -> tuple[list, list]:
    """Sets of different candidates whose sizes and parities allow a similarity of ``least``; ``across``: of different blocks.

    A row: (block, set, candidate, size, parity).
    """
    rows = sorted(rows, key=lambda r: r[3])
    block, names, candidates, sizes = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(4))
    words = np.array([len(r[4]) // 8 for r in rows])
    left, right = [], []
    for m in np.unique(words).tolist():
        at = np.flatnonzero((words >= m) & (sizes * least <= sizes[words == m].max() + 1e-9))
        table = np.stack([folded(rows[x][4], m) for x in at.tolist()])
        for k in range(int((words == m).sum())):
            x, rest = at[k], at[k + 1 :]
            fit = (sizes[x] >= least * sizes[rest] - 1e-9) & (candidates[rest] != candidates[x])
            if across:
                fit &= block[rest] != block[x]
            hit = np.flatnonzero(fit)
            if len(hit):
                differ = np.bitwise_count(table[k + 1 + hit] ^ table[k]).sum(axis=1, dtype=np.int64)
                near = names[rest[hit[differ <= (sizes[x] + sizes[rest[hit]]) * (1 - least) / (1 + least) + 1e-6]]].tolist()
                left += [int(names[x])] * len(near)
                right += near
    return left, right


class Sets:
    """Shingle sets as one flat array of codes, for counting what one shares with many."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        known, self.codes = np.unique(np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64), return_inverse=True)
        self.ends = np.cumsum(self.sizes)
        self.has = np.zeros(len(known), dtype=bool)

    def near(self, x: int, others: np.ndarray, least: float) -> np.ndarray:
        """Which of ``others`` are at ``least`` similar to ``x``."""
        own = self.codes[self.ends[x] - self.sizes[x] : self.ends[x]]
        size = self.sizes[others]
        fit = (np.minimum(size, len(own)) >= least * np.maximum(size, len(own)) - 1e-9) & (size > 0)
        out = (size == 0) & (len(own) == 0)
        at = others[fit]
        if len(at):
            self.has[own] = True
            n = self.sizes[at]
            shared = np.add.reduceat(self.has[self.codes[ragged(self.ends[at] - n, n)]], np.cumsum(n) - n, dtype=np.int64)
            self.has[own] = False
            out[fit] = shared >= least * (n + len(own) - shared) - 1e-9
        return out


def alike(sets: list[np.ndarray], least: float = 0.8) -> list[int]:
    """For each of the sets a number: the first of those that steps of a Jaccard similarity of ``least`` or more reach."""
    label = np.full(len(sets), -1)
    own = Sets(sets)
    rest = np.arange(len(sets))
    while len(rest):
        root, rest = int(rest[0]), rest[1:]
        label[root] = root
        front = [root]
        while front and len(rest):
            near = own.near(front.pop(), rest, least)
            label[rest[near]] = root
            front += rest[near].tolist()
            rest = rest[~near]
    return label.tolist()


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[list, list]]:
    """(values of the last columns) of rows that come sorted by ``keys``, a group at a time: rows as tuples."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
            key = row[: len(keys)]
            if key != now and rows:
                yield now, rows
                rows = []
            now = key
            rows.append(row[len(keys) :])
    if rows:
        yield now, rows


def _pairs(left: list, right: list, names: tuple | str = ("set", "label")) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(names, (pa.array(left, pa.int64()), pa.array(right, pa.int64())), strict=True)))


#: Sets of a candidate group that one task compares; larger groups are dealt to several.
TOGETHER = 2000
#: Of a larger group, sets that stand in each of its parts: those that share bands with most others.
LEADERS = 8


def verified(asked: DataFrame, shingle: int, least: float, together: int = TOGETHER) -> DataFrame:
    """(set, label): sets, and which of its candidate group's classes by steps of a similarity of ``least`` each is in.

    ``asked``: (candidate, set, score, text), a row a set. A group of up to ``together`` sets is compared in one task. A
    larger one is dealt to parts, in each of which its LEADERS of the highest score stand too, so that what is like a
    leader is linked across the parts. What is then not in the group's largest class meets every part's sets in blocks
    of its own, also where another leader reaches it: no link between classes is left out, and no task holds more than
    two blocks.
    """
    n = partitions(asked.sparkSession)
    sizes = asked.groupBy("candidate").agg(F.count("*").alias("n"))
    large = cut(sizes.filter(F.col("n") > together).withColumn("parts", F.ceil(F.col("n") / together).cast("int")))

    def within(batches):
        for _, rows in grouped(batches, ["candidate", "part"]):
            rows = sorted(set(rows))  # leaders first
            names = [r[1] for r in rows]
            yield _pairs(names, [names[i] for i in alike([shingles(r[2], shingle) for r in rows], least)])

    def of_parts(rows: DataFrame) -> DataFrame:
        return rows.select("candidate", "part", "follows", "set", "text").repartition(n, "candidate", "part").sortWithinPartitions("candidate", "part").mapInArrow(within, "set long, label long")

    none = F.lit(0).alias("part"), F.lit(True).alias("follows")
    if not large.limit(1).count():
        return of_parts(asked.select("*", *none))
    in_large = asked.join(large, "candidate")
    first = Window.partitionBy("candidate").orderBy(F.desc("score"), "set")
    leaders = cut(in_large.select("candidate", "set", "score").withColumn("k", F.row_number().over(first)).filter(F.col("k") <= LEADERS).select("candidate", "set", F.lit(True).alias("leads")))
    dealt = cut(in_large.join(leaders, ["candidate", "set"], "left").withColumn("own", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int")))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    parts = dealt.withColumn("part", F.explode(F.when(F.col("leads"), every).otherwise(F.array("own")))).withColumn("follows", F.col("leads").isNull())
    small = asked.join(large.select("candidate"), "candidate", "left_anti").select("*", *none)
    found = cut(of_parts(small.select("candidate", "set", "text", "part", "follows").unionByName(parts.select("candidate", "set", "text", "part", "follows"))))
    reached = dealt.filter("leads is null").join(_classes(found).withColumnRenamed("label", "class"), "set", "left").withColumn("class", F.coalesce("class", "set"))
    reached = cut(reached)
    biggest = reached.groupBy("candidate", "class").count().groupBy("candidate").agg(F.max_by("class", F.struct("count", "class")).alias("class"))
    alone = cut(reached.join(biggest, ["candidate", "class"], "left_anti").drop("class"))
    if not alone.limit(1).count():
        return _classes(found)
    counts = alone.groupBy("candidate").agg(F.ceil(F.count("*") / together).cast("int").alias("blocks"))
    asking = alone.join(counts, "candidate").withColumn("block", F.pmod(F.xxhash64("set", F.lit(1)), F.col("blocks")).cast("int")).withColumn("part", F.explode(every))
    others = dealt.join(counts, "candidate").withColumn("part", F.col("own")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def across(batches):
        for _, rows in grouped(batches, ["candidate", "part", "block"]):
            names, asks = [r[1] for r in rows], np.array([r[0] for r in rows])
            own = Sets([shingles(r[2], shingle) for r in rows])
            right = np.flatnonzero(~asks)
            left, to = [], []
            for x in np.flatnonzero(asks).tolist():
                near = right[own.near(x, right, least)].tolist()
                left += [names[x]] * len(near)
                to += [names[i] for i in near]
            yield _pairs(left, to)

    both = asking.select("candidate", "part", "block", F.lit(True).alias("asks"), "set", "text").unionByName(others.select("candidate", "part", "block", F.lit(False).alias("asks"), "set", "text"))
    more = both.repartition(n, "candidate", "part", "block").sortWithinPartitions("candidate", "part", "block").mapInArrow(across, "set long, label long")
    return _classes(found.unionByName(more))


def _classes(pairs: DataFrame) -> DataFrame:
    return components(pairs.select(F.col("set").alias("a"), F.col("label").alias("b"))).select(F.col("node").alias("set"), F.col("component").alias("label"))


def one_of_each(docs: DataFrame, shingle: int = 5, least: float = 0.8, radius: int = 3, together: int = TOGETHER) -> DataFrame:
    """The rows with all their columns, exactly one of each group that steps of a similarity of ``least`` or more connect.

    A row is known by its doc_id and its text: the one with the smallest doc_id stays, one without an id only where its
    group holds none, then the one with the smallest digest. Texts without words, null and empty ones among them, are
    copies of each other; rows of one doc_id with different texts are different documents. Other columns may have any
    names but ``_digest``. An empty table gives no rows. ``together`` changes the way, not the result.

    Candidates are fingerprints within ``radius`` bits (covering tables), sets that share a band with others, and sets
    that share a window and by size and parity can be similar, directly or by steps; the exact similarity decides.
    """
    found = cut(sketches(docs, shingle))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("digest"))
    same = ("handle", "size", "parity", "fp", "bands")  # fp: of repeats too, so that of any of the rows
    classes = cut(found.groupBy("content").agg(F.min(row).alias("best"), *(F.first(c).alias(c) for c in same)).drop("content").withColumn("set", F.monotonically_increasing_id()))
    keys = classes.select("set", F.posexplode("bands").alias("band", "key"))
    first = keys.groupBy("band", "key").agg(F.min("set").alias("root"), F.count("*").alias("n")).filter("n > 1")
    shared = cut(keys.join(first, ["band", "key"]).select("set", "root", "n"))
    prints = cut(classes.groupBy("fp").agg(F.min("set").alias("root")))
    close = links(prints.select("fp"), radius)
    one, other = (prints.select(F.col("fp").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    edges = shared.select(F.col("set").alias("a"), F.col("root").alias("b"))
    edges = edges.unionByName(classes.join(prints, "fp").select(F.col("set").alias("a"), F.col("root").alias("b")))
    edges = edges.unionByName(close.join(one, "a").join(other, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    met = cut(components(edges).select(F.col("node").alias("set"), F.col("component").alias("candidate")))
    more = cut(missed(docs, classes, met, shingle, least))
    if more.limit(1).count():
        steps = met.select(F.col("set").alias("a"), F.col("candidate").alias("b")).unionByName(more)
        met = cut(components(steps).select(F.col("node").alias("set"), F.col("component").alias("candidate")))
    scores = shared.groupBy("set").agg(F.sum("n").alias("score"))
    asked = classes.join(met, "set").join(scores, "set", "left").select("candidate", "set", F.coalesce("score", F.lit(0)).alias("score"), F.col("best.doc_id").alias("own_id"), F.col("best.digest").alias("digest"))
    keyed = texts(docs).withColumn("digest", F.md5("text"))
    dealt = asked.join(keyed, (asked["digest"] == keyed["digest"]) & asked["own_id"].eqNullSafe(keyed["doc_id"])).select("candidate", "set", "score", "text").dropDuplicates(["candidate", "set"])
    labels = cut(verified(cut(dealt), shingle, least, together))
    kept = classes.join(labels, "set", "left").groupBy(F.coalesce("label", "set").alias("label")).agg(F.min("best").alias("best"))
    kept = kept.select(F.col("best.doc_id").alias("kept_id"), F.col("best.digest").alias("kept_digest"))
    counts = found.groupBy("doc_id", "digest").count()
    kept = cut(kept.join(counts, kept["kept_id"].eqNullSafe(counts["doc_id"]) & (kept["kept_digest"] == counts["digest"])).select("kept_id", "kept_digest", "count"))
    out = docs.withColumn("_digest", F.md5(F.coalesce("text", F.lit(""))))
    own = lambda k: out.join(k, out["doc_id"].cast("long").eqNullSafe(k["kept_id"]) & (out["_digest"] == k["kept_digest"]), "left_semi")
    if kept.filter("count > 1").limit(1).count():
        out = own(kept.filter("count = 1")).unionByName(own(kept.filter("count > 1")).dropDuplicates(["doc_id", "_digest"]))
    else:
        out = own(kept)
    return out.drop("_digest")
