"""Exact substring deduplication by suffix arrays over shards (operator 1).

A string counts as repeated if it also starts earlier, in a document with a smaller id or earlier in the same one.
Sorting all suffixes of a corpus moves every byte many times, so the shards hold only what can repeat:

1. Anchors. In every window of ``length - GRAM + 1`` byte n-grams the one with the least hash is an anchor. Two equal
   strings of ``length`` bytes have their anchors at the same place, so each repeated string lies in the block
   around an anchor whose n-gram occurs elsewhere too. Only anchors are shuffled, by hash, as packed arrays.
2. Equal blocks. Blocks with the same anchor and the same bytes repeat as a whole: all but the first go. What is left
   are n-grams with several different blocks around them: the borders of repeated passages.
3. Shards. The different blocks of an n-gram meet in a shard, whose suffix array (induced sorting) and permuted
   common prefixes tell which strings of ``length`` bytes are equal; all but the earliest go.
4. Spans return to their documents, where overlapping ones merge.

Hot n-grams. A task sends equal blocks once: its later ones are decided on the spot. An n-gram with more than ``HOT``
different blocks (the border of a passage that very many documents share) is no longer brought together: its strings
are dealt by their own 128-bit digests, of which a task sends each once too. So no task holds more than ``HOT`` blocks
of an n-gram from any other task, nor more than one place of a string.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, bytes_of, keep_only, merged, partitions, ragged, rows_of, small_batches
from .merkle import _byte_values, _powers, mixed
from .suffix import common_prefixes, suffix_array

#: Bytes of the n-grams that anchors are chosen from.
GRAM = 28
#: Bytes of text hashed at a time, so that the arrays stay in a core's cache.
RUN = 1 << 18
#: Anchors a task holds before it sends them off.
HELD = 3_000_000
#: Bytes of blocks that one suffix array covers, unless one n-gram alone has more.
SHARD = 1 << 20
#: Bytes of input, as Spark estimates them, that a group of documents has.
HOME = 32 << 20
#: Different blocks of one n-gram, in a task or together, from which on its strings are dealt by digest.
HOT = 2048
ANCHOR = np.dtype([("gram", "<u8"), ("block", "<u8"), ("doc", "<i8"), ("text", "<u4"), ("at", "<i4")])
TAGGED = np.dtype([*ANCHOR.descr, ("kind", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("text", "<u4"), ("start", "<i4"), ("end", "<i4")])
STRING = np.dtype([("one", "<u8"), ("two", "<u8"), ("doc", "<i8"), ("text", "<u4"), ("start", "<i4")])
EDGE = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("text", "<u4"), ("start", "<i4"), ("size", "<i4")])


def pack(rows: np.ndarray, extra: bytes = b"") -> bytes:
    """Column after column, which compresses better than row after row."""
    return len(rows).to_bytes(8, "little") + b"".join(np.ascontiguousarray(rows[c]).tobytes() for c in rows.dtype.names) + extra


def unpack(blob: bytes, dtype: np.dtype) -> tuple[np.ndarray, bytes]:
    n, at = int.from_bytes(blob[:8], "little"), 8
    rows = np.empty(n, dtype=dtype)
    for c in dtype.names:
        rows[c] = np.frombuffer(blob, dtype[c], n, at)
        at += n * dtype[c].itemsize
    return rows, blob[at:]


def least(h: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """The least (or what ``pick`` picks) of every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        h = pick(h[:-size], h[size:])
        size *= 2
    return pick(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


_A = [np.uint64(pow(0xD1342543DE82EF95, k, 2**64)) for k in range(33)]


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after the other (``ends``: where each stops): anchors' positions, n-gram hashes and block hashes."""
    none = np.zeros(0, dtype=np.int64)
    n, width = len(data), length - GRAM + 1
    if n < length:
        return none, none.astype(np.uint64), none.astype(np.uint64)
    value = _byte_values()[data]
    two = value[:-1] * _A[1] + value[1:]
    four = two[:-2] * _A[2] + two[2:]
    eight = four[:-4] * _A[4] + four[4:]
    sixteen = eight[:-8] * _A[8] + eight[8:]
    gram = sixteen[: n - GRAM + 1] * _A[12] + (eight[16 : 16 + n - GRAM + 1] * _A[4] + four[24 : 24 + n - GRAM + 1])
    low = least(gram, width)  # by start of each string of ``length`` bytes
    starts = np.r_[0, ends[:-1]]
    for e, size in zip(ends.tolist(), (ends - starts).tolist(), strict=True):
        low[max(e - min(size, length - 1), 0) : e] = 0  # strings that would leave their text
    edge = np.zeros(width - 1, dtype=np.uint64)
    high = least(np.concatenate([edge, low, edge]), width, np.maximum)
    at = np.flatnonzero((high[: len(gram)] == gram) & (gram > 0))
    if not len(at):
        return none, none.astype(np.uint64), none.astype(np.uint64)
    text = np.searchsorted(ends, at, side="right")
    lo, hi = np.maximum(at - (width - 1), starts[text]), np.minimum(at + length, ends[text])
    power, undo = _powers(1 << max(12, (n + 1).bit_length()))
    # sums of powers over single bytes agree for strings built to that end; over mixed groups of eight they do not
    prefix = np.r_[np.uint64(0), np.cumsum(mixed(eight) * power[: n - 7])]
    block = mixed((prefix[hi - 7] - prefix[lo]) * undo[lo] + (at - lo).astype(np.uint64) * _A[5] + (hi - lo).astype(np.uint64) * _A[6])
    return at, mixed(gram[at]), block


def _scan(batches, length: int, buckets: int, most: int):
    keep_only()
    held: list[np.ndarray] = []
    count = 0

    def send():
        rows = _in_order(np.concatenate(held) if held else np.zeros(0, ANCHOR))
        if not len(rows):
            return
        new_block, new_gram, blocks = _groups(rows)
        hot = new_block & (blocks > most)
        for kind, own in ((1, rows[~new_block]), (3, rows[hot])):
            yield from _dealt(own, home_of(own["doc"], buckets), pack, kind)
        marks = rows[hot & new_gram]
        for kind, own in ((0, rows[new_block & ~hot]), (4, marks)):
            yield from _dealt(own, (own["gram"] % np.uint64(buckets)).astype(np.int64), pack, kind)

    for ids, run in rows_of(batches, RUN):
        raw = [t.encode() for t in run]
        ends = np.cumsum([len(r) for r in raw])
        at, gram, block = anchors(np.frombuffer(b"".join(raw), dtype=np.uint8), ends, length)
        if not len(at):
            continue
        own = np.empty(len(at), dtype=ANCHOR)
        text = np.searchsorted(ends, at, side="right")
        own["gram"], own["block"] = gram, block
        own["doc"] = np.array(ids, dtype=np.int64)[text]
        own["text"] = np.array([zlib.crc32(r) for r in raw], dtype=np.uint32)[text]
        own["at"] = at - np.r_[0, ends[:-1]][text]
        held.append(own)
        count += len(own)
        if count >= HELD:
            yield from send()
            held, count = [], 0
    yield from send()


BLOBS = "to int, kind int, home int, blob binary"


def _dealt(rows: np.ndarray, to: np.ndarray, packed, kind: int = 0):
    """A batch with a packed row for each target; ``home`` is the target too."""
    if not len(rows):
        return
    order = np.argsort(to, kind="stable")
    to = to[order]
    cuts = np.flatnonzero(to[1:] != to[:-1]) + 1
    targets = to[np.r_[0, cuts]].astype(np.int32)
    blobs = [packed(part) for part in np.split(rows[order], cuts)]
    yield _blobs(targets, np.full(len(targets), kind, np.int32), targets, blobs)


def _blobs(to, kind, home, blobs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(kind, pa.int32()), pa.array(home, pa.int32()), pa.array(blobs, pa.binary())], names=["to", "kind", "home", "blob"])


def home_of(doc: np.ndarray, homes: int) -> np.ndarray:
    return np.mod(np.mod(doc, 1000003), homes)


def _in_order(rows: np.ndarray) -> np.ndarray:
    """Anchors by n-gram, block, document and place; a row that stands twice in the table counts once."""
    rows = rows[np.lexsort((rows["at"], rows["text"], rows["doc"], rows["block"], rows["gram"]))]
    return rows[_changed(rows, *ANCHOR.names)] if len(rows) else rows


def _changed(rows: np.ndarray, *names: str) -> np.ndarray:
    """Whether a row differs from the one before it in any of the columns."""
    return np.r_[True, np.any([rows[c][1:] != rows[c][:-1] for c in names], axis=0)]


def _groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of anchors in order: whether a block begins, whether an n-gram begins, and how many blocks each row's n-gram has."""
    new_block, new_gram = _changed(rows, "gram", "block"), _changed(rows, "gram")
    first = np.flatnonzero(new_gram)
    return new_block, new_gram, np.repeat(np.add.reduceat(new_block.astype(np.int64), first), np.diff(np.r_[first, len(rows)]))


def _group(batches, homes: int, most: int):
    """Anchors of one part of the hash range, dealt by document: what repeats as a whole (kind 1), what borders on it (2), or does so where very much meets (3)."""
    held, marks, out = [], [], []
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            rows = unpack(blob, ANCHOR)[0]
            if kind in (1, 3):  # decided already
                out.append(_tagged(rows, kind))
            else:
                (marks if kind == 4 else held).append(rows)
    out += _grouped(held, marks, most)
    if out:
        rows = np.concatenate(out)
        yield from _dealt(rows, home_of(rows["doc"], homes), pack)


def _tagged(rows: np.ndarray, kind: int) -> np.ndarray:
    out = np.empty(len(rows), TAGGED)
    for c in ANCHOR.names:
        out[c] = rows[c]
    out["kind"] = kind
    return out


def _grouped(held: list[np.ndarray], marks: list[np.ndarray], most: int) -> list[np.ndarray]:
    if not held:
        return []
    rows, marks = np.concatenate(held), np.unique(np.concatenate([np.zeros(0, np.uint64), *(m["gram"] for m in marks)]))
    # most n-grams occur once
    order = np.argsort(rows["gram"], kind="stable")
    gram = rows["gram"][order]
    twice = gram[1:] == gram[:-1]
    rows = rows[order[np.r_[twice, False] | np.r_[False, twice] | np.isin(gram, marks)]]
    if not len(rows):
        return []
    rows = _in_order(rows)
    new_block, _, blocks = _groups(rows)
    hot = (blocks > most) | np.isin(rows["gram"], marks)
    return [_tagged(rows[chosen], kind) for kind, chosen in ((1, ~new_block), (2, new_block & (blocks > 1) & ~hot), (3, new_block & hot))]


def digests(data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the strings of ``length`` bytes at ``start``."""
    out = []
    value = _byte_values()[data]
    two = value[:-1] * _A[1] + value[1:]
    four = two[:-2] * _A[2] + two[2:]
    eight = four[:-4] * _A[4] + four[4:]
    power, undo = _powers(1 << max(12, (len(data) + 1).bit_length()))
    for salt in (np.uint64(0), np.uint64(0x9E3779B97F4A7C15)):
        prefix = np.r_[np.uint64(0), np.cumsum(mixed(eight + salt) * power[: len(eight)])]
        out.append(mixed((prefix[start + length - 7] - prefix[start]) * undo[start]))
    return out[0], out[1]


def _first_places(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings in order, and whether each is at the first place of its digest; a place that stands twice counts once."""
    rows = rows[np.lexsort((rows["start"], rows["text"], rows["doc"], rows["two"], rows["one"]))]
    rows = rows[_changed(rows, *STRING.names)]
    return rows, _changed(rows, "one", "two")


def _spans_of(rows: np.ndarray, length: int) -> np.ndarray:
    """Spans of the strings of ``length`` bytes at some places, overlapping ones merged."""
    if not len(rows):
        return np.zeros(0, SPAN)
    rows = rows[np.lexsort((rows["start"], rows["text"], rows["doc"]))]
    at = rows["start"].astype(np.int64)
    first = np.flatnonzero(np.r_[True, (rows["doc"][1:] != rows["doc"][:-1]) | (rows["text"][1:] != rows["text"][:-1]) | (at[1:] > at[:-1] + length)])
    out = np.empty(len(first), SPAN)
    out["doc"], out["text"], out["start"], out["end"] = rows["doc"][first], rows["text"][first], at[first], at[np.r_[first[1:] - 1, len(at) - 1]] + length
    return out


def _blocks(docs: pa.Table, found: pa.Table, length: int, shards: int) -> pa.Table:
    """Spans of whole repeated blocks (kind 1), the bytes of the others (2) dealt to shards by n-gram, and hot strings (3) dealt by digest."""
    width = length - GRAM + 1
    empty = pa.Table.from_batches([_blobs([], [], [], [])])
    if not found.num_rows or not docs.num_rows:
        return empty
    home = found.column("home")[0].as_py()
    rows = np.concatenate([unpack(b, TAGGED)[0] for b in found.column("blob").to_pylist()])
    rows = rows[np.lexsort((rows["text"], rows["doc"]))]
    kinds = rows["kind"]
    cuts = np.flatnonzero((rows["doc"][1:] != rows["doc"][:-1]) | (rows["text"][1:] != rows["text"][:-1])) + 1
    first = {(int(rows["doc"][i]), int(rows["text"][i])): (i, j) for i, j in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(rows)].tolist(), strict=True)}
    spans, edges, held, strings = [], [], [], []
    for doc, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True):
        raw = text.encode()
        i, j = first.pop((doc, zlib.crc32(raw)), (0, 0))
        if i == j:
            continue
        at = rows["at"][i:j].astype(np.int64)
        lo, hi = np.maximum(at - (width - 1), 0), np.minimum(at + length, len(raw))
        whole = kinds[i:j] == 1
        if whole.any():
            runs = merged(np.stack([lo[whole], hi[whole]], axis=1))
            own = np.empty(len(runs), SPAN)
            own["doc"], own["text"], own["start"], own["end"] = doc, rows["text"][i], runs[:, 0], runs[:, 1]
            spans.append(own)
        hot = kinds[i:j] == 3
        if hot.any():
            start = np.unique(ragged(lo[hot], hi[hot] - lo[hot] - length + 1))
            own = np.empty(len(start), STRING)
            own["one"], own["two"] = digests(np.frombuffer(raw, np.uint8), start, length)
            own["doc"], own["text"], own["start"] = doc, rows["text"][i], start
            strings.append(own)
        edge = kinds[i:j] == 2
        if edge.any():
            lo, hi = lo[edge], hi[edge]
            own = np.empty(len(lo), EDGE)
            own["gram"], own["doc"], own["text"], own["start"], own["size"] = rows["gram"][i:j][edge], doc, rows["text"][i], lo, hi - lo
            edges.append(own)
            held.append(np.frombuffer(raw, np.uint8)[ragged(lo, hi - lo)])
    out = []
    if strings:
        own, first = _first_places(np.concatenate(strings))
        spans.append(_spans_of(own[~first], length))
        own = own[first]
        out += _dealt(own, (own["one"] % np.uint64(shards)).astype(np.int64), pack, 3)
    if spans:
        out.append(_blobs([home % shards], [1], [home], [pack(np.concatenate(spans))]))
    if edges:
        edges, data = np.concatenate(edges), np.concatenate(held)
        offset = np.cumsum(edges["size"]) - edges["size"]
        shard = (mixed(edges["gram"]) % np.uint64(shards)).astype(np.int64)
        index = np.arange(len(edges))
        out += _dealt(index, shard, lambda own: pack(edges[own], data[ragged(offset[own], edges["size"][own].astype(np.int64))].tobytes()), 2)
    return pa.Table.from_batches(out) if out else empty


def _shard(batches, length: int, homes: int):
    edges, data, strings, out = [], [], [], []
    for batch in batches:
        for kind, home, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "home", "blob")), strict=True):
            if kind == 1:
                yield _blobs([home], [1], [home], [blob])
            elif kind == 3:
                strings.append(unpack(blob, STRING)[0])
            else:
                own, raw = unpack(blob, EDGE)
                edges.append(own)
                data.append(np.frombuffer(raw, np.uint8))
    if strings:
        own, first = _first_places(np.concatenate(strings))
        out.append(_spans_of(own[~first], length))
    if edges:
        out += _by_suffixes(np.concatenate(edges), np.concatenate(data), length)
    if out:
        spans = np.concatenate(out)
        yield from _dealt(spans, home_of(spans["doc"], homes), pack, 1)


def _by_suffixes(edges: np.ndarray, data: np.ndarray, length: int) -> list[np.ndarray]:
    """Spans to remove, by suffix arrays over blocks of some n-grams at a time."""
    out = []
    offset = np.cumsum(edges["size"].astype(np.int64)) - edges["size"]
    order = np.argsort(edges["gram"], kind="stable")
    edges, offset = edges[order], offset[order]
    grams = np.flatnonzero(np.r_[True, edges["gram"][1:] != edges["gram"][:-1]])
    bytes_before = np.r_[0, np.cumsum(edges["size"].astype(np.int64))]
    i = 0
    while i < len(grams):
        j = max(i + 1, int(np.searchsorted(bytes_before[grams], bytes_before[grams[i]] + SHARD, side="right")) - 1)
        stop = grams[j] if j < len(grams) else len(edges)
        own = edges[grams[i] : stop]
        out.append(repeated(own, data[ragged(offset[grams[i] : stop], own["size"].astype(np.int64))], length))
        i = j
    return out


def repeated(edges: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """Spans of those strings of ``length`` bytes in the blocks that another block, or the same, has at an earlier place."""
    size = edges["size"].astype(np.int64)
    start = np.cumsum(size + 1) - size - 1
    text = np.zeros(int(size.sum()) + len(size), dtype=np.int64)  # blocks end with a 0
    text[ragged(start, size)] = data.astype(np.int64) + 1
    sa = suffix_array(text)
    prefix = common_prefixes(text, sa)
    block = np.repeat(np.arange(len(size)), size + 1)
    inside = np.arange(len(text)) - start[block]
    whole = inside + length <= size[block]
    sa = sa[whole[sa]]  # a string that shares ``length`` symbols with a whole one is whole itself
    if not len(sa):
        return np.zeros(0, SPAN)
    group = np.cumsum(np.r_[True, prefix[sa[1:]] < length])
    doc, crc, at = edges["doc"][block[sa]], edges["text"][block[sa]], edges["start"][block[sa]] + inside[sa]
    order = np.lexsort((at, crc, doc, group))
    g, d, c, a = group[order], doc[order], crc[order], at[order]
    lead = np.r_[True, g[1:] != g[:-1]]
    head = np.flatnonzero(lead)[np.cumsum(lead) - 1]
    later = (d != d[head]) | (c != c[head]) | (a != a[head])  # one place may stand in several blocks
    own = np.empty(int(later.sum()), STRING)
    own["doc"], own["text"], own["start"] = d[later], c[later], a[later]
    return _spans_of(own, length)


OUT = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "spans": "array<struct<start:long,end:long>>", "kept": "binary", "kept_sha256": "string"}


def _apply(docs: pa.Table, found: pa.Table, length: int, outputs: tuple[str, ...], schema: pa.Schema) -> pa.Table:
    rows = [unpack(b, SPAN)[0] for b in found.column("blob").to_pylist()]
    rows = np.concatenate(rows) if rows else np.zeros(0, SPAN)
    rows = rows[np.lexsort((rows["text"], rows["doc"]))]
    cuts = np.flatnonzero((rows["doc"][1:] != rows["doc"][:-1]) | (rows["text"][1:] != rows["text"][:-1])) + 1
    spans = {(int(part["doc"][0]), int(part["text"][0])): part for part in np.split(rows, cuts)} if len(rows) else {}
    columns: dict[str, list] = {c: [] for c in ("doc_id", *outputs)}
    seen: set = set()
    for doc, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True):
        raw = text.encode()
        key = (doc, zlib.crc32(raw))
        own = spans.get(key)
        if key in seen and len(raw) >= length:
            runs = np.array([[0, len(raw)]])  # the row stands in the table again
        else:
            runs = merged(np.stack([own["start"], own["end"]], axis=1).astype(np.int64)) if own is not None else np.zeros((0, 2), np.int64)
        seen.add(key)
        kept = raw
        if len(runs):
            bounds = [0, *runs.ravel().tolist(), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))
        made = {"doc_id": None if doc == NULL_ID else doc, "n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": len(runs), "kept": kept}
        for c in columns:
            columns[c].append([{"start": a, "end": b} for a, b in runs.tolist()] if c == "spans" else hashlib.sha256(kept).hexdigest() if c == "kept_sha256" else made[c])
    return pa.Table.from_pydict(columns, schema=schema)


def remove_repeated(docs: DataFrame, length: int = 100, outputs: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "spans", "kept"), hot: int = HOT) -> DataFrame:
    """Of each document what stays when every string of ``length`` bytes that also starts earlier is taken out.

    Returns doc_id and, of n_bytes, n_removed, n_spans, spans, kept, kept_sha256, those named. Texts are UTF-8 bytes;
    matches never cross documents. Null texts are empty; a null doc_id comes before every other; rows with one
    doc_id count in the order of their texts' checksums, and of rows equal in both the later ones repeat the first;
    texts under ``length`` bytes stay; an empty table gives no rows; ``hot`` changes the way, not the result; columns
    besides doc_id and text, whatever their names, are not looked at.
    """
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), OUT["spans"]: pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
    schema = pa.schema([("doc_id", pa.int64()), *((c, kinds[OUT[c]]) for c in outputs)])
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return _with_spans(base, base, length, lambda d, f: _apply(d, f, length, outputs, schema), "doc_id long, " + ", ".join(f"{c} {OUT[c]}" for c in outputs), hot)


def _with_spans(base: DataFrame, rows: DataFrame, length: int, apply, schema, hot: int = HOT) -> DataFrame:
    """``apply`` on the rows and the packed spans to remove of each home; ``base``: doc_id and text without nulls."""
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} at least")
    small_batches(base.sparkSession)
    n = partitions(base.sparkSession)
    # a home's documents are worked on together: so many homes that each has about HOME bytes of them
    buckets, homes, shards = n, max(2 * n, -(-bytes_of(base) // HOME)), n
    at_home = lambda df: df.groupBy(F.pmod(F.pmod(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), F.lit(1000003)), F.lit(homes)).cast("int"))
    found = base.mapInArrow(lambda b: _scan(b, length, buckets, hot), BLOBS).repartitionById(n, "to").mapInArrow(lambda b: _group(b, homes, hot), BLOBS)
    blocks = at_home(base).cogroup(found.groupBy("home")).applyInArrow(lambda d, f: _blocks(d, f, length, shards), BLOBS)
    spans = blocks.repartitionById(n, "to").mapInArrow(lambda b: _shard(b, length, homes), BLOBS)
    return at_home(rows).cogroup(spans.groupBy("home")).applyInArrow(apply, schema)


def without_repeated(docs: DataFrame, length: int = 100) -> DataFrame:
    """The same rows and columns; ``text`` is what stays of it (see ``remove_repeated``), n_chars its code points.

    A cut within a character takes the rest of that character too. Null texts stay null, repeated rows stay with what
    they keep (nothing, from ``length`` bytes on), an empty table gives no rows, and other columns pass through.
    """
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    names = docs.columns

    def apply(table: pa.Table, found: pa.Table) -> pa.Table:
        ids = [NULL_ID if i is None else i for i in table.column("doc_id").to_pylist()]
        old = table.column("text").to_pylist()
        plain = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array([t or "" for t in old], pa.string())})
        kept = _apply(plain, found, length, ("kept",), pa.schema([("doc_id", pa.int64()), ("kept", pa.binary())])).column("kept").to_pylist()
        new = [None if t is None else k.decode(errors="ignore") for t, k in zip(old, kept, strict=True)]
        table = table.set_column(names.index("text"), table.schema.field("text"), pa.array(new, table.schema.field("text").type))
        if "n_chars" in names:
            table = table.set_column(names.index("n_chars"), table.schema.field("n_chars"), pa.array([None if t is None else len(t) for t in new], table.schema.field("n_chars").type))
        return table

    return _with_spans(base, docs, length, apply, docs.schema)
