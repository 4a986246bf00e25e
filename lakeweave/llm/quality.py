"""Document quality by a byte-level convolutional network in numpy (operator 9)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_only, rows_of, slices, small_batches, texts

#: Bytes a filter spans, filters, numbers learned for a byte, bytes of a half chunk, hidden units.
WIDTH, FILTERS, CODE, HALF, HIDDEN = 4, 8, 6, 128, 12
#: How far apart the two bytes are that a filter of two taps looks at: one such filter for each distance.
APART = tuple(range(2, 34))
INPUTS = 2 * FILTERS + len(APART)
#: Labelled documents of each class that the network learns from at most, and bytes of their texts: a bounded sample by hash of the id.
SAMPLE, SAMPLE_BYTES = 1200, 24 << 20
ROUNDS = 14
#: Half chunks that are worked on at a time.
BLOCK = 4096


@dataclass
class Batch:
    """Texts as bytes, each from a half chunk's start on and filled up with zeros."""

    data: np.ndarray  # (halves, HALF)
    size: np.ndarray  # bytes of text in each half
    doc: np.ndarray  # of each half
    chunk: np.ndarray  # first half of each chunk; a chunk is two halves, or the only one
    pair: np.ndarray  # whether a chunk has a second half
    owner: np.ndarray  # document of each chunk
    heard: np.ndarray  # bytes of each half from which a filter's span ends within the document, one at least


def batch_of(texts: list[str]) -> Batch:
    raw = [t.encode() for t in texts]
    halves = np.array([max(1, -(-len(r) // HALF)) for r in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(r.ljust(h * HALF, b"\0") for r, h in zip(raw, halves.tolist(), strict=True)), np.uint8).reshape(-1, HALF)
    doc = np.repeat(np.arange(len(raw)), halves)
    start = np.cumsum(halves) - halves
    place = np.arange(len(doc)) - start[doc]
    size = np.clip(np.array([len(r) for r in raw])[doc] - place * HALF, 0, HALF)
    last = place == halves[doc] - 1
    chunk = np.flatnonzero(~last | (halves[doc] == 1))
    left = np.array([len(r) for r in raw])[doc] - place * HALF - (WIDTH - 1)
    heard = np.clip(left, (place == 0) & (size > 0), HALF)
    return Batch(data, size, doc, chunk, ~last[chunk], doc[chunk], heard)


class Network:
    """Learned filters over overlapping chunks of bytes, hidden units on them, both pooled to one probability.

    Filters of four neighbouring bytes are max-pooled, and averaged, over each chunk. Filters of two taps, n bytes apart
    for each n of APART, respond to a pair of bytes by the product of the numbers learned for these bytes; they are
    averaged over each chunk. All feed hidden units, which are max-pooled over the chunks of a document, and averaged.
    """

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.filters = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.code = rng.normal(0, 0.4, (256, CODE)).astype(np.float32)
        self.code_bias = np.zeros(1, np.float32)
        self.hidden = rng.normal(0, 0.4, (INPUTS, HIDDEN)).astype(np.float32)
        self.hidden_bias = np.zeros(HIDDEN, np.float32)
        self.out = rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)
        self.fixed = None

    def parameters(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.code, self.code_bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By byte pairs: both halves of the four-byte filters, and the response of the two-tap ones. Byte 0, which fills up documents, has none."""
        f = self.filters
        one, two = ((f[i][:, None, :] + f[i + 1][None, :, :]).reshape(65536, FILTERS) + (self.bias if i == 0 else 0) for i in (0, 2))
        pair = np.maximum(self.code @ self.code.T + self.code_bias, 0)
        pair[0], pair[:, 0] = 0, 0
        return one, two, pair.ravel()

    def responses(self, b: Batch, first: int, stop: int) -> np.ndarray:
        """Four-byte filters' responses, rectified, of the bytes of some halves with the three that follow (halves, HALF, FILTERS)."""
        flat = b.data.ravel()[first * HALF : stop * HALF + WIDTH - 1]
        n = (stop - first) * HALF
        flat = np.r_[flat, np.zeros(n + WIDTH - 1 - len(flat), np.uint8)].astype(np.uint16)
        pair = flat[:-1] << 8 | flat[1:]
        table = self.fixed or self.tables()
        z = np.take(table[0], pair[:n], axis=0)
        z += np.take(table[1], pair[2 : n + 2], axis=0)
        np.maximum(z, 0, out=z)
        z = z.reshape(-1, HALF, FILTERS)
        heard = b.heard[first:stop]
        short = np.flatnonzero(heard < HALF)
        z[short] *= (np.arange(HALF) < heard[short, None])[:, :, None]
        return z

    @staticmethod
    def apart(b: Batch):
        """For each distance the byte pairs so far apart, as numbers; and the halves whose first bytes have no such pair."""
        flat = b.data.ravel().astype(np.uint16)
        high, first = flat << 8, np.flatnonzero(np.r_[True, b.doc[1:] != b.doc[:-1]])
        for n in APART:
            yield n, np.r_[np.zeros(n, np.uint16), high[n:] | flat[:-n]], first

    def pairs(self, b: Batch) -> np.ndarray:
        """Two-tap filters' responses, summed over each half."""
        table = (self.fixed or self.tables())[2]
        out = np.empty((len(b.data), len(APART)), dtype=np.float32)
        for k, (n, pair, first) in enumerate(self.apart(b)):
            z = np.take(table, pair).reshape(-1, HALF)
            z[first, :n] = 0
            out[:, k] = z.sum(axis=1)
        return out

    def chunks(self, b: Batch) -> np.ndarray:
        """Inputs of the hidden units, by chunk: greatest and mean responses, mean pairs. Long texts are worked through in blocks."""
        sums, most = [], []
        for i in range(0, len(b.data), BLOCK):
            z = self.responses(b, i, min(i + BLOCK, len(b.data)))
            sums.append(z.sum(axis=1))
            most.append(z.max(axis=1))
        most, half = np.concatenate(most), np.concatenate([np.concatenate(sums), self.pairs(b)], axis=1)
        total = half[b.chunk] + np.where(b.pair[:, None], half[np.minimum(b.chunk + 1, len(half) - 1)], 0)
        total[:, :FILTERS] /= self.both(b, b.heard)[:, None]
        total[:, FILTERS:] /= self.both(b, b.size)[:, None]
        other = np.where(b.pair[:, None], most[np.minimum(b.chunk + 1, len(half) - 1)], 0)
        return np.concatenate([np.maximum(most[b.chunk], other), total], axis=1)

    @staticmethod
    def both(b: Batch, of: np.ndarray) -> np.ndarray:
        """Sum over a chunk's halves, one at least."""
        return np.maximum(of[b.chunk] + np.where(b.pair, of[np.minimum(b.chunk + 1, len(of) - 1)], 0), 1).astype(np.float32)

    def pool(self, b: Batch, x: np.ndarray):
        h = np.maximum(x @ self.hidden + self.hidden_bias, 0)
        first = np.flatnonzero(np.r_[True, b.owner[1:] != b.owner[:-1]])
        count = np.diff(np.r_[first, len(b.owner)])
        most = np.maximum.reduceat(h, first, axis=0)
        mean = np.add.reduceat(h, first, axis=0) / count[:, None]
        return h, count, most, mean, np.concatenate([most, mean], axis=1) @ self.out + self.out_bias[0]

    def scores(self, texts: list[str]) -> np.ndarray:
        b = batch_of(texts)
        z = self.pool(b, self.chunks(b))[-1].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def gradient(self, b: Batch, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        responses = self.responses(b, 0, len(b.data))
        x = self.chunks(b)
        h, count, most, mean, z = self.pool(b, x)
        dz = ((1 / (1 + np.exp(-np.clip(z, -60, 60))) - label) * weight).astype(np.float32)
        pooled = np.concatenate([most, mean], axis=1)
        g_out = pooled.T @ dz
        by_doc = dz[:, None] * self.out[None, :]
        doc = np.repeat(np.arange(len(count)), count)
        top = h == most[doc]
        ties = np.add.reduceat(top, np.cumsum(count) - count, axis=0)
        dh = by_doc[doc, :HIDDEN] * top / ties[doc] + by_doc[doc, HIDDEN:] / count[doc][:, None]
        dh = np.where(h > 0, dh, 0).astype(np.float32)
        g_hidden, g_hb = x.T @ dh, dh.sum(axis=0)
        dx = dh @ self.hidden.T
        # averages go to both halves of a chunk, a greatest response to the first place that has it
        means = np.concatenate([dx[:, FILTERS : 2 * FILTERS] / self.both(b, b.heard)[:, None], dx[:, 2 * FILTERS :] / self.both(b, b.size)[:, None]], axis=1)
        d_half = np.zeros((len(b.size), means.shape[1]), np.float32)
        np.add.at(d_half, b.chunk, means)
        np.add.at(d_half, b.chunk[b.pair] + 1, means[b.pair])
        d = np.repeat(d_half[:, None, :FILTERS], HALF, axis=1)
        place, best = responses.argmax(axis=1), responses.max(axis=1)
        column = np.arange(FILTERS)[None, :]
        ahead = np.minimum(b.chunk + 1, len(b.size) - 1)
        half = np.where(b.pair[:, None] & (best[ahead] > best[b.chunk]), ahead[:, None], b.chunk[:, None])
        np.add.at(d, (half, place[half, column], np.broadcast_to(column, half.shape)), dx[:, :FILTERS])
        d = np.where(responses > 0, d, 0).reshape(-1, FILTERS)
        flat = np.r_[b.data.ravel(), np.zeros(WIDTH - 1, np.uint8)]
        g_filters = np.stack([np.stack([np.bincount(flat[k : k + len(d)], weights=d[:, f], minlength=256) for f in range(FILTERS)], axis=1) for k in range(WIDTH)])
        g_pair = np.zeros(65536)
        for k, (n, pair, first) in enumerate(self.apart(b)):
            w = np.repeat(d_half[:, FILTERS + k], HALF).reshape(-1, HALF)
            w[first, :n] = 0
            g_pair += np.bincount(pair, weights=w.ravel(), minlength=65536)
        g_pair = (g_pair * (self.tables()[2] > 0)).reshape(256, 256)
        return [g_filters, d.sum(axis=0), (g_pair + g_pair.T) @ self.code, np.array([g_pair.sum()]), g_hidden, g_hb, g_out, dz.sum(keepdims=True)]

    def fit(self, texts: list[str], labels: list[int], rounds: int = ROUNDS, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        label = np.array(labels, dtype=np.float32)
        share = label.mean()
        weight = np.where(label > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        groups = [order[i::24] for i in range(min(24, len(order)))]  # each with short and long ones
        made = []
        for own in groups:
            made.append((batch_of([texts[i] for i in own]), label[own], weight[own] / len(own)))
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        step = 0
        for r in range(rounds):
            for k in rng.permutation(len(made)).tolist():
                step += 1
                for p, g, (m, v) in zip(self.parameters(), self.gradient(*made[k]), state, strict=True):
                    g = g.astype(np.float32) + decay * p
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.99
                    v += 0.01 * g * g
                    p -= rate / (1 + r / 6) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        self.fixed = self.tables()
        return self


def held_out(doc_id: Column) -> Column:
    """Whether a row's label must not be learnt from: crc32 of the id as text is divisible by 5. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | float:
    """The network, fitted on at most ``sample`` labelled documents of each class and SAMPLE_BYTES of their whole texts; or the only class's label, or 0.5 without labels.

    Null labels and others than 0 and 1 teach nothing; of several labels of an id the least counts; rows that repeat an
    id are all learnt from.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = [usable.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    ids = [(r.doc_id, r.quality) for df in some for r in df.collect()]  # two samples at most
    if not ids:
        return 0.5
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, quality int")
    so_far = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0)
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").withColumn("bytes", F.sum(F.octet_length("text")).over(so_far)).filter(F.col("bytes") <= SAMPLE_BYTES).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    classes = {r.quality for r in rows}
    if len(classes) < 2:
        return float(classes.pop()) if classes else 0.5
    return Network().fit([r.text for r in rows], [r.quality for r in rows])


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from ``threshold`` on) of each document.

    The whole text is read, in chunks that overlap by half; labels, lang, source and doc_id are no inputs. Null and
    empty texts are scored as a chunk of no bytes. Without labels every score is 0.5, with one class it is that label.
    A null doc_id counts as held out; repeated rows give repeated results; an empty table gives no rows; other columns,
    whatever their names, are not looked at.
    """
    network = train(docs, labels, sample)

    def run(batches):
        keep_only()
        for ids, run in rows_of(batches, 1 << 19):
            z = network.scores(run) if isinstance(network, Network) else np.full(len(run), network)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "score": pa.array(z)})

    found = texts(docs).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The rows that are not rejected, with all their columns, whatever their names. Nothing is shuffled but the sample.

    Null and empty texts are scored like any other; repeated rows are kept or go together; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    network = train(docs, labels, sample)
    at = docs.columns.index("text")

    def run(batches):
        keep_only()
        for batch in batches:
            keep: list[bool] = []
            column = batch.column(at)
            for start, stop in slices(column, 1 << 19):
                some = [t or "" for t in column.slice(start, stop - start).to_pylist()]
                z = network.scores(some) if isinstance(network, Network) else np.full(len(some), network)
                keep += (z >= threshold).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
