"""BPE encoding and decoding (operator 2) and token counts (operator 7). Neither shuffles."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import keep_only, rows_of, texts


def encode_decode(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Each document's ids and their decoding: doc_id, and of n_tokens, ids, decoded, ids_sha256, decoded_sha256 those named.

    Pairs are merged by a pair occurrence index over the distinct words of a run of documents. Null and empty
    texts have no ids and decode to the empty text; repeated rows give repeated results; a null doc_id stays null; an
    empty table gives no rows; columns besides doc_id and text, whatever their names, are not looked at.
    """
    kinds = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = "doc_id long, " + ", ".join(f"{c} {kinds[c]}" for c in outputs)
    arrow = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return texts(docs).mapInArrow(lambda batches: _encode_decode(batches, path, outputs, arrow), schema)


def _memory(path: str) -> bpe.Remembered:
    if path not in _MEMORIES:
        names = {i: t for t, i in bpe.merges(path).vocab.items()} | {i: t.content for i, t in bpe.library(path).get_added_tokens_decoder().items()}

        def make(words):
            out = []
            for ids in bpe.encode_words(path, words, bpe.merge_by_pair_index):
                ids = ids.tolist()
                out.append((" ".join(map(str, ids)), " ".join(map(names.__getitem__, ids)), len(ids)))
            return out

        _MEMORIES[path] = bpe.Remembered(make, 600_000)
    return _MEMORIES[path]


#: Per worker process: by vocabulary file, what its words become.
_MEMORIES: dict[str, bpe.Remembered] = {}


def _encode_decode(batches, path, outputs, arrow):
    keep_only("encoding", _MEMORIES.clear)
    memory = _memory(path)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for ids, run in rows_of(batches, 4 << 20):
        split = [bpe.words_of(t) for t in run]
        columns: dict[str, list] = {c: [] for c in outputs}
        for words in memory.look(split):
            found = [x for x in words if x[2]]
            text = " ".join([x[0] for x in found])
            if "n_tokens" in columns:
                columns["n_tokens"].append(text.count(" ") + 1 if text else 0)
            if "ids_sha256" in columns:
                columns["ids_sha256"].append(sha(text))
            if "ids" in columns:
                columns["ids"].append([int(x) for x in text.split()])
            if "decoded" in columns or "decoded_sha256" in columns:
                decoded = " ".join([x[1] for x in found])
                if "decoded" in columns:
                    columns["decoded"].append(decoded)
                if "decoded_sha256" in columns:
                    columns["decoded_sha256"].append(sha(decoded))
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64())} | {c: pa.array(columns[c], arrow[c]) for c in outputs})


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document by rank-synchronous merging of its distinct words.

    Null and empty texts count zero; repeated rows give repeated results; a null doc_id stays null; an empty table gives
    no rows; columns besides doc_id and text, whatever their names, are not looked at.
    """
    return texts(docs).mapInArrow(lambda batches: _counts(batches, path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


_COUNTS: dict[str, bpe.Remembered] = {}


def _counts(batches, path, limit):
    keep_only("counts", _COUNTS.clear)
    if path not in _COUNTS:
        _COUNTS[path] = bpe.Remembered(lambda words: _word_counts(path, words))
    memory = _COUNTS[path]
    for ids, run in rows_of(batches):
        split = [bpe.words_of(t) for t in run]
        n = np.array(list(map(sum, memory.look(split))), dtype=np.int64)
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array([len(t.encode()) for t in run], pa.int64()), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})


def _word_counts(path: str, words: list[str]) -> list[int]:
    parts, distinct = bpe.pretokens(bpe.library(path), words)
    _, counts = bpe.merge_by_rank_rounds(bpe.merges(path), distinct)
    counts = counts.tolist()
    return [sum(1 if isinstance(p, tuple) else counts[p] for p in own) for own in parts]
