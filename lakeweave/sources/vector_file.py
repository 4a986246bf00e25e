"""VECT version 2 files: a header of ten 32-bit numbers, the document's id, an index of sections, and float vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: little-endian u32 magic, version, index numbers a section.
MAGIC, VERSION, INDEX = 0x56454354, 2, 3
ROWS = "document_id string, section int, range_start long, range_end long, vec int, vector array<float>"


def encode(document_id: str, sections: list[tuple[int, int, list[list[float]]]]) -> bytes:
    """Bytes of a document: sections are (start, end, vectors)."""
    name = document_id.encode()
    name += b"\0" * (-len(name) % 4)
    index = np.array([(a, b, len(v)) for a, b, v in sections], dtype="<u4").reshape(-1, INDEX)
    vectors = np.array([x for _, _, v in sections for x in v], dtype="<f4")
    dim = vectors.shape[1] if vectors.size else 0
    head = np.array([MAGIC, VERSION, INDEX, dim, len(sections), len(vectors), index.nbytes, vectors.nbytes, len(document_id.encode()), 0], dtype="<u4")
    return head.tobytes() + name + index.tobytes() + vectors.tobytes()


def decode(data: bytes) -> tuple[str, np.ndarray, np.ndarray]:
    """(document id, index by section, vectors); the arrays are views of ``data``."""
    head = np.frombuffer(data, "<u4", 10).tolist()
    if head[0] != MAGIC or head[1] != VERSION or head[2] != INDEX:
        raise ValueError("not a VECT version 2 file")
    _, _, _, dim, sections, total, n_index, n_vectors, n_name, _ = head
    at = 40 + n_name + -n_name % 4
    index = np.frombuffer(data, "<u4", n_index // 4, at).reshape(sections, INDEX)
    vectors = np.frombuffer(data, "<f4", n_vectors // 4, at + n_index).reshape(total, dim)
    return data[40 : 40 + n_name].decode(), index, vectors


def offsets(counts: np.ndarray) -> np.ndarray:
    """Where each section's vectors start."""
    return np.cumsum(counts) - counts


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each vector of the .bin files in a path, folders included. One length of vectors throughout, or an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.bin").load(path).select("content")

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                name, index, vectors = decode(content)
                section = np.repeat(np.arange(len(index)), index[:, 2])
                n = len(section)
                yield pa.RecordBatch.from_pydict({"document_id": pa.array([name] * n), "section": pa.array(section, pa.int32()), "range_start": pa.array(index[section, 0].astype(np.int64)), "range_end": pa.array(index[section, 1].astype(np.int64)), "vec": pa.array(np.arange(n) - offsets(index[:, 2])[section], pa.int32()), "vector": pa.array(list(vectors), pa.list_(pa.float32()))})

    return files.mapInArrow(run, ROWS)


def one_length(vectors: DataFrame, column: str = "vector") -> int:
    """The length that all vectors have; an error if they differ."""
    found = [r.n for r in vectors.select(F.size(column).alias("n")).distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"vectors of several lengths: {sorted(found)}")
    return found[0] if found else 0


def files(vectors: DataFrame) -> DataFrame:
    """(document_id, content): a file's bytes for each document."""

    def run(key, table):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("section", "vec", "range_start", "range_end", "vector")), strict=True))
        sections: dict = {}
        for s, _, a, b, v in rows:
            sections.setdefault(s, (a, b, []))[2].append(v)
        return pa.table({"document_id": [key[0].as_py()], "content": pa.array([encode(key[0].as_py(), list(sections.values()))], pa.binary())})

    return vectors.groupBy("document_id").applyInArrow(run, "document_id string, content binary")
