"""JSON text as records: nested values become dotted paths."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "source string, record_index long, values map<string,string>, anomaly string"


def flatten(value, prefix: str = "") -> dict:
    """path -> leaf: members by name, elements by index; blank strings and empty containers are null."""
    if isinstance(value, dict) and value:
        return {k: v for name, x in value.items() for k, v in flatten(x, f"{prefix}.{name}" if prefix else name).items()}
    if isinstance(value, list) and value:
        return {k: v for i, x in enumerate(value) for k, v in flatten(x, f"{prefix}.{i}" if prefix else str(i)).items()}
    if isinstance(value, str):
        return {prefix: value.strip() or None}
    return {prefix: None if isinstance(value, (dict, list)) else value}


def rows_in(value) -> list:
    """The records of a parsed text: an array's, or those of an object's first array, or the object; a scalar has none."""
    if isinstance(value, list):
        return value
    if isinstance(value, dict):
        return next((x for x in value.values() if isinstance(x, list)), [value])
    return []


def _written(x) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x)


def records(texts: DataFrame, namespace: str | None = None) -> DataFrame:
    """(source, record_index, values, anomaly) from (source, text). What cannot be parsed gives one row with an anomaly and no values."""

    def run(batches):
        for batch in batches:
            out = []
            for source, text in zip(*(batch.column(c).to_pylist() for c in ("source", "text")), strict=True):
                try:
                    found = rows_in(json.loads(text or ""))
                except ValueError:
                    out.append((source, -1, None, "json_parse_error"))
                    continue
                for i, r in enumerate(found):
                    out.append((source, i, [(".".join(x for x in (namespace, k) if x), _written(v)) for k, v in flatten(r).items()], None))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["source", "record_index", "values", "anomaly"])

    return texts.select("source", "text").mapInArrow(run, RECORDS)


def read(spark: SparkSession, path: str, namespace: str | None = None) -> DataFrame:
    return records(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text")), namespace)


def shredded(df: DataFrame, column: str, paths: list[str]) -> DataFrame:
    """The named dotted paths of a JSON column as columns, without Python: for a schema that is known."""
    return df.select("*", *(F.get_json_object(column, "$." + p).alias(p) for p in paths))


def long_paths(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, path, value) of the first level of a JSON object column, in the JVM."""
    parsed = F.from_json(column, "map<string,string>")
    return df.select(*keys, F.explode(parsed).alias("path", "value"))
