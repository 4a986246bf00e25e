"""Which reader a source wants, safe names, media types, markdown folders."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.docid import document_id
from . import delimited, json_records

# Media types by extension.
MEDIA = {"csv": "text/csv", "tsv": "text/tab-separated-values", "txt": "text/plain", "md": "text/markdown", "json": "application/json", "html": "text/html", "htm": "text/html", "xml": "application/xml", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml"}


def media_type(name: Column, default: str = "application/octet-stream") -> Column:
    """By the extension at the end of a name, path or address."""
    extension = F.lower(F.regexp_extract(F.regexp_replace(name, r"[?#].*$", ""), r"\.?([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in MEDIA.items() for x in kv)), extension), F.lit(default))


def is_json(name: str, text: str, form: str | None = None) -> bool:
    return form == "json" or name.lower().endswith(".json") or text.lstrip()[:1] in ("[", "{")


def read(spark: SparkSession, path: str, form: str | None = None, namespace: str | None = None) -> DataFrame:
    """Records or cells of files, by format: named, by extension, or by how the first file begins."""
    head = spark.read.text(path, wholetext=True).select(F.substring("value", 1, 256).alias("v")).limit(1).collect()
    if is_json(path, head[0].v if head else "", form):
        return json_records.read(spark, path, namespace)
    return delimited.cells(spark, path)


def safe_name(name: str, extension: str = ".csv") -> str:
    """A bare file name with the wanted extension; anything that leads elsewhere is refused."""
    if PurePosixPath(name).name != name or not name.endswith(extension) or name.startswith("."):
        raise ValueError(f"not a {extension} file name: {name!r}")
    return name


def markdown(spark: SparkSession, path: str, theme: str | None = None) -> DataFrame:
    """(document_id, text) of markdown files, folders and their folders included. Two files with one id are an error."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    out = files.select(document_id(F.col("_metadata.file_path"), theme).alias("document_id"), F.col("value").alias("text"))
    again = [r.document_id for r in out.groupBy("document_id").count().filter("count > 1").limit(5).collect()]
    if again:
        raise ValueError(f"several files have the same id: {again}")
    return out


def add(corpus: DataFrame, more: DataFrame, key: str = "document_id") -> DataFrame:
    """Both; ids that are there already are an error."""
    again = [r[0] for r in more.select(key).intersect(corpus.select(key)).limit(5).collect()]
    if again:
        raise ValueError(f"ids are there already: {again}")
    return corpus.unionByName(more)


def remove(corpus: DataFrame, ids: DataFrame, key: str = "document_id") -> DataFrame:
    """Without the given ids; unknown ones change nothing."""
    return corpus.join(ids.select(key), key, "left_anti")


def unknown(corpus: DataFrame, ids: DataFrame, key: str = "document_id") -> DataFrame:
    """Ids to be removed that are not there, for a warning."""
    return ids.select(key).distinct().join(corpus.select(key), key, "left_anti")
