"""Delimited text of unknown make: sniffing, a lossless tokenizer, repair with a log of what was repaired."""

from __future__ import annotations

from statistics import fmean, pvariance

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Delimiters in the order that ties are decided in.
DELIMITERS = (",", "\t", ";", "|")
ROWS = "source string, record_index long, cells array<string>"


def tokenize(text: str, delimiter: str = ",", quote: str = '"'):
    """Rows of cells, one after the other. A quote opens at a field's start only, doubled it stands for itself; line ends are LF, CRLF or CR."""
    row: list[str] = []
    at, n = 0, len(text)
    began = False
    while at < n or began:
        cell, began = "", False
        if at < n and text[at] == quote:
            at += 1
            while at < n:
                stop = text.find(quote, at)
                if stop < 0:
                    cell, at = cell + text[at:], n
                    break
                cell, at = cell + text[at:stop], stop + 1
                if at < n and text[at] == quote:
                    cell, at = cell + quote, at + 1
                else:
                    break
        stop = at
        while stop < n and text[stop] != delimiter and text[stop] not in "\r\n":
            stop += 1
        row.append(cell + text[at:stop])
        at = stop
        if at < n and text[at] == delimiter:
            at, began = at + 1, True
            continue
        if at < n:
            at += 2 if text[at : at + 2] == "\r\n" else 1
        yield row
        row = []


def physical_lines(text: str, quote: str = '"') -> list[str]:
    """Lines, but for line ends within quotes; blank ones left out."""
    out, own, inside = [], [], False
    for c in text:
        inside ^= c == quote
        if c in "\r\n" and not inside:
            out.append("".join(own))
            own = []
        else:
            own.append(c)
    return [x for x in [*out, "".join(own)] if x.strip()]


def sniff_delimiter(lines: list[str]) -> tuple[str, float]:
    """The delimiter that stands in most lines and evenly, and the share of lines that have it."""
    best, score, sure = ",", float("-inf"), 0.0
    for d in DELIMITERS:
        counts = [x.count(d) for x in lines]
        share = sum(map(bool, counts)) / len(counts) if counts else 0
        if share and (own := fmean(counts) * share - pvariance(counts)) > score:
            best, score, sure = d, own, share
    return best, sure


def _label(cell: str) -> bool:
    bare = cell.strip().strip('"').strip()
    try:
        float(bare)
    except ValueError:
        return bool(bare)
    return False


def sniff_header(rows: list[list[str]]) -> bool:
    """Whether the first row is of labels: over 0.6 of it, and no less than of the rows below."""
    share = lambda row: sum(map(_label, row)) / len(row) if row else 0.0
    if not rows or share(rows[0]) <= 0.6:
        return False
    return len(rows) < 2 or share(rows[0]) >= fmean(map(share, rows[1:21]))


def sniff(text: str) -> dict:
    """{delimiter, quote, has_header, confidence} from the first fifty lines."""
    lines = physical_lines(text)[:50]
    delimiter, confidence = sniff_delimiter(lines)
    return {"delimiter": delimiter, "quote": '"', "has_header": sniff_header([x.split(delimiter) for x in lines[:21]]), "confidence": confidence}


def cells(spark: SparkSession, path: str, delimiter: str | None = None, quote: str = '"', has_header: bool | None = None) -> DataFrame:
    """(source, record_index, cells) of every row of the files, headers with index -1. A file is tokenized by one task, since quotes may hold line ends."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))

    def run(batches):
        for batch in batches:
            for source, text in zip(*(batch.column(c).to_pylist() for c in ("source", "text")), strict=True):
                found = sniff(text[: 1 << 20])
                first = -1 if (found["has_header"] if has_header is None else has_header) else 0
                held: list[tuple] = []
                for i, row in enumerate(tokenize(text.removeprefix("﻿"), delimiter or found["delimiter"], quote), first):
                    held.append((source, i, row))
                    if len(held) == 10_000:
                        yield _rows(held)
                        held = []
                yield _rows(held)

    return whole.mapInArrow(run, ROWS)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*held, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.string()))], names=["source", "record_index", "cells"])


def header(rows: DataFrame) -> list[str]:
    """Column names: the header row, or col0, col1, ... for the widest row."""
    found = rows.filter("record_index = -1").select("cells").limit(1).collect()
    if found:
        return [c.strip() for c in found[0].cells]
    wide = rows.agg(F.max(F.size("cells"))).first()[0] or 0
    return [f"col{i}" for i in range(wide)]


def repaired(rows: DataFrame, names: list[str]) -> DataFrame:
    """(source, record_index, one column a name): short rows padded with nulls, long ones cut, blank cells null."""
    blank = lambda c: F.when(F.trim(c) != "", c)
    return rows.filter("record_index >= 0").select("source", "record_index", *(blank(F.get("cells", F.lit(i))).alias(n) for i, n in enumerate(names)))


def anomalies(rows: DataFrame, width: int) -> DataFrame:
    """(source, record_index, kind, detail) of each ragged row; a long one's detail holds the cells that were cut off."""
    n = F.size("cells")
    kind = F.when(n < width, "ragged_short").when(n > width, "ragged_long")
    detail = F.when(n > width, F.to_json(F.slice("cells", width + 1, F.greatest(n - width, F.lit(1))))).otherwise(F.concat_ws(" of ", n, F.lit(width)))
    return rows.filter(F.col("record_index") >= 0).select("source", "record_index", kind.alias("kind"), detail.alias("detail")).filter("kind is not null")


def write(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """Delimited text with as few quotes as needed."""
    df.write.mode("overwrite").option("sep", delimiter).option("header", True).option("quoteAll", False).option("escape", '"').csv(path)
