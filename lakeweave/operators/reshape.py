"""Shapes of records: long and wide, forward fill, even samples, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells


def normalized(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cells trimmed and sentinels nulled, and in ``sentinels`` the columns where one stood."""
    flags = F.array_compact(F.array(*(F.when(cells.is_sentinel(F.col(c)), F.lit(c)) for c in columns)))
    return df.select(*(cells.normalize(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns), flags.alias("sentinels"))


def paths(df: DataFrame, namespace: str, keys: list[str], columns: list[str]) -> DataFrame:
    """Long form: keys, path (namespace.column) and value."""
    return df.select(*keys, *(F.col(c).cast("string").alias(c) for c in columns)).unpivot(keys, columns, "path", "value").withColumn("path", F.concat(F.lit(namespace + "."), "path"))


def records(df: DataFrame, namespace: str, columns: list[str], source: str, index: Column) -> DataFrame:
    """(source, record_index, values map, pairs in column order, sentinels) of each row."""
    clean = {c: cells.normalize(F.col(c).cast("string")) for c in columns}
    pairs = F.array(*(F.struct(F.lit(f"{namespace}.{c}").alias("path"), v.alias("value")) for c, v in clean.items()))
    flags = F.array_compact(F.array(*(F.when(cells.is_sentinel(F.col(c).cast("string")), F.lit(f"{namespace}.{c}")) for c in columns)))
    return df.select(F.lit(source).alias("source"), index.alias("record_index"), F.map_from_entries(pairs).alias("values"), pairs.alias("pairs"), flags.alias("sentinels"))


def forward_fill(df: DataFrame, partition: str | list[str], order: str, columns: list[str]) -> DataFrame:
    """Null cells take the last value above them within the partition (a source); ``filled`` lists where that happened."""
    w = Window.partitionBy(*([partition] if isinstance(partition, str) else partition)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    new = {c: F.last(c, ignorenulls=True).over(w) for c in columns}
    flags = F.array_compact(F.array(*(F.when(F.col(c).isNull() & v.isNotNull(), F.lit(c)) for c, v in new.items())))
    return df.withColumns({"filled": flags} | {f"_{c}": v for c, v in new.items()}).select(*(F.col(f"_{c}").alias(c) if c in columns else F.col(c) for c in df.columns), "filled")


def even_sample(df: DataFrame, order: str, n: int, k: int) -> DataFrame:
    """The rows at floor(i * n / k) of ``n`` in all: ``order`` is a gapless index from 0."""
    if k >= n:
        return df
    i = F.col(order)
    return df.filter(F.floor(F.ceil(i * k / F.lit(n)) * n / F.lit(k)) == i) if k > 0 else df.limit(0)


def at_path(df: DataFrame, path: str) -> Column:
    """A dotted path as a column, null where the schema has none."""
    from pyspark.sql.types import StructType

    kind, parts = df.schema, path.split(".")
    for p in parts:
        if not isinstance(kind, StructType) or p not in kind.names:
            return F.lit(None).cast("string")
        kind = kind[p].dataType
    return F.col(".".join(f"`{p}`" for p in parts))


def project(df: DataFrame, field_map: dict[str, str]) -> DataFrame:
    """target <- dotted path; a missing path gives null."""
    return df.select(*(at_path(df, path).alias(target) for target, path in field_map.items()))
