"""Source against target after a migration: dropped, added and changed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import same_value

SEVERITY = {"dropped": 3, "value": 2, "reference": 1}


#: Bytes, by the plan's estimate, of what one task groups.
PART = 4 << 20


def parts(df: DataFrame) -> int:
    """Into how many parts to deal a table: as many as shuffles have here, more if it is large; adaptive plans keep the number."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART if size < 1 << 40 else 0)


def compare(source: DataFrame, target: DataFrame, key: str, fields: list[str], order: str | None = None) -> DataFrame:
    """Both sides by key, with the list of fields that differ; of repeated keys the last in ``order`` counts.

    Rows of both are dealt by key into parts of about PART bytes before they are grouped, both sides at once: keys hardly
    repeat, so grouping where rows are read would sort whole input splits for nothing, and each side again for a join. Null
    keys equal nothing.
    """
    side = lambda df, name: df.select(F.col(key), F.when(F.col(key).isNull(), F.lit(name)).alias("_side"), F.struct(*fields).alias(name), F.col(order or fields[0]).alias(f"_{name}"), F.lit(1).alias(f"{name}_rows"))
    rows = side(source, "s").unionByName(side(target, "t"), allowMissingColumns=True)
    last = lambda name: [F.max_by(name, f"_{name}").alias(name), F.sum(f"{name}_rows").alias(f"{name}_rows")]
    both = rows.repartition(parts(rows), key).groupBy(key, "_side").agg(*last("s"), *last("t"))
    differ = F.array_compact(F.array(*(F.when(~same_value(F.col(f"s.{f}"), F.col(f"t.{f}")), F.lit(f)) for f in fields)))
    state = F.when(F.col("t_rows").isNull(), "dropped").when(F.col("s_rows").isNull(), "added").otherwise("both")
    return both.select(key, state.alias("state"), F.when(state == "both", differ).otherwise(F.array().cast("array<string>")).alias("fields"), "s", "t", "s_rows", "t_rows")


def findings(compared: DataFrame, key: str, severities: dict[str, int] | None = None) -> DataFrame:
    """(key, kind, field, severity): a dropped row, or a field that differs. Added rows are counted in the report only."""
    known = F.create_map(*(F.lit(x) for kv in (severities or SEVERITY).items() for x in kv))
    dropped = compared.filter("state = 'dropped'").select(key, F.lit("dropped").alias("kind"), F.lit(None).cast("string").alias("field"), F.lit((severities or SEVERITY)["dropped"]).alias("severity"))
    changed = compared.filter("state = 'both'").select(key, F.lit("mismatch").alias("kind"), F.explode("fields").alias("field")).withColumn("severity", F.coalesce(F.element_at(known, F.col("field")), F.lit(0)))
    return dropped.unionByName(changed)


def ordered(found: DataFrame, key: str) -> DataFrame:
    """Findings by falling severity; within one, by key and field, dropped rows before differing fields."""
    return found.orderBy(F.desc("severity"), F.col("kind") != "dropped", key, F.asc_nulls_first("field"))


def report(compared: DataFrame, n_fields: int) -> DataFrame:
    """One row: source_rows, target_rows, dropped, added, mismatches, repeated_keys, completeness, fidelity (%), passed."""
    n = lambda cond: F.count_if(cond)
    sums = compared.agg(
        n(F.col("state") != "added").alias("source_rows"), n(F.col("state") != "dropped").alias("target_rows"), n(F.col("state") == "dropped").alias("dropped"), n(F.col("state") == "added").alias("added"),
        F.coalesce(F.sum(F.size("fields")), F.lit(0)).alias("mismatches"), n((F.coalesce("s_rows", F.lit(0)) > 1) | (F.coalesce("t_rows", F.lit(0)) > 1)).alias("repeated_keys"), n(F.col("state") == "both").alias("_both"),
    )
    share = lambda part, whole: F.coalesce(F.round(100 * F.try_divide(part.cast("double"), whole.cast("double")), 3), F.lit(100.0))
    done = F.col("source_rows") - F.col("dropped")
    return sums.select("*", share(done, F.col("source_rows")).alias("completeness"), share(F.col("_both") * n_fields - F.col("mismatches"), F.col("_both") * n_fields).alias("fidelity"), ((F.col("dropped") == 0) & (F.col("added") == 0) & (F.col("mismatches") == 0)).alias("passed")).drop("_both")


def with_defects(df: DataFrame, key: str, value: str, drop_every: int = 97, change_every: int = 53) -> DataFrame:
    """Known defects for tests: rows dropped and values changed by key."""
    return df.filter(F.col(key) % drop_every != 0).withColumn(value, F.when(F.col(key) % change_every == 0, F.col(value) + 1).otherwise(F.col(value)))
