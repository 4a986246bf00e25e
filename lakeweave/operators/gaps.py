"""Expected steps that did not happen: conditions by longest prefix, expected codes, results and open orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active(status: Column, strict: bool = False) -> Column:
    """Null, 1, or text that holds "active" (by default also within "inactive"; ``strict`` wants the whole word)."""
    said = status.rlike(r"(?i)\bactive\b" if strict else "(?i)active")
    return status.isNull() | F.coalesce(said | (status == "1"), F.lit(False))


def by_longest_prefix(rows: DataFrame, rules: DataFrame, code: str, prefix: str = "prefix", keep: bool = False) -> DataFrame:
    """Each row with the rule whose prefix of its code is the longest; codes are compared in capitals without white space.

    An equality join for each length that a prefix has (a handful), the longest first match counting: no comparison of
    all rows with all rules, no row ids, and a broadcast only where Spark finds the rules small. Of rules with one
    prefix the greatest counts. ``keep``: rows without a rule stay.
    """
    clean = lambda c: F.upper(F.regexp_replace(c, r"\s+", ""))
    columns = rules.columns
    known = rules.withColumn("_p", clean(F.col(prefix))).filter("_p is not null").groupBy("_p").agg(F.max(F.struct(*columns)).alias("_rule"))
    sizes = sorted((r.n for r in known.select(F.length("_p").alias("n")).distinct().collect()), reverse=True)
    out = rows.withColumn("_code", clean(F.col(code)))
    for n in sizes:
        own = known.filter(F.length("_p") == n).select(F.col("_p").alias(f"_p{n}"), F.col("_rule").alias(f"_rule{n}"))
        out = out.join(own, F.substring("_code", 1, n) == F.col(f"_p{n}"), "left")
    best = F.coalesce(*(F.col(f"_rule{n}") for n in sizes)) if sizes else F.lit(None).cast(known.schema["_rule"].dataType)
    out = out.withColumn("_rule", best)
    return (out if keep else out.filter("_rule is not null")).select(*rows.columns, *(F.col(f"_rule.{c}").alias(c) for c in columns))


def longest_prefix(code: Column, rules: dict[str, str]) -> Column:
    """The value of the longest prefix of ``code`` in a literal rule table; null without one. No join at all."""
    clean = F.upper(F.regexp_replace(code, r"\s+", ""))
    out = F.lit(None).cast("string")
    for prefix in sorted(rules, key=len):
        out = F.when(F.startswith(clean, F.lit(prefix.upper())), F.lit(rules[prefix])).otherwise(out)
    return out


def expected(conditions: DataFrame, rules: DataFrame, condition_key: str) -> DataFrame:
    """Conditions with each code that their rule expects: rules hold (condition_key, expects array<string>)."""
    return conditions.join(F.broadcast(rules), condition_key).withColumn("expected_code", F.explode("expects")).drop("expects")


def gaps(wanted: DataFrame, results: DataFrame, orders: DataFrame, patient: str = "patient_id", condition: str = "condition") -> DataFrame:
    """(patient, condition, expected_code, gap_type) of what was expected and has no result.

    ``results``: (patient, code). ``orders``: open ones (patient, code); such a gap is ordered-not-resulted, others are
    never-ordered. Each patient, condition and code counts once. A result without a value closes a gap too.
    """
    key = wanted.select(patient, condition, "expected_code").filter(F.col(patient).isNotNull()).distinct()
    done = results.select(F.col("patient_id").alias(patient), F.col("code").alias("expected_code")).distinct()
    open_ = orders.select(F.col("patient_id").alias(patient), F.col("code").alias("expected_code"), F.lit(True).alias("_open")).distinct()
    left = key.join(done, [patient, "expected_code"], "left_anti").join(open_, [patient, "expected_code"], "left")
    return left.select(patient, condition, "expected_code", F.when(F.col("_open"), "ordered-not-resulted").otherwise("never-ordered").alias("gap_type"))


def stats(wanted: DataFrame, results: DataFrame, orders: DataFrame, patient: str = "patient_id", condition: str = "condition") -> DataFrame:
    """One row: conditions_checked, never_ordered, ordered_not_resulted, closed."""
    key = wanted.select(patient, condition, "expected_code").filter(F.col(patient).isNotNull()).distinct()
    found = gaps(wanted, results, orders, patient, condition)
    sums = found.agg(F.count_if(F.col("gap_type") == "never-ordered").alias("never_ordered"), F.count_if(F.col("gap_type") == "ordered-not-resulted").alias("ordered_not_resulted"))
    total = key.agg(F.countDistinct(patient, condition).alias("conditions_checked"), F.count("*").alias("n"))
    return total.crossJoin(sums).select("conditions_checked", "never_ordered", "ordered_not_resulted", (F.col("n") - F.col("never_ordered") - F.col("ordered_not_resulted")).alias("closed"))  # one row with one row
