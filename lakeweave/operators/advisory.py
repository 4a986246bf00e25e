"""Advice by a model, let through only if every claim is backed: the gate is deterministic, the model is injected."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINK = re.compile(r"\bhttps?://|\bwww\.|\]\(")
NUMBER = re.compile(r"\d+(?:\.\d+)?")


def applicable(tickets: DataFrame, rules: DataFrame, on: tuple[str, str] = ("loinc", "way")) -> DataFrame:
    """Tickets with the rules for their code and direction. ``rules``: (rule_id, loinc, direction, statement, url), a governed few."""
    return tickets.join(F.broadcast(rules.select(F.col("loinc").alias(on[0]), F.col("direction").alias(on[1]), "rule_id", "statement", "url")), list(on))


def citable(facts: dict) -> list[str]:
    """``key: value`` of the facts that are there, those within facts by dotted key."""
    out = []
    for k, v in facts.items():
        if isinstance(v, dict):
            out += [f"{k}.{x}" for x in citable(v)]
        elif v is not None:
            out.append(f"{k}: {v}")
    return out


def sourced(facts: dict) -> list[float]:
    """Numbers that the facts hold."""
    out: list[float] = []
    for v in facts.values():
        if isinstance(v, dict):
            out += sourced(v)
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            out.append(float(v))
    return out


def check(proposal: dict, facts: dict, rules: list[dict]) -> dict:
    """{verified, reasons, assessment, plan, cites}: rejected as a whole for any reason.

    It must name a known rule that applies and cite a real fact; it may hold no link, no decimal, and no whole number
    that restates a measured value of ten or more. The address in the result is the rule's own.
    """
    reasons = []
    rule = next((r for r in rules if r["rule_id"] == proposal.get("rule_id")), None)
    if rule is None:
        reasons.append("no known rule that applies")
    squeeze = lambda s: re.sub(r"\s+", " ", str(s)).strip().lower()
    real = {squeeze(f): f for f in citable(facts)}
    cited = [real[squeeze(c)] for c in proposal.get("facts") or [] if squeeze(c) in real]
    if not cited:
        reasons.append("no real fact is cited")
    text = " ".join(str(proposal.get(k) or "") for k in ("assessment", "plan"))
    if LINK.search(text):
        reasons.append("holds a link")
    measured = {round(v) for v in sourced(facts) if abs(v) >= 10}
    for n in NUMBER.findall(text):
        if "." in n:
            reasons.append(f"holds a decimal: {n}")
        elif int(n) in measured:
            reasons.append(f"restates a measured value: {n}")
    cites = {"facts": cited, "rule": {k: rule[k] for k in ("rule_id", "statement", "url")}} if rule and not reasons else None
    return {"verified": not reasons, "reasons": reasons, "assessment": proposal.get("assessment") if not reasons else None, "plan": proposal.get("plan") if not reasons else None, "cites": cites}


def attach(tickets: DataFrame, rules: list[dict], model: Callable[[dict, list[dict]], dict], severities: tuple[str, ...] = ("critical",), facts: tuple[str, ...] = ()) -> DataFrame:
    """Tickets with hypothesis {status, assessment, plan, rule_id, reasons}. Only the chosen severities ask the model, and only where a rule applies; data quality never does.

    ``model`` runs on the executors, a batch at a time; how many calls run at once is the number of partitions.
    """
    kind = "status string, assessment string, plan string, rule_id string, reasons array<string>"

    @F.pandas_udf(kind)
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.to_dict("records"):
            own = [r for r in rules if r["loinc"] == row.get("loinc") and r["direction"] == row.get("way")]
            if row["severity"] not in severities or row["severity"] == "data-quality":
                out.append(("not asked", None, None, None, []))
            elif not own:
                out.append(("no rule", None, None, None, []))
            else:
                known = {k: (None if pd.isna(row[k]) else row[k]) for k in facts}
                try:
                    got = check(model(row, own), known, own)
                except Exception as e:  # a failing call is a ticket without advice, not a failing job
                    out.append(("failed", None, None, None, [str(e)]))
                    continue
                out.append(("verified" if got["verified"] else "rejected", got["assessment"], got["plan"], got["cites"]["rule"]["rule_id"] if got["cites"] else None, got["reasons"]))
        return pd.DataFrame(out, columns=["status", "assessment", "plan", "rule_id", "reasons"])

    return tickets.withColumn("hypothesis", run(F.struct(*[c for c in ("severity", "loinc", "way", *facts) if c in tickets.columns])))


def usage(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Token use rolled up: sums, whether any call was cached or batched, and cost of both kinds."""
    return calls.groupBy(*(by or [])).agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.bool_or("batched").alias("any_batched"), F.sum("cost").alias("cost"), F.coalesce(F.sum(F.when(F.col("batched"), F.col("cost"))), F.lit(0.0)).alias("batch_cost"))
