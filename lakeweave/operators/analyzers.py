"""Analyzers as plug-ins: each names the entities it needs, and runs where they are."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tickets import union


@dataclass(frozen=True)
class Analyzer:
    """``requires``: entity names, or "*" for any data at all. ``run``: {entity: DataFrame} -> findings."""

    id: str
    title: str
    requires: tuple[str, ...] | str
    run: Callable[[dict[str, DataFrame]], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.known: dict[str, Analyzer] = {}

    def register(self, analyzer: Analyzer) -> Analyzer:
        """The first of an id stays; what is no analyzer is an error."""
        if not analyzer.id or not callable(analyzer.run) or not analyzer.requires:
            raise ValueError("an analyzer wants id, requires and run")
        return self.known.setdefault(analyzer.id, analyzer)

    def list(self) -> list[tuple[str, str]]:
        return [(a.id, a.title) for a in self.known.values()]

    def applicable(self, dataset: dict[str, DataFrame]) -> list[Analyzer]:
        """Those whose entities are all there with rows."""
        there = {k for k, df in dataset.items() if not df.isEmpty()}
        return [a for a in self.known.values() if (there if a.requires == "*" else set(a.requires) <= there)]

    def run_all(self, dataset: dict[str, DataFrame]) -> DataFrame | None:
        """Findings of all applicable analyzers in one table, each with its checker's id."""
        found = [a.run(dataset).withColumn("checker", F.lit(a.id)) for a in self.applicable(dataset)]
        return union(*found) if found else None
