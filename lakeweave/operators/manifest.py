"""Mapping manifests: which source column becomes which canonical path, compiled to one projection and verified in one pass."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.transforms import REGISTRY
from .model import PATHS, column


@dataclass(frozen=True)
class Field:
    """A source column and where it goes: one path, or the several that a transform emits; neither drops it."""

    source: str
    to: str | None = None
    emits: tuple[str, ...] = ()
    transform: str | None = None

    @property
    def targets(self) -> tuple[str, ...]:
        return self.emits or ((self.to,) if self.to else ())


@dataclass(frozen=True)
class Manifest:
    source: str
    entity: str
    fields: tuple[Field, ...] = field(default=())

    @classmethod
    def read(cls, raw: dict) -> Manifest:
        own = [Field(f.get("from"), f.get("to"), tuple(f.get("emits") or ()), f.get("transform")) for f in raw.get("fields", [])]
        return cls(raw.get("source"), raw.get("entity"), tuple(own))

    def write(self) -> dict:
        return {"source": self.source, "entity": self.entity, "fields": [{k: v for k, v in {"from": f.source, "to": f.to, "emits": list(f.emits), "transform": f.transform}.items() if v} for f in self.fields]}


def validate(raw: dict) -> dict:
    """{errors, warnings, mapped, dropped} of a manifest as read from JSON. With errors nothing is applied."""
    if not isinstance(raw, dict):
        return {"errors": ["not an object"], "warnings": [], "mapped": [], "dropped": []}
    errors, warnings, mapped, dropped = [], [], [], []
    if not raw.get("source"):
        errors.append("source is missing")
    paths = PATHS.get(raw.get("entity"))
    if paths is None:
        errors.append(f"unknown entity {raw.get('entity')!r}")
    if not isinstance(raw.get("fields"), list):
        return {"errors": [*errors, "fields is no list"], "warnings": [], "mapped": [], "dropped": []}
    for f in raw["fields"]:
        name = f.get("from")
        if not name:
            errors.append("a field has no from")
            continue
        t = REGISTRY.get(f.get("transform")) if f.get("transform") else None
        if f.get("transform") and t is None:
            errors.append(f"{name}: unknown transform {f['transform']!r}")
        arity = t.arity if t else 1
        if f.get("emits") and (arity < 2 or len(f["emits"]) != arity):
            errors.append(f"{name}: emits wants a transform with {len(f['emits'])} results")
        if f.get("to") and arity > 1:
            errors.append(f"{name}: {f['transform']} has {arity} results, so it wants emits")
        targets = f.get("emits") or ([f["to"]] if f.get("to") else [])
        errors += [f"{name}: unknown path {p!r}" for p in targets if paths is not None and p not in paths]
        warnings += [f"{p} is mapped twice" for p in targets if p in mapped]
        mapped += targets
        if not targets:
            dropped.append(name)
    if not mapped:
        warnings.append("nothing is mapped")
    return {"errors": errors, "warnings": warnings, "mapped": mapped, "dropped": dropped}


def resolve(name: str, columns: list[str]) -> str | None:
    """The column that a manifest means: the same name, the only dotted suffix, the bare name's first, or the first suffix."""
    if name in columns:
        return name
    ends = [c for c in columns if c.endswith("." + name)]
    if len(ends) == 1:
        return ends[0]
    bare = name.rsplit(".", 1)[-1]
    same = [c for c in columns if c.rsplit(".", 1)[-1] == bare]
    return same[0] if same else ends[0] if ends else None


def _raw(f: Field, columns: list[str]) -> Column | None:
    found = resolve(f.source, columns)
    return None if found is None else F.col(f"`{found}`").cast("string")


def _made(f: Field, raw: Column | None) -> list[Column]:
    """The columns of a field's targets."""
    if raw is None:
        return [F.lit(None).cast("string")] * len(f.targets)
    if f.transform in REGISTRY:
        out = REGISTRY[f.transform].apply(raw)
        return out if isinstance(out, list) else [out]
    return [cells.trim(raw)]


def apply(df: DataFrame, manifest: Manifest, keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical rows: ``keep`` columns and every mapped path, in one projection. The later of two fields for a path wins."""
    out: dict[str, Column] = {}
    for f in manifest.fields:
        for target, c in zip(f.targets, _made(f, _raw(f, df.columns)), strict=False):
            kind = PATHS[manifest.entity][target]
            out[target] = c.try_cast("double") if kind == "number" and f.transform is None else c
    return df.select(*keep, *(c.alias(column(p), metadata={"path": p}) for p, c in out.items()))


def anomalies(df: DataFrame, manifest: Manifest, key: str) -> DataFrame:
    """(key, kind, field, detail): cells that a transform could not read, and source columns that are not there (once each, null key)."""
    marks = []
    missing = []
    for f in manifest.fields:
        raw = _raw(f, df.columns)
        if raw is None:
            missing.append((None, "unresolved_source", f.source, None))
        elif f.transform in REGISTRY and f.targets:
            none = F.lit(True)
            for c in _made(f, raw):
                none = none & c.isNull()
            marks.append(F.when(~cells.is_blank(raw) & none, F.struct(F.lit("transform_unparsed").alias("kind"), F.lit(f.source).alias("field"), raw.alias("detail"))))
    kind = dict(df.dtypes)[key]
    lost = df.sparkSession.createDataFrame(missing, f"{key} {kind}, kind string, field string, detail string")
    if not marks:
        return lost
    return df.select(key, F.explode(F.array_compact(F.array(*marks))).alias("a")).select(key, "a.kind", "a.field", "a.detail").unionByName(lost)


def type_ok(kind: str, value: Column) -> Column:
    """Whether a canonical value has its path's type; null does."""
    if kind == "number":
        return value.isNull() | F.coalesce(F.abs(value.try_cast("double")) < float("inf"), F.lit(False))
    if kind == "date":
        return value.isNull() | value.cast("string").rlike(r"^\d{4}(-\d{2}-\d{2})?")
    return value.isNull() | F.lit(True)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def verify(df: DataFrame, manifest: Manifest, key: str, examples: int = 5) -> DataFrame:
    """A row for each mapped field: field, reversibility, rows, losses, type_violations, examples (the first keys that lose something).

    Every row is checked: each field's raw cell and results are worked out once, in one pass that sums up by field
    before the shuffle. ``examples`` (0 for none) take a second pass, in which tasks keep no more than that many.
    """

    def checked(f: Field, raw: Column) -> Column:
        t = REGISTRY.get(f.transform)

        def held(r: Column, made: Column) -> Column:
            out = [made[f"m{i}"] for i in range(max(1, len(f.targets)))]
            kept = t.check(r, out) if t else cells.trim(r).eqNullSafe(out[0].cast("string"))
            typed = F.lit(True)
            for p, c in zip(f.targets, out, strict=False):
                typed = typed & type_ok(PATHS[manifest.entity][p], c)
            return F.struct(F.lit(f.source).alias("field"), F.lit(t.kind if t else "passthrough").alias("reversibility"), (~F.coalesce(kept, F.lit(False))).alias("lost"), (~typed).alias("wrong"))

        return _let(raw, lambda r: _let(F.struct(*(c.alias(f"m{i}") for i, c in enumerate(_made(f, r)))), lambda made: held(r, made)))

    fields = [checked(f, raw) for f in manifest.fields if f.targets and (raw := _raw(f, df.columns)) is not None]
    if not fields:
        return df.sparkSession.createDataFrame([], "field string, reversibility string, rows long, losses long, type_violations long, examples array<string>")
    rows = df.select(F.col(key).alias("_key"), F.explode(F.array(*fields)).alias("c")).select("_key", "c.*")
    sums = rows.groupBy("field", "reversibility").agg(F.count("*").alias("rows"), F.count_if("lost").alias("losses"), F.count_if("wrong").alias("type_violations"))
    if not examples:
        return sums.withColumn("examples", F.array().cast("array<string>"))
    first = rows.filter("lost").withColumn("n", F.row_number().over(Window.partitionBy("field").orderBy("_key"))).filter(F.col("n") <= examples)
    first = first.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "_key"))), lambda x: x["_key"].cast("string")).alias("examples"))
    return sums.join(first, "field", "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


def coverage(df_columns: list[str], manifest: Manifest) -> dict:
    """{ratio, missing}: the source's columns that the manifest names, dropped ones included."""
    named = {resolve(f.source, df_columns) for f in manifest.fields}
    missing = [c for c in df_columns if c not in named]
    return {"ratio": 1 - len(missing) / len(df_columns) if df_columns else 1.0, "missing": missing}


def report(df: DataFrame, manifest: Manifest, key: str) -> dict:
    """The verification's roll-up; it passes without loss and type violation. Coverage never fails a mapping."""
    rows = verify(df, manifest, key, examples=0).collect()  # a row a field
    classes: dict[str, int] = {}
    for r in rows:
        classes[r.reversibility] = classes.get(r.reversibility, 0) + 1
    loss, wrong = [r.field for r in rows if r.losses], [r.field for r in rows if r.type_violations]
    lost = [f.source for f in manifest.fields if resolve(f.source, df.columns) is None]
    return {"coverage": coverage(df.columns, manifest), "loss_fields": loss, "type_fields": wrong, "unresolved": lost, "reversibility": classes, "passed": not loss and not wrong}


def failures(found: dict) -> list[str]:
    """What a repair is told: losses first, then types, then missing columns."""
    return [*(f"{f}: information is lost" for f in found["loss_fields"]), *(f"{f}: wrong type" for f in found["type_fields"] if f not in found["loss_fields"]), *(f"{f}: no such column" for f in found["unresolved"])]


def induce(df: DataFrame, source: str, entity: str) -> dict:
    """A manifest by names alone: a path and a column agree when their letters do. Stands in for a model's proposal."""
    squeeze = lambda s: "".join(c for c in s.lower() if c.isalnum())
    by_name = {squeeze(p): p for p in PATHS[entity]} | {squeeze(column(p)): p for p in PATHS[entity]}
    transform = {"number": "to_number", "date": "to_date", "boolean": "to_boolean"}
    fields = []
    for c in df.columns:
        p = by_name.get(squeeze(c.rsplit(".", 1)[-1])) or by_name.get(squeeze(c))
        t = transform.get(PATHS[entity][p]) if p else None
        fields.append({"from": c} | ({"to": p} if p else {}) | ({"transform": t} if t else {}))
    return {"source": source, "entity": entity, "fields": fields}


def with_repair(df: DataFrame, key: str, inducer: Callable[[list[str]], dict], attempts: int = 2, supplied: dict | None = None) -> tuple[Manifest, dict]:
    """A manifest that verifies: asked for anew with what failed, up to ``attempts`` times. A supplied one is never repaired."""
    told: list[str] = []
    for turn in range(attempts + 1):
        raw = supplied or inducer(told)
        checked = validate(raw)
        if checked["errors"]:
            told = checked["errors"]
            if supplied:
                break
            continue
        manifest = Manifest.read(raw)
        found = report(df, manifest, key) | {"attempts": turn}
        if found["passed"] or supplied:
            return manifest, found
        told = failures(found)
    raise ValueError(f"no manifest that verifies: {told}")


def save(manifest: Manifest, folder: str) -> Path:
    """Keeps a manifest for the next run."""
    path = Path(folder) / f"mapping.{Path(manifest.source).stem}.json"
    path.write_text(json.dumps(manifest.write(), indent=1))
    return path


def load(source: str, folder: str) -> Manifest | None:
    path = Path(folder) / f"mapping.{Path(source).stem}.json"
    return Manifest.read(json.loads(path.read_text())) if path.exists() else None


def sweep(sources: dict[str, tuple[DataFrame, Manifest, str]]) -> dict[str, dict]:
    """The report of every source; a gate passes if all do."""
    return {name: report(df, m, key) for name, (df, m, key) in sources.items()}


def same_rows(first: tuple[DataFrame, Manifest, str], second: tuple[DataFrame, Manifest, str]) -> DataFrame:
    """Two sources of one entity, each through its own manifest: the canonical rows that only one of them gives, with how often (side, n); none proves them equal.

    Columns' names and order in the sources play no part. Rows are counted as they are: a repeated row must repeat in both.
    """
    made = [apply(df, m) for df, m, _ in (first, second)]
    columns = sorted({c for df in made for c in df.columns})
    sides = [df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in columns), F.lit(sign).alias("_n")) for df, sign in zip(made, (1, -1), strict=True)]
    left = sides[0].unionByName(sides[1]).groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    return left.select(F.when(F.col("_n") > 0, "first").otherwise("second").alias("side"), F.abs("_n").alias("n"), *columns)
