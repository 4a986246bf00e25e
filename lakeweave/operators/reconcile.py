"""Two sides' sets held against each other by any name they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import medication_aliases, named_in
from .gaps import active


def one_sided(left: DataFrame, right: DataFrame, group: str, name: str = "name", aliases=None) -> DataFrame:
    """(group, kind, name, aliases): what only one side of a group holds; kind is left_only or right_only.

    ``left`` and ``right``: (group, name). ``aliases`` makes the array of names that an entry goes by (itself unless
    given); a shared one on the other side of the group is a match. Entries without any name are ignored, and entries
    with equal names count once. Groups meet by key and alias, so no group is gathered anywhere.
    """
    make = aliases or (lambda c: F.filter(F.array(c), lambda x: x.isNotNull() & (x != "")))
    sides = {}
    for kind, df in (("left_only", left), ("right_only", right)):
        sides[kind] = df.select(group, F.col(name).alias("name"), make(F.col(name)).alias("aliases")).filter(F.size("aliases") > 0).groupBy(group, "aliases").agg(F.min("name").alias("name"))
    out = []
    for kind, other in (("left_only", "right_only"), ("right_only", "left_only")):
        own = sides[kind].withColumn("_id", F.xxhash64("aliases"))
        pool = sides[other].select(group, F.explode("aliases").alias("_alias")).distinct()
        matched = own.select(group, "aliases", F.explode("aliases").alias("_alias")).join(pool, [group, "_alias"], "left_semi").select(group, "aliases").distinct()
        out.append(own.join(matched, [group, "aliases"], "left_anti").select(group, F.lit(kind).alias("kind"), "name", "aliases"))
    return out[0].unionByName(out[1])


def notes_about(notes: DataFrame, patient: str = "patient_id", text: str = "text", word: str = "medication") -> DataFrame:
    """Notes of known patients that hold ``word``."""
    return notes.filter(F.col(patient).isNotNull() & F.lower(text).contains(word))


def extract_by_lexicon(notes: DataFrame, lexicon: list[str], note: str = "note_id", text: str = "text") -> DataFrame:
    """(note, name) of the names in a note: the default, without a model, of extraction."""
    found = F.array_distinct(F.filter(F.array(*map(F.lit, lexicon)), lambda x: F.contains(F.lower(F.col(text)), F.lower(x))))
    return notes.select(note, F.explode(found).alias("name"))


def as_written(found: DataFrame, notes: DataFrame, note: str = "note_id", text: str = "text", name: str = "name") -> DataFrame:
    """Of extracted names those that stand in their note, by its first word: what a model made up falls away."""
    own = found.join(notes.select(note, F.col(text).alias("_text")), note)
    return own.filter(named_in(F.col("_text"), F.col(name))).drop("_text")


def reconcile_notes(notes: DataFrame, orders: DataFrame, extract, patient: str = "patient_id", note: str = "note_id", text: str = "text", status: str = "status") -> DataFrame:
    """(patient, kind, name, aliases): what a patient's notes name without an active order (note_only), and active orders that no note names (order_only).

    ``notes``: (note, patient, text). ``orders``: (patient, name, status). ``extract`` makes (note, name) of notes, by a model
    or a word list; names that do not stand in their note are dropped. Only patients with a note about medication are
    looked at; one without orders has none, so all that its notes name is note_only.
    """
    about = notes_about(notes, patient, text).select(note, patient, text)
    named = as_written(extract(about), about, note, text).join(about.select(note, patient), note).select(patient, "name")
    asked = about.select(patient).distinct()
    active_ones = orders.filter(active(F.col(status), strict=True)).select(patient, "name").join(asked, patient, "left_semi")
    kind = F.when(F.col("kind") == "left_only", "order_only").otherwise("note_only")
    return medication_reconciliation(active_ones, named, patient).withColumn("kind", kind)


def medication_reconciliation(orders: DataFrame, mentioned: DataFrame, patient: str = "patient_id") -> DataFrame:
    """Active orders against the medications that notes mention, by any alias."""
    return one_sided(orders, mentioned, patient, aliases=medication_aliases)


def overlap(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)
