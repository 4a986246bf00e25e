"""The canonical model: closed entities with dotted paths, and their schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# The entities' paths by type, each preceded by the entity's name in a manifest.
ENTITIES: dict[str, dict[str, str]] = {
    "patient": {"string": "id mrn name.first name.middle name.last sex status pcp.id pcp.name", "date": "birth_date death_date", "number": "age"},
    "provider": {"string": "id name npi type specialty department"},
    "encounter": {"string": "id patient_id type status department location provider.id provider.name visit_reason insurance", "date": "date"},
    "problem": {"string": "id patient_id dx_id name icd10 status", "boolean": "chronic", "date": "noted_date resolved_date"},
    "diagnosis": {"string": "encounter_id dx_id name icd10 type", "number": "seq", "date": "date"},
    "medication_order": {"string": "id patient_id encounter_id name generic dose_unit frequency route status class provider_id sig rxnorm", "number": "dose", "date": "ordering_date start_date end_date"},
    "lab_order": {"string": "id encounter_id patient_id code name type status provider_id specialty result_unit result_flag", "date": "order_date result_date", "number": "result_value days_from_visit"},
    "lab_result": {"string": "id order_id patient_id encounter_id component_id component loinc value_text flag unit reference.raw", "number": "value reference.low reference.high", "date": "date"},
    "vital": {"string": "id patient_id name value_text", "number": "value bp.systolic bp.diastolic", "date": "date"},
    "note": {"string": "id patient_id encounter_id type text author service status", "date": "entry_time"},
    "surgical_history": {"string": "patient_id encounter_id procedure procedure_id cpt comments", "date": "date start_date end_date"},
}
PATHS = {entity: {f"{entity}.{p}": kind for kind, names in kinds.items() for p in names.split()} for entity, kinds in ENTITIES.items()}
SPARK = {"string": T.StringType(), "date": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType()}


def column(path: str) -> str:
    """A path as a column name: without the entity, underscores for dots."""
    return path.split(".", 1)[1].replace(".", "_")


def schema(entity: str) -> T.StructType:
    """Every path of an entity, nullable; the dotted path is in the field's metadata. Dates are text, since partial ones are kept."""
    return T.StructType([T.StructField(column(p), SPARK[kind], True, {"path": p, "type": kind}) for p, kind in PATHS[entity].items()])
