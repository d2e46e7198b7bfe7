"""Metadata rules by execution type, and JSON object helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The execution types, in the order the error message lists them.
EXECUTION_TYPES = ["dataset_generation", "fine_tune", "dataset_and_fine_tune", "full_pipeline"]

# The types that include each kind of work.
GENERATES = ["dataset_generation", "dataset_and_fine_tune", "full_pipeline"]
TUNES = ["fine_tune", "dataset_and_fine_tune", "full_pipeline"]
DEPLOYS = ["full_pipeline"]

# Required metadata keys in the order they are checked.
REQUIRED_KEYS = [
    ("gen_model", GENERATES),
    ("min_samples", GENERATES),
    ("base_model", TUNES),
    ("deploy_instance_type", DEPLOYS),
]

# Message texts.
MESSAGES = {
    "invalid_execution_type": f"Invalid execution type. Must be one of: {EXECUTION_TYPES}",
    "missing_gen_model": "Missing 'gen_model' in metadata for dataset generation",
    "missing_min_samples": "Missing 'min_samples' in metadata for dataset generation",
    "missing_base_model": "Missing 'base_model' in metadata for fine tuning",
    "missing_deploy_instance_type": "Missing 'deploy_instance_type' in metadata for deployment",
}


def is_known_type(execution_type: Column) -> Column:
    """False, not NULL, for a NULL type."""
    return F.coalesce(execution_type.isin(EXECUTION_TYPES), F.lit(False))


def json_keys(json: Column) -> Column:
    """Array of the object's keys, NULL for anything but a JSON object. Parse once, ask often."""
    return F.json_object_keys(json)


def has_key(keys: Column, key: str) -> Column:
    """Whether the parsed keys hold this one, whatever its value; false without an object."""
    return F.coalesce(F.array_contains(keys, key), F.lit(False))


def required_keys(execution_type: Column) -> Column:
    """Array of the keys a known type requires, in checking order; NULL for an unknown type."""
    arrays = [
        (kind, F.array(*[F.lit(key) for key, types in REQUIRED_KEYS if kind in types]))
        for kind in EXECUTION_TYPES]
    required = F.when(execution_type == arrays[0][0], arrays[0][1])
    for kind, array in arrays[1:]:
        required = required.when(execution_type == kind, array)
    return required


def first_metadata_error(execution_type: Column, keys: Column) -> Column:
    """Code of the first failing rule, NULL if all hold. Only the presence of keys is tested.

    ``keys`` occurs once, so they are parsed once even where the optimizer inlines this.
    """
    present = F.coalesce(keys, F.array().cast("array<string>"))
    missing = F.get(F.array_except(required_keys(execution_type), present), F.lit(0))
    return F.when(~is_known_type(execution_type), "invalid_execution_type").otherwise(
        F.concat(F.lit("missing_"), missing))


def error_message(code: Column) -> Column:
    message = F.lit(None).cast("string")
    for name, text in MESSAGES.items():
        message = F.when(code == name, text).otherwise(message)
    return message


def is_blank(text: Column) -> Column:
    """NULL or empty; white space counts as content."""
    return text.isNull() | (text == "")


def is_email(text: Column) -> Column:
    """One @, no white space, and a dot inside the domain."""
    return F.coalesce(text.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit(False))
