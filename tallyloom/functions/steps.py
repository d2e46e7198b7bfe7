"""Which steps a run of a project consists of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.rules import DEPLOYS, GENERATES, TUNES

# Step names in run order, with the execution types that include them
# (None: every type, known or not).
STEPS = [
    ("validate_data", None),
    ("ocr_extraction", None),
    ("chunk_data", None),
    ("generate_dataset", GENERATES),
    ("fine_tune", TUNES),
    ("deploy_model", DEPLOYS),
]

# Fixed value: how long a step result is kept.
RETENTION = "24 hours"

# The status of a step that ran, and of a run that went through.
STEP_STATUS = "success"
RUN_STATUS = "completed"


def is_planned(step: str, execution_type: Column) -> Column:
    types = dict(STEPS)[step]
    if types is None:
        return F.lit(True)
    return F.coalesce(execution_type.isin(types), F.lit(False))


def planned_steps(execution_type: Column) -> Column:
    """Array of step names in run order."""
    return F.array_compact(F.array(*[
        F.when(is_planned(step, execution_type), F.lit(step)) for step, _ in STEPS
    ]))
