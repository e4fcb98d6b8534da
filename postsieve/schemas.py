"""Row layouts. Two of the file layouts have twelve columns in different positions, so a
reader is always told which one it reads."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "citizenship_required": T.BooleanType(),
    "security_clearance_required": T.BooleanType(),
    "visa_sponsorship": T.BooleanType(),
    "age_match": T.BooleanType(),
    "match_score": T.DoubleType(),
}

# --- fixed values: keys of a model answer and column order of the three file layouts ---------
FLAGS = ("citizenship_required", "security_clearance_required", "visa_sponsorship")
RESPONSE_KEYS = ("company", "min_exp", "max_exp", "overall", "primary", "secondary") + FLAGS
LAYOUTS = {
    "raw_v2": ("title", "company", "min_exp", "max_exp", "overall", "primary", "secondary",
               "citizenship_required", "security_clearance_required", "visa_sponsorship",
               "match_score", "link"),
    "raw_v1": ("title", "company", "min_exp", "max_exp", "age_match", "overall", "primary",
               "secondary", "citizenship_required", "security_clearance_required",
               "visa_sponsorship", "link"),
    "digest": ("title", "company", "min_exp", "max_exp", "age_match", "overall", "primary",
               "secondary", "citizenship_required", "security_clearance_required",
               "visa_sponsorship", "link"),
}
# ----------------------------------------------------------------------------------------------

QUARANTINE = ("link", "stage", "reason", "raw")
CORRUPT = "_corrupt_record"


def column_type(name: str) -> T.DataType:
    return _TYPES.get(name, T.StringType())


def layout(name: str, corrupt: bool = False) -> T.StructType:
    """Schema of a file layout, with the corrupt-record column appended on request."""
    fields = [T.StructField(column, column_type(column)) for column in LAYOUTS[name]]
    if corrupt:
        fields.append(T.StructField(CORRUPT, T.StringType()))
    return T.StructType(fields)


# every value is parsed as text first: declared booleans would turn "False" into a corrupt record
RESPONSE = T.StructType([T.StructField(key, T.StringType()) for key in RESPONSE_KEYS])
LEGACY_RESPONSE = T.StructType(RESPONSE.fields + [T.StructField("age_match", T.StringType())])
