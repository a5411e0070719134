"""Types of the fields of parsed JSON, which a conversion to text would hide."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_type(v: Column, field: str) -> Column:
    """Type name of a top-level field of a variant; NULL where the field is missing."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))


def json_string(v: Column, field: str) -> Column:
    """The field where it is a string, else NULL."""
    return F.when(json_type(v, field) == "STRING", F.try_variant_get(v, f"$.{field}", "string"))


def json_text(v: Column, field: str) -> Column:
    """Whether the field is a string with at least one character."""
    return F.coalesce(F.length(json_string(v, field)) > 0, F.lit(False))


def json_optional_text(v: Column, field: str) -> Column:
    """Whether the field is missing, null, or a string with at least one character."""
    return F.coalesce(json_type(v, field) == "VOID", F.lit(True)) | json_text(v, field)


def json_boolean(v: Column, field: str) -> Column:
    """The field where it is true or false, else NULL."""
    return F.when(json_type(v, field) == "BOOLEAN", F.try_variant_get(v, f"$.{field}", "boolean"))


def json_number(v: Column, field: str) -> Column:
    """The field where it is a number, else NULL."""
    numeric = F.rlike(json_type(v, field), F.lit("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"))
    return F.when(numeric, F.try_variant_get(v, f"$.{field}", "double"))


def json_integer(v: Column, field: str) -> Column:
    """Whether the field is a whole number."""
    number = F.try_variant_get(v, f"$.{field}", "double")
    numeric = F.rlike(json_type(v, field), F.lit("^(BIGINT|DOUBLE|DECIMAL)"))
    return F.coalesce(numeric & (number == F.floor(number)), F.lit(False))
