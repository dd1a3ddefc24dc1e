"""Declared fields of delimited files: type, mask, trim."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "boolean": T.BooleanType(),
}
_TRIMS = {
    "none": lambda c: c,
    "left": F.ltrim,
    "right": F.rtrim,
    "both": F.trim,
}


@dataclass(frozen=True)
class Field:
    """One column of a file.

    ``fmt`` is the date or timestamp mask; ``group`` and ``decimal`` are the number signs.
    A ``decimal`` column takes ``precision`` and ``scale``.
    """

    name: str
    type: str = "string"
    trim: str = "none"
    fmt: str | None = None
    group: str = ""
    decimal: str = "."
    precision: int = 38
    scale: int = 18

    @property
    def spark_type(self) -> T.DataType:
        if self.type == "decimal":
            return T.DecimalType(self.precision, self.scale)
        return _TYPES[self.type]


def named(name: str) -> Column:
    """A column by its literal name, which may hold blanks and dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def file_name() -> Column:
    """Name of the file a row comes from; the metadata column holds it in URL form."""
    encoded = F.col("_metadata.file_name")
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def strings(*names: str, trim: str = "both") -> list[Field]:
    return [Field(n, trim=trim) for n in names]


def struct_of(fields: Iterable[Field]) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.spark_type) for f in fields])


def parse_field(field: Field, text: Column) -> Column:
    """Typed value of a text column; text that does not fit the mask becomes NULL."""
    text = _TRIMS[field.trim](text)
    if field.type == "string":
        return text
    text = F.trim(text)
    if field.type == "date":
        return F.try_to_date(text, field.fmt or "yyyy-MM-dd")
    if field.type == "timestamp":
        return F.try_to_timestamp(text, F.lit(field.fmt)) if field.fmt else text.try_cast("timestamp")
    if field.type == "boolean":
        # Spark's cast also takes y/n/1/0 as booleans; files hold true/false only.
        lower = F.lower(text)
        return F.when(lower == "true", True).when(lower == "false", False)
    if field.group:
        text = F.replace(text, F.lit(field.group), F.lit(""))
    if field.decimal != ".":
        text = F.replace(text, F.lit(field.decimal), F.lit("."))
    return text.try_cast(field.spark_type)
