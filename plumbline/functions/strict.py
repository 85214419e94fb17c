"""Strict JSON: numbers that JSON cannot say become null, at any depth of a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from plumbline.functions.scalars import finite


def _odd(kind: DataType) -> bool:
    """Whether a type can hold a number that is not finite."""
    if isinstance(kind, StructType):
        return any(_odd(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _odd(kind.elementType)
    if isinstance(kind, MapType):
        return _odd(kind.valueType)
    return isinstance(kind, (DoubleType, FloatType))


def strict(value: Column, kind: DataType) -> Column:
    """`value` with NaN and infinities null in all structs, arrays and map values; nulls stay, keys are not touched."""
    if not _odd(kind):
        return value
    if isinstance(kind, StructType):
        fields = [strict(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda v: strict(v, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, v: strict(v, kind.valueType))
    return F.when(finite(value), value)


def strict_json(d: DataFrame) -> Column:
    """A row of `d` as one JSON object that any parser reads; null fields are written."""
    fields = [strict(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in d.schema.fields]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
