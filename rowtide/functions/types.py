"""The twelve logical types, their Spark types, names and ranges. Unsigned types are kept in a wider Spark type, with the
logical type in the field's metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG = "logical"
BIG = "decimal(20,0)"
SPARK = {
    "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint",
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": BIG,
    "float": "float", "double": "double", "string": "string",
}
SIGNED, UNSIGNED = ("int8", "int16", "int32", "int64"), ("uint8", "uint16", "uint32", "uint64")
INTS, FLOATS = SIGNED + UNSIGNED, ("float", "double")

#: Further names of the types.
ALIASES = {
    "b": "bool",
    "i8": "int8", "sbyte": "int8",
    "i16": "int16", "short": "int16",
    "i32": "int32", "int": "int32",
    "i64": "int64", "long": "int64",
    "ui8": "uint8", "u8": "uint8", "uchar": "uint8", "char": "uint8", "ch": "uint8", "byte": "uint8",
    "ui16": "uint16", "u16": "uint16", "ushort": "uint16",
    "ui32": "uint32", "u32": "uint32", "uint": "uint32",
    "ui64": "uint64", "u64": "uint64", "ulong": "uint64",
    "f": "float", "f32": "float", "single": "float",
    "d": "double", "f64": "double",
    "str": "string", "s": "string",
}

_PLAIN = {"boolean": "bool", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", BIG: "uint64", "float": "float", "double": "double", "string": "string"}


def type_named(name: str) -> str:
    low = name.strip().lower()
    kind = ALIASES.get(low, low)
    if kind not in SPARK:
        raise ValueError(f"unknown type: {name!r}")
    return kind


def width(kind: str) -> int:
    return int(kind.lstrip("uint"))


def limits(kind: str) -> tuple[int, int]:
    bits = width(kind)
    return (0, (1 << bits) - 1) if kind in UNSIGNED else (-(1 << (bits - 1)), (1 << (bits - 1)) - 1)


def logical(field: T.StructField) -> str:
    """A field's logical type: its tag, or what its Spark type stands for."""
    kind = (field.metadata or {}).get(TAG) or _PLAIN.get(field.dataType.simpleString())
    if kind is None:
        raise ValueError(f"column {field.name!r} has a type outside the twelve: {field.dataType.simpleString()}")
    return kind


def tagged(column: Column, name: str, kind: str) -> Column:
    return column.cast(SPARK[kind]).alias(name, metadata={TAG: kind})


def big(value: int | Column) -> Column:
    """Any of the integer types as decimal(20,0)."""
    return (value if isinstance(value, Column) else F.lit(str(value))).cast(BIG)


def finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def whole(x: Column) -> Column:
    """A finite double rounded half away from zero."""
    size = F.abs(x)
    low = F.floor(F.least(size, F.lit(float(1 << 62)))).cast("double")
    near = F.when(size >= float(1 << 52), size).when(size.isNotNull(), low + F.when(size - low >= 0.5, 1.0).otherwise(0.0))
    return F.when(x < 0, -near).otherwise(near)


def to_int(x: Column, kind: str) -> Column:
    """A double as an integer type: rounded half away from zero, clamped, NaN as 0. The value is a decimal(20,0)."""
    low, high = limits(kind)
    r, half = whole(x), float(1 << 63)
    upper = (r - half).cast("long").cast(BIG) + big(1 << 63) if kind == "uint64" else F.lit(None).cast(BIG)
    inside = F.when(r < half, r.cast("long").cast(BIG)).otherwise(upper.cast(BIG))
    return F.when(F.isnan(x), big(0)).when(x >= float(high), big(high)).when(x <= float(low), big(low)).otherwise(inside)
