"""Narrowing and casting: the smallest types that hold a table, loss counts, saturating casts.

Nulls are passed over by scans and stay null in casts. A column without values keeps its type.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import BIG, FLOATS, INTS, SIGNED, SPARK, UNSIGNED, big, finite, limits, logical, tagged, to_int, type_named, whole, width
from .order import ROW

SCAN_SCHEMA = "column_index int, column string, original string, optimal string"


def _names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW]


def smallest(low: int, high: int, unsigned_below: int = 128, signed_below: int = 128) -> str | None:
    """The smallest type of low..high: bool, then unsigned for values from 0 on, else signed. Of widths under the bounds."""
    if low >= 0:
        if high <= 1:
            return "bool"
        return next((k for k in UNSIGNED if width(k) < unsigned_below and high <= limits(k)[1]), None)
    return next((k for k in SIGNED if width(k) < signed_below and limits(k)[0] <= low and high <= limits(k)[1]), None)


def parsed(text: Column) -> Column:
    """A text as double: null unless it is a finite number without space at its edges. Hexadecimal numbers are none."""
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    return F.when(finite(number), number)


def _float_folds(x: Column, n: str, tolerance: float, single: Column) -> list[Column]:
    near = F.rint(x)
    return [
        F.bool_and(finite(x)).alias(n + "finite"),
        F.bool_and(x.isin(0.0, 1.0)).alias(n + "bits"),
        F.bool_and(finite(x) & (F.abs(x - near) <= tolerance)).alias(n + "whole"),
        F.min(F.when(finite(x), near)).alias(n + "low"),
        F.max(F.when(finite(x), near)).alias(n + "high"),
        F.bool_and(F.isnan(x) | (x == single) | (F.abs(x - single) <= tolerance)).alias(n + "single"),
    ]


def _folds(df: DataFrame, tolerance: float) -> list[Column]:
    out = []
    for i, c in enumerate(_names(df)):
        x, kind, n = F.col(f"`{c}`"), logical(df.schema[c]), f"c{i}_"
        out.append(F.count(x).alias(n + "n"))
        if kind in INTS:
            out += [F.min(x).alias(n + "low"), F.max(x).alias(n + "high")]
        elif kind in FLOATS or kind == "string":
            v = parsed(x) if kind == "string" else x.cast("double")
            out += _float_folds(v, n, tolerance, v.cast("float").cast("double"))
            if kind == "string":
                out.append(F.count(v).alias(n + "numbers"))
    return out


def _optimal(kind: str, r: dict, string_to_value: bool) -> str:
    if not r["n"] or kind == "bool":
        return kind
    if kind in INTS:
        bits = width(kind)
        return smallest(int(r["low"]), int(r["high"]), bits, bits) or kind
    if kind == "string" and not (string_to_value and r["numbers"] == r["n"]):
        return kind
    if r["bits"]:
        return "bool"
    if r["whole"]:
        found = smallest(int(r["low"]), int(r["high"]))
        if found:
            return found
    return "float" if r["single"] else "double"


def scan(df: DataFrame, tolerance: float = 0.0, string_to_value: bool = False) -> DataFrame:
    """One row per column: its type and the smallest without loss, from a single aggregation over all columns."""
    if not 0 <= tolerance < float("inf"):
        raise ValueError("a tolerance is finite and not negative")
    names = _names(df)
    row = df.agg(F.count("*").alias("rows"), *_folds(df, tolerance)).first().asDict()
    found = []
    for i, c in enumerate(names):
        kind = logical(df.schema[c])
        of = {k[len(f"c{i}_") :]: v for k, v in row.items() if k.startswith(f"c{i}_")}
        found.append((i, c, kind, _optimal(kind, of, string_to_value)))
    return df.sparkSession.createDataFrame(found, SCAN_SCHEMA)


def parse_spec(spec: str, names: list[str]) -> dict[str, str]:
    """A cast plan, column to type: a map `0=int32,price=float,7:8=double`, or the types of all columns in order."""
    text = spec.strip()
    if text.startswith("{") and text.endswith("}"):
        text = text[1:-1]
    parts = [p.strip() for p in text.split(",")]
    if any(not p for p in parts):
        raise ValueError("empty part in a cast plan")
    if not any("=" in p for p in parts):
        if len(parts) != len(names):
            raise ValueError(f"{len(parts)} types for {len(names)} columns")
        return {c: type_named(p) for c, p in zip(names, parts)}
    if not all("=" in p for p in parts):
        raise ValueError("a cast plan is a map or a list, not both")
    plan: dict[str, str] = {}
    for part in parts:
        key, kind = part.rsplit("=", 1)
        key = key.strip()
        span = re.fullmatch(r"(\d+)(?::(\d+))?", key)
        if key in names:
            chosen = [key]
        elif span and int(span[1]) <= int(span[2] or span[1]) < len(names):
            chosen = names[int(span[1]) : int(span[2] or span[1]) + 1]
        else:
            raise ValueError(f"unknown column: {key}")
        for c in chosen:
            if c in plan:
                raise ValueError(f"column {c!r} is given twice")
            plan[c] = type_named(kind)
    return plan


def coerced(x: Column, source: str, target: str) -> Column:
    """x cast with saturation: integers clamp, floats round half away from zero and clamp, NaN is 0, anything but 0 is
    true. A text that is no number is null."""
    if source == target or target == "string" and source == "string":
        return x
    if target == "string":
        return x.cast("string")
    if source == "string":
        text = F.trim(x)
        exact = F.when(text.rlike(r"^[+-]?\d{1,19}$"), text.try_cast(BIG))
        if target in INTS:
            return F.coalesce(coerced(exact, "uint64", target), coerced(parsed(text), "double", target))
        return coerced(parsed(text), "double", target)
    if target == "bool":
        return x != 0
    if target in FLOATS:
        return (x.cast("int") if source == "bool" else x).cast(target)
    if source in FLOATS:
        return to_int(x.cast("double"), target).cast(SPARK[target])
    low, high = limits(target)
    value = big(x.cast("int") if source == "bool" else x)
    return F.when(value > high, big(high)).when(value < low, big(low)).otherwise(value).cast(SPARK[target])


def lossy(x: Column, source: str, target: str, tolerance: float = 0.0) -> Column:
    """Whether the cast changes the value."""
    if source == target or target == "string" or source == "bool":
        return F.lit(False)
    if source == "string":
        number = parsed(F.trim(x))
        return number.isNull() | F.coalesce(lossy(number, "double", target, tolerance), F.lit(False))
    if target == "bool":
        return ~x.isin(0, 1) if source in INTS else F.isnan(x) | ((x != 0) & (x != 1))
    if source in FLOATS:
        d = x.cast("double")
        if target in FLOATS:
            single = d.cast("float").cast("double")
            return F.lit(False) if target == "double" else ~(F.isnan(d) | (d == single) | (F.abs(d - single) <= tolerance))
        low, high = limits(target)
        top = float(high) if width(target) < 64 else float(high + 1)
        beyond = (whole(d) > top) if width(target) < 64 else (d >= top)
        return F.when(~finite(d), True).otherwise(beyond | (whole(d) < float(low)) | (F.abs(d - whole(d)) > tolerance))
    if target in FLOATS:
        # significant bits beyond the mantissa: the value isn't a multiple of its last place
        bits = 24 if target == "float" else 53
        size = F.abs(x.cast("decimal(38,0)"))
        unit = F.lit("1").cast("decimal(38,0)")
        for extra in range(1, max(1, 65 - bits)):
            unit = F.when(size >= F.lit(str(1 << (bits + extra - 1))).cast("decimal(38,0)"), F.lit(str(1 << extra)).cast("decimal(38,0)")).otherwise(unit)
        return (size % unit) != 0
    low, high = limits(target)
    return (big(x) < low) | (big(x) > high)


def loss_counts(df: DataFrame, spec: str, tolerance: float = 0.0) -> DataFrame:
    """(column, original, target, lossy) for each column of the plan, in one aggregation; lossy counts the cells that change."""
    plan = parse_spec(spec, _names(df))
    row = df.agg(*(F.count_if(lossy(F.col(f"`{c}`"), logical(df.schema[c]), k, tolerance)).alias(f"n{i}") for i, (c, k) in enumerate(plan.items()))).first()
    found = [(c, logical(df.schema[c]), k, row[f"n{i}"]) for i, (c, k) in enumerate(plan.items())]
    return df.sparkSession.createDataFrame(found, "column string, original string, target string, lossy long")


def _applied(df: DataFrame, plan: dict[str, str]) -> DataFrame:
    out = []
    for f in df.schema:
        x = F.col(f"`{f.name}`")
        target = plan.get(f.name)
        out.append(x if target is None or target == logical(f) else tagged(coerced(x, logical(f), target), f.name, target))
    return df.select(*out)


def cast_static(df: DataFrame, spec: str) -> DataFrame:
    """df with the plan's types by force, values clamped. A text that is no number raises an error before anything is cast."""
    plan = parse_spec(spec, _names(df))
    texts = [c for c, k in plan.items() if logical(df.schema[c]) == "string" and k != "string"]
    if texts:
        bad = df.agg(*(F.count_if(F.col(f"`{c}`").isNotNull() & parsed(F.trim(F.col(f"`{c}`"))).isNull()).alias(f"n{i}") for i, c in enumerate(texts))).first()
        for i, c in enumerate(texts):
            if bad[f"n{i}"]:
                raise ValueError(f"column {c!r}: {bad[f'n{i}']} texts are no numbers")
    return _applied(df, plan)


def cast_dynamic(df: DataFrame, spec: str, tolerance: float = 0.0) -> DataFrame:
    """df with the plan's types where no cell changes; the other columns keep theirs."""
    safe = {r["column"]: r["target"] for r in loss_counts(df, spec, tolerance).collect() if not r["lossy"]}
    return _applied(df, safe)


def optimize(df: DataFrame, tolerance: float = 0.0, string_to_value: bool = False) -> DataFrame:
    """df in the smallest types that scan finds."""
    return _applied(df, {r["column"]: r["optimal"] for r in scan(df, tolerance, string_to_value).collect() if r["optimal"] != r["original"]})


def suggested_spec(df: DataFrame, tolerance: float = 0.0, string_to_value: bool = False) -> str:
    """The plan of the columns that scan narrows, as a map by position."""
    return ",".join(f"{r['column_index']}={r['optimal']}" for r in scan(df, tolerance, string_to_value).collect() if r["optimal"] != r["original"])


def numeric_stats(df: DataFrame) -> DataFrame:
    """min, max, sum, count, mean of all cells in numeric columns (not bool), as double; NaN cells take part as in Spark."""
    cells = F.explode(F.array(*(F.col(f"`{c}`").cast("double") for c in _names(df) if logical(df.schema[c]) in INTS + FLOATS)))
    v = df.select(cells.alias("v")).where("v is not null")
    return v.agg(F.min("v").alias("min"), F.max("v").alias("max"), F.sum("v").alias("sum"), F.count("v").alias("count"), F.avg("v").alias("mean"))


def header(df: DataFrame) -> DataFrame:
    """(column_index, column, type) of the table."""
    rows = [(i, c, logical(df.schema[c])) for i, c in enumerate(_names(df))]
    return df.sparkSession.createDataFrame(rows, T._parse_datatype_string("column_index int, column string, type string"))
