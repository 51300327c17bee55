"""Comparison of two ordered tables: layout, then values row by row, across types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import FLOATS, INTS, big, logical
from .order import ROW
from .selection import columns, in_ranges, parse_ranges, row_count

MODES = ("names", "types", "values")
#: Named sets of modes.
NAMED = {"all": {"names", "types", "values"}, "strict": {"names", "types", "values"}, "compatible": {"types", "values"}, "value": {"values"}}
#: Integers beyond this may not have an exact double.
EXACT = 1 << 53


def parse_modes(text: str) -> set[str]:
    found: set[str] = set()
    for part in (p.strip().lower() for p in text.split(",")):
        if part not in MODES and part not in NAMED:
            raise ValueError(f"unknown comparison mode: {part!r}")
        found |= NAMED.get(part, {part})
    return found


def layout_differences(a: DataFrame, b: DataFrame, modes: set[str]) -> list[tuple[int, str, str]]:
    """(column index, side a, side b) of each difference; -1 for the number of columns."""
    fa, fb = ([f for f in t.schema if f.name != ROW] for t in (a, b))
    if len(fa) != len(fb):
        return [(-1, str(len(fa)), str(len(fb)))]
    names = [(i, x.name, y.name) for i, (x, y) in enumerate(zip(fa, fb)) if "names" in modes and x.name != y.name]
    return names + [(i, logical(x), logical(y)) for i, (x, y) in enumerate(zip(fa, fb)) if "types" in modes and logical(x) != logical(y)]


def _both_nan(x: Column, y: Column) -> Column:
    return F.isnan(x) & F.isnan(y)


def _close(x: Column, y: Column, tolerance: float) -> Column:
    """IEEE: a NaN is close to nothing; equal infinities are equal."""
    ok = (x == y) | (F.abs(x - y) <= tolerance) if tolerance else x == y
    return ~F.isnan(x) & ~F.isnan(y) & ok


def same(x: Column, kx: str, y: Column, ky: str, tolerance: float, imprecise: bool, string_to_value: bool) -> Column:
    """Whether two cells are equal; a null only equals a null."""
    whole = (*INTS, "bool")
    number = lambda v, k: v.cast("int") if k == "bool" else v
    if kx in FLOATS and ky in FLOATS:
        p, q = (x, y) if kx == ky else (x.cast("double"), y.cast("double"))
        found = _both_nan(p, q) | _close(p, q, tolerance)
    elif kx in whole and ky in whole:
        found = x == y if kx == ky else big(number(x, kx)) == big(number(y, ky))
    elif kx == ky == "string":
        found = x == y
    elif "string" in (kx, ky):
        if not string_to_value:
            return x.isNull() & y.isNull()
        double = lambda v, k: F.trim(v).try_cast("double") if k == "string" else number(v, k).cast("double")
        found = F.coalesce(_close(double(x, kx), double(y, ky), tolerance), F.lit(False))
    else:
        (i, ki), (f, kf) = ((x, kx), (y, ky)) if kx in whole else ((y, ky), (x, kx))
        space = "float" if kf == "float" and ki in ("bool", "int8", "int16", "uint8", "uint16") else "double"
        found = _close(number(i, ki).cast(space), f.cast(space), tolerance)
        if ki in ("int64", "uint64") and not imprecise:
            found = (big(i) <= EXACT) & (big(i) >= -EXACT) & found
    return F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(found)


def compare_values(a: DataFrame, b: DataFrame, tolerance: float = 0.0, allow_imprecise: bool = False, string_to_value: bool = False, rows: str = "", cols: str = "") -> DataFrame:
    """(row_idx, column_index, column, left, right) of every cell that differs, columns by position, of rows both have.

    rows and cols are index ranges. The tables have the same number of columns. One join on row_idx; nothing is capped.
    """
    names_a, names_b = ([c for c in t.columns if c != ROW] for t in (a, b))
    if len(names_a) != len(names_b):
        raise ValueError(f"{len(names_a)} and {len(names_b)} columns")
    if cols:
        chosen = columns(a, cols).columns
        pairs = [(i, x, y) for i, (x, y) in enumerate(zip(names_a, names_b)) if x in chosen]
    else:
        pairs = [(i, x, y) for i, (x, y) in enumerate(zip(names_a, names_b))]
    if rows:
        a = a.where(in_ranges(parse_ranges(rows, row_count(a))))
    left = a.select(ROW, *(F.col(f"`{x}`").alias(f"__a{i}") for i, x, _ in pairs))
    right = b.select(ROW, *(F.col(f"`{y}`").alias(f"__b{i}") for i, _, y in pairs))
    cells = []
    for i, x, y in pairs:
        p, q = F.col(f"__a{i}"), F.col(f"__b{i}")
        equal = same(p, logical(a.schema[x]), q, logical(b.schema[y]), tolerance, allow_imprecise, string_to_value)
        cells.append(F.when(~equal, F.struct(F.lit(i).alias("column_index"), F.lit(x).alias("column"), p.cast("string").alias("left"), q.cast("string").alias("right"))))
    return left.join(right, ROW).select(ROW, F.explode(F.array_compact(F.array(*cells))).alias("d")).select(ROW, "d.*")


def compare(a: DataFrame, b: DataFrame, modes: str = "all", report: int = 10, **how) -> dict:
    """equal, layout (differences end the comparison), rows (both counts), mismatches (number) and examples (report of
    them at most, in order). Row counts count only where values do."""
    wanted = parse_modes(modes)
    layout = layout_differences(a, b, wanted)
    result = {"equal": not layout, "layout": layout, "rows": None, "mismatches": 0, "examples": []}
    if layout or "values" not in wanted:
        return result
    result["rows"] = (row_count(a), row_count(b))
    if result["rows"][0] != result["rows"][1]:
        return result | {"equal": False}
    found = compare_values(a, b, **how)
    result["mismatches"] = found.count()
    if result["mismatches"]:
        result["examples"] = found.orderBy(ROW, "column_index").limit(report).collect()
    return result | {"equal": not result["mismatches"]}


def validate(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Cells of df that differ from the expected ones; here NaN differs from NaN."""
    found = compare_values(df, expected)
    nans = []
    for i, (x, y) in enumerate(zip((c for c in df.columns if c != ROW), (c for c in expected.columns if c != ROW))):
        if logical(df.schema[x]) in FLOATS:
            nans.append((i, x, y))
    if not nans:
        return found
    left = df.select(ROW, *(F.col(f"`{x}`").alias(f"__a{i}") for i, x, _ in nans))
    right = expected.select(ROW, *(F.col(f"`{y}`").alias(f"__b{i}") for i, _, y in nans))
    cells = [F.when(_both_nan(F.col(f"__a{i}").cast("double"), F.col(f"__b{i}").cast("double")), F.struct(F.lit(i).alias("column_index"), F.lit(x).alias("column"), F.lit("NaN").alias("left"), F.lit("NaN").alias("right"))) for i, x, _ in nans]
    return found.unionByName(left.join(right, ROW).select(ROW, F.explode(F.array_compact(F.array(*cells))).alias("d")).select(ROW, "d.*"))
