"""Rows and columns by position."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import ROW


def row_count(df: DataFrame) -> int:
    last = df.agg(F.max(ROW)).first()[0]
    return 0 if last is None else last + 1


def head(df: DataFrame, n: int = 10) -> DataFrame:
    return df.where(F.col(ROW) < n)


def tail(df: DataFrame, n: int = 10) -> DataFrame:
    return df.where(F.col(ROW) >= row_count(df) - n)


def between(df: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """Rows first to last, both included."""
    if last is not None and first > last:
        raise ValueError("the first row comes after the last")
    return df.where((F.col(ROW) >= first) & (F.lit(True) if last is None else F.col(ROW) <= last))


def slice_rows(df: DataFrame, spec: str) -> DataFrame:
    """start:stop:step as in Python, half open; a single number n is 0:n; the step is 1 at least."""
    parts = [int(p) if p.strip() else None for p in spec.split(":")]
    if len(parts) > 3:
        raise ValueError(f"not a slice: {spec}")
    if len(parts) == 1:
        parts = [0, parts[0]]
    start, stop, step = (*parts, None, None)[:3]
    step = 1 if step is None else step
    if step < 1:
        raise ValueError("a slice's step is 1 at least")
    n = row_count(df) if (start or 0) < 0 or (stop or 0) < 0 else None
    start = max(0, n + start) if (start or 0) < 0 else start or 0
    stop = n + stop if stop is not None and stop < 0 else stop
    rows = df.where(F.col(ROW) >= start) if stop is None else df.where((F.col(ROW) >= start) & (F.col(ROW) < stop))
    return rows if step == 1 else rows.where((F.col(ROW) - start) % step == 0)


def parse_ranges(spec: str, total: int | None) -> list[tuple[int, int | None]]:
    """Inclusive ranges i, i:j, :j, i: in a comma list, sorted and merged. Negative bounds count from the end; with
    total None they are errors and an open end is unbounded. [] matches everything."""
    if not spec.strip() or total == 0:
        return []
    found = []
    for part in spec.split(","):
        m = re.fullmatch(r"\s*(-?\d+)?\s*(:)?\s*(-?\d+)?\s*", part)
        if not m or not (m[1] or m[2]) or m[3] and not m[2]:
            raise ValueError(f"not an index range: {part!r}")
        low = int(m[1]) if m[1] else 0
        high = (int(m[3]) if m[3] else None if total is None else total - 1) if m[2] else low
        if total is None and (low < 0 or (high or 0) < 0):
            raise ValueError("negative indices need a known length")
        low, high = (low + total if low < 0 else low), (high + total if high is not None and high < 0 else high)
        if total is not None and not (0 <= low < total and 0 <= high < total) or high is not None and low > high:
            raise ValueError(f"index range out of bounds: {part!r}")
        found.append((low, high))
    out: list[tuple[int, int | None]] = []
    for low, high in sorted(found, key=lambda r: r[0]):
        if out and (out[-1][1] is None or low <= out[-1][1] + 1):
            out[-1] = (out[-1][0], None if out[-1][1] is None or high is None else max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def in_ranges(ranges: list[tuple[int, int | None]], column: str = ROW) -> Column:
    test = F.lit(not ranges)
    for low, high in ranges:
        test = test | ((F.col(column) >= low) & (F.lit(True) if high is None else F.col(column) <= high))
    return test


def rows_in(df: DataFrame, spec: str) -> DataFrame:
    return df.where(in_ranges(parse_ranges(spec, row_count(df))))


def columns(df: DataFrame, spec: str | list, keep_order: bool = False) -> DataFrame:
    """Columns by index ranges or names; in the table's order, or in the order asked for."""
    names = [c for c in df.columns if c != ROW]
    wanted: list[str] = []
    for item in spec if isinstance(spec, list) else spec.split(","):
        item = str(item).strip()
        if item in names:
            wanted.append(item)
        else:
            try:
                ranges = parse_ranges(item, len(names))
            except ValueError:
                raise ValueError(f"unknown column: {item}") from None
            wanted += [names[k] for low, high in ranges for k in range(low, high + 1)]
    wanted = list(dict.fromkeys(wanted))
    ordered = wanted if keep_order else [c for c in names if c in wanted]
    return df.select(*[c for c in (ROW,) if c in df.columns], *(F.col(f"`{c}`") for c in ordered))


def every(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col(ROW) % n == 0)


def percent(df: DataFrame, column: str, p: int) -> DataFrame:
    """Rows whose column's hash falls among p of 100."""
    return df.where(F.pmod(F.xxhash64(F.col(column)), F.lit(100)) < p)
