"""Nested tables as flat ones and back: structs as `a.b`, lists of one length as `v[0]`, lists of structs as `v[0].x`."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import ROW

MOST_DEPTH, MOST_ITEMS, MOST_ESCAPES = 64, 64, 64


def _lists(kind: T.DataType, at: Column, path: str) -> Iterator[tuple[str, Column]]:
    """(path, column) of every list, those within lists by their outer list's items."""
    if isinstance(kind, T.StructType):
        for f in kind:
            yield from _lists(f.dataType, at.getField(f.name), f"{path}.{f.name}")
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.ArrayType):
            raise ValueError(f"column {path!r} is a list of lists")
        yield path, at
        if isinstance(kind.elementType, T.StructType) and any(isinstance(f.dataType, T.ArrayType) for f in kind.elementType):
            raise ValueError(f"column {path!r} has lists within a list")


def list_sizes(df: DataFrame) -> dict[str, int]:
    """The length of each list column, one aggregation; lists of several lengths are an error. Without rows: 0."""
    found = [x for f in df.schema if f.name != ROW for x in _lists(f.dataType, F.col(f"`{f.name}`"), f.name)]
    if not found:
        return {}
    row = df.agg(*(e.alias(f"{n}{i}") for i, (_, c) in enumerate(found) for n, e in (("low", F.min(F.size(c))), ("high", F.max(F.size(c))))))
    row = row.first()
    sizes = {}
    for i, (path, _) in enumerate(found):
        low, high = row[f"low{i}"], row[f"high{i}"]
        if low != high:
            raise ValueError(f"column {path!r} has lists of {low} to {high} items")
        if (high or 0) > MOST_ITEMS:
            raise ValueError(f"column {path!r} has lists of {high} items, over {MOST_ITEMS}")
        sizes[path] = max(0, high or 0)
    return sizes


def _checked(name: str) -> str:
    if name.endswith("_"):
        raise ValueError(f"column name {name!r} ends with an underscore, which marks escaped names")
    return name


def flatten(df: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """df without nesting. A name that a flat column has already gets underscores after its parent: `a_.b`."""
    sizes = list_sizes(df) if sizes is None else sizes
    nested = (T.StructType, T.ArrayType)
    for f in df.schema:
        if isinstance(f.dataType, (T.MapType, T.BinaryType)):
            raise ValueError(f"column {f.name!r} has a type that can't be flattened")
    taken = {f.name for f in df.schema if not isinstance(f.dataType, nested)}
    out: list[Column] = []

    def add(parent: str, suffix: str, column: Column) -> None:
        name = parent + suffix
        for k in range(1, MOST_ESCAPES + 1):
            if name not in taken:
                break
            name = parent + "_" * k + suffix
        if name in taken:
            raise ValueError(f"no free name for {parent + suffix!r}")
        taken.add(name)
        out.append(column.alias(name))

    def walk(kind: T.DataType, at: Column, parent: str, suffix: str, path: str, depth: int) -> None:
        if depth > MOST_DEPTH:
            raise ValueError(f"column {path!r} is nested deeper than {MOST_DEPTH}")
        if isinstance(kind, T.StructType):
            for f in kind:
                walk(f.dataType, at.getField(f.name), parent + suffix, "." + _checked(f.name), f"{path}.{f.name}", depth + 1)
        elif isinstance(kind, T.ArrayType):
            for i in range(sizes[path]):
                walk(kind.elementType, F.get(at, F.lit(i)), parent + suffix, f"[{i}]", f"{path}[{i}]", depth + 1)
        else:
            add(parent, suffix, at)

    for f in df.schema:
        at = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, nested):
            out.append(at if f.name == ROW else at.alias(_checked(f.name)))
        else:
            walk(f.dataType, at, _checked(f.name), "", f.name, 0)
    return df.select(*out)


def unflatten(df: DataFrame) -> DataFrame:
    """The nested table of a flat one's names. A path that is both a value and a parent is an error, and so are list items
    with gaps. Underscores before a dot or bracket are what flatten added, and a name with them starts its own parent."""
    tree: dict = {}
    for c in df.columns:
        keys = re.findall(r"\[\d+\]|[^.\[\]]+", c)
        if not keys or "".join(k if k[0] == "[" else "." + k for k in keys)[1:] != c:
            keys = [c]
        node = tree
        for k in keys[:-1]:
            node = node.setdefault(k, {})
            if not isinstance(node, dict):
                raise ValueError(f"{c!r}: {k!r} is both a value and a parent")
        if keys[-1] in node:
            raise ValueError(f"{c!r} is both a value and a parent")
        node[keys[-1]] = F.col(f"`{c}`")

    def build(node) -> Column:
        if not isinstance(node, dict):
            return node
        items = [k for k in node if k[0] == "["]
        if not items:
            return F.struct(*(build(v).alias(k) for k, v in node.items()))
        if len(items) != len(node) or sorted(int(k[1:-1]) for k in items) != list(range(len(items))):
            raise ValueError(f"list items with gaps: {sorted(node)}")
        return F.array(*(build(node[f"[{i}]"]) for i in range(len(items))))

    return df.select(*(build(v).alias(k) for k, v in tree.items()))


def first_nulls(df: DataFrame) -> dict[str, int]:
    """The first row_idx at which each flat column that has nulls is null."""
    names = [c for c in df.columns if c != ROW]
    row = df.agg(*(F.min(F.when(F.col(f"`{c}`").isNull(), F.col(ROW))).alias(f"n{i}") for i, c in enumerate(names))).first()
    return {c: row[f"n{i}"] for i, c in enumerate(names) if row[f"n{i}"] is not None}


def require_values(df: DataFrame) -> DataFrame:
    found = first_nulls(df)
    if found:
        raise ValueError("nulls: " + ", ".join(f"{c!r} first in row {n}" for c, n in found.items()))
    return df
