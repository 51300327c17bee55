"""Filter and project an ordered table by the language of plans.language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.language import BOOL, FLOAT, INT, STRING, UINT, Compiler, Node, parse_condition, parse_selection
from .order import BLOCK_ROWS, ROW, with_neighbours

_OUT = {BOOL: "boolean", INT: "long", UINT: "decimal(20,0)", FLOAT: "double", STRING: "string"}


def sample(df: DataFrame, condition: str = "true", selection: str | None = None, mode: str = "truncate", on_error: str = "throw", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of df (with row_idx 0..N-1) for which the condition holds, as the selection has them, with row_idx.

    mode: truncate drops rows whose neighbours lie beyond the ends, expand takes the first or last row for them. Both
    regard the farthest neighbours of condition and selection together. on_error, for integer division by zero: throw,
    skip_row, or saturate. Without a selection all columns stay.
    """
    if mode not in ("truncate", "expand"):
        raise ValueError("mode is truncate or expand")
    names = [c for c in df.columns if c != ROW]
    schema = T.StructType([df.schema[c] for c in names])
    cells: dict[str, tuple[str, int]] = {}

    def cell(offset: int, n: int):
        if not offset:
            return F.col(f"`{names[n]}`")
        cells[f"__c{n}_{offset}"] = (names[n], offset)
        return F.col(f"__c{n}_{offset}")

    compiler = Compiler(schema, cell, on_error)
    keep = compiler.condition(parse_condition(condition))
    nodes = parse_selection(selection) if selection is not None else [Node("row", [0])]
    out, taken = [], set()

    def add(column, name, metadata=None):
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(column.alias(name, metadata=metadata) if metadata else column.alias(name))

    skip = []
    for node in nodes:
        picked = range(len(names)) if node.op == "row" else [compiler.number(node.args[1], node.position)] if node.op == "cell" else None
        if picked is None:
            column, kind = compiler.value(node)
            add(column.cast(_OUT[kind]), f"expr{len(out)}")
            skip.append(column)
        else:
            k = node.args[0]
            compiler.offsets.add(k)
            for n in picked:
                add(cell(k, n), (names[n] or f"col{n}") + (f"_m{-k}" if k < 0 else f"_p{k}" if k else ""), schema[n].metadata)
    back, ahead = -min(compiler.offsets), max(compiler.offsets)
    rows = df
    if back or ahead:
        count = df.agg(F.max(ROW)).first()[0]
        count = 0 if count is None else count + 1
        rows = with_neighbours(df, cells, block_rows)
        if mode == "truncate":
            rows = rows.where((F.col(ROW) >= back) & (F.col(ROW) <= count - 1 - ahead))
        elif count:
            edges = {r[ROW]: r for r in df.where(F.col(ROW).isin(0, count - 1)).collect()}
            edge = lambda name, c, k: F.when(F.col(ROW) + k < 0, F.lit(edges[0][c])).when(F.col(ROW) + k >= count, F.lit(edges[count - 1][c])).otherwise(F.col(name)).cast(schema[c].dataType)
            rows = rows.withColumns({name: edge(name, c, k) for name, (c, k) in cells.items()})
    rows = rows.where(keep)
    if compiler.may_skip and skip:
        for column in skip:
            rows = rows.where(column.isNotNull())
    return rows.select(F.col(ROW), *out)
