"""Delimited text: types found over whole files, rows of another shape, forced types, and a writer."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import BIG, FLOATS, SPARK, big, limits, logical, tagged, type_named
from ..operators.cast import coerced, smallest
from ..operators.order import ROW

DELIMITERS = (",", ";", "\t", "|")
_EXTRA = "__bad"
_NONE = "\x00"


def sniff(line: str) -> str:
    """The delimiter that a line has most often outside quotes; a comma if it has none."""
    outside = "".join(line.split('"')[::2])
    return max(DELIMITERS, key=outside.count)


def _number_text(cell: Column, decimal_sep: str) -> Column:
    return cell if decimal_sep == "." else F.regexp_replace(cell, "^([^" + decimal_sep + "]*)[" + decimal_sep + "]", "$1.")


def _classes(cell: Column, decimal_sep: str, tolerance: float) -> dict[str, Column]:
    """The folds that tell a column's type, as aggregates over its cells (trimmed; null and empty ones have no say)."""
    t = F.when(cell != "", cell)
    low = F.lower(t)
    integer = t.rlike(r"^[+-]?\d+$")
    digits = F.when(integer, t.try_cast("decimal(38,0)"))
    fits = integer & digits.isNotNull() & (digits >= F.lit(str(-(1 << 63))).cast("decimal(38,0)")) & (digits <= F.lit(str((1 << 64) - 1)).cast("decimal(38,0)"))
    text = _number_text(t, decimal_sep)
    special = low.rlike(r"^[+-]?(nan|inf|infinity)$")
    syntax = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    value = F.when(syntax & ~integer, text.try_cast("double"))
    huge = F.coalesce(integer & ~fits, F.lit(False)) | F.coalesce(F.abs(value) == float("inf"), F.lit(False))
    whole_value = F.rint(value)
    number = F.when(integer, digits.cast("double")).otherwise(value)
    return {
        "n": F.count(t),
        "tokens": F.bool_and(low.isin("true", "false", "1", "0")),
        "texts": F.count_if(~(syntax | special)),
        "huge": F.bool_or(huge),
        "ints": F.bool_and(integer),
        "special": F.bool_or(special),
        "low": F.min(F.when(fits, digits)),
        "high": F.max(F.when(fits, digits)),
        "inexact": F.bool_or(fits & (F.abs(digits) > (1 << 53)) & (digits.cast("double").cast("decimal(38,0)") != digits)),
        "whole": F.bool_and(F.abs(number - F.rint(number)) <= tolerance),
        "flow": F.min(whole_value),
        "fhigh": F.max(whole_value),
        "single": F.bool_and(F.isnan(number) | (number == number.cast("float").cast("double")) | (F.abs(number - number.cast("float").cast("double")) <= tolerance)),
    }


def _kind(r: dict) -> tuple[str, bool]:
    """(type, whether numbers had to stay text)."""
    if not r["n"]:
        return "string", False
    if r["tokens"]:
        return "bool", False
    if r["texts"]:
        return "string", False
    low, high = (int(r[k]) if r[k] is not None else None for k in ("low", "high"))
    if r["huge"] or low is not None and low < 0 and high > limits("int64")[1] or not r["ints"] and r["inexact"]:
        return "string", True
    if r["ints"]:
        return smallest(low, high), False
    if r["whole"] and not r["special"]:
        ends = [v for v in (low, high, r["flow"], r["fhigh"]) if v is not None]
        found = smallest(int(min(ends)), int(max(ends)))
        if found:
            return found, False
    return ("float" if r["single"] else "double"), False


def infer(cells: DataFrame, decimal_sep: str = ".", tolerance: float = 0.0) -> DataFrame:
    """(column_index, column, type, overflow) of a table of texts, from one aggregation over all rows and columns."""
    names = [c for c in cells.columns if c not in (ROW, _EXTRA)]
    folds = [_classes(F.trim(F.col(f"`{c}`")), decimal_sep, tolerance) for c in names]
    row = cells.agg(*(e.alias(f"c{i}_{k}") for i, fs in enumerate(folds) for k, e in fs.items())).first()
    found = []
    for i, c in enumerate(names):
        found.append((i, c, *_kind({k: row[f"c{i}_{k}"] for k in folds[i]})))
    return cells.sparkSession.createDataFrame(found, "column_index int, column string, type string, overflow boolean")


def raw_cells(spark: SparkSession, path: str, sep: str | None = None, header: bool = True, skip_header: bool = False, partial: str = "error", multi_line: bool = True) -> DataFrame:
    """All cells as texts. Without a header, or if it is skipped, columns are column_1, column_2, ...

    partial, for rows with too few or too many cells: error, skip, or pad (short rows get empty cells; long ones are still
    an error). Cells too many that are all empty are no fault. multi_line lets quoted cells hold line ends, and then a
    file is one task; without it files are split.
    """
    if partial not in ("error", "skip", "pad"):
        raise ValueError("partial is error, skip or pad")
    lines = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    if not lines:
        return spark.createDataFrame([], "column_1 string")
    top = lines[0][0].lstrip("﻿").rstrip("\r")
    sep = sep or sniff(top)
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": multi_line, "nullValue": _NONE, "emptyValue": "", "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    first = spark.read.csv(spark.sparkContext.parallelize([top], 1), sep=sep, quote='"', escape='"', nullValue=_NONE, emptyValue="").first()
    width = len(first)
    if header and not skip_header:
        names = [str(v).strip() or f"column_{i + 1}" for i, v in enumerate(first)]
        if len(set(names)) < width:
            raise ValueError(f"repeated column names: {names}")
    else:
        names = [f"column_{i + 1}" for i in range(width)]
    schema = T.StructType([T.StructField(f"__{i}", T.StringType()) for i in range(width)] + [T.StructField(_EXTRA, T.StringType())])
    rows = spark.read.schema(schema).options(**options).option("header", header or skip_header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _EXTRA).csv(path)
    short = F.col(f"__{width - 1}").isNull()
    tail = F.regexp_extract(_EXTRA, "([" + ("\\" + sep if sep in "|\t^]\\" else sep) + "\\s]*)$", 1)
    excess = F.col(_EXTRA).isNotNull() & ~short & (F.length(F.replace(tail, F.lit(sep))) == F.length(tail))
    if partial == "skip":
        rows = rows.where(~short & ~excess)
    else:
        bad = excess if partial == "pad" else short | excess
        rows = rows.withColumn("__0", F.when(bad, F.raise_error(F.concat(F.lit("a row has another number of cells: "), F.coalesce(_EXTRA, F.lit(""))))).otherwise(F.col("__0")))
    return rows.select(*(F.coalesce(F.trim(F.col(f"__{i}")), F.lit("")).alias(n) for i, n in enumerate(names)))


def typed(cells: DataFrame, kinds: dict[str, str], decimal_sep: str = ".") -> DataFrame:
    """Texts as values of kinds; cells out of range clamp, those that are no values become 0, false or empty."""
    out = []
    for c, kind in kinds.items():
        t = F.trim(F.col(f"`{c}`"))
        low = F.lower(t)
        if kind == "string":
            value = F.col(f"`{c}`")
        elif kind == "bool":
            value = F.when(low == "true", True).when(low == "false", False).otherwise(F.coalesce(_number_text(t, decimal_sep).try_cast("double") != 0, F.lit(False)))
        elif kind in FLOATS:
            value = F.coalesce(_number_text(t, decimal_sep).try_cast("double"), F.lit(0.0))
        else:
            exact = F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("decimal(38,0)"))
            lo, hi = (F.lit(str(v)).cast("decimal(38,0)") for v in limits(kind))
            value = F.coalesce(F.greatest(lo, F.least(hi, exact)).cast(BIG), coerced(_number_text(t, decimal_sep).try_cast("double"), "double", kind).cast(BIG), big(0))
        out.append(tagged(value, c, kind))
    return cells.select(*out)


def read(spark: SparkSession, path: str, decimal_sep: str = ".", tolerance: float = 0.0, forced: dict[str, str] | None = None, **how) -> DataFrame:
    """A delimited file or folder as a typed table: types are found over all rows, forced ones are taken as given."""
    cells = raw_cells(spark, path, **how)
    kinds = {r["column"]: r["type"] for r in infer(cells, decimal_sep, tolerance).collect()}
    for c, k in (forced or {}).items():
        if c not in kinds:
            raise ValueError(f"unknown column: {c}")
        kinds[c] = type_named(k)
    return typed(cells, kinds, decimal_sep)


def shortest(digits: str) -> str:
    """A number's shortest digits (as repr gives them) in the shorter of plain and scientific notation, plain on ties."""
    value = float(digits)
    if math.isnan(value) or math.isinf(value):
        return "nan" if math.isnan(value) else "inf" if value > 0 else "-inf"
    sign, ds, exponent = Decimal(digits).as_tuple()
    text = "".join(map(str, ds)).lstrip("0")
    cut = text.rstrip("0")
    exponent += len(text) - len(cut)
    minus = "-" if sign else ""
    if not cut:
        return minus + "0"
    if exponent >= 0:
        plain = cut + "0" * exponent
    elif -exponent < len(cut):
        plain = f"{cut[:exponent]}.{cut[exponent:]}"
    else:
        plain = "0." + "0" * (-exponent - len(cut)) + cut
    power = exponent + len(cut) - 1
    science = cut[0] + ("." + cut[1:] if len(cut) > 1 else "") + f"e{'-' if power < 0 else '+'}{abs(power):02d}"
    return minus + (plain if len(plain) <= len(science) else science)


@F.pandas_udf(T.StringType())
def _double_text(values: pd.Series) -> pd.Series:
    return values.map(lambda v: shortest(repr(float(v))))


@F.pandas_udf(T.StringType())
def _float_text(values: pd.Series) -> pd.Series:
    return values.map(lambda v: shortest(str(v)))


def lines(df: DataFrame, sep: str = ",", decimal_sep: str = ".") -> DataFrame:
    """(value) per row: texts quoted always, numbers in shortest form, true and false; nulls empty."""
    cells = []
    for f in df.schema:
        if f.name == ROW:
            continue
        x, kind = F.col(f"`{f.name}`"), logical(f)
        if kind == "string":
            text = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
        elif kind in FLOATS:
            text = F.when(x.isNotNull(), (_float_text if kind == "float" else _double_text)(F.coalesce(x, F.lit(0.0).cast(SPARK[kind]))))
            text = text if decimal_sep == "." else F.replace(text, F.lit("."), F.lit(decimal_sep))
        else:
            text = x.cast("string")
        cells.append(F.coalesce(text, F.lit("")))
    return df.select(F.concat_ws(sep, *cells).alias("value"))


def write(df: DataFrame, path: str, sep: str = ",", decimal_sep: str = ".", header: bool = True) -> None:
    """A folder of text parts in the table's order; each begins with the header, so that each is a file of its own."""
    names = sep.join('"' + c.replace('"', '""') + '"' for c in df.columns if c != ROW)

    def with_header(batches: Iterator) -> Iterator:
        begun = not header
        for batch in batches:
            if not begun and batch.num_rows:
                begun = True
                yield pa.RecordBatch.from_arrays([pa.array([names], batch.schema.field(0).type)], schema=batch.schema)
            yield batch

    ordered = df.repartitionByRange(ROW).sortWithinPartitions(ROW) if ROW in df.columns else df
    lines(ordered, sep, decimal_sep).mapInArrow(with_header, "value string").write.text(path)
