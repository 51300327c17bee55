import pytest

from rowtide.functions.types import logical
from rowtide.sources import delimited


def put(folder, text):
    path = folder / "t.csv"
    path.write_bytes(text.encode())
    return f"file://{path}"


def kinds(df):
    return {f.name: logical(f) for f in df.schema}


def test_types(spark, tmp_path):
    path = put(tmp_path, "u,i,w,f,d,big,b,s,e,huge\n0,-100,1000,3.14,3.141592653589793,9999999999999999999,true,x,,99999999999999999999\n255,100,50000,2.71,1.0,1,0,1,,1\n")
    df = delimited.read(spark, path, tolerance=1e-6)
    assert kinds(df) == {"u": "uint8", "i": "int8", "w": "uint16", "f": "float", "d": "float", "big": "uint64", "b": "bool", "s": "string", "e": "string", "huge": "string"}
    assert kinds(delimited.read(spark, path))["d"] == "double"
    assert [int(r["big"]) for r in df.collect()] == [9999999999999999999, 1]
    forced = delimited.read(spark, path, forced={"w": "u8"})
    assert [r["w"] for r in forced.collect()] == [255, 255]


def test_shapes(spark, tmp_path):
    path = put(tmp_path, '﻿a;b;c\r\n1,5;"x\ny";2\r\n\r\n2,5;z;3\r\n')
    df = delimited.read(spark, path, decimal_sep=",")
    assert [tuple(r) for r in df.collect()] == [(1.5, "x\ny", 2), (2.5, "z", 3)]
    path = put(tmp_path, "a,b\n1,2\n3\n4,5,6\n7,8,\n")
    with pytest.raises(Exception, match="number of cells"):
        delimited.raw_cells(spark, path).collect()
    assert [tuple(r) for r in delimited.raw_cells(spark, path, partial="skip").collect()] == [("1", "2"), ("7", "8")]
    path = put(tmp_path, "1,2\n3\n")
    assert [tuple(r) for r in delimited.raw_cells(spark, path, header=False, partial="pad").collect()] == [("1", "2"), ("3", "")]
    assert delimited.raw_cells(spark, path, header=False, partial="pad").columns == ["column_1", "column_2"]


def test_shortest():
    assert [delimited.shortest(x) for x in ("10000000.0", "0.1", "100.0", "1e-05", "123456.0", "-0.0", "1.5e+300", "nan")] == ["1e+07", "0.1", "100", "1e-05", "123456", "-0", "1.5e+300", "nan"]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, 'a"b', 1.5, True), (1, "c,d", 2.25, False)], "row_idx long, s string, x double, b boolean")
    delimited.write(df, f"file://{tmp_path}/out")
    back = delimited.read(spark, f"file://{tmp_path}/out")
    assert sorted(tuple(r) for r in back.collect()) == [('a"b', 1.5, True), ("c,d", 2.25, False)]
