import math

import pytest
from pyspark.sql import functions as F

from rowtide.functions.types import logical
from rowtide.operators import cast, compare, nested
from rowtide.operators.order import ROW


def kinds(df, **how):
    return {r["column"]: r["optimal"] for r in cast.scan(df, **how).collect()}


def test_narrowing(spark):
    df = spark.createDataFrame([(0, 0, 300, -5, 1.0, 2.5, math.nan, 0.1, "1"), (1, 255, 70000, 7, 0.0, 3.0, 1.0, 0.2, "2.5")], "a long, b int, c long, d long, e double, f double, g double, h double, s string")
    assert kinds(df) == {"a": "bool", "b": "uint8", "c": "uint32", "d": "int8", "e": "bool", "f": "float", "g": "float", "h": "double", "s": "string"}
    assert kinds(df, string_to_value=True)["s"] == "float"
    assert kinds(df.where("false"))["a"] == "int64"
    same_width = spark.createDataFrame([(1 << 40, 100)], "a long, b byte")
    assert kinds(same_width) == {"a": "int64", "b": "int8"}


def test_saturating_casts(spark):
    df = spark.createDataFrame([(300, 2.5, "7"), (-1, math.nan, "-3.5"), (5, 1e300, "1e3"), (None, -0.5, None)], "i long, f double, s string")
    rows = cast.cast_static(df, "i=u8, f=int, s=i16").collect()
    assert [tuple(r) for r in rows] == [(255, 3, 7), (0, 0, -4), (5, 2147483647, 1000), (None, -1, None)]
    counts = {r["column"]: r["lossy"] for r in cast.loss_counts(df, "0:1=u8").collect()}
    assert counts == {"i": 2, "f": 4}
    assert logical(cast.cast_static(df, "i=u8").schema["i"]) == "uint8"
    kept = cast.cast_dynamic(df, "i=u8,f=double")
    assert kept.schema["i"].dataType.simpleString() == "bigint"
    edge = spark.createDataFrame([(float(1 << 63), (1 << 53) + 1), (1e30, 1 << 62)], "f double, i long")
    assert [int(r["f"]) for r in cast.cast_static(edge, "f=u64").collect()] == [1 << 63, (1 << 64) - 1]
    assert cast.loss_counts(edge, "i=double").first()["lossy"] == 1
    with pytest.raises(ValueError):
        cast.cast_static(spark.createDataFrame([("x",)], "s string"), "s=int")


def test_cast_plans():
    names = ["a", "b", "c"]
    assert cast.parse_spec("{0=int, c=f}", names) == {"a": "int32", "c": "float"}
    assert cast.parse_spec("i8,u8,d", names) == {"a": "int8", "b": "uint8", "c": "double"}
    for bad in ("a=int,a=long", "a=int,,b=int", "int", "a=int,float", "z=int", "a=void"):
        with pytest.raises(ValueError):
            cast.parse_spec(bad, names)


def test_compare(spark):
    a = spark.createDataFrame([(0, 1, 1.0, math.nan, "x"), (1, 2, 2.0, 1.0, "y"), (2, (1 << 53) + 1, 3.0, 1.0, "5")], f"{ROW} long, i long, f double, n double, s string")
    b = a.withColumn("f", F.col("f") + 0.25)
    assert compare.compare(a, a)["equal"]
    assert compare.compare(a, b)["mismatches"] == 3
    assert compare.compare(a, b, tolerance=0.5)["equal"]
    assert compare.compare(a, b, rows="0:1")["mismatches"] == 2
    assert compare.compare(a, b, cols="i,n,s")["equal"]
    c = a.withColumn("i", F.col("i").cast("double"))
    assert compare.compare(a, c)["layout"] == [(0, "int64", "double")]
    assert compare.compare(a, c, modes="value")["mismatches"] == 1
    assert compare.compare(a, a.where(f"{ROW} < 2"))["equal"] is False
    s = a.select(ROW, "s"), spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 5.0)], f"{ROW} long, s double")
    assert compare.compare(*s, modes="value", string_to_value=True)["mismatches"] == 2
    assert compare.compare(*s, modes="value")["mismatches"] == 3
    assert compare.validate(a, a).count() == 1
    with pytest.raises(ValueError):
        compare.parse_modes("names,colour")


def test_nested(spark):
    df = spark.createDataFrame([(0, (1, ("p", 2.0)), [1.0, 2.0], [(7,), (8,)])], f"{ROW} long, a struct<b:int,c:struct<d:string,e:double>>, v array<double>, w array<struct<x:int>>")
    flat = nested.flatten(df)
    assert flat.columns == [ROW, "a.b", "a.c.d", "a.c.e", "v[0]", "v[1]", "w[0].x", "w[1].x"]
    assert nested.unflatten(flat).collect() == df.collect()
    clash = spark.createDataFrame([(1, (2,))], "`a.b` int, a struct<b:int>")
    assert nested.flatten(clash).columns == ["a.b", "a_.b"]
    for bad, schema in (([([1],), ([1, 2],)], "v array<int>"), ([((1,),)], "a struct<b_:int>"), ([(1,)], "a_ int")):
        with pytest.raises(ValueError):
            nested.flatten(spark.createDataFrame(bad, schema))
    with pytest.raises(ValueError):
        nested.unflatten(spark.createDataFrame([(1, 2)], "a int, `a.b` int"))
    holes = spark.createDataFrame([(0, 1), (1, None), (2, None)], f"{ROW} long, x int")
    assert nested.first_nulls(holes) == {"x": 1}
