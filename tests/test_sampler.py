import pytest

from rowtide.operators.cast import cast_static
from rowtide.operators.order import ROW, with_neighbours, with_row_index
from rowtide.operators.sampler import sample
from rowtide.operators.selection import parse_ranges, slice_rows
from rowtide.plans.language import ExprError

#: Rows whose results are known.
TABLE = [
    (1.0, 20.5, "ok", 6, 0), (2.0, 21.0, "ok", 7, 1), (3.0, 21.0, "warn", 3, 2), (4.0, 55.0, "alarm", 5, 3),
    (5.0, 55.0, "alarm", 5, 100), (6.0, 22.0, "ok", 7, 101), (7.0, 22.5, "ok", 6, 102),
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, *r) for i, r in enumerate(TABLE)]
    return spark.createDataFrame(rows, "row_idx long, timestamp double, temperature float, status string, flags int, counter int").repartition(3)


@pytest.mark.parametrize("condition,selection,mode,want", [
    ("true", "X[0][*]", "truncate", [1, 2, 3, 4, 5, 6, 7]),
    ("false", "X[0][*]", "truncate", []),
    ("X[0][1] > 50.0", "X[0][0], X[0][1]", "truncate", [4, 5]),
    ("X[0][1] != X[-1][1]", "X[0][0], X[-1][1], X[0][1]", "truncate", [2, 4, 6, 7]),
    ("X[0][1] != X[-1][1]", "X[0][0], X[-1][1], X[0][1]", "expand", [2, 4, 6, 7]),
    ('X[0][2] == "alarm"', "X[0][0], X[0][2]", "truncate", [4, 5]),
    ('X[0][2] != "ok"', "X[0][0], X[0][2]", "truncate", [3, 4, 5]),
    ("X[0][4] != 0 && X[0][1] / X[0][4] > 10.0", "X[0][0], X[0][1], X[0][4]", "truncate", [2, 3, 4]),
    ('X[0][1] > 50.0 || X[0][2] == "warn"', "X[0][0]", "truncate", [3, 4, 5]),
    ("(X[0][3] & 1) != 0", "X[0][0]", "truncate", [2, 3, 4, 5, 6]),
])
def test_vectors(table, condition, selection, mode, want):
    got = sample(table, condition, selection, mode, block_rows=3).orderBy(ROW).collect()
    assert [r[1] for r in got] == want


def test_gradient_and_names(table):
    out = sample(table, "true", "X[0][0], X[0][1] - X[-1][1], X[+1][2], X[0][0]", block_rows=2).orderBy(ROW)
    assert out.columns == [ROW, "timestamp", "expr1", "status_p1", "timestamp_"]
    assert [r.expr1 for r in out.collect()] == [0.5, 0.0, 34.0, 0.0, -33.0]


def test_errors(table):
    for text in ("X[0][9] > 1", 'X[0]["no"] > 1', "foo", "X[0][2] < 1", 'X[0][2] + "a"', "1 +", "X[0][1] % 2", '"text"', "X[0][*]", "1.", "(1"):
        with pytest.raises(ExprError):
            sample(table, text)


def test_division_policies(table):
    assert sample(table, "10 / X[0][4] > 0", "X[0][0]", on_error="skip_row").count() == 3
    first = sample(table, "true", "5 / X[0][4], 5 % X[0][4]", on_error="saturate").orderBy(ROW).first()
    assert first.expr0 == 2**63 - 1 and first.expr1 == 0
    with pytest.raises(Exception, match="division by zero"):
        sample(table, "10 / X[0][4] > 0").collect()


def test_row_index_and_neighbours(spark):
    df = spark.range(0, 500, 1, 7).selectExpr("id * 3 as k", "cast(id as string) as v")
    rows = with_row_index(df, "k")
    assert {(r.k, r.row_idx) for r in rows.collect()} == {(3 * i, i) for i in range(500)}
    got = {r.row_idx: (r.a, r.b) for r in with_neighbours(rows, {"a": ("k", -5), "b": ("k", 3)}, block_rows=9).collect()}
    assert got == {i: (3 * (i - 5) if i >= 5 else None, 3 * (i + 3) if i + 3 < 500 else None) for i in range(500)}


def test_ranges(table):
    assert parse_ranges("5,0:2,-2:", 10) == [(0, 2), (5, 5), (8, 9)] and parse_ranges("", 10) == []
    for bad in ("1+2", "5:3", "99", "-1"):
        with pytest.raises(ValueError):
            parse_ranges(bad, None if bad == "-1" else 10)
    assert sorted(r[ROW] for r in slice_rows(table, "1:-1:2").collect()) == [1, 3, 5]


def test_unsigned_columns(spark):
    df = cast_static(spark.createDataFrame([(0, 3, 5), (1, 9, 2)], "row_idx long, a long, b long"), "a=u8,b=u32")
    out = sample(df, "true", "X[0][0] - X[0][1], X[0][0] + 1, X[0][0] - 10")
    assert [tuple(map(int, r)) for r in out.orderBy("row_idx").collect()] == [(0, 2**64 - 2, 4, -7), (1, 7, 10, -1)]
    assert [f.dataType.simpleString() for f in out.schema][1:] == ["decimal(20,0)", "bigint", "bigint"]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_integers_wrap(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([(0, 2**63 - 1, -(2**63))], "row_idx long, a long, b long")
        row = sample(df, "true", "X[0][0] + 1, X[0][1] - 1, X[0][0] * X[0][0], -X[0][1]").first()
        assert tuple(row) == (0, -(2**63), 2**63 - 1, 1, -(2**63))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
