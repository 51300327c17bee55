"""The engine's registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cast, compare, nested, selection
from ..operators.order import ROW, first_rows, last_rows, shared_path, with_row_index
from ..operators.sampler import sample
from ..sources import delimited


def plain_events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")


def events(spark, sf_dir):
    return with_row_index(plain_events(spark, sf_dir), "event_id")


def _unsigned(condition, selection):
    """Over events with event_id as uint32 and user_id as uint16, clamped."""
    return lambda spark, sf_dir: sample(cast.cast_static(events(spark, sf_dir), "event_id=u32,user_id=u16"), condition, selection)


def _as_text(**how):
    """Events written as delimited text and read back, with inferred types as far as none are forced."""

    def query(spark, sf_dir):
        path = shared_path(spark)
        delimited.write(plain_events(spark, sf_dir), path)
        back = delimited.read(spark, path, **how)
        return back.select(*(F.col(c).cast("long") for c in ("event_id", "user_id")), "event_type", F.col("value").cast("double"))

    return query


def _sampled(condition, selection, **how):
    return lambda spark, sf_dir: sample(events(spark, sf_dir), condition, selection, **how)


_E = "WITH e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_idx, event_id, user_id, event_type, value FROM events), n AS (SELECT count(*) AS n FROM events)"
_WIN = "SELECT e.*, lag(value, 1) OVER w AS m1, lag(value, 2) OVER w AS m2, lead(value, 1) OVER w AS p1, lag(event_type, 1) OVER w AS t1, lag(user_id) OVER w AS u1, n.n FROM e, n WINDOW w AS (ORDER BY row_idx)"
_ALL = "row_idx, event_id, user_id, event_type, value"



def lineitem(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")


def _compared(change, **how):
    """Where events differ from a changed copy, cell by cell."""

    def query(spark, sf_dir):
        rows = events(spark, sf_dir)
        return compare.compare_values(rows, change(rows), **how).select(ROW, "column_index", "column")

    return query


_SCAN = [(0, "l_orderkey", "int64", 64), (1, "l_linenumber", "int32", 32), (2, "l_quantity", "double", 128)]
_RANGES = " UNION ALL ".join(f"SELECT {i} AS column_index, '{c}' AS \"column\", '{k}' AS original, {b} AS bits, min({c}) AS lo, max({c}) AS hi, bool_and({c} = round({c})) AS whole FROM lineitem" for i, c, k, b in _SCAN)
_LADDER = "CASE WHEN NOT whole THEN 'other' WHEN lo >= 0 AND hi <= 1 THEN 'bool' WHEN lo >= 0 AND hi <= 255 AND bits > 8 THEN 'uint8' WHEN lo >= 0 AND hi <= 65535 AND bits > 16 THEN 'uint16' WHEN lo >= 0 AND hi <= 4294967295 AND bits > 32 THEN 'uint32' ELSE original END"
_CLAMP = "event_id=u8,user_id=i8,value=i16"

#: name: (query, SQL)
QUERIES = {
    "sampler_pass_through": (_sampled("true", "X[0][*]"), f"{_E} SELECT {_ALL} FROM e"),
    "sampler_float_filter": (_sampled('X[0]["value"] > 50.0', 'X[0]["event_id"], X[0]["value"]'), f"{_E} SELECT row_idx, event_id, value FROM e WHERE value > 50.0"),
    "sampler_string_filter": (_sampled('X[0]["event_type"] == "click" || X[0]["event_type"] != "view" && X[0][3] < 10.0', "X[0]"), f"{_E} SELECT {_ALL} FROM e WHERE event_type = 'click' OR event_type <> 'view' AND value < 10.0"),
    "sampler_gradient": (_sampled("true", 'X[0]["event_id"], X[0]["value"] - X[-1]["value"]'), f"{_E}, w AS ({_WIN}) SELECT row_idx, event_id, value - m1 AS expr1 FROM w WHERE row_idx >= 1"),
    "sampler_mean3": (_sampled("true", '(X[-1]["value"] + X[0]["value"] + X[+1]["value"]) / 3.0'), f"{_E}, w AS ({_WIN}) SELECT row_idx, (m1 + value + p1) / 3.0 AS expr0 FROM w WHERE row_idx BETWEEN 1 AND n - 2"),
    "sampler_second_derivative": (_sampled("true", "X[0][0], X[0][3] - 2.0 * X[-1][3] + X[-2][3]"), f"{_E}, w AS ({_WIN}) SELECT row_idx, event_id, value - 2.0 * m1 + m2 AS expr1 FROM w WHERE row_idx >= 2"),
    "sampler_change": (_sampled('X[0]["event_type"] != X[-1]["event_type"]', 'X[0][0], X[-1]["event_type"], X[0]["event_type"]'), f"{_E}, w AS ({_WIN}) SELECT row_idx, event_id, t1 AS event_type_m1, event_type FROM w WHERE row_idx >= 1 AND event_type <> t1"),
    "sampler_expand": (_sampled("true", "X[-1][3], X[0][3], X[+1][3]", mode="expand"), f"{_E}, w AS ({_WIN}) SELECT row_idx, coalesce(m1, value) AS value_m1, value, coalesce(p1, value) AS value_p1 FROM w"),
    "sampler_bits": (_sampled("X[0][0] & 7 == 3 || true", "X[0][0] & 255, X[0][0] | 1, X[0][0] ^ X[-1][0], ~X[0][0], X[0][0] << 3, X[0][0] >> 2"), f"{_E}, w AS (SELECT *, lag(event_id) OVER (ORDER BY row_idx) AS i1 FROM e) SELECT row_idx, event_id & 255 AS expr0, event_id | 1 AS expr1, xor(event_id, i1) AS expr2, ~event_id AS expr3, event_id * 8 AS expr4, event_id // 4 AS expr5 FROM w WHERE row_idx >= 1"),
    "sampler_skip_row": (_sampled("X[0][0] / (X[0][1] % 5) >= 0", "X[0][0] / (X[0][1] % 3), X[0][1] % 7", on_error="skip_row"), f"{_E} SELECT row_idx, event_id // (user_id % 3) AS expr0, user_id % 7 AS expr1 FROM e WHERE user_id % 5 <> 0 AND user_id % 3 <> 0"),
    "sampler_saturate": (_sampled("true", "X[0][0] / (X[0][1] % 3), X[0][0] % (X[0][1] % 2)", on_error="saturate"), f"{_E} SELECT row_idx, CASE WHEN user_id % 3 = 0 THEN 9223372036854775807 ELSE event_id // (user_id % 3) END AS expr0, CASE WHEN user_id % 2 = 0 THEN 0 ELSE event_id % (user_id % 2) END AS expr1 FROM e"),
    "sampler_truth": (_sampled("!(X[0][1] % 2) && X[0][3]", "X[0][0], !X[0][3], -X[0][0]"), f"{_E} SELECT row_idx, event_id, NOT (value <> 0) AS expr1, -event_id AS expr2 FROM e WHERE user_id % 2 = 0 AND value <> 0"),
    "sampler_unsigned": (_unsigned("X[0][0] < X[0][1] || true", "X[0][0] - X[0][1], X[0][1] * X[0][0]"), f"{_E} SELECT row_idx, ((event_id::HUGEINT - least(user_id, 65535) + {2**64}) % {2**64})::DECIMAL(20,0) AS expr0, (least(user_id, 65535)::HUGEINT * event_id)::DECIMAL(20,0) AS expr1 FROM e"),
    "sampler_promotion": (_unsigned("X[0][0] > X[0][1]", "X[0][0] + 1, X[0][1] * X[0][3], (X[0][3] > 50.0) + X[0][1]"), f"{_E} SELECT row_idx, event_id + 1 AS expr0, least(user_id, 65535) * value AS expr1, (value > 50.0)::BIGINT + least(user_id, 65535) AS expr2 FROM e WHERE event_id > least(user_id, 65535)"),
    "sampler_wrap": (_sampled("true", "X[0][0] * 9223372036854775807, X[0][1] + 9223372036854775800"), f"{_E} SELECT row_idx, ((event_id::HUGEINT * 9223372036854775807 + {2**63}) % {2**64} - {2**63})::BIGINT AS expr0, ((user_id::HUGEINT + 9223372036854775800 + {2**63}) % {2**64} - {2**63})::BIGINT AS expr1 FROM e"),
    "csv_round_trip": (_as_text(), "SELECT event_id, user_id, event_type, value FROM events"),
    "csv_forced_clamp": (_as_text(forced={"event_id": "u8", "user_id": "i8"}), "SELECT least(event_id, 255) AS event_id, least(user_id, 127) AS user_id, event_type, value FROM events"),
    "cast_optimize": (lambda s, d: cast.optimize(lineitem(s, d)).select(*(F.col(c).cast("long") for c in ("l_orderkey", "l_linenumber")), F.col("l_quantity").cast("double")), "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM lineitem"),
    "head": (lambda s, d: first_rows(plain_events(s, d), 10, "event_id"), f"{_E} SELECT {_ALL} FROM e WHERE row_idx < 10"),
    "tail": (lambda s, d: last_rows(plain_events(s, d), 10, "event_id"), f"{_E} SELECT {_ALL} FROM e, n WHERE row_idx >= n - 10"),
    "first_last_row": (lambda s, d: selection.between(events(s, d), 5, 99), f"{_E} SELECT {_ALL} FROM e WHERE row_idx BETWEEN 5 AND 99"),
    "slice": (lambda s, d: selection.slice_rows(events(s, d), "10:-10:7"), f"{_E} SELECT {_ALL} FROM e, n WHERE row_idx >= 10 AND row_idx < n - 10 AND (row_idx - 10) % 7 = 0"),
    "index_ranges": (lambda s, d: selection.rows_in(events(s, d), "0:9,5:20,-3:,100"), f"{_E} SELECT {_ALL} FROM e, n WHERE row_idx <= 20 OR row_idx = 100 OR row_idx >= n - 3"),
    "column_selection": (lambda s, d: selection.columns(events(s, d), "value,0:1"), f"{_E} SELECT row_idx, event_id, user_id, value FROM e"),
    "every_100th": (lambda s, d: selection.every(events(s, d), 100), f"{_E} SELECT {_ALL} FROM e WHERE row_idx % 100 = 0"),
    "random_access": (lambda s, d: events(s, d).where(F.col(ROW) == 123), f"{_E} SELECT {_ALL} FROM e WHERE row_idx = 123"),
    "row_count": (lambda s, d: s.read.parquet(f"{d}/events.parquet").agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM events"),
    "numeric_stats": (lambda s, d: cast.numeric_stats(lineitem(s, d).select("l_linenumber", "l_quantity")), "SELECT min(v) AS min, max(v) AS max, sum(v) AS sum, count(v) AS count, avg(v) AS mean FROM (SELECT l_quantity AS v FROM lineitem UNION ALL SELECT l_linenumber::DOUBLE FROM lineitem)"),
    "narrow_scan": (lambda s, d: cast.scan(lineitem(s, d)), f"WITH r AS ({_RANGES}) SELECT column_index, \"column\", original, {_LADDER} AS optimal FROM r"),
    "cast_static_clamp": (lambda s, d: cast.cast_static(events(s, d).drop("event_type"), _CLAMP), f"{_E} SELECT row_idx, least(event_id, 255)::SMALLINT AS event_id, least(user_id, 127)::TINYINT AS user_id, greatest(least(round(value), 32767), -32768)::SMALLINT AS value FROM e"),
    "cast_loss_count": (lambda s, d: cast.loss_counts(events(s, d).drop("event_type"), _CLAMP), "SELECT 'event_id' AS \"column\", 'int64' AS original, 'uint8' AS target, count(*) FILTER (event_id > 255) AS lossy FROM events UNION ALL SELECT 'user_id', 'int64', 'int8', count(*) FILTER (user_id > 127) FROM events UNION ALL SELECT 'value', 'double', 'int16', count(*) FILTER (value <> round(value) OR round(value) NOT BETWEEN -32768 AND 32767) FROM events"),
    "compare_values": (_compared(lambda e: e.withColumn("value", F.col("value") + (F.col("event_id") % 3) * 0.25)), f"{_E} SELECT row_idx, 3 AS column_index, 'value' AS \"column\" FROM e WHERE event_id % 3 <> 0"),
    "compare_tolerance": (_compared(lambda e: e.withColumn("value", F.col("value") + (F.col("event_id") % 3) * 0.25), tolerance=0.375), f"{_E} SELECT row_idx, 3 AS column_index, 'value' AS \"column\" FROM e WHERE event_id % 3 = 2"),
    "compare_int_float": (_compared(lambda e: e.withColumn("user_id", F.col("user_id") + F.when(F.col("event_id") % 10 == 0, 0.5).otherwise(0.0))), f"{_E} SELECT row_idx, 1 AS column_index, 'user_id' AS \"column\" FROM e WHERE event_id % 10 = 0"),
    "flatten_embedding": (lambda s, d: nested.flatten(s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding"), {"embedding": 64}), "SELECT vec_id, " + ", ".join(f'embedding[{i + 1}] AS "embedding[{i}]"' for i in range(64)) + " FROM embeddings"),
    "unflatten_nation": (lambda s, d: nested.unflatten(s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.col("n_name").alias("n.name"), F.col("n_regionkey").alias("n.region"))).select("n_nationkey", "n.name", "n.region"), "SELECT n_nationkey, n_name AS name, n_regionkey AS region FROM nation"),
}
