"""Chat formatting with cumulative snapshots collapsed: only conversations that are no beginning of another are rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

_PARTS = ["h0", "h1", "h2", "h3"]


def _hashed(turns: DataFrame) -> DataFrame:
    """Turns with their place and four 32-bit parts of the digest of place, role and text; parts are summed, so that a
    prefix's hash rolls on by adding the next turn's."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    mark = lambda c: F.coalesce(F.concat(F.octet_length(c), F.lit(":"), c), F.lit("-"))
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(order).cast("long"))
    rows = rows.withColumn("digest", F.sha2(F.concat_ws("|", "place", mark("role"), mark("text")), 256))
    return rows.select("conv_id", "place", "role", "text", *(F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(h) for k, h in enumerate(_PARTS)))


def maximal(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations that are no proper beginning of another, one for each distinct content (that of the smallest
    conv_id): (conv_id, n_turns, n_copies), and the turns with their places."""
    rows = stash(_hashed(turns), "turns")
    whole = rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), *(F.sum(h).alias(h) for h in _PARTS))
    rolling = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("conv_id").orderBy("place")
    prefixes = rows.select("conv_id", "place", *(F.sum(h).over(rolling).alias(h) for h in _PARTS), F.lead("place").over(after).alias("next"))
    prefixes = prefixes.where("next is not null").select(F.col("place").alias("n_turns"), *_PARTS).distinct()
    contents = whole.groupBy("n_turns", *_PARTS).agg(F.min(F.struct("conv_id")).alias("first"), F.count("*").alias("n_copies"))
    kept = contents.join(prefixes, ["n_turns", *_PARTS], "left_anti")
    return kept.select("first.conv_id", "n_turns", "n_copies"), rows


def render(turns: DataFrame, opening: str = "<|im_start|>", closing: str = "<|im_end|>") -> DataFrame:
    """A row for each maximal conversation of turns (conv_id, turn, role, text): conv_id, n_turns, n_copies (logged
    conversations with the same turns), rendered.

    Turns are in the order of turn, then role, then text, nulls first; repeated rows are repeated turns. Rows with a
    null conv_id make up one conversation. A null role renders as "unknown", a null text as the empty one, but both
    differ from those in comparisons. An empty table gives no rows; other columns are not read. Conversations are
    compared by 128 bits of their turns' digests.
    """
    kept, rows = maximal(turns)
    kept = stash(kept, "maximal")
    line = F.concat(F.lit(opening), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(closing + "\n"))
    parts = rows.select(F.col("conv_id").alias("of"), "place", line.alias("line"))
    joined = parts.join(kept, parts.of.eqNullSafe(kept.conv_id))
    texts = joined.groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return texts.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))


RENDER_SQL = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM conversations),
c AS (SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY place) AS turns,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT list_slice(turns, 1, k) AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM c)),
g AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns)
SELECT g.conv_id, c.n_turns, g.n_copies, c.rendered FROM g JOIN c ON c.conv_id = g.conv_id WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = g.turns)
"""
