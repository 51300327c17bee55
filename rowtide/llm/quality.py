"""Quality rules on hosts: failures of documents, summed by source, shrunk with an empirical beta prior, and joined back.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CLASS, BLANKS, alone, stash

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
#: Rules of a document that count against its host: most repeated words, symbols and repeated lines, in hundredths.
MOST_REPEATED, MOST_SYMBOLS, MOST_DUP_LINES = 30, 20, 30
#: Fewer repeated lines than this are none too many, whatever their share of a short text.
LEAST_DUP_LINES = 3
#: A host whose shrunk failure rate is above this is rejected whole: most of what it has fails.
HOST_LIMIT = 0.5
#: A host is suspect if its shrunk rate is above the prior's mean by more than this. Symbols and repeated lines, which no document
#: is rejected for by itself, are held against the documents of suspect hosts.
ABOVE = 1e-9


def _count(chars: str, text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def with_measures(docs: DataFrame, text: str = "text", mark: str = "__q_") -> DataFrame:
    """docs and, under names that begin with `mark`, the measures of each whole text (null: empty): words, chars,
    symbols, lines, dups, repeats (words in windows of 8 words that the text has twice or more).

    Arrays of one row only; windows are compared by 64-bit hashes within their text.
    """
    m = lambda name: mark + name
    c = lambda name: F.col(mark + name)
    body = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda x: x.rlike(f"[^{BLANK_CLASS}]")
    hashes = F.transform(F.filter(F.split(body, f"[{BLANK_CLASS}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    rows = docs.withColumns({m("h"): hashes, m("l"): F.filter(F.split(body, "\n"), has_word)})
    rows = rows.withColumns({
        m("words"): F.size(c("h")).cast("long"),
        m("chars"): F.length(F.translate(body, BLANKS, "")).cast("long"),
        m("symbols"): _count(SYMBOLS, body).cast("long"),
        m("lines"): F.size(c("l")).cast("long"),
        m("dups"): (F.size(c("l")) - F.size(F.array_distinct(c("l")))).cast("long"),
        m("w"): F.when(F.size(c("h")) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(c("h")) - WINDOW + 1), lambda i: F.xxhash64(F.slice(c("h"), i, WINDOW)))),
    })
    twice = F.size(F.array_distinct(c("w"))) < F.size(c("w"))
    rows = rows.withColumn(m("s"), F.when(twice, F.sort_array(F.transform(c("w"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    again = F.filter(c("s"), lambda e, i: F.coalesce(F.get(c("s"), i - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(c("s"), i + 1)["x"] == e["x"], F.lit(False)))
    rows = rows.withColumn(m("p"), F.sort_array(F.transform(again, lambda e: e["i"])))
    gaps = F.transform(c("p"), lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(c("p"), i + 1) - p, F.lit(WINDOW))))
    rows = rows.withColumn(m("repeats"), F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    return rows.drop(*map(m, ("h", "l", "w", "s", "p")))


def base_failed(mark: str = "__q_") -> Column:
    words, repeats = F.col(mark + "words"), F.col(mark + "repeats")
    return (words < MIN_WORDS) | (100 * repeats > MOST_REPEATED * words)


def soft_failed(mark: str = "__q_") -> Column:
    """Too many symbols, or too many repeated lines. With the base, a document's failures for its host."""
    c = lambda name: F.col(mark + name)
    return (100 * c("symbols") > MOST_SYMBOLS * c("chars")) | (100 * c("dups") > MOST_DUP_LINES * c("lines")) & (c("dups") >= LEAST_DUP_LINES)


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, docs, failed, rate, suspect, bad): each host's failures and its rate, shrunk by the beta distribution that has
    the mean and variance of all hosts' rates. bad: above the limit; suspect: above the prior's mean. measured: (host,
    base, soft), booleans that say which rules a document fails. A null host is one host; no rows give no hosts."""
    hosts = stash(measured.groupBy("host").agg(F.count("*").alias("docs"), F.count_if(F.col("base") | F.col("soft")).alias("failed")), "hosts")
    own = F.col("failed") / F.col("docs")
    a, b = prior(*hosts.agg(F.avg(own), F.var_pop(own)).first())
    rated = hosts.withColumn("rate", (F.col("failed") + a) / (F.col("docs") + a + b))
    return rated.withColumns({"suspect": F.col("rate") > a / (a + b) + ABOVE, "bad": F.col("rate") > limit})


def prior(mean: float | None, variance: float | None) -> tuple[float, float]:
    """Parameters of the beta distribution with these moments; the uniform one where there is no such (no hosts, or
    all of them at 0 or 1), and a weight of a million documents where rates don't differ."""
    if mean is None or mean <= 0 or mean >= 1:
        return 1.0, 1.0
    weight = min(1e6, mean * (1 - mean) / variance - 1) if variance else 1e6
    return (mean * weight, (1 - mean) * weight) if weight > 0 else (1.0, 1.0)


def _judged(rows: DataFrame, limit: float) -> DataFrame:
    """rows (host, base, soft) with `host_ok`, false if the host's verdict rejects them. Only hosts with one are joined."""
    verdicts = host_verdicts(rows.select("host", "base", "soft"), limit).where("suspect or bad").select(F.col("host").alias("of"), "bad")
    joined = rows.join(verdicts, rows.host.eqNullSafe(F.col("of")), "left")
    return joined.withColumn("host_ok", F.col("bad").isNull() | ~(F.col("bad") | F.col("soft"))).drop("of", "bad")


def score(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for each row of docs.

    kept: not base_failed, the host isn't rejected, and either the host isn't suspect or symbols and repeated lines are
    few. A null text has no words (and so fails), a null host is a host of its own, a null doc_id stays null, rows that
    repeat are judged each. An empty table gives no rows; other columns are not read. The texts are read once; hosts are
    summed before the shuffle.
    """
    rows = with_measures(docs.select("doc_id", "text", F.col(host).alias("host"))).drop("text")
    rows = stash(rows.withColumns({"base": base_failed(), "soft": soft_failed()}), "measures")
    names = {"n_words": "words", "word_chars": "chars", "n_symbols": "symbols", "n_dup_lines": "dups", "n_repeat_words": "repeats"}
    return _judged(rows, limit).select("doc_id", *(F.col("__q_" + v).alias(k) for k, v in names.items()), F.col("base").alias("base_failed"), (~F.col("base") & F.col("host_ok")).alias("kept"))


def keep_good(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of docs that `score` keeps, with docs' own columns, whatever their names; nulls, repeated rows and empty tables
    as there."""
    own = [f"c{k}" for k in range(len(docs.columns))]
    renamed = docs.toDF(*own).select("*", F.col(own[docs.columns.index("text")]).alias("__text"), F.col(own[docs.columns.index(host)]).alias("host"))
    key = [F.xxhash64("__text").alias("h0"), F.hash("__text").alias("h1"), F.length("__text").alias("size")]

    def gone() -> DataFrame:
        # written before it is filtered: a filter would be pushed down and repeat the array functions inside each other
        rows = stash(with_measures(renamed, "__text").select(*key, "host", base_failed().alias("base"), soft_failed().alias("soft")), "measured")
        judged = _judged(rows, limit).where(F.col("base") | ~F.col("host_ok"))
        return judged.select(*(F.col(c).alias("__g_" + c) for c in ("h0", "h1", "size", "host"))).distinct()

    # text and host settle the verdict, so that their hashes stand for the row, and texts need no copy on disk
    bad, rows = alone(gone, "gone"), renamed.select("*", *key)
    same = [rows[c].eqNullSafe(bad["__g_" + c]) for c in ("h0", "h1", "size", "host")]
    return rows.join(bad, same, "left_anti").select(*own).toDF(*docs.columns)


SCORE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
x AS (SELECT r, i, list_slice(ws, i, i + 7) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
y AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM x) WHERE n > 1),
z AS (SELECT r, sum(least(8, coalesce(j - i, 8)))::BIGINT AS reps FROM y GROUP BY r),
m AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(reps, 0) AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN z USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 100 * n_symbols > 20 * word_chars OR 100 * n_dup_lines > 30 * n_lines AND n_dup_lines >= 3 AS soft FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft) AS k FROM f GROUP BY source),
v AS (SELECT avg(k / n) AS m, var_pop(k / n) AS s FROM h),
q AS (SELECT m, CASE WHEN m <= 0 OR m >= 1 THEN NULL WHEN s > 0 THEN least(1e6, m * (1 - m) / s - 1) ELSE 1e6 END AS wt FROM v),
r AS (SELECT source, (k + CASE WHEN wt > 0 THEN m * wt ELSE 1 END) / (n + CASE WHEN wt > 0 THEN wt ELSE 2 END) AS rate, CASE WHEN wt > 0 THEN m ELSE 0.5 END AS mid FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (rate > 0.5) AND NOT (soft AND rate > mid + 1e-9) AS kept FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""
