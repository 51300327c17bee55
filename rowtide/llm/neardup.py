"""Near-duplicate documents: bottom-k sketches from one hash function, inverted lists, estimates, exact verification.

A document's set is that of its word shingles' 64-bit hashes; documents with equal sets are one class. A class keeps
its smallest hashes. Two sets that are alike share most of them, and so share a run of three that follow each other;
runs are the keys of the inverted lists. (Longer texts that share only a passage hardly ever share a run: another value
of either comes between. Sets so small that a run may be torn have their single values as keys too.)

Lists are not expanded into pairs. First each member meets two centres of its list; links that hold join most of a
group. Lists that still have several components go to tasks in blocks, where sketches are compared across components and only
pairs near the threshold come out. Pairs whose union sketch puts them far below the threshold go; the others are verified on
their full sets, family by family.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, components, discard, renamed, shuffle_parts, small_batches, stash
from .fingerprints import Shingles, mix

SHINGLE, PERCENT = 5, 80
SKETCH = 256
#: Smallest hashes whose runs are keys, a run's length, and the set size up to which single values are keys.
KEYED, RUN, TINY = 40, 3, 12
#: Standard deviations below the threshold at which an estimate rejects a pair.
SIGMAS = 5
#: Members of a family that are verified in one block, and of a list that are compared in one.
BLOCK = 400
#: Documents whose sketches are shuffled at a time to make classes, dealt by class, and the most parts that they are dealt into, which
#: bounds the disk that they take.
PART_ROWS, PARTS = 10_000, 4
_U = np.uint64


class _Sets(Shingles):
    def __init__(self, size: int):
        super().__init__(size, keep=100_000)  # several workers of an executor hold some at a time

    def of(self, text: str) -> np.ndarray:
        return np.unique(super().of(text.encode().lower().decode()))  # bytes.lower(): A-Z only


def _keys(s: np.ndarray) -> np.ndarray:
    low = s[:KEYED]
    with np.errstate(over="ignore"):
        runs = np.zeros(max(0, len(low) - RUN + 1), _U)
        for k in range(RUN):
            runs = mix(runs * _U(0x9E3779B97F4A7C15) + low[k : len(low) - RUN + 1 + k]) if len(runs) else runs
        single = mix(low ^ _U(0x5851F42D4C957F2D)) if len(s) <= TINY else low[:0]
    return np.concatenate([runs, single]).view(np.int64)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, h (of the text), n (set size), c (class: hash of the set; null without words), sketch and keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(shingle)
        for batch in batches:
            found = [sets.of(t or "") for t in batch.column("text").to_pylist()]
            c = [int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)) if len(s) else None for s in found]
            columns = [batch.column("doc_id"), batch.column("h"), pa.array([len(s) for s in found], pa.int64()), pa.array(c, pa.int64()), pa.array([s[:SKETCH].tobytes() for s in found], pa.binary()), pa.array([_keys(s) for s in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "n", "c", "sketch", "keys"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    return rows.mapInArrow(sketch, f"doc_id {kind}, h long, n long, c long, sketch binary, keys array<long>")


def estimate(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> tuple[float, bool]:
    """Jaccard similarity from the smallest hashes of the union, and whether that is the whole union."""
    union = np.union1d(a, b)
    whole = na <= SKETCH and nb <= SKETCH
    low = union if whole else union[:SKETCH]
    both = np.isin(low, a, assume_unique=True) & np.isin(low, b, assume_unique=True)
    return float(both.sum()) / len(low), whole


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimate doesn't rule them out, with it."""
    t, least = percent / 100, _least(percent)
    of = lambda x: classes.select(F.col("c").alias(x), F.col("n").alias("n" + x), F.col("sketch").alias("s" + x))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {k: batch.column(k).to_pylist() for k in ("na", "nb", "sa", "sb")}
            est, keep = [], []
            for k, (na, nb, sa, sb) in enumerate(zip(*columns.values())):
                e, whole = estimate(np.frombuffer(sa, _U), np.frombuffer(sb, _U), na, nb)
                if e >= (t - 1e-9 if whole else least):
                    est.append(e)
                    keep.append(k)
            index = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(index), batch.column("b").take(index), pa.array(est, pa.float64())], ["a", "b", "est"])

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(test, "a long, b long, est double")


def _least(percent: int) -> float:
    """The least estimate that doesn't rule a pair out."""
    t = percent / 100
    return t - SIGMAS * (t * (1 - t) / SKETCH) ** 0.5


def estimates(a: np.ndarray, na: int, values: np.ndarray, place: np.ndarray, owner: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`estimate` of the sketch a with many others at once: their values in order, each with its place in its sketch and its
    owner; n: set sizes by owner."""
    low, high = np.searchsorted(values, a, "left"), np.searchsorted(values, a, "right")
    many = high - low
    at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
    where = np.full((len(n), len(a)), -1, np.int16)  # the place in the other sketch of each value of a
    where[owner[at], np.repeat(np.arange(len(a)), many)] = place[at]
    shared = where >= 0
    nth = np.cumsum(shared, axis=1, dtype=np.int16)  # common values up to this one
    common = nth[:, -1].astype(int)
    rank = where + np.arange(1, len(a) + 1, dtype=np.int16) - nth  # in the union
    whole = (n <= SKETCH) & (na <= SKETCH)
    union = len(a) + np.minimum(n, SKETCH) - common
    among = (shared & (rank < SKETCH)).sum(axis=1)
    return np.where(whole, common / union, among / np.minimum(SKETCH, union)), whole


def _across(open_lists: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, est) of lists (k, c, n, g) whose ends are in different components g and whose estimate doesn't rule them
    out; a pair of several lists comes from that of its least key. A list of several blocks goes to a task for each pair of blocks; no task holds more than two."""
    size = open_lists.groupBy("k").agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).cast("int").alias("s"))
    rows = open_lists.join(size, "k").join(classes.select("c", "sketch"), "c").withColumn("own", F.expr("cast(pmod(xxhash64(c), s) as int)")).withColumn("e", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    rows = rows.select("k", F.least("own", "e").alias("i"), F.greatest("own", "e").alias("j"), "own", "c", "n", "g", "sketch")
    rows = rows.repartition(shuffle_parts(open_lists.sparkSession), "k", "i", "j").sortWithinPartitions("k", "i", "j", "own", "c")
    least, t = _least(percent), percent / 100

    def pairs_of(k: int, block: list) -> Iterator[tuple[int, int, float]]:
        own, c, n, g, sketches = zip(*block)
        n, g, c = np.array(n), np.array(g), np.array(c)
        sketches = [np.frombuffer(x, _U) for x in sketches]
        alone = own[0] == own[-1]
        first = len(own) if alone else own.index(own[-1])
        start = 0 if alone else first
        keys: dict[int, np.ndarray] = {}

        def here(x: int, y: int) -> bool:
            for z in (x, y):
                if z not in keys:
                    keys[z] = np.unique(_keys(sketches[z]))
            return np.intersect1d(keys[x], keys[y], assume_unique=True)[0] == k

        others = sketches[start:]
        owner = np.repeat(np.arange(len(others)), [len(x) for x in others])
        place = np.concatenate([np.arange(len(x)) for x in others])
        values = np.concatenate(others)
        order = np.argsort(values, kind="stable")
        values, place, owner = values[order], place[order], owner[order]
        for x in range(first):
            fits = (g[start:] != g[x]) & (100 * np.minimum(n[start:], n[x]) >= percent * np.maximum(n[start:], n[x]))
            if alone:
                fits[: x + 1] = False
            if fits.any():
                est, whole = estimates(sketches[x], int(n[x]), values, place, owner, n[start:])
                for y in np.nonzero(fits & (est >= np.where(whole, t - 1e-9, least)))[0]:
                    if here(x, start + int(y)):
                        a, b = int(c[x]), int(c[start + y])
                        yield min(a, b), max(a, b), float(est[y])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(k, block):
            found = list(pairs_of(k, block))
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], ["a", "b", "est"])

        here, block = None, []
        for batch in batches:
            for *key, own, c, n, g, sketch in zip(*(batch.column(x).to_pylist() for x in ("k", "i", "j", "own", "c", "n", "g", "sketch"))):
                if key != here:
                    if len(block) > 1 and (here[1] == here[2] or block[0][0] != block[-1][0]):
                        yield out(here[0], block)
                    here, block = key, []
                block.append((own, c, n, g, sketch))
        if len(block) > 1 and (here[1] == here[2] or block[0][0] != block[-1][0]):
            yield out(here[0], block)

    return rows.mapInArrow(compare, "a long, b long, est double")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) among the pairs (a, b, est), enough to connect what the linked ones connect. texts: (c, text).

    Pairs that reach each other make up a family. A class's text goes to its family once, or, in a family of several
    blocks, once for each block of partners. Pairs are tried by falling estimate; one whose ends are linked already
    in the same block is not needed.
    """
    family = stash(components(pairs), "families")
    size = family.groupBy("component").agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).cast("int").alias("s"))
    family = stash(family.join(size, "component").select("id", F.col("component").alias("f"), "s", F.expr("cast(pmod(xxhash64(id), s) as int)").alias("i")), "blocks")
    of = lambda x: family.select(F.col("id").alias(x), "f", F.col("i").alias("i" + x))
    placed = pairs.join(of("a"), "a").join(of("b").drop("f"), "b")
    placed = placed.select("f", F.least("ia", "ib").alias("i"), F.greatest("ia", "ib").alias("j"), F.lit(1).alias("kind"), F.col("a").alias("x"), F.col("b").alias("y"), "est", F.lit(None).cast("string").alias("text"))
    members = texts.join(family, texts.c == family.id).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    members = members.select("f", F.least("i", "k").alias("i"), F.greatest("i", "k").alias("j"), F.lit(0).alias("kind"), F.col("c").alias("x"), F.lit(None).cast("long").alias("y"), F.lit(None).cast("double").alias("est"), "text")
    rows = members.unionByName(placed).repartition(shuffle_parts(pairs.sparkSession), "f", "i", "j").sortWithinPartitions("f", "i", "j", "kind", F.desc("est"), "x", "y")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, here = _Sets(shingle), None
        texts: dict[int, str] = {}
        known: dict[int, np.ndarray] = {}
        up: dict[int, int] = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            out: list[tuple[int, int]] = []
            for *block, kind, x, y, text in zip(*(batch.column(k).to_pylist() for k in ("f", "i", "j", "kind", "x", "y", "text"))):
                if block != here:
                    here = block
                    texts, known, up = {}, {}, {}
                if kind == 0:
                    texts[x] = text or ""
                    continue
                if root(x) == root(y):
                    continue
                for c in (x, y):
                    if c not in known:
                        known[c] = sets.of(texts[c])
                both = len(np.intersect1d(known[x], known[y], assume_unique=True))
                if 100 * both >= percent * (len(known[x]) + len(known[y]) - both):
                    up[root(x)] = root(y)
                    out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([k for _, k in out], pa.int64())], ["a", "b"])

    return rows.mapInArrow(verify, "a long, b long")


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, text) of the classes in wanted (id), by the document that stands for the class."""
    stands = classes.join(wanted, classes.c == wanted.id, "left_semi").select("c", F.col("one.doc_id").alias("at"), F.col("one.h").alias("at_h"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    return rows.join(stands, rows.doc_id.eqNullSafe(stands["at"]) & (rows.h == stands.at_h)).select("c", "text")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()


def _ordered(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, component_id, kept for each row of docs (doc_id, text).

    Words are runs of characters other than space and 9 to 13, with A-Z in lower case. Documents are linked if
    100 * |A and B| >= percent * |A or B|; component_id is the smallest doc_id that links reach, the document itself
    included. A null or wordless text has no shingles and no links; fewer words than a shingle make up one. kept:
    doc_id = component_id; rows that repeat a kept row are kept too. Null doc_ids are smaller than none: a component
    has a null id only if all its rows have. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark, 300)
    full = stash(sketches(docs, shingle), "sketches")
    wordy = full.where("c is not null")
    one = lambda rows: rows.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("one"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    parts = min(PARTS, 1 + full.count() // PART_ROWS)
    classes = reduce(DataFrame.union, [stash(one(wordy.where(F.pmod("c", F.lit(parts)) == n)), "classes") for n in range(parts)])
    found = stash(full.select("doc_id", "h", "n", "c"), "rows")
    discard(full)
    entries = classes.select("c", "n", F.explode("keys").alias("k"))
    shared = entries.groupBy("k").agg(F.count("*").alias("m")).where("m > 1").select("k")
    lists = stash(entries.join(shared, "k", "left_semi"), "lists")

    near = lambda p, q: 100 * F.least(p, q) >= percent * F.greatest(p, q)
    place = F.struct(F.xxhash64("c", "k").alias("o"), "c", "n")
    centres = lists.groupBy("k").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    met = lists.join(centres, "k").select("c", "n", F.explode(F.array("low", "high")).alias("z")).where((F.col("c") != F.col("z.c")) & near("n", "z.n"))
    first = stash(met.select(*_ordered("c", "z.c")).distinct(), "pairs")
    likely = stash(_likely(first, classes, percent), "likely")
    texts = stash(_texts(docs, classes, _ends(likely)), "texts")
    links = stash(_verified(likely, texts, shingle, percent), "links")
    part = components(links)

    spread = lists.join(part, lists.c == part.id, "left").select("k", "c", "n", F.coalesce("component", "c").alias("g"))
    several = spread.groupBy("k").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x <> y").select("k")
    open_lists = stash(spread.join(several, "k", "left_semi"), "open")
    second = stash(_across(open_lists, classes, percent), "across")
    more = stash(_texts(docs, classes, _ends(second)), "texts")
    links = stash(links.union(_verified(second, more, shingle, percent)), "links")
    part = stash(components(links), "components")
    discard(first, likely, texts, open_lists, second, more, lists)

    of = classes.select("c", F.col("one.doc_id").alias("least")).join(part, classes.c == part.id, "left").select("c", "least", F.coalesce("component", "c").alias("g"))
    ids = of.join(of.groupBy("g").agg(F.min("least").alias("component_id")), "g").select(F.col("c").alias("of"), "component_id")
    rows = found.join(ids, found.c == F.col("of"), "left")
    component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "h", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group, that of the smallest doc_id; of equal rows of that id, one. Rows without
    words stay."""
    found = alone(lambda: groups(docs, shingle, percent), "groups")
    drop = found.groupBy(F.col("doc_id").alias("__n_id"), F.col("h").alias("__n_h")).agg(F.bool_or("kept").alias("__n_kept"), F.max("n_shingles").alias("__n_size"))
    repeated = found.where("kept and n_shingles > 0").groupBy("component_id").agg(F.count("*").alias("m"), F.min("h").alias("first_h")).where("m > 1")
    h = F.xxhash64("text")
    frame, own = renamed(docs)
    rows = frame.withColumn("__n_hash", h)
    joined = rows.join(drop.where("not __n_kept"), rows.doc_id.eqNullSafe(F.col("__n_id")) & (F.col("__n_hash") == F.col("__n_h")), "left_anti")
    if repeated.isEmpty():
        return joined.select(*own).toDF(*docs.columns)
    many = repeated.select(F.col("component_id").alias("__m_id"), F.col("first_h").alias("__m_h"))
    marked = joined.join(many, joined.doc_id.eqNullSafe(F.col("__m_id")), "left")
    once = marked.where("__m_id is not null or __m_h is not null").where(F.col("__n_hash") == F.col("__m_h")).dropDuplicates(["__m_id", "__m_h"])
    return marked.where("__m_id is null and __m_h is null").unionByName(once).select(*own).toDF(*docs.columns)


def dedup(docs: DataFrame, shingle: int = 3, percent: int = 85) -> DataFrame:
    """`groups` without h. Nulls, empty texts, ties, repeated rows and empty tables are as there."""
    return groups(docs, shingle, percent).drop("h")
