"""Repeated byte windows over a corpus by a depth-limited radix sort of suffixes.

Suffixes matter only through their first `depth` bytes: two suffixes that agree so far are a repeated window. The
sort goes by most significant digits in three passes, and a group that can't be split any more, or that has one
member, goes no further:

1. Every window of `depth` bytes has an anchor, the place of its smallest 32-byte digit (leftmost of equals), so equal
   windows have equal anchors at equal distances. Runs of suffixes that share an anchor are one row. Rows are grouped
   by digit: a digit found once settles its suffixes as unrepeated. Rows whose whole extent is equal elsewhere are
   settled as repeated. Only groups that hold different extents stay, one representative for each extent.
2. The same for cells of 48 suffixes, by the bytes that all windows of the cell share, and by the cell's whole extent.
3. Single suffixes of what is left, by their whole `depth` bytes: equal groups are exactly the repeated windows.

Bytes are compared as 128-bit digests, built by doubling.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, alone, discard, renamed, small_batches, stash
from .fingerprints import mix

DEPTH = 400
GRAM = 32
CELL = 48
#: The smallest depth.
LEAST = 2 * GRAM + CELL
#: Bytes that are hashed at once; texts are joined up to a batch and cut into blocks that overlap.
BLOCK = 1 << 17
#: Runs, cells or suffixes that are settled at a time, and the most parts that they are dealt into, which bounds the disk of their shuffles.
PART_ROWS, PARTS = 2_000_000, 8
_U = np.uint64
_SEEDS = ((_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)), (_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)))
#: Low bits of a digit's digest that give way to its place when the smallest is sought.
_PLACE = 20


class Digests:
    """64-bit digests, for two seeds, of any stretch of at least 32 bytes of `data`, by doubled powers of 32."""

    def __init__(self, data: np.ndarray, longest: int):
        words = np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), strides=(1,))
        self.levels: list[list[np.ndarray]] = []
        with np.errstate(over="ignore"):
            for m, n in _SEEDS:
                h, width, own = mix(words * m + n), 8, []
                while 2 * width <= longest and len(h) > width:
                    right = h[width:]
                    h = h[:-width] * m + (right ^ (right >> _U(29))) * n
                    width *= 2
                    if width >= GRAM:
                        own.append(h)
                self.levels.append(own)

    def of(self, start: np.ndarray, size: np.ndarray | int) -> list[np.ndarray]:
        """Digests of data[start : start + size], with the size; two overlapping powers cover a stretch."""
        size = np.broadcast_to(np.asarray(size, np.int64), start.shape)
        power = np.frexp(size.astype(np.float64))[1] - GRAM.bit_length()
        out = []
        with np.errstate(over="ignore"):
            for (m, _), own in zip(_SEEDS, self.levels):
                h = np.zeros(len(start), _U)
                for k, level in enumerate(own):
                    at = np.flatnonzero(power == k)
                    if len(at):
                        s, n = start[at], size[at]
                        h[at] = mix(mix(level[s]) * m + level[s + n - (GRAM << k)] + n.astype(_U))
                out.append(h.view(np.int64))
        return out


def window_minima(gram: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost smallest value, but for its lowest bits, of each window of `width` values."""
    low = _U((1 << _PLACE) - 1)
    value, done = (gram & ~low) | np.arange(len(gram), dtype=_U), 1
    while done < width:
        step = min(done, width - done)
        value = np.minimum(value[: len(value) - step], value[step:])
        done += step
    return (value & low).astype(np.int64)


def runs(data: np.ndarray, ends: np.ndarray, depth: int, block: int = BLOCK) -> tuple[np.ndarray, ...]:
    """Runs of suffixes with one anchor, of texts that end at `ends`: the digit's digest, the extent's two digests,
    first suffix, count, anchor."""
    found = []
    sizes = np.diff(ends, prepend=0)
    fits = np.arange(len(data)) + depth <= np.repeat(ends, sizes)
    for s in range(0, len(data) - depth + 1, block):
        inside = np.flatnonzero(fits[s : s + block])
        if not len(inside):
            continue
        part = data[s : s + block + depth - 1]
        digests = Digests(part, 2 * depth)
        gram = digests.levels[0][0]
        place = window_minima(gram, depth - GRAM + 1)[inside]
        new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(inside, prepend=-2) != 1))
        first, count = inside[new], np.diff(new, append=len(place))
        x, y = digests.of(first, depth + count - 1)
        found.append((gram[place[new]].view(np.int64), x, y, first + s, count, place[new] + s))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 6


def cells(data: np.ndarray, depth: int, first: np.ndarray, count: np.ndarray, anchor: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, ...]:
    """The runs cut into cells at fixed distances from the anchor: digest of the bytes that all windows of a full
    cell share, the extent's two digests, first suffix, count, and the run that it is from."""
    far, near = anchor - first, anchor - first - count + 1  # distances of the run's first and last suffix
    low, high = near // CELL, far // CELL
    times = high - low + 1
    run = np.repeat(np.arange(len(first)), times)
    k = np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times) + low[run]
    start, stop = anchor[run] - np.minimum(far[run], k * CELL + CELL - 1), anchor[run] - np.maximum(near[run], k * CELL)
    core, core_size = anchor[run] - k * CELL, depth - CELL + 1
    out = []
    for pick, s, part in _stretches(data, np.minimum(start, core), np.maximum(stop + depth, core + core_size), block):
        digests = Digests(part, 2 * depth)
        c = digests.of(core[pick] - s, core_size)[0]
        x, y = digests.of(start[pick] - s, depth + stop[pick] - start[pick])
        with np.errstate(over="ignore"):
            tag = mix(k[pick].astype(_U) * _SEEDS[0][0]).view(np.int64)
        out.append((c ^ tag, x, y, start[pick], (stop - start + 1)[pick], run[pick]))
    return tuple(np.concatenate(o) for o in zip(*out)) if out else (np.zeros(0, np.int64),) * 6


def windows(data: np.ndarray, depth: int, first: np.ndarray, count: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, ...]:
    """Every suffix of the runs: two digests of its `depth` bytes, its place, and the run that it is from."""
    run = np.repeat(np.arange(len(first)), count)
    start = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + first[run]
    out = [(*Digests(part, depth).of(start[pick] - s, depth), start[pick], run[pick]) for pick, s, part in _stretches(data, start, start + depth, block)]
    return tuple(np.concatenate(o) for o in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def _stretches(data: np.ndarray, low: np.ndarray, high: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Groups of stretches that begin in one block: which, the place of their bytes, and the bytes."""
    of = low // block
    order = np.argsort(of, kind="stable")
    for pick in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else ():
        s = int(low[pick].min())
        yield pick, s, data[s : int(high[pick].max())]


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after another, and where each ends."""
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw], dtype=np.int64)


def _rows(batch: pa.RecordBatch, owner: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    index = pa.array(owner)
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(index), batch.column("tag").take(index), *map(pa.array, columns.values())], ["doc_id", "tag", *columns])


_COLUMNS = "tag long, c long, x long, y long, first long, count long, anchor long, many boolean"


def _of_runs(docs: DataFrame, todo: DataFrame, depth: int, single: bool, block: int) -> DataFrame:
    """Cells (or, if single, suffixes) of the runs in todo (doc_id, tag, first, count, anchor, many)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    lists = todo.groupBy(F.col("doc_id").alias("at_id"), F.col("tag").alias("at_tag")).agg(F.collect_set(F.struct("first", "count", "anchor", "many")).alias("runs"))
    texts = docs.join(lists, docs.doc_id.eqNullSafe(lists.at_id) & (docs.tag == lists.at_tag)).select("doc_id", "tag", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _joined(batch.column("text").to_pylist())
            lists = batch.column("runs")
            doc = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            first, count, anchor, many = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
            base = np.r_[0, ends[:-1]][doc]
            if single:
                x, y, start, run = windows(data, depth, first + base, count, block)
                c, n = x, np.ones(len(x), np.int64)
            else:
                c, x, y, start, n, run = cells(data, depth, first + base, count, anchor + base, block)
            start = start - base[run]
            yield _rows(batch, doc[run], {"c": c, "x": x, "y": y, "first": start, "count": n, "anchor": anchor[run], "many": many[run].astype(bool)})

    return texts.mapInArrow(cut, f"doc_id {kind}, {_COLUMNS}")


def _settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows with a digit c and an extent (x, y): the repeated ones, and a representative of each extent of digits
    that have several, in parts by digit. many: the row already stands for repeated ones."""
    both = [_settle_part(some) for some in _dealt(rows, "c")]
    discard(rows)
    return tuple(reduce(DataFrame.union, x) for x in zip(*both))


def _dealt(rows: DataFrame, by: str) -> list[DataFrame]:
    parts = min(PARTS, 1 + rows.count() // PART_ROWS)
    return [rows.where(F.pmod(by, F.lit(parts)) == n) for n in range(parts)]


def _settle_part(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    place = F.struct("doc_id", "tag", "first", "count", "anchor")
    classes = rows.groupBy("c", "x", "y").agg((F.count("*") > 1).alias("again"), F.max("many").alias("many"), F.min(place).alias("one"))
    classes = stash(classes.withColumn("many", F.col("many") | F.col("again")), "classes")
    repeated = classes.where("many").select("c", "x", "y")
    several = classes.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c")
    left = stash(classes.join(several, "c", "left_semi").select("one.*", "many"), "left")
    settled = stash(rows.where("not many").join(repeated, ["c", "x", "y"], "left_semi").select("doc_id", "tag", "first", "count"), "settled")
    discard(classes)
    return settled, left


def _settle_windows(rows: DataFrame) -> DataFrame:
    """The repeated ones of whole windows (x, y), which need no representatives, in parts by window."""
    found = []
    for some in _dealt(rows, "x"):
        repeated = some.groupBy("x", "y").agg(F.count("*").alias("n"), F.max("many").alias("again")).where("n > 1 or again").select("x", "y")
        settled = some.where("not many").join(repeated, ["x", "y"], "left_semi")
        found.append(stash(settled.select("doc_id", "tag", "first", F.lit(1).cast("long").alias("count")), "settled"))
    discard(rows)
    return reduce(DataFrame.union, found)


def repeated_windows(docs: DataFrame, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """Where a window of `depth` bytes of text occurs again, in the same or another row of docs (doc_id, tag, text):
    (doc_id, tag, first, count), runs of suffixes. Rows are known by doc_id and tag together; rows alike in both and in
    text are each other's copies."""
    if depth < LEAST:
        raise ValueError(f"depth must be {LEAST} at least")
    small_batches(docs.sparkSession, 200)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _joined(batch.column("text").to_pylist())
            c, x, y, first, count, anchor = runs(data, ends, depth, block)
            doc = np.searchsorted(ends, first, "right")
            base = np.r_[0, ends[:-1]][doc]
            yield _rows(batch, doc, {"c": c, "x": x, "y": y, "first": first - base, "count": count, "anchor": anchor - base, "many": np.zeros(len(doc), bool)})

    long_texts = docs.where(F.octet_length("text") >= depth)
    first = stash(long_texts.mapInArrow(anchors, f"doc_id {kind}, {_COLUMNS}"), "runs")
    settled, left = _settle(first)
    second = stash(_of_runs(long_texts, left, depth, single=False, block=block), "cells")
    discard(left)
    settled_cells, left = _settle(second)
    third = stash(_of_runs(long_texts, left, depth, single=True, block=block).select("doc_id", "tag", "x", "y", "first", "many"), "suffixes")
    discard(left)
    return settled.union(settled_cells).union(_settle_windows(third))


def _word_windows(data: bytes, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each stretch of so many words, as BLANKS part them, begins and ends."""
    blank = np.isin(np.frombuffer(b" " + data + b" ", np.uint8), np.frombuffer(BLANKS.encode(), np.uint8))
    start, stop = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    return start[: max(0, len(start) - words + 1)], stop[words - 1 :]


def repeated_passages(docs: DataFrame, words: int, block: int = BLOCK) -> DataFrame:
    """Where a stretch of `words` whole words occurs again byte by byte, as in `repeated_windows`: (doc_id, tag, first,
    stop). Only stretches whose every window of LEAST bytes is repeated, or that are shorter than one, are compared."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = repeated_windows(docs, LEAST, block)
    lists = found.groupBy(F.col("doc_id").alias("at_id"), F.col("tag").alias("at_tag")).agg(F.collect_set(F.struct("first", "count")).alias("runs"))
    texts = docs.where(F.octet_length("text") >= 2 * words - 1)
    texts = texts.join(lists, texts.doc_id.eqNullSafe(lists.at_id) & (texts.tag == lists.at_tag), "left").select("doc_id", "tag", "text", "runs")

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, out = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                data, todo = text.encode(), batch.column("runs")[k]
                first, stop = _word_windows(data, words)
                edge = np.zeros(len(data) + 2, np.int64)
                if todo.is_valid:
                    begin, count = (c.to_numpy() for c in todo.values.flatten())
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + count, -1)
                again = np.r_[0, np.cumsum(np.cumsum(edge) > 0)]  # repeated windows that begin before a place
                last = np.maximum(stop - LEAST + 1, first)
                for i in np.flatnonzero(again[last] - again[first] == last - first).tolist():
                    a, b = int(first[i]), int(stop[i])
                    x, y = np.frombuffer(hashlib.blake2b(data[a:b], digest_size=16).digest(), np.int64).tolist()
                    owner.append(k)
                    out.append((x, y, a, b))
            x, y, first, stop = np.array(out, np.int64).reshape(-1, 4).T.copy()
            yield _rows(batch, np.array(owner, np.int64), {"x": x, "y": y, "first": first, "stop": stop})

    rows = stash(texts.mapInArrow(stretches, f"doc_id {kind}, tag long, x long, y long, first long, stop long"), "passages")
    again = rows.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y")
    return rows.join(again, ["x", "y"], "left_semi").select("doc_id", "tag", "first", "stop")


def remove_repeats(docs: DataFrame, depth: int = DEPTH, keep_text: bool = False, block: int = BLOCK, words: int | None = None) -> DataFrame:
    """docs without each byte that a repeated window of `depth` bytes or, if asked for, a repeated stretch of `words`
    words covers.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and, if asked for, kept: the remaining bytes as text,
    where a character that lost some of its bytes is left out, and
    the hash of the text, tag. Every copy of a repeated window goes, its first
    included, and what is repeated is judged on the input. Null and empty texts, and texts shorter than a window, lose
    nothing. Rows that repeat are copies of each other; a null doc_id is a value like others. An empty table gives no
    rows; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").withColumn("tag", F.xxhash64("text"))
    found = repeated_windows(rows, depth, block)
    if words:  # count is what gives the stop, so that it can be less than 1
        found = found.union(repeated_passages(rows, words, block).select("doc_id", "tag", "first", (F.col("stop") - F.col("first") - depth + 1).alias("count")))
    lists = found.groupBy(F.col("doc_id").alias("at_id"), F.col("tag").alias("at_tag")).agg(F.sort_array(F.collect_set(F.struct("first", "count"))).alias("runs"))
    joined = rows.join(lists, rows.doc_id.eqNullSafe(lists.at_id) & (rows.tag == lists.at_tag), "left").select("doc_id", "tag", "text", "runs")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, (doc, tag, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text")))):
                data, todo = (text or "").encode(), batch.column("runs")[k]
                spans = []
                if todo.is_valid:
                    first, count = (c.to_numpy() for c in todo.values.flatten())  # in order, by sort_array
                    stop = np.maximum.accumulate(first + count - 1 + depth)
                    new = np.flatnonzero(np.r_[True, first[1:] > stop[:-1]])
                    spans = list(zip(first[new].tolist(), stop[np.r_[new[1:] - 1, len(stop) - 1]].tolist()))
                at, kept = 0, []
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                out.append((doc, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), _text(data, spans) if keep_text else None, tag))
            types = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, types)]
            yield pa.RecordBatch.from_arrays(columns[: 5 + 2 * keep_text], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "tag"][: 5 + 2 * keep_text])

    return joined.mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string, tag long" * keep_text)


def cut_repeats(docs: DataFrame, depth: int = DEPTH, words: int | None = None) -> DataFrame:
    """docs with text cut as `remove_repeats` cuts it; null texts stay null, other columns stay, whatever their names. Rows equal
    in doc_id and text are cut alike; an empty table gives no rows."""
    def gone() -> DataFrame:
        cut = remove_repeats(docs, depth, keep_text=True, words=words).where("n_removed > 0").select(F.col("doc_id").alias("__s_id"), "tag", "kept")
        return cut.dropDuplicates(["__s_id", "tag"]).select("__s_id", F.col("tag").alias("__s_tag"), F.col("kept").alias("__s_kept"))

    cut = alone(gone, "cut")
    frame, own = renamed(docs)
    rows = frame.withColumn("__s_hash", F.xxhash64("text"))
    rows = rows.join(cut, rows.doc_id.eqNullSafe(F.col("__s_id")) & (F.col("__s_hash") == F.col("__s_tag")), "left")
    return rows.select(*(F.coalesce("__s_kept", "text").alias(c) if name == "text" else c for name, c in zip(docs.columns, own))).toDF(*docs.columns)


def _text(data: bytes, spans: list[tuple[int, int]]) -> str:
    """What is left outside the spans, each part decoded by itself."""
    at, parts = 0, []
    for a, b in [*spans, (len(data), len(data))]:
        parts.append(data[at:a].decode("utf-8", "ignore"))
        at = b
    return "".join(parts)
