"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, shuffle_parts, small_batches

BINS = 1024
BITS = 4
SHINGLE = 5
_WORDS = regex.compile(f"[^{BLANKS}]+")
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits of the input."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Shingles:
    """64-bit hashes of a text's word shingles; a text with fewer words is one shingle, one without words none.
    Hashes of words are remembered, up to `keep`."""

    def __init__(self, size: int = SHINGLE, keep: int = 500_000):
        self.size, self.keep, self.memo = size, keep, {}

    def words(self, text: str) -> np.ndarray:
        found = text.split()
        if sum(map(len, found)) + sum(map(text.count, BLANKS)) != len(text):  # other white space belongs to words
            found = _WORDS.findall(text)
        memo = self.memo
        if len(memo) > self.keep:
            memo.clear()
        for w in found:
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w.encode())
        return np.fromiter(map(memo.__getitem__, found), _U, len(found))

    def of(self, text: str) -> np.ndarray:
        w = self.words(text)
        if not len(w):
            return w
        size = min(self.size, len(w))
        with np.errstate(over="ignore"):
            h = np.full(len(w) - size + 1, size, _U)
            for k in range(size):
                h = mix(h * _U(0x9E3779B97F4A7C15) + w[k : len(w) - size + 1 + k])
        return h


@lru_cache(4)
def _probes(bins: int) -> np.ndarray:
    """For each bin, the order in which it asks the other bins: a random permutation of its own."""
    with np.errstate(over="ignore"):
        h = mix(np.arange(bins * bins, dtype=_U).reshape(bins, bins) + _U(0x5851F42D4C957F2D))
    return np.argsort(h, axis=1, kind="stable").astype(np.int32)


def codes(hashes: np.ndarray, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """The low `bits` bits of each bin's smallest hash, uint8. Each hash falls into one bin by its high bits; an
    empty bin takes over the value of the first non-empty one in its own order of probes. Empty without hashes."""
    if not len(hashes):
        return np.zeros(0, np.uint8)
    h = np.sort(hashes)
    at = (h >> _U(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    out, full = np.zeros(bins, np.uint8), np.zeros(bins, bool)
    out[at[first]] = (h[first] & _U((1 << bits) - 1)).astype(np.uint8)
    full[at[first]] = True
    left, probes, step = np.flatnonzero(~full), _probes(bins), 32
    for k in range(0, bins, step):
        if not len(left):
            break
        asked = probes[left, k : k + step]
        hit = full[asked]
        found = hit.any(axis=1)
        out[left[found]] = out[asked[found, hit[found].argmax(axis=1)]]
        left = left[~found]
    return out


def packed(code: np.ndarray, bits: int = BITS) -> str:
    """As hexadecimal digits; "" for a text without words."""
    return np.packbits(np.unpackbits(code[:, None], axis=1)[:, 8 - bits :]).tobytes().hex()


def unpacked(text: str, bits: int = BITS) -> np.ndarray:
    return np.packbits(np.pad(np.unpackbits(np.frombuffer(bytes.fromhex(text), np.uint8)).reshape(-1, bits), ((0, 0), (8 - bits, 0))), axis=1)[:, 0]


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> float:
    """Estimated Jaccard similarity: the share of equal codes without those that are equal by chance. Two texts
    without words are alike (1), one with and one without are not (0)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    chance = 2.0**-bits
    return min(1.0, max(0.0, (float(np.mean(a == b)) - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """docs with a column fingerprint: that of text (null: empty). Other columns stay; a column named fingerprint is
    replaced. One pass without a shuffle; rows that repeat have equal fingerprints."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def fingerprint(text):
        hashes = Shingles(shingle)
        return text.map(lambda t: packed(codes(hashes.of(t or ""), bins, bits), bits))

    return docs.withColumn("fingerprint", fingerprint("text"))


def edited_pairs(docs: DataFrame, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """Each document beside its edited text and beside the next document, descending doc_id (after the last: the first).

    The edited text is the document with its last floor(n_chars/2) characters replaced by the first as many (or all)
    of the next document. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Null texts count as empty; null doc_ids come last, equal ones in the order of their texts; a table of
    one row has itself as the next. An empty table gives no rows; other columns are not read.

    Rows are dealt out once, by ranges of doc_id, and streamed in order; each range also gets the first row of the
    range after it, one for each range, so no task needs another's rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id").where("doc_id is not null")
    wanted = 4 * shuffle_parts(spark)
    bounds = sorted(set(int(b) for b in ids.stat.approxQuantile("doc_id", [k / wanted for k in range(1, wanted)], 0.2 / wanted)))  # as many as ranges

    if bounds:
        cut = F.array(*map(F.lit, bounds))
        span = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(F.size(F.filter(cut, lambda b: b >= F.col("doc_id"))))
    else:
        span = F.when(F.col("doc_id").isNull(), 1).otherwise(0)
    rows = rows.withColumn("span", span)
    tops = sorted((r.span, r.top) for r in rows.groupBy("span").agg(F.max("doc_id").alias("top")).collect())  # one for each range
    if not tops:
        return spark.createDataFrame([], f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    before = {here: tops[k - 1][0] for k, (here, _) in enumerate(tops)}
    is_top = F.col("doc_id").isin([t for _, t in tops if t is not None]) | F.col("doc_id").isNull()
    heads = rows.where(is_top).groupBy("span", "doc_id").agg(F.min("text").alias("text"))
    to = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    heads = heads.select("doc_id", "text", to[F.col("span")].alias("span"), F.lit(1).alias("head"))
    dealt = rows.withColumn("head", F.lit(0)).unionByName(heads).repartition(shuffle_parts(spark), "span")
    dealt = dealt.sortWithinPartitions("span", "head", F.desc_nulls_last("doc_id"), "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last = Shingles(shingle), None
        for batch in batches:
            out: list[tuple] = []
            for span, head, doc, text in zip(*(batch.column(k).to_pylist() for k in ("span", "head", "doc_id", "text"))):
                code = codes(hashes.of(text), bins, bits)
                if last is not None and last[0] == span:
                    _, own, own_text, own_code = last
                    n = len(own_text)
                    edited = own_text[: n - n // 2] + text[: n // 2]
                    edited_code = codes(hashes.of(edited), bins, bits)
                    out.append((own, n, hashlib.sha256(edited.encode()).hexdigest(), packed(own_code, bits), packed(edited_code, bits), likeness(own_code, edited_code, bits), likeness(own_code, code, bits)))
                last = None if head else (span, doc, text, code)
            columns = list(zip(*out)) or [()] * 7
            types = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(compare, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
