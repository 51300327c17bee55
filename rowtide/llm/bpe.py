"""BPE encoding and decoding with a table of distinct words.

Words are split and counted by the tasks; each distinct word that occurs at least twice is encoded once, in a
table; documents take their words' ids from it by position, and ids become text again through the table of pieces.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import clean_texts, small_batches, stash

#: Bytes of the word table that is sent to the executors, at most.
TABLE_BYTES = 48 << 20
#: Bytes that a word takes there besides its ids.
_ENTRY = 20


def distinct_words(docs: DataFrame, path: str, flush: int = 250_000) -> DataFrame:
    """(word, uses): the distinct words of text and how often they occur. Counted in each task before the shuffle;
    flush: words that a task holds at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, uses = tokens.encoder(path).words, Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(uses), pa.string()), pa.array(list(uses.values()), pa.int64())], ["word", "uses"])

        for batch in batches:
            for text in clean_texts(batch.column(0)):
                uses.update(split(text))
            if len(uses) > flush:
                yield out()
                uses = Counter()
        yield out()

    return docs.select("text").mapInArrow(count, "word string, uses long").groupBy("word").agg(F.sum("uses").alias("uses"))


def encoded_words(words: DataFrame, path: str, least: int = 2) -> DataFrame:
    """(key, check, uses, ids): hashes of each distinct word used at least `least` times, and its ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokens.encoder(path)
        for batch in batches:
            word = batch.column(0).to_pylist()
            hashes = [xxhash.xxh3_128_intdigest(w.encode()) for w in word]
            key = np.array([h & 0xFFFFFFFFFFFFFFFF for h in hashes], np.uint64).view(np.int64)
            check = np.array([h >> 96 for h in hashes], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(check), batch.column(1), pa.array(model.fresh(word), pa.binary())], ["key", "check", "uses", "ids"])

    return words.where(F.col("uses") >= least).select("word", "uses").mapInArrow(encode, "key long, check long, uses long, ids binary")


def bounded_table(encoded: DataFrame, most: int = TABLE_BYTES) -> tuple[tokens.WordTable, int]:
    """The table of the most used words that stays within `most` bytes, and the least use that is in it."""
    cost = F.octet_length("ids") + _ENTRY
    by_use = sorted(encoded.groupBy(F.floor(F.log2("uses") * 4).cast("int").alias("step")).agg(F.sum(cost).alias("cost"), F.min("uses").alias("least")).collect(), reverse=True)
    total, least = 0, None
    for row in by_use:
        total += row.cost
        if total > most:
            break
        least = row.least
    rows = encoded.where(F.col("uses") >= least if least else F.lit(False)).select("key", "check", "ids").toArrow()
    blob = rows["ids"].combine_chunks() if rows.num_rows else pa.array([], pa.binary())
    blob = blob if isinstance(blob, pa.Array) else pa.concat_arrays(blob.chunks)
    sizes = np.array(pa.compute.binary_length(blob).to_numpy(zero_copy_only=False), np.int64) // 4
    ids = np.frombuffer(b"".join(blob.to_pylist()), "<u4")
    ids = ids.astype(np.uint16) if not len(ids) or ids.max() < 65536 else ids
    return tokens.WordTable(rows["key"].to_numpy().view(np.uint64), rows["check"].to_numpy().astype(np.uint32), np.cumsum(sizes), ids), least or 0


class PieceTable:
    """id -> bytes of a byte-level vocabulary; its size is that of the vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        to_byte = {c: b for b, c in tokens.byte_letters().items()}
        vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
        pieces = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            pieces[i] = bytes(to_byte[c] for c in piece) if all(c in to_byte for c in piece) else piece.encode()
        self.pieces = pa.array(pieces, pa.binary())

    def decode(self, ids: np.ndarray) -> str:
        got = self.pieces.take(pa.array(ids))
        data = got.buffers()[2]  # the pieces one after another
        return data.to_pybytes().decode("utf-8", "replace") if data is not None else ""


@lru_cache(2)
def _piece_table(path: str) -> PieceTable:
    return PieceTable(path)


def encode_decode(docs: DataFrame, path: str | None = None, most: int = TABLE_BYTES, with_ids: bool = True) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, and if asked for ids
    and the decoded text.

    The word table has each word used at least twice, as long as it stays within `most` bytes; a word used once, or
    one of the rarest beyond the bound, is encoded where it stands. Ids are those of the tokenizers library for the
    whole text in either case. A null or empty text has no ids. Rows that repeat give repeated rows, a null doc_id
    stays null, an empty table gives no rows; other columns of docs are not read.

    Shuffled: each task's distinct words with their counts, never texts or positions.
    """
    path = path or tokens.vocabulary("byte_bpe_50k.json")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    table, _ = bounded_table(stash(encoded_words(distinct_words(docs, path), path), "words"), most)
    sent = spark.sparkContext.broadcast(table)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pieces = tokens.encoder(path), _piece_table(path)
        model.table = sent.value
        for batch in batches:
            coded = model.encode(clean_texts(batch.column(1)))
            ids = [np.frombuffer(x, "<u4") for x in coded]
            texts = [pieces.decode(x) for x in ids]
            columns = [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in coded]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])]
            if with_ids:
                columns += [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(join, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)
