"""Packing by powers of two: a document is cut into pieces of binary lengths, and equal lengths share a bucket.

A piece is a whole sequence, so no sequence crosses documents and none needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import clean_texts, small_batches

WIDTH = 1024
END = 0


def piece_lengths(n: int, width: int = WIDTH) -> list[int]:
    """n as pieces: as many of `width` (a power of two) as fit, then the binary digits of the rest, largest first."""
    rest = n % width
    return [width] * (n // width) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, path: str | None = None, width: int = WIDTH, end: int = END, with_ids: bool = True) -> DataFrame:
    """A row for each piece of each row of docs (doc_id, text).

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of the length) and, if
    asked for, ids. Training reads the bucket of a length, in which every sequence has that length. A null or empty
    text is the end mark alone, one piece of length 1. Rows that repeat are packed each on their own; a null doc_id
    stays null. An empty table gives no rows. Other columns of docs are not read. sequence_id: unique, from the
    partition's number and the place in it.

    One pass without a shuffle; a task holds one Arrow batch.
    """
    path = path or tokens.vocabulary("byte_bpe_50k.json")
    if width < 1 or width & (width - 1):
        raise ValueError("width must be a power of two")
    small_batches(docs.sparkSession)
    mark = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).encode
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else []))}
            for doc, ids in zip(batch.column(0).to_pylist(), encode(clean_texts(batch.column(1)))):
                ids += mark
                n, start = len(ids) // 4, 0
                for length in piece_lengths(n, width):
                    part = ids[4 * start : 4 * (start + length)]
                    for k, v in zip(rows, (doc, start, length, zlib.crc32(part), n, *([np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else []))):
                        rows[k].append(v)
                    start += length
            types = {"doc_id": batch.schema.field(0).type, "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.int64())) for k, v in rows.items()], list(rows))

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)
    return out.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2("length").cast("int")})


def write_buckets(packed: DataFrame, folder: str) -> None:
    """The sequences as Parquet, a subfolder for each bucket."""
    packed.write.partitionBy("bucket").parquet(folder)
