"""Token ids as length-delimited binary records with an offset index.

A shard file is a run of frames: the payload's length (unsigned 64-bit), the masked checksum of those eight bytes,
the payload, the masked checksum of the payload, all little-endian. A checksum is CRC-32, masked by rotating it right by 15
bits and adding a constant, so that a checksum of data that holds checksums stays sound. A payload is a byte for the width of an id (2 or 4) and the ids. The index, a
Parquet table beside the shards, has each record's shard, offset and size; a reader shuffles the index and seeks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import clean_texts, new_path, shuffle_parts, small_batches

END = 2
#: Fixed value: the constant of the checksum's mask.
MASK = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def read_frame(file: BinaryIO) -> bytes | None:
    """The next payload; None at the end of the file. ValueError if the file is cut or damaged."""
    head = file.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError("a record's length is damaged")
    size = struct.unpack("<Q", head[:8])[0]
    body = file.read(size + 4)
    if len(body) < size + 4 or struct.unpack("<I", body[size:])[0] != masked(body[:size]):
        raise ValueError("a record is damaged")
    return body[:size]


def payload(ids: bytes, wide: bool) -> bytes:
    return b"\x04" + ids if wide else b"\x02" + np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def payload_ids(body: bytes) -> np.ndarray:
    return np.frombuffer(body[1:], "<u4" if body[0] == 4 else "<u2").astype("<u4")


def _place(folder: str):
    from pyarrow import fs

    scheme, found, rest = folder.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if found and scheme in ("s3a", "s3n") else folder)


def write_records(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> DataFrame:
    """Writes docs (doc_id, text), encoded and each with the end id, as shards in ascending doc_id order, and their
    index; gives the index as (shard, record, offset, size, doc_id, n_tokens).

    folder: a place that driver and executors share, by any address that pyarrow's file systems know. Null doc_ids
    come first, equal ones in the order of their texts; a null or empty text is the end id alone; repeated rows are
    repeated records. An empty table writes no shard and an empty index. Other columns of docs are not read. A shard is written under a
    passing name and renamed, so a task that is run again replaces it whole.
    """
    path = path or tokens.vocabulary("word_bpe_49k.json")
    spark = docs.sparkSession
    small_batches(spark)
    mark = np.array([end], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (store, root) = tokens.encoder(path), _place(folder)
        wide = model.model.get_vocab_size(with_added_tokens=True) > 65536
        task = TaskContext.get()
        name = f"{root}/shard-{task.partitionId():06d}"
        passing, file, at, record = f"{name}.{task.taskAttemptId()}.tmp", None, 0, 0
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("record", "offset", "size", "n_tokens")}
            for ids in model.encode(clean_texts(batch.column(1))):
                if file is None:
                    store.create_dir(root, recursive=True)
                    file = store.open_output_stream(passing)
                ids += mark
                data = frame(payload(ids, wide))
                file.write(data)
                for k, v in zip(rows, (record, at, len(data), len(ids) // 4)):
                    rows[k].append(v)
                record, at = record + 1, at + len(data)
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()] * batch.num_rows, pa.int64()), *(pa.array(rows[k], pa.int64()) for k in ("record", "offset", "size")), batch.column(0), pa.array(rows["n_tokens"], pa.int64())], ["shard", "record", "offset", "size", "doc_id", "n_tokens"])
        if file is not None:
            file.close()
            store.move(passing, name)

    rows = docs.select("doc_id", "text").repartitionByRange(shuffle_parts(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    index = rows.mapInArrow(write, f"shard long, record long, offset long, size long, doc_id {kind}, n_tokens long")
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


def read_records(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Every record of the shards, read from the files and checked against the index: doc_id, start (ids of all
    records before it), n_tokens, ids_crc32 and, if asked for, ids."""
    index = spark.read.parquet(f"{folder}/index")
    small_batches(spark)
    total, shards = 0, []
    for shard, count in sorted(index.groupBy("shard").agg(F.sum("n_tokens")).collect()):
        shards.append((shard, total))
        total += count
    kind = index.schema["doc_id"].dataType.simpleString()
    bases = spark.sparkContext.broadcast(dict(shards))  # one entry for each shard: as many as there were partitions

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _place(folder)
        file, open_shard, at = None, None, 0
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("start", "n_tokens", "ids_crc32", "ids")}
            for shard, record, offset in zip(*(batch.column(k).to_pylist() for k in ("shard", "record", "offset"))):
                if shard != open_shard:
                    file = store.open_input_file(f"{root}/shard-{shard:06d}")
                    open_shard, at = shard, bases.value[shard]
                if file.tell() != offset:
                    raise ValueError(f"record {record} of shard {shard} isn't where the index has it")
                ids = payload_ids(read_frame(file))
                for k, v in zip(rows, (at, len(ids), zlib.crc32(ids.tobytes()), ids.astype(np.int32) if with_ids else None)):
                    rows[k].append(v)
                at += len(ids)
            columns = [batch.column("doc_id"), *(pa.array(rows[k], pa.int64()) for k in ("start", "n_tokens", "ids_crc32"))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(rows["ids"], pa.list_(pa.int32()))] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])

    entries = index.select("shard", "record", "offset", "doc_id").repartition(shuffle_parts(spark), "shard").sortWithinPartitions("shard", "record")
    return entries.mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def read_shuffled(spark: SparkSession, folder: str, seed: int = 0) -> DataFrame:
    """The records (doc_id, ids) in a random order: the index is shuffled, the files are read by offset. Null doc_ids and
    repeated rows stay as they were written, records of equal order come in any, an empty index gives no rows."""
    kind = spark.read.parquet(f"{folder}/index").schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _place(folder)
        files: dict[int, BinaryIO] = {}
        for batch in batches:
            ids = []
            for shard, offset in zip(*(batch.column(k).to_pylist() for k in ("shard", "offset"))):
                if shard not in files:
                    if len(files) >= 64:
                        files.pop(next(iter(files))).close()
                    files[shard] = store.open_input_file(f"{root}/shard-{shard:06d}")
                files[shard].seek(offset)
                ids.append(payload_ids(read_frame(files[shard])).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    order = F.xxhash64("shard", "record", F.lit(seed))
    entries = spark.read.parquet(f"{folder}/index").repartitionByRange(shuffle_parts(spark), order).sortWithinPartitions(order)
    return entries.select("shard", "offset", "doc_id").mapInArrow(read, f"doc_id {kind}, ids array<int>")


def round_trip(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """Writes docs to the shared folder and reads the files back: doc_id, start, n_tokens, ids_crc32."""
    folder = new_path(docs.sparkSession, "records")
    write_records(docs, folder, path, end)
    return read_records(docs.sparkSession, folder, with_ids=False)
