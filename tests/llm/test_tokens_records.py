import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from rowtide.llm import bpe, packing, records, tokens
from rowtide.llm.common import new_path

TEXTS = [None, "", " ", "a", "Hello, world", "  two  spaces \n\n and lines\t", "<|endoftext|> it's", "é ß 日本  x\u0085y\x1cz \0", "word " * 3000, "x" * 5000, "a", "dup dup", "dup dup"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k != 3 else None, t, "ids") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[-1:], "doc_id long, text string, ids string").repartition(3)


def _model(name):
    return Tokenizer.from_file(tokens.vocabulary(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_give_the_librarys_ids(name):
    random.seed(3)
    parts = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "\r\n", "é", "'s", "'S", "12", "٣", " ", "\x1c", "\x85", "\0", "<|endoftext|>", "́", "ΑΣ", "ﬁ", "...", "日本", "İ", "ǅ", "²", "ª"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(4000)]
    coded, model = tokens.WordEncoder(tokens.vocabulary(name)).encode(texts), _model(name)
    assert [np.frombuffer(c, "<u4").tolist() for c in coded] == [model.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("most", [bpe.TABLE_BYTES, 200, 0])
def test_bpe_round_trip(spark, docs, most):
    model = _model("byte_bpe_50k.json")
    got = bpe.encode_decode(docs, most=most).collect()
    assert len(got) == len(TEXTS) + 1
    by_id = {r.doc_id: r for r in got}
    for k, t in enumerate(TEXTS):
        row, ids = by_id[k if k != 3 else None], model.encode(t or "", add_special_tokens=False).ids
        assert row.ids == ids and row.n_tokens == len(ids) and row.decoded == (t or "")
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(model.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_packing(spark, docs):
    model = _model("byte_bpe_50k.json")
    got = packing.pack(docs).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 1024 and 1 << r.bucket == r.length for r in got)
    for k, t in enumerate(TEXTS[:-1]):
        key = k if k != 3 else None
        pieces = sorted((r for r in got if r.doc_id == key), key=lambda r: r.start)
        ids = model.encode(t or "", add_special_tokens=False).ids + [0]
        assert [i for r in pieces for i in r.ids] == ids
        assert [r.start for r in pieces] == [sum(x.length for x in pieces[:j]) for j in range(len(pieces))]
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in pieces)
    assert packing.piece_lengths(2048 + 5, 1024) == [1024, 1024, 4, 1]
    assert packing.pack(docs.limit(0)).collect() == []


def test_records(spark, docs, tmp_path):
    model = _model("word_bpe_49k.json")
    folder = new_path(spark, "test")
    records.write_records(docs, folder)
    got = sorted(records.read_records(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *[k for k in range(len(TEXTS)) if k != 3], len(TEXTS) - 1]
    start = 0
    for r in got:
        ids = model.encode(TEXTS[3 if r.doc_id is None else r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert r.ids == ids and r.n_tokens == len(ids) and r.start == start
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    shuffled = records.read_shuffled(spark, folder, 7).collect()
    assert sorted(map(str, shuffled)) == sorted(str(type(shuffled[0])(doc_id=r.doc_id, ids=r.ids)) for r in got)
    assert records.round_trip(docs.limit(0)).collect() == []


def test_damaged_record(tmp_path):
    path = tmp_path / "shard"
    data = bytearray(records.frame(b"\x02abcd"))
    for place in (0, 9, 13, len(data) - 1):
        bad = data.copy()
        bad[place] ^= 1
        path.write_bytes(bad)
        with pytest.raises(ValueError), path.open("rb") as f:
            records.read_frame(f)
    path.write_bytes(data[:-2])
    with pytest.raises(ValueError), path.open("rb") as f:
        records.read_frame(f)
