import struct
import zlib

import numpy as np
import pytest
from llm_helpers import docs_frame, odd_texts, prose, seeded
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vitalstream.llm import records
from vitalstream.llm.common import fresh_path
from vitalstream.llm.tokens import Encoder, tokenizer_path


def library():
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def test_encoder_equals_the_library(monkeypatch):
    lib, mine, rng = library(), Encoder(tokenizer_path()), seeded(1)
    parts = [" ", " ", "  ", "\n", "\t", "a", "b'", "'s", "é", "1", "!", "　", "\x1c", "\u0085", "<|endoftext|>", "word", "日", ",", ".", "...", ", ", ".\n", "\x00", "_", "²", "½"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + odd_texts(rng)
    for stride in (1 << 20, 3):
        monkeypatch.setattr("vitalstream.llm.tokens.STRIDE", stride)
        for t in texts:
            assert np.frombuffer(mine.encode(t), "<u4").tolist() == lib.encode(t or "", add_special_tokens=False).ids


def test_encoder_forgets():
    lib, mine, rng = library(), Encoder(tokenizer_path(), 900), seeded(2)
    for _ in range(20):
        t = prose(rng, 30)
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
    assert len(mine.words) <= 40


@pytest.mark.parametrize("file_bytes", [1 << 25, 300])
def test_round_trip(spark, file_bytes):
    lib, rng = library(), seeded(3)
    texts = [*odd_texts(rng), *(prose(rng, n) for n in range(30))]
    ids = [None if i % 9 == 4 else (i * 5) % 40 for i in range(len(texts))]
    path = fresh_path(spark, "records")
    index = records.write_records(docs_frame(spark, texts, ids, extra=True), path, file_bytes=file_bytes)
    rows = records.with_starts(index).orderBy("start").collect()
    want = [lib.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == sorted(
        (i is not None, i or 0, len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for i, w in zip(ids, want)
    )
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert order == sorted(order)
    back = records.read_records(spark, path, index.orderBy(F.xxhash64("doc_id")))
    assert sorted(map(str, ((r.doc_id, list(r.ids)) for r in back.collect()))) == sorted(map(str, zip(ids, want)))
    some = records.read_records(spark, path, index.where("doc_id = 15"))
    assert {r.doc_id for r in some.collect()} == {15}


def test_empty(spark):
    path = fresh_path(spark, "records")
    assert records.with_starts(records.write_records(docs_frame(spark, []), path)).count() == 0


def test_damage_is_found():
    good = records.frame(7, np.array([1, 2, 70000], "<u4")) + b"\n"
    after, doc_id, ids = records.frame_at(good, 0)
    assert (after, doc_id, ids.tolist()) == (len(good), 7, [1, 2, 70000])
    for i in range(len(good) - 1):
        bad = bytearray(good)
        bad[i] ^= 4
        with pytest.raises(ValueError):
            records.frame_at(bytes(bad), 0)
    with pytest.raises(ValueError):
        records.frame_at(good[:-6], 0)
    assert struct.unpack("<Q", good[:8])[0] == len(good) - 17


def test_memory_of_words_is_bounded_in_bytes():
    mine, rng = Encoder(tokenizer_path(), 1 << 16), seeded(9)
    for _ in range(20):
        # Words without spaces are never kept; many short ones push out older ones.
        mine.encode("".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(50_000)))
        assert not mine.words
    for k in range(40):
        mine.encode(" ".join(f"w{k}x{i}" for i in range(200)))
        kept = sum(len(w) + len(i) + 180 for d in (mine.words, mine.older) for w, i in d.items())
        assert kept <= 2 * (1 << 16) + 200 * 220
    assert mine.older


@pytest.mark.parametrize("memory", [900, 96 << 20])
def test_texts_together_equal_the_library(monkeypatch, memory):
    """Many texts at once give the ids of each alone, and a word is looked up once however often it stands."""
    monkeypatch.setattr("vitalstream.llm.tokens.STRIDE", 2000)
    lib, mine, rng = library(), Encoder(tokenizer_path(), memory), seeded(11)
    texts = [*odd_texts(rng), "a\x00b c", "\x00", "x y. z, " * 900, "ü ß. ,", prose(rng, 300), " end ", "  two  ", "a . b ,c"]
    got = mine.encode_all(texts)
    for text, ids in zip(texts, got.to_pylist(), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text or "", add_special_tokens=False).ids
    assert mine.encode_all([]).to_pylist() == [] and mine.encode_all([None, ""]).to_pylist() == [b"", b""]
    asked = []
    learn = Encoder._learn
    monkeypatch.setattr(Encoder, "_learn", lambda self, word: asked.append(word) or learn(self, word))
    Encoder(tokenizer_path()).encode_all(["one two"] * 500 + ["two one two"] * 500)
    assert sorted(asked) == sorted([" one", " two", "one", "two"])
