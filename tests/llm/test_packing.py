import numpy as np
import pytest
from llm_helpers import docs_frame, odd_texts, prose, seeded
from test_records import library

from vitalstream.llm import packing


@pytest.mark.parametrize("seed", range(5))
def test_pack_holds_the_capacity(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 257, rng.integers(1, 600))
    found = packing.pack(lengths, 1024)
    sums = np.bincount(found, weights=lengths)
    assert sums.max() <= 1024 and len(found) == len(lengths)
    assert len(sums) <= np.ceil(lengths.sum() / 1024) * 1.06 + 1


def test_windows_rise_with_the_capacity_exceeded():
    assert len(set(packing.pack([600, 600, 600], 1000))) == 3
    assert sorted(np.bincount(packing.pack([500, 500, 500, 500], 1000))) == [2, 2]
    assert packing.pack([], 10).tolist() == []
    with pytest.raises(ValueError):
        packing.pack([11], 10)


def test_differencing_is_near_equal():
    lengths = np.random.default_rng(1).integers(1, 257, 400)
    sums = np.bincount(packing.balanced(lengths, 40), weights=lengths, minlength=40)
    assert sums.sum() == lengths.sum() and sums.max() - sums.min() <= 5


@pytest.mark.parametrize("group", [4, 512])
def test_every_id_once(spark, group):
    rng, lib = seeded(6), library()
    texts = odd_texts(rng) + [prose(rng, n * 20) for n in range(30)]
    ids = [None if i % 13 == 3 else i for i in range(len(texts))]
    rows = packing.pack_documents(docs_frame(spark, texts, ids, extra=True), group=group).collect()
    want = sorted(str((i, lib.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in zip(ids, texts))
    docs, sequences = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id is not None:
            docs.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    for doc, pieces in docs.items():
        at, whole = 0, []
        for start, ids_, n in sorted(pieces):
            assert start == at
            at, whole = at + len(ids_), whole + ids_
        assert at == n and str((doc, whole)) in want
    assert sum(r.length for r in rows) == sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    assert len(docs) == sum(i is not None for i in ids)


def test_empty(spark):
    assert packing.pack_documents(docs_frame(spark, [])).count() == 0
