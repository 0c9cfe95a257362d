import numpy as np
import pytest
import xxhash
from llm_helpers import docs_frame, odd_texts, prose, seeded

from vitalstream.llm import simhash
from vitalstream.llm.components import components


def brute_fingerprint(text, k=4):
    words = [w for w in "".join(c if c in "\t\n\v\f\r " or c not in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c.lower() for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, bits=4):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            r = root(i)
            least[r] = min(d, least.get(r, d))
    return [least.get(root(i)) for i in range(len(ids))]


def test_fingerprints_equal_brute_force():
    rng = seeded(1)
    for text in [*odd_texts(rng), "A b C d", "A b\vC d e", "\xa0a b", *(prose(rng, n) for n in range(12))]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_long_text_in_strides(monkeypatch):
    rng = seeded(2)
    text = prose(rng, 500)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "STRIDE", 7)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text)


@pytest.mark.parametrize("extra", [False, True])
def test_near_duplicates_equal_brute_force(spark, extra):
    rng = seeded(3)
    base = [prose(rng, 200) for _ in range(6)]
    texts = odd_texts(rng)
    for b in base:
        for _ in range(6):
            words = b.split(" ")
            words[rng.randrange(len(words))] = "changed"
            texts += [" ".join(words), b]
    ids = [None if i % 17 == 5 else (i * 7) % 90 for i in range(len(texts))]
    found = simhash.near_duplicates(docs_frame(spark, texts, ids, extra=extra)).collect()
    fps = [brute_fingerprint(t) for t in texts]
    want = sorted(zip(map(str, ids), (f"{f:016x}" for f in fps), map(str, brute_components(ids, fps))))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == want


def roots(spark, fps, **how):
    links = simhash.links_between(spark.createDataFrame([(int(f),) for f in fps], "fp long"), **how)
    named = {r.vertex: r.root for r in components(links).collect()}
    return [named.get(int(f), int(f)) for f in fps]


@pytest.mark.parametrize("bits,blocks,bucket", [(4, 7, 4096), (4, 7, 3), (3, 6, 2), (4, 5, 2)])
def test_buckets_of_any_size_give_the_same_components(spark, bits, blocks, bucket):
    rng = np.random.default_rng(4)
    centres = rng.integers(-(1 << 62), 1 << 62, 3)
    fps = set(centres.tolist())
    for c in centres.tolist():
        for _ in range(25):
            flips = sum(1 << int(b) for b in rng.choice(62, rng.integers(1, 6), replace=False))
            fps.add(c ^ flips)
    fps = sorted(fps)
    got = roots(spark, fps, max_bits=bits, blocks=blocks, max_bucket=bucket)
    masked = [f & (1 << 64) - 1 for f in fps]
    want = brute_components(list(range(len(fps))), masked, bits)
    assert [got.index(r) for r in got] == [want.index(w) for w in want]


def test_keep_one_each(spark):
    rng = seeded(5)
    a, b = prose(rng, 100), prose(rng, 100)
    df = docs_frame(spark, [a, a, b, b, None, "", b], [5, 3, 9, 9, None, 8, None], extra=True)
    kept = simhash.keep_one_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 8, 9]


def test_empty(spark):
    df = docs_frame(spark, [])
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_one_each(df).count() == 0


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in components(path).collect()} == {0}
