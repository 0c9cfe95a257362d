import re
from itertools import combinations

import numpy as np
import pytest
from llm_helpers import docs_frame, odd_texts, prose, seeded

from vitalstream.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text, k=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def brute(ids, texts, percent=85):
    """Rows (id, set size, component) by comparing all pairs."""
    sets = [brute_set(t) for t in texts]
    label = list(range(len(ids)))
    for i, j in combinations(range(len(ids)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
            old = label[j]
            label = [label[i] if x == old else x for x in label]
    least = {}
    for i, x in zip(ids, label):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return [(i, len(s), least.get(x), i is not None and least.get(x) == i) for i, s, x in zip(ids, sets, label)]


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def families(rng):
    """Families whose members have a few to many edits, so that links are chains and near misses abound."""
    texts = []
    for size, most in ((40, 6), (25, 14), (12, 3)):
        base = prose(rng, 160)
        texts += [edited(rng, base, rng.randint(0, most)) for _ in range(size)]
    return texts + [prose(rng, 60) for _ in range(15)]


def check(spark, ids, texts, **how):
    got = minhash.near_duplicates(docs_frame(spark, texts, ids, extra=True), **how).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(ids, texts)))


@pytest.mark.parametrize("block", [1 << 18, 3000])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    rng = seeded(11)
    texts = families(rng)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    check(spark, ids, texts)


def test_joins_with_exploded_rows_are_not_broadcast(spark, monkeypatch):
    """Spark sizes exploded rows and stored tables too low, so a broadcast of them can exceed the driver's memory."""
    plans = []

    def noting(f):
        def run(df, *name):
            plans.append((*name, df._jdf.queryExecution().executedPlan().toString()))
            return f(df, *name)

        return run

    for name in ("materialise", "components"):
        monkeypatch.setattr(minhash, name, noting(getattr(minhash, name)))
    rng = seeded(14)
    texts = families(rng)
    check(spark, list(range(len(texts))), texts)
    # The texts of candidates are joined by a table of hashes, which do not compress.
    planned = [p for *name, p in plans if name != ["candidate-sets"]]
    assert len(planned) == len(plans) - 1 and sum("SortMergeJoin" in p for p in planned) >= 7
    assert not any("BroadcastHashJoin" in p for p in planned)


def test_odd_documents(spark):
    rng = seeded(12)
    a = prose(rng, 80)
    texts = [*odd_texts(rng), a, a.upper().replace(" ", "\t"), edited(rng, a, 1), "x y", "x  y", "x y z", None]
    ids = [None if k in (3, 12) else (k * 5) % 17 for k in range(len(texts))]
    got = minhash.near_duplicates(docs_frame(spark, texts, ids, extra=True)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(ids, texts)))


def test_threshold_is_exact(spark):
    # 17 of 20 shingles are shared: 100 * 17 = 85 * 20.
    one = " ".join(f"a{i}" for i in range(21))
    two = " ".join(f"a{i}" for i in range(19)) + " b"
    texts = [one, two]
    s, t = map(brute_set, texts)
    assert (len(s & t), len(s | t)) == (17, 20)
    check(spark, [1, 2], texts)
    check(spark, [1, 2], [one, " ".join(f"a{i}" for i in range(18)) + " b"])


def test_tables_come_from_few_minhashes():
    rng = np.random.default_rng(1)
    signer = minhash.Signer(minhash.ROWS, minhash.PARTS, minhash.SEED)
    assert len(signer.factors) == 128
    met, tries = 0, 400
    for _ in range(tries):
        both, x, y = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (170, 15, 15))
        k, m = signer.keys(np.concatenate([both, x])), signer.keys(np.concatenate([both, y]))
        met += bool((k[:16] == m[:16]).any() and (k[16:] == m[16:]).any())
    assert met == tries


def test_long_text_in_strides(monkeypatch):
    from vitalstream.llm import simhash

    text = prose(seeded(13), 4000)
    whole = minhash.shingles(text)
    keys = minhash.Signer(4, 16, 1).keys(whole)
    monkeypatch.setattr(simhash, "STRIDE", 50)
    monkeypatch.setattr(minhash, "STRIDE", 64)
    assert (minhash.shingles(text) == whole).all() and len(whole) == len(brute_set(text))
    assert (minhash.Signer(4, 16, 1).keys(whole) == keys).all()


def test_empty(spark):
    assert minhash.near_duplicates(docs_frame(spark, [])).count() == 0
    assert [tuple(r) for r in minhash.near_duplicates(docs_frame(spark, ["", None], [4, 3])).orderBy("doc_id").collect()] == [
        (3, 0, 3, True), (4, 0, 4, True)
    ]
