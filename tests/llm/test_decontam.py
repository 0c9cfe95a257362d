import numpy as np
from llm_helpers import docs_frame, odd_texts, prose, seeded

from vitalstream.llm import decontam


def brute(doc, item):
    """The most equal words of a stretch (+1, -2) on any diagonal that holds a masked seed, 0 if below the thresholds."""
    a, b = decontam.word_hashes(doc), decontam.word_hashes(item)
    best = 0
    for d in range(-len(b), len(a)):
        i, j = max(d, 0), max(-d, 0)
        n = min(len(a) - i, len(b) - j)
        if n <= 0:
            continue
        same = a[i : i + n] == b[j : j + n]
        for mask in decontam.MASKS:
            need = [k for k, c in enumerate(mask) if c == "1"]
            for hit in range(n - len(mask) + 1):
                if all(same[hit + k] for k in need):
                    low, high = max(0, hit - decontam.REACH), min(n, hit + decontam.REACH)
                    start, end, got = decontam.overlap(a[i + low : i + high], b[j + low : j + high], hit - low)
                    if got >= decontam.MIN_MATCHES and got >= decontam.MIN_SHARE * (end - start):
                        best = max(best, got)
    return best


def case(seed):
    rng = seeded(seed)
    items = [prose(rng, n) for n in (0, 5, 9, 14, 20, 40, 40)] + [None]
    docs = odd_texts(rng)[:5] + [prose(rng, 80) for _ in range(4)]
    for item in items[3:7]:
        for every in (0, 3, 4, 5, 7):
            words = item.split(" ")
            if every:
                words[every - 1 :: every] = [f"other{i}" for i in range(len(words[every - 1 :: every]))]
            docs.append(prose(rng, 30) + " " + " ".join(words).upper() + ". " + prose(rng, 20))
    docs.append(items[5] + " " + items[4])
    return docs, items


def test_leaks_equal_brute_force(spark):
    docs, items = case(1)
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.matches for r in decontam.find_leaks(docs_frame(spark, docs, extra=True), bench).collect()}
    want = {(i, j): n for i, d in enumerate(docs) for j, t in enumerate(items) if (n := brute(d, t))}
    assert got == want
    assert len({d for d, _ in want}) >= 15


def test_places(spark):
    rng = seeded(2)
    item = prose(rng, 30)
    doc = prose(rng, 7) + " " + item
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    (r,) = decontam.find_leaks(docs_frame(spark, [doc]), bench).collect()
    assert (r.doc_start, r.item_start, r.words, r.matches) == (7, 0, 30, 30)


def test_drop(spark):
    docs, items = case(3)
    ids = [None if i % 4 == 1 else i % 6 for i in range(len(docs))]
    df = docs_frame(spark, docs, ids, extra=True)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    kept = decontam.drop_leaks(df, bench)
    assert kept.columns == df.columns
    clean = [(i, d) for i, d in zip(ids, docs) if not any(brute(d, t) for t in items)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, clean))
    assert decontam.drop_leaks(df, bench.limit(0)).count() == len(docs)
    assert decontam.drop_leaks(df.limit(0), bench).count() == 0


def test_word_hashes(monkeypatch):
    text = prose(seeded(4), 400) + " Été été ÉTÉ_x é" + " ab ba aab abb"
    whole = decontam.word_hashes(text)
    words = [w for w in decontam.GAP.split(text.lower()) if w]
    known = dict(zip(words, whole.tolist()))
    assert len(whole) == len(words) and [known[w] for w in words] == whole.tolist()
    assert len(set(known.values())) == len(known)
    monkeypatch.setattr(decontam, "STRIDE", 9)
    np.testing.assert_array_equal(decontam.word_hashes(text), whole)


def most_equal(masks, upto):
    """By length from 1, the most equal words of a stretch that no mask fits into."""
    span = max(map(len, masks)) - 1
    needs = [int(m, 2) for m in masks]
    best, out = {0: 0}, []
    for _ in range(upto):
        after = {}
        for state, n in best.items():
            for bit in (0, 1):
                full = state << 1 | bit
                if all(full & need != need for need in needs):
                    key = full & ((1 << span) - 1)
                    after[key] = max(after.get(key, 0), n + bit)
        best = after
        out.append(max(best.values()))
    return out


def test_a_mask_fits_into_any_qualifying_stretch():
    for n, most in enumerate(most_equal(decontam.MASKS, 100), 1):
        assert most < max(decontam.MIN_MATCHES, decontam.MIN_SHARE * n)
    for n, most in enumerate(most_equal(decontam.SHORT_MASKS, 11), 1):
        assert n < decontam.LEAST_MATCHES or most < max(decontam.LEAST_MATCHES, decontam.MIN_SHARE * n)


def qualifies(same, least):
    return any(
        (got := sum(same[i:j])) >= least and got >= decontam.MIN_SHARE * (j - i)
        for i in range(len(same)) for j in range(i + 1, len(same) + 1)
    )


def test_substituted_and_short_items(spark):
    rng = seeded(6)
    docs, items, want = [], [], set()
    for n in [5, 6, 7, 8, 9, 10, 11] * 3 + [16] * 25 + [24] * 15:
        words = [f"w{len(items)}x{k}" for k in range(n)]
        same = [rng.random() >= 0.2 for _ in words] if len(items) >= 7 else [True] * n
        docs.append(" ".join(["a b c", *(w if s else "other" for w, s in zip(words, same)), "d e f"]))
        if qualifies(same, 12 if n >= 12 else max(5, 0.75 * n)):
            want.add(len(items))
        items.append(" ".join(words))
    items += ["a b c", "d e f d"]  # too short
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs_frame(spark, docs), bench).collect()}
    assert found == {(i, i) for i in want} and 35 < len(want) < len(docs)


def test_hot_seeds_lose_nothing(spark, monkeypatch):
    """With every seed held to be hot, all overlaps come by the wide masks."""
    docs, items = case(1)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(i, j): n for i, d in enumerate(docs) for j, t in enumerate(items) if (n := brute(d, t))}
    monkeypatch.setattr(decontam, "HOT", 0)
    found = decontam.find_leaks(docs_frame(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id): r.matches for r in found} == want


def test_a_wide_mask_fits_into_any_qualifying_stretch():
    for n, most in enumerate(most_equal(decontam.WIDE_MASKS, 40), 1):
        assert most < max(decontam.MIN_MATCHES, decontam.MIN_SHARE * n)
    assert min(map(len, decontam.WIDE_MASKS)) == 10


def test_a_common_phrase_does_not_meet_in_pairs(spark):
    phrase = "which of the following statements is the most accurate"
    text = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    items = [f"{text(i, 20)} {phrase} {text(i + 1000, 20)}" for i in range(300)]
    docs = [f"{text(i + 2000, 20)} {phrase} {text(i + 3000, 20)}" for i in range(300)] + [items[7]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = docs_frame(spark, docs)
    keyed = df.selectExpr("doc_id", "doc_id AS id", "doc_id AS doc_hash", "text")
    assert decontam._hits(keyed, bench).count() < 10 * len(docs)
    assert [(r.doc_id, r.item_id, r.words) for r in decontam.find_leaks(df, bench).collect()] == [(300, 7, 49)]


def slow_longest(same):
    best = (0, 0, 0)
    for i in range(len(same)):
        for j in range(i + 1, len(same) + 1):
            got = int(sum(same[i:j]))
            if got >= decontam.MIN_SHARE * (j - i) and (got, i - j) > (best[2], best[0] - best[1]):
                best = (i, j, got)
    return best


def test_longest_equals_brute_force():
    rng = np.random.default_rng(9)
    for n in [1, 2, 5] + [40] * 60:
        same = rng.random(n) < rng.choice([0.2, 0.6, 0.8, 1.0])
        assert decontam.longest(same)[2] == slow_longest(same)[2]
        if same.any():
            assert decontam.longest(same) == slow_longest(same)


def test_long_overlaps(spark):
    rng = seeded(10)
    item, other = prose(rng, 230), prose(rng, 60)
    words = item.split(" ")
    words[110:130] = [f"no{k}" for k in range(20)]
    docs = [prose(rng, 9) + " " + " ".join(item.split(" ")[:200]) + " end", "a b " + " ".join(words), other]
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.doc_start, r.item_start, r.words, r.matches) for r in decontam.find_leaks(docs_frame(spark, docs), bench).collect()}
    assert found == {(0, 1): (9, 0, 200, 200), (1, 1): (2, 0, 230, 210), (2, 2): (0, 0, 60, 60)}
