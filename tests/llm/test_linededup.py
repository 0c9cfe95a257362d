import hashlib
from collections import defaultdict

from llm_helpers import docs_frame, odd_texts, prose, seeded

from vitalstream.llm import linededup


def brute_chunks(text):
    lines = (text or "").split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        by_hash = (h[i] + 31 * (h[i - 1] if i else 0)) % 1_000_003 % 2 == 0
        in_run = h[i : i + 1] == h[i + 1 : i + 2]
        beside_run = (i > 0 and h[i - 1] == h[i]) or (i + 2 < len(h) and h[i + 1] == h[i + 2])
        if i == len(lines) - 1 or (not in_run and (by_hash or beside_run)):
            out.append(lines[start : i + 1])
            start = i + 1
    return out


def brute(docs):
    """Texts left, by (id, text); rows equal in both are one document."""
    places = defaultdict(list)
    for d in set(docs):
        for at, c in enumerate(brute_chunks(d[1])):
            if len(c) >= 2:
                places["\n".join(c)].append((d, at))
    order = lambda p: (p[0][0] is None, p[0][0] or 0, p[1])
    gone = {p for v in places.values() for p in sorted(v, key=order)[1:]}
    out = {}
    for d in set(docs):
        left = ["\n".join(c) for at, c in enumerate(brute_chunks(d[1])) if (d, at) not in gone]
        removed = [c for at, c in enumerate(brute_chunks(d[1])) if (d, at) in gone]
        out[d] = ("\n".join(left) if removed else d[1], len(removed), sum(map(len, removed)))
    return out


def case(seed):
    rng = seeded(seed)
    passages = ["\n".join(prose(rng, 5) for _ in range(12)) for _ in range(3)]
    texts = odd_texts(rng)
    for i in range(25):
        own = ["\n".join(prose(rng, 4) for _ in range(rng.randint(0, 5))) for _ in range(2)]
        texts.append("\n".join([own[0], rng.choice(passages), own[1]] if i % 3 else own))
    texts += [passages[0] + "\n" + passages[0], "\n" * 50, "x\n" * 40]
    return texts


def test_equals_brute_force(spark):
    texts = case(1)
    docs = list(zip([i if i % 2 else i + 100 for i in range(len(texts))], texts))
    docs += [docs[-3], docs[15]]  # repeated rows
    df = docs_frame(spark, [t for _, t in docs], [i for i, _ in docs], extra=True)
    found = linededup.drop_repeated_chunks(df)
    assert found.columns[: len(df.columns)] == df.columns
    got = sorted(map(str, ((r.doc_id, r.text, r.chunks_removed, r.lines_removed) for r in found.collect())))
    want = brute(docs)
    assert got == sorted(map(str, ((d[0], *want[d]) for d in docs)))
    assert sum(w[1] for w in want.values()) > 10


def test_null_ids_come_last(spark):
    passage = case(2)[-3]
    found = linededup.drop_repeated_chunks(docs_frame(spark, [passage, passage], [None, 5])).collect()
    # What repeats inside the passage goes from both.
    assert {r.doc_id: r.chunks_removed for r in found}[None] > {r.doc_id: r.chunks_removed for r in found}[5]


def test_shift_resistance():
    rng = seeded(3)
    lines = [prose(rng, 4) for _ in range(200)]
    one, two = brute_chunks("\n".join(lines)), brute_chunks("\n".join(["new"] * 7 + lines))
    assert len({tuple(c) for c in one} & {tuple(c) for c in two}) >= len(one) - 2


def test_digests_that_collide(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(linededup.F, "xxhash64", lambda *c: F.lit(1).cast("long") if len(c) == 1 else F.hash(*c).cast("long"))
    texts = case(4)
    docs = list(enumerate(texts))
    got = linededup.drop_repeated_chunks(docs_frame(spark, texts)).collect()
    want = brute(docs)
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, ((d[0], want[d][0]) for d in docs)))


def test_runs_of_one_line(spark):
    """Equal lines stay together, so that a run leaves one copy in all documents."""
    rng = seeded(5)
    for line in ("All rights reserved.", "-----", "x"):
        texts = ["\n".join([prose(rng, 4), *[line] * 20, prose(rng, 4)]) for _ in range(50)]
        found = linededup.drop_repeated_chunks(docs_frame(spark, texts)).collect()
        assert sorted(r.lines_removed for r in found) == [0] + [20] * 49
        assert sum(r.text.split("\n").count(line) for r in found) == 20


def test_empty(spark):
    assert linededup.drop_repeated_chunks(docs_frame(spark, [])).count() == 0
