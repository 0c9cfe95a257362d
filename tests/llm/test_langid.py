import re
import zlib
from collections import Counter

from llm_helpers import docs_frame, odd_texts, seeded

from vitalstream.llm import langid


def brute_grams(text):
    out = Counter()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        w = f"_{w}_"
        for n in (1, 2, 3):
            out.update(w[i : i + n] for i in range(len(w) - n + 1) if w[i : i + n] != "_")
    # The gap between two words is written once, so the two-letter grams around it are the same.
    return out


def code(g):
    out = 0
    for c in g:
        out = out << 21 | ord(c)
    return out


def profile(counts):
    return [g for _, _, g in sorted((-n, code(g), g) for g, n in counts.items())][: langid.PROFILE]


def brute(docs):
    learned = {}
    for i, t, lang in docs:
        if i is not None and lang is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            learned.setdefault(lang, Counter()).update(brute_grams(t))
    profiles = {k: {g: p for p, g in enumerate(profile(v))} for k, v in learned.items() if v}
    out = []
    for i, t, _ in docs:
        top = profile(brute_grams(t))
        held = i is not None and zlib.crc32(str(i).encode()) % 3 == 1
        if not top or not profiles:
            out.append((i, held, "und", 0.0))
            continue
        apart = {k: sum(abs(p[g] - r) if g in p else langid.PROFILE for r, g in enumerate(top)) for k, p in profiles.items()}
        best = min(sorted(apart), key=apart.get)
        out.append((i, held, best, round(1 - apart[best] / (langid.PROFILE * len(top)), 9)))
    return out


def corpus(seed, n=60):
    rng = seeded(seed)
    parts = {"aa": ["the", "ing", "tion", "and"], "bb": ["eux", "ère", "ou", "que"], "cc": ["schö", "ung", "keit", "ver"]}
    docs = []
    for i in range(n):
        lang = rng.choice(list(parts))
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 80))]
        docs.append((i, " ".join(words).capitalize() + ". 12", lang if rng.random() < 0.9 else None))
    return docs


def test_equals_brute_force(spark, monkeypatch):
    docs = corpus(1) + [(100 + i, t, "aa") for i, t in enumerate(odd_texts(seeded(2)))] + [(None, "theing", "aa"), (5, "again", "bb"), (5, "again", "bb")]
    df = docs_frame(spark, [d[1] for d in docs], [d[0] for d in docs], [d[2] for d in docs], extra=True)
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in langid.identify_languages(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(docs)))


def test_long_texts_in_strides(monkeypatch):
    text = " ".join(d[1] for d in corpus(3))
    whole = langid.grams(text)
    monkeypatch.setattr(langid, "STRIDE", 11)
    parts = langid.grams(text)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_held_out_accuracy(spark):
    docs = corpus(4, 300)
    df = docs_frame(spark, [d[1] for d in docs], langs=[d[2] for d in docs])
    true = {d[0]: d[2] for d in docs}
    rows = [r for r in langid.identify_languages(df).collect() if r.held_out and true[r.doc_id]]
    assert sum(r.lang_pred == true[r.doc_id] for r in rows) >= 0.95 * len(rows) > 50


def test_drop_and_empty(spark):
    texts = ["theing and", None, "", "12 !?", "ing"]
    df = docs_frame(spark, texts, extra=True)
    kept = langid.drop_undetermined(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 4]
    assert langid.identify_languages(df.limit(0)).count() == 0
    nothing = langid.identify_languages(docs_frame(spark, ["a", "b"], langs=[None, None]))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_only_letterless_texts_go(spark):
    """Also where no profile holds any n-gram of a text, and where there is nothing to learn from."""
    texts = ["theing and", None, "", "12 !?_", "ж" * 300, "__ _é"]
    for langs in (None, [None] * len(texts), [None, "aa", "aa", "aa", None, None]):
        kept = langid.drop_undetermined(docs_frame(spark, texts, langs=langs))
        assert sorted(r.doc_id for r in kept.collect()) == [0, 4, 5]
