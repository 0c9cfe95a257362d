import public_tokenizers
import pytest
from llm_helpers import docs_frame, odd_texts, prose, seeded
from tokenizers import Tokenizer, models, pre_tokenizers

from vitalstream.llm import viterbi


def library(pieces, unk_id, byte_fallback):
    t = Tokenizer(models.Unigram(pieces, unk_id=unk_id, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def random_texts(rng, n):
    parts = [" ", " ", "  ", "\n", "a", "the", "ing", "é", "日", "1", "!", ".", "▁", "<0x0A>", "<s>", "<unk>", "\x00", "🙂", "word", "\t"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_public_vocabulary():
    pieces = viterbi.read_pieces(public_tokenizers.path(viterbi.VOCABULARY))
    lib, mine, rng = library(pieces, 0, True), viterbi.Counter(pieces), seeded(1)
    assert mine.parted
    for t in [*random_texts(rng, 4000), *(x for x in odd_texts(rng) if x), *(prose(rng, 60) for _ in range(50))]:
        assert mine.count(t) == len(lib.encode(t, add_special_tokens=False).ids), repr(t)


@pytest.mark.parametrize("bytes_too", [False, True])
def test_small_vocabularies_with_ties(bytes_too):
    rng = seeded(2)
    for _ in range(60):
        names = {"".join(rng.choice("ab▁c") for _ in range(rng.randint(1, 4))) for _ in range(12)}
        pieces = [("<unk>", 0.0)] + [(p, float(-rng.randint(1, 4)) / rng.choice([1, 1, 4])) for p in sorted(names)]
        if bytes_too:
            pieces += [(f"<0x{b:02X}>", 0.0) for b in range(256)]
        lib, mine = library(pieces, 0, bytes_too), viterbi.Counter(pieces)
        for _ in range(60):
            t = "".join(rng.choice("aabbc dé") for _ in range(rng.randint(0, 12)))
            assert mine.count(t) == len(lib.encode(t, add_special_tokens=False).ids), (pieces, t)


def test_operator(spark, monkeypatch):
    monkeypatch.setattr(viterbi, "KNOWN", 10)
    texts = odd_texts(seeded(3))
    pieces = viterbi.read_pieces(public_tokenizers.path(viterbi.VOCABULARY))
    lib = library(pieces, 0, True)
    ids = [None, *range(len(texts) - 1)]
    got = viterbi.count_tokens(docs_frame(spark, texts, ids, extra=True)).collect()
    want = [(i, len(lib.encode(t or "", add_special_tokens=False).ids), len(t or "")) for i, t in zip(ids, texts)]
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.n_chars) for r in got))) == sorted(map(str, want))
    assert viterbi.count_tokens(docs_frame(spark, [])).count() == 0
