"""Token counts of a unigram vocabulary without the tokens: Aho-Corasick matches and a count-only Viterbi pass.

The automaton lists all pieces that end at a character; the pass keeps, per character, the best
score of a segmentation up to there and how many pieces it has. The rules are those
of the tokenizers library's Unigram model behind a Metaspace pre-tokenizer:
a text is cut before every space, the space is written as U+2581, and one is put before
a text that does not begin with it. Of equal scores the piece that starts first
wins. A character that no one-character piece covers may be unknown, at the least score minus
ten; a run of them counts as its UTF-8 bytes if the vocabulary has byte pieces, and as one piece if not. The
name of the unknown piece, written in a text, joins such a run; alone it is one piece.
"""

from __future__ import annotations

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from vitalstream.llm.common import col, pieces_of

SPACE = "▁"
#: Fixed value: what an unknown character costs beyond the least score.
UNKNOWN_PENALTY = 10.0
VOCABULARY = "piece_bpe_32k.model"
#: Parts remembered by a worker.
KNOWN = 400_000


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in order of their ids; its scores are taken as a unigram model's."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Piece counts of texts under a vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], unk_id: int = 0):
        self.name = pieces[unk_id][0]
        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(pieces).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score, piece == self.name))
        self.automaton.make_automaton()
        self.reach = max(len(p) for p, _ in pieces)
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        names = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        # No piece holds these neighbours, so every segmentation parts them. Scores that are whole
        # numbers add up exactly, so that parts may then be counted alone without moving a tie.
        self.inside = {p[i : i + 2] for p in names for i in range(len(p) - 1)}
        self.parted = self.bytes and all(float(s).is_integer() for _, s in pieces)
        self.known: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        text = text or ""
        if not text:
            return 0
        total, at, known = 0, 0, self.known
        if text[0] in (" ", SPACE):
            at = 1
        # Literal U+2581 is what a space becomes, so it cuts as well.
        while at <= len(text):
            end = text.find(" ", at + 65536)
            part = text[at:] if end < 0 else text[at:end]
            for word in part.replace(SPACE, " ").split(" "):
                n = known.get(word)
                total += self._word(word) if n is None else n
            if end < 0:
                break
            at = end + 1
        return total

    def _word(self, word: str) -> int:
        text = SPACE + word
        if self.parted and self.name not in text:
            inside, start, n = self.inside, 0, 0
            for i in range(1, len(text)):
                if text[i - 1 : i + 1] not in inside:
                    n += self._part(text[start:i])
                    start = i
            n += self._part(text[start:])
        else:
            n = self.best(text)
        if len(word) <= 64:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[word] = n
        return n

    def _part(self, part: str) -> int:
        # A part that does not begin with the space sign has a key no word has.
        key = SPACE + part
        n = self.known.get(key)
        if n is None:
            n = self.best(part)
            if len(part) <= 64:
                self.known[key] = n
        return n

    def best(self, text: str) -> int:
        """Pieces of the best segmentation; only the last ``reach`` characters are kept in mind."""
        size = min(self.reach, len(text)) + 1
        # At an end: best score, pieces, and whether it ends in unknowns (1) or the unknown piece's name alone (2).
        score, pieces, run = [0.0] * size, [0] * size, [0] * size
        done, single, found = 0, False, None  # the character being ended

        def with_unknown(before: int, value: float, part: str) -> tuple[float, int, int]:
            if not self.bytes:
                return value, pieces[before] + int(not run[before]), 1
            if not run[before] and part == self.name:
                return value, pieces[before] + 1, 2
            late = len(self.name.encode()) - 1 if run[before] == 2 else 0
            return value, pieces[before] + len(part.encode()) + late, 1

        def close() -> None:
            nonlocal found
            if not single:
                before = (done - 1) % size
                value = score[before] + self.unknown
                if found is None or value > found[0]:
                    found = with_unknown(before, value, text[done - 1])
            at = done % size
            score[at], pieces[at], run[at] = found

        for last, (length, value, named) in self.automaton.iter(text):
            while done <= last:
                if done:
                    close()
                done, single, found = done + 1, False, None
            before = (done - length) % size
            value += score[before]
            if found is None or value > found[0]:
                found = with_unknown(before, value, self.name) if named else (value, pieces[before] + 1, 0)
            single = single or length == 1
        while done <= len(text):
            if done:
                close()
            done, single, found = done + 1, False, None
        return pieces[len(text) % size]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(read_pieces(path))
    return _counters[path]


def count_tokens(df: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``n_tokens``, ``n_chars``. Null and empty texts have none.

    Rows with null or repeated ids are counted like any other; other columns
    are not read. Memory follows the longest stretch without a space.
    """
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches):
        count = counter(vocabulary).count
        for batch in batches:
            for part in pieces_of(batch, "text"):
                texts = part.column("text").to_pylist()
                counts = [pa.array([count(t) for t in texts], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts], ["doc_id", "n_tokens", "n_chars"])

    kind = df.select(col(doc_id)).schema[0].dataType.simpleString()
    docs = df.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_chars long")
