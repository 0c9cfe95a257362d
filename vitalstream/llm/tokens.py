"""Token ids of whole texts by the tokenizers library, with a bounded memory of words."""

from __future__ import annotations

import gc
import os
import re
from array import array
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

BYTE_BPE = "byte_bpe_50k.json"
#: A space between two visible characters: the byte-level pattern always splits there, whatever stands around.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Written before each space, comma and full stop; texts that hold it are left to the pattern.
SEAM = "\x00"
#: Seams where the pattern would not split: at a mark after anything but a letter or digit, and at a space
#: before white space or the end.
WRONG_MARK = re.compile(r"\x00[.,](?<=[\W_]\x00.)")
WRONG_SPACE = re.compile(r"\x00 (?![^\s\x00])")
#: Characters looked at together, and the bytes of words a worker remembers before it forgets older ones.
STRIDE, MEMORY = 1 << 20, 96 << 20
#: Longer words are not remembered; what an entry takes besides its characters and ids.
LONGEST, ENTRY = 64, 180


def tokenizer_path(name: str = BYTE_BPE) -> str:
    return public_tokenizers.path(name)


def _byte_letters() -> str:
    """The letter that byte-level tokenizers write for each byte: itself if printable, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    rest = (b for b in range(256) if b not in letters)
    letters |= {b: chr(256 + i) for i, b in enumerate(rest)}
    return "".join(letters[b] for b in range(256))


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit numbers.

    A text is cut before single spaces, commas and full stops, where the
    tokenizer splits in any case, and the words by the tokenizer's own pattern.
    The library's model encodes a word once as long as it is remembered. The memory is bounded
    by ``memory`` bytes in thirds: words met once, which are all forgotten when their third is full, and words met again, newer
    and older; when the newer third is full, the older is forgotten. Words above
    ``LONGEST`` characters (text without spaces, encoded data) are never kept. Strings of special
    tokens are ordinary text. Memory follows the longest stretch without a single space.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.set_threshold(100_000)  # many short-lived tokens, no cycles: fewer rounds of looking for some
        self.tokenize = Tokenizer.from_file(path).model.tokenize
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.letters = _byte_letters()
        self.space = self.letters[0x20]
        self.limit, self.held, self.fresh_held = memory // 3, 0, 0
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.fresh: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.parts(text or ""))

    def parts(self, text: str) -> Iterator[bytes]:
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > STRIDE and (cut := CUT.search(text, at + STRIDE)):
                end = cut.start()
            yield self._ids(text[at:end])
            at = end

    def encode_all(self, texts: list[str | None]) -> pa.Array:
        """The ids of every text as ``encode`` gives them, one binary value each.

        The words of all texts are split and numbered by Arrow, so that each distinct word is looked up once and not at
        every place. Texts above ``STRIDE`` characters and those that hold the seam are encoded one by one.
        """
        apart = {i: self.encode(t) for i, t in enumerate(texts) if t and (len(t) > STRIDE or SEAM in t)}
        seams = [self._seams(t or "") for i, t in enumerate(texts) if i not in apart]
        words = pc.split_pattern(pa.array(seams, pa.string()), SEAM)
        numbered = words.values.dictionary_encode()
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
        ids = pa.array(self._all_ids(distinct), pa.binary()).take(numbered.indices)
        _, ends, data = ids.buffers()
        # Where a text's words end, its ids do.
        ends = pa.array(np.frombuffer(ends, np.int32)[words.offsets.to_numpy()])
        found = pa.Array.from_buffers(pa.binary(), len(seams), [None, ends.buffers()[1], data])
        if not apart:
            return found
        order = np.argsort([i for i in range(len(texts)) if i not in apart] + list(apart))
        return pa.concat_arrays([found, pa.array(apart.values(), pa.binary())]).take(pa.array(order))

    def _all_ids(self, words: list[str]) -> list[bytes]:
        found = list(map(self.words.get, words))
        for at, i in enumerate([i for i, ids in enumerate(found) if ids is None]):
            if at % 4096 == 0:
                self._forget()
            found[i] = self._learn(words[i])
        return found

    def _ids(self, text: str) -> bytes:
        if SEAM in text:
            return self._pieces(text)
        seams = self._seams(text)
        self._forget()
        words = seams.split(SEAM)
        found = list(map(self.words.get, words))
        if None in found:
            for i in [i for i, ids in enumerate(found) if ids is None]:
                found[i] = self._word(words[i])
        return b"".join(found)

    @staticmethod
    def _seams(text: str) -> str:
        seams = text.replace(" ", SEAM + " ").replace(",", SEAM + ",").replace(".", SEAM + ".")
        if WRONG_SPACE.search(seams) or WRONG_MARK.search(seams):
            return CUT.sub(SEAM + " ", text)
        return seams

    def _forget(self) -> None:
        if self.held > self.limit:
            self.older, self.words, self.held = self.words, {}, 0
        if self.fresh_held > self.limit:
            self.older = self.older or self.fresh  # room that no words met again take yet
            self.fresh, self.fresh_held = {}, 0

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)  # met before in the same text
        return self._learn(word) if ids is None else ids

    def _learn(self, word: str) -> bytes:
        """The ids of a word with the space or mark before it; met again, it is remembered for long."""
        ids = self.older.get(word) or self.fresh.get(word)
        if ids:
            self.words[word] = ids
            self.held += self._size(word, ids)
            return ids
        # The pattern takes letters, and a space before them, as one piece.
        if word[1:].isalpha() and word[0] == " ":
            ids = self._ids_of(self.space + word[1:] if word.isascii() else self._lettered(word))
        else:
            ids = self._pieces(word)
        if len(word) <= LONGEST:
            self.fresh[word] = ids
            self.fresh_held += self._size(word, ids)
        return ids

    @staticmethod
    def _size(word: str, ids: bytes) -> int:
        return ENTRY + len(word) * (1 if word.isascii() else 4) + len(ids)

    def _pieces(self, text: str) -> bytes:
        return b"".join([self._ids_of(self._lettered(piece)) for piece in self.split(text)])

    def _lettered(self, piece: str) -> str:
        return charmap_decode(piece.encode(), "strict", self.letters)[0]

    def _ids_of(self, lettered: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(lettered)]).tobytes()


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, memory: int = MEMORY) -> Encoder:
    """The worker's encoder; it outlives a task."""
    if (path, memory) not in _encoders:
        _encoders[path, memory] = Encoder(path, memory)
    return _encoders[path, memory]
