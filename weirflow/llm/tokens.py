"""Exact, fast encoding with the tokenizers library.

Both vocabularies used here split text before merging bytes, and never merge across those splits. So a text is cut
into chunks at single spaces, where a split is certain, and a bounded cache maps a chunk to the bytes of its ids.
Chunks that are one plain word go straight to the tokenizer's BPE model; all others through the whole tokenizer.
``encode`` therefore equals ``Tokenizer.encode(text, add_special_tokens=False)`` of the vocabulary as it is, control strings that
a text holds included: none of them has a space in it or takes those beside it. Tests compare them.
"""

from __future__ import annotations

import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, extra = [], 256
    for b in range(256):
        if b in plain:
            chars.append(chr(b))
        else:
            chars.append(chr(extra))
            extra += 1
    return chars


#: Letters, which is all that is passed through it, have no ASCII byte that changes.
_ALPHABET = {b: c for b, c in enumerate(byte_alphabet())}


def _visible(text: str) -> str:
    return text if text.isascii() else text.encode().decode("latin-1").translate(_ALPHABET)


class _Chunks(dict):
    def __init__(self, path: str, most: int):
        from tokenizers import Tokenizer

        super().__init__()
        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[chunk] = ids = self.fresh(chunk)
        return ids


class WordBpe(_Chunks):
    """For the lower-casing vocabulary with word ends: white space only separates, so every space is a safe cut.

    Below U+0130 lower-casing goes by single characters and NFC leaves letters as they are."""

    def __init__(self, path: str, most: int = 800_000):
        super().__init__(path, most)

    def fresh(self, chunk: str) -> bytes:
        if chunk.isalpha():
            if chunk.isascii() or max(chunk) < "\u0130":
                low = chunk.lower()
                if low != chunk:
                    return self[low]
                return array("I", [t.id for t in self.model.tokenize(low if low.isascii() else _visible(low))]).tobytes()
        elif chunk[-1:] in (".", ",") and chunk[:-1].isalpha() and max(chunk) < "\u0130":
            return self[chunk[:-1]] + self[chunk[-1]]
        return self.whole(chunk)

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 32-bit integers in the machine's order, little-endian on all that Spark runs on."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


class ByteBpe(_Chunks):
    """For the byte-level vocabulary: a space joins the word after it. In a text whose only white space is single
    spaces and newlines, each between two other characters, every one of them is a safe cut. A bare key stands for
    a word with the space before it, a key that begins with a newline for the newline and a word without space.
    Other texts are cut where a single space or newline stands between two other characters."""

    _CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")

    def __init__(self, path: str, most: int = 800_000):
        super().__init__(path, most)
        self.newline = self.whole("\n")

    def fresh(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return array("I", [t.id for t in self.model.tokenize("\u0120" + (chunk if chunk.isascii() else _visible(chunk)))]).tobytes()
        word = chunk[1:] if chunk[:1] == "\n" else chunk
        if word.isalpha():
            return self.newline + array("I", [t.id for t in self.model.tokenize(_visible(word))]).tobytes()
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return self[chunk[:-1]] + self[f"\n{word[-1]}"][len(self.newline) :]
        return self.newline + self.whole(word) if word is not chunk else self.whole(f" {word}")

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 32-bit integers in the machine's order, little-endian on all that Spark runs on."""
        if not text:
            return b""
        cut = f"\n{text}".replace("\n", " \n")
        if "  " in cut or "\n " in cut or cut[-1] in " \n" or not text.replace("\n", "").isprintable():
            return b"".join(map(self.whole, self._CUT.split(text)))
        return b"".join(map(self.__getitem__, cut[1:].split(" ")))[len(self.newline) :]


_ENCODERS: dict[tuple[str, str], _Chunks] = {}


def encoder(kind: type[_Chunks], path: str) -> _Chunks:
    """One encoder for each Python worker, so that its cache outlives a task."""
    if (key := (kind.__name__, path)) not in _ENCODERS:
        _ENCODERS[key] = kind(path)
    return _ENCODERS[key]
