"""Encoding of whole texts with a word memo in front of a public tokenizer file.

The merges of a piece depend on nothing outside it, and no piece crosses a place where ASCII
white space ends (``byte``) or stands (``word``). So a text may be cut there, each distinct part
be encoded once, and the ids be joined. Texts for which the cut would not be safe are given to
the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from codecs import charmap_decode

# White space beyond ASCII, which the byte pattern treats like a space, and the two split patterns
# of the tokenizer files, here for ASCII and the letters of Latin-1.
WIDE_SPACE = re.compile("[\x85\xa0  -     　]")
BYTE_PARTS = re.compile(rb" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
SPACE_RUN = re.compile(rb"[ \t-\r]{2}")
WIDE_LEADS = b"\xc2", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80"  # one of these begins each of them in UTF-8
RARE_SPACES, SPACE_PAIRS = (b"\t", b"\x0b", b"\x0c", b"\r"), (b"  ", b"\n\n", b" \n", b"\n ")
NARROW = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
BYTE_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+", re.ASCII)
WORD_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+", re.ASCII)

_ENCODERS: dict = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> str:
    """Byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(other)) for b in range(256))


def spaces_meet(data: bytes) -> bool:
    """Whether two white spaces stand side by side."""
    if any(c in data for c in RARE_SPACES):
        return SPACE_RUN.search(data) is not None
    return any(c in data for c in SPACE_PAIRS)


def has_wide_space(text: str, data: bytes) -> bool:
    return any(c in data for c in WIDE_LEADS) and WIDE_SPACE.search(text) is not None


class Memo(dict):
    """Part -> ids as bytes. At ``limit`` entries the older generation is let go; words still in use move on."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, part: bytes) -> bytes:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        got = self.older.get(part)
        got = self[part] = self.make(part) if got is None else got
        return got


class TextEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to ``Tokenizer.encode(text).ids``.

    ``kind`` is ``word`` (white space is dropped) or ``byte`` (a space belongs to the next word).
    The memo is bounded, so a worker's memory is too; its size changes only how often a part is
    encoded again.
    """

    def __init__(self, path: str, memo_words: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokenize = self.library.model.tokenize
        self.kind = "word" if "word" in os.path.basename(path) else "byte"
        self.pieces = WORD_PIECES if self.kind == "word" else BYTE_PIECES
        self.alphabet = byte_alphabet()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.merged = Memo(self._merge, memo_words // 4)
        self.memo = Memo(self._part, memo_words)
        self.spaced = Memo(self._spaced, memo_words)

    def _lines(self, data: bytes) -> bytes:
        """Ids of a text of the byte kind in which no two white spaces meet: each word has its space, each line end is a piece."""
        out, end, memo, spaced = [], self.memo[b"\n"], self.memo, self.spaced.__getitem__
        for line in data.split(b"\n"):
            first, *others = line.split(b" ")
            out.append(memo[first])
            out.extend(map(spaced, others))
            out.append(end)
        return b"".join(out[:-1])

    def _bytes(self, piece: bytes) -> bytes:
        """Ids of one piece of the split pattern."""
        return array("I", [t.id for t in self.tokenize(charmap_decode(piece, "strict", self.alphabet)[0])]).tobytes()

    def _merge(self, piece: str) -> bytes:
        return self._bytes(piece.encode())

    def _spaced(self, part: bytes) -> bytes:
        return self._bytes(b" " + part) if part.isalpha() else self._part(b" " + part)

    def _part(self, part: bytes) -> bytes:
        if part.isalpha() or part[:1] == b" " and part[1:].isalpha():  # one piece of ASCII letters
            return self._bytes(part.lower() if self.kind == "word" else part)
        text = part.decode()
        if "<|" in text or not NARROW.fullmatch(text):
            return self.whole(text)
        if self.kind == "word":
            text = text.lower()
        found = self.pieces.findall(text)
        return b"".join([self.merged[p] for p in found]) if len(found) > 1 else self._merge(found[0]) if found else b""

    def encode(self, text: str) -> bytes:
        data = text.encode()
        if self.kind == "word":
            return b"".join(map(self.memo.__getitem__, data.split()))
        if "<|" in text and any(s in text for s in self.special) or not text.isascii() and has_wide_space(text, data):
            return self.whole(text)
        if spaces_meet(data):
            return b"".join(map(self.memo.__getitem__, BYTE_PARTS.findall(data)))
        return self._lines(data)

    def whole(self, text: str) -> bytes:
        """One plain call of the library."""
        import numpy as np

        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def encoder(path: str) -> TextEncoder:
    """One encoder for each tokenizer file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
