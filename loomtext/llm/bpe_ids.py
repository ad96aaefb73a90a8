"""Token ids of whole texts with a public byte-level BPE (``tokenizers``).

The pre-token pattern of a byte-level BPE always starts a token at a single
space between two other characters, and makes a token of a single line break
between two.  So a text without other white space, and without two of them in a
row, is encoded piece by piece, and the ids of a piece are kept in a bounded
cache; any other text goes to the library whole.  Both give the library's ids.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from string import punctuation

import numpy as np

#: Pieces kept per Python worker (some 250 bytes each), and the longest of them.
CACHE_PIECES, CACHE_CHARS = 500_000, 48
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u3000\ufeff]")


def _byte_names() -> list[str]:
    """The character by which a byte-level BPE names each byte: itself where it
    prints, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class _Pieces(dict):
    """piece -> ids as bytes; the piece follows ``lead`` ('' or a space)."""

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, piece: str) -> bytes:
        word = piece.rstrip(punctuation)
        if word.isalpha() and max(word) < "\u0250":  # Latin letters: one pre-token
            if word == piece:
                ids = self.encoder.word(self.lead + piece)
            else:  # marks that follow letters make one more
                ids = self[word] + self.encoder.marks[piece[len(word):]]
        else:
            ids = self.encoder.whole(self.lead + piece)
        if len(self) < CACHE_PIECES and len(piece) <= CACHE_CHARS:
            self[piece] = ids
        return ids


class Encoder:
    """Texts to id bytes (little-endian, ``dtype`` wide)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                         and pre.get("use_regex", True) and spec.get("normalizer") is None)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.model, self.names = self.lib.model, dict(enumerate(_byte_names()))
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.line_break = self.whole("\n")
        self.head, self.tail, self.marks = _Pieces(self, ""), _Pieces(self, " "), _Pieces(self, "")

    def word(self, word: str) -> bytes:
        """Ids of one pre-token, without the library's search for pre-tokens and offsets."""
        named = word.encode().decode("latin-1").translate(self.names)
        return array(self.code, [t.id for t in self.model.tokenize(named)]).tobytes()

    def whole(self, text: str) -> bytes:
        return np.asarray(self.lib.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_piece or _OTHER_SPACE.search(text) or any(t in text for t in self.added):
            return self.whole(text)
        out = []
        tail = self.tail.__getitem__
        for line in text.split("\n"):
            pieces = line.split(" ")
            if "" in pieces:  # two spaces or breaks in a row, or one at an end
                return self.whole(text)
            out.append(self.head[pieces[0]])
            if len(pieces) > 1:
                out[-1] += b"".join(map(tail, pieces[1:]))
        return self.line_break.join(out)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    """The 50k byte-level BPE of the installed public vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
