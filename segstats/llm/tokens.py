"""Token ids of whole texts with a tokenizers file, as little-endian unsigned 32-bit bytes.

Both supported kinds of pre-tokenizer end a piece wherever a single space stands
between two characters that are not white space.  So a text is cut there, each
piece is encoded by the library together with the space before it, and pieces
that come again are taken from a bounded memory of the worker.  A piece of Latin
letters, of ASCII marks, or of one after the other is what the pre-tokenizer
would hand to the model (the letters, then the marks), so it is given to the
library's model at once; a single line end may stand in the place of the space.  Files with any other pre-tokenizer are given whole
texts.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable

from tokenizers import Tokenizer

_RARE = re.compile("[\t\r\v\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space for str.split() only
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Letters whose lower case and composition do not depend on what stands around them, then marks that no contraction begins with.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*)([!-&(-/:-@\[-`{-~]*)")
#: Pieces of a generation that a worker remembers, and the longest that is.
REMEMBERED, LONGEST = 250_000, 48
_PROBES = ("The", "straße,", "École", "niño?!", "x", "...", "Ünder-", "of", "###", "Ĳssel.", "ſo")

_open: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, once for each worker process."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def _ends_pieces_at_spaces(kind: dict) -> bool:
    if kind.get("type") == "ByteLevel":
        return kind["use_regex"] and not kind["add_prefix_space"]
    steps = kind.get("pretokenizers", [])
    return bool(steps) and steps[0]["type"] == "Split" and steps[0]["invert"] and steps[0]["behavior"] == "Removed" and "\\s" in str(steps[0]["pattern"])


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level models write for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 0x100 + i for i, b in enumerate(others)}


class _Pieces(dict):
    """Ids of pieces; what is not there is encoded.  Holds two generations of ``limit`` pieces: what the younger lacks is looked up in the older."""

    def __init__(self, encode: Callable[[str], bytes], limit: int):
        self.encode, self.limit, self.older = encode, limit, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids

    def age(self) -> None:
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        kind = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        self.space = "\u0120" if kind.get("type") == "ByteLevel" else ""  # how the model spells the space before a piece
        self.lower = not self.space
        self.letters = _byte_letters()
        self.cuts = _ends_pieces_at_spaces(kind)
        self.known = _Pieces(self._after_space, REMEMBERED)
        self.words = _Pieces(lambda word: self._spelled(word, self.space), REMEMBERED // 4)
        self.bare = _Pieces(lambda part: self._spelled(part, ""), REMEMBERED // 4)
        self.line = b"" if self.lower else self._whole("\n")
        self.plain = self.cuts and all(self._plain(p) == self._whole(f" {p}") for p in _PROBES) and (
            self.lower or all(self._plain(f"\n{p}") == self._whole(f"\n{p}") for p in _PROBES))

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _spelled(self, text: str, space: str) -> bytes:
        text = text.lower() if self.lower else text
        spelled = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(space + spelled)]).tobytes()

    def _plain(self, piece: str) -> bytes | None:
        """Ids of a space, or of a line end in its place, and the letters and marks after it; None for any other piece."""
        if piece[:1] == "\n" and not self.lower:
            found = _PLAIN.fullmatch(piece, 1)
            return None if found is None else self.line + (self._joined(found, self.bare) if found[0] else b"")
        found = _PLAIN.fullmatch(piece)
        if found is None or not piece:
            return None
        return self._joined(found, self.words) if found[1] and found[2] else self._spelled(piece, self.space)

    def _joined(self, found: re.Match, memory: _Pieces) -> bytes:
        letters, marks = found.groups()
        if not letters:
            return memory[marks]
        return memory[letters] + (self.bare[marks] if marks else b"")

    def _after_space(self, piece: str) -> bytes:
        if self.plain and piece.isascii():  # most of what is new: a word, perhaps with one mark
            if piece.isalpha():
                return array("I", [t.id for t in self.model.tokenize(self.space + (piece.lower() if self.lower else piece))]).tobytes()
            if piece[-1:] in ".,;:!?" and piece[:-1].isalpha():
                return self.words[piece[:-1]] + self.bare[piece[-1]]
        ids = self._plain(piece) if self.plain else None
        return self._whole(piece if piece[:1] == "\n" and not self.lower else f" {piece}") if ids is None else ids

    def _dropped(self, text: str) -> list[str]:
        """Pieces for a tokenizer that drops white space and case; Latin-1 letters have one lower case each, wherever they stand."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        return text.split() if "<|" in text else text.lower().split()

    def encode(self, text: str) -> bytes:
        """The ids of a text without special tokens."""
        if not self.cuts or not text or (self.lower and _SEPARATORS.search(text)):
            return self._whole(text) if text else b""
        for memory in (self.known, self.words, self.bare):
            memory.age()
        if self.lower:
            return b"".join(map(self.known.__getitem__, self._dropped(text)))
        if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or _RARE.search(text):
            head, *rest = _CUT.split(text)
            pieces = [p[1:] for p in rest]
        else:  # a line end begins a piece of its own with the word after it
            head, *pieces = text.replace("\n", " \n").split(" ")
        return (self._whole(head) if head else b"") + b"".join(map(self.known.__getitem__, pieces))
