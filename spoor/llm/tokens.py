"""Token ids of public tokenizers as little-endian bytes, with a cache of words that is bounded in bytes.

A tokenizer file whose normalizer and pre-tokenizer are one of the two kinds known here is used word by word: its
pre-tokenizer's pattern, spelt out for plain Latin text, cuts the text, and the file's own model encodes each different
word once while the cache holds it. A text with other characters is cut at white space, where no token of these kinds
crosses, and its words with such characters go through the whole tokenizer, as do texts with strings that look special. Any other
file is used whole for every text.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable

from tokenizers import Tokenizer

#: Bytes of a generation of the cache, of which a worker holds two; words of more letters are not kept.
CACHE_BYTES, LONGEST = 32 << 20, 64
_ENTRY = 250  # bytes of an entry besides its letters and ids
_SPECIAL = "<|"
_RARE_SPACE = re.compile(r"[^\S \n\r\t]")
#: Letters and numbers among the plain characters; İ lower-cases to two characters and is left out.
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_ODD = re.compile("[^ \\n\\r\\t\\x21-\\x7e\\xa1-\\u012f\\u0131-\\u024f]")
#: Fixed patterns of the two kinds' pre-tokenizers, with plain classes.
_BYTE_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_WORD_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
#: Fixed settings by which the two kinds are told from other files.
_BYTE_KIND = (None, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True})
_WORD_KIND = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]},
)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


_LETTERS = _byte_letters()


def _same(given: object, known: object) -> bool:
    """Whether given has all that known has; trimming of offsets changes no id."""
    if isinstance(known, dict):
        return isinstance(given, dict) and all(k in given and _same(given[k], v) for k, v in known.items())
    if isinstance(known, list):
        return isinstance(given, list) and len(given) == len(known) and all(map(_same, given, known))
    return given == known


class _Cache(dict):
    """Two generations of at most CACHE_BYTES: a full one becomes the old one, and what is used again moves to the new one."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.old, self.held = make, {}, 0

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > LONGEST:
                return found
        if self.held >= CACHE_BYTES:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self.held += _ENTRY + len(key) + len(found)
        self[key] = found
        return found


class Encoder:
    """encode(text) gives the bytes of the ids that Tokenizer.encode(text, add_special_tokens=False) gives."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        told = json.loads(self.whole.to_str())
        own = (told["normalizer"], told["pre_tokenizer"])
        self.byte, self.word = (all(map(_same, own, kind)) for kind in (_BYTE_KIND, _WORD_KIND))
        self.model, self.pattern = self.whole.model, _WORD_PATTERN if self.word else _BYTE_PATTERN
        self.parts, self.pieces = _Cache(self.part), _Cache(self.full)
        self.cut = re.compile(r"[^ \n\r\t]+" if self.word else r"[ \n\r\t]*[^ \n\r\t]+|[ \n\r\t]+\Z")

    def full(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, part: str) -> bytes:
        letters = part.replace(" ", "Ġ") if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self.pattern.findall(text.lower() if self.word else text)))

    def encode(self, text: str) -> bytes:
        if not (self.byte or self.word) or _SPECIAL in text:
            return self.full(text)
        if not _ODD.search(text):
            return self.plain(text)
        if self.byte and _RARE_SPACE.search(text):
            return self.full(text)
        return b"".join(self.pieces[p] if _ODD.search(p) else self.plain(p) for p in self.cut.findall(text))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
