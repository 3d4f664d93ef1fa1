"""Byte-level tokenizer files, and cutting text where their split certainly cuts."""

from __future__ import annotations

import json
import re
from array import array

#: Fixed value: the published split of byte-level BPE into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space that stands before a non-space always starts a new piece, as runs of white
#: space leave their last character to what follows. `\S` of Python takes more
#: characters for white space than the tokenizer does, which only cuts less.
CUT = re.compile(r" (?=\S)")
#: Chunks in one generation of a memory.
MOST = 300_000


def cut(text: str) -> list[str]:
    """The text in chunks; all but the first lack their leading space.

    >>> cut("a  b c")
    ['a ', 'b', 'c']
    """
    parts = text.split(" ")
    if "" in parts or any(map(str.isspace, {p[0] for p in parts})):
        return CUT.split(text)
    return parts


class Memory(dict):
    """At most two generations of MOST entries: what is used stays, the rest goes."""

    def __init__(self) -> None:
        self.old: dict = {}

    def missing(self, keys: set) -> list:
        """The keys that neither generation has; those of the old one move up."""
        new = {k for k in keys if k not in self}
        if len(self) + len(new) > MOST:
            self.old = dict(self)
            self.clear()
            new = keys
        old = self.old
        self.update((k, old[k]) for k in new if k in old)
        return [k for k in new if k not in old]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = (b for b in range(256) if b not in own)
    sign = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [sign[b] for b in range(256)]


def spec(path: str) -> dict:
    """A tokenizers file of byte-level BPE; others are refused."""
    with open(path, encoding="utf-8") as f:
        out = json.load(f)
    if out["model"]["type"] != "BPE" or (out.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or out.get("normalizer"):
        raise ValueError("a byte-level BPE file without a normalizer is expected")
    return out


class Chunks(dict):
    """Ids of texts by a tokenizers file; each distinct chunk is merged once.

    The file's merges run in tiktoken, which gives the same ids several times faster.
    Maps a chunk without its leading space to its ids as little-endian unsigned 32-bit
    numbers, in two generations of at most MOST chunks.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        own, byte = spec(path), {s: i for i, s in enumerate(byte_symbols())}
        self.special = {t["content"]: t["id"] for t in own["added_tokens"]}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in own["model"]["vocab"].items() if t not in self.special}
        self.encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.old: dict[str, bytes] = {}
        self.marks = {c: self._encode(c) for c in ".,"}

    def __missing__(self, chunk: str) -> bytes:
        if chunk in self.old:
            out = self.old[chunk]
        elif chunk[-1:] in self.marks and chunk[-2:-1].isalpha():  # a mark after a letter is a piece of its own
            out = self[chunk[:-1]] + self.marks[chunk[-1]]
        else:
            out = self._encode(" " + chunk)
        self[chunk] = out
        return out

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids; special strings count as their ids."""
        if self.split and any(s in text for s in self.special):
            return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self._plain(p) for p in self.split.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if len(self) > MOST:
            self.old = dict(self)
            self.clear()
        head, *parts = cut(text)
        if len(parts) > MOST:
            return self._encode(text)
        return self._encode(head) + b"".join(map(self.__getitem__, parts))

    def _encode(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()
