"""Byte-level BPE ids for whole texts, shared by packing and by the encoding operator.

A text is cut before every blank and around every line feed. Where no two white-space characters
meet, and blanks and line feeds are the only ones, the library's pre-tokenizer cuts at all these
places too, so pieces can be encoded one by one and kept. Any other text goes to the library whole.
Without a lexicon, such a text in letters of Latin-1 is merged in one call, which costs less than
cutting it up and looking up its pieces, most of which are met a few times only.
"""

from __future__ import annotations

import json
import re
import struct

from tidegate.llm.common import groups

ODD = re.compile(r"\s\s|[^\S \n]|\0")
KEPT_PIECES = 300_000
GROUP_LETTERS = 2_000_000

_loaded: dict[str, Vocabulary] = {}
_encoders: dict[str, Encoder] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for
    themselves, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def latin(text: str) -> bool:
    """Whether all letters are such that all Unicode versions say the same of them."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Vocabulary:
    """Token bytes, merge ranks and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {
            i: bytes(letters[c] for c in token)
            for token, i in spec["model"]["vocab"].items()
            if token not in self.special
        }
        self.bytes_of |= {i: text.encode() for text, i in self.special.items()}
        ranks = {self.bytes_of[i]: i for i in self.bytes_of if i not in self.special.values()}
        merged = [a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        ids = [spec["model"]["vocab"][token] for token in merged]
        if ids != sorted(ids):
            raise ValueError(f"{path}: ids do not follow the order of the merges")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.merger = tiktoken.Encoding(
            "byte-bpe",
            pat_str=r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s",  # no two white-space characters meet here
            mergeable_ranks=ranks,
            special_tokens={},
        )
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """One per process."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def merge(self, piece: str) -> bytes:
        """Ids of one piece, or of a plain text, as little-endian unsigned 32-bit integers, by exact merging."""
        ids = self.merger.encode_ordinary(piece) if latin(piece) else self.library.encode(piece, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def plain(self, text: str) -> bool:
        """Whether a text can be cut into pieces; if not, it must go to the library whole."""
        return not (ODD.search(text) or self.cut_special and self.cut_special.search(text))

    def pieces(self, text: str) -> list[str] | None:
        """Pieces that can be encoded one by one; None if the text must be encoded whole."""
        if not self.plain(text):
            return None
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Encodes texts of a batch; pieces met before are remembered up to a bound."""

    def __init__(self, vocabulary: Vocabulary, lexicon=None, most: int = KEPT_PIECES):
        self.vocabulary, self.lexicon, self.most = vocabulary, lexicon, most
        self.known: dict[str, bytes] = {"": b""}

    @classmethod
    def plain(cls, path: str) -> Encoder:
        """One per process, without a lexicon: its tasks share what it has learnt, up to the bound."""
        if path not in _encoders:
            _encoders[path] = cls(Vocabulary.load(path))
        return _encoders[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.lexicon is not None:
            return self._by_pieces(texts)
        merge, plain = self.vocabulary.merge, self.vocabulary.plain
        found = [merge(text) if latin(text) and plain(text) else None for text in texts]
        others = iter(self._by_pieces([text for text, ids in zip(texts, found, strict=True) if ids is None]))
        return [next(others) if ids is None else ids for ids in found]

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        return [ids for part in groups(texts, GROUP_LETTERS) for ids in self._encode(texts[part])]

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.vocabulary.pieces(text) for text in texts]
        new = set().union(*(p for p in cut if p is not None)) - self.known.keys()
        if len(new) + len(self.known) > self.most:
            self.known = {"": b""}
            new = set().union(*(p for p in cut if p is not None)) - {""}
        self._learn(list(new))
        get = self.known.__getitem__
        return [
            self.vocabulary.whole(text) if pieces is None else b"".join(map(get, pieces))
            for text, pieces in zip(texts, cut, strict=True)
        ]

    def _learn(self, new: list[str]) -> None:
        found = self.lexicon.look_up(new) if self.lexicon is not None else [None] * len(new)
        merge = self.vocabulary.merge
        self.known.update((w, merge(w) if ids is None else ids) for w, ids in zip(new, found, strict=True))
