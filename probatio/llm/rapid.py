"""Whole texts to ids of a tokenizer file, by tiktoken's merge loop.

Byte-level files map to merge ranks as they are. In a file with word ends the
last letter of a pre-token is another symbol than the same letter elsewhere; it
is spelled as the letter and a blank. Merging a letter with the blank comes
before all other merges, so what follows is the file's own merging, token for
token. Blanks never lie inside its pre-tokens.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import regex
import tiktoken

from .bpe import SPACE, Vocabulary, byte_letters, unassigned

ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _class(category: str, top: int) -> str:
    """The category's characters below ``top`` as ranges for ``re``."""
    one, spans = regex.compile(rf"\p{{{category}}}+"), []
    for m in one.finditer("".join(map(chr, [*range(0xD800), *range(0xE000, top)]))):
        run = m[0]
        start = run[0]
        for a, b in zip(run, run[1:] + "\0", strict=True):
            if ord(b) != ord(a) + 1:
                spans.append((start, a))
                start = b
    return "".join(f"{re.escape(a)}-{re.escape(b)}" if a != b else re.escape(a) for a, b in spans)


class Rapid:
    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        back = {c: b for b, c in byte_letters().items()}
        ranks: dict[bytes, int] = {}
        pattern = BYTE_PATTERN
        if v.suffix:
            pattern = "[^ ]+ "
            for b in range(256):
                ranks[bytes([b])] = b
            for b in range(256):
                if b != 32:
                    ranks[bytes([b, 32])] = len(ranks)
            # Classes within the basic plane compile to a table, which is much faster.
            self.words, self.wide_words = (
                re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+") for letters, numbers in ((_class("L", top), _class("N", top)) for top in (0x10000, 0x110000))
            )
        self.id_of = np.zeros(v.size + 600, np.uint32)
        for token in sorted(v.ids, key=lambda t: v.rank[v._form(t)]):
            closed = v.suffix and token.endswith(v.suffix) and len(token) > len(v.suffix)
            data = bytes(back[c] for c in (token[: -len(v.suffix)] if closed else token)) + (b" " if closed else b"")
            self.id_of[ranks.setdefault(data, len(ranks))] = v.ids[token]
        self.id_of = self.id_of.astype(v.kind)
        self.core = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> np.ndarray:
        if self.vocabulary.suffix:
            if text.isascii():
                found = ASCII_WORDS.findall(text.lower())
            else:
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
                basic = len(text.encode("utf-16-le")) == 2 * len(text)
                found = (self.words if basic else self.wide_words).findall(text)
            text = " ".join(found) + " " if found else ""
        return self.id_of[np.array(self.core.encode_ordinary(text), np.int32)]

    def encode(self, text: str) -> np.ndarray:
        v = self.vocabulary
        if not text.isascii() and unassigned(text):
            # Characters newer than Python's tables: see ``bpe``.
            return np.frombuffer(v.encode_bytes(text), v.kind)
        if not any(c in text for c in v.marks):
            return self._plain(text)
        parts = [np.array([p], v.kind) if isinstance(p, int) else self._plain(p) for p in v.pieces(text)]
        return np.concatenate(parts) if parts else np.zeros(0, v.kind)

    def encode_batch(self, texts: list[str]):
        return map(self.encode, texts)


_made: dict[str, Rapid] = {}


def encoder(path: str) -> Rapid:
    """This worker's encoder for a tokenizer file, made once."""
    if path not in _made:
        _made[path] = Rapid(path)
    return _made[path]
