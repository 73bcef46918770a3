"""Exact byte-pair encoding in linear time, and decoding by an offset table.

Encoder: an Aho-Corasick automaton over all tokens finds the longest token at a
start in a pre-token, for those starts that the walk visits. A backtracking walk takes longest matches
and falls back to the next shorter prefix token (or to the previous token)
whenever two neighbours are not *compatible*, i.e. merging by rank would not
leave exactly this pair. The walk visits every end position at most once, so it
is linear in the pre-token, and its result equals merging by rank. Texts are
split into pre-tokens here as the files say; where a text holds a character that
is newer than Python's Unicode tables, the library that reads the same file
normalizes and splits it, so that both know the same letters and digits.

Decoder: all token strings lie in one byte blob; ids gather their spans by an
offset table.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import ahocorasick
import numpy as np
import regex

#: White space as the tokenizer files' patterns see it (no \x1c-\x1f).
SPACE = "\t-\r \x85\xa0  -     　"
CHUNK = regex.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
WORDS = regex.compile(f"[^{SPACE}]+")
ODD = regex.compile("[\x1c-\x1f]")
WIDE_SPACE = regex.compile("[\x0b\x0c\r\x85\xa0  -     　]")
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE + r"\p{L}\p{N}]+")
BYTE_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + "]+")


_assigned: set[str] = set()


def unassigned(text: str) -> bool:
    """Whether ``text`` has a character that Python's Unicode tables do not know: only there may the library's differ."""
    new = set(text) - _assigned
    if any(unicodedata.category(c) == "Cn" for c in new):
        return True
    _assigned.update(new)
    return False


#: Entries of one worker's cache of encoded chunks; a full cache starts anew.
CACHE = 600_000
#: Entries of one worker's cache of encoded pre-tokens.
WORD_CACHE = 900_000
#: Ids that one step of decoding gathers.
DECODE_STEP = 1 << 18


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the files' token strings."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Vocabulary:
    """One tokenizer file: tokens, merges in rank order, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback"):
            raise ValueError(f"{path} is no plain BPE file")
        self.path, self.library = path, None
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.marks = {x[0] for x in self.special}
        self.ids: dict[str, int] = model["vocab"]
        self.text = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.size = max(self.text) + 1
        self.words_only = bool(self.suffix)
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.kind = np.dtype(f"=u{array(self.code).itemsize}")
        #: One letter for each (letter, end of word), so that every token is a plain string.
        self.letters = byte_letters()
        self.closed = {c: chr(0xE000 + b) for b, c in self.letters.items()} if self.suffix else {}
        self._index(model["merges"])

    def _form(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            core = token[: -len(self.suffix)]
            return core[:-1] + self.closed[core[-1]]
        return token

    def _index(self, merges: list) -> None:
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        forms = [(self._form(a), self._form(b)) for a, b in pairs]
        made = {a + b for a, b in forms}
        if len(made) != len(forms):
            raise ValueError("two merges make the same token")
        form_of = {self._form(t): i for t, i in self.ids.items()}
        base = [t for t in form_of if t not in made]
        #: rank: single letters first, then merged tokens in the order of their merges.
        order = base + [a + b for a, b in forms]
        self.rank = {t: k for k, t in enumerate(order)}
        self.id_of_rank = [form_of[t] for t in order]
        self.length = [len(t) for t in order]
        self.split = [(k, k) for k in range(len(base))] + [(self.rank[a], self.rank[b]) for a, b in forms]
        self.merged = {(self.rank[a], self.rank[b]): self.rank[a + b] for a, b in forms}
        self.shorter = [-1] * len(order)
        for t, k in self.rank.items():
            for n in range(len(t) - 1, 0, -1):
                if (x := self.rank.get(t[:n])) is not None:
                    self.shorter[k] = x
                    break
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, k in self.rank.items():
            self.automaton.add_word(t, k)
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' strings by rank ends in exactly this pair."""
        merged, split = self.merged, self.split
        limit = 1 << 60
        while True:
            if merged.get((left, right), limit) < limit:
                return False
            if left > right:
                limit = left
                left = split[left][1]
                if left == limit:
                    limit = right + 1
                    right = split[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit = right + 1
                right = split[right][0]
                if right + 1 == limit:
                    limit = left
                    left = split[left][1]
                    if left == limit:
                        return True

    def encode_form(self, word: str) -> list[int]:
        """Ranks of one pre-token's tokens."""
        if (whole := self.rank.get(word)) is not None:
            return [whole]
        length, shorter, known, matches = self.length, self.shorter, self.compatible, self.automaton.iter_long
        greedy = [k for _, k in matches(word)]
        out: list[int] = []
        at, last = 0, -1
        for token in greedy:
            if last >= 0 and not known.get(last << 20 | token):
                break
            out.append(token)
            at += length[token]
            last = token
        else:
            return out
        n = len(word)
        longest = [-1] * n
        start = 0
        for k in greedy:
            longest[start] = k
            start += length[k]
        dead = bytearray(n + 1)
        while True:
            last = out[-1] if out else -1
            while True:
                end = at + length[token]
                if not dead[end]:
                    if last < 0:
                        fits = True
                    else:
                        key = last << 20 | token
                        fits = known.get(key)
                        if fits is None:
                            if len(known) >= 1 << 19:
                                known.clear()
                            fits = known[key] = self._fits(last, token)
                    if fits:
                        out.append(token)
                        at = end
                        break
                token = shorter[token]
                if token < 0:
                    dead[at] = 1
                    token = out.pop()
                    at -= length[token]
                    last = out[-1] if out else -1
                    dead[at + length[token]] = 1
            if at == n:
                return out
            token = longest[at]
            if token < 0:
                for end, k in matches(word, at):
                    start = end - length[k] + 1
                    if longest[start] >= 0:
                        break
                    longest[start] = k
                token = longest[at]

    def pre_tokens(self, text: str) -> list[str]:
        if self.words_only:
            # Letters alone, or letters and one mark, need no pattern.
            if text.isalpha() and text.isascii():
                return [text.lower()]
            text = (text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower()
            if text.isalpha():
                return [text]
            if text[-1:] in (".", ",") and text[:-1].isalpha():
                return [text[:-1], text[-1]]
            return WORD_PATTERN.findall(text)
        head, body = text[:1], text[1:]
        if body.isalpha():
            if head == " " or head.isalpha():
                return [text]
            if head == "\n":
                return [head, body]
        elif body[-1:] in (".", ",") and body[:-1].isalpha():
            if head == " " or head.isalpha():
                return [text[:-1], text[-1]]
            if head == "\n":
                return [head, body[:-1], text[-1]]
        return BYTE_PATTERN.findall(text)

    def pieces(self, text: str) -> list:
        """``text`` cut at special tokens: strings, and ids of the special ones."""
        if self.special and any(s in text for s in self.special):
            found = regex.split("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")", text)
            return [self.special.get(x, x) for x in found if x]
        return [text]

    def encode(self, text: str) -> list[int]:
        """Ids of ``text`` by backtracking, special strings included."""
        return np.frombuffer(self.encode_bytes(text), self.kind).tolist()

    def encode_bytes(self, text: str) -> bytes:
        """Ids of ``text`` as ``kind``, through a bounded cache of pre-tokens."""
        words, out = self.words, []
        odd = not text.isascii() and unassigned(text)
        for part in self.pieces(text) if any(c in text for c in self.marks) else (text,):
            if isinstance(part, int):
                out.append(array(self.code, (part,)).tobytes())
                continue
            if odd:
                out += [self.encode_letters(x) for x in self.library_letters(part)]
                continue
            for word in self.pre_tokens(part):
                if (ids := words.get(word)) is None:
                    if len(words) >= WORD_CACHE:
                        words.clear()
                    ids = words[word] = self.encode_word(word)
                out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def library_letters(self, text: str) -> list[str]:
        """Pre-tokens as byte letters, as the library normalizes and splits ``text``."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        if self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        return [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode_word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.encode_letters(word)
        letters = self.letters
        return self.encode_letters("".join([letters[b] for b in word.encode("utf-8", "surrogatepass")]))

    def encode_letters(self, form: str) -> bytes:
        id_of_rank = self.id_of_rank
        if self.suffix:
            form = form[:-1] + self.closed[form[-1]]
        return array(self.code, [id_of_rank[k] for k in self.encode_form(form)]).tobytes()

    def chunks(self, text: str) -> list[str]:
        """Parts of ``text`` that encode independently, white space in front."""
        if self.words_only:
            return WORDS.findall(text) if ODD.search(text) else text.split()
        if "\x00" in text or "  " in text or "\n\n" in text or "\n " in text or " \n" in text or "\t" in text or WIDE_SPACE.search(text):
            return CHUNK.findall(text)
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00")

    def offset_table(self, between: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Blob, starts and lengths of each id's bytes, with ``between`` after each."""
        back = {c: b for b, c in self.letters.items()}
        blob, starts, sizes = bytearray(), np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        for i in range(self.size):
            token = self.text.get(i, "")
            if self.suffix or i in self.special.values():
                data = token.encode()
            else:
                data = bytes(back[c] for c in token)
            starts[i], sizes[i] = len(blob), len(data) + len(between)
            blob += data + between
        return np.frombuffer(bytes(blob), np.uint8), starts, sizes


class Cached:
    """Encodes whole texts through a bounded cache of chunks; ``encode`` gives new ones' ids."""

    def __init__(self, vocabulary: Vocabulary, encode=None, limit: int = CACHE):
        self.vocabulary, self.limit, self.kind = vocabulary, limit, vocabulary.kind
        self.encode = encode or vocabulary.encode_bytes
        self.known = _Chunks(self.encode)

    def encode_batch(self, texts: list[str]):
        """One array of ids for each text, in order."""
        for text in texts:
            if len(self.known) > self.limit:
                self.known.clear()
            yield np.frombuffer(b"".join(map(self.known.__getitem__, self.vocabulary.chunks(text))), self.kind)


class _Chunks(dict):
    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = self.encode(chunk)
        return ids


class Decoder:
    """Gathers the bytes of ids by an offset table."""

    def __init__(self, vocabulary: Vocabulary):
        self.between = b" " if vocabulary.suffix else b""
        self.blob, self.starts, self.sizes = vocabulary.offset_table(self.between)

    def decode(self, ids: np.ndarray) -> bytes:
        out = []
        for at in range(0, len(ids), DECODE_STEP):
            part = ids[at : at + DECODE_STEP].astype(np.int64)
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            where = np.repeat(self.starts[part] - (ends - sizes), sizes) + np.arange(ends[-1])
            out.append(self.blob[where].tobytes())
        data = b"".join(out)
        return data[: -len(self.between)] if self.between and data else data


_made: dict = {}


def cached_encoder(path: str) -> Cached:
    """This worker's encoder for a tokenizer file, made once."""
    if path not in _made:
        _made[path] = Cached(Vocabulary(path))
    return _made[path]


def decoder(path: str) -> Decoder:
    if ("decoder", path) not in _made:
        _made["decoder", path] = Decoder(cached_encoder(path).vocabulary)
    return _made["decoder", path]
