import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from probatio.llm.bpe import Cached, Decoder, Vocabulary
from probatio.llm.rapid import Rapid

ODD = [
    "", " ", "  a  b ", "<|endoftext|>x<|endoftext|>", "I'm Don't \n\n x\t\ty \x1c a\x1fb", "ΑΣ İstanbul ß", "a\xa0\xa0b 　 c", "1234 ½", "...!!! '' 's'S", "\r\n \r\n",
    "a <|startoftext|> b  <|endoftext|>  ", "x" * 5000,
]


def _texts():
    draw = random.Random(3)
    letters = "ab '\n\t \x1c\x85\xa0 éßΣ1½<|endoftext|>́.,s"
    return ODD + ["".join(draw.choice(letters) for _ in range(40)) for _ in range(800)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_both_encoders_equal_the_library(name):
    path = public_tokenizers.path(name)
    library, own, rapid = Tokenizer.from_file(path), Cached(Vocabulary(path), limit=50), Rapid(path)
    decoder = Decoder(own.vocabulary)
    for text in _texts():
        want = library.encode(text, add_special_tokens=False).ids
        got = next(own.encode_batch([text]))
        assert got.tolist() == want, repr(text)
        assert rapid.encode(text).tolist() == want, repr(text)
        assert decoder.decode(got).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_tokenize_whole_table(spark):
    from probatio.llm.op03_tokenize import tokenize

    rows = [(1, "the cat", "x"), (1, "the cat", "x"), (2, None, "y"), (3, "", "z"), (None, "a" * 20000, None)]
    path = public_tokenizers.path("word_bpe_49k.json")
    got = tokenize(spark.createDataFrame(rows, "id int, text string, n_tokens string"), path, id_col="id", keep_ids=True).collect()
    assert len(got) == 5 and sum(r["n_tokens"] == 0 for r in got) == 2
    for r in got:
        assert len(r["ids"]) == r["n_tokens"] and np.array(r["ids"]).dtype.kind in "if"
    empty = spark.createDataFrame([], "id int, text string")
    assert tokenize(empty, path, id_col="id").count() == 0


def _every_code_point():
    """Texts that hold each code point between letters; known and unknown ones apart.

    Planes without any assigned letter (4 to 13, private use) are one text each.
    """
    groups: dict = {}
    for cp in (*range(0xD800), *range(0xE000, 0x40000), *range(0x40000, 0xE0000, 0x400), *range(0xE0000, 0xE0400), *range(0xF0000, 0x110000, 0x400)):
        groups.setdefault((cp >> 8, unicodedata.category(chr(cp)) == "Cn"), []).append(chr(cp))
    return [" ".join(f"a{c}b" for c in own) for own in groups.values()]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_code_point_equals_the_library(name):
    path = public_tokenizers.path(name)
    library, own, rapid = Tokenizer.from_file(path), Cached(Vocabulary(path)), Rapid(path)
    texts = _every_code_point()
    for at in range(0, len(texts), 1000):
        part = texts[at : at + 1000]
        for text, want, got in zip(part, library.encode_batch(part, add_special_tokens=False), own.encode_batch(part), strict=True):
            assert got.tolist() == want.ids, repr(text)
            assert rapid.encode(text).tolist() == want.ids, repr(text)
