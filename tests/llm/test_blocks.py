import io
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from probatio.llm import pfor


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=600), st.booleans())
def test_round_trip(values, narrow):
    ids = np.array([v % 50_000 if narrow else v for v in values], np.uint32)
    data, starts = pfor.encode_blocks(ids)
    assert (pfor.decode_blocks(data, starts, len(ids)) == ids).all()


def test_file_round_trip():
    draw = np.random.default_rng(0)
    docs = [(k, draw.integers(0, 50_000, n).astype(np.uint16)) for k, n in enumerate([0, 1, 127, 128, 129, 5000, 3])]
    stream = io.BytesIO()
    writer = pfor.Writer(stream, section=200)
    for key, ids in docs:
        writer.add(key, ids)
    writer.close()
    stream.seek(0)
    back = []
    for keys, sizes, ids in pfor.read_sections(stream):
        ends = np.cumsum(sizes)
        back += [(k, ids[e - n : e].tolist()) for k, e, n in zip(keys, ends, sizes)]
    assert back == [(k, ids.tolist()) for k, ids in docs]


def test_output_in_id_order(spark):
    from probatio.llm.op10_output import token_output

    rows = [(9, "b c", 1), (3, None, 1), (5, "the quick " * 3000, 1), (3, "dup", 1), (12, "", 1)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = sorted(token_output(spark.createDataFrame(rows, "doc_id long, text string, start int"), path).collect(), key=lambda r: r["start"])
    at = 0
    for r, (key, text, _) in zip(got, sorted(rows, key=lambda x: (x[0], x[1] or ""))):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_output(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def _lengths(draw):
    return [*draw.integers(1, 900, 3000).tolist(), *draw.integers(900, 9000, 300).tolist(), 1, 1, 4095, 4096, 8192, 20_000]


def test_windows_of_the_pool():
    """Every id once, in full windows; most documents whole, gaps filled from shorter tiers."""
    from probatio.llm.op04_pack import TIERS, Pool, route

    draw = np.random.default_rng(5)
    pool, sizes = Pool(TIERS), {}
    for k, n in enumerate(_lengths(draw)):
        sizes[k] = n % 4096
        if n % 4096:
            pool.add(k, 0, np.full(n % 4096, k, np.uint32))
    for low, high in pool.bounds:
        assert {route(n) for n in range(low, high + 1)} == {pool.bounds.index((low, high))}
    seen, windows = [], [*pool.windows(20_000), *pool.windows(0), *pool.rest()]
    mixed = 0
    for k, pieces in windows:
        assert sum(len(ids) for *_, ids in pieces) == TIERS[k]
        mixed += len({route(len(ids)) for *_, ids in pieces}) > 1
        seen += pieces
    left = pool.leftover()
    assert sum(len(ids) for *_, ids in left) < TIERS[-1] and pool.total == 0
    spans: dict = {}
    for doc, start, ids in seen + left:
        spans.setdefault(doc, []).append((start, len(ids)))
    for doc, own in spans.items():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at == sizes[doc]
    assert len(spans) == sum(n > 0 for n in sizes.values())
    assert len(seen) + len(left) < 1.15 * len(spans) and mixed > 0.3 * len(windows)


def test_packing(spark):
    from probatio.llm.op04_pack import pack

    draw = np.random.default_rng(2)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["cat dog " * (n // 2) + "Ünïted !" * (n % 3) for n in (0, 1, 200, 255, 256, 5000, 12000, 300, 700, 3, 4095, 100)] + ["the quick brown fox " * int(n) for n in draw.integers(1, 400, 300)]
    texts += [texts[5], None, "", "new \ua7cb letter"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, part string").repartition(3)
    for pool in (1 << 21, 3000):
        rows = pack(docs, path, pool=pool).collect()
        by_doc: dict = {}
        windows: dict = {}
        for r in rows:
            by_doc.setdefault(r["doc_id"], []).append(r)
            windows.setdefault(r["sequence_id"], []).append(r)
        for k, t in enumerate(texts):
            ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
            at = 0
            for r in sorted(by_doc[k], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids)
                assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(ids)
        assert sorted(windows) == list(range(len(windows)))
        padded = 0
        for own in windows.values():
            at = 0
            for r in sorted(own, key=lambda r: r["offset"]):
                assert r["offset"] == at and r["tier"] == own[0]["tier"] and r["step_group"] == own[0]["step_group"]
                at += r["length"]
            assert at <= own[0]["tier"]
            padded += at < own[0]["tier"]
        assert padded <= 1
        if pool > 3000:
            whole = sum(-(-int(own[0]["doc_tokens"]) // 4096) for own in by_doc.values())
            assert len(rows) < 1.25 * whole
    assert pack(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
