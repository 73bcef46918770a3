import numpy as np

from probatio.llm import op07_similar as m


def _shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def _brute(rows, similarity=0.8):
    sets = [_shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    moved = True
    while moved:
        moved = False
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if root[i] != root[j] and len(x & y) >= similarity * len(x | y):
                    root[i] = root[j] = min(root[i], root[j])
                    moved = True
    return [rows[k][0] for k in root]


def _rows():
    draw = np.random.default_rng(7)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for base in range(12):
        text = [*draw.choice(words, 60 + 40 * base)]
        for edits in (0, 0, 1, 2, 3, 5, 8, 40):
            own = list(text)
            for at in draw.integers(0, len(own), edits):
                own[at] = f"new{len(rows)}"
            rows.append((len(rows), " ".join(own)))
    return rows + [(900, None), (901, ""), (902, " \t"), (903, "One two"), (904, "one  TWO")]


def test_groups_equal_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for cell_rows in (4096, 3):
        got = {r["doc_id"]: r["component"] for r in m.similar_groups(df, cell_rows=cell_rows).collect()}
        assert [got[k] for k, _ in rows] == _brute(rows)
    kept = {r["doc_id"] for r in m.leaders(df).collect()}
    assert kept == set(_brute(rows))


def test_nulls_ties_and_clashing_names(spark):
    rows = [(1, None, 1), (2, "", 2), (None, "a b", 3), (None, "a b", 3), (None, "q b", 4), (5, "A  b", 5), (5, "A  b", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = sorted((r["doc_id"] or 0, r["component"] or 0) for r in m.similar_groups(df).collect())
    assert got == [(0, 0), (0, 5), (0, 5), (1, 1), (2, 1), (5, 5), (5, 5)]
    kept = m.leaders(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, "q b"), (1, ""), (5, "A  b")]
    assert m.leaders(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_are_read_whole():
    long = " ".join(f"w{k}" for k in range(20_000))
    assert len(m.shingle_set(long, 5)) == 19_996
    assert (m.parts_of(m.shingle_set(long, 5)) == m.parts_of(m.shingle_set(long + " end", 5))).sum() > 60


#: Seeds of pairs at similarity 0.8 that no fingerprint brings together.
MISSED = [45, 197, 206, 231, 255, 279, 483, 692, 710, 1474]


def test_pairs_that_fingerprints_miss(spark):
    rows = []
    for seed in MISSED:
        words = [f"s{seed}w{k}" for k in range(94)]
        rows += [(seed, " ".join(words)), (seed + 10_000, " ".join(words[:-10] + [f"s{seed}e{k}" for k in range(10)]))]
        # One shingle less in common is not enough.
        rows.append((seed + 20_000, " ".join([f"s{seed}f{k}" for k in range(11)] + words[11:])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in m.similar_groups(df).collect()}
    assert [got[k] for k, _ in rows] == _brute(rows)
    assert all(got[k + 10_000] == k and got[k + 20_000] == k + 20_000 for k in MISSED)


def test_no_bound_rules_out_a_similar_pair():
    draw = np.random.default_rng(3)
    for n in (1, 2, 4, 5, 9, 10, 90, 700, 3000):
        frequent = np.sort(draw.integers(0, 1 << 63, 50, dtype=np.uint64))
        for _ in range(40):
            pool = np.concatenate([draw.integers(0, 1 << 63, 2 * n, dtype=np.uint64), frequent[:40]])
            a = np.unique(draw.choice(pool, n))
            out = int(draw.integers(0, len(a) // 5 + 1))
            b = np.unique(np.concatenate([draw.permutation(a)[out:], draw.integers(0, 1 << 63, int(draw.integers(0, len(a) // 8 + 1)), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if common < 0.8 * (len(a) + len(b) - common):
                continue
            assert len(np.intersect1d(m.prefix(a, frequent, 0.8), m.prefix(b, frequent, 0.8)))
            rows = [np.array([7, 7]), np.array([2, 1]), np.array([1, 2]), np.array([len(a), len(b)]), np.stack([m.parity(a), m.parity(b)]).view(np.uint64)]
            assert [x.tolist() for x in m.meet(*rows, 0.8)] == [[1], [2]]
            assert [len(x) for x in m.meet(*rows, 0.8, np.array([4, 4]))] == [0, 0]
            apart = m.parities_apart(m.wide_parity(a).tobytes(), m.wide_parity(b).tobytes())
            assert apart <= len(np.setxor1d(a, b)) <= 0.2 / 1.8 * (len(a) + len(b)) + 1e-6


def test_wide_parities_tell_unlike_sets_apart():
    draw = np.random.default_rng(5)
    for n in (600, 5000, 40_000):
        a = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
        for out, over in ((0.3, True), (0.05, False)):
            b = np.unique(np.concatenate([a[int(out * n) :], draw.integers(0, 1 << 63, int(out * n), dtype=np.uint64)]))
            apart = m.parities_apart(m.wide_parity(a).tobytes(), m.wide_parity(b).tobytes())
            assert (apart > 0.2 / 1.8 * (len(a) + len(b))) == over
    # Widths of one set's parities agree: wide ones fold to narrow ones.
    assert m.parities_apart(m.parity(a, 1 << 16).tobytes(), m.parity(a).tobytes()) == 0


def test_marks_lose_no_key(spark):
    import pyarrow as pa

    draw = np.random.default_rng(4)
    keys = [*draw.integers(-(1 << 63), 1 << 63, 3000).tolist(), 0, 1, -1, m.MARKS - 1, m.MARKS, 32767, 32768, 32769]

    class Shipped:
        value = m.marked(spark.createDataFrame([(k,) for k in keys], "row long"), "row")

    def passed(rows):
        return sum(b.num_rows for b in m._asked([pa.RecordBatch.from_arrays([pa.array(rows, pa.int64())], names=["row"])], Shipped))

    assert len(Shipped.value) == m.MARKS // 8 and passed(keys) == len(keys)
    assert passed(draw.integers(-(1 << 63), 1 << 63, 3000).tolist()) < 10
