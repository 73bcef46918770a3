import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

ROWS = [
    (1, "Shared line that is long enough to be counted as repeated\nown one", "en"),
    (2, "  shared LINE that is long enough to be counted as repeated\t\nsecond", "en"),
    (3, "Shared line that is long enough to be counted as repeated\nShared line that is long enough to be counted as repeated", "de"),
    (4, None, "en"),
    (5, "", None),
    (6, "short\nshort\nshort", "en"),
    (7, "x\nShared line that is long enough to be counted as repeated\ny\nz", "en"),
    (8, "Shared line that is long enough to be counted as repeated", "fr"),
    (8, "Shared line that is long enough to be counted as repeated", "fr"),
    (9, "Ärger mit dieser langen Zeile, die in fünf Texten steht\nq", "de"),
]


def _brute_lines(rows):
    blank = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(blank))
    holders = defaultdict(set)
    for d, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(d)
    out = []
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 5 and max(holders[key(x)]) != d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup(spark):
    from probatio.llm.op02_lines import dedup_lines

    df = spark.createDataFrame(ROWS, "doc_id long, text string, pos string")
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in dedup_lines(df).collect())
    assert got == _brute_lines(ROWS)
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_quality_statistics(spark):
    from probatio.llm.op06_rules import fit, judge, with_statistics

    texts = [None, "", " ", "a b c a b c", "a b c d e a b c", "x " * 300, "# $ | a\n\n# $ | a\nq", "a a a a", "é é b"]
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for r in with_statistics(df.drop("n_words")).collect():
        t = texts[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = Counter(windows)
        covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert fit(df, labels) == []
    assert judge(df, []).where("kept").count() == 0


def test_decision_list_is_learned():
    from probatio.llm.op06_rules import RATES, learn

    rows = [({r: 0.0 for r in RATES} | {"symbol_rate": k / 100, "n_words": 100.0}, k >= 50) for k in range(100)] * 2
    rules = learn(rows)
    assert rules and rules[0][0].rate == "symbol_rate" and 0.48 <= rules[0][0].threshold <= 0.52
    assert learn([]) == [] and learn([(rows[0][0], True)]) == []


def _slow_print(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    if not w:
        return 0
    shingles = [w] if len(w) < 3 else [w[i : i + 3] for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(spark):
    from probatio.llm import op07_simhash as m

    draw = np.random.default_rng(5)
    words = [f"w{k}" for k in range(50)]
    base = [" ".join(draw.choice(words, 200)) for _ in range(30)]
    texts = [None, "", " \t", "A b", "a B c"] + base + [b + " extra" for b in base[:10]] + base[:3]
    rows = list(enumerate(texts))
    prints = [_slow_print(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, p in enumerate(prints):
            for j, q in enumerate(prints):
                if (p ^ q).bit_count() <= 3:
                    root[i] = min(root[i], root[j])
    for cell_rows in (4096, 3):
        got = m.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), cell_rows=cell_rows).collect()
        assert sorted((r["doc_id"], r["fp"] & (2**64 - 1), r["component"]) for r in got) == [(k, prints[k], root[k]) for k in range(len(texts))]
    assert m.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_manhattan_is_a_lower_bound():
    from probatio.llm import op07_simhash as m

    draw = np.random.default_rng(1)
    a, b = (draw.integers(0, 2**63, 500, dtype=np.uint64) for _ in range(2))
    counts = lambda x: [((int(x) >> 2 * k) & 3).bit_count() for k in range(32)]
    got = m.manhattan(m.embed(a), m.embed(b))
    for k in range(500):
        want = sum(abs(p - q) for p, q in zip(counts(a[k]), counts(b[k])))
        assert got[k] == want <= (int(a[k]) ^ int(b[k])).bit_count()


def test_components(spark):
    from probatio.llm.components import components

    chain = [(k, k + 1) for k in range(60)] + [(100, 105), (105, 103), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 105: 100, 103: 100}


def test_language_mixture(spark):
    from probatio.llm import op01_language as m

    texts = {"en": ["the house and the garden with some flowers there"] * 3, "de": ["das Haus und der Garten mit einigen Blumen dort"] * 3}
    model = m.train(texts)
    assert m.predict(model, "the flowers and the garden")[0] == "en"
    lang, score, shares = m.predict(model, "der Garten und das Haus " * 20 + "the house and the garden " * 5)
    assert lang == "de" and 0 < score < 1 and set(shares) == {"de", "en"}
    assert m.predict(model, None)[:2] == ("und", 0.0) and m.predict(model, "12 !?")[:2] == ("und", 0.0)
    rows = [(k, texts[lang][0], lang, lang) for k, lang in enumerate(["en", "de"] * 20)] + [(50, None, "en", ""), (51, "7", None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in m.identify(df, m.fit(df)).collect()}
    assert all(got[k]["lang_pred"] == lang for k, _, lang, _ in rows[:40])
    assert got[50]["lang_pred"] == got[51]["lang_pred"] == "und"
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert m.identify(empty, m.fit(empty)).count() == 0


def test_language_of_long_texts_alone(spark):
    from probatio.llm import op01_language as m

    short, long = "the house and the garden with some flowers there", "das Haus und der Garten mit einigen Blumen dort " * 40
    df = spark.createDataFrame([(k, t, lang) for k in range(12) for t, lang in ((short, "en"), (long, "de"))], "doc_id long, text string, lang string")
    model = m.fit(df, max_docs=3, max_chars=100)
    assert [*model.langs] == ["de", "en"] and m.predict(model, long)[0] == "de" and m.predict(model, short)[0] == "en"


def test_held_out_accuracy(spark):
    from probatio.llm.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in QUERIES["op1_language_id"](spark, sf).collect() if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.9 * len(held)


def test_token_counts(spark):
    from probatio.llm.op05_counts import Pieces, token_counts

    import public_tokenizers

    pieces = Pieces({"▁": -5.0, "a": -3.0, "b": -3.0, "ab": -4.0, "▁a": -4.0, "ba": -4.5, "▁ab": -9.0})

    def brute(word):
        word = "▁" + word
        best = [(0.0, 0)] + [None] * len(word)
        for e in range(1, len(word) + 1):
            options = [(best[s][0] + pieces.scores[word[s:e]], best[s][1] - 1) for s in range(e) if word[s:e] in pieces.scores]
            options.append((best[e - 1][0] + pieces.unknown, best[e - 1][1] - len(word[e - 1].encode())))
            best[e] = max(options)
        return -best[-1][1]

    words = ["", "a", "ab", "aba", "abab", "bab", "c", "aéb", "abcab"]
    assert pieces.terminal_counts(words) == {w: brute(w) for w in words}
    df = spark.createDataFrame([(1, "the cat the cat"), (2, None), (3, " "), (4, "y" * 3000)], "doc_id long, text string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    each = Pieces.load(path).terminal_counts(["the", "cat"])
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts(df, path).collect()}
    assert each["the"] == 1 and got[1] == (4, 2 * sum(each.values())) and got[2] == got[3] == (0, 0) and got[4][0] == 1


def test_top_k(spark):
    from probatio.llm.op09_topk import top_k

    draw = np.random.default_rng(2)
    rows = [(k, [float(x) for x in draw.normal(size=12)]) for k in range(400)] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 12), (503, [float("inf")] * 12), (600, [0.5] * 12), (601, [0.5] * 12), (602, [0.5] * 5), (603, [])]
    q = {k: np.floor(1024 * np.array(v)) for k, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    pad = {k: np.pad(v, (0, 12 - len(v))) for k, v in q.items()}
    want = []
    for a in (k for k in pad if k % 100 == 0):
        best = sorted((-int(pad[a] @ pad[b]), b) for b in pad if b != a)[:10]
        want += [(a, r + 1, b, -s) for r, (s, b) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (1 << 26, 200):
        got = top_k(df, block_bytes=block, step=2).collect()
        assert sorted(tuple(r) for r in got) == sorted(want)
    # Rows that repeat a query id: the invalid one is never the query.
    twice = [(0, None, 1), (0, [1.0], 1), (0, [0.5], 2), (1, [2.0], 3), (1, [2.0], 3), (2, [], 4), (None, [9.0], 5), (3, [1e300], 6)]
    got = top_k(spark.createDataFrame(twice, "vec_id long, embedding array<double>, score int"), k=3).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 3, (1 << 63) - 1), (0, 2, 1, 1024 * 2048), (0, 3, 1, 1024 * 2048)]
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_few_pairs_survive_the_bounds():
    """On the table's vectors, and with the same results as all scores."""
    import pyarrow.parquet as pq

    from probatio.llm import op09_topk as m

    read = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids = np.asarray(read.column("vec_id"))
    use, rows = m.quantized(read.column("embedding").combine_chunks())
    ids = ids[use]
    asked = ids % 20 == 0
    turn = m.transform(rows)
    assert np.allclose(turn @ turn.T, np.eye(len(turn)))
    start = m.first_scores(ids[asked], rows[asked], ids, rows, 10, 512)
    queries, best = m.Queries(ids[asked], rows[asked], turn), m.Best(start, 10)
    computed = 0
    for at in range(0, len(ids), 250):
        part = rows[at : at + 250]
        computed += m.scan(best, queries, ids[at : at + 250], part, m.statistics(part @ turn), np.linalg.norm(part, axis=1))
    # Vectors of almost equal energy in all 64 directions: the two-component resolution decides.
    assert computed < 0.4 * asked.sum() * len(ids)
    scores = (rows[asked] @ rows.T).astype(np.int64)
    for q, own in enumerate(ids[asked]):
        order = [k for k in np.lexsort((ids, -scores[q])) if ids[k] != own][:10]
        assert best.ids[q].tolist() == ids[order].tolist() and best.scores[q].tolist() == scores[q][order].tolist()


def test_html(spark):
    from probatio.llm.html_tree import main_text
    from probatio.llm.op08_html import extract

    page = (
        "<html><head><title>T</title><script>var a='<p>';</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='cookie-notice'><p>We use cookies, as you know, on this site.</p></div>"
        "<article><h1>Head &amp; title</h1><p>First,   one of the paragraphs, with <b>bold</b> text<br>and a break.<p>Second &#233;.</p><ul><li>item</ul></article>"
        "<div id=comments><p>Nice article, very nice, really, I liked reading it so much.</p></div><aside>side</aside><form><p>Subscribe, please, to the letter that we send.</p></form><footer>foot</footer>"
    )
    assert main_text(page) == "Head & title\nFirst, one of the paragraphs, with bold text and a break.\nSecond é.\nitem"
    assert main_text(None) == main_text("") == main_text("<p>") == ""
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    df = spark.createDataFrame([(1, "u", page, 3), (2, None, None, 4)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in extract(df).collect()}
    assert got[1]["n_chars"] == len(got[1]["text"]) and (got[2]["text"], got[2]["n_chars"]) == ("", 0)
