"""Work that does not grow with copies of a text, and plain searches before patterns."""

from functools import reduce

import pyarrow as pa
from pyspark.sql import functions as F

from probatio import snippets, templates
from probatio.config import Settings
from probatio.functions import text as T
from probatio.operators import correctness, facts, security, style
from probatio.operators import rules as R
from probatio.plans import verify as plan

RUN = 'def run_{k}(v0):\n    """Do the work."""\n    for i in range(9):\n        run_{k}(v0)\n    return v0\n'
ODD = [
    *(RUN.format(k=k) for k in (1, 2, 30, 31, 300)), *(s[1] for s in snippets.SNIPPETS), 'x_1 = "x_" "1"\n', 'x_1 = "x_1"\n', "x_1 = x_2\n", "import m_12, b, m_\n", "import m_1, m_\n", "def f_9(:\n",
    'a_7 = "\\x61_7"\n', "", "é_1 = 2\n", "class C_3:\n    def b(self):\n        global C_3\n", 'def f_12(a):\n    "returns f_12"\n    f_12x = open(a)\n', 'secret_12 = "aaaaaaaaaaaaa"\n', "x = 1\n" * 3000,
]


def test_facts_of_texts_that_differ_in_a_number_are_found_once(monkeypatch):
    want = pa.array([facts._clean(facts.facts_of(c)) for c in ODD * 2], facts.FACTS)
    got = facts._facts_array(ODD * 2, facts._Facts(5))
    got.validate(full=True)
    assert got.to_pylist() == want.to_pylist()
    seen, own = [], facts.facts_of
    monkeypatch.setattr(facts, "facts_of", lambda code: seen.append(code) or own(code))
    list(facts._facts([pa.RecordBatch.from_pydict({"code": [RUN.format(k=k) for k in range(100, 1000)]})] * 2))
    assert len(seen) == 1

def test_each_program_is_analysed_once(spark):
    part = spark.range(1, 20 * len(snippets.SNIPPETS) + 1).withColumnRenamed("id", "p_partkey")
    rows = snippets.distinct(part).collect()
    assert {(r["name"], r["code"], r["n"]) for r in rows} == {(*s, 20) for s in snippets.SNIPPETS}


def test_plain_searches_lose_no_match(spark):
    texts = [*templates.RISKY, *map(str.upper, templates.RISKY), "a" * 40, "b" * 39 + "-" + "c" * 20, "x" * 20 + "-" + "y" * 19, "'" + "0f" * 20 + "'", "sk-" + "a1" * 30, "AKIA" + "A" * 16, "ghp_" + "a" * 36, "mysql://u:p@h", "xoxb-1", "eyJa.b.c", "-----BEGIN PRIVATE KEY-----", "plain"]
    code, rules = F.col("code"), [(n, T.pattern(r)) for n, _, r, _ in R.SECRET_RULES] + [(n, r) for n, r, _ in R.ENTROPY_RULES]
    both = [F.struct(security.held(n, r, code).alias("quick"), F.rlike(code, F.lit(r)).alias("own")) for n, r in rules]
    both += [F.struct((T.contains_any(F.lower(code), R.LINE_PARTS[r.name]) & F.rlike(code, F.lit(T.pattern(r.regex, ignore_case=True)))).alias("quick"), F.rlike(code, F.lit(T.pattern(r.regex, ignore_case=True))).alias("own")) for r in R.LINE_RULES]
    rows = spark.createDataFrame([(t,) for t in texts], "code string").select(F.explode(F.array(*both)).alias("b")).select("b.*").collect()
    assert all(r["quick"] == r["own"] for r in rows) and sum(r["own"] for r in rows) > len(R.LINE_RULES)


def test_words_of_weak_crypto_end_at_letters_outside_ascii(spark):
    df = spark.createDataFrame([("éDES",), ("DESÉ",), ("xDES",), ("rc4_",), ("a 3des.",)], "code string")
    assert [r[0] for r in df.select(security.weak_crypto(F.col("code"), True)).collect()] == [True, True, False, False, True]


def test_texts_are_searched_once_for_each_rule(spark):
    steps = {a: " ".join(str(c) for s in plan._agent_steps(a, Settings()) for c in s.values()) for a in ("style", "correctness")}
    assert steps["style"].count("(?dm)") == len(R.SPACING)
    assert steps["correctness"].count("__import__") == 1


LAYOUT = [
    "", " ", "a;b", "a; b", "a \nb", "a\t", "a\x0b\nb", "a\x0c", "a\r\nb", "a,b", "a ,b", "a\n,b", "a+b", "a = b", "a=b", "a\n\n\nb", "a\n \n\t\nb", "a\n\nb", "(a)", "( a", "a )", "[\na", "{ }", "\"a\" 'b'", "'b' \"a\"",
    "'a'", '"a"', "a\u00a0\n", "a\u2028", "\u00e9,\u00e9", "a\x85\n", "\n", "\n\n", "assert x", "assert\nx", "self.assertTrue", "def test_a", "import pytest\nimport unittest", "@pytest.mark", "MyTestCase", "x-1; y", "a*b/c",
]
WEAK = ["hashlib.MD5 (x", "HASHLIB.sha1(", "random.randint(", "Random.Random (", "random", "Besuch, des", "rc4", "3DES", "dE", "hashl\u0130b.md5(", "\u017fde\u017f", ""]


def test_plain_searches_lose_no_match(spark):
    code = F.col("code")
    plain = lambda regexes: sum((F.regexp_count(code, F.lit(r)) for r in regexes), F.lit(0))
    texts = spark.createDataFrame([(a + b,) for a in LAYOUT for b in LAYOUT], "code string")
    rows = texts.select("code", style.spacing_issues(code), plain([T.pattern(r, multiline=True) for r in R.SPACING]), style.test_hints(code), plain(R.TEST_HINTS)).collect()
    assert [r[0] for r in rows if r[1] != r[2] or r[3] != r[4]] == [] and {r[1] > 0 for r in rows} == {r[3] > 0 for r in rows} == {True, False}
    weak = spark.createDataFrame([(w,) for w in WEAK], "code string")
    for whole in (False, True):
        rows = weak.select(security.weak_crypto(code, whole), security.weak_crypto(code, whole, F.lower("code"))).collect()
        assert [r[0] for r in rows] == [r[1] for r in rows] and {r[0] for r in rows} == {True, False}


def test_parts_that_many_rules_need_are_searched_once(spark):
    steps = [str(c) for a in ("correctness", "security", "style") for s in plan._agent_steps(a, Settings()) for c in s.values()]
    shared = [str(c) for c in T.marks(F.col("code")).values()]
    assert len(shared) == len(T.MARKS) and not any(part.isalnum() for part in "".join(T.MARKS))
    for one in "=(;_":
        assert not any(f"contains(code, '{one}')" in s for s in steps) and sum(f"contains(code, '{one}')" in s for s in shared) == 1


def test_shared_marks_lose_no_match(spark):
    code, lower, lines = F.col("code"), F.col("code_lower"), F.col("lines")
    runs = [x + "a1" * 20 + y for x in ("", " ", "\n", "\u00e9", "=", "b ", "c\t") for y in ("", " ", "\n", "\u00e9", "b")] + [" " + "a" * 39 + " ", "a" * 20 + " " + "b" * 20, "\u00e9" * 45, "x" * 20 + "-" + "y" * 20]
    secrets = ["'" + "0f" * 20 + "'", "'" + "0123456789abcdefABCDEF" * 2 + "'", "sk-" + "a1" * 30, "sk-ant-" + "a" * 12, "AKIA" + "A" * 16, "ghp_" + "a" * 36, "gho_" + "a" * 36, "sk_live_" + "a" * 24, "pk_live_" + "b" * 24, "mysql://u:p@h", "xoxb-1", "eyJa.b.c", "-----BEGIN PRIVATE KEY-----"]
    danger = [*R.DANGEROUS_TEXT, "import re", "Import os", "__IMPORT__", "open (", "while True"]
    own = [*templates.RISKY, *map(str.upper, templates.RISKY), *(s[1] for s in snippets.SNIPPETS), *runs, *secrets, *danger, *LAYOUT, *WEAK, *(a + b for a in LAYOUT[:20] for b in LAYOUT[:20])]
    df = T.materialise(plan.with_text(spark.createDataFrame([(t,) for t in own], "code string")), **T.marks(code))
    both = {
        **{r.name: [security.line_rule_issues(r, lines, code, lower, m) for m in (True, False)] for r in R.LINE_RULES},
        "secrets": [security.secret_issues(lines, code, m) for m in (True, False)],
        "entropy": [security.entropy_issues(lines, code, marked=m) for m in (True, False)],
        "spacing": [style.spacing_issues(code, m) for m in (True, False)],
        "hints": [style.test_hints(code, m) for m in (True, False)],
        "danger": [correctness.is_dangerous(code, True), reduce(lambda a, w: a | code.contains(w), R.DANGEROUS_TEXT, F.lit(False))],
        "run": [security.held("aws_secret_key", R.SECRET_RULES[1][2], code, True), F.rlike(code, F.lit(R.SECRET_RULES[1][2]))],
        "weak": [security.weak_crypto(code, code_lower=lower), security.weak_crypto(code)],
    }
    rows = df.select("code", *[F.struct(a.alias("quick"), b.alias("own")).alias(k) for k, (a, b) in both.items()]).collect()
    for k in both:
        assert [r["code"] for r in rows if r[k]["quick"] != r[k]["own"]] == [], k
    assert {k for k in both if len({str(r[k]["own"]) for r in rows}) > 1} == set(both)
