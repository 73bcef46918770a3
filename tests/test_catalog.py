"""Whole results against counts of collected reports, and the parts that SQL can express."""

from collections import Counter, defaultdict
from math import sqrt
from statistics import fmean

import duckdb
import pytest
from pyspark.sql import functions as F

from probatio import catalog, templates
from probatio.config import Settings
from probatio.model import AGENTS
from probatio.plans import verify as plan

SF = "/root/testdata/sf0.001"
SLOW = "def f(rows, a, b):\n    out = ''\n    for x in rows:\n        for y in rows:\n            for z in rows:\n                out = out + str(x)\n    return out\n"
BAD = "import os, pickle, hashlib\ndef f(a, user):\n    try:\n        x = eval(a)\n    except:\n        pass\n    password = \"abcdefghijkl\"\n    return hashlib.md5(x)\n"
CODES = [BAD, SLOW, "x = 1\n", BAD + SLOW, "def g(:\n", 'import pickle\nkey = pickle.loads(open("a"))\n']


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(k, c, "en", f"s{k % 2}", len(c)) for k, c in enumerate(CODES)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(len(CODES))], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def reported(spark, tables):
    settings = Settings(agents=("security", "performance", "style"))
    return plan.with_report(plan.analyse(catalog.documents(spark, tables), settings), settings.agents, settings).collect()


def test_issue_types_are_whole(spark, tables, reported):
    want = Counter((i["type"], i["severity"]) for r in reported for i in r["issues"])
    got = catalog.QUERIES["issue_types"](spark, tables).collect()
    assert {(r["type"], s): r[s] for r in got for s in ("low", "medium", "high", "critical") if r[s]} == want
    assert {r["type"]: r["n"] for r in got} == Counter(t for t, s in want.elements())
    assert {"secret", "security_cascade", "compliance_failure", "compound_vulnerability"} & {r["type"] for r in got}


def test_false_positive_types_are_whole(spark, tables, reported):
    want = defaultdict(set)
    for r in reported:
        if r["verdict"] == "FAIL":
            for i in r["issues"]:
                want[i["type"]].add(r["sample_id"])
    got = {r["type"]: r["n_docs"] for r in catalog.QUERIES["false_positive_types"](spark, tables).collect()}
    assert got == {t: len(d) for t, d in want.items()} and len(got) > 1


def test_agent_correlation_has_every_pair(spark, tables):
    rows = catalog.analysed(spark, tables).select(*[f"{a}_score" for a in AGENTS]).collect()
    got = catalog.QUERIES["agent_correlation"](spark, tables).first().asDict()
    assert len(got) == 6 and got["correctness_performance"] is not None
    for pair, rho in got.items():
        x, y = ([r[f"{a}_score"] for r in rows] for a in pair.split("_"))
        mx, my = fmean(x), fmean(y)
        spread = sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))
        assert rho == (pytest.approx(sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / spread, abs=1e-5) if spread else None)


def test_tree_issues_are_whole(spark):
    rows = plan.analyse(catalog._templated(spark, SF)).select(*[F.transform(f"{a}_issues", lambda i: F.struct(i["type"].alias("type"), i["severity"].alias("severity"))).alias(a) for a in AGENTS]).collect()
    want = Counter((a, i["type"], i["severity"]) for r in rows for a in AGENTS for i in r[a])
    got = {(r["agent"], r["type"], r["severity"]): r["n"] for r in catalog.QUERIES["tree_issues"](spark, SF).collect()}
    assert got == want and not {f"{a}.{t}" for a, t, _ in got} <= set(templates.ISSUE_TYPES)


SHARED = {
    "issue_types": "type NOT IN ('secret', 'security_cascade', 'compliance_failure', 'compound_vulnerability')",
    "false_positive_types": "type = 'secret'",
    "agent_correlation": "true",
    "tree_issues": "concat_ws('.', agent, type) IN ('" + "', '".join(templates.ISSUE_TYPES) + "')",
}


@pytest.mark.parametrize("name", sorted(catalog.PARTS))
def test_parts_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    cursor = con.execute(catalog.PARTS[name])
    names = [d[0] for d in cursor.description]
    norm = lambda x: round(float(x), 4) if isinstance(x, float) else x
    got = [tuple(norm(r[c]) for c in names) for r in catalog.QUERIES[name](spark, SF).where(SHARED[name]).collect()]
    assert sorted(got, key=repr) == sorted((tuple(map(norm, r)) for r in cursor.fetchall()), key=repr)
