"""Code and patches made from table columns, with closed forms of what rules must find in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatio.catalog_sql import any_of, quoted
from probatio.operators import rules as R


def programs(part: DataFrame) -> DataFrame:
    """One function for each part: siblings, loops, parameters, docstring and more by ``p_size``."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    names = F.array(*[F.lit(f"v{k}") for k in range(9)])
    params = F.array_join(F.slice(names, F.lit(1), (size % 10).cast("int")), ", ")
    loops = F.concat(*[F.when(size % 4 > k, F.lit("    " * (k + 1) + f"for {name} in range(9):\n")).otherwise("") for k, name in enumerate("ijk")])
    body = F.when(size % 4 > 0, F.concat(F.repeat(F.lit("    "), (size % 4 + 1).cast("int")), F.lit("total = total + 8\n"))).otherwise("")
    code = F.concat(
        F.when(size % 4 == 0, "import pickle\n").otherwise(""),
        F.lit("def run_"), key, F.lit("("), params, F.lit("):\n"),
        F.when(size % 2 == 0, '    """Do the work."""\n').otherwise(""),
        F.lit("    total = 3\n"),
        F.repeat(F.lit("    if total > 5:\n        total = 7\n"), (size % 7).cast("int")),
        loops, body,
        F.when(size % 5 == 0, "    try:\n        total = total + 6\n    except:\n        pass\n").otherwise(""),
        F.when(size % 6 == 0, F.concat(F.lit("    run_"), key, F.lit("("), params, F.lit(")\n"))).otherwise(""),
        F.lit("    return total\n"),
    )
    return part.select(F.col("p_partkey").alias("sample_id"), code.alias("code"))


TERMS = """WITH q AS (
 SELECT p_partkey, p_size % 10 AS np, p_size % 7 AS nb, p_size % 4 AS nl, CAST(p_size % 5 = 0 AS INTEGER) AS ex, CAST(p_size % 2 = 0 AS INTEGER) AS doc,
        CAST(p_size % 4 = 0 AS INTEGER) AS imp, CAST(p_size % 6 = 0 AS INTEGER) AS rec FROM part),
t AS (SELECT *, greatest(CAST(nb > 0 AS INTEGER), nl, ex) AS depth, 1 + nb + nl + ex AS cc FROM q)
"""
FACTS_ORACLE = TERMS + """SELECT p_partkey, 'ok' AS parse_status, CAST(cc AS BIGINT) AS cyclomatic, 1 AS functions, 0 AS classes, imp AS imports, depth, doc AS doc_functions,
 1 + 2 * nb + nl + CAST(nl > 0 AS INTEGER) + ex AS magic, rec AS recursive_calls, np AS worst_params, 1 AS worst_returns, nl AS worst_loops, nb AS worst_conditionals, nl AS worst_loop_depth, depth AS worst_nesting FROM t"""
SITES_ORACLE = TERMS + """, s AS (
 SELECT 'bare_except' AS rule FROM t WHERE ex = 1 UNION ALL SELECT 'missing_input_validation' FROM t WHERE np > 0 UNION ALL SELECT 'missing_none_case' FROM t WHERE np > 0
 UNION ALL SELECT 'missing_empty_case' FROM t WHERE np > 0 AND nl > 0 UNION ALL SELECT 'import' FROM t WHERE imp = 1)
SELECT rule, count(*) AS n, count(*) AS n_samples FROM s GROUP BY rule"""
CLASSES_ORACLE = TERMS + """SELECT CASE nl WHEN 0 THEN 'O(1)' WHEN 1 THEN 'O(n)' WHEN 2 THEN 'O(n²)' ELSE 'O(n³)' END AS loop_class,
 CASE depth WHEN 0 THEN 'O(1)' WHEN 1 THEN 'O(n)' WHEN 2 THEN 'O(n²)' ELSE 'O(n^3)' END AS time_class, 'O(1)' AS space_class,
 CASE depth WHEN 0 THEN 'excellent' WHEN 1 THEN 'good' ELSE 'acceptable' END AS fit, count(*) AS n FROM t GROUP BY ALL"""
ISSUE_TYPES = (
    "correctness.bare_except correctness.missing_input_validation correctness.missing_edge_case correctness.complexity correctness.execution security.dangerous_import "
    "security.vulnerable_dependency security.compliance_failure performance.loop_nesting performance.performance_bottleneck style.docstring_coverage style.missing_docstrings style.comment_density"
).split()
ISSUES_ORACLE = TERMS + """, s AS (
 SELECT 'correctness' AS agent, 'bare_except' AS type, 'high' AS severity FROM t WHERE ex = 1
 UNION ALL SELECT 'correctness', 'missing_input_validation', 'medium' FROM t WHERE np > 0
 UNION ALL SELECT 'correctness', 'missing_edge_case', 'medium' FROM t WHERE np > 0
 UNION ALL SELECT 'correctness', 'missing_edge_case', 'medium' FROM t WHERE np > 0 AND nl > 0
 UNION ALL SELECT 'security', 'dangerous_import', 'high' FROM t WHERE imp = 1
 UNION ALL SELECT 'security', 'vulnerable_dependency', 'high' FROM t WHERE imp = 1
 UNION ALL SELECT 'performance', 'loop_nesting', 'medium' FROM t WHERE depth = 3
 UNION ALL SELECT 'performance', 'performance_bottleneck', 'high' FROM t WHERE nl = 3
 UNION ALL SELECT 'style', 'docstring_coverage', CASE WHEN doc = 1 THEN 'low' ELSE 'medium' END FROM t
 UNION ALL SELECT 'style', 'missing_docstrings', 'low' FROM t WHERE doc = 0
 UNION ALL SELECT 'style', 'comment_density', 'low' FROM t)
SELECT agent, type, severity, count(*) AS n FROM s GROUP BY ALL"""

#: One line for each line rule, in the order of the rules.
RISKY = (
    "cursor.execute('select %s' % 'x')", "q = 'SELECT a'.format(b)", "q = 'DELETE ' + f'{a}'", "os.system('rm ' + name)", "run(cmd, shell=True)", "os.system('ls')", "eval(text)",
    "exec(text)", "compile(input, 'f', 'exec')", "pickle.loads(data)", "yaml.load(data)", "marshal.loads(data)", "hashlib.md5(password)", "hashlib.sha1(data)", "random.choice(keys)",
    "open(base + name)", "open(input_name)", "password = 'abcdef'", "api_key = 'abcdefghijklmnopqrstuvwx'", "secret = 'abcdefghij'", "if token == other: pass", "xml.etree.ElementTree.parse(f)",
)


def risky_lines(part: DataFrame) -> DataFrame:
    line = F.element_at(F.array(*map(F.lit, RISKY)), (F.col("p_partkey") % len(RISKY) + 1).cast("int"))
    code = F.concat(line, F.lit("\n"), F.when(F.col("p_size") % 2 == 0, "# for the User account").otherwise("# plain"), F.lit("\n"))
    return part.select(F.col("p_partkey").alias("sample_id"), code.alias("code"))


def _severity(rule: R.LineRule) -> str:
    strong = [w for w, m in rule.escalate.items() if m >= 2.5]
    up = {"high": "critical", "medium": "high"}.get(rule.severity, rule.severity)
    mild = {"medium": "high", "low": "medium"}.get(rule.severity, rule.severity)
    cases = (f"WHEN {any_of('lower(code)', strong)} THEN '{up}' " if strong else "") + (f"WHEN {any_of('lower(code)', rule.escalate)} THEN '{mild}' " if rule.escalate else "")
    return f"CASE {cases}ELSE '{rule.severity}' END" if cases else f"'{rule.severity}'"


def _words(rule: R.LineRule) -> str:
    return " + ".join(["0.9", *(f"CASE WHEN contains(lower(line), '{w}') THEN 0.05 ELSE 0 END" for w in rule.escalate)])


LINE_RULES_ORACLE = (
    f"WITH snippets(k, line) AS (VALUES {', '.join(f'({k}, {quoted(x)})' for k, x in enumerate(RISKY))}), c AS (SELECT p_partkey, line AS first, CASE WHEN p_size % 2 = 0 THEN '# for the User account' ELSE '# plain' END AS second FROM part JOIN snippets ON p_partkey % {len(RISKY)} = k),"
    " l AS (SELECT first || chr(10) || second || chr(10) AS code, unnest([first, second]) AS line FROM c), f AS ("
    + " UNION ALL ".join(f"SELECT '{r.name}' AS rule, {_severity(r)} AS severity, least(1.0, CAST({_words(r)} AS DOUBLE)) AS confidence FROM l WHERE regexp_matches(line, {quoted('(?i)' + r.regex)})" for r in R.LINE_RULES)
    + ") SELECT rule, severity, count(*) AS n, round(sum(confidence), 4) AS confidence FROM f GROUP BY ALL"
)


def patches(orders: DataFrame) -> DataFrame:
    """A unified diff for each order; every other one is too short to stand alone."""
    key, status = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    tail = F.when(F.col("o_orderkey") % 2 == 0, " and some more words to be long enough to keep").otherwise("")
    text = F.concat(F.lit("diff --git a/f b/f\nindex 1..2\n--- a/f\n+++ b/f\nignored before\n@@ -1,2 +1,2 @@\n keep "), key, F.lit("\n-old\n+new "), status, tail, F.lit("\n"))
    return orders.select("o_orderkey", text.alias("patch"))


PATCH_ORACLE = """WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ' and some more words to be long enough to keep' ELSE '' END AS tail, o_orderstatus AS s FROM orders),
 c AS (SELECT o_orderkey, 'keep ' || o_orderkey || chr(10) || 'new ' || s || tail AS code,
  'diff --git a/f b/f' || chr(10) || 'index 1..2' || chr(10) || '--- a/f' || chr(10) || '+++ b/f' || chr(10) || 'ignored before' || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || ' keep ' || o_orderkey || chr(10) || '-old' || chr(10) || '+new ' || s || tail || chr(10) AS patch FROM p),
 d AS (SELECT o_orderkey, CASE WHEN length(code) < 50 THEN patch ELSE code END AS code FROM c)
 SELECT o_orderkey, length(code) AS n_chars, md5(code) AS digest FROM d"""
