"""SQL that DuckDB runs to check the engine's queries, written from the rules' definitions."""

from __future__ import annotations

from probatio.operators import rules as R


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


STRIP = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
#: Documents with their lines; the tables hold no line break but \n.
LINES = f"""
docs AS (SELECT doc_id, coalesce(text, '') AS code FROM documents),
cut AS (SELECT doc_id, code, lower(code) AS low,
               CASE WHEN code = '' THEN [] WHEN ends_with(code, chr(10)) THEN string_split(left(code, length(code) - 1), chr(10)) ELSE string_split(code, chr(10)) END AS lines FROM docs),
base AS (SELECT *, len(lines) AS n_lines, len(list_filter(lines, lambda x: trim(x, {STRIP}) <> '')) AS n_kept FROM cut)
"""
DANGER = any_of("code", R.DANGEROUS_TEXT)


def matches(column: str, regex: str, flags: str = "") -> str:
    prefix = f"(?{flags})" if flags else ""
    return f"regexp_matches({column}, {quoted(prefix + regex)})"


def count(column: str, regex: str, flags: str = "") -> str:
    prefix = f"(?{flags})" if flags else ""
    return f"len(regexp_extract_all({column}, {quoted(prefix + regex)}))"


WEAK = "(" + " OR ".join(matches("code", r, "i") for r in R.WEAK_CRYPTO) + ")"
LINE_TABLE = "line_t AS (SELECT doc_id, unnest(lines) AS line FROM base)"
#: Every secret of every line: the rule, its value, entropy and severity.
SECRETS = (
    "secret_t AS ("
    + " UNION ALL ".join(f"SELECT doc_id, 'pattern' AS how, {quoted(n)} AS rule, unnest(regexp_extract_all(line, {quoted(r)})) AS value, line, {quoted(s)} AS fixed FROM line_t WHERE {matches('line', r)}" for n, s, r, _ in R.SECRET_RULES)
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT doc_id, 'entropy', {quoted(k)}, unnest(regexp_extract_all(line, {quoted(r)}, {g})), line, NULL FROM line_t WHERE {matches('line', r)}" for k, r, g in R.ENTROPY_RULES)
    + """),
measured AS (
  SELECT *, CASE WHEN length(value) < 8 THEN 0.0 ELSE -list_sum(list_transform(list_distinct(string_split(value, '')),
            lambda c: (len(list_filter(string_split(value, ''), lambda y: y = c)) / CAST(length(value) AS DOUBLE)) * log2(len(list_filter(string_split(value, ''), lambda z: z = c)) / CAST(length(value) AS DOUBLE)))) END AS bits
  FROM secret_t),
found AS (
  SELECT doc_id, how, rule, bits,
         CASE WHEN how = 'pattern' THEN fixed
              WHEN contains(lower(line), 'prod') OR contains(lower(line), 'live') OR contains(lower(line), 'api_key') THEN 'critical'
              WHEN contains(lower(line), 'key') OR contains(lower(line), 'token') OR contains(lower(line), 'secret') OR contains(lower(line), 'password') THEN 'high'
              WHEN length(value) > 40 AND rule IN ('base64_key', 'api_key') THEN 'medium' ELSE 'low' END AS severity
  FROM measured WHERE how = 'pattern' OR bits >= 3.5)"""
)
PER_DOC = """
per_doc AS (
  SELECT b.doc_id, count(f.rule) AS n_secrets, count(*) FILTER (WHERE how = 'pattern') AS n_pattern, count(*) FILTER (WHERE how = 'entropy') AS n_entropy,
         count(*) FILTER (WHERE severity = 'critical') AS n_critical, count(*) FILTER (WHERE severity = 'high') AS n_high,
         count(*) FILTER (WHERE severity = 'medium') AS n_medium, count(*) FILTER (WHERE severity = 'low') AS n_low
  FROM base b LEFT JOIN found f ON b.doc_id = f.doc_id GROUP BY b.doc_id)"""
SECRET_CTES = f"WITH {LINES}, {LINE_TABLE}, {SECRETS}, {PER_DOC}"

#: Line rules hold no match on the tables' prose unless one of these does.
RULE_HITS = " UNION ALL ".join(f"SELECT doc_id, {quoted(r.name)} AS rule, count(*) AS n FROM line_t WHERE {matches('line', r.regex, 'i')} GROUP BY doc_id" for r in R.LINE_RULES)

SPACING = " + ".join(count("code", r, "m") for r in R.SPACING)
STYLE = f"""
style_t AS (
  SELECT doc_id, code, lines, n_lines, n_kept, low,
         len(list_filter(lines, lambda x: length(x) > 88)) AS long_lines,
         len(list_filter(lines, lambda x: trim(x, {STRIP}) <> '' AND (length(x) - length(ltrim(x, {STRIP}))) % 4 <> 0)) AS odd_indents,
         {SPACING} AS spacing
  FROM base),
style_m AS (SELECT *, greatest(0.0, 1.0 - spacing / CAST(greatest(n_lines, 1) AS DOUBLE) * 2) AS formatting FROM style_t)"""
#: Closed forms of unparsable samples.
AGENTS = f"""
correct_t AS (
  SELECT doc_id, greatest(0.3, 1.0 - (0.6 + 3 * 0.64 + CASE WHEN {DANGER} THEN 0.24 ELSE 0.48 END + CASE WHEN n_kept >= 30 THEN 0.8 ELSE 0.0 END) / 6.0) AS correctness_score,
         1 AS c_critical,
         3 + CASE WHEN n_kept >= 30 THEN 1 ELSE 0 END + CASE WHEN {DANGER} THEN 0 ELSE 1 END AS c_high,
         CASE WHEN {DANGER} THEN 1 ELSE 0 END AS c_medium
  FROM base),
hits AS (SELECT doc_id, sum(n) AS n_rules FROM ({RULE_HITS}) GROUP BY doc_id),
secure_0 AS (
  SELECT b.doc_id, p.n_secrets, p.n_critical AS k, p.n_high AS h, p.n_medium AS m, p.n_low AS l, {WEAK} AS weak
  FROM base b JOIN per_doc p USING (doc_id)),
secure_1 AS (
  SELECT *, CASE WHEN k + h >= 3 THEN 1 ELSE 0 END AS cascade FROM secure_0),
secure_t AS (
  SELECT doc_id, n_secrets, weak, cascade,
         k + cascade + CASE WHEN k + cascade > 0 THEN 1 ELSE 0 END AS s_critical,
         h + CASE WHEN h > 1 THEN 1 ELSE 0 END + CASE WHEN n_secrets > 0 THEN 1 ELSE 0 END + CASE WHEN weak THEN 1 ELSE 0 END AS s_high,
         m AS s_medium, l AS s_low
  FROM secure_1),
secure_s AS (
  SELECT *, CASE WHEN s_critical + s_high + s_medium + s_low = 0 THEN 1.0
                 WHEN s_critical > 0 THEN greatest(0.1, 0.3 - s_critical * 0.1)
                 WHEN s_high >= 3 THEN greatest(0.4, 0.6 - s_high * 0.05)
                 WHEN s_high >= 1 THEN greatest(0.7, 0.85 - s_high * 0.05)
                 ELSE 1.0 - s_medium * 0.03 - s_low * 0.01 END AS security_score
  FROM secure_t),
style_s AS (
  SELECT doc_id,
         1 + 6 + 1 + CASE WHEN long_lines > 0 THEN 1 ELSE 0 END + CASE WHEN odd_indents > 0 THEN 1 ELSE 0 END + CASE WHEN spacing > 0 THEN 1 ELSE 0 END + CASE WHEN formatting < 0.8 THEN 1 ELSE 0 END AS style_issues,
         CASE WHEN long_lines = 0 THEN 1.0 ELSE greatest(0.0, 1.0 - (1.2 * 1.2 + 0.3 * 0.3 + 3.9 * 0.3 + 0.4 * 0.3
           + CASE WHEN odd_indents > 0 THEN 0.15 ELSE 0.0 END + CASE WHEN spacing > 0 THEN 0.12 ELSE 0.0 END + CASE WHEN formatting < 0.8 THEN 0.15 ELSE 0.0 END) / 5.0) END AS style_score
  FROM style_m)"""
FULL_CTES = f"WITH {LINES}, {LINE_TABLE}, {SECRETS}, {PER_DOC}, {STYLE}, {AGENTS}"
