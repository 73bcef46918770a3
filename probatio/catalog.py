"""Registry of the engine's own queries and their SQL oracles."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatio import catalog_sql as Q
from probatio import snippets, templates
from probatio.config import Settings
from probatio.functions import text as T
from probatio.model import AGENTS
from probatio.operators import correctness, corpus, facts, history, performance, report, security, style
from probatio.operators import rules as R
from probatio.plans import verify as plan
from probatio.sources import corpus as sources
from probatio.sources import sinks

FLAGSHIP = "secrets_per_document"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: SQL of a part of a query's result; the tests hold that part against it.
PARTS: dict[str, str] = {}


def query(name: str, oracle: str | None = None, part: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        if part:
            PARTS[name] = part
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir: str) -> DataFrame:
    return sources.table(table(spark, sf_dir, "documents"), "doc_id", "text")


def with_text(spark, sf_dir: str) -> DataFrame:
    return plan.with_text(plan.prepared(documents(spark, sf_dir), Settings())).withColumnRenamed("sample_id", "doc_id")


def analysed(spark, sf_dir: str, *agents: str) -> DataFrame:
    return plan.analyse(documents(spark, sf_dir), Settings(agents=agents or ("all",)))


def labelled(spark, sf_dir: str) -> DataFrame:
    """Documents with labels: low quality or toxic ones are to be rejected."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("should_reject"))
    return documents(spark, sf_dir).join(labels, "sample_id")


# Lexical rules -------------------------------------------------------------------------------------------------------


@query(FLAGSHIP, f"{Q.SECRET_CTES} SELECT doc_id, n_secrets, n_pattern, n_entropy, n_critical, n_high, n_medium, n_low FROM per_doc")
def secrets_per_document(spark, sf_dir):
    df = with_text(spark, sf_dir)
    df = T.materialise(df, p=security.secret_issues(F.col("lines"), F.col("code")), e=security.entropy_issues(F.col("lines"), F.col("code")))
    df = T.materialise(df, s=F.concat("p", "e"))
    of = lambda severity: F.size(F.filter("s", lambda i: i["severity"] == severity)).cast("long")
    return df.select(
        "doc_id", F.size("s").cast("long").alias("n_secrets"), F.size("p").cast("long").alias("n_pattern"), F.size("e").cast("long").alias("n_entropy"),
        of("critical").alias("n_critical"), of("high").alias("n_high"), of("medium").alias("n_medium"), of("low").alias("n_low"),
    )


@query("secret_entropy", f"{Q.SECRET_CTES} SELECT rule, severity, count(*) AS n, round(avg(bits), 6) AS mean_bits FROM found WHERE how = 'entropy' GROUP BY rule, severity")
def secret_entropy(spark, sf_dir):
    lines = with_text(spark, sf_dir).select(F.explode("lines").alias("line"))
    rows = [
        lines.select(F.lit(k).alias("rule"), F.explode(F.regexp_extract_all("line", F.lit(r), g)).alias("v"), "line").select("rule", T.entropy(F.col("v")).alias("bits"), security.impact(F.lit(k), F.col("v"), F.lower("line")).alias("severity"))
        for k, r, g in R.ENTROPY_RULES
    ]
    return reduce(DataFrame.unionByName, rows).where("bits >= 3.5").groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("bits"), 6).alias("mean_bits"))


@query("line_rules_documents", f"WITH {Q.LINES}, {Q.LINE_TABLE}, hits AS ({Q.RULE_HITS}) SELECT rule, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_lines FROM hits GROUP BY rule")
def line_rules_documents(spark, sf_dir):
    df = with_text(spark, sf_dir)
    found = F.flatten(F.array(*[security.line_rule_issues(r, F.col("lines"), F.col("code"), F.col("code_lower")) for r in R.LINE_RULES]))
    rows = df.select("doc_id", F.explode(found).alias("i")).groupBy("doc_id", F.col("i.type").alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("rule").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_lines"))


@query("code_stats", f"""WITH {Q.LINES} SELECT doc_id, n_lines AS total_lines, n_kept AS non_empty_lines, len(list_filter(lines, lambda x: starts_with(trim(x, {Q.STRIP}), '#'))) AS comment_lines,
 n_lines - n_kept AS blank_lines, length(code) AS characters, round(CASE WHEN n_lines > 0 THEN list_sum(list_transform(lines, lambda x: length(x))) / CAST(n_lines AS DOUBLE) ELSE 0.0 END, 6) AS avg_line_length FROM base""")
def code_stats(spark, sf_dir):
    df = T.materialise(with_text(spark, sf_dir), c=report.code_stats(F.col("lines"), F.col("code")))
    longs = [F.col(f"c.{n}").cast("long").alias(n) for n in ("total_lines", "non_empty_lines", "comment_lines", "blank_lines", "characters")]
    return df.select("doc_id", *longs, F.round("c.avg_line_length", 6).alias("avg_line_length"))


@query("layout_metrics", f"WITH {Q.LINES}, {Q.STYLE} SELECT doc_id, long_lines, odd_indents, spacing, round(formatting, 6) AS formatting FROM style_m")
def layout_metrics(spark, sf_dir):
    df = T.materialise(with_text(spark, sf_dir), spacing=style.spacing_issues(F.col("code")).cast("long"))
    return df.select("doc_id", style.long_lines(F.col("lines")).cast("long").alias("long_lines"), style.odd_indents(F.col("lines")).cast("long").alias("odd_indents"), "spacing", F.round(style.formatting_score(F.col("spacing"), F.col("n_lines")), 6).alias("formatting"))


@query("spacing_by_rule", f"WITH {Q.LINES}, c AS ({' UNION ALL '.join(f'SELECT {k} AS rule, {Q.count("code", r, "m")} AS n FROM base' for k, r in enumerate(R.SPACING))}) SELECT rule, count(*) FILTER (WHERE n > 0) AS n_docs, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY rule")
def spacing_by_rule(spark, sf_dir):
    df = with_text(spark, sf_dir)
    cells = F.array(*[F.struct(F.lit(k).alias("rule"), F.regexp_count("code", F.lit(T.pattern(r, multiline=True))).alias("n")) for k, r in enumerate(R.SPACING)])
    return df.select(F.inline(cells)).groupBy("rule").agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.sum("n").alias("n"))


@query("duplication", f"""WITH {Q.LINES}, s AS (SELECT doc_id, list_filter(list_transform(lines, lambda x: trim(x, {Q.STRIP})), lambda x: x <> '') AS own FROM base),
 w AS (SELECT doc_id, own, len(own) AS n, unnest(CASE WHEN len(own) >= 4 THEN range(1, len(own) - 1) ELSE [] END) AS i FROM s),
 r AS (SELECT doc_id, n, i, own[i] || ' ' || own[i + 1] || ' ' || own[i + 2] AS run FROM w),
 l AS (SELECT doc_id, run, max(i) AS last FROM r GROUP BY doc_id, run),
 d AS (SELECT r.doc_id, count(*) AS k FROM r JOIN l ON r.doc_id = l.doc_id AND r.run = l.run WHERE l.last >= r.i + 3 AND r.i <= r.n - 3 GROUP BY r.doc_id)
 SELECT s.doc_id, round(CASE WHEN len(own) < 4 THEN 1.0 ELSE greatest(0.0, 1.0 - 3 * coalesce(k, 0) / CAST(len(own) AS DOUBLE)) END, 6) AS duplication FROM s LEFT JOIN d USING (doc_id)""")
def duplication(spark, sf_dir):
    return with_text(spark, sf_dir).select("doc_id", F.round(style.duplication_score(F.col("lines")), 6).alias("duplication"))


@query("consistency", f"""WITH {Q.LINES}, i AS (SELECT doc_id, code, list_filter(list_transform(list_filter(lines, lambda x: trim(x, {Q.STRIP}) <> ''), lambda x: length(x) - length(ltrim(x, {Q.STRIP}))), lambda n: n > 0) AS own FROM base)
 SELECT doc_id, round((CASE WHEN contains(code, '''') AND contains(code, '"') THEN 0.7 ELSE 1.0 END + CASE WHEN len(own) = 0 THEN 1.0 ELSE 1.0 - len(list_filter(own, lambda n: n % list_min(own) <> 0)) / CAST(len(own) AS DOUBLE) END) / 2, 6) AS consistency FROM i""")
def consistency(spark, sf_dir):
    return with_text(spark, sf_dir).select("doc_id", F.round(style.consistency(F.col("lines"), F.col("code")), 6).alias("consistency"))


@query("text_patterns", f"""WITH {Q.LINES}, p AS (SELECT *, CASE {' '.join(f"WHEN {Q.any_of('low', w)} THEN '{n}'" for n, w in performance.PATTERNS)} ELSE 'general' END AS pattern FROM base)
 SELECT pattern, (pattern IN ('sorting', 'searching') OR {Q.any_of('low', ('performance', 'optimization', 'scale', 'production'))}) AS critical, CASE WHEN n_kept < 30 THEN 'snippet_context' WHEN n_kept < 100 THEN 'patch_context' ELSE 'full_file' END AS context,
 (n_kept >= 100 AND NOT {Q.any_of('code', R.UNPROFILED_TEXT)}) AS profiled, count(*) AS n FROM p GROUP BY ALL""")
def text_patterns(spark, sf_dir):
    df = with_text(spark, sf_dir)
    context = performance.code_context(F.lit(False), F.col("n_non_blank"))
    return df.groupBy(performance.algorithm_pattern(F.col("code_lower")).alias("pattern"), performance.is_critical(F.col("code_lower")).alias("critical"), context.alias("context"), performance.may_profile(F.col("code"), context).alias("profiled")).agg(F.count(F.lit(1)).alias("n"))


@query("text_gates", f"WITH {Q.LINES} SELECT {Q.DANGER} AS dangerous, {Q.WEAK} AS weak_crypto, ({Q.matches('code', R.WEAK_CRYPTO[0], 'i')} OR {Q.matches('code', R.WEAK_CRYPTO[1], 'i')} OR {Q.matches('code', chr(92) + 'b(?:DES|3DES|RC4)' + chr(92) + 'b', 'i')}) AS weak_words, count(*) AS n FROM base GROUP BY ALL")
def text_gates(spark, sf_dir):
    code = F.col("code")
    return with_text(spark, sf_dir).groupBy(T.contains_any(code, R.DANGEROUS_TEXT).alias("dangerous"), security.weak_crypto(code).alias("weak_crypto"), security.weak_crypto(code, True).alias("weak_words")).agg(F.count(F.lit(1)).alias("n"))


@query("test_hints", f"WITH {Q.LINES} SELECT doc_id, {' + '.join(Q.count('code', r) for r in R.TEST_HINTS)} AS hints FROM base")
def test_hints(spark, sf_dir):
    return with_text(spark, sf_dir).select("doc_id", style.test_hints(F.col("code")).cast("long").alias("hints"))


@query("live_lint", f"""WITH {Q.LINES}, p AS (SELECT *, {' + '.join(Q.count('code', w) for w in ('if', 'for', 'while', 'try'))} AS points FROM base)
 SELECT CASE WHEN points < 5 THEN 'Low' WHEN points < 15 THEN 'Medium' ELSE 'High' END AS complexity, count(*) AS n, CAST(sum(n_lines) AS BIGINT) AS total_lines, CAST(sum(n_kept) AS BIGINT) AS code_lines FROM p GROUP BY 1""")
def live_lint(spark, sf_dir):
    df = T.materialise(with_text(spark, sf_dir), lint=history.live_lint(F.col("lines"), F.col("code")))
    return df.groupBy(F.col("lint.complexity").alias("complexity")).agg(F.count(F.lit(1)).alias("n"), F.sum("lint.total_lines").alias("total_lines"), F.sum("lint.code_lines").alias("code_lines"))


# Agents and reports on the documents table ---------------------------------------------------------------------------


@query("correctness_documents", f"{Q.FULL_CTES} SELECT doc_id, c_critical AS n_critical, c_high AS n_high, c_medium AS n_medium, round(correctness_score, 6) AS score FROM correct_t")
def correctness_documents(spark, sf_dir):
    return _agent(spark, sf_dir, "correctness")


def _agent(spark, sf_dir, agent):
    df = analysed(spark, sf_dir, agent)
    of = lambda s: F.size(F.filter(f"{agent}_issues", lambda i: i["severity"] == s)).cast("long")
    return df.select(F.col("sample_id").alias("doc_id"), of("critical").alias("n_critical"), of("high").alias("n_high"), of("medium").alias("n_medium"), F.round(f"{agent}_score", 6).alias("score"))


@query("security_documents", f"{Q.FULL_CTES} SELECT doc_id, s_critical AS n_critical, s_high AS n_high, s_medium AS n_medium, round(security_score, 6) AS score FROM secure_s")
def security_documents(spark, sf_dir):
    return _agent(spark, sf_dir, "security")


@query("performance_documents", f"WITH {Q.LINES} SELECT doc_id, 0 AS n_critical, 0 AS n_high, 0 AS n_medium, 1.0 AS score FROM base")
def performance_documents(spark, sf_dir):
    return _agent(spark, sf_dir, "performance")


@query("style_documents", f"{Q.FULL_CTES} SELECT doc_id, style_issues AS n_issues, round(style_score, 6) AS score FROM style_s")
def style_documents(spark, sf_dir):
    return analysed(spark, sf_dir, "style").select(F.col("sample_id").alias("doc_id"), F.size("style_issues").cast("long").alias("n_issues"), F.round("style_score", 6).alias("score"))


@query("security_metrics", f"{Q.FULL_CTES} SELECT CAST(sum(n_secrets) AS BIGINT) AS secrets, count(*) FILTER (WHERE n_secrets > 0) AS with_secrets, count(*) FILTER (WHERE weak OR n_secrets > 0) AS with_compliance FROM secure_t")
def security_metrics(spark, sf_dir):
    df = analysed(spark, sf_dir, "security")
    m = "security_metrics"
    return df.agg(F.sum(f"{m}.secrets_found").alias("secrets"), F.count_if(F.col(f"{m}.secrets_found") > 0).alias("with_secrets"), F.count_if(F.col(f"{m}.compliance_risk") > 0).alias("with_compliance"))


@query("reports_documents", f"{Q.FULL_CTES} SELECT doc_id, 'FAIL' AS verdict, CASE WHEN s_critical > 0 THEN 0.0 ELSE 0.4 END AS score, CASE WHEN s_critical > 0 THEN 'F (Critical Failures)' ELSE 'D (Deployment Blocked)' END AS grade, 'BLOCKED' AS readiness, 'CRITICAL' AS risk FROM secure_s")
def reports_documents(spark, sf_dir):
    df = plan.verify(documents(spark, sf_dir))
    return df.select(F.col("sample_id").alias("doc_id"), "verdict", "score", "grade", F.col("assessment.deployment_readiness").alias("readiness"), F.col("enterprise.deployment_risk").alias("risk"))


SUBSETS = ", ".join(f"({k}, '{n}', {len(a)}, {', '.join(str(x in a).lower() for x in ('correctness', 'security', 'performance', 'style'))})" for k, n, a in corpus.agent_subsets())
CELLS = f"""
subsets(seq, config, n_agents, c, s, p, t) AS (VALUES {SUBSETS}),
cells AS (
  SELECT doc_id AS sample_id, x.*, (l.quality = 0 OR l.toxic = 1) AS should_reject,
         (CASE WHEN c THEN c_critical ELSE 0 END) + (CASE WHEN s AND s_critical > 0 THEN 3 ELSE 0 END) AS critical,
         (CASE WHEN c THEN c_high ELSE 0 END) + (CASE WHEN s THEN s_high ELSE 0 END) + (CASE WHEN t THEN 1 ELSE 0 END) AS high,
         (CASE WHEN c THEN c_high ELSE 0 END) + (CASE WHEN s THEN s_high ELSE 0 END) AS blocking,
         ((CASE WHEN s THEN 0.45 * security_score ELSE 0.0 END) + (CASE WHEN c THEN 0.35 * correctness_score ELSE 0.0 END) + (CASE WHEN p THEN 0.15 ELSE 0.0 END) + (CASE WHEN t THEN 0.05 * style_score ELSE 0.0 END))
           / ((CASE WHEN s THEN 0.45 ELSE 0.0 END) + (CASE WHEN c THEN 0.35 ELSE 0.0 END) + (CASE WHEN p THEN 0.15 ELSE 0.0 END) + (CASE WHEN t THEN 0.05 ELSE 0.0 END)) AS mean,
         security_score
  FROM base b JOIN labels l USING (doc_id) JOIN correct_t USING (doc_id) JOIN secure_s USING (doc_id) JOIN style_s USING (doc_id) CROSS JOIN subsets x),
scored AS (
  SELECT *, round(greatest(0.0, least(CASE WHEN s AND security_score < 0.4 THEN least(mean, 0.6) ELSE mean END,
              CASE WHEN critical >= 3 THEN 0.0 WHEN critical > 0 THEN 1.0 - (0.6 + (critical - 1) * 0.2) ELSE 1.0 END,
              CASE WHEN high >= 3 THEN 0.4 WHEN high = 2 THEN 0.6 WHEN high = 1 THEN 0.8 ELSE 1.0 END)), 3) AS score FROM cells),
judged AS (
  SELECT *, CASE WHEN critical > 0 OR high >= 3 THEN 'FAIL' WHEN high = 2 THEN 'WARNING' WHEN score >= 0.85 THEN (CASE WHEN high >= 1 THEN 'WARNING' ELSE 'PASS' END)
                 WHEN score >= 0.7 THEN 'WARNING' WHEN blocking > 0 THEN 'FAIL' ELSE 'WARNING' END AS verdict FROM scored),
kinds AS (
  SELECT *, CASE WHEN should_reject AND verdict = 'FAIL' THEN 'tp' WHEN NOT should_reject AND verdict IN ('PASS', 'WARNING') THEN 'tn' WHEN NOT should_reject AND verdict = 'FAIL' THEN 'fp' ELSE 'fn' END AS kind FROM judged),
rates AS (
  SELECT seq, config, n_agents, c, s, p, t, count(*) AS n, count(*) FILTER (WHERE kind = 'tp') AS tp, count(*) FILTER (WHERE kind = 'tn') AS tn, count(*) FILTER (WHERE kind = 'fp') AS fp, count(*) FILTER (WHERE kind = 'fn') AS fn,
         (count(*) FILTER (WHERE kind IN ('tp', 'tn'))) / CAST(count(*) AS DOUBLE) AS accuracy,
         coalesce((count(*) FILTER (WHERE kind = 'tp')) / CAST(nullif(count(*) FILTER (WHERE should_reject), 0) AS DOUBLE), 0.0) AS tpr,
         coalesce((count(*) FILTER (WHERE kind = 'fp')) / CAST(nullif(count(*) FILTER (WHERE NOT should_reject), 0) AS DOUBLE), 0.0) AS fpr
  FROM kinds GROUP BY ALL)"""
ABLATION = f"{Q.FULL_CTES}, {CELLS}"


def cells(spark, sf_dir) -> DataFrame:
    return corpus.subset_cells(plan.analyse(labelled(spark, sf_dir)), Settings())


def rates(spark, sf_dir) -> DataFrame:
    return corpus.confusion(cells(spark, sf_dir), "seq", "config", "n_agents", "agents")


@query("ablation_cells", f"{ABLATION} SELECT config, verdict, count(*) AS n, round(avg(score), 5) AS mean_score FROM judged GROUP BY config, verdict")
def ablation_cells(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("config", "verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 5).alias("mean_score"))


@query("ablation", f"{ABLATION} SELECT CAST(row_number() OVER (ORDER BY accuracy DESC, seq) AS INTEGER) AS rank, config, n_agents, tp, tn, fp, fn, round(accuracy, 6) AS accuracy, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM rates")
def ablation(spark, sf_dir):
    return corpus.ranked(rates(spark, sf_dir)).select("rank", "config", "n_agents", "tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "tpr", "fpr")])


@query("ablation_by_size", f"{ABLATION} SELECT n_agents, round(avg(accuracy), 6) AS accuracy, round(avg(tpr), 6) AS tpr, round(avg(fpr), 6) AS fpr, arg_min(config, -accuracy * 1000 + seq) AS best FROM rates GROUP BY n_agents")
def ablation_by_size(spark, sf_dir):
    return corpus.by_size(rates(spark, sf_dir)).select("n_agents", *[F.round(c, 6).alias(c) for c in ("accuracy", "tpr", "fpr")], "best")


@query("ablation_contribution", " UNION ALL ".join(f"SELECT '{n}' AS agent, round(avg(accuracy) FILTER (WHERE {k}) - avg(accuracy) FILTER (WHERE NOT {k}), 6) AS contribution FROM rates" for n, k in (("correctness", "c"), ("security", "s"), ("performance", "p"), ("style", "t"))).join((f"{ABLATION} SELECT * FROM (", ")")))
def ablation_contribution(spark, sf_dir):
    return corpus.contributions(rates(spark, sf_dir)).select("agent", F.round("contribution", 6).alias("contribution"))


@query("ablation_advantage", f"""{ABLATION}, a AS (SELECT avg(accuracy) FILTER (WHERE n_agents = 1) AS single, avg(accuracy) FILTER (WHERE n_agents > 1) AS several, max(accuracy) AS best, min(accuracy) FILTER (WHERE n_agents = 1) AS worst_single FROM rates)
 SELECT round(single, 6) AS single, round(several, 6) AS several, round(several - single, 6) AS gain, round(best - worst_single, 6) AS improvement, CASE WHEN several - single > 0.1 THEN 'strong' WHEN several - single > 0.05 THEN 'moderate' WHEN several - single > 0 THEN 'weak' ELSE 'none' END AS band FROM a""")
def ablation_advantage(spark, sf_dir):
    return corpus.advantage(rates(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("single", "several", "gain", "improvement")], "band")


@query("confusion_by_language", f"""{ABLATION}, j AS (SELECT k.*, d.lang FROM kinds k JOIN documents d ON k.sample_id = d.doc_id WHERE config = 'S+P+St')
 SELECT lang, count(*) AS n, count(*) FILTER (WHERE kind = 'tp') AS tp, count(*) FILTER (WHERE kind = 'tn') AS tn, count(*) FILTER (WHERE kind = 'fp') AS fp, count(*) FILTER (WHERE kind = 'fn') AS fn,
 round((count(*) FILTER (WHERE kind IN ('tp', 'tn'))) / CAST(count(*) AS DOUBLE), 6) AS accuracy FROM j GROUP BY lang""")
def confusion_by_language(spark, sf_dir):
    lang = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "lang")
    own = cells(spark, sf_dir).where("config = 'S+P+St'").join(lang, "sample_id")
    return corpus.confusion(own, "lang").select("lang", "n", "tp", "tn", "fp", "fn", F.round("accuracy", 6).alias("accuracy"))


def reviews(spark, sf_dir) -> DataFrame:
    """Reports without the correctness agent, which do not all fail."""
    source = sources.spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("sample_id"), F.col("text").alias("code"), "source", "lang")
    settings = Settings(agents=("security", "performance", "style"))
    return plan.with_report(plan.analyse(source, settings), settings.agents, settings)


REVIEWS = f"""{Q.FULL_CTES}, reviewed AS (
  SELECT doc_id, security_score, style_score, s_critical, s_high + 1 AS high, CASE WHEN s_critical > 0 THEN 0.0 ELSE round(least((0.45 * security_score + 0.15 + 0.05 * style_score) / 0.65, CASE WHEN s_high >= 2 THEN 0.4 WHEN s_high = 1 THEN 0.6 ELSE 0.8 END), 3) END AS score,
         CASE WHEN s_critical > 0 OR s_high >= 2 THEN 'FAIL' ELSE 'WARNING' END AS verdict, source, lang, code
  FROM secure_s JOIN style_s USING (doc_id) JOIN base USING (doc_id) JOIN (SELECT doc_id, source, lang FROM documents) USING (doc_id))"""


@query("verdicts_by_source", f"{REVIEWS} SELECT source, count(*) AS n, count(*) FILTER (WHERE verdict = 'PASS') AS passed, count(*) FILTER (WHERE verdict = 'WARNING') AS warned, count(*) FILTER (WHERE verdict = 'FAIL') AS failed, round(avg(score), 5) AS mean_score FROM reviewed GROUP BY source")
def verdicts_by_source(spark, sf_dir):
    return corpus.group_stats(reviews(spark, sf_dir), "source").select("source", "n", "passed", "warned", "failed", F.round("mean_score", 5).alias("mean_score"))


@query("top_sources", f"{REVIEWS} SELECT source, count(*) AS n FROM reviewed GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_sources(spark, sf_dir):
    return corpus.group_stats(reviews(spark, sf_dir), "source", top=10).select("source", "n")


@query("score_stats", f"""{REVIEWS}, o AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS pos, count(*) OVER () AS n FROM reviewed)
 SELECT max(n) AS n, round(avg(score), 5) AS mean, round(median(score), 5) AS median, round(stddev_samp(score), 5) AS stdev, min(score) AS least, max(score) AS most, max(score) FILTER (WHERE pos = n // 4) AS q1, max(score) FILTER (WHERE pos = (3 * n) // 4) AS q3 FROM o""")
def score_stats(spark, sf_dir):
    return corpus.score_stats(reviews(spark, sf_dir).select("score")).select("n", *[F.round(c, 5).alias(c) for c in ("mean", "median", "stdev")], "least", "most", "q1", "q3")


@query("agent_stats", " UNION ALL ".join(f"SELECT '{a}' AS agent, round(avg({c}), 5) AS mean, round(median({c}), 5) AS median, round(stddev_samp({c}), 5) AS stdev, round(min({c}), 5) AS least, round(max({c}), 5) AS most FROM reviewed" for a, c in (("security", "security_score"), ("style", "style_score"), ("performance", "1.0::DOUBLE"))).join((f"{REVIEWS} SELECT * FROM (", ")")))
def agent_stats(spark, sf_dir):
    return corpus.agent_stats(reviews(spark, sf_dir)).select("agent", *[F.round(c, 5).alias(c) for c in ("mean", "median", "stdev", "least", "most")])


@query("quality_bands", f"""{REVIEWS} SELECT verdict, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS band,
 CASE WHEN length(code) > 100 THEN 'high' WHEN length(code) > 50 AND score <> 0 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN s_critical > 0 OR high >= 3 THEN 'LOW' ELSE 'MEDIUM' END AS quality, count(*) AS n FROM (SELECT * REPLACE (CASE WHEN score = 0 THEN '' ELSE code END AS code) FROM reviewed) GROUP BY ALL""")
def quality_bands(spark, sf_dir):
    n = F.col("n")
    df = reviews(spark, sf_dir).select(
        "verdict", corpus.quality_band(F.col("score")).alias("band"), corpus.confidence_level(n["total"], F.length("code"), F.col("score"), 3).alias("confidence"), corpus.patch_quality(n["critical"], n["high"], n["medium"]).alias("quality")
    )
    return df.groupBy("verdict", "band", "confidence", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("verdict_confidence", f"""{REVIEWS}, v AS (SELECT *, (security_score + 1.0 + style_score) / 3 AS m FROM reviewed)
 SELECT round(least(1.0, 0.5 + CASE WHEN length(code) > 100 THEN 0.2 WHEN length(code) > 50 THEN 0.1 ELSE 0.0 END + CASE WHEN ((security_score - m) * (security_score - m) + (1.0 - m) * (1.0 - m) + (style_score - m) * (style_score - m)) / 2 < 0.05 THEN 0.2 ELSE 0.0 END + CASE WHEN s_critical > 0 THEN 0.1 ELSE 0.0 END), 6) AS confidence, count(*) AS n FROM v GROUP BY 1""")
def verdict_confidence(spark, sf_dir):
    scores = [F.col(f"{a}_score") for a in ("security", "performance", "style")]
    return reviews(spark, sf_dir).groupBy(F.round(corpus.verdict_confidence(F.length("code"), scores, F.col("n.critical")), 6).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("issue_types", part=f"""{Q.FULL_CTES}, u AS (SELECT 'maintainability_index' AS type, 'high' AS severity FROM style_m UNION ALL SELECT 'crypto_compliance_failure', 'high' FROM secure_t WHERE weak
 UNION ALL SELECT unnest(['import_organization', 'variable_naming', 'function_naming', 'class_naming', 'code_clarity', 'logical_structure', 'consistency']), 'low' FROM style_m
 UNION ALL SELECT 'line_length', 'low' FROM style_m WHERE long_lines > 0 UNION ALL SELECT 'indentation', 'low' FROM style_m WHERE odd_indents > 0 UNION ALL SELECT 'spacing', 'low' FROM style_m WHERE spacing > 0 UNION ALL SELECT 'code_formatting', 'low' FROM style_m WHERE formatting < 0.8)
 SELECT type, count(*) AS n, count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'high') AS high FROM u GROUP BY type""")
def issue_types(spark, sf_dir):
    return corpus.type_severity(reviews(spark, sf_dir))


@query("false_positive_types", part=f"""{ABLATION}, f AS (SELECT sample_id FROM kinds WHERE config = 'S+P+St' AND kind = 'fp')
 SELECT 'secret' AS type, count(DISTINCT f.sample_id) AS n_docs FROM f JOIN found ON found.doc_id = f.sample_id HAVING count(*) > 0""")
def false_positive_types(spark, sf_dir):
    """Documents behind false positives by issue type."""
    settings = Settings(agents=("security", "performance", "style"))
    reports = plan.with_report(plan.analyse(labelled(spark, sf_dir), settings), settings.agents, settings)
    wrong = reports.where((F.col("verdict") == "FAIL") & ~F.col("should_reject"))
    return corpus.issue_rows(wrong).groupBy("type").agg(F.count_distinct("sample_id").alias("n_docs"))


@query("batch_summary", f"{REVIEWS} SELECT count(*) AS total, count(*) FILTER (WHERE score >= 0.85) AS passed, count(*) FILTER (WHERE score < 0.7) AS failed, round(avg(score), 5) AS mean_score, round(avg(security_score), 5) AS security_mean, round(avg(style_score), 5) AS style_mean FROM reviewed")
def batch_summary(spark, sf_dir):
    return corpus.batch_summary(reviews(spark, sf_dir), 0.7).select("total", "passed", "failed", *[F.round(c, 5).alias(c) for c in ("mean_score", "security_mean", "style_mean")])


@query("running_accuracy", f"""{ABLATION}, k AS (SELECT sample_id, CASE WHEN kind IN ('tp', 'tn') THEN 1.0 ELSE 0.0 END AS correct FROM kinds WHERE config = 'S+P+St')
 SELECT sample_id, round(avg(correct) OVER (ORDER BY sample_id ROWS UNBOUNDED PRECEDING), 6) AS running FROM k""")
def running_accuracy(spark, sf_dir):
    own = cells(spark, sf_dir).where("config = 'S+P+St'").select("sample_id", corpus.is_correct(F.col("verdict"), F.col("should_reject")).alias("correct"))
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"))
    return corpus.progress(own, "sample_id", ids).select("sample_id", F.round("running", 6).alias("running"))


@query("mutual_information", f"""{ABLATION}, k AS (SELECT verdict, should_reject FROM judged WHERE config = 'S+P+St'), j AS (SELECT verdict, should_reject, count(*) AS n FROM k GROUP BY ALL),
 w AS (SELECT *, sum(n) OVER () AS a, sum(n) OVER (PARTITION BY verdict) AS na, sum(n) OVER (PARTITION BY should_reject) AS nb FROM j) SELECT round(sum(n / CAST(a AS DOUBLE) * log2(n * CAST(a AS DOUBLE) / (na * nb))), 6) AS bits FROM w""")
def mutual_information(spark, sf_dir):
    return corpus.mutual_information(cells(spark, sf_dir).where("config = 'S+P+St'"), "verdict", "should_reject").select(F.round("bits", 6).alias("bits"))


@query("agent_correlation", part=f"{Q.FULL_CTES} SELECT round(corr(correctness_score, security_score), 5) AS correctness_security, round(corr(correctness_score, style_score), 5) AS correctness_style, round(corr(security_score, style_score), 5) AS security_style FROM correct_t JOIN secure_s USING (doc_id) JOIN style_s USING (doc_id)")
def agent_correlation(spark, sf_dir):
    """Null where a score never varies."""
    rho = corpus.agent_correlation(analysed(spark, sf_dir))
    return rho.agg(*[F.round(F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col("rho"))), 5).alias(f"{a}_{b}") for a, b in combinations(AGENTS, 2)])


@query("report_json", f"{Q.FULL_CTES} SELECT doc_id, CASE WHEN s_critical > 0 THEN 0.0 ELSE 0.4 END AS score, 'FAIL' AS verdict FROM secure_s")
def report_json(spark, sf_dir):
    """Reports through JSON and back."""
    done = sinks.report_json(plan.verify(documents(spark, sf_dir)))
    return done.select(F.col("sample_id").alias("doc_id"), F.get_json_object("report", "$.score").cast("double").alias("score"), F.get_json_object("report", "$.verdict").alias("verdict"))


# Corpus plumbing -----------------------------------------------------------------------------------------------------


@query("first_by_text", "SELECT min(doc_id) AS doc_id, md5(text) AS key FROM documents GROUP BY text")
def first_by_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.md5("text").alias("key"), "doc_id")
    return corpus.first_of(docs, "key", "doc_id").select("doc_id", "key")


@query("tagged_union", "SELECT source, count(*) AS n, CAST(sum(length(code)) AS BIGINT) AS chars FROM (SELECT 'documents' AS source, text AS code FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'pages', html FROM pages) GROUP BY source")
def tagged_union(spark, sf_dir):
    parts = {n: table(spark, sf_dir, n).select(F.col(c).alias("code")) for n, c in (("documents", "text"), ("benchmark", "text"), ("conversations", "text"), ("pages", "html"))}
    return corpus.tagged_union(parts).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("code")).alias("chars"))


@query("problem_categories", f"SELECT category, count(*) AS n FROM (SELECT CASE {' '.join(f"WHEN {Q.any_of('lower(text)', w)} THEN '{n}'" for n, w in R.CATEGORIES.items())} ELSE 'other' END AS category FROM documents) GROUP BY category")
def problem_categories(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(corpus.problem_category(F.col("text")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("patch_code", templates.PATCH_ORACLE)
def patch_code(spark, sf_dir):
    patches = templates.patches(table(spark, sf_dir, "orders"))
    return patches.select("o_orderkey", F.length(corpus.patch_code(F.col("patch"))).cast("long").alias("n_chars"), F.md5(corpus.patch_code(F.col("patch"))).alias("digest"))


@query("generic_score", "SELECT o_orderkey, round(CASE WHEN n = 0 THEN 1.0 ELSE greatest(0.0, 1.0 - (k * 0.7 + (n - k) * 0.1) / n) END, 6) AS score FROM (SELECT o_orderkey, count(l_orderkey) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS k FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)")
def generic_score(spark, sf_dir):
    from probatio.model import issue, severity_score

    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(issue("x", F.when(F.col("l_returnflag") == "R", "high").otherwise("low"), "m")).alias("issues"))
    joined = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.round(severity_score(F.coalesce("issues", F.array().cast(lines.schema["issues"].dataType))), 6).alias("score"))


# Cache, history and statistics ---------------------------------------------------------------------------------------


@query("cache_keys", f"SELECT doc_id, sha256(sha256(text) || sha256('{{}}') || '{Settings().fingerprint()}') AS key FROM documents")
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", history.cache_key(F.col("text"), None, Settings()).alias("key"))


@query("cache_lookup", """WITH c AS (SELECT user_id, max(ts) AS created FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id)
 SELECT count(*) AS requests, count(*) FILTER (WHERE created IS NOT NULL) AS hits, count(*) FILTER (WHERE created IS NULL) AS misses, round(avg(CASE WHEN created IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM events e LEFT JOIN c ON e.user_id = c.user_id AND c.created > (SELECT min(ts) FROM events) + INTERVAL 1 HOUR""")
def cache_lookup(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    low = events.agg(F.min("event_type").alias("__t"), (F.min("ts") + F.expr("INTERVAL 1 HOUR")).alias("__now"))
    # ``low`` has one row.
    cache = events.crossJoin(F.broadcast(low)).where((F.col("event_type") == F.col("__t")) & (F.col("ts") > F.col("__now")))
    cache = cache.select(F.col("user_id").alias("key"), F.col("ts").alias("created_at"), F.col("ts").alias("expires_at"), "value")
    found = history.lookup(events.select(F.col("user_id").alias("key")), cache, F.lit("1900-01-01").cast("timestamp"))
    return history.cache_stats(found).select("requests", "hits", "misses", F.round("hit_rate", 6).alias("hit_rate"))


@query("expired_entries", "SELECT event_type, count(*) AS n FROM events WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) GROUP BY event_type")
def expired_entries(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    stamped = events.withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 1 HOUR")).crossJoin(F.broadcast(now))  # now has one row
    return history.expired(stamped, F.col("now")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("running_statistics", "SELECT event_id, count(*) OVER w AS runs, round(avg(value) OVER w, 9) AS running_mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_statistics(spark, sf_dir):
    return history.running(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "runs", F.round("running_mean", 9).alias("running_mean"))


@query("history_trend", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(sum(value), 4) AS total, round(arg_max(value, event_id) - arg_min(value, event_id), 6) AS change FROM events GROUP BY event_type")
def history_trend(spark, sf_dir):
    return history.trend(table(spark, sf_dir, "events"), "event_type", "event_id", "value").select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("total", 4).alias("total"), F.round("change", 6).alias("change"))


@query("latency_average", """WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
 e AS (SELECT user_id, k, value AS ema FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, e.ema * 0.9 + o.value * (1 - 0.9) FROM e JOIN o ON o.user_id = e.user_id AND o.k = e.k + 1),
 m AS (SELECT user_id, max(k) AS n FROM o GROUP BY user_id) SELECT e.user_id, round(ema, 6) AS ema, n FROM e JOIN m ON e.user_id = m.user_id AND e.k = m.n""")
def latency_average(spark, sf_dir):
    return history.moving_average(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("user_id", F.round("ema", 6).alias("ema"), F.col("n").cast("long").alias("n"))


@query("feedback_means", "SELECT round(avg(least(5, 1 + quantity % 5)), 6) AS satisfaction, round(avg(3.0), 6) AS accuracy, CAST(sum(quantity % 3) AS BIGINT) AS false_positives, CAST(sum(quantity % 2) AS BIGINT) AS false_negatives FROM (SELECT CAST(l_quantity AS BIGINT) AS quantity FROM lineitem)")
def feedback_means(spark, sf_dir):
    names = F.array(*map(F.lit, history.RATINGS))
    q = F.col("l_quantity").cast("long")
    rows = table(spark, sf_dir, "lineitem").select(F.element_at(names, (1 + q % 5).cast("int")).alias("satisfaction"), F.lit("no such rating").alias("accuracy"), (q % 3).alias("false_positives"), (q % 2).alias("false_negatives"))
    return history.feedback_means(rows).select(F.round("satisfaction", 6).alias("satisfaction"), F.round("accuracy", 6).alias("accuracy"), "false_positives", "false_negatives")


# Syntax-tree rules on code made from table columns -------------------------------------------------------------------


def _templated(spark, sf_dir) -> DataFrame:
    return templates.programs(sources.spread(table(spark, sf_dir, "part")))


@query("tree_facts", templates.FACTS_ORACLE)
def tree_facts(spark, sf_dir):
    f = facts.with_facts(_templated(spark, sf_dir))
    names = ("cyclomatic", "functions", "classes", "imports", "depth", "doc_functions", "magic", "recursive_calls")
    worst = ("params", "returns", "loops", "conditionals", "loop_depth", "nesting")
    return f.select(F.col("sample_id").alias("p_partkey"), "facts.parse_status", *[F.col(f"facts.{n}").cast("long").alias(n) for n in names], *[F.col(f"facts.worst.{n}").cast("long").alias(f"worst_{n}") for n in worst])


@query("tree_sites", templates.SITES_ORACLE)
def tree_sites(spark, sf_dir):
    f = facts.with_facts(_templated(spark, sf_dir)).select("sample_id", F.explode("facts.sites").alias("s"))
    return f.groupBy(F.col("s.rule").alias("rule")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample_id").alias("n_samples"))


@query("tree_classes", templates.CLASSES_ORACLE)
def tree_classes(spark, sf_dir):
    df = plan.with_text(facts.with_facts(plan.prepared(_templated(spark, sf_dir), Settings())))
    f = F.col("facts")
    context = performance.code_context(F.col("is_patch_context"), F.col("n_non_blank"))
    return df.groupBy(performance.loop_class(f).alias("loop_class"), performance.time_class(f).alias("time_class"), performance.space_class(f).alias("space_class"), performance.suitability(performance.time_class(f), context).alias("fit")).agg(F.count(F.lit(1)).alias("n"))


@query("tree_issues", part=templates.ISSUES_ORACLE)
def tree_issues(spark, sf_dir):
    df = plan.analyse(_templated(spark, sf_dir))
    def kinds(agent):
        return F.transform(f"{agent}_issues", lambda i: F.struct(F.lit(agent).alias("agent"), i["type"].alias("type"), i["severity"].alias("severity")))

    own = corpus.generated(df, F.concat(*map(kinds, ("correctness", "security", "performance", "style"))))
    return own.groupBy("agent", "type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("snippet_issues", snippets.ISSUES_ORACLE)
def snippet_issues(spark, sf_dir):
    """Every issue of programs that meet the rules of all agents one by one."""
    df = plan.analyse(snippets.distinct(table(spark, sf_dir, "part")).withColumnRenamed("n", "copies"))
    kinds = lambda agent: F.transform(f"{agent}_issues", lambda i: F.struct(F.lit(agent).alias("agent"), i["type"].alias("type"), i["severity"].alias("severity")))
    own = corpus.generated(df, F.concat(*map(kinds, ("correctness", "security", "performance", "style"))), "name", "copies")
    return own.groupBy("name", "agent", "type", "severity").agg(F.sum("copies").alias("n"))


@query("snippet_facts", snippets.FACTS_ORACLE)
def snippet_facts(spark, sf_dir):
    """What the same programs measure."""
    df = plan.with_text(facts.with_facts(plan.prepared(snippets.distinct(table(spark, sf_dir, "part")), Settings())))
    f = F.col("facts")
    context = performance.code_context(F.col("is_patch_context"), F.col("n_non_blank"))
    means = correctness.semantics(f)
    whole = {"functions": f["functions"], "classes": f["classes"], "cyclomatic": f["cyclomatic"], "cognitive": f["worst"]["cognitive"], "depth": f["depth"], "concerns": f["concerns"], "refactorings": f["refactorings"]}
    shares = {
        "exception_coverage": f["exception_coverage"], "input_validation": f["input_validation"], "resource_safety": f["resource_safety"], "logic": means["logic"], "clarity": means["clarity"],
        "edge": means["edge"], "risk": performance.scale_risk(f, context), "docs": style.docs_coverage(f),
    }
    names = {"context": context, "time_class": performance.time_class(f), "space_class": performance.space_class(f), "pattern": performance.algorithm_pattern(F.col("code_lower"))}
    columns = {k: c.cast("long") for k, c in whole.items()} | {k: F.round(c, 4) for k, c in shares.items()} | names
    return df.groupBy("name", *[c.alias(k) for k, c in columns.items()]).agg(F.sum("n").alias("n"))


@query("line_rules_templated", templates.LINE_RULES_ORACLE)
def line_rules_templated(spark, sf_dir):
    samples = templates.risky_lines(sources.spread(table(spark, sf_dir, "part")))
    df = plan.with_text(plan.prepared(samples, Settings()))
    found = F.flatten(F.array(*[security.line_rule_issues(r, F.col("lines"), F.col("code"), F.col("code_lower")) for r in R.LINE_RULES]))
    return df.select(F.explode(found).alias("i")).groupBy(F.col("i.type").alias("rule"), F.col("i.severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("i.confidence"), 4).alias("confidence"))


@query("templated_verdicts")
def templated_verdicts(spark, sf_dir):
    """Whole reports of the templated programs: held against a Python model in the tests."""
    return plan.verify(_templated(spark, sf_dir)).select(F.col("sample_id").alias("p_partkey"), "score", "verdict", "grade", F.col("n.total").alias("issues"))


@query("latest_verdicts", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_verdicts(spark, sf_dir):
    """The last entry of each history."""
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
