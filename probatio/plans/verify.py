"""The verification plan: samples -> facts -> issues and scores by agent -> report.

Everything is narrow: a sample's issues stay in arrays of its own row, so a
report needs no shuffle. Only the asked-for agents are computed.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio.config import Settings
from probatio.functions import text as T
from probatio.model import AGENTS
from probatio.operators import correctness, facts, performance, report, security, style


def prepared(samples: DataFrame, settings: Settings) -> DataFrame:
    """``sample_id``, ``code``, ``is_patch_context`` (and ``context``) with nulls settled."""
    patch = F.coalesce(F.col("is_patch_context"), F.lit(False)) if "is_patch_context" in samples.columns else F.lit(False)
    keep = [c for c in samples.columns if c not in ("code", "is_patch_context")]
    return samples.select(*keep, F.coalesce("code", F.lit("")).alias("code"), patch.alias("is_patch_context"))


def with_text(samples: DataFrame) -> DataFrame:
    """Lines and counts that many rules share, computed once."""
    out = T.materialise(samples, lines=T.split_lines(F.col("code")), code_lower=F.lower("code"))
    return T.materialise(out, n_lines=F.size("lines"), n_non_blank=F.size(T.non_blank(F.col("lines"))))


@lru_cache(maxsize=64)
def _agent_steps(agent: str, settings: Settings) -> tuple[dict[str, Column], ...]:
    """Columns of one agent in the order in which they build on each other.

    Expressions name their inputs, so they are built once for a process: building
    them costs much more than planning or running them on a small table.
    """
    f, lines, code, lower = F.col("facts"), F.col("lines"), F.col("code"), F.col("code_lower")
    if agent == "correctness":
        steps = [
            {"correctness_means": correctness.semantics(f), "__dangerous": correctness.is_dangerous(code, True)},
            {"correctness_issues": correctness.found_issues(f, F.col("correctness_means"), F.col("__dangerous"), F.col("n_non_blank"))},
            {"correctness_score": correctness.score(F.col("correctness_issues"), f)},
        ]
    elif agent == "security":
        parts = [F.col("__more"), security.compliance_issues(F.col("__more"), code, settings.word_boundary_crypto, lower)]
        if settings.check_dependencies:
            parts.append(security.dependency_issues(f))
        steps = [
            {"__found": security.found_issues(lines, code, lower, f, settings.entropy_floor, True)},
            {"__more": F.concat(F.col("__found"), security.compound_issues(F.col("__found")))},
            {"security_issues": F.concat(*parts)},
            {"security_metrics": security.metrics(F.col("security_issues"))},
            {"security_score": security.score(F.col("security_issues"), F.col("security_metrics"))},
        ]
    elif agent == "performance":
        steps = [
            {"code_context": performance.code_context(F.col("is_patch_context"), F.col("n_non_blank"))},
            {"performance_issues": performance.found_issues(f, lines, code, lower, F.col("code_context"))},
            {"performance_score": performance.score(F.col("performance_issues"), f, F.col("code_context"))},
        ]
    else:
        steps = [
            {"__spacing": style.spacing_issues(code, True)},
            {"style_metrics": style.metrics(f, lines, code, F.col("n_lines"), F.col("n_non_blank"), F.col("__spacing"), settings.max_line, True)},
            {"style_issues": style.found_issues(F.col("style_metrics"), f)},
            {"style_score": style.score(F.col("style_issues"), F.col("style_metrics"), f)},
        ]
    return tuple(T.kept_apart(s) for s in steps)


def agent_issues(df: DataFrame, settings: Settings) -> DataFrame:
    """``<agent>_issues`` and ``<agent>_score`` of each asked-for agent.

    Agents do not read each other's columns, so their steps share projections. Marks that no agent reads are pruned.
    """
    marks = T.marks(F.col("code"))
    df = T.materialise(df, **marks)
    for steps in zip_longest(*(_agent_steps(a, settings) for a in settings.agents), fillvalue={}):
        df = df.withColumns({name: c for own in steps for name, c in own.items()})
    return df.drop("__found", "__more", "__dangerous", "__spacing", *marks)


def failed(settings: Settings) -> Column:
    """Whether every agent fails: in compat mode, where the parser gives up."""
    return (F.col("facts.parse_status") == "parser_limit") if settings.mode == "compat" else F.lit(False)


@lru_cache(maxsize=64)
def _report_steps(agents: tuple[str, ...], settings: Settings) -> tuple[dict[str, Column], ...]:
    """Report columns in the order in which they build on each other."""
    broken = failed(settings)
    secrets = F.col("security_metrics.secrets_found") if "security" in agents else None
    parts = [report.enriched(a, F.when(broken, F.array().cast(report.ISSUES)).otherwise(F.col(f"{a}_issues")), secrets, settings.mode) for a in agents]
    n = F.col("n")
    scores = {a: F.when(broken, 0.0).otherwise(F.col(f"{a}_score")) for a in agents}
    lost = F.when(broken, len(agents)).otherwise(0)
    steps = [
        {"__own": F.flatten(F.array(*parts)) if parts else F.array().cast(report.ISSUES), "__base": report.base_score(scores)},
        {"__joined": report.compounds(F.col("__own"))},
        {"issues": report.clustered(F.concat(F.col("__own"), F.col("__joined")), settings.mode)},
        {"n": F.struct(*[c.alias(k) for k, c in report.counts(F.col("issues")).items()])},
        {"score": report.overall_score(F.col("__base"), n["critical"], n["high"], n["joined"], lost)},
        {"verdict": report.verdict(F.col("score"), n["critical"], n["high"], n["joined"], n["blocking"], settings.min_score)},
    ]
    steps = [T.kept_apart(s) for s in steps]
    if settings.mode == "compat":
        # Published runs raise on an issue without a source: verdict ERROR, score 0.
        error = F.size("__joined") > 0
        steps.append({"verdict": F.when(error, "ERROR").otherwise(F.col("verdict")), "score": F.when(error, 0.0).otherwise(F.col("score"))})
    return tuple(steps)


def with_report(df: DataFrame, agents: tuple[str, ...], settings: Settings) -> DataFrame:
    """Report columns of a subset of the agents that ``df`` holds."""
    for step in _report_steps(tuple(agents), settings):
        df = df.withColumns(step)
    return df.drop("__own", "__joined", "__base")


def analyse(samples: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Agent issues and scores of each sample."""
    return agent_issues(with_text(facts.with_facts(prepared(samples, settings))), settings)


@lru_cache(maxsize=64)
def _summaries(agents: tuple[str, ...]) -> dict[str, Column]:
    n, scores = F.col("n"), {a: F.col(f"{a}_score") for a in agents}
    return {
        "grade": report.grade(F.col("score")),
        "code_stats": report.code_stats(F.col("lines"), F.col("code")),
        "issue_summary": report.issue_summary(F.col("issues")),
        "enterprise": report.enterprise_metrics(F.col("issues"), scores, n["critical"], n["high"]),
        "assessment": report.readiness(F.col("issues"), F.col("score"), n["critical"], n["high"]),
        "top_types": report.top_types(F.col("issues")),
        "recommendations": report.recommendations(F.col("issues"), scores, n["critical"], n["high"]),
        "agent_status": report.agent_status(scores, {a: F.col(f"{a}_issues") for a in agents}),
        "findings": report.key_findings(n["critical"], n["high"], F.size(F.filter("issues", lambda i: i["type"].contains("compound"))), n["total"]),
    }


def verify(samples: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Reports: one row for each sample; agents that are not asked for stand in ``skipped_agents`` with score 1."""
    skipped = F.array(*[F.struct(F.lit(a).alias("agent"), F.lit("skipped").alias("status"), F.lit(1.0).alias("score")) for a in AGENTS if a not in settings.agents])
    reports = with_report(analyse(samples, settings), settings.agents, settings).withColumns(_summaries(settings.agents))
    return reports.withColumn("skipped_agents", skipped.cast("array<struct<agent:string,status:string,score:double>>"))
