"""Types of issues, agent results and reports, and builders of issue columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AGENTS = ("correctness", "security", "performance", "style")
SEVERITIES = ("low", "medium", "high", "critical")
LOW, MEDIUM, HIGH, CRITICAL = SEVERITIES
ISSUE = "struct<type:string,severity:string,message:string,line_number:int,suggestion:string,confidence:double,agent_source:string>"
ISSUES = f"array<{ISSUE}>"


def text(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def issue(kind, severity, message, line=None, suggestion=None, confidence=1.0, source=None) -> Column:
    """One issue; every part may be a value or a column."""
    return F.struct(
        text(kind).cast("string").alias("type"),
        text(severity).cast("string").alias("severity"),
        text(message).cast("string").alias("message"),
        text(line).cast("int").alias("line_number"),
        text(suggestion).cast("string").alias("suggestion"),
        text(confidence).cast("double").alias("confidence"),
        text(source).cast("string").alias("agent_source"),
    )


def no_issues() -> Column:
    return F.array().cast(ISSUES)


def issue_if(condition: Column, one: Column) -> Column:
    return F.when(condition, F.array(one).cast(ISSUES)).otherwise(no_issues())


def join_issues(*parts: Column) -> Column:
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def rank(severity: Column) -> Column:
    """1 for low to 4 for critical, 0 for anything else."""
    return reduce(lambda acc, k: F.when(severity == SEVERITIES[k], k + 1).otherwise(acc), range(4), F.lit(0))


def severity_of(ranked: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), ranked)


def count_severity(issues: Column, severity: str) -> Column:
    return F.size(F.filter(issues, lambda i: i["severity"] == severity))


def count_type_like(issues: Column, part: str) -> Column:
    return F.size(F.filter(issues, lambda i: i["type"].contains(part)))


def weight_of(kind: Column, weights: dict[str, float], default: float) -> Column:
    """A dictionary lookup with a default, as a map literal."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(default))


def penalty(issues: Column, weights: dict[str, float], default: float, factors: dict[str, float]) -> Column:
    """Sum of type weight times severity factor, in emission order."""
    return F.aggregate(issues, F.lit(0.0), lambda acc, i: acc + weight_of(i["type"], weights, default) * weight_of(i["severity"], factors, 0.0))


def severity_score(issues: Column) -> Column:
    """Generic score: 1 less the mean severity weight; 1 without issues."""
    total = F.aggregate(issues, F.lit(0.0), lambda acc, i: acc + weight_of(i["severity"], {"low": 0.1, "medium": 0.3, "high": 0.7, "critical": 1.0}, 0.0))
    return F.when(F.size(issues) == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - total / F.size(issues)))
