"""Report: enrichment, cross-agent compounds, clustering, score, verdict, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from probatio.functions import text as T
from probatio.model import CRITICAL, HIGH, ISSUES, LOW, MEDIUM, count_severity, count_type_like, issue, issue_if, join_issues, no_issues, rank
from probatio.operators import rules as R

JOINED = ("compound_vulnerability", "security_cascade")
GRADES = ((0.95, "A+ (Enterprise Ready)"), (0.90, "A (Production Ready)"), (0.85, "A- (Minor Concerns)"), (0.75, "B+ (Needs Review)"), (0.65, "B (Multiple Issues)"), (0.50, "C (Major Rework)"), (0.30, "D (Deployment Blocked)"))


def adjusted(agent: str, i: Column, secrets_found: Column | None, mode: str) -> Column:
    """Severity of an agent's issue in the context of the whole sample."""
    kind, severity, message = i["type"], i["severity"], F.lower(i["message"])
    raised = F.when(severity == MEDIUM, HIGH).otherwise(severity)
    if agent == "security":
        many = secrets_found > 2 if secrets_found is not None else F.lit(False)
        secret = F.when(severity == HIGH, CRITICAL).otherwise(HIGH)
        if mode == "intended":  # a critical secret stays critical
            secret = F.when(severity == CRITICAL, CRITICAL).otherwise(secret)
        return (
            F.when(kind.contains("weak_hash") & message.contains("auth"), CRITICAL)
            .when(kind.contains("sql") & T.contains_any(message, ("user", "auth", "login", "password")), CRITICAL)
            .when(kind.contains("secret") & many, secret)
            .otherwise(severity)
        )
    if agent == "performance":
        return (
            F.when(kind.contains("complexity") & T.contains_any(message, ("sort", "search", "find", "query")), CRITICAL)
            .when(kind.contains("memory") | kind.contains("resource"), raised)
            .otherwise(severity)
        )
    if agent == "correctness":
        return F.when(message.contains("exception") | message.contains("error"), raised).otherwise(severity)
    return severity


def enriched(agent: str, issues: Column, secrets_found: Column | None, mode: str) -> Column:
    return F.transform(
        issues, lambda i: issue(i["type"], adjusted(agent, i, secrets_found, mode), i["message"], i["line_number"], i["suggestion"], i["confidence"], agent)
    )


def compounds(issues: Column) -> Column:
    """Cross-agent compounds; their source is the aggregator."""
    kinds = F.transform(issues, lambda i: i["type"])
    parts = [
        issue_if(F.array_contains(kinds, a) & F.array_contains(kinds, b), issue("compound_vulnerability", CRITICAL, f"Compound: {a} with {b} (x{m})", None, f"Fix both {a} and {b} at once", 0.95, "aggregator"))
        for a, b, m in R.REPORT_COMPOUNDS
    ]

    def of(severity: str) -> Column:
        return F.exists(issues, lambda i: (i["agent_source"] == "security") & (i["severity"] == severity))

    parts.append(issue_if(of(CRITICAL) & of(HIGH), issue("security_cascade", CRITICAL, "Critical and high security findings together", None, "Fix the findings together", 1.0, "aggregator")))
    return join_issues(*parts)


def clustered(issues: Column, mode: str = "intended") -> Column:
    """Issues of one type, line, agent and severity merged, then ordered.

    The order is by severity rank, blocker priority and line, all descending,
    and stable. A merged issue gains confidence; in compat mode it loses its
    source.
    """

    def key(i: Column) -> Column:
        line = F.when(i["line_number"] != 0, i["line_number"])
        return F.struct(i["type"], line, i["agent_source"], i["severity"])

    keyed = F.transform(issues, lambda i, at: F.struct(key(i).alias("key"), at.alias("at"), i.alias("issue")))

    def merge(rows: Column) -> Column:
        # Sorted by key, then position: equal keys are neighbours, first one first.
        ordered = F.array_sort(rows, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))

        def pick(s: Column) -> Column:
            def of(x: Column, k: Column) -> Column:
                first = (k == 0) | ~x["key"].eqNullSafe(F.get(s, k - 1)["key"])
                merged = x["key"].eqNullSafe(F.get(s, k + 1)["key"])
                i = x["issue"]
                agents = F.when(F.lit(mode) == "compat", 1).otherwise(1)
                one = issue(
                    i["type"], i["severity"], i["message"], i["line_number"], i["suggestion"],
                    F.when(merged, F.least(F.lit(1.0), i["confidence"] + 0.1 * agents)).otherwise(i["confidence"]),
                    F.when(merged & (F.lit(mode) == "compat"), F.lit(None).cast("string")).otherwise(i["agent_source"]),
                )
                return F.when(first, F.struct(one.alias("issue"), x["at"].alias("at")))

            return F.filter(F.transform(s, of), lambda r: r.isNotNull())

        return T.let(ordered, pick)

    def order(rows: Column) -> Column:
        table = F.create_map(*[F.lit(x) for pair in R.BLOCKERS.items() for x in pair])
        sortable = F.transform(
            rows,
            lambda r: F.struct(
                (-rank(r["issue"]["severity"])).alias("s"),
                (-F.coalesce(F.try_element_at(table, r["issue"]["type"]), F.lit(10))).alias("p"),
                (-F.coalesce(r["issue"]["line_number"], F.lit(0))).alias("l"),
                r["at"].alias("at"),
                r["issue"].alias("issue"),
            ),
        )
        return F.transform(F.array_sort(sortable), lambda r: r["issue"])

    return F.when(F.size(issues) == 0, no_issues()).otherwise(T.let(keyed, lambda rows: T.let(merge(rows), order))).cast(ISSUES)


def base_score(scores: dict[str, Column]) -> Column:
    """Weighted mean over the given agents, capped where security fails."""
    if not scores:
        return F.lit(0.0)
    total = sum(R.AGENT_WEIGHTS.get(a, 0.25) for a in scores)
    mean = reduce(lambda x, y: x + y, [s * R.AGENT_WEIGHTS.get(a, 0.25) for a, s in scores.items()]) / total
    return F.when(scores["security"] < 0.4, F.least(mean, F.lit(0.6))).otherwise(mean) if "security" in scores else mean


def overall_score(base: Column, critical: Column, high: Column, joined: Column, failed: Column | int = 0) -> Column:
    """The base score under the caps of severe findings; ``least`` passes over caps that do not apply."""
    failed = F.lit(failed) if isinstance(failed, int) else failed
    capped = F.least(
        base,
        F.when(critical > 0, 1.0 - (0.6 + (critical - 1) * 0.2)),
        F.when(high >= 3, 0.4).when(high == 2, 0.6).when(high == 1, 0.8),
        F.when(joined > 0, 0.3),
    )
    return F.round(F.greatest(F.lit(0.0), capped - 0.15 * failed), 3)


def verdict(score: Column, critical: Column, high: Column, joined: Column, blocking: Column, min_score: float = 0.85) -> Column:
    """``blocking``: high issues of security or correctness."""
    return (
        F.when((critical > 0) | (joined > 0) | (high >= 3), "FAIL")
        .when(high == 2, "WARNING")
        .when(score >= min_score, F.when(high >= 1, "WARNING").otherwise("PASS"))
        .when(score >= 0.70, "WARNING")
        .otherwise(F.when(blocking > 0, "FAIL").otherwise("WARNING"))
    )


def counts(issues: Column) -> dict[str, Column]:
    return {
        "critical": count_severity(issues, CRITICAL),
        "high": count_severity(issues, HIGH),
        "medium": count_severity(issues, MEDIUM),
        "low": count_severity(issues, LOW),
        "joined": F.size(F.filter(issues, lambda i: i["type"].isin(*JOINED))),
        "blocking": F.size(F.filter(issues, lambda i: (i["severity"] == HIGH) & i["agent_source"].isin("security", "correctness"))),
        "total": F.size(issues),
    }


def grade(score: Column) -> Column:
    out = F.lit("F (Critical Failures)")
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def code_stats(lines: Column, code: Column) -> Column:
    kept = T.non_blank(lines)
    comments = F.size(F.filter(lines, lambda x: T.strip(x).startswith("#")))
    return F.struct(
        F.size(lines).alias("total_lines"),
        F.size(kept).alias("non_empty_lines"),
        comments.alias("comment_lines"),
        (F.size(lines) - F.size(kept)).alias("blank_lines"),
        F.when(F.size(kept) > 0, comments / F.size(kept)).otherwise(0.0).alias("comment_ratio"),
        F.length(code).alias("characters"),
        F.when(F.size(lines) > 0, F.aggregate(lines, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)) / F.size(lines)).otherwise(0.0).alias("avg_line_length"),
    )


def count_map(values: Column) -> Column:
    return F.map_from_entries(F.transform(F.array_distinct(values), lambda k: F.struct(k, F.size(F.filter(values, lambda v: v == k)).cast("long"))))


def issue_summary(issues: Column) -> Column:
    kinds = F.transform(issues, lambda i: i["type"])
    return F.struct(
        F.size(issues).alias("total"),
        count_map(F.transform(issues, lambda i: i["severity"])).alias("by_severity"),
        count_map(kinds).alias("by_type"),
        F.size(F.array_distinct(kinds)).alias("unique_types"),
        count_type_like(issues, "compound").alias("compound_vulnerabilities"),
    )


def risk_level(critical: Column, high: Column) -> Column:
    return F.when(critical > 0, "CRITICAL").when(high >= 2, "HIGH").when(high == 1, "MEDIUM").otherwise("LOW")


def enterprise_metrics(issues: Column, scores: dict[str, Column], critical: Column, high: Column) -> Column:
    bad_security = F.exists(issues, lambda i: (i["agent_source"] == "security") & (i["severity"] == CRITICAL))
    complex_code = F.exists(issues, lambda i: (i["agent_source"] == "performance") & i["type"].contains("complexity"))
    posture = F.when(bad_security, 0.2).otherwise(scores["security"]) if "security" in scores else F.lit(0.0)
    scaling = F.when(complex_code, F.greatest(F.lit(0.3), scores["performance"] - 0.4)).otherwise(scores["performance"]) if "performance" in scores else F.lit(0.0)
    level = risk_level(critical, high)
    readiness = F.when((level == "LOW") & (posture > 0.8), 0.9).when(level == "MEDIUM", 0.6).when(level == "HIGH", 0.3).otherwise(0.1)
    return F.struct(posture.alias("security_posture"), scaling.alias("scalability"), level.alias("deployment_risk"), readiness.alias("production_readiness"))


def readiness(issues: Column, score: Column, critical: Column, high: Column) -> Column:
    from_security = F.size(F.filter(issues, lambda i: i["agent_source"] == "security"))
    state = F.when((critical == 0) & (high == 0) & (score >= 0.9), "READY").when((critical == 0) & (high <= 1) & (score >= 0.8), "CONDITIONAL").otherwise("BLOCKED")
    return F.struct(
        state.alias("deployment_readiness"),
        F.when(state == "CONDITIONAL", "MEDIUM").otherwise("HIGH").alias("confidence"),
        F.when(from_security > 2, "HIGH").when(from_security > 0, "MEDIUM").otherwise("LOW").alias("security_risk_level"),
    )


def top_types(issues: Column, n: int = 5) -> Column:
    """The most frequent types, ties in the order of first appearance."""
    kinds = F.array_distinct(F.transform(issues, lambda i: i["type"]))

    def of(k: Column, at: Column) -> Column:
        own = F.filter(issues, lambda i: i["type"] == k)
        worst = F.array_max(F.transform(own, lambda i: rank(i["severity"])))
        mean = F.aggregate(own, F.lit(0.0), lambda acc, i: acc + i["confidence"]) / F.size(own)
        return F.struct((-F.size(own)).alias("order"), at.alias("at"), k.alias("type"), F.size(own).alias("count"), F.element_at(F.array(*map(F.lit, (LOW, MEDIUM, HIGH, CRITICAL))), worst).alias("worst_severity"), F.round(mean, 2).alias("avg_confidence"))

    return F.transform(F.slice(F.array_sort(F.transform(kinds, of)), 1, n), lambda t: F.struct(t["type"].alias("type"), t["count"].alias("count"), t["worst_severity"].alias("worst_severity"), t["avg_confidence"].alias("avg_confidence")))


def recommendations(issues: Column, scores: dict[str, Column], critical: Column, high: Column) -> Column:
    severe = F.concat(F.filter(issues, lambda i: i["severity"] == CRITICAL), F.filter(issues, lambda i: i["type"].contains("compound")))
    texts = F.transform(F.filter(F.slice(severe, 1, 3), lambda i: i["suggestion"].isNotNull()), lambda i: F.concat(F.lit("- "), i["suggestion"]))
    none = F.array().cast("array<string>")
    from_security = F.size(F.filter(issues, lambda i: i["agent_source"] == "security"))
    slow = scores["performance"] < 0.6 if "performance" in scores else F.lit(False)
    said = F.flatten(
        F.array(
            F.when(F.size(severe) > 0, F.concat(F.array(F.lit("Blocked: resolve critical findings first")), texts)).otherwise(none),
            F.when(from_security >= 2, F.array(*map(F.lit, ("Security first: several findings", "- Review security as a whole", "- Test security in the build")))).otherwise(none),
            F.when(slow, F.array(*map(F.lit, ("Scaling risk: performance findings", "- Load-test with real volumes", "- Improve the algorithms")))).otherwise(none),
            F.when((critical == 0) & (high == 0), F.array(*map(F.lit, ("Ready: meets the deployment standard", "Next: monitoring and alerts")))).otherwise(none),
        )
    )
    return F.slice(said, 1, 8)


def agent_status(scores: dict[str, Column], issues: dict[str, Column]) -> Column:
    rows = [
        F.struct(F.lit(a).alias("agent"), F.when(s >= (0.85 if a == "security" else 0.80), "PASS").otherwise("FAIL").alias("status"), s.alias("score"), F.size(issues[a]).alias("issues_found"))
        for a, s in scores.items()
    ]
    return F.array(*rows)


def key_findings(critical: Column, high: Column, compound: Column, total: Column) -> Column:
    return F.filter(
        F.array(
            F.when(compound > 0, F.concat(compound.cast("string"), F.lit(" compound findings"))),
            F.when(critical > 0, F.concat(critical.cast("string"), F.lit(" critical blockers"))),
            F.when(high > 0, F.concat(high.cast("string"), F.lit(" high risks"))),
            F.when(total == 0, F.lit("No blockers")),
        ),
        lambda x: x.isNotNull(),
    )
