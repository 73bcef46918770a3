"""Correctness agent: issues of tree metrics, sites, semantics and (static) execution; score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from probatio.functions import text as T
from probatio.model import CRITICAL, HIGH, LOW, MEDIUM, issue, issue_if, join_issues, penalty
from probatio.operators import rules as R

SITE_RULES = {
    "missing_exception_handling": ("missing_exception_handling", HIGH, "Risky calls without exception handling in "),
    "bare_except": ("bare_except", HIGH, "Bare except hides every error"),
    "empty_exception_handler": ("empty_exception_handler", MEDIUM, "Exception handler that does nothing, errors need logging"),
    "missing_input_validation": ("missing_input_validation", MEDIUM, "Parameters are not validated in "),
    "resource_leak_risk": ("resource_leak_risk", HIGH, "Resource without cleanup: "),
    "missing_none_case": ("missing_edge_case", MEDIUM, "None is not handled in "),
    "missing_empty_case": ("missing_edge_case", MEDIUM, "Empty collections are not handled in "),
    "contract_raises": ("contract_violation", MEDIUM, "Documented exceptions are never raised in "),
    "contract_returns": ("contract_violation", MEDIUM, "Documented return value is never returned in "),
}


def parsed(facts: Column) -> Column:
    return facts["parse_status"] == "ok"


def semantics(facts: Column) -> Column:
    """Logic, clarity and edge-case scores, and their mean before flooring."""
    ok = parsed(facts)
    logic = F.when(ok, 1.0 - 0.1 * facts["open_ifs"]).otherwise(0.5)
    clarity = F.when(ok, 1.0 - 0.1 * (facts["chained"] + facts["long_bools"])).otherwise(0.5)
    edge = F.when(ok & (facts["functions"] > 0), facts["edge_functions"] / facts["functions"]).otherwise(0.8)
    return F.struct(
        F.greatest(F.lit(0.0), logic).alias("logic"),
        F.greatest(F.lit(0.0), clarity).alias("clarity"),
        edge.alias("edge"),
        ((logic + clarity + edge) / 3).alias("readiness"),
    )


def is_dangerous(code: Column, marked: bool = False) -> Column:
    imports = [w for w in R.DANGEROUS_TEXT if w.startswith("import ")]
    return (code.contains("import ") & T.contains_any(code, imports)) | T.contains_any(code, [w for w in R.DANGEROUS_TEXT if w not in imports], marked)


def found_issues(facts: Column, means: Column, dangerous: Column, n_non_blank: Column) -> Column:
    """``dangerous``: a column that holds ``is_dangerous``, as it is used several times."""
    simple = n_non_blank < 30
    ok = parsed(facts)
    noted = F.transform(
        facts["potential"],
        lambda p: issue(
            "ast_analysis",
            F.when(p["kind"] == "syntax", CRITICAL)
            .when(p["kind"].isin("endless", "open_file"), HIGH)
            .when(F.lower(p["message"]).contains("production") & ~simple, HIGH)
            .otherwise(LOW),
            p["message"],
            None,
            "Resolve before deployment",
        ),
    )

    def of_site(s: Column) -> Column:
        out = F.lit(None)
        for rule, (kind, severity, about) in SITE_RULES.items():
            out = F.when(s["rule"] == rule, issue(kind, severity, F.concat(F.lit(about), F.coalesce(s["name"], F.lit(""))), s["line"], "Handle the case explicitly")).otherwise(out)
        return out

    at_sites = F.filter(F.transform(F.filter(facts["sites"], lambda s: s["rule"].isin(*SITE_RULES)), of_site), lambda i: i.isNotNull())

    def banded(kind: str, value: Column) -> Column:
        level = F.when(value < 0.7, HIGH).otherwise(MEDIUM)
        return issue_if(value < 0.8, issue(kind, level, F.concat(F.lit(f"Low {kind.replace('_', ' ')}: "), F.format_string("%.2f", value)), None, "Review the logic"))

    bugs = F.when(
        ok, F.transform(F.array_repeat(F.lit(1), facts["open_ifs"]), lambda _: issue("potential_bug", HIGH, "Decision without an else branch", None, "Add the missing branch"))
    ).otherwise(F.array(issue("potential_bug", HIGH, "Unparsable text hides bugs", None, "Add the missing branch")))
    return join_issues(
        issue_if(facts["cyclomatic"] > 15, issue("complexity", F.when(simple, MEDIUM).otherwise(HIGH), F.concat(F.lit("Cyclomatic complexity "), facts["cyclomatic"].cast("string")), None, "Split the function")),
        issue_if((facts["exception_coverage"] < 0.8) & ~simple, issue("exception_coverage", HIGH, "Few functions handle exceptions", None, "Handle exceptions")),
        noted,
        at_sites,
        banded("logic", means["logic"]),
        banded("edge_case_coverage", means["edge"]),
        issue_if(means["readiness"] < 0.8, issue("production_readiness", HIGH, F.concat(F.lit("Readiness "), F.format_string("%.2f", means["readiness"])), None, "Fix correctness first")),
        bugs,
        # Samples are never run: what does not compile fails, what looks dangerous is set aside.
        issue_if(dangerous | ~ok, issue("execution", F.when(dangerous, MEDIUM).otherwise(HIGH), F.when(dangerous, "Dangerous operations: not executed").otherwise("Execution failed: syntax error"), None, "Review by hand")),
    )


def score(issues: Column, facts: Column) -> Column:
    base = F.greatest(F.lit(0.3), 1.0 - F.least(penalty(issues, R.CORRECTNESS_WEIGHTS, 0.6, R.CORRECTNESS_FACTORS) / 6.0, F.lit(1.0)))
    bonus = F.when(facts["exception_coverage"] > 0.9, 0.1).otherwise(0.0) + F.when(facts["input_validation"] > 0.8, 0.05).otherwise(0.0) + F.when(facts["resource_safety"] > 0.9, 0.1).otherwise(0.0)
    return F.when(F.size(issues) == 0, 1.0).otherwise(F.least(F.lit(1.0), base + bonus))
