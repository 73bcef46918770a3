"""Performance agent: context, complexity classes, algorithm analysis, text patterns, score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from probatio.functions import text as T
from probatio.model import HIGH, MEDIUM, issue, issue_if, join_issues, no_issues, penalty
from probatio.operators import rules as R

PATCH, SNIPPET, FULL = "patch_context", "snippet_context", "full_file"
PATTERNS = (
    ("sorting", ("sort", "order")),
    ("searching", ("search", "find", "lookup")),
    ("traversal", ("traverse", "walk", "iterate")),
    ("filtering", ("filter", "select", "where")),
    ("processing", ("process", "transform", "convert")),
)


def code_context(is_patch: Column, n_non_blank: Column) -> Column:
    return F.when(is_patch, PATCH).when(n_non_blank < 30, SNIPPET).when(n_non_blank < 100, PATCH).otherwise(FULL)


def by_context(context: Column, table: dict) -> Column:
    return F.when(context == PATCH, table[PATCH]).when(context == SNIPPET, table.get(SNIPPET, table[FULL])).otherwise(table[FULL])


def loop_class(facts: Column) -> Column:
    depth = facts["worst"]["loop_depth"]
    return F.when(facts["parse_status"] != "ok", "O(?)").when(depth == 0, "O(1)").when(depth == 1, "O(n)").when(depth == 2, "O(n²)").otherwise("O(n³)")


def scale_risk(facts: Column, context: Column) -> Column:
    worst = facts["worst"]
    base = F.when(worst["loop_depth"] == 0, 0.0).when(worst["loop_depth"] == 1, 0.1).when(worst["loop_depth"] == 2, 0.4).otherwise(0.7)
    loops = F.least(F.lit(0.1), worst["loops"] * 0.03)
    length = F.least(F.lit(0.1), F.greatest(F.lit(0.0), (worst["length"] - 50) / F.lit(100.0)))
    nesting = F.least(F.lit(0.1), F.greatest(F.lit(0.0), (worst["nesting"] - 2) * 0.05))
    total = F.least(F.lit(1.0), (base + loops + length + nesting) * by_context(context, {PATCH: 0.6, SNIPPET: 0.5, FULL: 1.0}))
    return F.when(facts["parse_status"] != "ok", 0.0).otherwise(total)


def time_class(facts: Column) -> Column:
    depth = facts["depth"]
    return (
        F.when(facts["parse_status"] != "ok", "O(?)")
        .when(depth == 0, "O(1)")
        .when((depth == 1) & facts["efficient"], "O(n log n)")
        .when(depth == 1, "O(n)")
        .when(depth == 2, "O(n²)")
        .otherwise(F.concat(F.lit("O(n^"), depth.cast("string"), F.lit(")")))
    )


def space_class(facts: Column) -> Column:
    return F.when(facts["parse_status"] != "ok", "O(?)").when(facts["builds"], "O(n)").otherwise("O(1)")


def algorithm_pattern(code_lower: Column) -> Column:
    out = F.lit("general")
    for name, words in reversed(PATTERNS):
        out = F.when(T.contains_any(code_lower, words), name).otherwise(out)
    return out


def is_critical(code_lower: Column) -> Column:
    return algorithm_pattern(code_lower).isin("sorting", "searching") | T.contains_any(code_lower, ("performance", "optimization", "scale", "production"))


def suitability(time: Column, context: Column) -> Column:
    base = (
        F.when(time.isin("O(1)", "O(log n)"), "excellent")
        .when(time.isin("O(n)", "O(n log n)"), "good")
        .when(time == "O(n²)", F.when(context == FULL, "limited").otherwise("acceptable"))
        .when(time == "O(n³)", "limited")
        .when(time == "O(2^n)", "poor")
        .otherwise("acceptable")
    )
    return F.when((base == "limited") & (context != FULL), "acceptable").otherwise(base)


def suggestions(facts: Column, code_lower: Column, context: Column) -> Column:
    """Texts for the metadata; never issues."""
    pattern = algorithm_pattern(code_lower)
    wide = (context == FULL) | pattern.isin("sorting", "searching")
    return F.filter(
        F.array(
            F.when(wide & (pattern == "sorting") & code_lower.contains("bubble"), "Sort with the built-in sort"),
            F.when(wide & (pattern == "searching") & facts["search_in_loop"], "Look up in a set or dictionary"),
            F.when(facts["nested_loops"] >= 2, "Flatten nested loops"),
        ),
        lambda x: x.isNotNull(),
    )


def bubble_sort_issues(lines: Column, code: Column) -> Column:
    """A sorting pattern in the lines around each line (one before to two after)."""
    gate = code.contains("for") & code.contains("swap")

    def near(_line: Column, at: Column) -> Column:
        start = F.greatest(F.lit(0), at - 1)
        return F.array_join(F.slice(lines, start + 1, at + 3 - start), " ")

    found = F.transform(lines, lambda line, at: F.when(F.rlike(near(line, at), F.lit("(?d)for.*for.*if.*>.*swap")), issue("algorithm_inefficiency", MEDIUM, "Bubble sort", at + 1, "Use the built-in sort")))
    return F.when(gate, F.filter(found, lambda i: i.isNotNull())).otherwise(no_issues())


def concatenation_issues(lines: Column, code: Column) -> Column:
    """Text added up inside a loop of a longer sample."""
    gate = code.contains("+=") & (F.size(lines) > 20)

    def of(line: Column, at: Column) -> Column:
        start = F.greatest(F.lit(0), at - 4)
        before = F.slice(lines, start + 1, at + 1 - start)
        adds = line.contains("+=") & (line.contains('"') | line.contains("'"))
        looped = F.exists(before, lambda x: (T.indent(x) < T.indent(line)) & x.contains("for"))
        return F.when(adds & looped, issue("performance_antipattern", MEDIUM, "Text concatenated in a loop", at + 1, "Join the parts once"))

    return F.when(gate, F.filter(F.transform(lines, of), lambda i: i.isNotNull())).otherwise(no_issues())


def found_issues(facts: Column, lines: Column, code: Column, code_lower: Column, context: Column) -> Column:
    worst = facts["worst"]
    cc_warn, cc_high = by_context(context, {k: v[0] for k, v in R.CYCLOMATIC.items()}), by_context(context, {k: v[1] for k, v in R.CYCLOMATIC.items()})
    cog_high = by_context(context, {k: v[1] for k, v in R.COGNITIVE.items()})
    fit = suitability(time_class(facts), context)
    deep = F.filter(facts["loops"], lambda x: x["inner"] >= 2)
    return join_issues(
        issue_if(worst["cyclomatic"] >= cc_warn, issue("cyclomatic_complexity", F.when(worst["cyclomatic"] >= cc_high, HIGH).otherwise(MEDIUM), F.concat(F.lit("Cyclomatic complexity "), worst["cyclomatic"].cast("string")), None, "Simplify")),
        issue_if((loop_class(facts) == "O(n³)") & (context == FULL), issue("algorithm_complexity", HIGH, "Algorithm class O(n³)", None, "Use a better algorithm")),
        issue_if(worst["cognitive"] >= cog_high, issue("cognitive_complexity", MEDIUM, F.concat(F.lit("Cognitive complexity "), worst["cognitive"].cast("string")), None, "Simplify")),
        issue_if((fit == "poor") & is_critical(code_lower), issue("scale_unsuitability", HIGH, "Poor scaling of critical code", None, "Use a better algorithm")),
        issue_if((fit == "poor") & ~is_critical(code_lower), issue("scale_concern", MEDIUM, "Scaling may be poor", None, "Use a better algorithm")),
        issue_if(facts["depth"] >= 3, issue("loop_nesting", F.when(facts["depth"] >= 4, HIGH).otherwise(MEDIUM), F.concat(F.lit("Nesting depth "), facts["depth"].cast("string")), None, "Flatten the nesting")),
        # Weights are 0.8 outside patches, 0.6 (never an issue) within.
        F.when(context == PATCH, no_issues()).otherwise(F.transform(deep, lambda x: issue("performance_bottleneck", HIGH, F.concat(F.lit("Nested loops: "), (x["inner"] + 1).cast("string")), x["line"], "Flatten the loops"))),
        # Both patterns are tried line by line, in the order of the lines.
        F.array_sort(
            F.concat(bubble_sort_issues(lines, code), concatenation_issues(lines, code)),
            lambda a, b: F.when(a["line_number"] < b["line_number"], -1).when(a["line_number"] > b["line_number"], 1).when(a["type"] < b["type"], -1).when(a["type"] > b["type"], 1).otherwise(0),
        ),
        F.when(F.size(lines) > 15, F.transform(F.filter(facts["sites"], lambda s: s["rule"] == "open_unmanaged"), lambda s: issue("resource_leak_risk", MEDIUM, "File opened outside 'with'", s["line"], "Open it in a 'with'"))).otherwise(no_issues()),
    )


def may_profile(code: Column, context: Column) -> Column:
    return (context == FULL) & ~T.contains_any(code, R.UNPROFILED_TEXT)


def score(issues: Column, facts: Column, context: Column) -> Column:
    tolerance = by_context(context, {k: v[0] for k, v in R.TOLERANCE.items()})
    floor = by_context(context, {k: v[1] for k, v in R.TOLERANCE.items()})
    base = F.greatest(floor, 1.0 - F.least(penalty(issues, R.PERFORMANCE_WEIGHTS, 0.3, R.PERFORMANCE_FACTORS) / (8.0 * tolerance), F.lit(1.0)))
    bonus = F.when(scale_risk(facts, context) < 0.2, 0.1).otherwise(0.0)
    return F.when(F.size(issues) == 0, 1.0).otherwise(F.round(F.least(F.lit(1.0), base + bonus), 3))
