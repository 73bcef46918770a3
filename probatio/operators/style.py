"""Style agent: layout, documentation, maintainability, readability, architecture, score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from probatio.functions import text as T
from probatio.model import HIGH, LOW, MEDIUM, issue, issue_if, join_issues, penalty
from probatio.operators import rules as R

MAX_LINE = 88
MIN_DOCS = 0.8


def long_lines(lines: Column, most: int = MAX_LINE) -> Column:
    return F.size(F.filter(lines, lambda x: F.length(x) > most))


def odd_indents(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda x: (T.strip(x) != "") & (T.indent(x) % 4 != 0)))


def spacing_issues(code: Column, marked: bool = False) -> Column:
    def of(regex: str, parts: tuple[str, ...]) -> Column:
        found = T.contains_any(code, parts, marked)
        if regex.endswith("$"):
            found = found | F.substring(code, -1, 1).isin(*R.BLANK)
        # Plain searches come first: most texts hold no match of most patterns.
        return F.when(found, F.regexp_count(code, F.lit(T.pattern(regex, multiline=True)))).otherwise(0)

    counts = [of(*pair) for pair in zip(R.SPACING, R.SPACING_PARTS, strict=True)]
    return sum(counts[1:], counts[0])


def formatting_score(spacing: Column, n_lines: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - spacing / F.greatest(n_lines, F.lit(1)) * 2)


def import_score(facts: Column) -> Column:
    placed = F.when(facts["imports_late"], 0.0).otherwise(0.3)
    ordered = F.when(facts["imports_sorted"], 0.2).otherwise(0.0)
    late = F.when(facts["imports_late"], 0.4).otherwise(0.0)
    return F.when(facts["parse_status"] != "ok", 0.5).when(facts["imports"] == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + placed + ordered - late)))


def duplication_score(lines: Column) -> Column:
    """1 less the share of lines in three-line runs that occur again further on."""
    kept = F.filter(F.transform(lines, T.strip), lambda x: x != "")

    def of(own: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(own) - 3), lambda i: F.struct(F.concat_ws(" ", own[i], own[i + 1], own[i + 2]).alias("run"), i.alias("at")))
        # Sorted by run, then position: the last of each run lies behind its equals.
        ordered = F.sort_array(runs)

        def repeated(s: Column) -> Column:
            back = F.reverse(s)
            start = F.struct(F.lit(None).cast("string").alias("run"), F.lit(0).alias("last"), F.lit(0).alias("n"))
            step = lambda acc, x: F.when(
                acc["run"] == x["run"],
                F.struct(acc["run"].alias("run"), acc["last"].alias("last"), (acc["n"] + F.when((x["at"] + 3 <= acc["last"]) & (x["at"] < F.size(own) - 3), 1).otherwise(0)).alias("n")),
            ).otherwise(F.struct(x["run"].alias("run"), x["at"].alias("last"), acc["n"].alias("n")))
            return F.aggregate(back, start, step, lambda acc: acc["n"])

        return F.when(F.size(own) < 4, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - 3 * T.let(ordered, repeated) / F.size(own)))

    return T.let(kept, of)


def test_hints(code: Column, marked: bool = False) -> Column:
    counts = [F.when(T.contains(code, part, marked), F.regexp_count(code, F.lit(p))).otherwise(0) for p, part in zip(R.TEST_HINTS, R.HINT_PARTS, strict=True)]
    return sum(counts[1:], counts[0])


def docs_coverage(facts: Column) -> Column:
    return F.when(facts["parse_status"] != "ok", 0.0).otherwise((facts["doc_functions"] + facts["doc_classes"] + facts["doc_modules"]) / (facts["functions"] + facts["classes"] + 1))


def comment_density(facts: Column, lines: Column) -> Column:
    total = F.size(T.non_blank(lines))
    comments = F.size(F.filter(lines, lambda x: T.strip(x).startswith("#")))
    return F.when((facts["parse_status"] != "ok") | (total == 0), 0.0).otherwise(comments / total)


def maintainability_index(facts: Column, code: Column, n_non_blank: Column) -> Column:
    branches = F.greatest(F.lit(1), sum((T.count_of(code, w) for w in ("for", "while", "except", "elif")), T.count_of(code, "if")))
    volume = F.when(facts["halstead"] <= 0, 1.0).otherwise(facts["halstead"])
    index = 171 - 5.2 * F.ln(volume) - 0.23 * branches - 16.2 * F.ln(n_non_blank.cast("double"))
    return F.when(facts["parse_status"] != "ok", 0.0).when(n_non_blank == 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), index)))


def naming_score(names: Column, convention: str, short_fail: bool) -> Column:
    regex = F.lit(R.NAMING[convention])
    good = F.size(F.filter(names, lambda n: F.rlike(n, regex) & ((F.length(n) > 1) if short_fail else F.lit(True))))
    return F.when(F.size(names) == 0, 1.0).otherwise(good / F.size(names))


def consistency(lines: Column, code: Column) -> Column:
    mixed = F.when(code.contains("'") & code.contains('"'), 0.7).otherwise(1.0)
    indents = F.filter(F.transform(F.filter(lines, lambda x: T.strip(x) != ""), T.indent), lambda n: n > 0)

    def even(own: Column) -> Column:
        return F.when(F.size(own) == 0, 1.0).otherwise(T.let(F.array_min(own), lambda least: 1.0 - F.size(F.filter(own, lambda n: n % least != 0)) / F.size(own)))

    return (mixed + T.let(indents, even)) / 2


def readability(facts: Column, lines: Column, code: Column) -> Column:
    ok = facts["parse_status"] == "ok"

    def of(value: Column) -> Column:
        return F.when(ok, value).otherwise(0.5)

    short = F.when(facts["names"] > 0, facts["short_names"] / facts["names"] * 0.3).otherwise(0.0)
    clarity = F.greatest(F.lit(0.0), 1.0 - short - F.least(facts["magic"] * 0.1, F.lit(0.3)))
    structure = F.when(facts["functions"] > 0, F.greatest(F.lit(0.0), 1.0 - facts["order_breaks"] / facts["functions"] * 0.2)).otherwise(1.0)
    return F.struct(
        of(naming_score(facts["variables"], "snake_case", False)).alias("variable_naming"),
        of(naming_score(facts["function_names"], "snake_case", True)).alias("function_naming"),
        of(naming_score(facts["class_names"], "PascalCase", True)).alias("class_naming"),
        of(clarity).alias("code_clarity"),
        of(structure).alias("logical_structure"),
        of(consistency(lines, code)).alias("consistency"),
    )


def metrics(facts: Column, lines: Column, code: Column, n_lines: Column, n_non_blank: Column, spacing: Column, most: int = MAX_LINE, marked: bool = False) -> Column:
    """``spacing``: a column that holds ``spacing_issues``, as it is used twice."""
    return F.struct(
        long_lines(lines, most).alias("long_lines"),
        odd_indents(lines).alias("odd_indents"),
        spacing.alias("spacing"),
        import_score(facts).alias("imports"),
        formatting_score(spacing, n_lines).alias("formatting"),
        docs_coverage(facts).alias("docs"),
        comment_density(facts, lines).alias("comments"),
        maintainability_index(facts, code, n_non_blank).alias("maintainability"),
        F.when(facts["parse_status"] == "ok", duplication_score(lines)).otherwise(1.0).alias("duplication"),
        test_hints(code, marked).alias("test_hints"),
        readability(facts, lines, code).alias("readability"),
    )


def found_issues(m: Column, facts: Column) -> Column:
    some = facts["functions"] + facts["classes"] > 0
    bare_functions = facts["functions"] - facts["doc_functions"]
    bare_classes = facts["classes"] - facts["doc_classes"]

    def low(condition: Column, kind: str, about: str) -> Column:
        return issue_if(condition, issue(kind, LOW, about, None, "Tidy up"))

    def banded(kind: str, high: Column, medium: Column) -> Column:
        return issue_if(high | medium, issue(kind, F.when(high, HIGH).otherwise(MEDIUM), f"Poor {kind.replace('_', ' ')}", None, "Simplify"))

    sized = F.filter(facts["sites"], lambda s: s["rule"].isin("srp_violation", "god_function", "deep_inheritance"))
    return join_issues(
        low(m["long_lines"] > 0, "line_length", "Long lines"),
        low(m["odd_indents"] > 0, "indentation", "Uneven indentation"),
        low(m["spacing"] > 0, "spacing", "Uneven spacing"),
        low(m["imports"] < 0.7, "import_organization", "Imports out of order"),
        low(m["formatting"] < 0.8, "code_formatting", "Poor formatting"),
        issue_if(some & (m["docs"] < MIN_DOCS), issue("docstring_coverage", F.when(m["docs"] < 0.3, MEDIUM).otherwise(LOW), "Few docstrings", None, "Document")),
        low(some & (bare_functions > 0), "missing_docstrings", "Functions without docstrings"),
        low(some & (bare_classes > 0), "missing_docstrings", "Classes without docstrings"),
        low(some & (m["comments"] < 0.1), "comment_density", "Few comments"),
        banded("maintainability_index", m["maintainability"] < 50, m["maintainability"] < 70),
        banded("halstead_complexity", facts["halstead"] > 500, facts["halstead"] > 200),
        issue_if(m["duplication"] < 0.8, issue("code_duplication", MEDIUM, "Repeated blocks", None, "Extract a function")),
        issue_if(facts["concerns"] > 0, issue("architectural_concerns", MEDIUM, "Oversized parts", None, "Split")),
        low(facts["refactorings"] > 0, "refactoring_opportunities", "Long chains or deep loops"),
        *(low(m["readability"][n] < (0.7 if n == "code_clarity" else 0.8), n, f"Poor {n.replace('_', ' ')}") for n in ("variable_naming", "function_naming", "class_naming", "code_clarity", "logical_structure", "consistency")),
        F.transform(sized, lambda s: issue(s["rule"], F.when(s["rule"] == "god_function", HIGH).otherwise(MEDIUM), F.concat(F.lit("Oversized: "), s["name"]), s["line"], "Split")),
    )


def score(issues: Column, m: Column, facts: Column) -> Column:
    plain = (m["long_lines"] == 0) & (facts["functions"] == 0) & (facts["classes"] == 0)
    docs = F.when(m["docs"] > 0.8, 0.15 * m["docs"]).otherwise(0.0)
    upkeep = F.when(m["maintainability"] > 80, 0.1 * ((m["maintainability"] - 80) / 20)).otherwise(0.0)
    base = F.greatest(F.lit(0.0), 1.0 - F.least(penalty(issues, R.STYLE_WEIGHTS, 0.5, R.STYLE_FACTORS) / 5.0, F.lit(1.0)))
    return F.when((F.size(issues) == 0) | plain, 1.0).otherwise(F.least(F.lit(1.0), base + docs + upkeep))
