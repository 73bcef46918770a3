"""Corpus-level operators over reports: evaluation, ablation, calibration, rollups."""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatio.functions import text as T
from probatio.model import AGENTS
from probatio.operators import report
from probatio.operators import rules as R


def first_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the first by ``order``."""
    names = [c for c in df.columns if c != key]
    # min_by keeps one row a key on the map side, so a hot key stays small.
    picked = df.groupBy(key).agg(F.min_by(F.struct(*names), order).alias("__row"))
    return picked.select(key, *[F.col("__row")[n].alias(n) for n in names]).select(*df.columns)


def tagged_union(parts: dict[str, DataFrame]) -> DataFrame:
    """Sample sets one after another with a ``source`` tag."""
    out = None
    for name, part in parts.items():
        own = part.withColumn("source", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def patch_code(patch: Column, gated: bool = True, least: int = 50) -> Column:
    """Added and context lines of a unified diff; the whole patch if they are few.

    ``gated``: only lines behind the first hunk header count.
    """

    def of(lines: Column) -> Column:
        start = F.array_position(F.transform(lines, lambda x: x.startswith("@@")), True)
        body = F.when(start == 0, F.array().cast("array<string>")).otherwise(F.slice(lines, start.cast("int"), F.size(lines))) if gated else lines
        header = lambda x: x.startswith("diff --git") | x.startswith("index ") | x.startswith("+++") | x.startswith("---") | x.startswith("@@")
        kept = F.filter(body, lambda x: ~header(x) & (x.startswith("+") | x.startswith(" ")))
        return F.array_join(F.transform(kept, lambda x: F.substr(x, F.lit(2))), "\n")

    code = T.let(T.split_lines(patch), of)
    return F.when(F.coalesce(patch, F.lit("")) == "", "").otherwise(T.let(code, lambda c: F.when(F.length(T.strip(c)) < least, patch).otherwise(c)))


def problem_category(text: Column) -> Column:
    """First category one of whose words the text holds."""
    lower, out = F.lower(text), F.lit("other")
    for name, words in reversed(R.CATEGORIES.items()):
        out = F.when(T.contains_any(lower, words), name).otherwise(out)
    return out


def is_correct(verdict: Column, should_reject: Column) -> Column:
    return (should_reject & (verdict == "FAIL")) | (~should_reject & verdict.isin("PASS", "WARNING"))


def outcome(verdict: Column, should_reject: Column) -> Column:
    """TP, TN, FP, or FN for all else, errors on good samples included."""
    return F.when(should_reject & (verdict == "FAIL"), "TP").when(~should_reject & verdict.isin("PASS", "WARNING"), "TN").when(~should_reject & (verdict == "FAIL"), "FP").otherwise("FN")


def confusion(df: DataFrame, *by: str) -> DataFrame:
    """Counts and rates over rows of (verdict, should_reject)."""
    kind = outcome(F.col("verdict"), F.col("should_reject"))
    grouped = df.withColumn("__kind", kind).groupBy(*by)
    out = grouped.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("__kind") == k).alias(k.lower()) for k in ("TP", "TN", "FP", "FN")],
        F.count_if("should_reject").alias("n_bad"),
        F.count_if(~F.col("should_reject")).alias("n_good"),
    )
    return with_rates(out)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def with_rates(df: DataFrame) -> DataFrame:
    tp, tn, fp, n = (F.col(c) for c in ("tp", "tn", "fp", "n"))
    df = df.withColumns({"accuracy": ratio(tp + tn, n), "tpr": ratio(tp, F.col("n_bad")), "tnr": ratio(tn, F.col("n_good")), "fpr": ratio(fp, F.col("n_good")), "precision": ratio(tp, tp + fp)})
    both = F.col("precision") + F.col("tpr")
    return df.withColumns({"f1": ratio(2 * F.col("precision") * F.col("tpr"), both), "ci95": F.when(n > 0, 1.96 * F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / n)).otherwise(0.0)})


def agent_subsets() -> list[tuple[int, str, tuple[str, ...]]]:
    """(order, name, agents) of all 15 subsets, smallest first."""
    out = []
    for size in range(1, len(AGENTS) + 1):
        for own in combinations(AGENTS, size):
            out.append((len(out), "+".join(a[0].upper() if a != "style" else "St" for a in own), own))
    return out


def generated(df: DataFrame, structs: Column, *keep: str) -> DataFrame:
    """``keep`` and the fields of each of ``structs``.

    The outer form, without its rows of nulls: from the plain one the optimizer
    infers a filter on the computed array and pulls it through the whole plan.
    """
    return df.select(*keep, F.explode_outer(structs).alias("__s")).where(F.col("__s").isNotNull()).select(*keep, "__s.*")


@lru_cache(maxsize=8)
def _cell_steps(mode: str) -> tuple[dict[str, Column], ...]:
    """Columns that lead to ``cells``; built once for a process, as they name their inputs."""
    secrets = F.col("security_metrics.secrets_found")
    enriched = {a: report.enriched(a, F.col(f"{a}_issues"), secrets if a == "security" else None, mode) for a in AGENTS}
    has = lambda s: F.exists("security_enriched", lambda i: i["severity"] == s)
    steps = [
        {f"{a}_enriched": c for a, c in enriched.items()},
        {f"{a}_clustered": report.clustered(F.col(f"{a}_enriched"), mode) for a in AGENTS},
        {f"{a}_n": F.struct(*[c.alias(k) for k, c in report.counts(F.col(f"{a}_clustered")).items()]) for a in AGENTS}
        | {f"{a}_kinds": F.array_distinct(F.transform(f"{a}_enriched", lambda i: i["type"])) for a in AGENTS}
        # Security's own cascades merge with the report's only if they share a source; they do not.
        | {"severe": F.when(has("critical") & has("high"), 1).otherwise(0)},
    ]
    counted, scored = {}, {}
    for order, _, own in agent_subsets():
        n = {k: sum((F.col(f"{a}_n")[k] for a in own[1:]), F.col(f"{own[0]}_n")[k]) for k in ("critical", "high", "joined", "blocking")}
        kinds = F.flatten(F.array(*[F.col(f"{a}_kinds") for a in own]))
        pair = reduce(lambda x, y: x | y, [F.array_contains(kinds, a) & F.array_contains(kinds, b) for a, b, _ in R.REPORT_COMPOUNDS])
        # Compounds share type, source and severity, so they cluster into one.
        extra = F.when(pair, 1).otherwise(0) + (F.col("severe") if "security" in own else F.lit(0))
        counted[f"n{order}"] = F.struct((n["critical"] + extra).alias("critical"), n["high"].alias("high"), (n["joined"] + extra).alias("joined"), n["blocking"].alias("blocking"))
    for order, name, own in agent_subsets():
        n = F.col(f"n{order}")
        score = report.overall_score(report.base_score({a: F.col(f"{a}_score") for a in own}), n["critical"], n["high"], n["joined"])
        scored[order] = F.struct(F.lit(order).alias("seq"), F.lit(name).alias("config"), F.lit(len(own)).alias("n_agents"), F.array(*map(F.lit, own)).alias("agents"), n.alias("n"), score.alias("score"))
    return tuple(T.kept_apart(x) for x in (*steps, counted, {"cells": F.array(*scored.values())}))


def subset_cells(analysed: DataFrame, settings) -> DataFrame:
    """A verdict for each sample and agent subset, in one pass.

    Agents are analysed once; the 15 subsets only recombine severity counts and
    scores, so no text or issue is copied. Issues are clustered within one agent, so counts of a subset are sums over
    its agents plus the cross-agent compounds that the subset can see.
    """
    df = analysed
    for step in _cell_steps(settings.mode):
        df = df.withColumns(step)
    keep = [c for c in ("sample_id", "should_reject") if c in df.columns]
    n = F.col("n")
    judged = report.verdict(F.col("score"), n["critical"], n["high"], n["joined"], n["blocking"], settings.min_score)
    # Generating positions, not cells: a filter on computed cells would be inferred and pulled through the whole plan.
    each = df.select(*keep, "cells", F.explode(F.array(*map(F.lit, range(len(agent_subsets()))))).alias("at")).select(*keep, F.get("cells", F.col("at")).alias("cell"))
    return T.materialise(each, cell=F.col("cell")).select(*keep, "cell.*").select(*keep, "seq", "config", "n_agents", "agents", judged.alias("verdict"), "score")


def ranked(rates: DataFrame) -> DataFrame:
    """Configurations by accuracy, ties in the order of generation."""
    return rates.withColumn("rank", F.row_number().over(Window.orderBy(F.col("accuracy").desc(), "seq")))


def by_size(rates: DataFrame) -> DataFrame:
    return rates.groupBy("n_agents").agg(F.avg("accuracy").alias("accuracy"), F.avg("tpr").alias("tpr"), F.avg("fpr").alias("fpr"), F.min_by("config", F.struct(-F.col("accuracy"), F.col("seq"))).alias("best"))


def contributions(rates: DataFrame) -> DataFrame:
    """Mean accuracy with less mean accuracy without, for each agent."""
    agents = F.explode(F.array(*map(F.lit, AGENTS))).alias("agent")
    each = rates.select(agents, "accuracy", "agents").withColumn("has", F.expr("array_contains(agents, agent)"))
    return each.groupBy("agent").agg((F.avg(F.when(F.col("has"), F.col("accuracy"))) - F.avg(F.when(~F.col("has"), F.col("accuracy")))).alias("contribution"))


def advantage(rates: DataFrame) -> DataFrame:
    """Several agents against one: means, their difference and its band."""
    single, several = F.avg(F.when(F.col("n_agents") == 1, F.col("accuracy"))), F.avg(F.when(F.col("n_agents") > 1, F.col("accuracy")))
    out = rates.agg(single.alias("single"), several.alias("several"), F.max("accuracy").alias("best"), F.min(F.when(F.col("n_agents") == 1, F.col("accuracy"))).alias("worst_single"))
    gain = F.col("several") - F.col("single")
    return out.withColumns({"gain": gain, "improvement": F.col("best") - F.col("worst_single"), "band": F.when(gain > 0.1, "strong").when(gain > 0.05, "moderate").when(gain > 0, "weak").otherwise("none")})


def score_stats(df: DataFrame, *by: str, score: str = "score") -> DataFrame:
    """Mean, median, deviation, extremes and index quartiles of a score.

    Everything comes from counts by score, so a group meets with as many rows as
    it has different scores (of three decimals: 1001 at most).
    """
    keys = [F.col(c).alias(f"__by_{c}") for c in by]
    names = [f"__by_{c}" for c in by]
    counts = df.groupBy(*keys, F.col(score).alias("__score")).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*names)
    upto = whole.orderBy("__score").rowsBetween(Window.unboundedPreceding, 0)
    valid = F.when(F.col("__score").isNotNull(), F.col("__n"))
    placed = counts.withColumns({"__all": F.sum("__n").over(whole), "__upto": F.sum("__n").over(upto), "__mean": F.sum(F.col("__score") * F.col("__n")).over(whole) / F.sum(valid).over(whole)})
    # The score at a place, counted from zero, is the least one that has more rows up to it.
    at = lambda k: F.min(F.when(F.col("__upto") > F.floor(F.col("__all") * k / 4), F.col("__score")))
    off = F.col("__score") - F.col("__mean")
    return placed.groupBy(*[F.col(n).alias(c) for n, c in zip(names, by, strict=True)]).agg(
        F.sum("__n").alias("n"), F.max("__mean").alias("mean"), F.expr("percentile(__score, 0.5, __n)").alias("median"), F.coalesce(F.sqrt(F.try_divide(F.sum(off * off * F.col("__n")), F.sum(valid) - 1)), F.lit(0.0)).alias("stdev"),
        F.min("__score").alias("least"), F.max("__score").alias("most"), at(1).alias("q1"), at(3).alias("q3"),
    )


def agent_stats(df: DataFrame) -> DataFrame:
    """Score statistics of each agent, by partial aggregation."""
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(a).alias("agent"), F.col(f"{a}_score").alias("score")) for a in AGENTS if f"{a}_score" in df.columns])))
    return rows.groupBy("agent").agg(
        F.avg("score").alias("mean"), F.expr("percentile(score, 0.5)").alias("median"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("stdev"), F.min("score").alias("least"), F.max("score").alias("most")
    )


def group_stats(reports: DataFrame, by: str, top: int | None = None) -> DataFrame:
    """Counts, verdict shares, scores and issues of each repository or category."""
    out = reports.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("verdict") == "PASS").alias("passed"),
        F.count_if(F.col("verdict") == "WARNING").alias("warned"),
        F.count_if(F.col("verdict") == "FAIL").alias("failed"),
        F.avg("score").alias("mean_score"),
        F.sum("n.total").alias("issues"),
        F.count_if(F.col("n.critical") > 0).alias("with_critical"),
    )
    return out if top is None else out.orderBy(F.col("n").desc(), by).limit(top)


def quality_band(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def patch_quality(critical: Column, high: Column, medium: Column) -> Column:
    return F.when((critical > 0) | (high >= 3), "LOW").when((high >= 1) | (medium >= 5), "MEDIUM").otherwise("HIGH")


def confidence_level(total: Column, code_length: Column, score: Column, n_agents: int) -> Column:
    return F.when((total > 0) & (code_length > 100) & (score != 0) & F.lit(n_agents >= 3), "high").when((code_length > 50) & (score != 0) & F.lit(n_agents >= 2), "medium").otherwise("low")


def verdict_confidence(code_length: Column, scores: list[Column], critical: Column) -> Column:
    n = len(scores)
    mean = sum(scores[1:], scores[0]) / n
    variance = sum(((s - mean) * (s - mean) for s in scores[1:]), (scores[0] - mean) * (scores[0] - mean)) / (n - 1) if n > 1 else F.lit(0.0)
    total = 0.5 + F.when(code_length > 100, 0.2).when(code_length > 50, 0.1).otherwise(0.0) + F.when(variance < 0.05, 0.2).otherwise(0.0) + F.when(critical > 0, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), total)


def key_issues(issues: Column, most: int = 3, cut: int = 100) -> Column:
    """Messages of the first severe issues."""
    severe = F.filter(issues, lambda i: i["severity"].isin("critical", "high"))
    return F.transform(F.slice(severe, 1, most), lambda i: F.substring(i["message"], 1, cut))


def issue_rows(reports: DataFrame, *keep: str) -> DataFrame:
    """One row for each issue. ``inline`` keeps nested-column rules away from the report's expressions."""
    numbered = F.transform("issues", lambda i, at: F.struct(at.alias("issue_idx"), *[i[n].alias(n) for n in ("type", "severity", "message", "line_number", "suggestion", "confidence", "agent_source")]))
    return generated(reports, numbered, "sample_id", *keep)


def type_severity(reports: DataFrame, top: int | None = None) -> DataFrame:
    """Issue types by severity, most frequent first."""
    rows = generated(reports, F.transform("issues", lambda i: F.struct(i["type"].alias("type"), i["severity"].alias("severity"))))
    out = rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("low", "medium", "high", "critical")])
    return out if top is None else out.orderBy(F.col("n").desc(), "type").limit(top)


#: Style types that calibration tones down.
STYLE_TYPES = ("spacing", "code_formatting", "import_organization", "variable_naming", "function_naming", "class_naming", "code_clarity")


def calibration(rates: dict, false_positives: list[dict], missed: list[str]) -> list[str]:
    """Recommendations from rates, false-positive type counts and missed categories (all small)."""
    out = []
    if rates["fpr"] > 0.5:
        out.append(f"false positives at {rates['fpr']:.1%}: recalibrate now, keep style apart from security and correctness")
        for row in false_positives:
            if row["type"] in STYLE_TYPES and row["high"]:
                out.append(f"{row['type']}: high to low ({row['n']})")
            elif row["type"] in STYLE_TYPES and row["medium"]:
                out.append(f"{row['type']}: medium to info ({row['n']})")
    elif rates["fpr"] > 0.3:
        out.append("false positives need tuning: review style severities and thresholds by context")
    if rates["tpr"] < 0.85:
        out.append("detection below target: " + ", ".join(sorted({*missed})))
    return out


def batch_summary(reports: DataFrame, min_score: float = 0.85) -> DataFrame:
    """Totals over a batch: passed by the fixed bound, failed by the configured one."""
    agents = [a for a in AGENTS if f"{a}_score" in reports.columns]
    return reports.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("score") >= 0.85).alias("passed"),
        F.count_if(F.col("score") < min_score).alias("failed"),
        F.avg("score").alias("mean_score"),
        *[F.avg(f"{a}_score").alias(f"{a}_mean") for a in agents],
        *[F.sum(F.size(f"{a}_issues")).alias(f"{a}_issues") for a in agents],
    )


def progress(df: DataFrame, order: str = "seq", bounds_of: DataFrame | None = None) -> DataFrame:
    """Running accuracy over ``order``, by prefixes of its ranges (see ``prefix``)."""
    from probatio.operators.prefix import running_sums

    own = running_sums(df, [], [order], {"__right": F.col("correct").cast("long"), "__seen": F.lit(1)}, bounds_of=bounds_of)
    return own.withColumn("running", F.col("__right") / F.col("__seen")).drop("__right", "__seen")


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information of two discrete columns, in bits."""
    pair = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    # Windows over the few pairs, so that the rows behind them are read once.
    sums = {"na": Window.partitionBy(a), "nb": Window.partitionBy(b), "all": Window.partitionBy()}
    full = pair.withColumns({k: F.sum("n").over(w) for k, w in sums.items()})
    p = F.col("n") / F.col("all")
    return full.agg(F.sum(p * F.log2(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))).alias("bits"))


def agent_correlation(df: DataFrame) -> DataFrame:
    """Correlation of each pair of agent scores; null where a score never varies."""
    pairs = list(combinations(AGENTS, 2))
    spread = lambda a: F.stddev_pop(f"{a}_score")
    wide = df.agg(*[F.try_divide(F.covar_pop(f"{a}_score", f"{b}_score"), spread(a) * spread(b)).alias(f"{a}_{b}") for a, b in pairs])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("rho")) for a, b in pairs])))
