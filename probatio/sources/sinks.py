"""Writers of reports and evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT = ("sample_id", "score", "verdict", "grade", "issues", "issue_summary", "enterprise", "assessment", "top_types", "recommendations", "agent_status", "findings", "code_stats")


def report_json(reports: DataFrame) -> DataFrame:
    """(sample_id, report): each report as one JSON text."""
    return reports.select("sample_id", F.to_json(F.struct(*[c for c in REPORT if c in reports.columns])).alias("report"))


def _yaml(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def report_yaml(reports: DataFrame) -> DataFrame:
    """(sample_id, report): the main fields of each report as a YAML text."""
    issues = F.transform("issues", lambda i: F.concat(F.lit("  - type: "), i["type"], F.lit("\n    severity: "), i["severity"], F.lit("\n    line: "), F.coalesce(i["line_number"].cast("string"), F.lit("null")), F.lit("\n    message: "), _yaml(i["message"])))
    text = F.concat(F.lit("score: "), F.col("score").cast("string"), F.lit("\nverdict: "), F.col("verdict"), F.lit("\nissues:"), F.when(F.size("issues") == 0, F.lit(" []")).otherwise(F.concat(F.lit("\n"), F.array_join(issues, "\n"))), F.lit("\n"))
    return reports.select("sample_id", text.alias("report"))


def report_text(reports: DataFrame, per_severity: int | None = 5) -> DataFrame:
    """(sample_id, report): text grouped by severity, at most ``per_severity`` issues each (a display bound)."""
    parts = []
    for severity in ("critical", "high", "medium", "low"):
        own = _of(severity)
        shown = own if per_severity is None else F.slice(own, 1, per_severity)
        lines = F.transform(shown, lambda i: F.concat(F.lit("  - "), i["type"], F.when(i["line_number"].isNotNull(), F.concat(F.lit(" (line "), i["line_number"].cast("string"), F.lit(")"))).otherwise(""), F.lit(": "), i["message"]))
        parts.append(F.when(F.size(own) > 0, F.concat(F.lit(f"{severity.upper()} ("), F.size(own).cast("string"), F.lit(")\n"), F.array_join(lines, "\n"), F.lit("\n"))).otherwise(""))
    head = F.concat(F.col("verdict"), F.lit("  score "), F.format_string("%.3f", "score"), F.lit("  "), F.col("grade"), F.lit("\n"))
    return reports.select("sample_id", F.concat(head, *parts).alias("report"))


def _of(severity: str) -> Column:
    return F.filter("issues", lambda i: i["severity"] == severity)


def write_reports(reports: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, partitioned by verdict."""
    reports.write.mode(mode).partitionBy("verdict").parquet(path)


def write_texts(texts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON line for each report, keyed by the full sample id (no stem collisions)."""
    texts.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV files with a header each, one for each task; arrays are joined by ``+``."""
    flat = df.select(*[F.array_join(c, "+").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat.write.mode(mode).option("header", True).csv(path)


def markdown(df: DataFrame, most: int = 100) -> str:
    """A Markdown table of a small aggregate (at most ``most`` rows are shown)."""
    rows = df.limit(most).collect()
    cell = lambda x: f"{x:.4f}" if isinstance(x, float) else "" if x is None else str(x)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(cell(x) for x in r) + " |" for r in rows)])


def append_checkpoint(df: DataFrame, path: str) -> None:
    """Progress of a long evaluation: only new rows are written."""
    df.write.mode("append").parquet(path)


def write_evaluation(results: DataFrame, rates: DataFrame, path: str, mode: str = "overwrite") -> None:
    """An evaluation as JSON lines: ``rates`` (one row) below ``metrics``, one line for each result below ``details``."""
    rates.write.mode(mode).json(f"{path}/metrics")
    results.write.mode(mode).json(f"{path}/details")


def read_evaluation(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(results, rates) as ``write_evaluation`` left them."""
    details = "problem_id string, category string, should_reject boolean, verdict string, score double, correct boolean"
    return spark.read.schema(details).json(f"{path}/details"), spark.read.json(f"{path}/metrics")


def ablation_summary(rates: DataFrame) -> DataFrame:
    """Mean and best accuracy by number of agents, from one row (n_agents, accuracy, config) for each subset."""
    by = rates.groupBy("n_agents").agg(F.count(F.lit(1)).alias("configs"), F.avg("accuracy").alias("mean"), F.max("accuracy").alias("best"), F.max_by("config", F.struct("accuracy", "config")).alias("best_config"))
    return by.orderBy("n_agents")
