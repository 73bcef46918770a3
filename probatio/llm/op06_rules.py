"""Quality rules: a decision list learned from labelled statistics.

Statistics come from native expressions, one narrow pass without a shuffle.
Repeated word windows are found by sorting each text's window hashes, not by
grouping over the corpus.

Learner (sequential covering): a rule for low quality grows by adding the
threshold test with the best FOIL gain on two thirds of the labelled rows, loses
trailing tests while that helps on the last third, and is kept if it is precise
there; rows that it covers are set aside and the next rule is grown. The list is
emitted as ordered Spark conditions. Learning reads a bounded sample of the
labelled rows (``max_rows``, those with the smallest hash of their id); applying
covers all rows.

Null and empty texts have no words and fail the base rules. Labels with null ids
or verdicts are not learned from; of several labels for one id the lowest
counts. Without labels, or with one class only, the list is empty and the base
rules alone decide. Repeated rows are judged each on its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

GAP = "[ \\t-\\r]+"
#: Rates that rules may test, as expressions of the counts.
RATES = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate")


@dataclass(frozen=True)
class Test:
    """``rate`` at least (``above``) or at most ``threshold``."""

    rate: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.rate] >= self.threshold if self.above else row[self.rate] <= self.threshold

    def column(self) -> Column:
        return F.col(self.rate) >= F.lit(self.threshold) if self.above else F.col(self.rate) <= F.lit(self.threshold)


Rule = tuple[Test, ...]


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words inside ``width``-word windows that occur at least twice in ``words``.

    Windows are sorted as (leading hash bits, position) longs; neighbours with
    equal leading bits are compared by whole 64-bit hashes.
    """

    def of(w: Column) -> Column:
        size = F.size(w)
        room = F.ceil(F.log2(size.cast("double") + 1)).cast("int")
        return F.when(size <= width, F.lit(0)).otherwise(let(room, lambda bits: let(packed(w, bits), lambda s: covered(w, s, bits))))

    def window_hash(w: Column, at: Column) -> Column:
        return F.xxhash64(*(w[at + k] for k in range(width)))

    def call(name: str, value: Column, bits: Column) -> Column:
        return F.call_function(name, value, bits)

    def packed(w: Column, bits: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - width)
        return F.sort_array(F.transform(at, lambda i: call("shiftleft", window_hash(w, i), bits).bitwiseOR(i.cast("long"))))

    def covered(w: Column, s: Column, bits: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            return call("shiftright", x, bits) == call("shiftright", y, bits)

        twins = F.filter(s, lambda x, i: ((i > 0) & same(x, F.get(s, i - 1))) | ((i < F.size(s) - 1) & same(x, F.get(s, i + 1))))
        places = F.transform(twins, lambda x: x.bitwiseAND(call("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int"))
        whole = F.sort_array(F.transform(places, lambda i: F.struct(window_hash(w, i).alias("h"), i.alias("at"))))
        exact = let(
            whole,
            lambda t: F.sort_array(
                F.transform(
                    F.filter(t, lambda x, i: ((i > 0) & (x["h"] == F.get(t, i - 1)["h"])) | ((i < F.size(t) - 1) & (x["h"] == F.get(t, i + 1)["h"]))),
                    lambda x: x["at"],
                )
            ),
        )
        start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(
            exact,
            start,
            lambda acc, x: F.struct(x.alias("last"), (acc["total"] + F.least(F.lit(width), x - acc["last"])).alias("total")),
            lambda acc: acc["total"],
        )

    return let(words, of)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (longs)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, GAP), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit("[^ \\t-\\r]")))
    held = docs.withColumn("__words", words)
    return held.select(
        *docs.columns,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, GAP, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).cast("long").alias("n_repeat_words"),
        F.greatest(F.size(F.split(text, "\n")), F.lit(1)).cast("long").alias("n_lines"),
    )


def with_rates(stats: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns(
        {
            "mean_word": F.col("word_chars") / words,
            "symbol_rate": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
            "dup_line_rate": F.col("n_dup_lines") / F.col("n_lines").cast("double"),
            "repeat_rate": F.col("n_repeat_words") / words,
        }
    )


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def _cuts(values: list[float], most: int) -> list[float]:
    """At most ``most`` candidate thresholds: quantiles of the distinct values."""
    values = sorted({*values})
    return values if len(values) <= most else [values[k * (len(values) - 1) // (most - 1)] for k in range(most)]


def _grow(bad: list[dict], good: list[dict], max_tests: int, max_cuts: int) -> Rule:
    rule: list[Test] = []
    while good and bad and len(rule) < max_tests:
        before = log2(len(bad) / (len(bad) + len(good)))
        best = (1e-9, None, None, None)
        for rate in RATES:
            for cut in _cuts([r[rate] for r in bad], max_cuts):
                for above in (True, False):
                    test = Test(rate, above, cut)
                    b = [r for r in bad if test.holds(r)]
                    if len(b) * -before <= best[0]:
                        continue
                    g = [r for r in good if test.holds(r)]
                    gain = len(b) * (log2(len(b) / (len(b) + len(g))) - before)
                    if gain > best[0] and len(g) < len(good):
                        best = (gain, test, b, g)
        if best[1] is None:
            break
        rule.append(best[1])
        bad, good = best[2], best[3]
    return tuple(rule)


def _cover(rule: Rule, rows: list[dict]) -> list[dict]:
    return [r for r in rows if all(t.holds(r) for t in rule)]


def learn(rows: list[tuple[dict, bool]], max_rules: int = 8, max_tests: int = 4, max_cuts: int = 24, min_precision: float = 0.95, min_cover: int = 5) -> list[Rule]:
    """Rules for low quality from (rates, is low) rows; every third row prunes."""
    bad, good = ([r for r, low in rows if low is want] for want in (True, False))
    if not bad or not good:
        return []
    split = [([r for k, r in enumerate(x) if k % 3], x[::3]) for x in (bad, good)]
    (grow_bad, prune_bad), (grow_good, prune_good) = split
    rules: list[Rule] = []
    while len(rules) < max_rules and grow_bad:
        rule = _grow(grow_bad, grow_good, max_tests, max_cuts)
        best: tuple = (0.0, ())
        for size in range(len(rule), 0, -1):
            b, g = len(_cover(rule[:size], prune_bad)), len(_cover(rule[:size], prune_good))
            worth = (b - g) / (b + g) if b + g else 0.0
            if worth >= best[0] and b:
                best = (worth, rule[:size])
        rule = best[1]
        b, g = len(_cover(rule, grow_bad + prune_bad)), len(_cover(rule, grow_good + prune_good))
        if not rule or b < min_cover or b < min_precision * (b + g):
            break
        rules.append(rule)
        grow_bad, prune_bad, grow_good, prune_good = ([r for r in x if not all(t.holds(r) for t in rule)] for x in (grow_bad, prune_bad, grow_good, prune_good))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditions: the number of the first rule that holds, 0 if none."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(reduce(lambda a, b: a & b, [t.column() for t in rules[k - 1]]), F.lit(k)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **how) -> list[Rule]:
    """A list learned from at most ``max_rows`` labelled documents."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg((F.min(label_col) <= 0).alias("__low"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    # At most max_rows pairs of an id and a boolean.
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(known), "__id")
    # No filter on the statistics here: it would move below the join and cover every document.
    stats = with_rates(with_statistics(own)).select("__id", "__low", base_failed().alias("__failed"), *RATES)
    rows = stats.orderBy(F.xxhash64("__id"), "__id", *RATES).limit(max_rows).collect()
    return learn([({r: float(row[r]) for r in RATES}, row["__low"]) for row in rows if not row["__failed"]], **how)


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, ``rule`` (0: none) and ``kept``.

    Columns of ``docs`` that clash with these are not touched: they are kept
    under their names and the added ones replace them in the result.
    """
    added = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "__words", *RATES, "base_failed", "rule", "kept"}
    clear = docs.select(*[c for c in docs.columns if c == text_col or c not in added])
    out = with_rates(with_statistics(clear, text_col)).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
