"""Text expressions with the meaning of their Python counterparts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ends a line for ``str.splitlines``, as a Java pattern.
LINE_END = "\\r\\n|[\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
#: What ``str.strip`` takes off.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Parts that many searches share. They hold no letter, so the lower-case text holds the same ones.
MARKS = (*"()[]{}+-*/=;'\"_@\t\x0b\f\r", " \n", "\n\n")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def materialise(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once, however often they are used.

    Each is wrapped in a condition that always holds but that the optimizer may
    not move or fold (``spark_partition_id() >= 0``; one on ``rand`` would be
    folded). It so stays in a projection of its own, instead
    of being copied into each of its uses: plans grow in proportion to the
    rules, not with their nesting. Nothing is shuffled.
    """
    return df.withColumns(kept_apart(columns))


def kept_apart(columns: dict[str, Column]) -> dict[str, Column]:
    """The columns in the wrapping that ``materialise`` describes."""
    return {name: F.when(F.spark_partition_id() >= 0, c) for name, c in columns.items()}


def split_lines(code: Column) -> Column:
    """Lines of ``code`` as ``str.splitlines`` gives them."""
    parts = F.split(F.when(contains_any(code, LINE_ENDS), F.regexp_replace(code, LINE_END, "\n")).otherwise(code), "\n")
    return F.when(code == "", F.array().cast("array<string>")).otherwise(
        let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))
    )


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def lstrip(x: Column) -> Column:
    return F.ltrim(x, F.lit(BLANKS))


def indent(line: Column) -> Column:
    return F.length(line) - F.length(lstrip(line))


def non_blank(lines: Column) -> Column:
    return F.filter(lines, lambda x: strip(x) != "")


def marks(code: Column) -> dict[str, Column]:
    """Which of ``MARKS`` a text holds, as the columns that ``has`` names."""
    return {f"__has_{k}": code.contains(part) for k, part in enumerate(MARKS)}


def has(part: str) -> Column:
    return F.col(f"__has_{MARKS.index(part)}")


def contains(x: Column, word: str, marked: bool = False) -> Column:
    """``marked``: the row has the columns of ``marks`` for this text; the word is searched only where its marks are."""
    if not marked:
        return x.contains(word)
    if word in MARKS:
        return has(word)
    return reduce(lambda found, part: has(part) & found, [m for m in MARKS if m in word], x.contains(word))


def contains_any(x: Column, words, marked: bool = False) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | contains(x, word, marked)
    return out


def count_of(x: Column, part: str) -> Column:
    """Occurrences of a literal, not overlapping."""
    return F.regexp_count(x, F.lit("\\Q" + part + "\\E"))


def entropy(x: Column) -> Column:
    """Shannon entropy in bits of a text's characters; 0 below eight characters."""
    letters = F.split(x, "")

    def of(own: Column) -> Column:
        n = F.size(own).cast("double")
        return F.aggregate(
            F.array_sort(F.array_distinct(own)),
            F.lit(0.0),
            lambda acc, c: acc - let(F.size(F.filter(own, lambda y: y == c)) / n, lambda p: p * F.log2(p)),
        )

    return F.when(F.length(x) < 8, F.lit(0.0)).otherwise(let(letters, of))


def pattern(regex: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """A Java pattern in which line ends are those of Python."""
    return f"(?d{'m' if multiline else ''}{'i' if ignore_case else ''}){regex}"
