"""Line dedup that returns compressed keep bitmaps.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z
lower-cased. Keys of at least ``min_chars`` code points that at least
``min_docs`` documents hold lose all their lines except in the largest document
id that holds them.

Key hashes (128 bits) are range-partitioned by (hash, document) and sorted by
document and position, so a hash that a third of all rows hold spans as many
ranges as it needs. A window over the sorted ranges streams out the first line of
each (hash, document) without another shuffle; those first occurrences are
counted in ``SALTS`` parts of each hash, dealt by document, and the parts are
summed. Lines meet the verdict of their part, never of the whole hash, so no task
takes all lines of a hot one. What comes back for a document is its keep bitmap,
run-length compressed: the (start, length) runs of lines that stay. Texts are
read again only to apply it.

Null and empty texts are one empty line. Rows that share an id are one document
for counting; each row keeps its own bitmap, and equal rows have equal ones. A
null id counts as the smallest document. Columns besides id and text play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, checkpointed, let

#: Parts of a hash that are counted and joined apart, dealt by document.
SALTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(x: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.when(F.length(x) == F.octet_length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_runs(dropped: Column, n_lines: Column) -> Column:
    """Runs of kept lines between ascending dropped positions."""
    ends = F.concat(F.array(F.lit(-1)), dropped, F.array(n_lines))
    return let(
        ends,
        lambda b: F.filter(
            F.transform(F.slice(b, F.lit(2), F.size(b) - 1), lambda x, i: F.struct((b[i] + 1).alias("start"), (x - b[i] - 1).alias("length"))),
            lambda r: r["length"] > 0,
        ),
    )


def apply_runs(lines: Column, runs: Column) -> Column:
    """The text that the kept runs leave."""
    return F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")


def line_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, dropped) of the rows that lose lines; ``dropped`` ascends."""
    exploded = docs.select(F.col(id_col).alias("doc"), text_hash(F.col(text_col)).alias("text_hash"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    key = F.btrim("line", F.lit(BLANK))
    lines = (
        exploded.where(F.length("line") >= min_chars)
        .select("doc", "text_hash", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc", "text_hash", "pos", ascii_lower(F.col("key")).alias("key"))
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(17), "key").alias("h2"), "doc", "text_hash", "pos")
    )
    lines = checkpointed(lines)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("h1", "h2", "doc").orderBy("pos")
    salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")
    first = (
        lines.select("h1", "h2", "doc", "pos")
        .repartitionByRange(n, "h1", "h2", "doc")
        .sortWithinPartitions("h1", "h2", "doc", "pos")
        .withColumn("nth", F.row_number().over(order))
        .where("nth = 1")
    )
    parts = first.groupBy("h1", "h2", salt.alias("salt")).agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("last"))
    # At most SALTS rows of a hash meet here.
    whole = Window.partitionBy("h1", "h2")
    told = parts.withColumn("n_docs", F.sum("n").over(whole)).withColumn("keeper", F.max("last").over(whole)).where(F.col("n_docs") >= min_docs).select("h1", "h2", "salt", "keeper")
    lost = lines.withColumn("salt", salt).join(told, ["h1", "h2", "salt"]).where(~F.col("doc").eqNullSafe(F.col("keeper"))).select("doc", "text_hash", "pos")
    return lost.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("dropped")).withColumnRenamed("doc", id_col)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped``, ``keep_runs`` and ``kept_text`` added."""
    own = [f"__{c}" for c in ("doc", "hash", "dropped", "lines")]
    lost = line_bitmaps(docs, min_chars, min_docs, id_col, text_col).toDF(*own[:3])
    joined = docs.withColumn(own[3], text_hash(F.col(text_col))).join(lost.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(own[0])) & (F.col(own[3]) == F.col(own[1])), "left")
    lines = lines_of(F.col(text_col))
    n_lines = F.size(lines)
    none = F.col(own[2]).isNull()
    return joined.select(
        *docs.columns,
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size(own[2]), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(none, F.array(F.struct(F.lit(0).alias("start"), n_lines.alias("length")))).otherwise(keep_runs(F.col(own[2]), n_lines)).alias("keep_runs"),
        F.when(none, F.coalesce(F.col(text_col), F.lit(""))).otherwise(let(lines, lambda x: apply_runs(x, keep_runs(F.col(own[2]), F.size(x))))).alias("kept_text"),
    )


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, pos, parts[pos] AS line,
         translate(trim(parts[pos], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
many AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.doc_id, l.pos, l.line, (m.key IS NOT NULL AND l.doc_id <> m.keeper) AS lost
  FROM lines l LEFT JOIN many m ON l.key = m.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
