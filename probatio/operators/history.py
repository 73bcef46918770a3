"""Result cache, running statistics, history and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatio.config import Settings
from probatio.operators.prefix import running_sums

RATINGS = {"Very Dissatisfied": 1, "Dissatisfied": 2, "Neutral": 3, "Satisfied": 4, "Very Satisfied": 5}


def cache_key(code: Column, context: Column | None, settings: Settings) -> Column:
    """Key of a result: text, sorted context and all settings, agents and thresholds included."""
    own = F.lit("{}") if context is None else F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(context, F.create_map().cast("map<string,string>"))))))
    return F.sha2(F.concat(F.sha2(code, 256), F.sha2(own, 256), F.lit(settings.fingerprint())), 256)


def joined_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def lookup(samples: DataFrame, cache: DataFrame, now: Column, key: str = "key") -> DataFrame:
    """``samples`` with ``hit``, and the cached columns of entries that have not expired.

    Keys are hashes, so rows spread evenly; of several entries the last counts.
    """
    names = [c for c in cache.columns if c != key]
    fresh = cache.where(F.col("expires_at") > now).groupBy(key).agg(F.max_by(F.struct(*names), "created_at").alias("__entry"))
    joined = samples.join(fresh, key, "left")
    return joined.select(*samples.columns, F.col("__entry").isNotNull().alias("hit"), *[F.col("__entry")[n].alias(n) for n in names])


def expired(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") <= now)


def kept_within_quota(cache: DataFrame, size: str, quota: int, share: float = 0.8) -> DataFrame:
    """Entries that stay when the oldest go until ``share`` of the quota is left.

    Whole days (or whatever ``created_at`` truncates to) are summed first.
    """
    days = cache.groupBy(F.date_trunc("day", "created_at").alias("day")).agg(F.sum(size).alias("bytes"))
    newer = days.withColumn("upto", F.sum("bytes").over(Window.orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    total = days.agg(F.sum("bytes").alias("total"))
    keep = newer.crossJoin(F.broadcast(total)).where((F.col("total") <= quota) | (F.col("upto") <= quota * share)).select("day")  # total has one row
    return cache.join(keep, F.date_trunc("day", "created_at") == F.col("day"), "left_semi")


def entries(reports: DataFrame, key: str, now: Column, ttl: str, payload: Column | None = None) -> DataFrame:
    """Reports as cache entries: key, report as JSON, times and size in bytes."""
    kept = F.to_json(F.struct(*[c for c in reports.columns if c != key])) if payload is None else payload
    out = reports.select(F.col(key).alias("key"), kept.alias("report"), now.alias("created_at"), (now + F.expr(f"INTERVAL {ttl}")).alias("expires_at"), F.lit(0).cast("long").alias("hits"))
    return out.withColumn("bytes", F.octet_length("report").cast("long"))


def with_tier(cache: DataFrame, memory_bytes: int) -> DataFrame:
    """``cache`` with ``tier``: memory for entries up to ``memory_bytes`` each, disk for larger ones."""
    return cache.withColumn("tier", F.when(F.col("bytes") <= memory_bytes, "memory").otherwise("disk"))


def store(cache: DataFrame, added: DataFrame) -> DataFrame:
    """The cache after ``added`` is set: of entries of one key the newest counts."""
    names = [c for c in cache.columns if c != "key"]
    both = cache.select("key", *names).unionByName(added.select("key", *names))
    return both.groupBy("key").agg(F.max_by(F.struct(*names), "created_at").alias("e")).select("key", *[F.col("e")[n].alias(n) for n in names])


def touched(cache: DataFrame, requests: DataFrame) -> DataFrame:
    """``cache`` with the hits of ``requests`` (key) added; requests are counted before they meet it."""
    asked = requests.groupBy(F.col("key").alias("__key")).agg(F.count(F.lit(1)).alias("__asked"))
    return cache.join(asked, F.col("key") == F.col("__key"), "left").withColumn("hits", F.col("hits") + F.coalesce("__asked", F.lit(0))).drop("__key", "__asked")


def evicted(cache: DataFrame, most: int, now: Column) -> DataFrame:
    """At most ``most`` fresh entries: those of fewest hits go first, of equal ones the oldest.

    The bound is found on counts by (hits, second); only entries on it are ranked.
    """
    fresh = cache.where(F.col("expires_at") > now).withColumn("__place", F.struct(F.col("hits").alias("h"), F.date_trunc("second", "created_at").alias("t")))
    counts = fresh.groupBy("__place").agg(F.count(F.lit(1)).alias("n"))
    better = counts.withColumn("above", F.sum("n").over(Window.orderBy(F.col("__place").desc()).rowsBetween(Window.unboundedPreceding, -1)))
    held = better.select(F.col("__place").alias("p"), (F.lit(most) - F.coalesce("above", F.lit(0))).alias("room")).where("room > 0")
    rank = Window.partitionBy("__place").orderBy(F.col("created_at").desc(), "key")
    return fresh.join(held, F.col("__place") == F.col("p")).withColumn("__rank", F.row_number().over(rank)).where(F.col("__rank") <= F.col("room")).drop("__place", "__rank", "p", "room")


def deleted(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """``cache`` without the given keys; with an empty table of keys, as it is."""
    return cache.join(keys.select(F.col("key").alias("__key")).distinct(), F.col("key") == F.col("__key"), "left_anti")


def missing(samples: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Samples to verify when a cache is warmed: one of each key that has no fresh entry."""
    fresh = cache.where(F.col("expires_at") > now).select(F.col("key").alias("__key"))
    return samples.dropDuplicates(["key"]).join(fresh, F.col("key") == F.col("__key"), "left_anti")


def cache_health(cache: DataFrame, now: Column, quota: int) -> DataFrame:
    """One row: entries, expired ones, bytes, share of the quota, and a status."""
    out = cache.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("expires_at") <= now).alias("expired"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    used = F.col("bytes") / F.lit(quota)
    return out.withColumns({"used": used, "status": F.when(used > 1, "over quota").when(F.col("expired") * 2 > F.col("entries"), "stale").otherwise("healthy")})


def cache_stats(lookups: DataFrame, *by: str) -> DataFrame:
    return lookups.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"),
        F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg((~F.col("hit")).cast("double")).alias("miss_rate"),
    )


def moving_average(df: DataFrame, by: str, order: str, value: str, keep: float = 0.9) -> DataFrame:
    """Exponential moving average of each group's values in order; the first value starts it.

    A value's weight follows from how many of its group come after it, so the
    average is a sum of partial sums, however long a group is.
    """
    ranks = running_sums(df.select(by, order, value), [by], [order], {"__rank": F.lit(1)})
    sizes = df.groupBy(F.col(by).alias("__by")).agg(F.count(F.lit(1)).alias("__n"))
    joined = ranks.join(sizes, F.col(by).eqNullSafe(F.col("__by")))
    weight = F.pow(F.lit(keep), F.col("__n") - F.col("__rank")) * F.when(F.col("__rank") == 1, 1.0).otherwise(1 - keep)
    return joined.groupBy(by).agg(F.sum(weight * F.col(value)).alias("ema"), F.count(F.lit(1)).alias("n"))


def running(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Running count and mean of each group."""
    held = F.col(value).isNotNull().cast("long")
    out = running_sums(df, [by], order, {"runs": F.lit(1), "__sum": F.coalesce(F.col(value).cast("double"), F.lit(0.0)), "__held": held})
    return out.withColumn("running_mean", F.try_divide("__sum", "__held")).drop("__sum", "__held")


def trend(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Mean, sum and last less first of each group, by partial aggregation."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total"), (F.max_by(value, order) - F.min_by(value, order)).alias("change"))


def rating(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in RATINGS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), F.lit(3))


def feedback_means(feedback: DataFrame) -> DataFrame:
    return feedback.agg(F.avg(rating(F.col("satisfaction"))).alias("satisfaction"), F.avg(rating(F.col("accuracy"))).alias("accuracy"), F.sum("false_positives").alias("false_positives"), F.sum("false_negatives").alias("false_negatives"))


def live_lint(lines: Column, code: Column) -> Column:
    """Counts, complexity band and warnings for an editor."""
    from probatio.functions import text as T

    points = sum((T.count_of(code, w) for w in ("for", "while", "try")), T.count_of(code, "if"))
    patterns = (("os", "import os"), ("subprocess", "subprocess"), ("eval", r"eval\s*\("), ("exec", r"exec\s*\("), ("pickle", r"pickle\.loads"))
    warned = F.filter(F.array(*[F.when(F.rlike(code, F.lit(p)), name) for name, p in patterns]), lambda x: x.isNotNull())
    return F.struct(
        F.size(lines).alias("total_lines"),
        F.size(T.non_blank(lines)).alias("code_lines"),
        F.size(F.filter(lines, lambda x: T.strip(x).startswith("#"))).alias("comments"),
        F.when(points < 5, "Low").when(points < 15, "Medium").otherwise("High").alias("complexity"),
        warned.alias("warnings"),
    )
