import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from probatio.config import Settings
from probatio.operators import corpus, history
from probatio.operators.prefix import running_sums
from probatio.plans.verify import analyse

CACHE = "key string, report string, created_at timestamp, expires_at timestamp, hits long, bytes long"


def _cache(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h, tzinfo=dt.timezone.utc)
    later = dt.datetime(2024, 1, 3, tzinfo=dt.timezone.utc)
    return spark.createDataFrame([("a", "1", at(1), later, 5, 10), ("b", "2", at(2), later, 1, 3000), ("c", "3", at(3), later, 1, 20), ("d", "4", at(4), at(5), 9, 5)], CACHE)


def test_cache_life(spark):
    cache, now = _cache(spark), F.lit("2024-01-02 00:00:00").cast("timestamp")
    keys = lambda df: sorted(r["key"] for r in df.collect())
    assert {r["key"]: r["tier"] for r in history.with_tier(cache, 1000).collect()} == {"a": "memory", "b": "disk", "c": "memory", "d": "memory"}
    assert keys(history.evicted(cache, 2, now)) == ["a", "c"] and keys(history.evicted(cache, 0, now)) == [] and keys(history.evicted(cache, 9, now)) == ["a", "b", "c"]
    asked = spark.createDataFrame([("b",), ("b",), ("x",)], "key string")
    assert {r["key"]: r["hits"] for r in history.touched(cache, asked).collect()} == {"a": 5, "b": 3, "c": 1, "d": 9}
    assert keys(history.deleted(cache, asked)) == ["a", "c", "d"]
    assert keys(history.missing(spark.createDataFrame([("a",), ("d",), ("d",), ("n",)], "key string"), cache, now)) == ["d", "n"]
    added = history.entries(spark.createDataFrame([("a", 0.5)], "key string, score double"), "key", now, "1 HOUR")
    stored = {r["key"]: r for r in history.store(cache, added).collect()}
    assert len(stored) == 4 and stored["a"]["report"] == '{"score":0.5}' and stored["a"]["hits"] == 0 and stored["a"]["bytes"] == 13
    health = history.cache_health(cache, now, 1000).first()
    assert (health["entries"], health["expired"], health["bytes"], health["status"]) == (4, 1, 3035, "over quota")
    assert {r["key"] for r in history.kept_within_quota(cache, "bytes", 10_000).collect()} == {"a", "b", "c", "d"}


def test_running_sums_equal_brute_force(spark):
    draw = np.random.default_rng(1)
    rows = [(k, int(draw.integers(0, 3)) or None, int(draw.integers(0, 40)), float(draw.integers(0, 9))) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, user int, ts long, value double")
    for ranges in (2, 7, 256):
        got = {r["id"]: r["s"] for r in running_sums(df, ["user"], ["ts", "id"], {"s": F.col("value")}, ranges).collect()}
        assert all(got[i] == sum(v for j, w, t, v in rows if w == u and (t, j) <= (ts, i)) for i, u, ts, _ in rows)
    ema = {r["user"]: r for r in history.moving_average(df, "user", "id", "value").collect()}
    for user in (None, 1, 2):
        own = [v for _, u, _, v in rows if u == user]
        want = own[0]
        for v in own[1:]:
            want = want * 0.9 + v * 0.1
        assert abs(ema[user]["ema"] - want) < 1e-9 and ema[user]["n"] == len(own)
    stats = corpus.score_stats(df, "user", score="value")
    for r in stats.collect():
        own = sorted(v for _, u, _, v in rows if u == r["user"])
        assert (r["n"], r["q1"], r["q3"], r["median"]) == (len(own), own[len(own) // 4], own[len(own) * 3 // 4], float(np.median(own)))
        assert abs(r["stdev"] - np.std(own, ddof=1)) < 1e-9 and abs(r["mean"] - np.mean(own)) < 1e-9


def test_line_length_is_a_setting(spark):
    df = spark.createDataFrame([("s", "x = '" + "a" * 90 + "'\n")], "sample_id string, code string")
    kinds = lambda settings: {i["type"] for i in analyse(df, settings).first()["style_issues"]}
    assert "line_length" in kinds(Settings()) and "line_length" not in kinds(Settings(max_line=120))


def test_skipped_agents_and_stored_evaluations(spark, tmp_path):
    from probatio.plans.verify import verify
    from probatio.sources import sinks

    df = spark.createDataFrame([("s", "x = 1\n")], "sample_id string, code string")
    row = verify(df, Settings(agents=("security", "style"))).select("skipped_agents").first()
    assert [tuple(x) for x in row[0]] == [("correctness", "skipped", 1.0), ("performance", "skipped", 1.0)]
    results = spark.createDataFrame([("p", "bug", True, "FAIL", 0.25, True), ("q", None, False, "PASS", 1.0, True)], "problem_id string, category string, should_reject boolean, verdict string, score double, correct boolean")
    rates = spark.createDataFrame([(1, "S", 0.5), (1, "C", 0.75), (2, "C+S", 0.9)], "n_agents int, config string, accuracy double")
    sinks.write_evaluation(results, rates.agg(F.max("accuracy").alias("accuracy")), str(tmp_path / "e"))
    back, metrics = sinks.read_evaluation(spark, str(tmp_path / "e"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, results.collect())) and metrics.first()["accuracy"] == 0.9
    assert [tuple(r) for r in sinks.ablation_summary(rates).collect()] == [(1, 2, 0.625, 0.75, "C"), (2, 1, 0.9, 0.9, "C+S")]
