"""Rate limiting against its definition."""

import datetime
import random

import pytest

from offerloom.operators.ratelimit import rate_limit

START = datetime.datetime(2024, 1, 1)


def admitted_by_definition(hits, limit, seconds):
    """Each hit against all earlier ones of its key: fewer than ``limit`` admitted at most ``seconds`` before."""
    ordered = sorted(hits, key=lambda h: (h[2], h[0]))
    let_in = [False] * len(ordered)
    for i, (_, key, ts) in enumerate(ordered):
        earlier = [j for j in range(i) if let_in[j] and ordered[j][1] == key and (ts - ordered[j][2]).total_seconds() <= seconds]
        let_in[i] = len(earlier) < limit
    return sorted(h[0] for h, yes in zip(ordered, let_in, strict=True) if yes)


def make(rng, n, span, hot=0.4):
    return [
        (i, "hot" if rng.random() < hot else f"k{rng.randrange(8)}", START + datetime.timedelta(seconds=rng.randrange(span)))
        for i in range(n)
    ]


def run(spark, hits, limit, seconds):
    df = spark.createDataFrame(hits, "event_id INT, key STRING, ts TIMESTAMP_NTZ").repartition(4)
    decided = rate_limit(df, limit, seconds)
    assert decided.columns == ["event_id", "key", "ts", "admitted"] and decided.count() == len(hits)
    return sorted(r.event_id for r in decided.filter("admitted").collect())


@pytest.mark.parametrize(("limit", "seconds", "span"), [(1, 60, 4000), (3, 60, 3000), (10, 60, 600), (2, 5, 100)])
def test_equals_its_definition(spark, limit, seconds, span):
    hits = make(random.Random(limit), 1500, span)
    assert run(spark, hits, limit, seconds) == admitted_by_definition(hits, limit, seconds)


def test_one_key_over_many_partitions(spark):
    # Adaptive execution would join the small test partitions again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for hot in (1.0, 0.8):
            hits = make(random.Random(9), 1200, 5000, hot)
            assert run(spark, hits, 4, 60) == admitted_by_definition(hits, 4, 60)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_exactly_one_window_old_still_counts(spark):
    hits = [(i, "k", START + datetime.timedelta(seconds=s)) for i, s in enumerate([0, 30, 60, 61, 120])]
    assert run(spark, hits, 1, 60) == [0, 3]
    assert run(spark, hits, 2, 60) == admitted_by_definition(hits, 2, 60)


def test_hits_without_key_count_under_one_name(spark):
    hits = [(1, None, START), (2, "k", None), (3, None, START), (4, "unknown", START)]
    df = spark.createDataFrame(hits, "event_id INT, key STRING, ts TIMESTAMP_NTZ")
    rows = {r.event_id: r.admitted for r in rate_limit(df, 2, 60).collect()}
    assert rows == {1: True, 3: True, 4: False}


def test_limit_zero_refuses_all(spark):
    df = spark.createDataFrame([(1, "k", START)], "event_id INT, key STRING, ts TIMESTAMP_NTZ")
    assert [r.admitted for r in rate_limit(df, 0, 60).collect()] == [False]


def test_times_without_zone_do_not_depend_on_the_session(spark):
    times = [datetime.datetime(2024, 3, 31, 2, 59, 30), datetime.datetime(2024, 3, 31, 4, 0, 10, 500)]
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate(times)], "event_id INT, key STRING, ts TIMESTAMP_NTZ")
    for zone in ("UTC", "Europe/Bucharest"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert rate_limit(df, 1, 60).filter("admitted").count() == 2
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_jobs_do_not_grow_with_the_partitions_of_a_key(spark):
    rng, counts = random.Random(3), []
    # Without a pause of a window, above the limit in bursts only.
    seconds = [s + rng.randrange(5) for s in range(0, 24_000, 20) for _ in range(3 if s % 1000 else 12)]
    hits = [(i, "hot", START + datetime.timedelta(seconds=s)) for i, s in enumerate(seconds)]
    expected = admitted_by_definition(hits, 10, 60)
    assert len(expected) < len(hits)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context, before = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in (8, 32):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            context.setJobGroup(f"partitions-{partitions}", "")
            df = spark.createDataFrame(hits, "event_id INT, key STRING, ts TIMESTAMP_NTZ").repartition(4)
            assert sorted(r.event_id for r in rate_limit(df, 10, 60).filter("admitted").collect()) == expected
            counts.append(len(context.statusTracker().getJobIdsForGroup(f"partitions-{partitions}")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        context.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] <= counts[0] + 1, counts
