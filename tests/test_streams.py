"""A stream over split files gives the rows of the batch operator, also after a restart."""

import datetime
import random
import time

from pyspark.sql import functions as F

from offerloom.operators.dedupe import dedupe_results
from offerloom.operators.extract import extract_products
from offerloom.operators.ratelimit import rate_limit
from offerloom.operators.results import job_status
from offerloom.sources.tables import read_pages, stream_table
from offerloom.streaming import jobs


def write_parts(df, path, parts):
    for p in parts:
        df.filter(F.col("part") == p).drop("part").coalesce(1).write.mode("append").parquet(path)


def stream(spark, df, path):
    return stream_table(spark, path, df.drop("part").schema, files_per_trigger=1)


def test_stream_extract(spark, tmp_path):
    html = "<html><h1>Ghiveci {0}</h1><p>{0},50 lei in Cluj, 3 kg</p></html>"
    pages = spark.createDataFrame(
        [(i % 3, f"https://a.ro/p/{i}", html.format(i)) for i in range(12)], "part INT, url STRING, html STRING"
    )
    source, folder = str(tmp_path / "pages"), str(tmp_path / "run")
    write_parts(pages, source, [0, 1])
    jobs.stream_extract(stream(spark, pages, source), folder).awaitTermination()
    write_parts(pages, source, [2])
    jobs.stream_extract(stream(spark, pages, source), folder).awaitTermination()
    got = spark.read.parquet(f"{folder}/products")
    expected = extract_products(read_pages(spark, source))
    assert sorted(map(str, got.select(*expected.columns).collect())) == sorted(map(str, expected.collect()))
    assert got.count() == 12


def test_stream_dedupe(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i // 100, f"j{rng.randrange(3)}", i, f"a{rng.randrange(60)}", f"b{rng.randrange(60)}") for i in range(300)]
    df = spark.createDataFrame(rows, "part INT, job_id STRING, ord INT, a STRING, b STRING")
    source, folder = str(tmp_path / "rows"), str(tmp_path / "run")
    for part in range(3):
        write_parts(df, source, [part])
        jobs.stream_dedupe(stream(spark, df, source), folder, ["ord"], ["a"], ["b"]).awaitTermination()
    got = sorted(r.ord for r in jobs.read_batches(spark, folder, "kept").collect())
    assert got == sorted(r.ord for r in dedupe_results(df.drop("part"), ["ord"], ["a"], ["b"]).collect())


def test_stream_dedupe_over_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(9)
    rows = [
        (i // 60, None if i % 17 == 0 else f"j{rng.randrange(4)}", i, rng.choice(["a", None, "b", "c", "d"]), rng.randrange(3), f"u{rng.randrange(40)}")
        for i in range(420)
    ]
    df = spark.createDataFrame(rows, "part INT, job_id STRING, ord BIGINT, a STRING, b INT, u STRING")
    source, folder = str(tmp_path / "rows"), str(tmp_path / "run")
    args = (["ord"], ["a", "b"], ["u"])
    write_parts(df, source, range(5))
    jobs.stream_dedupe(stream(spark, df, source), folder, *args).awaitTermination()
    write_parts(df, source, [5, 6])
    query = jobs.stream_dedupe(stream(spark, df, source), folder, *args)
    query.awaitTermination()
    assert query.lastProgress["batchId"] == 6 and query.lastProgress["stateOperators"][0]["numRowsTotal"] > 0
    got = jobs.read_batches(spark, folder, "kept")
    assert got.columns == df.drop("part").columns
    expected = dedupe_results(df.drop("part"), *args)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_keys_of_old_jobs_are_forgotten(spark, tmp_path):
    df = spark.createDataFrame([(p, "j", 10 * p + i, f"a{i}", f"b{i}") for p in range(3) for i in range(4)], "part INT, job_id STRING, ord INT, a STRING, b STRING")
    source, counts = str(tmp_path / "rows"), []
    for ttl in (2, None):
        folder = str(tmp_path / f"run{ttl}")
        for part in range(2):
            write_parts(df, f"{source}{ttl}", [part])
            query = jobs.stream_dedupe(stream(spark, df, f"{source}{ttl}"), folder, ["ord"], ["a"], ["b"], ttl_seconds=ttl)
            query.awaitTermination()
            time.sleep(3)
        counts.append(jobs.read_batches(spark, folder, "kept").count())
    assert counts == [8, 4]  # after its time a key is new again; without a time it never is


def test_stream_rate_limit(spark, tmp_path):
    rng = random.Random(6)
    start = datetime.datetime(2024, 1, 1)
    seconds = sorted(rng.randrange(900) for _ in range(300))
    rows = [
        (i // 100, i, "hot" if rng.random() < 0.5 else f"k{rng.randrange(4)}", start + datetime.timedelta(seconds=s))
        for i, s in enumerate(seconds)
    ]
    df = spark.createDataFrame(rows, "part INT, event_id INT, key STRING, ts TIMESTAMP_NTZ")
    source, folder = str(tmp_path / "hits"), str(tmp_path / "run")
    for part in range(3):
        write_parts(df, source, [part])
        jobs.stream_rate_limit(stream(spark, df, source), folder, 3, 60).awaitTermination()
    got = {r.event_id: r.admitted for r in jobs.read_batches(spark, folder, "decided").collect()}
    assert got == {r.event_id: r.admitted for r in rate_limit(df.drop("part"), 3, 60).collect()}

    # A hit older than what was decided before is set aside.
    old = spark.createDataFrame([(0, 999, "hot", start)], df.schema)
    write_parts(old, source, [0])
    jobs.stream_rate_limit(stream(spark, df, source), folder, 3, 60).awaitTermination()
    assert [r.event_id for r in jobs.read_batches(spark, folder, "late").collect()] == [999]
    assert jobs.read_batches(spark, folder, "decided").count() == 300


def test_late_hits_are_put_in_order(spark, tmp_path):
    start = datetime.datetime(2024, 3, 31, 1, 0)
    # Out of order by at most 200 seconds, across the change of the clocks in many zones.
    seconds = [i * 40 + (-160 if i % 7 == 3 else 0) for i in range(300)]
    rows = [(i // 100, i, None if i % 11 == 0 else f"k{i % 3}", start + datetime.timedelta(seconds=s)) for i, s in enumerate(seconds)]
    df = spark.createDataFrame(rows, "part INT, event_id INT, key STRING, ts TIMESTAMP_NTZ")
    source, folder = str(tmp_path / "hits"), str(tmp_path / "run")
    for part in range(3):
        write_parts(df, source, [part])
        query = jobs.stream_rate_limit(stream(spark, df, source), folder, 2, 240, lateness_seconds=200, trigger={"once": True})
        query.awaitTermination()
    got = {r.event_id: r.admitted for r in jobs.read_batches(spark, folder, "decided").collect()}
    expected = {r.event_id: r.admitted for r in rate_limit(df.drop("part"), 2, 240).collect()}
    newest = max(seconds)
    assert got == {i: a for i, a in expected.items() if seconds[i] <= newest - 200}
    assert jobs.read_batches(spark, folder, "late").count() == 0 and 0 < sum(got.values()) < len(got)


def test_keyed_rate_limit_over_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(16)
    start = datetime.datetime(2024, 3, 31, 1, 0)
    # Out of order by less than 200 seconds, many at one time, a third under one key, some without a key or a time.
    rows = [
        (
            i // 60,
            i,
            None if i % 13 == 0 else "hot" if rng.random() < 0.33 else f"k{rng.randrange(5)}",
            None if i % 97 == 0 else start + datetime.timedelta(seconds=(i // 3) * 20 - rng.choice([0, 0, 0, 60, 150])),
        )
        for i in range(420)
    ]
    df = spark.createDataFrame(rows, "part INT, event_id INT, key STRING, ts TIMESTAMP_NTZ")
    source, folder = str(tmp_path / "hits"), str(tmp_path / "run")
    args = {"limit": 2, "window_seconds": 300, "lateness_seconds": 200}
    for parts in (range(5), [5, 6]):
        write_parts(df, source, parts)
        query = jobs.stream_rate_limit_keyed(stream(spark, df, source), folder, **args)
        query.awaitTermination()
    got = jobs.read_batches(spark, folder, "hits")
    assert got.filter("late").count() == 0
    expected = {r.event_id: r.admitted for r in rate_limit(df.drop("part"), 2, 300).collect()}
    newest = max(r[3] for r in rows if r[3])
    settled = {r[1] for r in rows if r[3] and r[3] <= newest - datetime.timedelta(seconds=200)}
    assert {r.event_id: r.admitted for r in got.collect()} == {i: expected[i] for i in settled}
    assert 0 < got.filter("admitted").count() < got.count()

    # One hit far ahead settles all others and lets the state of their keys go; one far behind is late.
    ahead = start + datetime.timedelta(days=1)
    for k, (event, at) in enumerate([(900, ahead), (901, ahead), (902, start)]):
        write_parts(spark.createDataFrame([(0, event, f"x{k}", at)], df.schema), source, [0])
        query = jobs.stream_rate_limit_keyed(stream(spark, df, source), folder, **args)
        query.awaitTermination()
    got = jobs.read_batches(spark, folder, "hits")
    assert [r.event_id for r in got.filter("late").collect()] == [902]
    assert {r.event_id: r.admitted for r in got.filter("NOT late").collect()} == expected
    # Hits of two keys wait; of every other key nothing is left, neither hits nor times nor timers.
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * 5


def test_keyed_rate_limit_in_order_decides_the_newest(spark, tmp_path):
    # Without lateness, and with equal times on both sides of a batch border.
    rng = random.Random(26)
    start = datetime.datetime(2024, 1, 1)
    seconds = sorted(rng.randrange(60) for _ in range(300))
    rows = [(i // 100, i, f"k{rng.randrange(3)}", start + datetime.timedelta(seconds=s)) for i, s in enumerate(seconds)]
    assert any(seconds[i - 1] == seconds[i] for i in (100, 200))
    df = spark.createDataFrame(rows, "part INT, event_id INT, key STRING, ts TIMESTAMP_NTZ")
    source, folder = str(tmp_path / "hits"), str(tmp_path / "run")
    write_parts(df, source, range(3))
    jobs.stream_rate_limit_keyed(stream(spark, df, source), folder, 3, 10).awaitTermination()
    got = jobs.read_batches(spark, folder, "hits")
    assert got.columns == ["event_id", "key", "ts", "admitted", "late"] and got.filter("late").count() == 0
    expected = {r.event_id: r.admitted for r in rate_limit(df.drop("part"), 3, 10).collect()}
    assert {r.event_id: r.admitted for r in got.collect()} == expected


def test_stream_progress(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i // 40, f"j{rng.randrange(5)}", rng.random() < 0.7, rng.random() < 0.3, rng.random() < 0.1) for i in range(120)]
    df = spark.createDataFrame(rows, "part INT, job_id STRING, processed BOOLEAN, found BOOLEAN, error BOOLEAN")
    source, folder = str(tmp_path / "items"), str(tmp_path / "run")
    for part in range(3):
        write_parts(df, source, [part])
        jobs.stream_progress(stream(spark, df, source), folder).awaitTermination()
    job_ids = df.select("job_id", F.lit("running").alias("status")).distinct()
    counters = ["job_id", "total_candidate_urls", "processed_urls", "found_products", "errors"]
    expected = job_status(job_ids, df.drop("part")).select(*counters)
    got = jobs.latest_progress(spark, folder).select(*counters)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_progress_totals_and_expiry(spark, tmp_path):
    rng = random.Random(17)
    rows = [(i // 30, None if i % 19 == 0 else f"j{i // 60}", rng.random() < 0.7, rng.random() < 0.3, None if i % 7 == 0 else False) for i in range(150)]
    df = spark.createDataFrame(rows, "part INT, job_id STRING, processed BOOLEAN, found BOOLEAN, error BOOLEAN")
    source, folder = str(tmp_path / "items"), str(tmp_path / "run")
    write_parts(df, source, range(3))
    query = jobs.stream_progress(stream(spark, df, source), folder, ttl_seconds=3)
    query.awaitTermination()
    names = jobs.COUNTERS
    sums = jobs.latest_progress(spark, folder).agg(*[F.sum(c).alias(c) for c in names]).first().asDict()
    assert jobs.run_totals(query) == sums and sums["total_candidate_urls"] == 90
    held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    time.sleep(8)
    write_parts(df, source, [4])
    query = jobs.stream_progress(stream(spark, df, source), folder, ttl_seconds=3)
    query.awaitTermination()
    # The jobs of the first run are over and forgotten; one that came back is counted on.
    assert held >= 1 and query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
    assert jobs.run_totals(query)["total_candidate_urls"] == 30
    items = df.filter("part <> 3").drop("part")
    expected = items.groupBy("job_id").agg(F.count("*").alias("n"), F.count_if("found").alias("f"))
    got = jobs.latest_progress(spark, folder).select("job_id", "total_candidate_urls", "found_products")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, expected.collect())))


def test_keyed_rate_limit_keeps_a_class_of_keys_together(spark, tmp_path):
    rng = random.Random(36)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i // 200, i, f"k{rng.randrange(80)}", start + datetime.timedelta(seconds=i)) for i in range(600)]
    df = spark.createDataFrame(rows, "part INT, event_id INT, key STRING, ts TIMESTAMP_NTZ")
    source, folder = str(tmp_path / "hits"), str(tmp_path / "run")
    write_parts(df, source, range(3))
    query = jobs.stream_rate_limit_keyed(stream(spark, df, source), folder, 3, 100, lateness_seconds=50, classes=4)
    query.awaitTermination()
    # Hits of the last 50 seconds wait, and 80 keys have times: two values and a timer a class.
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4 * 5
    got = {r.event_id: r.admitted for r in jobs.read_batches(spark, folder, "hits").collect()}
    expected = {r.event_id: r.admitted for r in rate_limit(df.drop("part"), 3, 100).collect()}
    assert got == {i: expected[i] for i in range(550)}
