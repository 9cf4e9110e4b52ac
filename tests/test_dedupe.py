"""Two-key keep-first against the sequential loop."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from offerloom.operators import dedupe
from offerloom.plans import joins

ORDER = ["ord"]


def loop(rows):
    kept, seen_a, seen_b = [], {}, {}
    for job, n, a, b in sorted(rows, key=lambda r: r[1]):
        if a not in seen_a.setdefault(job, set()) and b not in seen_b.setdefault(job, set()):
            seen_a[job].add(a)
            seen_b[job].add(b)
            kept.append(n)
    return sorted(kept)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "job_id STRING, ord INT, a STRING, b STRING")
    kept = dedupe.dedupe_results(df, ORDER, ["a"], ["b"], **options)
    assert kept.columns == df.columns
    return sorted(r.ord for r in kept.collect())


def make(rng, n, jobs, keys):
    # A third of the rows of a job share one first key.
    rows = [
        (f"j{rng.randrange(jobs)}", i, "hot" if rng.random() < 0.33 else f"a{rng.randrange(keys)}", f"b{rng.randrange(keys)}")
        for i in range(n)
    ]
    rng.shuffle(rows)
    return rows


def test_ordinary_jobs(spark):
    rows = make(random.Random(1), 3000, 40, 12)
    assert run(spark, rows) == loop(rows)


@pytest.mark.parametrize("seed", [2, 3])
def test_large_jobs_take_rounds(spark, seed):
    rows = make(random.Random(seed), 800, 3, 60)
    assert run(spark, rows, job_rows=25) == loop(rows)


def test_rounds_with_salted_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_KEYS", 2)
    rows = make(random.Random(4), 500, 1, 200)
    assert run(spark, rows, job_rows=20) == loop(rows)


def test_chain_is_decided_in_order(spark):
    # Each row shares a key with the next: every second one stays.
    rows = [("j", i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(60)]
    assert run(spark, rows, job_rows=40) == list(range(0, 60, 2))


def test_chains_of_a_large_job_are_walked_side_by_side(spark, monkeypatch):
    # Three chains of 1,000 rows, read in turn, and many single rows: no round is needed.
    def no_round(*args):
        raise AssertionError("a component within the bound went through a round")

    monkeypatch.setattr(dedupe, "_round", no_round)
    chains = [("j", 3 * i + c, f"a{c}-{i // 2}", f"b{c}-{(i + 1) // 2}") for i in range(1000) for c in range(3)]
    single = [("j", 5000 + i, f"x{i}", f"y{i}") for i in range(500)]
    other = [("k", i, f"a0-{i // 2}", f"b0-{(i + 1) // 2}") for i in range(1400)]
    rows = chains + single + other
    assert run(spark, rows, job_rows=1450) == loop(rows)


def test_giant_component_beside_chains(spark):
    # A star whose rows share a key is above the bound, chains hang on some of its rows.
    rng = random.Random(11)
    star = [("j", rng.randrange(10**6), "hub", f"s{i}") for i in range(300)]
    tails = [("j", rng.randrange(10**6), f"t{i}-{k // 2}", f"s{i}" if k == 0 else f"u{i}-{(k + 1) // 2}") for i in range(20) for k in range(8)]
    chains = [("j", 2 * 10**6 + i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(90)]
    rows = star + tails + chains
    assert run(spark, rows, job_rows=100) == loop(rows)


def test_price_text_decides_and_zero_is_none(spark):
    rows = [(1, "0.00", None, "s1"), (2, None, "", "s2"), (3, "49.9", "c", "s3"), (4, "49.90", "d", "s4"), (5, "0", "e", "s5")]
    df = spark.createDataFrame(rows, "ord INT, price_token STRING, canonical_url STRING, source_url STRING")
    df = df.withColumn("job_id", F.lit("j")).withColumn("normalized_name", F.lit("n")).withColumn("domain", F.lit("d"))
    kept = dedupe.dedupe_results(dedupe.with_offer_keys(df), ORDER)
    assert sorted((r.ord, r.price_key, r.url_key) for r in kept.collect()) == [(1, "", "s1"), (3, "49.9", "c"), (4, "49.90", "d")]


def test_first_rows_of_pairs_are_spread_before_the_sort(spark):
    rows = [(None if i % 3 else "j", 7 * i % 2000, f"a{i % 40}" if i % 2 else "hot", f"b{i % 30}" if i % 2 else "hot") for i in range(2000)]
    df = spark.createDataFrame(rows, "job_id STRING, ord INT, a STRING, b STRING")
    got = dedupe._first_per_pair(df, "job_id", ["a"], ["b"], ["ord"])
    first = {}
    for job, at, a, b in rows:
        first[job, a, b] = min(at, first.get((job, a, b), at))
    assert sorted(map(str, got.collect())) == sorted(map(str, [Row(job_id=j, ord=n, a=a, b=b) for (j, a, b), n in first.items()]))
    plan = got._jdf.queryExecution().sparkPlan().toString()
    # Below the last shuffle by a fixed number of parts nothing is sorted.
    assert "REPARTITION_BY_NUM" in plan and "Sort" not in plan.rpartition("REPARTITION_BY_NUM")[2]
