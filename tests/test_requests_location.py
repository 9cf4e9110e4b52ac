"""Requests, allow-list, places and robots rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from offerloom import schemas
from offerloom.functions.geo import distance_from_center, within_radius
from offerloom.operators import location, requests, robots


def test_allowed_domains(spark):
    entries = ["http://Mobila.ro/oferte?x=1 , www.mobila.ro", " ", "HTTPS://unelte.deposit.ro,, ", ""]
    df = spark.createDataFrame([(e,) for e in entries], "entries STRING")
    assert {r.domain for r in requests.allowed_domains(df).collect()} == {"mobila.ro", "unelte.deposit.ro"}


def test_validate_requests(spark):
    rows = [
        ("ok", "  Ghivece  Mari ", "50", None, None, None),
        ("short", "x", "50", True, 30, 60),
        ("blank", "   ", "50", True, 30, 60),
        ("radius", "abc", "75", True, 30, 60),
        ("bounds", "abc", "200", True, 9, 181),
        ("long", "a" * 181, "200", True, 200, 180),
        ("none", None, None, True, 10, 60),
    ]
    df = spark.createDataFrame(rows, schemas.REQUESTS)
    valid = requests.validate_requests(df).collect()
    assert [(r.job_id, r.query, r.query_normalized, r.include_unknown, r.max_urls, r.time_budget_seconds) for r in valid] == [
        ("ok", "Ghivece Mari", "ghivece mari", False, 30, 60)
    ]
    errors = {r.job_id: r.errors for r in requests.rejected_requests(df).collect()}
    assert errors == {
        "short": ["query_length"],
        "blank": ["query_blank"],
        "radius": ["radius_option"],
        "bounds": ["max_urls", "time_budget_seconds"],
        "long": ["query_length"],
        "none": ["query_length", "radius_option"],
    }


def test_distance(spark):
    """Known distances: along the meridian of the centre an arc is as long as its angle."""
    degree = 6371 * math.pi / 180
    points = {
        (44.4268, 26.1025): 0.0,
        (54.4268, 26.1025): 10 * degree,
        (0.0, 26.1025): 44.4268 * degree,
        (90.0, -77.0): (90 - 44.4268) * degree,
        (-90.0, 12.0): (90 + 44.4268) * degree,
        (-44.4268, 26.1025 - 180): 180 * degree,
        (46.7712, 23.6236): 324.4,
    }
    df = spark.createDataFrame(list(points), "lat DOUBLE, lon DOUBLE")
    for r in df.select("lat", "lon", distance_from_center(F.col("lat"), F.col("lon")).alias("d")).collect():
        assert abs(r.d - points[r.lat, r.lon]) < (0.011 if r.lat != 46.7712 else 1.0)
    # East and west of the centre the same way is as far.
    east, west = (distance_from_center(F.lit(44.0), F.lit(26.1025 + x)) for x in (3.5, -3.5))
    row = spark.range(1).select(east.alias("e"), west.alias("w")).first()
    assert row.e == row.w > 200
    assert spark.range(1).select(distance_from_center(F.lit(None).cast("double"), F.lit(1.0)).alias("d")).first().d is None



@pytest.mark.parametrize(
    ("option", "unknown", "km", "city", "kept"),
    [
        ("All Romania", False, None, None, True),
        ("Bucuresti", False, 400.0, "București", True),
        ("Bucuresti", False, 15.0, "Ploiesti", True),
        ("Bucuresti", False, 15.01, "Ploiesti", False),
        ("50", False, 50.0, "Bucuresti", True),
        ("50", True, 50.01, None, False),
        ("100", True, None, "Cluj", True),
        ("100", False, None, "Cluj", False),
        ("200", None, None, None, False),
    ],
)
def test_within_radius(spark, option, unknown, km, city, kept):
    values = [F.lit(option), F.lit(unknown).cast("boolean"), F.lit(km).cast("double"), F.lit(city).cast("string")]
    assert spark.range(1).select(within_radius(*values).alias("x")).first().x is kept


def test_geocoding(spark):
    gazetteer = spark.createDataFrame([("Iasi", "Iasi", "Iasi, Romania", 47.1, 27.6, "Romania")], schemas.GAZETTEER)
    df = spark.createDataFrame([(1, "  Iasi\n"), (2, "Roma  antica"), (3, None), (4, " "), (5, "Roma antica")], "i INT, p STRING")
    joined = {r.i: r.city for r in location.geocode_join(df, gazetteer, "p").collect()}
    assert joined == {1: "Iasi", 2: None, 3: None, 4: None, 5: None}
    assert [r.raw_location for r in location.geocode_misses(df, gazetteer, "p").collect()] == ["Roma antica"]


def can_fetch(rules, agent, url):
    """The first section naming the agent, else ``*``; in it the first rule that is a prefix."""
    host, _, rest = url.removeprefix("https://").partition("/")
    target = "/" + rest
    mine = sorted((r for r in rules if r[0] == host), key=lambda r: r[2])
    named = [r[1] for r in mine if r[1] != "*" and r[1].lower() in agent.lower()]
    section = named[0] if named else "*"
    for _, name, _, allow, path in mine:
        if name == section and target.startswith(path):
            return allow or path == ""
    return True


@pytest.mark.parametrize("rules_per_row", [1_000, 4])
def test_robots_filter(spark, monkeypatch, rules_per_row):
    monkeypatch.setattr(robots, "RULES_PER_ROW", rules_per_row)
    rng = random.Random(11)
    paths = ["/", "/a", "/a/b", "", "/a?x", "/c/", "*", "/ü", "/a/b/c"]
    rules = []
    for h in range(12):
        for n in range(h):
            rules.append((f"h{h}.ro", rng.choice(["*", "OfferBot", "Other", "offer"]), n, rng.random() < 0.5, rng.choice(paths)))
    urls = [f"https://h{h}.ro{p}" for h in range(13) for p in ("/", "/a", "/a/b/d", "/a?x=1", "/c", "/c/d", "/ü", "/z")] * 2
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i INT, url STRING")
    table = spark.createDataFrame(rules, schemas.ROBOTS_RULES)
    got = sorted(r.i for r in robots.robots_filter(df, table, "OfferBot/1.0").collect())
    assert got == [i for i, u in enumerate(urls) if can_fetch(rules, "offerbot", u)]


def test_robots_targets_are_unquoted(spark):
    urls = ["https://h.ro/a%20b+c", "https://h.ro", "https://h.ro/%zz", "https://h.ro?q"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i INT, url STRING")
    got = df.orderBy("i").select(robots._target(F.col("url")).alias("t")).collect()
    assert [r.t for r in got] == ["/a b+c", "/", "/%zz", "?q"]


def test_robots_rules_are_unquoted(spark):
    rules = spark.createDataFrame([("h.ro", "*", 0, False, "/a%20b"), ("h.ro", "*", 1, False, "/c d")], schemas.ROBOTS_RULES)
    urls = ["https://h.ro/a%20b/x", "https://h.ro/c%20d", "https://h.ro/a"]
    df = spark.createDataFrame([(u,) for u in urls], "url STRING")
    assert [r.url for r in robots.robots_filter(df, rules, "OfferBot/1.0").collect()] == ["https://h.ro/a"]
