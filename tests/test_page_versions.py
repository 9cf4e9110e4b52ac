"""The newest version of a page, chosen without moving its source."""

import os
import random

import pytest

from offerloom.sources import tables


def write(spark, path, rows, files=4):
    df = spark.createDataFrame(rows, "url STRING, crawl INT, html STRING, _file STRING, id INT")
    df.repartition(files).write.mode("append").parquet(path)


def newest(stored):
    best = {}
    for r in stored:
        if r.url is not None:
            at = (r.crawl is not None, r.crawl or 0, r.at.file, r.at.place)
            best[r.url] = max(best.get(r.url, (at, r.id)), (at, r.id))
    return sorted([i for _, i in best.values()] + [r.id for r in stored if r.url is None])


@pytest.mark.parametrize("bound", [tables.BROADCAST_BYTES, 3 * tables.BITMAP_BYTES])
def test_newest_version(spark, tmp_path, monkeypatch, bound):
    rng, path = random.Random(31), str(tmp_path / "pages")
    urls = [f"https://a.ro/{i}" for i in range(40)] + ["https://a.ro/hot"] * 40 + [None]
    rows = [(rng.choice(urls), rng.choice([None, 1, 1, 2, 3]), "x" * rng.randrange(50), "f", i) for i in range(600)]
    for k in range(3):
        write(spark, path, rows[200 * k : 200 * k + 200])
    monkeypatch.setattr(tables, "BROADCAST_BYTES", bound)
    got = tables.read_pages(spark, path, version="crawl")
    assert got.columns == ["url", "crawl", "html", "_file", "id"]
    stored = spark.read.parquet(path).selectExpr(
        "url", "crawl", "id", "struct(_metadata.file_path AS file, _metadata.row_index AS place) AS at"
    )
    assert sorted(r.id for r in got.collect()) == newest(stored.collect())
    assert tables.read_pages(spark, path).count() == 600


def test_source_is_not_shuffled(spark, tmp_path, capsys):
    path = str(tmp_path / "pages")
    write(spark, path, [(f"u{i % 7}", i, "x", "f", i) for i in range(30)])
    got = tables.read_pages(spark, path, version="crawl")
    got.explain()
    plan = capsys.readouterr().out
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan and "html" in plan
    assert sorted(r.id for r in got.collect()) == list(range(23, 30))


def test_empty_snapshot(spark, tmp_path):
    path = str(tmp_path / "pages")
    write(spark, path, [("u", 1, "x", "f", 1)])
    spark.read.parquet(path).limit(0).write.parquet(f"{path}-empty")
    assert tables.read_pages(spark, f"{path}-empty", version="crawl").count() == 0
    assert os.path.isdir(path)
