"""Operators on vectors and conversations, and the SQL definitions."""

import re

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_points
from offerloom.llm import catalog, gridjoin, preferences, topk
from offerloom.llm.oracles import ORACLES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_definition(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = catalog.QUERIES[name](spark, FOLDER)
    result = db.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    ours = sorted(str(tuple(r)) for r in df.select(*columns).collect())
    assert ours == sorted(str(tuple(r)) for r in result.fetchall())


def test_all_are_registered():
    names = entry_points.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op4_secrets", "op8_preferences"])
def test_native_plans(spark, name):
    plan = catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def cosine(a, b):
    n = max(len(a), len(b))
    a, b = (np.array([*x, *[0.0] * (n - len(x))], float) for x in (a, b))
    return a @ b / (np.linalg.norm(a) * np.linalg.norm(b))


def linked(rows, limit):
    good = {
        i for i, v in enumerate(rows) if v[1] is not None and len(v[1]) and all(x is not None and np.isfinite(x) for x in v[1]) and any(v[1])
    }
    near = {i: [j for j in good if j != i and cosine(rows[i][1], rows[j][1]) >= limit] if i in good else [] for i in range(len(rows))}
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = set(), [i]
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo += near[at]
        out.append((key, len(near[i]), min(rows[j][0] for j in seen)))
    return sorted(out)


@pytest.mark.parametrize(("block", "limit"), [(4096, 0.9), (16, 0.9), (8, 0.5), (16, 0.999)])
def test_vector_links(spark, monkeypatch, block, limit):
    monkeypatch.setattr(gridjoin, "BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 5))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 9] + rng.normal(size=5) * 0.25]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(20)] + [(300, [x * 7 for x in rows[3][1]])]
    rows += [(400, None), (401, []), (402, [0.0] * 5), (403, [1.0, None, 0.0]), (404, [float("nan")] * 5), (405, [float("inf"), 0.0])]
    rows += [(406, [1.0, 2.0]), (407, [1.0, 2.0, 0.0, -0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "1 AS node", "1 AS v")
    found = gridjoin.similar(df.repartition(4), "vec_id", "embedding", limit).collect()
    assert sorted(map(tuple, found)) == linked(rows, limit)


def test_vector_links_of_few_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert gridjoin.similar(empty, "vec_id", "embedding").collect() == []
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.1]), (5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted(map(tuple, gridjoin.similar(df, "vec_id", "embedding").collect()), key=str)
    assert found == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (5, 0, 5)], key=str)


@pytest.mark.parametrize(("block", "queries", "shard"), [(2048, 512, 8), (7, 4, 2), (16, 3, 1)])
def test_top_k(spark, monkeypatch, block, queries, shard):
    for name, value in (("BLOCK", block), ("QUERIES", queries), ("SHARD", shard)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.integers(-4, 5, 6)]) for i in range(90)]
    rows[10:40] = [(i, [float(x) + 20 for x in v]) for i, v in rows[10:40]]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")]), (None, [9.0] * 6), (203, [3.0]), (204, [])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").selectExpr("*", "'x' AS vec", "'x' AS score").repartition(3)
    found = topk.top_k(df, "vec_id", "v", df.vec_id % 3 == 0, 5).collect()
    good = {i: [*v, *[0.0] * (6 - len(v))] for i, v in rows if i is not None and v is not None and not any(x is None or x != x for x in v)}
    expected = []
    for q, v in good.items():
        if q % 3 == 0:
            best = sorted((-int(np.dot(v, w)), i) for i, w in good.items() if i != q)[:5]
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, found)) == sorted(expected)


def test_top_k_of_few_and_of_large_rows(spark):
    schema = "vec_id long, v array<double>"
    none = spark.createDataFrame([], schema)
    assert topk.top_k(none, "vec_id", "v", none.vec_id > 0).collect() == []
    big = spark.createDataFrame([(2, [2.0**40 + 1]), (4, [2.0**20 + 1]), (6, [2.0**62])], schema)
    found = sorted(map(tuple, topk.top_k(big, "vec_id", "v", big.vec_id == 2).collect()))
    assert found == [(2, 1, 6, 2**63 - 1), (2, 2, 4, (2**40 + 1) * (2**20 + 1))]
    alone = spark.createDataFrame([(2, [1.0])], schema)
    assert topk.top_k(alone, "vec_id", "v", alone.vec_id == 2).collect() == []


@pytest.mark.parametrize(("cell", "shards", "scale"), [(1, 64, 1), (600, 1, 1), (32 << 20, 1, 300), (1, 64, 70000), (600, 64, 1 << 22)])
def test_top_k_in_cells(spark, monkeypatch, cell, shards, scale):
    """Several tiles and shards, a block that bounds all queries, repeated ids, values of all widths."""
    for name, value in (("BLOCK", 7), ("QUERIES", 4), ("SHARD", 2), ("CELL", cell), ("SHARDS", shards)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.integers(-4, 5, 6) * scale]) for i in range(120)]
    rows += [(i % 9, [float(x) for x in rng.integers(-4, 5, 6) * scale]) for i in range(60)]
    rows += [(500, [9.0 * scale] * 6), (500, [-9.0 * scale] * 6), (501, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3)
    expected = []
    for q, v in rows:
        if q % 2 == 0:
            best = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q)[:5]
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(df, "vec_id", "v", df.vec_id % 2 == 0, 5).collect())) == sorted(expected)
    assert topk.top_k(df, "vec_id", "v", df.vec_id < 0, 5).collect() == []


def test_top_k_keeps_vectors_off_the_driver(spark, monkeypatch):
    """No join broadcasts them, however small they look as files, and no sort samples them."""
    plans, kinds = [], set()

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    def numbered(df, keys, name, run=topk.numbered):
        kinds.update(kind for _, kind in df.select(*keys).dtypes)
        return run(df, keys, name)

    monkeypatch.setattr(topk, "stored", lambda df, purpose, run=topk.stored: run(seen(df), purpose))
    monkeypatch.setattr(topk, "numbered", numbered)
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, v array<double>")
    assert seen(topk.top_k(df, "vec_id", "v", df.vec_id < 3, 2)).count() == 6
    assert kinds == {"bigint"}
    assert {key for plan in plans for key in re.findall(r"BroadcastHashJoin \[(\w+)#", plan)} <= {"_p"}
    assert not any("NestedLoopJoin" in plan for plan in plans)


def test_preferences(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "yes"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "more"), (2, 3, "assistant", "näin"),
        (3, 0, "user", "hi"), (3, 0, "user", "hi"), (3, None, None, None), (None, 0, "user", "lost"),
        (4, 0, "user", "alone"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS conv", "1 AS turns")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 3, 1), (3, 4, 9), (4, 1, 1), (5, 1, None)], "pair_id long, chosen_id long, rejected_id long")
    found = {r.pair_id: r for r in preferences.format_preferences(pairs, turns).collect()}
    end = preferences.END
    one = found[1]
    assert one.n_prefix == 3 and one.prompt == f"<|user|>\nhi{end}<|assistant|>\nhello{end}<|user|>\nmore{end}"
    assert one.chosen == f"<|assistant|>\nyes{end}" and one.rejected == f"<|assistant|>\nnäin{end}"
    a, b = map(int, one.rejected_mask.split(":"))
    assert one.rejected[a:b] == f"näin{end}" and b == len(one.rejected)
    two = found[2]
    assert two.n_prefix == 1 and two.chosen == f"<|user|>\nhi{end}<|unknown|>\n{end}" and two.chosen_mask == ""
    assert [two.rejected[int(a) : int(b)] for a, b in (m.split(":") for m in two.rejected_mask.split(","))] == [f"hello{end}", f"yes{end}"]
    assert found[3].n_prefix == 0 and found[3].rejected == "" and found[5].rejected == "" and found[5].chosen != ""
    assert found[4].n_prefix == 4 and found[4].chosen == found[4].rejected == found[4].chosen_mask == ""
    paired = preferences.neighbours(turns, "conv_id", "turn", "role", "text").collect()
    assert sorted(x for p in paired for x in (p.chosen_id, p.rejected_id) if x is not None) == [1, 2, 3, 4]
    assert preferences.neighbours(turns.limit(0), "conv_id", "turn", "role", "text").collect() == []


def test_prompt_pairs(spark):
    """Every prompt of an even number pairs all, wherever it stands; what is left meets at an earlier turn."""
    rows = []
    for i in range(300):
        rows += [(i, 0, "system", "be kind"), (i, 1, "user", f"question {i % 150 if i < 250 else i}"), (i, 2, "assistant", f"answer {i}")]
    for i, last in ((400, "x"), (401, "x"), (402, "x"), (403, "y")):
        rows += [(i, 0, "user", "hi"), (i, 1, "assistant", "hello"), (i, 2, "user", last), (i, 3, "assistant", str(i))]
    rows += [(500, 0, "assistant", "no question"), (None, 0, "user", "hi")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)
    columns = ("conv_id", "turn", "role", "text")
    pairs = preferences.prompt_pairs(turns, *columns)
    found = {tuple(r)[1:] for r in pairs.collect()}
    together = {(i, i + 150) for i in range(100)}
    assert found == together | {(i, None) for i in [*range(100, 150), *range(250, 300), 500]} | {(400, 401), (402, 403)}
    shared = {r.pair_id: r.n_prefix for r in preferences.format_preferences(pairs, turns).collect() if r.rejected_id is not None}
    assert shared == {**{i: 2 for i in range(100)}, 400: 3, 402: 2}
    by_place = preferences.neighbours(turns, *columns).collect()
    assert len({(p.chosen_id, p.rejected_id) for p in by_place} & together) < 100
    assert preferences.prompt_pairs(turns.limit(0), *columns).collect() == []
