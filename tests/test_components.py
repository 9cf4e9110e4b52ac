"""Contracted labels against a search of the graph."""

import random

from offerloom.plans.components import contracted_labels


def expected(links, nodes):
    near = {n: set() for n in nodes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    root = {}
    for n in sorted(near):
        reached = [n] if n not in root else []
        while reached:
            at = reached.pop()
            if at not in root:
                root[at] = n
                reached.extend(near[at])
    return root


def check(spark, links, nodes):
    df = spark.createDataFrame(links, "a BIGINT, b BIGINT")
    got = contracted_labels(df, spark.createDataFrame([(n,) for n in nodes], "node BIGINT")).collect()
    assert len(got) == len(nodes)
    least = {}
    for row in got:
        least[row.component] = min(least.get(row.component, row.node), row.node)
    assert {row.node: least[row.component] for row in got} == expected(links, nodes)


def test_paths_stars_and_random_links(spark):
    rng = random.Random(21)
    path = [(i, i + 1) for i in range(1000, 1400)]
    star = [(5000, 5000 + i) for i in range(1, 200)]
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + path + star
    check(spark, links + links[:50], sorted({n for link in links for n in link} | {9999}))


def test_no_links_and_links_within_a_node(spark):
    check(spark, [(1, 1)], [1, 2])
