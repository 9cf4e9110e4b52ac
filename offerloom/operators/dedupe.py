"""Duplicate offers: in order, skip a row if its first or its second key was kept before.

Seen as a graph with the keys as nodes and the rows as edges, the kept rows are
the first maximal matching in row order.  Jobs of ordinary size (a request has
at most 200 URLs) are walked in order after one shuffle by job.  Larger ones are
split into the connected components of their graph, which do not touch each
other, so those of ordinary size are walked side by side.  Only the rows of
larger components go through rounds of aggregations: a row that is first for
both of its keys is kept, rows sharing a key with it are dropped.  After one
round, then two, four and so on, what is left is split again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.functions.urls import url_key
from offerloom.plans.checkpoints import materialize
from offerloom.plans.components import contracted_labels
from offerloom.plans.joins import hot_keys, lookup_join

JOB_ROWS = 10_000
SALTS = 64
# Tasks that find the first rows of pairs of keys; up to as many, a shuffle sorts nothing on its way there.
PAIR_PARTS = 200

OFFER_KEY = ["normalized_name", "domain", "price_key"]
URL_KEY = ["url_key"]


def with_offer_keys(results: DataFrame) -> DataFrame:
    """Add the texts the duplicate test compares: a price of zero counts as none."""
    token = F.col("price_token")
    price = F.when(token.rlike(r"\A[0.]*\z"), "").otherwise(F.coalesce(token, F.lit("")))
    return results.withColumn("price_key", price).withColumn(
        "url_key", url_key(F.col("canonical_url"), F.col("source_url"))
    )


def _first_per_pair(rows: DataFrame, job: str, first: list[str], second: list[str], order: list[str]) -> DataFrame:
    """Only the first row of each pair of keys can be kept.

    Whole rows are compared, which takes a sort.  So rows are spread over many tasks by their pair
    before it, and not sorted by the tasks that read them, which may hold any number.  Rows of a
    pair with a large share are spread as well, and the first ones of its shares compared.
    """
    keys = [job, *first, *second]
    rest = [c for c in rows.columns if c not in {*keys, *order}]

    def least(df: DataFrame, groups: list[str]) -> DataFrame:
        firsts = df.groupBy(*groups).agg(F.min(F.struct(*order, *rest)).alias("_row"))
        return firsts.select(*groups, "_row.*")

    # Hashes are never null; where two pairs share one, both are spread.
    hashed = rows.withColumn("_pair", F.xxhash64(*keys))
    hot = hot_keys(hashed, ["_pair"])
    if hot.isEmpty():
        return least(rows.repartition(PAIR_PARTS, *keys), keys).select(*rows.columns)
    marked = hashed.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "_pair", "left")
    salted = marked.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*order), F.lit(SALTS))).otherwise(-1))
    firsts = least(salted.drop("_pair", "_hot").repartition(PAIR_PARTS, *keys, "_salt"), [*keys, "_salt"])
    single, shares = firsts.filter("_salt < 0").drop("_salt"), firsts.filter("_salt >= 0").drop("_salt")
    return single.select(*rows.columns).unionByName(least(shares, keys).select(*rows.columns))


def _walk(rows: DataFrame, groups: list[str], first: list[str], second: list[str], order: list[str]) -> DataFrame:
    """Sequential pass over groups of bounded size, many groups per task.

    The rows arrive sorted by group and order; only the keys kept of the current
    group are held.  Of a row only its group and keys become Python values.
    """

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen_first, seen_second = None, set(), set()
        for batch in batches:
            accepted = []
            names = zip(*[batch.column(c).to_pylist() for c in groups], strict=True)
            keys_of = zip(*[batch.column(c).to_pylist() for c in (*first, *second)], strict=True)
            for name, keys in zip(names, keys_of, strict=True):
                if name != current:
                    current, seen_first, seen_second = name, set(), set()
                a, b = keys[: len(first)], keys[len(first) :]
                accept = a not in seen_first and b not in seen_second
                if accept:
                    seen_first.add(a)
                    seen_second.add(b)
                accepted.append(accept)
            yield batch.filter(pa.array(accepted, pa.bool_()))

    in_order = rows.repartition(*groups).sortWithinPartitions(*groups, *order)
    return in_order.mapInArrow(keep, rows.schema)


def _round(rows: DataFrame, job: str, first: list[str], second: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows kept by one round, and the rows it leaves undecided.

    The minimum per key is a map-side aggregation.  Dropping is an anti join
    whose large side is salted for the most frequent keys, so that no key's
    rows end up in one task.
    """
    position = F.struct(*order, *first, *second)
    by_first = rows.groupBy(job, *first).agg(F.min(position).alias("_at")).select(job, "_at")
    by_second = rows.groupBy(job, *second).agg(F.min(position).alias("_at")).select(job, "_at")
    kept_at = materialize(by_first.join(by_second, [job, "_at"], "left_semi"))
    kept_keys = kept_at.select(job, "_at.*")
    kept = rows.join(kept_keys.select(job, *first, *second), [job, *first, *second], "left_semi")

    def without(open_rows: DataFrame, key: list[str]) -> DataFrame:
        keys = [job, *key]
        hot = F.broadcast(hot_keys(rows, keys).withColumn("_hot", F.lit(True)))
        spread = F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int")
        salted = open_rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(0))
        copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        taken = kept_keys.select(*keys).join(hot, keys, "left").withColumn("_salt", F.explode(copies))
        return salted.drop("_hot").join(taken.drop("_hot"), [*keys, "_salt"], "left_anti").drop("_salt")

    return kept, materialize(without(without(rows, first), second).select(*rows.columns))


def _with_components(rows: DataFrame, job: str, first: list[str], second: list[str]) -> DataFrame:
    """Add ``_part``, the component of a row in the graph of its job.

    Nodes are hashes of keys.  Where two of them agree, components are walked
    together that could have been walked apart, and the rows kept are the same.
    """
    a = F.xxhash64(F.lit(1), job, *first)
    links = rows.select(a.alias("a"), F.xxhash64(F.lit(2), job, *second).alias("b")).distinct()
    labels = contracted_labels(links, links.select(F.col("a").alias("node")).distinct())
    named = labels.withColumnsRenamed({"node": "_node", "component": "_part"})
    return lookup_join(rows.withColumn("_node", a), named, ["_node"], "left").select(*rows.columns, "_part")


def dedupe_results(
    rows: DataFrame,
    order: list[str],
    first: list[str] | None = None,
    second: list[str] | None = None,
    job: str = "job_id",
    job_rows: int = JOB_ROWS,
) -> DataFrame:
    """Rows kept per job when read in ``order``; a null in a key counts as empty."""
    first, second = first or OFFER_KEY, second or URL_KEY
    given = rows.columns
    keys = {f"_key{i}": F.coalesce(F.col(c).cast("string"), F.lit("")) for i, c in enumerate([*first, *second])}
    first, second = list(keys)[: len(first)], list(keys)[len(first) :]
    rows = rows.withColumns(keys)
    columns = rows.columns

    def above_bound(df: DataFrame, groups: list[str]) -> DataFrame:
        sizes = df.groupBy(*groups).agg(F.count("*").alias("_n"))
        return materialize(sizes.filter(F.col("_n") > job_rows).select(*groups))

    kept: list[DataFrame] = []

    def walk_others(df: DataFrame, groups: list[str]) -> DataFrame | None:
        """Walk the groups within the bound; the rows of the others, if there are any."""
        large = above_bound(df, groups)
        if large.isEmpty():
            kept.append(_walk(df, groups, first, second, order))
            return None
        kept.append(_walk(lookup_join(df, large, groups, "left_anti").select(*df.columns), groups, first, second, order))
        return lookup_join(df, large, groups, "left_semi").select(*columns)

    undecided, rounds = walk_others(rows, [job]), 1
    if undecided is not None:
        undecided = materialize(_first_per_pair(undecided, job, first, second, order))
    while undecided is not None:
        parts = materialize(_with_components(undecided, job, first, second))
        giant = walk_others(parts, [job, "_part"])
        if giant is None:
            break
        undecided = materialize(giant)
        for _ in range(rounds):
            accepted, undecided = _round(undecided, job, first, second, order)
            kept.append(accepted)
        rounds *= 2
        undecided = walk_others(undecided, [job])
    return reduce(DataFrame.unionByName, [k.select(*given) for k in kept])
