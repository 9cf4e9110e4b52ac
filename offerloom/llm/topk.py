"""Exact top-k by inner product with block-at-a-time pruning.

Candidates lie in blocks of consecutive ids, each with a forward index (the matrix of
its vectors) and the largest and smallest value of each term in it.  For a query the
sum over terms of its value times the larger of the two outcomes bounds every score of
a block.  A first round scores, for each query, the block with the largest bound; the
k-th score so far is a limit that no later block may fall short of.  A second round
takes the blocks left for a group of queries in the order of their bounds, shard by
shard, and stops a query at the first block whose bound falls below its k-th score.  A
block whose bound equals it is scored, as an equal score with a smaller id comes first.

Queries and candidates meet in cells, a tile of query groups and a shard of blocks, to
which both are shuffled: a tile travels once per shard and a shard once per tile, and a
cell holds at most ``CELL`` bytes of either.  Vectors never pass the driver, neither
broadcast nor as samples of a sort.

Scores are integers: doubles hold them exactly while the largest possible sum is below
2**53; beyond that Python's integers are used, and a score that no long holds is cut to
the nearest long.  Vectors that are null or hold null or non-finite components take no
part; shorter vectors count as padded with zeros.  A repeated id is a candidate and a
query once per row, but never a candidate for itself; a null id takes no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.blocks import dimension, matrix, usable
from offerloom.llm.common import numbered, prepare, stored

BLOCK = 2048
QUERIES = 512
SHARD = 8
# Bytes of vectors, as doubles, on each side of a cell; shards grow up to it once there are this many.
CELL = 32 << 20
SHARDS = 64
LONG = (1 << 63) - 1
FOUND = "query bigint, row bigint, vec_id bigint, score bigint"
KINDS = {2: np.int16, 4: np.int32, 8: np.float64}


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products, exact."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)))
    largest = float(np.abs(queries).max()) * float(np.abs(vectors).max()) * queries.shape[1]
    if largest < 1 << 53:
        kind = np.float32 if largest < 1 << 24 else np.float64
        return queries.astype(kind) @ vectors.astype(kind).T
    whole = [[int(x) for x in row] for row in vectors.tolist()]
    out = np.empty((len(queries), len(vectors)), np.int64)
    for i, query in enumerate(queries.tolist()):
        terms = [int(x) for x in query]
        for j, row in enumerate(whole):
            out[i, j] = max(-LONG - 1, min(LONG, sum(x * y for x, y in zip(terms, row, strict=True))))
    return out


def _bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest score that a vector between ``low`` and ``high`` can have."""
    queries = queries.astype(np.float64)
    bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    return bound + np.abs(bound) * 1e-9  # rounding of large sums


def _ranks(rows: np.ndarray) -> np.ndarray:
    """The place, from 0, of each entry among those of its row; rows are sorted."""
    return np.arange(len(rows)) - np.searchsorted(rows, rows)


def _merge(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, by row, falling score and id."""
    order = np.lexsort((ids, ~scores, rows))
    order = order[_ranks(rows[order]) < k]
    return rows[order], ids[order], scores[order]


def _best(queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, limit: np.ndarray, k: int) -> tuple:
    """The k best of a block for each query, none below its limit: index of the query, ids, scores."""
    scores = _scores(queries, vectors)
    limit = limit.astype(np.float64 if scores.dtype == np.int64 else scores.dtype)
    free = np.flatnonzero(np.isneginf(limit))
    if len(free) and len(ids) > k and scores.dtype != np.int64:
        others = scores[free]
        others[ids == query_ids[free, None]] = -np.inf
        limit[free] = np.partition(others, len(ids) - k, axis=1)[:, len(ids) - k]
    found, place = np.divmod(np.flatnonzero(scores >= limit[:, None]), len(ids))
    other = ids[place] != query_ids[found]
    found, place = found[other], place[other]
    return _merge(found, ids[place], scores[found, place].astype(np.int64), k)


def _narrow(values: np.ndarray) -> bytes:
    """Vectors in the shortest of ``KINDS`` that holds them."""
    largest = np.abs(values).max(initial=0)
    for kind in (np.int16, np.int32):
        if largest <= np.iinfo(kind).max and (values == np.trunc(values)).all():
            return values.astype(kind).tobytes()
    return values.tobytes()


def _unpacked(ids: bytes, vectors: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, np.int64)
    return numbers, np.frombuffer(vectors, KINDS[len(vectors) // (len(numbers) * width)]).reshape(-1, width)


def _pack(key: tuple, rows: pd.DataFrame, width: int) -> pd.DataFrame:
    rows = rows.sort_values("vec")
    values = matrix(rows["v"], width)
    return pd.DataFrame(
        {
            "block": [key[0]],
            "low": [values.min(axis=0)],
            "high": [values.max(axis=0)],
            "ids": [rows["vec"].to_numpy(np.int64).tobytes()],
            "vectors": [_narrow(values)],
        }
    )


def _of(column: str, size: int) -> Column:
    """The number of the group of ``size`` that a number lies in."""
    return (F.col(column) / size).cast("long")


def _each(count: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))


def _meet(left: DataFrame, right: DataFrame, *keys: str):
    return left.groupBy(*keys).cogroup(right.groupBy(*keys))


def top_k(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best candidates of each query.

    Vectors hold whole numbers; ``is_query`` is a condition on the columns of ``vectors``.
    """
    prepare(vectors)
    given = vectors.select(
        F.col(id_col).cast("long").alias("vec"),
        F.col(vector_col).cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    given = given.filter(F.col("vec").isNotNull() & usable(F.col("v"), True))
    width = dimension(given, "v")
    if not width:
        return given.select(F.col("vec").alias("query_id"), F.lit(1).alias("rank"), F.col("vec").alias("vec_id"), F.col("vec").alias("score")).limit(0)
    # The driver gets a sample of the keys: a hash of the vector tells the rows of an id apart as well.
    keys = [F.col("vec"), F.xxhash64("v")]
    rows = stored(numbered(given, keys, "place"), "vectors")
    shape = "block bigint, low array<double>, high array<double>, ids binary, vectors binary"
    pack = lambda key, found: _pack(key, found, width)
    blocks = rows.select(_of("place", BLOCK).alias("block"), "vec", "v")
    blocks = stored(blocks.groupBy("block").applyInPandas(pack, shape), "blocks")
    asking = numbered(rows.filter("asks").select("vec", "v"), keys, "place")
    asking = asking.select(_of("place", QUERIES).alias("block"), "vec", "v")
    asking = stored(asking.groupBy("block").applyInPandas(pack, shape), "queries")
    asking = asking.select(F.col("block").alias("part"), "ids", "vectors")

    # Query groups lie in tiles, blocks in shards; a tile and a shard meet in a cell.
    group, last = QUERIES, blocks.agg(F.max("block")).first()[0]
    tile = max(1, CELL // (8 * width * QUERIES))
    shard = SHARD * max(1, min(last // (SHARD * SHARDS), CELL // (8 * width * BLOCK * SHARD)))
    tiles, shards = (asking.agg(F.max("part")).first()[0] or 0) // tile + 1, last // shard + 1
    in_tile, in_shard = _of("part", tile).alias("tile"), _of("block", shard).alias("shard")
    cell = ("tile", "shard")

    # Every query group meets every summary: the stated queries against all rows, in blocks.
    def bounds(key: tuple, groups: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        listed = listed.sort_values("block")
        low, high = (np.array(listed[c].tolist()) for c in ("low", "high"))
        out = []
        for one in groups.itertuples():
            _, queries = _unpacked(one.ids, one.vectors, width)
            found = _bounds(queries, low, high)
            best = found.argmax(axis=1)
            places = np.arange(len(queries))
            block = listed["block"].to_numpy()[best]
            out.append(pd.DataFrame({"part": one.part, "row": one.part * group + places, "block": block, "bound": found[places, best]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["part", "row", "block", "bound"])

    summaries = blocks.select("block", "low", "high", in_shard, _each(tiles).alias("tile"))
    met = _meet(asking.select("*", in_tile, _each(shards).alias("shard")), summaries, *cell)
    tops = met.applyInPandas(bounds, "part bigint, row bigint, block bigint, bound double")
    tops = tops.groupBy("part", "row").agg(F.max_by("block", F.struct("bound", -F.col("block"))).alias("block"))
    tops = stored(tops, "tops")

    def send(key: tuple, chosen: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        ids, queries = _unpacked(groups["ids"][0], groups["vectors"][0], width)
        out = []
        for block, found in chosen.groupby("block"):
            row = np.sort(found["row"].to_numpy())
            at = row - key[0] * group
            out.append((key[0], block, row.tobytes(), ids[at].tobytes(), queries[at].astype(np.float64)))
        return pd.DataFrame([(*x[:4], _narrow(x[4])) for x in out], columns=["part", "block", "rows", "ids", "vectors"])

    def score(key: tuple, sent: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        out = []
        known = {one.block: one for one in listed.itertuples()}
        for block, found in sent.groupby("block"):
            ids, values = _unpacked(known[block].ids, known[block].vectors, width)
            row = np.concatenate([np.frombuffer(one, np.int64) for one in found["rows"]])
            pairs = [_unpacked(one.ids, one.vectors, width) for one in found.itertuples()]
            q_ids, queries = (np.concatenate([p[n] for p in pairs]) for n in (0, 1))
            for start in range(0, len(row), group):
                some = slice(start, start + group)
                i, best, scores = _best(queries[some], q_ids[some], ids, values, np.full(len(row[some]), -np.inf), k)
                out.append(pd.DataFrame({"query": q_ids[some][i], "row": row[some][i], "vec_id": best, "score": scores, "n": _ranks(i) + 1}))
        return pd.concat(out) if out else pd.DataFrame(columns=["query", "row", "vec_id", "score", "n"])

    sent = _meet(tops, asking, "part").applyInPandas(send, "part bigint, block bigint, rows binary, ids binary, vectors binary")
    payload = blocks.select("*", in_shard, _each(tiles).alias("tile"))
    first = _meet(sent.select("*", in_tile, in_shard), payload.drop("low", "high"), *cell)
    seen = stored(first.applyInPandas(score, f"{FOUND}, n bigint"), "first")

    # A group takes along the limits of its queries and the blocks they have seen.
    nothing = F.lit(None)
    limits = seen.filter(F.col("n") == k).select(_of("row", QUERIES).alias("part"), "row", nothing.cast("long").alias("block"), F.col("score").cast("double").alias("limit"))
    known = tops.withColumn("limit", nothing.cast("double")).unionByName(limits)

    def arm(key: tuple, found: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        count = len(groups["ids"][0]) // 8
        limit, done = np.full(count, -np.inf), np.full(count, -1)
        for column, out in (("limit", limit), ("block", done)):
            some = found[found[column].notna()]
            out[some["row"].to_numpy() - key[0] * group] = some[column]
        return groups.assign(limits=[limit.tobytes()], done=[done.tobytes()])

    armed = _meet(known, asking, "part").applyInPandas(arm, "part bigint, ids binary, vectors binary, limits binary, done binary")

    def search(key: tuple, groups: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        listed = listed.sort_values("block")
        order = listed["block"].to_numpy()
        low, high = (np.array(listed[c].tolist()) for c in ("low", "high"))
        held = [_unpacked(one.ids, one.vectors, width) for one in listed.itertuples()]
        out = []
        for one in groups.itertuples():
            q_ids, queries = _unpacked(one.ids, one.vectors, width)
            limit = np.frombuffer(one.limits, np.float64).copy()
            bound = _bounds(queries, low, high)
            bound[np.frombuffer(one.done, np.int64)[:, None] == order] = -np.inf
            best = tuple(np.zeros(0, np.int64) for _ in range(3))
            # By the largest bound of the group; each query leaves out what cannot reach its own limit.
            for at in np.argsort(-bound.max(axis=0), kind="stable").tolist():
                asked = np.flatnonzero((bound[:, at] >= limit) & (bound[:, at] > -np.inf))
                if not len(asked):
                    continue
                i, ids, scores = _best(queries[asked], q_ids[asked], *held[at], limit[asked], k)
                if not len(i):
                    continue
                best = _merge(*(np.concatenate(x) for x in zip(best, (asked[i], ids, scores), strict=True)), k)
                full = _ranks(best[0]) == k - 1
                limit[best[0][full]] = np.maximum(limit[best[0][full]], best[2][full])
            out.append(pd.DataFrame({"query": q_ids[best[0]], "row": one.part * group + best[0], "vec_id": best[1], "score": best[2]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["query", "row", "vec_id", "score"])

    jobs = _meet(armed.select("*", in_tile, _each(shards).alias("shard")), payload, *cell)
    all_found = seen.drop("n").unionByName(jobs.applyInPandas(search, FOUND))
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    ranked = all_found.withColumn("rank", place).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
