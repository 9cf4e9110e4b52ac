"""Near duplicates among vectors by an epsilon grid order join.

Vectors of length one whose cosine is at least c are at most eps = sqrt(2 - 2c)
apart.  They are laid out on a grid of that width over their leading principal
directions, sorted by grid cell, and cut into blocks of consecutive vectors.  The
sequence is then joined with itself by intervals: a pair of intervals whose
bounding boxes are more than eps apart cannot hold a link and is dropped, any other
pair is halved on both sides, down to pairs of blocks, where all cosines are computed
in double precision.  The recursion runs as joins of a table of interval boxes, one
level at a time; blocks travel only for the pairs that are left.

Exact copies of a vector are one vector with a multiplicity, so a frequent vector is
compared once.  A pair of blocks hands on link counts and a spanning forest of its
links, never all pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing;
shorter vectors count as padded with zeros.  Repeated ids are vectors of their own for
the counts and one node for the components; rows without an id get no component of
their own but count for others.  Other columns may have any name.

Principal directions are a matter of cost only.  They come from the sums of products
of all vectors, one matrix per task, added up by Spark to a matrix of dimension squared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.blocks import PACKED, dimension, matrix, unpacked, usable
from offerloom.llm.common import forest, numbered, prepare, stored
from offerloom.llm.components import components
from offerloom.plans.joins import lookup_join

BLOCK = 4096
LEADING = 8
ROWS_AT_ONCE = 512


def principal_directions(vectors: DataFrame, width: int, leading: int) -> np.ndarray:
    """Leading eigenvectors of the sum of products, as columns."""

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            unit = matrix(batch["v"], width)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            total += unit.T @ unit
        yield pd.DataFrame({"i": np.arange(width), "row": list(total)})

    summed = vectors.select("v").mapInPandas(products, "i int, row array<double>")
    cells = summed.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    total = np.zeros((width, width))
    for row in cells.collect():
        total[row["i"], row["j"]] = row["x"]
    return np.linalg.eigh(total)[1][:, ::-1][:, :leading].copy()


def _pack(width: int, directions: np.ndarray):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = matrix(rows["v"], width)
        place = (values / np.linalg.norm(values, axis=1, keepdims=True)) @ directions
        return pd.DataFrame(
            {
                "block": [key[0]],
                "low": [place.min(axis=0)],
                "high": [place.max(axis=0)],
                "ids": [rows["node"].to_numpy(np.int64).tobytes()],
                "weights": [rows["copies"].to_numpy(np.int64).tobytes()],
                "vectors": [values.tobytes()],
            }
        )

    return pack


def _apart():
    """The squared distance of two boxes."""
    gaps = F.zip_with(
        F.zip_with("low", "other_high", lambda a, b: F.greatest(a - b, F.lit(0.0))),
        F.zip_with("other_low", "high", lambda a, b: F.greatest(a - b, F.lit(0.0))),
        lambda a, b: F.greatest(a, b),
    )
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)


def block_pairs(boxes: DataFrame, blocks: int, eps: float) -> DataFrame:
    """Pairs of blocks ``a <= b`` whose boxes are at most ``eps`` apart.

    From the whole sequence down: level k has intervals of 2**k blocks.
    """
    spark = boxes.sparkSession
    pairs = spark.createDataFrame([(0, 0)], "a long, b long")
    size = len(boxes.first()["low"])
    for level in range(max(0, (blocks - 1).bit_length()) - 1, -1, -1):
        bounds = [
            F.array(*[f(F.get(c, F.lit(k))) for k in range(size)]).alias(c) for c, f in (("low", F.min), ("high", F.max))
        ]
        merged = boxes.groupBy(F.shiftright("block", level).alias("a")).agg(*bounds)
        other = merged.select(F.col("a").alias("b"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
        halves = F.array(F.lit(0), F.lit(1))
        split = pairs.select(F.explode(halves).alias("x"), "a", "b").select((F.col("a") * 2 + F.col("x")).alias("a"), "b")
        split = split.select("a", F.explode(halves).alias("x"), "b").select("a", (F.col("b") * 2 + F.col("x")).alias("b"))
        near = split.filter("a <= b").join(merged, "a").join(other, "b")
        near = near.filter(_apart() <= eps * eps * (1 + 1e-9) + 1e-12).select("a", "b")
        pairs = stored(near, "intervals") if level % 4 == 0 else near
    return pairs


def _joined(width: int, cosine: float):
    def join(key: tuple, sides: pd.DataFrame) -> pd.DataFrame:
        sides = sides.sort_values("side")
        first, last = sides.iloc[0], sides.iloc[-1]
        alone = key[0] == key[1]
        a_ids, a = unpacked(first["ids"], first["vectors"], width)
        b_ids, b = unpacked(last["ids"], last["vectors"], width)
        a_weight, b_weight = (np.frombuffer(s["weights"], np.int64) for s in (first, last))
        a_norm, b_norm = (np.sqrt((x * x).sum(axis=1)) for x in (a, b))
        a_unit, b_unit = a / a_norm[:, None], b / b_norm[:, None]
        a_links, b_links = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        offset = 0 if alone else len(a)
        parent = np.arange(offset + len(b))
        for start in range(0, len(a), ROWS_AT_ONCE):
            close = a_unit[start : start + ROWS_AT_ONCE] @ b_unit.T
            i, j = np.nonzero(close >= cosine - 1e-9)
            near = np.abs(close[i, j] - cosine) < 1e-9  # too near to the limit for rounded lengths
            if near.any():
                x, y = i[near] + start, j[near]
                exact = (a[x] * b[y]).sum(axis=1) / (a_norm[x] * b_norm[y])
                keep = np.ones(len(i), bool)
                keep[near] = exact >= cosine
                i, j = i[keep], j[keep]
            i = i + start
            if alone:
                different = i != j
                i, j = i[different], j[different]
            if len(i):
                a_links += np.bincount(i, weights=b_weight[j], minlength=len(a)).astype(np.int64)
                if not alone:
                    b_links += np.bincount(j, weights=a_weight[i], minlength=len(b)).astype(np.int64)
                forest(parent, i, j + offset)
        ids = a_ids if alone else np.concatenate([a_ids, b_ids])
        links = a_links if alone else np.concatenate([a_links, b_links])
        some = np.flatnonzero(links)
        return pd.DataFrame({"node": ids[some], "root": ids[parent[some]], "links": links[some]})

    return join


def similar(vectors: DataFrame, id_col: str, vector_col: str, cosine: float = 0.9) -> DataFrame:
    """``(id, n_links, component_id)`` of every row: the other vectors with at least this
    cosine, and the smallest id that links reach, itself included."""
    prepare(vectors)
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = given.filter(usable(F.col("v"), False))
    width = dimension(good, "v")
    unlinked = given.filter(~usable(F.col("v"), False)).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if not width:
        return unlinked
    # Zeros at the end are padding, and -0.0 is 0.0.
    padded = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v")))
    good = good.select("id", F.transform(padded, lambda x: x + F.lit(0.0)).alias("v"))
    groups = good.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    directions = principal_directions(groups, width, min(LEADING, width))
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = matrix(batch["v"], width)
            place = (values / np.linalg.norm(values, axis=1, keepdims=True)) @ directions
            yield batch.assign(cell=list(np.floor(place / max(eps, 1e-9)).astype(np.int64)))

    grid = groups.mapInPandas(cells, "v array<double>, least long, copies long, cell array<long>")
    grid = stored(numbered(grid, [F.col("cell"), F.col("v")], "node"), "grid")
    rows = grid.select((F.col("node") / BLOCK).cast("long").alias("block"), "node", "copies", "v")
    shape = "block long, low array<double>, high array<double>, " + PACKED
    packed = stored(rows.groupBy("block").applyInPandas(_pack(width, directions), shape), "blocks")
    pairs = block_pairs(packed.select("block", "low", "high"), packed.count(), eps)
    sides = pairs.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.withColumn("block", F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b")))
    sides = sides.join(packed.select("block", "ids", "weights", "vectors"), "block")
    found = stored(sides.groupBy("a", "b").applyInPandas(_joined(width, cosine), "node long, root long, links long"), "found")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = grid.join(links, "node", "left").join(roots, "node", "left")
    nodes = stored(nodes.withColumn("root", F.coalesce("root", "node")), "nodes")
    least = stored(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    # A component, or the copies of a vector, may hold a large share of the rows: frequent keys are joined apart.
    nodes = lookup_join(nodes, least, ["root"], "inner")
    total = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    linked = good.join(nodes.select("v", total, "component_id"), "v").select("id", "n_links", "component_id")
    return linked.unionByName(unlinked)
