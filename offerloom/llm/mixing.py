"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the total in proportion to its weight.  A source
whose share exceeds ``max_epochs`` times its size is clamped there, and what it
cannot use goes to the others by weight, until no share is above its limit.
The shares are then drawn: ``floor(target / size)`` whole repetitions of every
document and one more of some, taken in a seeded order until the rest of the
target is reached as nearly as whole documents allow.

The end of that draw is found without sorting a source: sizes are summed by
4,096 ranges of the seeded hash, then by 4,096 ranges of the one range where the
sum passes the target, and only documents of that last range, one in 16 million
of a source, are put in order.  A hot source is thus a partial aggregate like
any other, and what is left of the plan is one row per source: repetitions, and
the hash up to which documents get one more.

Null or empty texts have size 0 and are repeated like the rest of their source;
a null source is a source of its own, last in order; repeated rows of an id stand
or fall together; an empty table gives an empty result.  Only the columns named
are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.common import WORD, numbered, prepare, stored
from offerloom.plans.joins import lookup_join

RANGES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A join key that a null source has too."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def order_hash(seed: int, *columns: Column) -> Column:
    """The seeded order of documents: 63 bits, never negative."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 1)


def cycled_weights(sizes: DataFrame, weights: list[float]) -> DataFrame:
    """Weights for sources in code point order, null last, repeating from the start."""
    order = [F.col("source").asc_nulls_last()]
    choice = F.array(*[F.lit(float(w)) for w in weights])
    return numbered(sizes, order, "_n").withColumn("weight", F.get(choice, F.col("_n") % len(weights))).drop("_n")


def fill(sizes: DataFrame, max_epochs: float, total: float | None = None) -> DataFrame:
    """Add ``target`` to rows of ``source_size`` and ``weight``.

    Each round sums what the clamped sources take and the weight of the others;
    the level per unit of weight only rises, so the clamped set only grows.
    """
    limit = F.col("source_size") * float(max_epochs)
    whole, weights = sizes.agg(F.sum("source_size"), F.sum("weight")).first()
    total = float(whole or 0) if total is None else float(total)
    level, clamped = (total / weights if weights else 0.0), -1
    while True:
        above = limit <= F.col("weight") * F.lit(level)
        used, rest, count = sizes.agg(
            F.sum(F.when(above, limit).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.count_if(above)
        ).first()
        if count == clamped or not rest:
            break
        clamped, level = count, max(level, (total - used) / rest)
    share = F.col("weight") * F.lit(level)
    return sizes.withColumn("target", F.least(limit, share))


def _passing(rows: DataFrame, plan: DataFrame, digit: str) -> DataFrame:
    """For each source the range of ``digit`` where the summed sizes reach ``need``."""
    sums = rows.groupBy("key", digit).agg(F.sum("size").alias("held")).filter("held > 0")
    before = F.sum("held").over(Window.partitionBy("key").orderBy(digit)) - F.col("held")
    found = sums.withColumn("before", before).join(plan.select("key", "need"), "key")
    found = found.filter("before < need and before + held >= need")
    return found.select("key", digit, (F.col("need") - F.col("before")).alias("need"))


def draw(sized: DataFrame, filled: DataFrame) -> DataFrame:
    """Per source: ``whole`` repetitions, and ``cut``, the last hash with one more."""
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = filled.withColumn("whole", epochs.cast("int"))
    plan = stored(plan.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "plan")
    step = 63 - 12
    rows = sized.select(
        "key", "size", "hash", F.shiftright("hash", step).alias("d1"), (F.shiftright("hash", step - 12) % RANGES).alias("d2")
    )
    first = stored(_passing(rows, plan, "d1"), "draw")
    inside = lookup_join(rows, first.select("key", "d1"), ["key", "d1"], "inner")
    second = stored(_passing(inside, first, "d2").join(first.select("key", "d1"), "key"), "draw")
    last = lookup_join(inside, second.select("key", "d1", "d2"), ["key", "d1", "d2"], "inner")
    ties = last.groupBy("key", "hash").agg(F.sum("size").alias("size"))
    before = F.sum("size").over(Window.partitionBy("key").orderBy("hash")) - F.col("size")
    near = ties.withColumn("before", before).join(second.select("key", "need"), "key")
    near = near.filter(F.col("before") + F.col("size") / 2 <= F.col("need")).groupBy("key").agg(F.max("hash").alias("cut"))
    start = F.shiftleft(F.col("d1").cast("long"), step) + F.shiftleft(F.col("d2").cast("long"), step - 12) - 1
    cuts = second.select("key", start.alias("start")).join(near, "key", "left")
    cuts = cuts.select("key", F.coalesce("cut", "start").alias("cut"))
    return plan.join(cuts, "key", "left").withColumn("cut", F.coalesce("cut", F.lit(-1).cast("long"))).drop("need")


def plan_mix(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: list[float], max_epochs: float, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """The sized documents ``(id, key, size, hash)``, and per source
    ``(key, source, source_size, weight, target, whole, cut)``."""
    prepare(docs)
    columns = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")]
    rows = docs.select(*columns, order_hash(seed, F.col(id_col), F.col(text_col)).alias("hash"))
    sized = stored(rows.withColumn("key", source_key(F.col("source"))), "sized")
    sizes = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    filled = fill(stored(cycled_weights(sizes, weights), "sources"), max_epochs)
    return sized, stored(draw(sized, filled), "mix")


def repeats() -> Column:
    return F.col("whole") + F.when(F.col("hash") <= F.col("cut"), 1).otherwise(0)


def mix_counts(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: list[float], max_epochs: float, seed: int = 42
) -> DataFrame:
    """Per document: ``id, source, size, source_size, target, repeats, taken``."""
    sized, plan = plan_mix(docs, id_col, text_col, source_col, weights, max_epochs, seed)
    rows = lookup_join(sized, plan.drop("source", "weight"), ["key"], "inner").withColumn("repeats", repeats())
    taken = (F.col("size") * F.col("repeats")).alias("taken")
    return rows.select("id", "source", "size", "source_size", "target", "repeats", taken)


def mixed(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: list[float], max_epochs: float, seed: int = 42
) -> DataFrame:
    """The mix itself: each document as often as it was drawn, with all its columns.

    Only the rows of ``plan_mix``, one per source, are joined; texts never move.
    """
    _, plan = plan_mix(docs, id_col, text_col, source_col, weights, max_epochs, seed)
    rows = docs.select(
        F.struct(*docs.columns).alias("doc"),
        source_key(F.col(source_col)).alias("key"),
        order_hash(seed, F.col(id_col), F.col(text_col)).alias("hash"),
    )
    rows = lookup_join(rows, plan.select("key", "whole", "cut"), ["key"], "inner", costly=True)
    return rows.select("doc", F.explode(F.array_repeat(F.lit(0), repeats()))).select("doc.*")
