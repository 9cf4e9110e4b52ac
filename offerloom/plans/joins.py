"""Joins against a keyed table that stay balanced whatever the key distribution.

``lookup_join`` is the one join the operators use to attach a table with unique
keys (a gazetteer, a cache, an allow-list) to a large one:

* the keyed side is broadcast only after its rows and bytes were counted and found small;
* beyond that, a bitmap of its keys is broadcast, and rows of the large side that surely
  match nothing stay where they are;
* of the others, keys with more than a share of 1 / HOT_KEYS of the rows are joined apart
  by broadcasting just their rows (at most ``HOT_KEYS`` of them, a fixed bound), and
  only the remaining keys go through a shuffle join.

Rows with a null key match nothing and never take part in a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerloom.plans.checkpoints import materialize

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 128 << 20
HOT_KEYS = 200
# Keys are first counted in as many classes of their hash, so that only those of large classes are counted one by one.
HOT_CLASSES = 1 << 14

# Size of the bitmap that stands for a set of keys: 2**27 bits in rows of 4 KB are 16 MB.
FILTER_BITS = 1 << 27


def _bytes(field: T.StructField) -> Column:
    """Size of a value: texts by their bytes, nested values by their JSON, others 8."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType | T.BinaryType):
        size = F.octet_length(column)
    elif isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
        size = F.octet_length(F.to_json(F.struct(column)))
    else:
        size = F.lit(8)
    return F.coalesce(size, F.lit(0)).cast("long")


def is_small(df: DataFrame) -> bool:
    """Whether a table may be broadcast; reads no more rows than it takes to tell."""
    size = reduce(lambda a, b: a + b, [_bytes(f) for f in df.schema.fields], F.lit(0).cast("long"))
    read = df.select(size.alias("_size")).limit(BROADCAST_ROWS + 1)
    rows, total = read.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and total <= BROADCAST_BYTES


def _all_not_null(keys: list[str]):
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that more than a share of 1 / HOT_KEYS of the rows have, so at most ``HOT_KEYS``.

    Such a key is in a class of hashes with as large a share, of which there are as few.  The
    counts that are shuffled and read by the driver are one per class, whatever the number of keys.
    """
    present = df.filter(_all_not_null(keys))
    if HOT_KEYS < 1:
        return present.select(*keys).limit(0)
    hashed = F.pmod(F.xxhash64(*keys), F.lit(HOT_CLASSES)).cast("int")
    counts = {r["_class"]: r["count"] for r in present.groupBy(hashed.alias("_class")).count().collect()}
    least = sum(counts.values()) / HOT_KEYS
    large = [c for c, n in counts.items() if n > least]
    if not large:
        return present.select(*keys).limit(0)
    counted = present.filter(hashed.isin(large)).groupBy(*keys).agg(F.count("*").alias("_n"))
    return materialize(counted.filter(F.col("_n") > least).select(*keys))


def unique_join(left: DataFrame, keyed: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join of two tables that are both unique per key, so no key can be hot."""
    return left.join(F.broadcast(keyed) if is_small(keyed) else keyed, keys, how)


def bit_is_set(bits: Column, at: Column) -> Column:
    """Whether a bitmap made by ``bitmap_construct_agg`` has the bit at a position."""
    octet = F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1)))
    return F.getbit(F.conv(octet, 16, 10).cast("int"), (at % 8).cast("int")) == 1


def likely_in(large: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``large`` whose key may be in ``wanted``; a share of the others stays too.

    The keys are hashed into a bitmap of fixed size, which is broadcast, so that
    wide rows are dropped where they are and need no shuffle.
    """
    spot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    bucket, at = F.bitmap_bucket_number(spot), F.bitmap_bit_position(spot)
    bits = (
        wanted.filter(F.col(key).isNotNull())
        .groupBy(bucket.alias("_bucket"))
        .agg(F.bitmap_construct_agg(at).alias("_bits"))
    )
    marked = large.withColumn("_bucket", bucket).join(F.broadcast(bits), ["_bucket"])
    return marked.filter(bit_is_set(F.col("_bits"), at)).select(*large.columns)


def bitmap_of(wanted: DataFrame) -> DataFrame:
    """The bitmap of a table of 64-bit hashes, its only column: rows of 4 KB, at most 16 MB."""
    spot = F.pmod(F.col(wanted.columns[0]), F.lit(FILTER_BITS)) + 1
    return wanted.groupBy(F.bitmap_bucket_number(spot).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("_bits")
    )


def mark_likely(large: DataFrame, wanted: DataFrame, hashed: Column, name: str) -> DataFrame:
    """Add ``name``: whether the 64-bit hash of a row may be among the hashes in ``wanted``, its only column.

    Rows stay where they are; a false mark is certain.  A name that is taken must not be given.
    """
    return mark_by(large, bitmap_of(wanted), hashed, name)


def mark_by(large: DataFrame, bits: DataFrame, hashed: Column, name: str) -> DataFrame:
    """``mark_likely`` by a bitmap of the wanted hashes."""
    own = F.pmod(hashed, F.lit(FILTER_BITS)) + 1
    rows = large.select(
        F.struct("*").alias("_row"), F.bitmap_bucket_number(own).alias("_bucket"), F.bitmap_bit_position(own).alias("_at")
    )
    marked = rows.join(F.broadcast(bits), "_bucket", "left")
    return marked.select("_row.*", F.coalesce(bit_is_set(F.col("_bits"), F.col("_at")), F.lit(False)).alias(name))


def lookup_join(
    large: DataFrame, keyed: DataFrame, keys: list[str], how: str = "left", costly: bool = False
) -> DataFrame:
    """Join ``large`` with ``keyed`` (unique per key combination) on ``keys``.

    ``how`` is ``left``, ``inner``, ``left_semi`` or ``left_anti``.  Beyond a
    broadcast ``large`` is read several times; if computing it is ``costly`` it
    is written out first.
    """
    if is_small(keyed):
        return large.join(F.broadcast(keyed), keys, how)

    if costly:
        large = materialize(large)
    mark, hashed = "_likely", F.xxhash64(*keys)
    if all(large.schema[k].dataType == keyed.schema[k].dataType for k in keys):
        bits = materialize(bitmap_of(keyed.filter(_all_not_null(keys)).select(hashed.alias("_hash"))))
        marked = mark_by(large, bits, hashed, mark)
    else:
        # Equal values of two types have different hashes.
        marked = large.withColumn(mark, F.lit(True))
    may_match = F.col(mark) & _all_not_null(keys)
    present = marked.filter(may_match).drop(mark)
    hot = hot_keys(present, keys)
    if hot.isEmpty():
        joined = present.join(keyed, keys, how)
    else:
        hot_rows = present.join(F.broadcast(hot), keys, "left_semi").join(
            F.broadcast(keyed.join(F.broadcast(hot), keys, "left_semi")), keys, how
        )
        other_rows = present.join(F.broadcast(hot), keys, "left_anti").join(keyed, keys, how)
        joined = hot_rows.unionByName(other_rows)
    if how in ("left", "left_anti"):
        joined = joined.unionByName(marked.filter(~may_match).drop(mark), allowMissingColumns=True)
    return joined


def match_join(large: DataFrame, other: DataFrame, keys: list[str], salts: int = 32) -> DataFrame:
    """Inner many-to-many join on ``keys`` that spreads frequent keys of ``large``.

    Broadcasts ``other`` if it was found small; else the rows of ``large`` are
    salted and those of ``other`` repeated once per salt.
    """
    if is_small(other):
        return large.join(F.broadcast(other), keys)
    salt = F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int")
    repeated = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return large.withColumn("_salt", salt).join(repeated, [*keys, "_salt"]).drop("_salt")
