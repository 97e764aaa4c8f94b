"""Running maxima along an ordered axis without one task per key.

A window over (key) puts a hot key into one task.  Here the axis is cut into
blocks of 2**bits positions, blocks into super-blocks.  Only per-block maxima
travel upwards; each level is a window over at most 2**bits entries, and every
block receives its carry as one extra row.  Rows are shuffled once, by
(key, block), so a key holding a third of all rows spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import staged

BLOCK_BITS = 12
BLOCK = "__block"
CARRY = "__carry"
PID = "__pid"


def block_of(order: Column, bits: int = BLOCK_BITS) -> Column:
    return F.shiftright(order, bits)


def _exclusive(summary: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return summary.withColumn(CARRY, F.max(value).over(w))


def with_carries(points: DataFrame, keys: Sequence[str], order: str, value: str, bits: int = BLOCK_BITS) -> DataFrame:
    """points plus one row per block holding its carry, shuffled by (keys, block).

    Carry rows (__is_carry) sit one position below their block, hold the
    maximum of value over all lower blocks, and are null in other columns."""
    keys = list(keys)
    blocks = points.groupBy(*keys, block_of(F.col(order), bits).alias(BLOCK)).agg(F.max(value).alias("__m"))
    supers = blocks.groupBy(*keys, block_of(F.col(BLOCK), bits).alias("__super")).agg(F.max("__m").alias("__m"))
    top = _exclusive(supers, keys, "__super", "__m").filter(F.col(CARRY).isNotNull())
    entries = blocks.select(*keys, block_of(F.col(BLOCK), bits).alias("__super"), BLOCK, "__m", F.lit(False).alias("__top")).unionByName(
        top.select(*keys, "__super", (F.shiftleft(F.col("__super"), bits) - 1).alias(BLOCK), F.col(CARRY).alias("__m"), F.lit(True).alias("__top"))
    )
    w = Window.partitionBy(*keys, "__super").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carries = entries.withColumn(CARRY, F.max("__m").over(w)).filter(~F.col("__top") & F.col(CARRY).isNotNull())
    carry_rows = carries.select(*keys, BLOCK, (F.shiftleft(F.col(BLOCK), bits) - 1).alias(order), F.col(CARRY).alias(value), F.lit(True).alias("__is_carry"))
    rows = points.withColumn(BLOCK, block_of(F.col(order), bits)).withColumn("__is_carry", F.lit(False))
    return rows.unionByName(carry_rows, allowMissingColumns=True).repartition(*keys, BLOCK)


def running_max(points: DataFrame, keys: Sequence[str], order: str, value: str, out: str, inclusive: bool = False, bits: int = BLOCK_BITS) -> DataFrame:
    """Adds out: the maximum of value over rows of the same key with a lower
    (inclusive: not higher) order.  Nulls in value are ignored; no such row
    gives null.  Rows with a null key or order must be filtered out before."""
    keys = list(keys)
    rows = with_carries(points, keys, order, value, bits)
    w = Window.partitionBy(*keys, BLOCK).orderBy(order).rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return rows.withColumn(out, F.max(value).over(w)).filter(~F.col("__is_carry")).drop(BLOCK, "__is_carry")


def range_split(rows: DataFrame, keys: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """rows sorted into ranges of (keys, order), numbered by PID in that order.

    Spark draws the ranges from a sample, so they are written once to the shared
    folder before anything is combined over them.  A hot key, or one value of
    the order, spreads over as many ranges as its rows need."""
    return staged(rows.repartitionByRange(*keys, *order).withColumn(PID, F.spark_partition_id()), label)


def running_sums(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Adds for each name the sum of its column over the key's rows before this one, in the given order.

    Sums within a range are shifted by those of the key's lower ranges, as ranks are."""
    keys = list(keys)
    ranged = range_split(rows.select("*", *[c.alias(f"__in_{n}") for n, c in sums.items()]), keys, order, "sums")
    below = Window.partitionBy(*keys).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, PID).agg(*[F.sum(f"__in_{n}").alias(f"__s_{n}") for n in sums])
    starts = totals.select(*keys, PID, *[F.coalesce(F.sum(f"__s_{n}").over(below), F.lit(0)).alias(f"__s_{n}") for n in sums])
    own = Window.partitionBy(*keys, PID).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.select("*", *[F.coalesce(F.sum(f"__in_{n}").over(own), F.lit(0)).alias(f"__r_{n}") for n in sums])
    same = [summed[k].eqNullSafe(starts[k]) for k in keys] + [summed[PID] == starts[PID]]
    return summed.join(starts, same).select(*[summed[c] for c in rows.columns], *[(starts[f"__s_{n}"] + summed[f"__r_{n}"]).alias(n) for n in sums])


def running_count(rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Adds out: the 0-based rank of a row within its key, in the given order.

    Ranks within a range are shifted by the sizes of the key's lower ranges, of
    which there are at most as many as shuffle partitions."""
    keys = list(keys)
    ranged = range_split(rows, keys, order, "ranks")
    below = Window.partitionBy(*keys).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*keys, PID).agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(below), F.lit(0))).drop("__n")
    own = Window.partitionBy(*keys, PID).orderBy(*order)
    ranked = ranged.withColumn("__r", F.row_number().over(own) - 1)
    same = [ranked[k].eqNullSafe(starts[k]) for k in keys] + [ranked[PID] == starts[PID]]
    joined = ranked.join(starts, same).select(*[ranked[c] for c in rows.columns], (starts["__start"] + ranked["__r"]).alias(out))
    return joined
