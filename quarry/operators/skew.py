"""Building blocks that keep one hot key from landing in one task.

* ``salted_join``  spreads the big side of a join on few, uneven keys over several tasks.
* ``topk``         ranks per key; Spark trims every task to k rows before it shuffles.
* ``running``      ordered per-key measures (row number, running sum, carried value, lag, lead)
                   computed per (key, slice) and lifted by the totals of the other slices, so a key
                   that holds a third of all rows is spread over as many tasks as it has slices.
* ``halo``         bounded look-back windows over the same kind of slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], salt_on: str,
                how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi-join where few key values can hold most rows of ``big``.

    ``big`` rows get a salt from their own id, ``small`` is repeated once per salt. No broadcast is
    forced: AQE broadcasts ``small`` when its measured size allows, else both sides shuffle on
    (keys, salt).
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot salt a {how} join")
    left = big.withColumn("__salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def topk(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank",
         spread_on: str | None = None) -> DataFrame:
    """First ``k`` rows per key with their rank from 1.

    ``row_number() <= k`` plans as WindowGroupLimit: each task keeps k rows per key before the
    shuffle. With ``spread_on`` the trimmed rows are first reduced per (key, bucket), for
    candidate lists that come from very many tasks.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if spread_on is not None:
        spread = df.withColumn("__bucket", F.pmod(F.xxhash64(spread_on), F.lit(SALTS)).cast("int"))
        df = topk(spread, [*keys, "__bucket"], order, k, rank).drop("__bucket", rank)
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column,
            **measures: tuple[str, Column | str | None]) -> DataFrame:
    """Ordered per-key measures without one task per key.

    ``order`` names ascending columns that order each key totally; ``slice_by`` is a column that
    never decreases along that order (an hour, a block of positions). Measures:

    * ``("row_number", None)``  position from 1
    * ``("sum", col)``          running sum up to the row, nulls as 0
    * ``("before", col)``       the same without the row itself
    * ``("last", col)``         last non-null value up to the row
    * ``("lag", col)``, ``("lead", col)``  value of the row before / after

    Each slice is windowed on its own; the per-slice totals, one row each, are windowed per key
    and joined back. Both sides share the (key, slice) partitioning.
    """
    base = df.withColumn("__key", F.struct(*keys)).withColumn("__slice", F.coalesce(slice_by.cast("long"), F.lit(-(1 << 62))))
    parts = ["__key", "__slice"]
    ordered = Window.partitionBy(*parts).orderBy(*order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = (Window.partitionBy("__key").orderBy("__slice")
               .rowsBetween(Window.unboundedPreceding, -1))
    later = Window.partitionBy("__key").orderBy("__slice").rowsBetween(1, Window.unboundedFollowing)
    place = F.struct(*order)

    local, totals, lifted, final = [], [], [], []
    for name, (kind, source) in measures.items():
        here, total, lift = f"__here_{name}", f"__total_{name}", f"__lift_{name}"
        value = F.col(source) if isinstance(source, str) else source
        if kind == "row_number":
            local.append(F.row_number().over(ordered).cast("long").alias(here))
            totals.append(F.count(F.lit(1)).alias(total))
        elif kind in ("sum", "before"):
            filled = F.coalesce(value, F.lit(0))
            run = F.sum(filled).over(so_far)
            local.append((run - filled if kind == "before" else run).alias(here))
            totals.append(F.sum(filled).alias(total))
        elif kind == "last":
            local.append(F.last(value, ignorenulls=True).over(so_far).alias(here))
            totals.append(F.max_by(value, F.when(value.isNotNull(), place)).alias(total))
        elif kind == "lag":
            local.append(F.lag(F.struct(value.alias("v"))).over(ordered).alias(here))
            totals.append(F.max_by(F.struct(value.alias("v")), place).alias(total))
        elif kind == "lead":
            local.append(F.lead(F.struct(value.alias("v"))).over(ordered).alias(here))
            totals.append(F.min_by(F.struct(value.alias("v")), place).alias(total))
        else:
            raise ValueError(f"unknown measure {kind}")

        if kind in ("row_number", "sum", "before"):
            lifted.append(F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(lift))
            final.append((F.col(here) + F.col(lift)).alias(name))
        elif kind == "lead":
            lifted.append(F.first(total, ignorenulls=True).over(later).alias(lift))
            final.append(F.coalesce(F.col(here), F.col(lift))["v"].alias(name))
        else:
            lifted.append(F.last(total, ignorenulls=True).over(earlier).alias(lift))
            both = F.coalesce(F.col(here), F.col(lift))
            final.append((both["v"] if kind == "lag" else both).alias(name))

    kept = [c for c in df.columns if c not in measures]
    per_row = base.select("*", *local)
    per_slice = base.groupBy(*parts).agg(*totals).select(*parts, *lifted)
    return per_row.join(per_slice, parts).select(*kept, *final)


def hour_of(ts: str) -> Column:
    """Slice for event logs."""
    return F.floor(F.unix_seconds(F.col(ts)) / 3600)


def block_of(position: str, size: int = 4096) -> Column:
    """Slice for integer positions."""
    return F.floor(F.col(position) / size)


def halo(df: DataFrame, position: str, look_back: int, size: int = 4096) -> DataFrame:
    """Cut positions 1, 2, 3, ... into blocks and repeat the last ``look_back`` rows of each block
    at the head of the next one.

    Adds ``__block`` and ``__halo`` (true on repeated rows, to drop after windowing).
    """
    size = max(size, look_back)
    block = F.floor((F.col(position) - 1) / size)
    tail = F.pmod(F.col(position) - 1, F.lit(size)) >= size - look_back
    homes = F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))
    return (df.withColumn("__home", block)
            .withColumn("__block", F.explode(homes))
            .withColumn("__halo", F.col("__block") != F.col("__home"))
            .drop("__home"))
