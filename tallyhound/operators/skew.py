"""Ordered work on keys that may hold a large share of all rows.

A window over such a key would put the whole key into one task. Here the rows of
hot keys are range-partitioned on (key, order), which splits a key over many
partitions of equal size. Each piece is scanned by itself and a small carry (one
row per key and piece) joins the pieces up again. Results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.session import cut_lineage

# Rows of one key that a single task may hold.
HOT_ROWS = 100_000
NEVER = float("inf")
# A side with at most this many narrow rows may be sent to every executor.
BROADCAST_ROWS = 500_000


def checked_side(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Compute a join side, count it, and broadcast it only when it is small.

    Beyond the limit it is joined by shuffle, where adaptive execution splits hot
    keys. The count is made at every size of input.
    """
    limit = BROADCAST_ROWS if limit is None else limit
    stored = cut_lineage(df)
    return F.broadcast(stored) if stored.limit(limit + 1).count() <= limit else stored


def busiest(df: DataFrame, keys: list[str]) -> int:
    """Rows of the key that has most."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def hot_keys(df: DataFrame, keys: list[str], limit: float | None = None) -> DataFrame | None:
    """Keys with more than `limit` rows, or None when there are none.

    The count is a map-side combined aggregate, made at every size of input: a small
    file may hold millions of rows of one key. At most rows / limit keys come back,
    so the result is far smaller than its input. A limit of NEVER says that the caller
    has counted and found none.
    """
    limit = HOT_ROWS if limit is None else limit
    if limit == NEVER:
        return None
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("hot_rows")).where(F.col("hot_rows") > limit)
    counted = cut_lineage(counted)
    return None if counted.isEmpty() else counted


def split_hot(df: DataFrame, hot: DataFrame | None, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys)."""
    if hot is None:
        return df, None
    names = hot.select(*keys)
    return df.join(names, keys, "left_anti"), df.join(names, keys, "left_semi")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str, salts: int = 32) -> DataFrame:
    """The first `n` rows of each key, numbered from 1 in `name`, in two levels: input partitions are dealt to
    `salts` groups, each group keeps its first n of a key, and the key's first n are taken of those. Each level cuts before its
    shuffle, so a key held by P partitions sends n * P / salts rows to a task, and then n * salts."""
    dealt = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    some = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col(name) <= n)
    return some.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n).drop("_salt")


def cut_into_pieces(df: DataFrame, keys: list[str], order: list[str], pieces: int | None = None) -> DataFrame:
    """Rows in (key, order) ranges of equal size, with the piece number.

    The result is written out: range bounds come from a sample, so computing
    them twice for a plan used twice could give two different cuts.
    """
    n = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, *order).withColumn("piece", F.spark_partition_id())
    return cut_lineage(ranged)



def running_sum(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Add running totals over each key in `order` to rows cut into pieces."""
    local = Window.partitionBy(*keys, "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "piece").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    carried = sums.select(
        *keys, "piece", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in values])
    out = df.withColumns({f"_l_{n}": F.sum(v).over(local) for n, v in values.items()})
    out = out.join(checked_side(carried), [*keys, "piece"])
    out = out.withColumns({n: F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.col(f"_c_{n}") for n in values})
    return out.drop(*[f"_l_{n}" for n in values], *[f"_c_{n}" for n in values])


def running_last(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str,
                 backward: bool = False) -> DataFrame:
    """Add the last non-null `value` at or before each row of its key (at or after, if backward)."""
    direction = F.desc if backward else F.asc
    local = (Window.partitionBy(*keys, "piece").orderBy(*[direction(o) for o in order])
             .rowsBetween(Window.unboundedPreceding, 0))
    before = (Window.partitionBy(*keys).orderBy(direction("piece"))
              .rowsBetween(Window.unboundedPreceding, -1))
    pick = F.min_by if backward else F.max_by
    ends = (
        df.withColumn("_v", value).where("_v is not null")
        .groupBy(*keys, "piece").agg(pick("_v", F.struct(*order)).alias("_end")))
    all_pieces = df.select(*keys, "piece").distinct().join(ends, [*keys, "piece"], "left")
    carried = all_pieces.select(
        *keys, "piece", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    out = df.withColumn("_here", F.last(value, ignorenulls=True).over(local))
    out = out.join(checked_side(carried), [*keys, "piece"])
    return out.withColumn(name, F.coalesce("_here", "_before")).drop("_here", "_before")
