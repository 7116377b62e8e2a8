"""Filters, lookups, windows and row shaping that the reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def since(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """Rows of the last `days` days before `as_of`, which is given and never the clock."""
    if not 1 <= days <= 365:
        raise ValueError("days must be from 1 to 365")
    return df.filter(F.col(ts) >= F.expr(f"timestamp_ntz'{as_of}' - interval {days} days"))


def equal(df: DataFrame, **values) -> DataFrame:
    """Equality filters; a value of None is no filter."""
    for column, value in values.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    return df


def search(df: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Case-insensitive substring in any of the columns."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{needle}%"), F.lit(False))
    return df.filter(hit)


def stale(ts: Column, as_of: str, days: int = 180) -> Column:
    """More than so many whole periods of 24 hours old."""
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    return F.floor(age / 86_400_000_000) > days


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def last_n(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def page(df: DataFrame, size: int, offset: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)


def streak(df: DataFrame, key: str, order: str, hit: Column) -> DataFrame:
    """Length of the run of hits that ends at each row; 0 on a miss."""
    w = Window.partitionBy(key).orderBy(order)
    islands = df.withColumn("__hit", hit).withColumn("__island", F.sum(F.when(F.col("__hit"), 0).otherwise(1)).over(w))
    run = F.sum(F.when(F.col("__hit"), 1).otherwise(0)).over(Window.partitionBy(key, "__island").orderBy(order))
    return islands.withColumn("streak", run).drop("__hit", "__island")


def carry_forward(df: DataFrame, key: str, order: str, value: str, rows: int = 3) -> DataFrame:
    """The last value of up to `rows` rows before, where a row has none."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-rows, -1)
    return df.withColumn("carried", F.coalesce(F.col(value), F.last(value, ignorenulls=True).over(w)))


def percentile(values: Column, p: float) -> Column:
    """Nearest rank with half-even rounding of p * (n - 1) over a sorted array; 1 decimal; 0 for none."""
    ordered = F.sort_array(values)
    at = F.bround(p * (F.size(ordered) - 1), 0).cast("int")
    return F.when(F.size(ordered) == 0, 0.0).otherwise(F.round(F.get(ordered, at), 1))


def ranked_percentile(df: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """The same rule by row numbers, for groups too large for an array."""
    w = Window.partitionBy(*keys)
    ranked = df.filter(F.col(value).isNotNull()).withColumns(
        {"__i": F.row_number().over(w.orderBy(value)) - 1, "__n": F.count(F.lit(1)).over(w)}
    )
    return ranked.filter(F.col("__i") == F.bround(p * (F.col("__n") - 1), 0)).select(*keys, F.round(value, 1).alias(name))
