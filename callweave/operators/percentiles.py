"""Percentiles that merge, and exact ones for groups of any size.

`rollup` stores a KLL sketch a key (day, stage, ...) beside count, sum and largest value; rollups of days, of streams'
batches and of tasks merge (`merged`) for any range, and `quantiles` reads them with a rank error of about 1.7 / K.

`nearest_rank` is exact: the value at place round_half_even(p * (n - 1)) of a group. A sketch says between which two
values it must lie; only values between them are counted by value and put in order, the rest is only counted. No group is
gathered or sorted whole. Were a sketch wrong (its error is a matter of chance), the place would fall outside its
bracket; such a group is then counted by value as a whole. Null values are left out; a group without values has no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.sources.shared import new_folder

K = 1024  # size of a sketch: about 10 KB
EPS = 0.01  # half the width of a bracket, in ranks: six times the sketch's error


def rollup(rows: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """keys, sketch, n, total, most."""
    v = F.col(value).cast("double")
    kept = rows.filter(v.isNotNull() & ~F.isnan(v))
    return kept.groupBy(*keys).agg(F.kll_sketch_agg_double(v, k).alias("sketch"), F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.max(v).alias("most"))


def merged(rolled: DataFrame, keys: list[str]) -> DataFrame:
    """Rollups of finer keys as rollups of `keys`."""
    return rolled.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most"))


def quantiles(rolled: DataFrame, ps: dict[str, float]) -> DataFrame:
    """A column for each name, the sketch's value at that share of the ranks."""
    return rolled.withColumns({name: F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for name, p in ps.items()})


def _table(rows: DataFrame) -> DataFrame:
    """Few rows a group, written and read back: the planner sees how small they are, so the values that meet them are not dealt by group."""
    path = new_folder(rows.sparkSession, "ranks")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def nearest_rank(rows: DataFrame, keys: list[str], value: str, ps: dict[str, float], k: int = K) -> DataFrame:
    """keys, and a column for each name of `ps`."""
    v = F.col(value).cast("double")
    own = rows.filter(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("__v"))
    at = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, p))))
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), at(p - EPS).alias("low"), at(p + EPS).alias("high"), F.bround(F.lit(p) * (F.col("n") - 1), 0).cast("long").alias("place")) for n, p in ps.items()])
    asked = _table(rollup(own, keys, "__v", k).select(*keys, F.explode(wanted).alias("w")).select(*keys, "w.*"))
    met = own.join(asked, keys) if keys else own.join(F.broadcast(asked))  # without keys: a row for each of ps
    group = [*keys, "name"]
    # values below a bracket fall together under a null
    by_value = met.filter(F.col("__v") <= F.col("high")).groupBy(*group, "place", F.when(F.col("__v") >= F.col("low"), F.col("__v")).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(*group).orderBy(F.col("x").asc_nulls_first())
    upto = by_value.withColumn("upto", F.sum("c").over(order))
    hit = F.min_by(F.struct("x"), F.when(F.col("upto") > F.col("place"), F.col("upto")))["x"]
    found = _table(upto.groupBy(*group, "place").agg(hit.alias("x")))
    each = lambda both: both.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("x"))).alias(n) for n in ps])
    if found.filter("x is null").isEmpty():
        return each(found)
    missed = found.filter("x is null").select(*group, "place")
    whole = own.join(missed, keys) if keys else own.join(F.broadcast(missed))
    counts = whole.groupBy(*group, "place", "__v").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(Window.partitionBy(*group).orderBy("__v")))
    again = counts.filter(F.col("upto") > F.col("place")).groupBy(*group).agg(F.min("__v").alias("x"))
    both = found.filter("x is not null").select(*group, "x").unionByName(again.select(*group, "x"))
    return each(both)
