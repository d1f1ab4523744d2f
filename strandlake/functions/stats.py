"""Statistics whose definitions differ from Spark's defaults.

The median is the upper one (the element at n/2 of the sorted values), spread is
raw (no normal-consistency factor), moments are those of the population and the
kurtosis is not the excess one. :func:`upper_median` is one aggregation whose
state is the distinct values of a group; :func:`wide_upper_median` is for groups
with more distinct values than a task should hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored


def moments(x: Column) -> dict[str, Column]:
    n = F.count(x)
    sd = F.stddev_pop(x)
    return {
        "n": n, "mean": F.avg(x), "stdev": sd, "seom": sd / F.sqrt(n), "skew": F.when(sd > 0, F.skewness(x)), "kurtosis": F.when(sd > 0, F.kurtosis(x) + 3),
        "minimum": F.min(x), "maximum": F.max(x),
    }


def upper_median_of(x: str) -> Column:
    """Upper median of a column as an aggregate: of a descending order, the first value that half of all reach."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{x}` DESC)")


def upper_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact upper median of ``value`` per group, with partial aggregation before the shuffle."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(upper_median_of(value).alias(name))


def wide_upper_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact upper median of ``value`` per group.

    Values are counted first (partial sums before the shuffle), so equal values
    cost one row. A group of very many distinct values is cut into slices by
    its own approximate quantiles: only the slice that holds the median is
    ranked, and slices are separate tasks.
    """
    counts = stored(df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n")), "value-counts")
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("__v", [i / 64 for i in range(1, 64)], 1000).alias("__cuts"), F.sum("__n").alias("__all"))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    cuts = cuts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__cuts", "__all")
    joined = counts.join(cuts, on, "inner") if keys else counts.crossJoin(cuts)
    # the slice of a value: how many cuts lie at or below it
    sliced = joined.withColumn("__s", F.size(F.filter("__cuts", lambda c: c <= F.col("__v"))))
    sums = sliced.groupBy(*keys, "__s").agg(F.sum("__n").alias("__m"), F.max("__all").alias("__all"))
    before = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__m").over(before), F.lit(0))).withColumn("__at", F.floor(F.col("__all") / 2))
    hit = sums.filter((F.col("__before") <= F.col("__at")) & (F.col("__at") < F.col("__before") + F.col("__m")))
    hit = hit.select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)], F.col("__s").alias("__hs"), "__before", "__at")
    inside = sliced.join(hit, [F.col(k).eqNullSafe(F.col(f"__h{i}")) for i, k in enumerate(keys)] + [F.col("__s") == F.col("__hs")])
    run = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    reached = inside.withColumn("__run", F.col("__before") + F.sum("__n").over(run)).filter(F.col("__run") > F.col("__at"))
    return reached.groupBy(*keys).agg(F.min("__v").alias(name))


def mad(df: DataFrame, keys: list[str], value: str, wide: bool = False) -> DataFrame:
    """Upper median and median absolute deviation per group; ``wide`` as in :func:`wide_upper_median`."""
    find = wide_upper_median if wide else upper_median
    rows = df.select(*keys, F.col(value).alias("__x"))
    med = find(rows, keys, "__x", "__med")
    other = F.broadcast(med) if not keys else med.select(*[F.col(k).alias(f"__m{i}") for i, k in enumerate(keys)], "__med")
    on = [F.col(k).eqNullSafe(F.col(f"__m{i}")) for i, k in enumerate(keys)]
    far = (rows.join(other, on) if keys else rows.crossJoin(other)).select(*keys, "__med", F.abs(F.col("__x") - F.col("__med")).alias("__dev"))  # without keys: one row
    # a group has one median, so it can be carried as a key
    return find(far, [*keys, "__med"], "__dev", "mad").select(*keys, F.col("__med").alias("median"), "mad")


def mad_in_row(values: Column) -> Column:
    """(median, mad) of an array, for groups that fit a row: a cohort's samples of one bin."""
    middle = lambda a: F.get(F.array_sort(a), F.floor(F.size(a) / 2).cast("int"))
    return F.get(F.transform(F.array(middle(values)), lambda m: F.struct(m.alias("median"), middle(F.transform(values, lambda x: F.abs(x - m))).alias("mad"))), 0)


def regression(y: Column, x: Column) -> dict[str, Column]:
    """Least squares of y on x: slope, intercept and their standard errors."""
    n, sxx, syy, sxy = F.regr_count(y, x), F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
    rest = (syy - sxy * sxy / sxx) / (n - 2)
    slope_error = F.sqrt(rest / sxx)
    return {
        "slope": F.regr_slope(y, x), "intercept": F.regr_intercept(y, x), "slope_error": slope_error,
        "intercept_error": F.sqrt(rest * (F.lit(1.0) / n + F.pow(F.regr_avgx(y, x), 2) / sxx)),
    }
