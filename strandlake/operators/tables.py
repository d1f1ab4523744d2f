"""Operators on generic tables: projection, filters, counts, summaries, pivots, sums, samples and order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import compile_expression
from ..functions.stats import mad, moments, wide_upper_median


def select_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns by name, in the given order; an unknown name is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def split_by(df: DataFrame, predicate: str | Column) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy the predicate, and all others (unknown counts as rejected)."""
    cond = F.expr(predicate) if isinstance(predicate, str) else predicate
    return df.filter(cond), df.filter(~F.coalesce(cond, F.lit(False)))


def equals(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose cell, as text, is ``value``."""
    return df.filter(F.col(column).cast("string") == value)


def derive(df: DataFrame, name: str, expression: str) -> DataFrame:
    """Add a column computed by the small arithmetic language."""
    return df.withColumn(name, compile_expression(expression))


def column_numbers(df: DataFrame) -> DataFrame:
    """Column names with their one-based numbers."""
    return df.sparkSession.createDataFrame([(i + 1, c) for i, c in enumerate(df.columns)], "number int, name string")


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """How often each value (combination) occurs."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def word_counts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(F.split(F.col(text), r"\s+")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def char_counts(df: DataFrame, text: str) -> DataFrame:
    """Characters without white space; partial counts come before the shuffle."""
    return df.select(F.explode(F.split(F.regexp_replace(text, r"\s+", ""), "")).alias("char")).filter("char <> ''").groupBy("char").agg(F.count("*").alias("n"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) rows of numeric columns, from one scan."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.column", "x.value")


def column_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """n, mean, seom, stdev, skew, upper median, minimum, maximum per numeric column."""
    columns = columns or numeric_columns(df)
    kinds = ("n", "mean", "seom", "stdev", "skew", "minimum", "maximum")
    # the moments of all columns in one row, without a row per cell
    row = df.agg(*[F.struct(F.lit(c).alias("column"), *[moments(F.col(f"`{c}`").cast("double"))[k].alias(k) for k in kinds]).alias(f"c{i}") for i, c in enumerate(columns)])
    stats = row.select(F.inline(F.array(*[f"c{i}" for i in range(len(columns))]))).filter("n > 0")
    return stats.join(wide_upper_median(long_form(df, columns).filter("value IS NOT NULL"), ["column"], "value"), "column")


def table_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Statistics of each column over all values, and over its nonzero, negative and positive ones where they vary."""
    rows = long_form(df, columns or numeric_columns(df)).filter("value IS NOT NULL")
    v = F.col("value")
    subsets = F.filter(
        F.array(
            F.lit("all"), F.when(v != 0, F.lit("nonzeros")), F.when(v < 0, F.lit("negatives")), F.when(v > 0, F.lit("positives"))
        ),
        lambda x: x.isNotNull(),
    )
    rows = rows.select("column", "value", F.explode(subsets).alias("subset"))
    m = moments(v)
    stats = rows.groupBy("column", "subset").agg(*[m[k].alias(k) for k in ("n", "minimum", "maximum", "mean", "stdev", "skew")])
    # a subset is told only where there are values of the other kind
    everything = stats.filter("subset = 'all'").select("column", F.col("n").alias("all_n"), (F.col("minimum") < 0).alias("has_negative"), (F.col("minimum") == F.col("maximum")).alias("constant"))
    keep = (F.col("subset") == "all") | (~F.col("constant") & (F.col("n") < F.col("all_n")))
    stats = stats.join(F.broadcast(everything), "column").filter(keep).drop("all_n", "has_negative", "constant")  # one row per column
    return stats.join(mad(rows, ["column", "subset"], "value", wide=True), ["column", "subset"])


def table_summary(df: DataFrame, columns: list[str], top: int = 10) -> tuple[DataFrame, DataFrame]:
    """Per column: distinct values with numeric statistics; and the most frequent values, ranked."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.column", "x.value")
    counts = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
    number = F.expr("try_cast(value AS double)")
    numeric = counts.groupBy("column").agg(F.count("*").alias("distinct"), F.every(number.isNotNull()).alias("numeric"))
    values = cells.withColumn("number", number).join(F.broadcast(numeric.filter("numeric").select("column")), "column")
    m = moments(F.col("number"))
    stats = values.groupBy("column").agg(m["minimum"].alias("minimum"), m["maximum"].alias("maximum"), m["mean"].alias("mean"), m["stdev"].alias("stdev"), F.sum("number").alias("total"))
    summary = numeric.join(stats, "column", "left").join(mad(values, ["column"], "number", wide=True), "column", "left")
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), F.desc("value")))
    ranked = counts.withColumn("rank", rank).filter(F.col("rank") <= top)
    return summary, ranked


def extremes(df: DataFrame, columns: list[str]) -> DataFrame:
    """minimum, maximum, mean and upper median per column."""
    return column_stats(df, columns).select("column", "minimum", "maximum", "mean", "median")


def cell_sums(tables: list[DataFrame], order: list[str], protect: list[str] = (), average: bool = False, skip_negative: bool = False) -> DataFrame:
    """Cell-wise sum of tables of one shape: rows meet by their number in ``order``.

    Protected columns take the last table's value; with ``average`` the mean of
    the summed cells (-1 where there are none).
    """
    names = tables[0].columns
    for t in tables:
        if t.columns != names:
            raise ValueError("tables differ in their columns")
    numbered = [t.select("*", F.row_number().over(Window.orderBy(*order)).alias("row"), F.lit(i).alias("file")) for i, t in enumerate(tables)]
    both = reduce(DataFrame.unionByName, numbered)

    def cell(c: str) -> Column:
        if c in protect:
            return F.max_by(c, "file").alias(c)
        x = F.when(F.col(c) >= 0, F.col(c)) if skip_negative else F.col(c)
        total = F.coalesce(F.avg(x), F.lit(-1.0)) if average else F.coalesce(F.sum(x), F.lit(0))
        return total.alias(c)

    return both.groupBy("row").agg(*[cell(c) for c in names])


def pivot_summary(df: DataFrame, pivots: list[str], measures: list[str], constants: list[str] = ()) -> DataFrame:
    """For each pivot column, its groups: count, fraction, means, and texts that are constant in the group ('-' otherwise).

    All pivots are one aggregation with grouping sets, from one scan.
    """
    rows = df.groupingSets([[F.col(p)] for p in pivots], *[F.col(p) for p in pivots]).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n"), *[F.avg(m).alias(f"mean_{m}") for m in measures],
        *[F.when(F.min(c) == F.max(c), F.min(c)).otherwise("-").alias(f"only_{c}") for c in constants],
    )
    masks = {(1 << len(pivots)) - 1 - (1 << (len(pivots) - 1 - i)): p for i, p in enumerate(pivots)}
    pivot = reduce(lambda acc, kv: F.when(F.col("gid") == kv[0], kv[1]).otherwise(acc), masks.items(), F.lit(None).cast("string"))
    group = F.coalesce(*[F.col(p).cast("string") for p in pivots])
    total = df.agg(F.count("*").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select(  # one row
        pivot.alias("pivot"), group.alias("group"), "n", (F.col("n") / F.col("total")).alias("fraction"), *[f"mean_{m}" for m in measures], *[f"only_{c}" for c in constants]
    )


def histogram(df: DataFrame, value: str, bins: int = 0, split: str | None = None) -> DataFrame:
    """Counts in equal bins over the range widened by 5 % on both sides; 0 bins: the square root of n."""
    bounds = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"), F.count(value).alias("n"))
    n_bins = F.lit(bins) if bins else F.greatest(F.lit(1), F.floor(F.sqrt("n"))).cast("int")
    pad = (F.col("hi") - F.col("lo")) * 0.05
    bounds = bounds.select((F.col("lo") - pad).alias("lo"), ((F.col("hi") - F.col("lo") + 2 * pad) / n_bins).alias("width"))
    at = F.when(F.col("width") > 0, F.floor((F.col(value) - F.col("lo")) / F.col("width"))).otherwise(0).cast("int")
    keys = [split] if split else []
    return df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(bounds)).withColumn("bin", at).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.min(F.col("lo") + F.col("bin") * F.col("width")).alias("low"))


def genome_sort(df: DataFrame, chromosomes: DataFrame, line: Column, chr_col: str = "chr", pos_col: str = "pos") -> DataFrame:
    """Total order by absolute position, then by the line itself: a range partitioning and local sorts."""
    from ..functions.coords import add_abspos

    return add_abspos(df, chromosomes, chr_col, pos_col).withColumn("line", line).orderBy("abspos", "line")


def shuffle_rows(df: DataFrame, seed: int, *key: str) -> DataFrame:
    """Rows in an order that depends only on the seed and the key columns."""
    names = list(key or df.columns)
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in names]).cast("binary")), *names)


def subsample(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """``n`` rows, each subset equally likely (0: all); a top-n by a seeded hash, without a full sort."""
    return df if n == 0 else shuffle_rows(df, seed, *key).limit(n)


def line_range(df: DataFrame, order: list[str], first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` (one-based) of an explicit order."""
    return df.orderBy(*order).offset(first - 1).limit(last - first + 1)


def union_same_header(tables: list[DataFrame]) -> DataFrame:
    """Union of tables whose headers must be equal."""
    if any(t.columns != tables[0].columns for t in tables):
        raise ValueError("headers differ")
    return reduce(DataFrame.union, tables)


def lines_at_positions(df: DataFrame, positions: DataFrame, keys: tuple[str, ...] = ("chr", "pos")) -> DataFrame:
    """Rows whose position is in a list of positions, whatever order either is in."""
    return df.join(positions.select(*keys).distinct(), list(keys), "left_semi")


def aligned(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cells as text padded to the widest of their column."""
    columns = columns or df.columns
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    wide = text.agg(*[F.greatest(F.max(F.length(c)), F.lit(len(c))).alias(f"w_{c}") for c in columns])
    return text.crossJoin(F.broadcast(wide)).select(F.concat_ws(" ", *[F.rpad(F.col(c), F.col(f"w_{c}"), F.lit(" ")) for c in columns]).alias("line"))  # one row of widths


def threshold_sweep(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Sensitivity and specificity of calling everything at or above each score.

    Scores are counted first; the running sums go over one row per score.
    """
    counts = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(truth)).alias("p"), F.count_if(~F.col(truth)).alias("n"))
    up = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    return counts.select(
        "threshold", (F.sum("p").over(up) / F.sum("p").over(whole)).alias("sensitivity"), (1 - F.sum("n").over(up) / F.sum("n").over(whole)).alias("specificity")
    )


def autocorrelation(df: DataFrame, order: str, value: str, lag: int, keys: list[str] = ()) -> DataFrame:
    """Correlation of a series with itself ``lag`` rows earlier, per key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("earlier", F.lag(value, lag).over(w)).groupBy(*keys).agg(F.corr(value, "earlier").alias("autocorrelation"))
