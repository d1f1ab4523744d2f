"""Queries of the generic table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions.expr import compile_expression
from ..operators import simulate, tables
from .model import rounded
from .registry import query


def rounded7(x, n: int = 7):
    """Seven digits: means of 60,000 two-digit values end halfway at six."""
    return rounded(x, n)


@query("uniqc_events", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    """Counts of values."""
    return tables.value_counts(t.events, "event_type")


@query("word_counts", r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS word FROM conversations) WHERE word <> '' GROUP BY 1")
def _(t):
    """Counts of words."""
    return tables.word_counts(t.conversations, "text")


@query("char_counts", r"""SELECT "char", count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(text, '\s+', '', 'g'), '(?s).')) AS "char" FROM benchmark) GROUP BY 1""")
def _(t):
    """Counts of characters other than white space."""
    return tables.char_counts(t.benchmark, "text")


@query("select_columns", "SELECT l_shipdate, l_orderkey, l_quantity FROM lineitem")
def _(t):
    """Projection in a given order."""
    return tables.select_columns(t.lineitem, ["l_shipdate", "l_orderkey", "l_quantity"])


@query("filter_rows", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30 AND greatest(l_discount, l_tax) > 0.05")
def _(t):
    """Predicate on named columns."""
    return tables.split_by(t.lineitem, "l_quantity > 30 AND greatest(l_discount, l_tax) > 0.05")[0].select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_rejects", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT coalesce(l_quantity > 30 AND greatest(l_discount, l_tax) > 0.05, false)")
def _(t):
    """The rows that a predicate rejects."""
    return tables.split_by(t.lineitem, "l_quantity > 30 AND greatest(l_discount, l_tax) > 0.05")[1].select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_body", "SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    """Filter and derived column over the body."""
    return t.orders.filter("o_orderstatus = 'F'").selectExpr("o_orderkey", "o_totalprice * 2 AS doubled")


@query("select_equal", "SELECT s_suppkey, s_nationkey FROM supplier WHERE CAST(s_nationkey AS VARCHAR) = '7'")
def _(t):
    """Equality on the text of a cell."""
    return tables.equals(t.supplier, "s_nationkey", "7").select("s_suppkey", "s_nationkey")


@query("derived_column", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount) + sqrt(greatest(l_tax, l_discount)), 7) AS net FROM lineitem")
def _(t):
    """P5: a column computed by the expression language."""
    d = tables.derive(t.lineitem, "net", "l_extendedprice * (1 - l_discount) + sqrt(max(l_tax, l_discount))")
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("net", 7).alias("net"))


@query("column_numbers", "SELECT CAST(number AS INTEGER) AS number, name FROM (VALUES (1, 'r_regionkey'), (2, 'r_name')) v(number, name)")
def _(t):
    """Columns with their numbers."""
    return tables.column_numbers(t.region)


@query("join_list", "SELECT event_type, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id) AS users FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY 1")
def _(t):
    """Values of a group joined to one line."""
    return t.events.groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_set("user_id")).cast("array<string>"), ",").alias("users"))


@query("split_lines", r"SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark")
def _(t):
    """One row per line."""
    return t.benchmark.select("item_id", F.explode(F.split("text", "\n")).alias("line"))


@query("lines_at_positions", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_suppkey, l_partkey % 100) IN (SELECT s_suppkey, s_nationkey FROM supplier)")
def _(t):
    """Rows at listed positions."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("chr"), (F.col("l_partkey") % 100).alias("pos"))
    return tables.lines_at_positions(rows, t.supplier.select(F.col("s_suppkey").alias("chr"), F.col("s_nationkey").cast("long").alias("pos"))).select("l_orderkey", "l_linenumber")


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = "(" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM lineitem" for c in NUMBERS) + ")"
_MOMENTS = """count(*) AS n, round(min(value), 7) AS minimum, round(max(value), 7) AS maximum, round(avg(value), 7) AS mean, round(stddev_pop(value), 7) AS stdev"""
_SKEW = "round(avg(power((value - mu) / sd, 3)), 4) AS skew"
_MED = "list_sort(list(value))[count(*) // 2 + 1]"


@query("stats_lineitem", f"""WITH l AS (SELECT *, avg(value) OVER (PARTITION BY "column") AS mu, stddev_pop(value) OVER (PARTITION BY "column") AS sd FROM {_LONG})
SELECT "column", {_MOMENTS}, round(stddev_pop(value) / sqrt(count(*)), 7) AS seom, {_SKEW}, {_MED} AS median FROM l GROUP BY 1""")
def _(t):
    """Statistics per column."""
    s = tables.column_stats(t.lineitem, NUMBERS)
    return s.select("column", "n", *[rounded7(c).alias(c) for c in ("minimum", "maximum", "mean", "stdev", "seom")], rounded7("skew", 4).alias("skew"), "median")


@query("minmax_lineitem", f"""SELECT "column", min(value) AS minimum, max(value) AS maximum, round(avg(value), 7) AS mean, {_MED} AS median FROM {_LONG} GROUP BY 1""")
def _(t):
    """Minimum, maximum, mean and median."""
    return tables.extremes(t.lineitem, NUMBERS).withColumn("mean", rounded7("mean"))


@query("averages", "SELECT round(avg(l_quantity), 7) AS l_quantity, round(avg(l_tax), 7) AS l_tax FROM lineitem")
def _(t):
    """Means."""
    return t.lineitem.agg(*[rounded7(F.avg(c)).alias(c) for c in ("l_quantity", "l_tax")])


@query("table_stats_nonzero", f"""
WITH l AS (SELECT "column", value - CASE "column" WHEN 'l_discount' THEN 0.05 ELSE 0 END AS value FROM {_LONG} WHERE "column" IN ('l_discount', 'l_tax')),
v AS (SELECT *, 'all' AS subset FROM l UNION ALL SELECT *, 'nonzeros' FROM l WHERE value <> 0 UNION ALL SELECT *, 'negatives' FROM l WHERE value < 0 UNION ALL SELECT *, 'positives' FROM l WHERE value > 0),
m AS (SELECT "column", subset, {_MOMENTS}, {_MED} AS median FROM v GROUP BY 1, 2),
d AS (SELECT "column", subset, list_sort(list(abs(value - median)))[count(*) // 2 + 1] AS mad FROM v JOIN (SELECT "column", subset, median FROM m) USING ("column", subset) GROUP BY 1, 2),
a AS (SELECT "column", n AS all_n FROM m WHERE subset = 'all')
SELECT "column", subset, n, minimum, maximum, mean, stdev, round(median, 7) AS median, round(mad, 7) AS mad FROM m JOIN d USING ("column", subset) JOIN a USING ("column") WHERE subset = 'all' OR n < all_n""")
def _(t):
    """Statistics over all, nonzero, negative and positive values."""
    df = t.lineitem.select((F.col("l_discount") - 0.05).alias("l_discount"), "l_tax")
    s = tables.table_stats(df, ["l_discount", "l_tax"])
    return s.select("column", "subset", "n", *[rounded7(c).alias(c) for c in ("minimum", "maximum", "mean", "stdev", "median", "mad")])


_CELLS = "(" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM part" for c in ("p_brand", "p_size")) + ")"


@query("table_summary_part", f"""
WITH x AS (SELECT "column", value, TRY_CAST(value AS DOUBLE) AS number FROM {_CELLS}),
s AS (SELECT "column", count(DISTINCT value) AS "distinct", bool_and(number IS NOT NULL) AS "numeric", min(number) AS minimum, max(number) AS maximum, round(avg(number), 7) AS mean, round(stddev_pop(number), 7) AS stdev, sum(number) AS total,
  list_sort(list(number) FILTER (number IS NOT NULL))[count(number) // 2 + 1] AS median FROM x GROUP BY 1)
SELECT s.*, list_sort(list(abs(number - median)) FILTER (number IS NOT NULL))[count(number) // 2 + 1] AS mad FROM s JOIN x USING ("column") GROUP BY ALL""")
def _(t):
    """Summary of columns."""
    s, _ranked = tables.table_summary(t.part, ["p_brand", "p_size"])
    return s.select("column", "distinct", "numeric", "minimum", "maximum", rounded7("mean").alias("mean"), rounded7("stdev").alias("stdev"), "total", "median", "mad")


@query("table_summary_ranks", f"""SELECT "column", value, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value DESC) AS rank FROM (SELECT "column", value, count(*) AS n FROM {_CELLS} GROUP BY ALL)) WHERE rank <= 10""")
def _(t):
    """Most frequent values, ranked (a top-k report)."""
    return tables.table_summary(t.part, ["p_brand", "p_size"])[1].select("column", "value", "n", "rank")


@query("table_sum_files", """
WITH f AS (SELECT s_suppkey, s_nationkey, s_acctbal, row_number() OVER (ORDER BY s_suppkey) AS "row" FROM supplier),
g AS (SELECT s_suppkey, s_nationkey * 2 AS s_nationkey, -s_acctbal AS s_acctbal, row_number() OVER (ORDER BY s_suppkey) AS "row" FROM supplier)
SELECT CAST(f."row" AS INTEGER) AS "row", g.s_suppkey, CAST(f.s_nationkey + g.s_nationkey AS BIGINT) AS s_nationkey, round(CASE WHEN f.s_acctbal >= 0 THEN f.s_acctbal ELSE 0 END + CASE WHEN g.s_acctbal >= 0 THEN g.s_acctbal ELSE 0 END, 7) AS s_acctbal FROM f JOIN g USING ("row")""")
def _(t):
    """Cell-wise sum, a protected column, negatives skipped."""
    a = t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal")
    b = a.select("s_suppkey", (F.col("s_nationkey") * 2).alias("s_nationkey"), (-F.col("s_acctbal")).alias("s_acctbal"))
    return tables.cell_sums([a, b], ["s_suppkey"], protect=["s_suppkey"], skip_negative=True).withColumn("s_acctbal", rounded7("s_acctbal"))


@query("table_averages", """WITH f AS (SELECT s_suppkey, s_acctbal FROM supplier) SELECT CAST(row_number() OVER (ORDER BY s_suppkey) AS INTEGER) AS "row", CAST(s_suppkey AS DOUBLE) AS s_suppkey, CASE WHEN s_acctbal >= 0 THEN round(s_acctbal, 7) ELSE -1 END AS s_acctbal FROM f""")
def _(t):
    """Cell-wise mean; -1 where nothing counts."""
    a = t.supplier.select("s_suppkey", "s_acctbal")
    return tables.cell_sums([a, a], ["s_suppkey"], average=True, skip_negative=True).withColumn("s_acctbal", rounded7("s_acctbal"))


@query("pivot_event_type", """
WITH a AS (SELECT *, count(*) OVER () AS total FROM (SELECT event_type, CAST(user_id % 7 AS BIGINT) AS u, value, 'x' AS tag FROM events))
SELECT 'event_type' AS pivot, event_type AS "group", count(*) AS n, count(*) / CAST(max(total) AS DOUBLE) AS fraction, round(avg(value), 7) AS mean_value, CASE WHEN min(tag) = max(tag) THEN min(tag) ELSE '-' END AS only_tag FROM a GROUP BY event_type
UNION ALL SELECT 'u', CAST(u AS VARCHAR), count(*), count(*) / CAST(max(total) AS DOUBLE), round(avg(value), 7), CASE WHEN min(tag) = max(tag) THEN min(tag) ELSE '-' END FROM a GROUP BY u""")
def _(t):
    """One summary per pivot column, by grouping sets."""
    e = t.events.select("event_type", (F.col("user_id") % 7).alias("u"), "value", F.lit("x").alias("tag"))
    return tables.pivot_summary(e, ["event_type", "u"], ["value"], ["tag"]).withColumn("mean_value", rounded7("mean_value"))


@query("mad_by_group", """
WITH m AS (SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS median FROM events GROUP BY 1)
SELECT event_type, median, list_sort(list(abs(value - median)))[count(*) // 2 + 1] AS mad FROM events JOIN m USING (event_type) GROUP BY ALL""")
def _(t):
    """Median absolute deviation per group."""
    return stats.mad(t.events, ["event_type"], "value")


@query("moments_by_group", """
WITH e AS (SELECT *, avg(value) OVER (PARTITION BY event_type) AS mu, stddev_pop(value) OVER (PARTITION BY event_type) AS sd FROM events)
SELECT event_type, count(*) AS n, round(avg(value), 7) AS mean, round(stddev_pop(value), 7) AS stdev, round(avg(power((value - mu) / sd, 3)), 4) AS skew, round(avg(power((value - mu) / sd, 4)), 4) AS kurtosis FROM e GROUP BY 1""")
def _(t):
    """Population moments; the kurtosis is not the excess one."""
    m = stats.moments(F.col("value"))
    return t.events.groupBy("event_type").agg(m["n"].alias("n"), rounded7(m["mean"]).alias("mean"), rounded7(m["stdev"]).alias("stdev"), rounded7(m["skew"], 4).alias("skew"), rounded7(m["kurtosis"], 4).alias("kurtosis"))


@query("running_mean_parts", """SELECT event_type, count(value) AS n, round(avg(value), 7) AS mean, round(stddev_samp(value), 7) AS stdev, min(value) AS minimum, max(value) AS maximum FROM events GROUP BY 1""")
def _(t):
    """Mergeable running statistics: partial sums per user, then merged."""
    p = t.events.groupBy("event_type", "user_id").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    return p.groupBy("event_type").agg(n.alias("n"), rounded7(s / n).alias("mean"), rounded7(F.sqrt((q - s * s / n) / (n - 1))).alias("stdev"), F.min("lo").alias("minimum"), F.max("hi").alias("maximum"))


@query("autocorrelation", """SELECT event_type, round(corr(value, earlier), 7) AS autocorrelation FROM (SELECT *, lag(value, 2) OVER (PARTITION BY event_type ORDER BY ts) AS earlier FROM events) GROUP BY 1""")
def _(t):
    """Autocorrelation at lag 2."""
    return tables.autocorrelation(t.events, "ts", "value", 2, ["event_type"]).withColumn("autocorrelation", rounded7("autocorrelation"))


@query("linear_regression", """
WITH r AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_count(l_extendedprice, l_quantity) AS n, regr_sxx(l_extendedprice, l_quantity) AS sxx,
  regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy, avg(l_quantity) AS mx FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 4) AS slope_error, round(sqrt((syy - sxy * sxy / sxx) / (n - 2) * (1.0 / n + mx * mx / sxx)), 4) AS intercept_error FROM r""")
def _(t):
    """Regression with errors."""
    return t.lineitem.groupBy("l_returnflag").agg(*[rounded7(c, 4).alias(k) for k, c in stats.regression(F.col("l_extendedprice"), F.col("l_quantity")).items()])


_HIST = """b AS (SELECT lo - 0.05 * (hi - lo) AS low0, (hi - lo) * 1.1 / {n} AS width FROM (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n FROM events))"""


@query("histogram_fixed", f"WITH {_HIST.format(n=20)} SELECT CAST(floor((value - low0) / width) AS INTEGER) AS bin, count(*) AS n, round(min(low0 + floor((value - low0) / width) * width), 7) AS low FROM events, b GROUP BY 1")
def _(t):
    """Histogram with 20 bins."""
    return tables.histogram(t.events, "value", 20).withColumn("low", rounded7("low"))


@query("histogram_split", f"WITH {_HIST.format(n='floor(sqrt(n))')} SELECT event_type, CAST(floor((value - low0) / width) AS INTEGER) AS bin, count(*) AS n FROM events, b GROUP BY 1, 2")
def _(t):
    """Histogram per group, square root of n bins."""
    return tables.histogram(t.events, "value", 0, "event_type").select("event_type", "bin", "n")


@query("sensitivity_sweep", """
WITH c AS (SELECT n_chars % 50 AS threshold, count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic = 0) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT threshold, round(sum(p) OVER w / CAST(sum(p) OVER () AS DOUBLE), 9) AS sensitivity, round(1 - sum(n) OVER w / CAST(sum(n) OVER () AS DOUBLE), 9) AS specificity FROM c WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)""")
def _(t):
    """Sensitivity and specificity at every threshold."""
    d = t.documents.select("doc_id", (F.col("n_chars") % 50).alias("score")).join(t.labels.select("doc_id", (F.col("toxic") == 1).alias("truth")), "doc_id")
    return tables.threshold_sweep(d, "score", "truth").withColumns({c: rounded7(c, 9) for c in ("sensitivity", "specificity")})


@query("candidate_stats", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 7) AS mean, list_sort(list(l_quantity))[count(*) // 2 + 1] AS median, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1, 2""")
def _(t):
    """Grouped statistics of a candidate table."""
    keys = ["l_returnflag", "l_linestatus"]
    s = t.lineitem.groupBy(*keys).agg(F.count("*").alias("n"), rounded7(F.avg("l_quantity")).alias("mean"), F.count_distinct("l_suppkey").alias("suppliers"))
    return s.join(stats.upper_median(t.lineitem, keys, "l_quantity"), keys)


@query("genome_sort", """WITH c AS (SELECT r_regionkey AS chr, sum(2000 * (r_regionkey + 1)) OVER (ORDER BY r_regionkey) - 2000 * (r_regionkey + 1) AS off FROM region WHERE r_regionkey < 3)
SELECT CAST(off + (l_partkey % 12) * 100 AS BIGINT) AS abspos, concat_ws(' ', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line FROM lineitem JOIN c ON l_suppkey % 3 = chr""")
def _(t):
    """Rows in genome order with their absolute positions."""
    rows = t.lineitem.select("*", (F.col("l_suppkey") % 3).cast("int").alias("chr"), ((F.col("l_partkey") % 12) * 100).alias("pos"))
    return tables.genome_sort(rows, t.chromosomes, F.concat_ws(" ", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).select("abspos", "line")


@query("abspos_round_trip", "SELECT DISTINCT CAST(l_suppkey % 3 AS INTEGER) AS chr, CAST((l_partkey % 12) * 100 AS BIGINT) AS pos FROM lineitem")
def _(t):
    """Absolute positions and back."""
    from ..functions.coords import add_abspos, to_chrpos

    rows = t.lineitem.select((F.col("l_suppkey") % 3).cast("int").alias("chr"), ((F.col("l_partkey") % 12) * 100).alias("pos")).distinct()
    return to_chrpos(add_abspos(rows, t.chromosomes).select("abspos"), t.chromosomes).select("chr", "pos")


@query("line_range", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 11 OFFSET 4")
def _(t):
    """Lines 5 to 15 of an explicit order (the limit is the feature)."""
    return tables.line_range(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], 5, 15)


@query("union_inputs", "SELECT * FROM region UNION ALL SELECT * FROM region")
def _(t):
    """Union of inputs of one header."""
    return tables.union_same_header([t.region, t.region])


@query("random_order", "SELECT * FROM orders")
def _(t):
    """All rows in a seeded random order."""
    return tables.shuffle_rows(t.orders, 7, "o_orderkey")


@query("subsample", "SELECT * FROM orders ORDER BY md5('7|' || o_orderkey), o_orderkey LIMIT 100")
def _(t):
    """100 rows, each as likely as any other (a sampling operator)."""
    return tables.subsample(t.orders, 100, 7, "o_orderkey")


_UNIFORM = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) / 4503599627370496.0"
_GENOME = "genome AS (SELECT CAST(r_regionkey AS INTEGER) AS chr, CAST(2000 * (r_regionkey + 1) AS BIGINT) AS len, coalesce(sum(2000 * (r_regionkey + 1)) OVER (ORDER BY r_regionkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM region WHERE r_regionkey < 3)"


@query("random_positions", f"WITH {_GENOME}, u AS (SELECT i AS id, CAST(floor({_UNIFORM.format("'5|' || i")} * (SELECT sum(len) FROM genome)) AS BIGINT) AS abspos FROM range(1000) t(i)) SELECT id, abspos, chr, CAST(abspos - o AS BIGINT) AS pos FROM u JOIN genome ON o <= abspos AND abspos < o + len")
def _(t):
    """Uniform genome positions."""
    return simulate.random_positions(t.spark, 1000, t.chromosomes, 5)


@query("random_draws", f"WITH n AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS row_ FROM supplier), u AS (SELECT i AS draw, CAST(floor({_UNIFORM.format("'3|' || i")} * (SELECT count(*) FROM supplier)) AS BIGINT) AS place FROM range(200) t(i)) SELECT draw, n.* EXCLUDE (row_) FROM u JOIN n ON place = row_")
def _(t):
    """Draws with replacement."""
    return simulate.sample_rows(t.supplier, 200, 3, "s_suppkey")


@query("aligned_text", "SELECT rpad(CAST(r_regionkey AS VARCHAR), 11, ' ') || ' ' || rpad(r_name, CAST((SELECT greatest(max(length(r_name)), 6) FROM region) AS INTEGER), ' ') AS line FROM region")
def _(t):
    """Aligned text."""
    return tables.aligned(t.region)


@query("expression_language", "SELECT p_partkey, CAST(3 + 4 - p_size AS DOUBLE) AS a, CAST(p_size * -3 AS DOUBLE) AS b, round(power(p_size, 2) + sqrt(p_size) / 2, 7) AS c, CAST(greatest(p_size, 10, 20) AS DOUBLE) AS d, CAST(p_partkey % 7 AS DOUBLE) AS e FROM part")
def _(t):
    """Section 2.8: the arithmetic language."""
    names = {"size": F.col("p_size"), "key": F.col("p_partkey"), "three": F.lit(-3)}
    e = lambda x: compile_expression(x, names)
    return t.part.select("p_partkey", e("3+4-size").alias("a"), e("size*three").alias("b"), rounded7(e("pow(size, 2) + sqrt(size) / 2")).alias("c"), e("max3(size, 10, 20)").alias("d"), e("key % 7").alias("e"))


@query("string_functions", """SELECT n_nationkey, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS capital, replace(n_name, 'A', '-') AS dashed, split_part(n_name, 'N', 1) AS head, format('{:,}', n_nationkey * 1234567) AS commas FROM nation""")
def _(t):
    """Section 2.8: string helpers."""
    n = F.col("n_name")
    return t.nation.select("n_nationkey", F.concat(F.upper(F.substring(n, 1, 1)), F.lower(F.substring(n, 2, 1000))).alias("capital"), F.replace(n, F.lit("A"), F.lit("-")).alias("dashed"), F.substring_index(n, "N", 1).alias("head"), F.format_number(F.col("n_nationkey").cast("long") * 1234567, 0).alias("commas"))


@query("hash_and_dates", "SELECT o_orderkey, sha1('salt' || o_orderpriority) AS salted, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS day FROM orders")
def _(t):
    """Section 2.8: salted hashes and formatted dates."""
    return t.orders.select("o_orderkey", F.sha1(F.concat(F.lit("salt"), "o_orderpriority")).alias("salted"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("day"))


@query("join_using", "SELECT o_orderkey, c_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(t):
    """A left join by key."""
    c = t.customer.select("c_custkey", "c_name")
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_custkey", "c_name")


@query("json_property", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def _(t):
    """Section 2.8: a property of a JSON column."""
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
