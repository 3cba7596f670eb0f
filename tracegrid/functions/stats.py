"""Quantiles, robust scales, interval unions, run lengths and hash draws as Columns or small DataFrame pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns a median absolute deviation into a standard deviation of normal data.
MAD = 1.4826


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def linear_quantile(c: str | Column, q: float) -> Column:
    """Linear interpolation between order statistics; null of nothing."""
    return F.percentile(col(c), q)


def nearest_rank(df: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """keys and the ceil(q n)-th smallest value, by numbering rather than by gathering a group in an array."""
    w = Window.partitionBy(*keys)
    ranked = df.select(*keys, value).filter(F.col(value).isNotNull()).withColumn("__k", F.row_number().over(w.orderBy(value))).withColumn("__n", F.count("*").over(w))
    # ceil of q n without the rounding error of q n itself
    return ranked.filter(F.col("__k") == F.greatest(F.ceil(F.round(F.col("__n") * q, 9)), F.lit(1))).select(*keys, F.col(value).alias(name))


def even_index_quantile(values: Column, q: float) -> Column:
    """Of a sorted array: the element at (n - 1) q, rounded half to even, without interpolation."""
    return F.get(values, F.bround((F.size(values) - 1) * q, 0).cast("int"))


def finite(c: str | Column) -> Column:
    x = col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def nonnegative(c: str | Column) -> Column:
    """Negative and not finite values are 0."""
    x = col(c)
    return F.when(finite(x) & (x > 0), x).otherwise(0.0)


def bounded_strength(z: str | Column, threshold: float) -> Column:
    """1 - exp(-z / threshold) in [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.exp(-nonnegative(z) / threshold)))


def robust_stats(df: DataFrame, keys: list[str], value: str, floor: Column | float) -> DataFrame:
    """keys, median, mad and scale = max(1.4826 mad, floor) in two passes of percentiles; floor may use `median`."""
    med = df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"))
    med = med.select(*(F.col(k).alias(f"__{k}") for k in keys), "median")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    dev = df.join(med, same).withColumn("__d", F.abs(F.col(value) - F.col("median")))
    out = dev.groupBy(*keys).agg(F.first("median").alias("median"), F.percentile("__d", 0.5).alias("mad"))
    least = floor if isinstance(floor, Column) else F.lit(float(floor))
    return out.withColumn("scale", F.greatest(F.col("mad") * MAD, least))


def smoothed_rate(errors: str | Column, n: str | Column) -> Column:
    return (col(errors) + 0.5) / (col(n) + 1)


def two_proportion_z(e0: str | Column, n0: str | Column, e1: str | Column, n1: str | Column) -> Column:
    """One-sided pooled z of rate 1 above rate 0; 0 where it has no variance or no rows."""
    e0, n0, e1, n1 = map(col, (e0, n0, e1, n1))
    p = (e0 + e1) / (n0 + n1)
    var = p * (1 - p) * (1 / n0 + 1 / n1)
    return F.when((n0 > 0) & (n1 > 0) & (var > 0), F.greatest(F.lit(0.0), (e1 / n1 - e0 / n0) / F.sqrt(var))).otherwise(0.0)


def interval_union(df: DataFrame, keys: list[str], start: str = "start_us", end: str = "end_us", name: str = "union_us") -> DataFrame:
    """keys and the length covered by intervals that may overlap or touch: each adds what lies past all ends so far."""
    before = F.max(end).over(Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    some = df.filter(F.col(end) > F.col(start)).withColumn("__new", F.greatest(F.lit(0), F.col(end) - F.greatest(start, before)))
    return some.groupBy(*keys).agg(F.sum("__new").alias(name))


def longest_run(df: DataFrame, keys: list[str], order: str, flag: str, name: str = "longest_run") -> DataFrame:
    """keys and the most consecutive rows with a true flag (0 if none)."""
    by = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("__i", F.row_number().over(by))
    on = marked.filter(F.col(flag)).withColumn("__g", F.col("__i") - F.row_number().over(by))
    runs = on.groupBy(*keys, "__g").agg(F.count("*").alias("__len")).groupBy(*keys).agg(F.max("__len").alias(name))
    runs = runs.select(*(F.col(k).alias(f"__{k}") for k in keys), name)
    every = df.select(*keys).distinct().join(runs, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left")
    return every.select(*keys, F.coalesce(name, F.lit(0)).alias(name))


def ordinal_percentile(partition: list[str], value: str, name: str) -> Column:
    """0-based position by value, then name, over n - 1; 0 of one row."""
    w = Window.partitionBy(*partition)
    n = F.count("*").over(w)
    return F.when(n > 1, (F.row_number().over(w.orderBy(value, name)) - 1) / (n - 1)).otherwise(0.0)


def cusum(df: DataFrame, keys: list[str], order: str | list[str], value: str, slack: float, name: str = "cusum") -> DataFrame:
    """Adds S_i = max(0, S_(i-1) + max(0, x_i) - slack), from prefix sums less their least so far."""
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    p = df.withColumn("__p", F.sum(F.greatest(F.lit(0.0), F.col(value)) - slack).over(by))
    return p.withColumn(name, F.col("__p") - F.least(F.lit(0.0), F.min("__p").over(by))).drop("__p")


def tied_rank(partition: list[str], value: str, ascending: bool = False) -> Column:
    """1 + how many are better + half of how many others tie."""
    order = F.col(value).asc() if ascending else F.col(value).desc()
    return F.rank().over(Window.partitionBy(*partition).orderBy(order)) + (F.count("*").over(Window.partitionBy(*partition, value)) - 1) / 2


def tied_percentile(partition: list[str], value: str, single: float = 0.0) -> Column:
    """Average 0-based rank among ties over n - 1; of one row: `single`."""
    n = F.count("*").over(Window.partitionBy(*partition))
    return F.when(n > 1, (tied_rank(partition, value, ascending=True) - 1) / (n - 1)).otherwise(float(single))


def hash_fraction(*parts: str | Column) -> Column:
    """First 52 bits of the SHA-256 of the parts joined by ':' as a fraction in [0, 1)."""
    joined = F.concat_ws(":", *(col(p) if isinstance(p, Column) else F.col(p) for p in parts))
    return F.conv(F.substring(F.sha2(joined, 256), 1, 13), 16, 10).cast("long") / float(1 << 52)


def digest_mod(text: Column, m_of_digits: int = 5) -> Column:
    """SHA-256 of the text, as a 256-bit number, mod 5 (or any divisor of 15): as 16 = 1 mod 15, that of its digit sum."""
    assert 15 % m_of_digits == 0
    d = F.filter(F.split(F.sha2(text, 256), ""), lambda x: x != "")
    return F.aggregate(d, F.lit(0).cast("long"), lambda a, x: a + F.conv(x, 16, 10).cast("long")) % m_of_digits


def wilson(successes: str | Column, n: str | Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Low and high end of Wilson's interval; 0 and 0 of nothing."""
    s, n = col(successes), col(n)
    p = s / n
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(0.0)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: list[float], name: str = "quantiles", buckets: int = 256) -> DataFrame:
    """keys and an array of linearly interpolated quantiles, as percentile() gives them, without a group's values in one task.

    Equal values are counted first, in each task and then over all. Places that cut a group's distinct values into about
    `buckets` parts come from a sketch, so that a part of a group, not the group, is what one task sorts; the counts of the parts
    before it say which ranks it holds. The result doesn't depend on how good the places are. Nulls are left out; a group of
    nulls alone has no row. df is read twice.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    at = [i / buckets for i in range(1, buckets)]
    places = counts.groupBy(*keys).agg(F.percentile_approx("__v", at, 4 * buckets).alias("__places")).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.array_distinct("__places").alias("__places"))
    same = lambda p: [F.col(k).eqNullSafe(F.col(f"{p}{i}")) for i, k in enumerate(keys)]
    b = counts.join(places, same("__k")) if keys else counts.crossJoin(places)  # one row of places where there are no keys
    b = b.withColumn("__b", F.size(F.filter("__places", lambda x: x < F.col("__v")))).drop("__places", *(f"__k{i}" for i in range(len(keys))))
    sizes = b.groupBy(*keys, "__b").agg(F.sum("__c").alias("__s"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__s").over(whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__n", F.sum("__s").over(whole))  # buckets rows a group
    # the two ranks, counted from 0, between which each quantile lies; only parts that hold one are sorted
    ranks = F.array(*(F.struct(F.lit(i).alias("i"), F.floor((F.col("__n") - 1) * q + side).alias("rank"), F.lit(side).alias("side")) for i, q in enumerate(quantiles) for side in (0, 1)))
    asked = sizes.withColumn("__r", F.explode(ranks)).withColumn("__rank", F.least(F.col("__r.rank"), F.col("__n") - 1))
    asked = asked.filter((F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__before") + F.col("__s")))
    held = asked.groupBy(*keys, "__b", "__before", "__n").agg(F.collect_list(F.struct("__r.i", "__r.side", "__rank")).alias("__asked"))
    held = held.select(*(F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)), F.col("__b").alias("__hb"), "__before", "__n", "__asked")
    part = b.join(held, [*same("__h"), F.col("__b") == F.col("__hb")])
    up = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("__to", F.col("__before") + F.sum("__c").over(up)).withColumn("__from", F.col("__to") - F.col("__c"))
    hit = part.withColumn("__a", F.explode("__asked")).filter((F.col("__a.__rank") >= F.col("__from")) & (F.col("__a.__rank") < F.col("__to")))
    pick = lambda i, side: F.max(F.when((F.col("__a.i") == i) & (F.col("__a.side") == side), F.col("__v")))
    g = hit.groupBy(*keys).agg(F.max("__n").alias("__n"), *(pick(i, side).alias(f"__q{i}{side}") for i in range(len(quantiles)) for side in (0, 1)))

    def between(i: int, q: float) -> Column:
        w = (F.col("__n") - 1) * q - F.floor((F.col("__n") - 1) * q)
        low, high = F.col(f"__q{i}0"), F.col(f"__q{i}1")
        return F.when(w == 0, low).otherwise((1 - w) * low + w * high)

    return g.select(*keys, F.array(*(between(i, q) for i, q in enumerate(quantiles))).alias(name))
