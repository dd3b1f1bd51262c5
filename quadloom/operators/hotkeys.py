"""Per-key results where a few keys hold most rows: counts, distinct values and exact quantiles without a task per key.

Counts and exact quantiles come from one distributed selection. Its first round makes, in one pass, a histogram of mergeable counts per key: 64 bins to
every power of two of the value, each with its count, smallest and largest value, combined before the shuffle. The rows of a key are the sum of its
bins; the bin that holds a wanted rank is the range still possible for it. Only the rows in such ranges are kept (written once), and each further
round divides a range into at most `bins` bins and keeps the rows of the bin with the rank, until a range holds one value. Values of a key are never
gathered, a hot key's rows stay spread as they were read, and no task gets more than the bins of one key at a time. Counts of distinct values are
made from one row per (key, column, value), which hashing spreads however hot the key is.

Defined results: rows with a NULL key form the key NULL; NULL values count as statements but neither as distinct values nor for quantiles; a
quantile is the smallest value whose cumulative count reaches ceil(q * n) (at least 1), NULL where a key has no value; values over the whole range of
BIGINT are exact; ties and repeated rows count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quadloom.session import BROADCAST_ROWS, cut


def distinct_counts(df: DataFrame, key: Column, distinct: dict[str, Column]) -> DataFrame:
    """(key, n_<name> for each distinct column): two-step counts, the first over (key, column, value)."""
    names = list(distinct)
    rows = df.select(key.alias("key"), *[distinct[n].alias(n) for n in names])
    parts = [rows.select("key", F.col(n).alias("v")).distinct().groupBy("key").agg(F.count("v").alias(f"n_{n}")) for n in names]
    out = parts[0]
    for part in parts[1:]:
        part = part.withColumnRenamed("key", "k2")
        out = out.join(part, F.col("key").eqNullSafe(F.col("k2"))).drop("k2")
    return out


def _first_round(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, c, n, vmin, vmax): the count of rows and of values, and the value range of every bin of every key; NULL values form a bin of their own."""
    rows = df.select(key.alias("key"), value.cast("bigint").alias("v"))
    size = F.when(F.col("v") < 0, F.expr("~v")).otherwise(F.col("v"))  # grows with the distance from 0 and can't overflow
    rows = rows.select("key", "v", (F.col("v") < 0).alias("below"), size.alias("size"))
    rows = rows.withColumn("e", F.floor(F.log2(F.col("size").cast("double") + 1)).cast("int")).withColumn("part", F.expr("shiftright(size, greatest(0, e - 6))"))
    return rows.groupBy("key", "below", "e", "part").agg(F.count(F.lit(1)).alias("c"), F.count("v").alias("n"), F.min("v").alias("vmin"), F.max("v").alias("vmax"))


def exact_quantiles(df: DataFrame, key: Column, value: Column, quantiles: list[float], bins: int = 1024, salts: int = 64) -> DataFrame:
    """(key, n_rows, n_values, q array<bigint>): the rows of each key and exact quantiles of a BIGINT value, in the order asked for."""
    hist = cut(_first_round(df, key, value))  # at most 64 bins for each sign and power of two of a key
    totals = hist.groupBy("key").agg(F.sum("c").alias("n_rows"), F.sum("n").alias("n_values"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(q).cast("double").alias("q")) for i, q in enumerate(quantiles)])
    ranks = totals.where("n_values > 0").select("key", F.explode(wanted).alias("w"), F.greatest(F.lit(1), F.ceil(F.col("w.q") * F.col("n_values"))).cast("bigint").alias("rank"))
    state, solved = _narrow(ranks.select("key", F.col("w.i").alias("i"), "rank"), hist.where("n > 0").drop("c").withColumnRenamed("n", "c"), ["key"]), []
    rows = df.select(key.alias("key"), value.cast("bigint").alias("v")).where("v is not null")
    while True:
        state = cut(state)
        solved.append(state.where("lo = hi"))
        state = state.where("lo < hi")
        targets = state.count()
        if not targets:
            break
        ranges = state.select("key", "lo", "hi").distinct()  # one histogram for all ranks of a key that share a range; ranges of a key are disjoint
        rows = cut(_within(rows, ranges, targets, salts))
        bin_ = F.expr(f"(v - lo) div ((hi - lo) div {bins} + 1)")  # a range lies within one power of two: no overflow
        hist = rows.groupBy("key", "lo", "hi", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("vmin"), F.max("v").alias("vmax"))
        state = _narrow(state, hist, ["key", "lo", "hi"])
        rows = rows.select("key", "v")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "lo"))), lambda x: x["lo"])  # one per wanted quantile
    found = reduce(DataFrame.unionByName, solved).groupBy(F.col("key").alias("k2")).agg(ordered.alias("q"))
    return totals.join(found, F.col("key").eqNullSafe(F.col("k2")), "left").select("key", "n_rows", "n_values", "q")


def _narrow(state: DataFrame, hist: DataFrame, group: list[str]) -> DataFrame:
    """(key, i, rank, lo, hi): for each wanted rank the bin that holds it, as the range from its smallest to its largest value, and the rank within it."""
    upto = W.partitionBy(*group).orderBy("vmin")
    hist = hist.withColumn("upto", F.sum("c").over(upto)).select(*[F.col(c).alias(f"{c}2") for c in group], "c", "upto", "vmin", "vmax")
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}2")) for c in group])
    hit = state.join(hist, on & (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("c")))
    return hit.select("key", "i", (F.col("rank") - (F.col("upto") - F.col("c"))).alias("rank"), F.col("vmin").alias("lo"), F.col("vmax").alias("hi"))


def _within(rows: DataFrame, ranges: DataFrame, n: int, salts: int) -> DataFrame:
    """(key, v, lo, hi): the rows that lie in one of the ranges."""
    ranges = ranges.withColumnRenamed("key", "k2")
    on = F.col("key").eqNullSafe(F.col("k2")) & F.col("v").between(F.col("lo"), F.col("hi"))
    if n <= BROADCAST_ROWS:
        hit = rows.join(F.broadcast(ranges), on)
    else:  # too many open ranges to copy to every executor: spread each key over salts
        salted = ranges.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        hit = rows.withColumn("s2", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(salted, on & (F.col("s2") == F.col("salt")))
    return hit.select("key", "v", "lo", "hi")


def with_shares(counts: DataFrame) -> DataFrame:
    """counts with the share of all rows that each key holds."""
    total = counts.agg(F.sum("n_rows").alias("all_rows"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n_rows") / F.col("all_rows")).drop("all_rows")  # total is one row


def hot_key_report(df: DataFrame, key: Column, distinct: dict[str, Column], value: Column, quantiles: list[float], bins: int = 1024) -> DataFrame:
    """One row per key: n_rows, share of all rows, n_values, the exact quantiles `q` of value, and the distinct counts."""
    out = with_shares(exact_quantiles(df, key, value, quantiles, bins))
    if not distinct:
        return out
    counts = distinct_counts(df, key, distinct).withColumnRenamed("key", "k2")
    return out.join(counts, F.col("key").eqNullSafe(F.col("k2"))).drop("k2")
