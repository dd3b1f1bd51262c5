"""Records of several sources mixed to target shares of the total size, small sources repeated up to a cap.

Weighted fair queueing: within its source each record stands in a shuffled order (a hash of its id) and gets a virtual finish time, the source's tokens
up to and including it divided by the source's weight; the k-th repetition of a source follows its (k-1)-th. Sorted by finish time, any beginning of the
queue holds the sources in their target shares, and the collection is the beginning that the total budget admits.

Running totals are distributed: records lie in buckets by a monotone function of their order, the buckets' totals give each bucket its start, and only
within a bucket are records summed one after another. The starts come from totals of blocks of buckets likewise, so that one task sums a row per twenty
million records. No source and no total is summed in one task. Only repetitions that can finish within the budget are made.

Defined results: records with a NULL source or a source without target are left out; sources without records keep a row with zero in the report, and the
others' weights are scaled up to 1; NULL and empty texts have size 0 and follow the same order; without a given budget the largest one is taken at which
every source with records still reaches its share within its repeats; ties are resolved by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from quadloom.session import cut, spread


#: Targets up to which they are copied to every executor; beyond it their joins shuffle.
MAX_TARGETS = 10_000
BUCKET_ROWS, BLOCK_BUCKETS = 20_000, 1_000


def _starts(totals: DataFrame, group: list[str], bucket: str, block: int | None) -> DataFrame:
    """totals (group, bucket, __t) with the sum of the buckets before each as __start; buckets are summed by blocks, and within a block one after another."""
    before = lambda *by: F.coalesce(F.sum("__t").over(W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if block is None:
        return totals.withColumn("__start", before(*group)).drop("__t")
    totals = totals.withColumn("__block", F.floor(F.col(bucket) / block))
    blocks = _starts(totals.groupBy(*group, F.col("__block").alias("__b2")).agg(F.sum("__t").alias("__t")), group, "__b2", None)
    blocks = blocks.select(*[F.col(c).alias(f"{c}2") for c in group], "__b2", F.col("__start").alias("__s2"))
    on = F.col("__block") == F.col("__b2")
    for c in group:
        on = on & (F.col(c) == F.col(f"{c}2"))
    return totals.withColumn("__start", before(*group, "__block")).join(blocks, on).select(*group, bucket, (F.col("__start") + F.col("__s2")).alias("__start"))


def _running(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """df with the running total of value per group in the order of (bucket, order); no task gets more than one bucket."""
    starts = _starts(df.groupBy(*group, bucket).agg(F.sum(value).alias("__t")), group, bucket, BLOCK_BUCKETS)  # one row per bucket
    inside = W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.join(starts, [*group, bucket]).withColumn(out, F.col("__start") + F.sum(value).over(inside)).drop("__start")


def mix(sized: DataFrame, targets: DataFrame, id_col: str, source_col: str, size_col: str, weight_col: str, repeats_col: str, budget: int | None = None, seed: int = 7) -> DataFrame:
    """(id, source, repeat, tokens, finish, running_tokens): the collection in its order of finish; targets has a row per source."""
    spark = sized.sparkSession
    small = targets.limit(MAX_TARGETS + 1).count() <= MAX_TARGETS
    copied = lambda x: F.broadcast(x) if small else x
    goals = targets.where(f"{weight_col} > 0 and {source_col} is not null").select(F.col(source_col).alias("source"), F.col(weight_col).cast("double").alias("weight"), F.greatest(F.col(repeats_col), F.lit(1)).alias("repeats"))
    rows = sized.where(F.col(source_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("bigint").alias("tokens"))
    rows = cut(rows.join(copied(goals.select("source")), "source", "left_semi"))
    sums = rows.groupBy("source").agg(F.sum("tokens").alias("all_tokens"), F.count(F.lit(1)).alias("n"))
    known = cut(sums.join(goals, "source").where("all_tokens > 0"))
    plan = known.agg(F.sum("weight").alias("w"), F.min(F.expr("all_tokens * repeats / weight")).alias("most"), F.sum("n").alias("n")).first()
    if plan["w"] is None:
        kind = sized.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"id {kind}, source string, repeat int, tokens bigint, finish double, running_tokens bigint")
    most = int(plan["most"] * plan["w"]) if budget is None else int(budget)
    buckets = max(spread(spark), plan["n"] // BUCKET_ROWS + 1)
    order = F.xxhash64(F.col("id"), F.lit(seed))
    rows = rows.withColumns({"__o": order, "__b": F.floor((order.cast("double") / 2.0**64 + 0.5) * buckets)})
    queue = _running(rows, ["source"], "__b", ["__o", "id"], "tokens", "__upto").join(copied(known), "source")
    share, latest = F.col("weight") / plan["w"], most * 1.0 + 1
    rounds = F.floor((latest * share - F.col("__upto")) / F.col("all_tokens")) + 2  # one to spare for rounding; the exact test follows
    queue = queue.withColumn("__n", F.least(F.col("repeats").cast("bigint"), rounds).cast("int")).where("__n >= 1").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    queue = queue.withColumn("finish", (F.col("__upto") + (F.col("repeat") - 1) * F.col("all_tokens")) / share).where(F.col("finish") <= latest)
    queue = queue.withColumn("__q", F.floor(F.col("finish") / (most + 2) * buckets)).select("id", "source", "repeat", "tokens", "finish", "__q")
    queue = _running(queue, [], "__q", ["finish", "source", "id", "repeat"], "tokens", "running_tokens")
    return queue.where(F.col("running_tokens") <= most).drop("__q").select("id", "source", "repeat", "tokens", "finish", "running_tokens")


def shares(mixed: DataFrame, targets: DataFrame, source_col: str, weight_col: str) -> DataFrame:
    """(source, target_weight, records, max_repeat, tokens, share): the actual shares of the collection, for every target."""
    per = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.max("repeat").alias("max_repeat"), F.sum("tokens").alias("tokens"))
    total = per.agg(F.sum("tokens").alias("__all"))
    goals = targets.select(F.col(source_col).alias("source"), F.col(weight_col).alias("target_weight"))
    out = goals.join(per, "source", "left").crossJoin(total)  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("source", "target_weight", zero("records"), zero("max_repeat"), zero("tokens"), F.coalesce(F.col("tokens") / F.col("__all"), F.lit(0.0)).alias("share"))
