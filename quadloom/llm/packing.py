"""Items packed into containers of fixed capacity with little unused space, split only if longer than a container.

Sizes are counted once and written; then only (id, size) pairs move. Items over capacity are cut into full containers and a rest. The other items go by
hash into shards of about `shard_rows` items, and each shard is packed by best-two-fit: a container is filled greedily with the largest items that fit;
then its smallest item is replaced by the two unpacked items that fit the expanded gap most tightly, if they fill it better. A shard leaves at most a few
loose containers, so the unused space does not grow with the number of shards but as 1 in shard_rows.

Defined results: an item of size 0 or with a NULL text lies in the first container of its shard; ties are resolved by id; repeated ids are separate items
only if the caller's ids are unique (the packing assumes unique ids); an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quadloom.session import BROADCAST_ROWS, cut


def best_two_fit(sizes: np.ndarray, capacity: int) -> list[int]:
    """The bin number of each item; all sizes lie in 0..capacity."""
    place, stock = [0] * len(sizes), defaultdict(list)
    for i in range(len(sizes) - 1, -1, -1):
        if sizes[i] > 0:
            stock[int(sizes[i])].append(i)
    left = np.zeros(capacity + 1, np.int64)
    for s, items in stock.items():
        left[s] = len(items)
    idx = np.arange(capacity + 1)
    floor = np.maximum.accumulate(np.where(left > 0, idx, 0))  # largest size in stock up to each size

    def take(s: int) -> None:
        nonlocal floor
        left[s] -= 1
        if not left[s]:
            below, end = floor[s - 1], s
            while end <= capacity and floor[end] == s:
                end += 1 if end + 64 > capacity or floor[end + 64] != s else 64
            floor[s:end] = below

    def give(s: int) -> None:
        left[s] += 1
        if left[s] == 1:
            np.maximum(floor[s:], s, out=floor[s:])

    number = 0
    while floor[capacity]:
        content, gap = [], capacity
        while gap and (s := int(floor[gap])):
            content.append(s)
            take(s)
            gap -= s
        if gap and floor[capacity] and content:
            small, room = content[-1], gap + content[-1]
            first = np.flatnonzero(left[1 : room + 1]) + 1
            second = floor[room - first]
            same = (second == first) & (left[first] < 2)
            second[same] = floor[np.maximum(first[same] - 1, 0)]
            total = np.where(second > 0, first + second, 0)
            if len(total) and (best := int(total.argmax())) >= 0 and total[best] > small:
                give(small)
                content[-1:] = [int(first[best]), int(second[best])]
                take(content[-2])
                take(content[-1])
        for s in content:
            place[stock[s].pop()] = number
        number += 1
    return place


def pack(sized: DataFrame, specs: DataFrame, id_col: str, size_col: str, spec_col: str, capacity_col: str, shard_rows: int = 20_000) -> DataFrame:
    """(spec, id, piece, first_token, tokens, container, container_tokens): every item once per spec, pieces of split items in order.

    specs is a table of container kinds; each item is packed once for each. It is copied to the executors up to BROADCAST_ROWS kinds.
    """
    items = cut(sized.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("bigint").alias("size")))
    shards = max(1, -(-items.count() // shard_rows))
    kinds = specs.where(F.col(capacity_col) > 0).select(F.col(spec_col).alias("spec"), F.col(capacity_col).cast("bigint").alias("capacity"))
    small = kinds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    each = items.join(F.broadcast(kinds) if small else kinds)  # the result has a row per item and kind
    full = each.where("size > capacity").select("spec", "capacity", "id", F.explode(F.sequence(F.lit(1), F.expr("(size - 1) div capacity").cast("int"))).alias("piece"))
    full = full.select("spec", "id", "piece", ((F.col("piece") - 1) * F.col("capacity")).alias("first_token"), F.col("capacity").alias("tokens"), F.concat_ws("-", "spec", F.lit("full"), "id", "piece").alias("container"), F.col("capacity").alias("container_tokens"))
    before = F.expr("cast(if(size > capacity, (size - 1) div capacity, 0) as int)")
    rest = each.withColumn("before", before).select(
        "spec", "capacity", "id", (F.col("before") + 1).alias("piece"), (F.col("before") * F.col("capacity")).alias("first_token"), (F.col("size") - F.col("before") * F.col("capacity")).alias("tokens")
    )
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        place = pd.Series(best_two_fit(pdf["tokens"].to_numpy(), int(pdf["capacity"].iloc[0])), index=pdf.index)
        spec, shard = pdf["spec"].iloc[0], pdf["shard"].iloc[0]
        return pdf.assign(container=[f"{spec}-{shard}-{b}" for b in place], container_tokens=pdf.groupby(place)["tokens"].transform("sum"))[out]

    kind, key = specs.schema[spec_col].dataType.simpleString(), sized.schema[id_col].dataType.simpleString()
    out = ["spec", "id", "piece", "first_token", "tokens", "container", "container_tokens"]
    packed = rest.groupBy("spec", "shard").applyInPandas(one, f"spec {kind}, id {key}, piece int, first_token bigint, tokens bigint, container string, container_tokens bigint")
    return packed.unionByName(full).withColumnsRenamed({"spec": spec_col, "id": id_col})
