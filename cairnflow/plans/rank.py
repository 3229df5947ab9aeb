"""Places in a global order without a single task that sees all rows, and a set of queries against all rows in blocks."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import durable


def global_rank(rows: DataFrame, order: list[Column], place: str, total: str) -> DataFrame:
    """rows with their place (1, 2, ...) by order and the number of all rows: sorted by range, ranked within ranges, moved by what
    the ranges before hold. The order must tell all rows apart."""
    dealt = durable(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    every = W.orderBy("_part")  # over ranges, not rows
    counts = counts.select("_part", (F.sum("_n").over(every) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy()).alias(total))
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    ranked = dealt.join(F.broadcast(counts), "_part").withColumn(place, within + F.col("_before"))
    return durable(ranked.select(*rows.columns, place, total))


def against_all(requests: DataFrame, items: DataFrame, block: int = 10_000, key: str = "user_id") -> DataFrame:
    """Every request with every item, in blocks: the requests of a block, about `block` by a hash of their key, are broadcast to the items, so
    what is sent is bounded however many requests there are."""
    blocks = max(1, math.ceil(requests.count() / block))
    parts = [items.join(F.broadcast(requests.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)), F.lit(True)) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def first_of_each(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among their row's first k by score, ties to the smaller id; in order of rows."""
    order = np.lexsort((ids, -score, row))
    sorted_ = row[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_, sorted_) < k]
