"""The seeded holdout of each user's positives, and evaluation samples: uniform, by activity, by the popularity of what is held out."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import durable
from ..plans.views import RATINGS, SPLIT, STATS, run_sql

LEAST, SEED = 5, 42


def holdout_counts(n: Column, least: int = LEAST) -> tuple[Column, Column]:
    """validation and test sizes of a user with n positives."""
    tenth = F.floor(n / 10)
    return F.when(n < least, 0).when(n < 20, 1).otherwise(tenth).cast("int"), F.when(n < least, 0).when(n < 10, 1).when(n < 20, 2).otherwise(tenth).cast("int")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _shuffled(user: pd.Series, n: pd.Series, seed: pd.Series) -> pd.Series:
    """A permutation of 0..n-1 by the Mersenne generator, seeded by a digest of seed and user."""
    out = []
    for u, k, s in zip(user, n, seed, strict=True):
        places = list(range(k))
        random.Random(int.from_bytes(hashlib.blake2b(f"{s}:{u}".encode(), digest_size=8).digest(), "little")).shuffle(places)
        out.append(places)
    return pd.Series(out)


def mersenne_split(positives: DataFrame, seed: int = SEED, least: int = LEAST) -> DataFrame:
    """Positives (user_id, item_id, rating) -> with fold. A user's positives in the order of item and rating are shuffled by the user's own
    seed; the first go to validation, the next to test. Only the number of a user's positives goes to Python, in 4-byte places;
    the rows themselves are numbered and joined here, so neither their order nor their partitions matter."""
    numbered = positives.withColumn("_i", F.row_number().over(W.partitionBy("user_id").orderBy("item_id", "rating")) - 1)
    users = positives.groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    v, t = holdout_counts(F.col("n"), least)
    users = users.withColumns({"v": v, "t": t})
    held = users.where("v > 0").withColumn("p", _shuffled("user_id", "n", F.lit(seed))).select("user_id", F.slice("p", F.lit(1), F.col("v") + F.col("t")).alias("p"), "v")
    held = held.select("user_id", "v", F.posexplode("p").alias("k", "_i")).select("user_id", "_i", F.when(F.col("k") < F.col("v"), "validation").otherwise("test").alias("fold"))
    return numbered.join(held, ["user_id", "_i"], "left").withColumn("fold", F.coalesce("fold", F.lit("train"))).drop("_i")


@F.pandas_udf(T.BinaryType())
def _digest(x: pd.Series) -> pd.Series:
    return x.map(lambda s: hashlib.blake2b(s.encode(), digest_size=8).digest())


def _key(*parts: Column | str) -> Column:
    return _digest(F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(p) for p in parts)))


def _first(rows: DataFrame, n: int, *parts: str) -> DataFrame:
    """The n users that come first by a digest of the parts and the user; a sort with a limit, so tasks keep n rows each."""
    return rows.select("user_id").orderBy(_key(*parts, F.col("user_id").cast("string")), "user_id").limit(n)


def uniform_sample(users: DataFrame, limit: int | None, seed: int = SEED) -> DataFrame:
    """`limit` of the users (user_id), or all."""
    return users.select("user_id") if not limit or limit <= 0 else _first(users, limit, "sample", str(seed))


def _targets(limit: int | None, per_stratum: int | None, names: tuple[str, ...]) -> dict[str, int | None]:
    if per_stratum is not None:
        if per_stratum < 1:
            raise ValueError("a stratum needs at least one user")
        return dict.fromkeys(names, per_stratum)
    if not limit or limit <= 0:
        return dict.fromkeys(names)
    return {s: limit // 3 + (i < limit % 3) for i, s in enumerate(names)}


def activity_sample(activity: DataFrame, limit: int | None = None, per_stratum: int | None = None, seed: int = SEED) -> DataFrame:
    """Activity (user_id, n: training positives) -> user_id, stratum: sparse to 4, medium to 19, heavy."""
    rows = activity.select("user_id", F.when(F.col("n") <= 4, "sparse").when(F.col("n") <= 19, "medium").otherwise("heavy").alias("stratum"))
    out = None
    for s, n in _targets(limit, per_stratum, ("sparse", "medium", "heavy")).items():
        own = rows.where(F.col("stratum") == s)
        part = (own.select("user_id") if n is None else _first(own, n, "sample", str(seed))).withColumn("stratum", F.lit(s))
        out = part if out is None else out.unionByName(part)
    return out


def popularity_sample(held: DataFrame, buckets: DataFrame, limit: int | None = None, per_stratum: int | None = None, seed: int = SEED) -> DataFrame:
    """Held (user_id, item_id: test positives), buckets (item_id, bucket: head, mid, tail) -> user_id, stratum: what the user was chosen for.

    Greedy from the rarest target: tail users first; a user counts for every bucket that holds one of the user's items, so later strata need
    only what the users chosen before don't already give."""
    names = ("head", "mid", "tail")
    member = durable(held.join(buckets.where(F.col("bucket").isin(*names)), "item_id").select("user_id", "bucket").distinct())
    targets = _targets(limit, per_stratum, names)
    chosen = member.sparkSession.createDataFrame([], "user_id long, stratum string")
    for s in reversed(names):
        own = member.where(F.col("bucket") == s).select("user_id")
        credit = own.join(chosen, "user_id", "left_semi").count()
        n = max(0, (own.count() if targets[s] is None else targets[s]) - credit)
        new = _first(own.join(chosen, "user_id", "left_anti"), n, "sample", str(seed), "popularity", s).withColumn("stratum", F.lit(s))
        chosen = durable(chosen.unionByName(new))
    return chosen


def _positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"WITH {RATINGS}, {SPLIT} SELECT user_id, item_id, rating FROM ratings WHERE rating >= 8")


def mersenne_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mersenne_split(_positives(spark, sf_dir))


def activity_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    activity = run_sql(spark, sf_dir, f"WITH {RATINGS}, {SPLIT} SELECT user_id, count_if(fold = 'train') AS n FROM split GROUP BY user_id HAVING count_if(fold = 'test') > 0")
    return activity_sample(activity, per_stratum=50)


def popularity_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = run_sql(spark, sf_dir, f"WITH {RATINGS}, {SPLIT} SELECT user_id, item_id FROM split WHERE fold = 'test'")
    return popularity_sample(held, run_sql(spark, sf_dir, f"WITH {RATINGS}, {SPLIT}, {STATS} SELECT item_id, bucket FROM bucketed"), per_stratum=100)


_F = (mersenne_holdout, activity_stratum, popularity_stratum)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _F}
