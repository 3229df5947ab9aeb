"""Learned reranking of candidate lists: eighteen features, a scaled linear model, boosted trees on lambda gradients, and their serving.

Everything that grows with users or items stays distributed: features are joins and sums per (user, item), the linear model is Spark's
weighted logistic regression, and trees are grown level by level from histograms that partitions sum (nodes x features x bins numbers reach
the driver). A user's list holds at most CANDIDATES rows, so a list is the unit that one task sees whole."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import batches_by_rows, durable, shuffles_dropped, whole_users
from ..plans.views import CATALOG, RATINGS, SPLIT, STATS, fact, run_sql
from ..sources.artifacts import publish, published
from .catalogue import _FOLDS, _PARTS
from .neighbours import MOST_PAIRS, NEIGHBOURS, best_by_votes, bounds_of, by_block, dealt, near_to, neighbour_lists, range_of, seen_items, training_likes, unpacked, waves

#: The features in the order in which models hold them.
FEATURES = (
    "als_score", "als_score_z", "als_rank_recip", "genre_affinity", "genre_coverage", "genre_jaccard_max", "studio_affinity", "source_affinity", "type_affinity",
    "year_gap", "year_close", "item_item_max", "item_item_sum5", "log_train_pop", "log_train_ratings", "train_rating_mean", "train_bayes", "profile_size",
)
CANDIDATES, NEAREST = 300, 5
_KNOWN = ("log_train_pop", "log_train_ratings", "train_rating_mean", "train_bayes")


def rerank_features(candidates: DataFrame, profiles: DataFrame, items: DataFrame, neighbours: DataFrame, stats: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """M17. candidates (user_id, item_id, score, and the columns of extra), profiles (user_id, item_id: training positives), items (item_id, genres, studios:
    arrays without repeats; source, type, year), neighbours (item_id, neighbor_id, score), stats (item_id, positives, ratings, mean, bayes, global_mean)
    -> user_id, item_id, extra and the features. Missing items and statistics count as empty and 0; a year of 0 or null is unknown; ties of
    score go to the smaller item. Users without a profile get zeros for what compares with it.

    neighbours may also be lists as of `neighbour_lists`. A range of users gets its lists and profiles, and once each the facts of the items in them and the
    lists of items that a profile's item is a neighbour of, so no pair of a candidate and a profile's item is shuffled and what is shuffled at once is bounded."""
    spark, held, none = candidates.sparkSession, profiles.select(F.col("user_id").cast("long"), F.col("item_id").cast("long")).distinct(), F.array().cast("array<string>")
    kept = {"genres": F.coalesce("genres", none), "studios": F.coalesce("studios", none), "source": F.coalesce("source", F.lit("")), "type": F.coalesce("type", F.lit("")), "year": F.coalesce("year", F.lit(0)).cast("int")}
    facts = items.select("item_id", "genres", "studios", "source", "type", "year")
    known = stats.select("item_id", F.log1p("positives").alias("log_train_pop"), F.log1p("ratings").alias("log_train_ratings"), (F.col("mean") - F.col("global_mean")).alias("train_rating_mean"), (F.col("bayes") - F.col("global_mean")).alias("train_bayes"))
    kept |= {c: F.to_json(kept[c]) for c in ("genres", "studios")}  # Spark's Arrow writer goes through all rows before at every null array
    told, near = durable(facts.join(known, "item_id", "full_outer").withColumns(kept)), near_to(neighbours)
    kept = {c: F.coalesce(c, F.lit(0 if c == "year" else "" if c in ("source", "type") else "[]")) for c in kept}
    types = dict(candidates.dtypes)
    given = durable(candidates.select(F.col("user_id").cast("long"), F.col("item_id").cast("long"), F.col("score").cast("double"), *extra))
    total, cores = given.count(), spark.sparkContext.defaultParallelism
    number = range_of(bounds_of(given, "user_id", math.ceil(total / max(1, min(ROWS, total // (3 * cores))))))
    given = given.withColumn("block", number("user_id"))
    held = durable(held.join(given.select("user_id").distinct(), "user_id", "left_semi").withColumn("block", number("user_id")))
    asked = durable(held.select("block", "item_id").distinct())
    every = durable(given.select("block", "item_id").distinct().unionByName(asked).distinct())
    sizes = {r[0]: r[1] * NEIGHBOURS for r in asked.groupBy("block").agg(F.count(F.lit(1))).collect()}  # a number a block
    sizes = {r[0]: sizes.get(r[0], 0) + r[1] for r in given.groupBy("block").agg(F.count(F.lit(1))).collect()}
    folder = f"{spark.sparkContext.getCheckpointDir()}/rerank-features-{uuid.uuid4().hex}"
    schema = ", ".join(["user_id long", "item_id long", *(f"`{c}` {types[c]}" for c in extra), *(f"{c} double" for c in FEATURES)])
    columns = {"user_id": "long", "item_id": "long", "score": "double", **{c: types[c] for c in extra}, "n": "long", "others": "binary", "scores": "binary", "genres": "string", "studios": "string", "source": "string", "type": "string", "year": "int", **dict.fromkeys(_KNOWN, "double")}
    row = lambda df, kind: df.select("block", F.lit(kind).alias("kind"), *((F.col(c) if c in df.columns else F.lit(None).cast(t)).alias(f"_{c}") for c, t in columns.items()))
    spark.createDataFrame([], schema).write.parquet(folder)
    for wave in waves(sizes, MOST_PAIRS):
        with shuffles_dropped(spark), batches_by_rows(spark):
            mine = lambda df, wave=wave: df.where(F.col("block").between(wave[0], wave[1] - 1))
            described = mine(every).join(told, "item_id", "left").withColumns(kept)
            rows = reduce(DataFrame.unionByName, [row(mine(given), 0), row(mine(held), 1), row(near.join(F.broadcast(mine(asked)), "item_id"), 2), row(described, 3)])
            dealt(rows, wave).mapInArrow(_list_features(extra), schema).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


#: The most rows of lists of a block of users; users whose features a task computes together.
ROWS, TOGETHER = 1 << 20, 128


def _flat(*columns: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Columns of lists of strings -> for each, the row and the code of every element; equal strings have equal codes."""
    columns = [c.combine_chunks() for c in columns]
    codes = pa.concat_arrays([c.flatten() for c in columns]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    out, at = [], 0
    for c in columns:
        sizes = c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        out.append((np.repeat(np.arange(len(c)), sizes), codes[at : at + sizes.sum()]))
        at += sizes.sum()
    return out


def _compared(lists: pa.Table, own: pa.Table) -> dict[str, np.ndarray]:
    """Whole lists and their users' profiles, both in order of user and item -> the features of the lists' rows."""
    number = lambda t, c: t.column(c).to_numpy().astype(float)
    ids, item, score = lists.column("user_id").to_numpy(), lists.column("item_id").to_numpy(), number(lists, "score")
    users, first, n = np.unique(ids, return_index=True, return_counts=True)
    at, rows = np.repeat(np.arange(len(users)), n), len(ids)
    own = own.filter(pa.array(np.isin(own.column("user_id").to_numpy(), users)))
    mine = np.searchsorted(users, own.column("user_id").to_numpy())
    low, high = np.searchsorted(mine, np.arange(len(users))), np.searchsorted(mine, np.arange(len(users)), "right")
    apart = score - (np.add.reduceat(score, first) / n)[at]
    spread = np.sqrt(np.add.reduceat(apart * apart, first) / n)
    spread[np.maximum.reduceat(score, first) == np.minimum.reduceat(score, first)] = 0
    order, place = np.lexsort((item, -score, at)), np.empty(rows)
    place[order] = np.arange(rows) - first[at] + 1
    size = (high - low).astype(float)
    out = {c: np.zeros(rows) for c in FEATURES} | {"als_score": score, "als_score_z": apart / np.where(spread > 0, spread, 1.0)[at], "als_rank_recip": 1 / place, "profile_size": np.log1p(size)[at]}
    out |= {c: np.nan_to_num(lists.column(c).fill_null(0.0).to_numpy()) for c in _KNOWN}

    (row, code), (held, theirs) = _flat(lists.column("studios"), own.column("studios"))
    kinds = max(code.max(initial=0), theirs.max(initial=0)) + 1
    out["studio_affinity"][row[np.isin(at[row] * kinds + code, mine[held] * kinds + theirs)]] = 1.0
    for c in ("source", "type"):
        codes = pa.concat_arrays([lists.column(c).combine_chunks(), own.column(c).combine_chunks()]).dictionary_encode().indices.to_numpy().astype(np.int64)
        kinds = codes.max(initial=0) + 1
        found, times = np.unique(mine * kinds + codes[rows:], return_counts=True)
        if len(found):
            key = at * kinds + codes[:rows]
            k = np.minimum(np.searchsorted(found, key), len(found) - 1)
            out[f"{c}_affinity"] = np.where(found[k] == key, times[k], 0) / np.maximum(size, 1)[at]

    (row, code), (held, theirs) = _flat(lists.column("genres"), own.column("genres"))
    many, several = np.bincount(row, minlength=rows), np.bincount(held, minlength=len(mine))
    row_at, held_at = np.searchsorted(row, np.arange(rows + 1)), np.searchsorted(held, np.arange(len(mine) + 1))
    year, years, median = number(lists, "year"), number(own, "year"), np.zeros(len(users))
    near = own.column("near").combine_chunks()
    reach = np.concatenate([[0], np.cumsum(near.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int)
    near = near.flatten()
    near_item, near_score = near.field("item_id").to_numpy(zero_copy_only=False), near.field("score").to_numpy(zero_copy_only=False)
    seen, covered = np.zeros(rows), np.zeros(rows)
    for u in range(len(users)):
        a, b, c, d = first[u], first[u] + n[u], low[u], high[u]
        if c == d:
            continue
        if len(some := years[c:d][years[c:d] > 0]):
            median[u] = np.median(some)
        asked, had = code[row_at[a] : row_at[b]], theirs[held_at[c] : held_at[d]]
        names, numbers = np.unique(np.concatenate([asked, had]), return_inverse=True)
        has = np.zeros((b - a, len(names)))
        has[row[row_at[a] : row_at[b]] - a, numbers[: len(asked)]] = 1
        times = np.bincount(numbers[len(asked) :], minlength=len(names))
        seen[a:b], covered[a:b] = has @ times, has @ (times > 0)
        for c0 in range(c, d, 4096):  # of long profiles a part at a time
            d0 = min(d, c0 + 4096)
            theirs_has = np.zeros((d0 - c0, len(names)))
            theirs_has[held[held_at[c0] : held_at[d0]] - c0, numbers[len(asked) :][held_at[c0] - held_at[c] : held_at[d0] - held_at[c]]] = 1
            both = has @ theirs_has.T
            jaccard = both / np.maximum(many[a:b, None] + several[None, c0:d0] - both, 1)
            out["genre_jaccard_max"][a:b] = np.maximum(out["genre_jaccard_max"][a:b], jaccard.max(1))
        other, s = near_item[reach[c] : reach[d]], near_score[reach[c] : reach[d]]
        k = np.searchsorted(item[a:b], other)
        inside = np.flatnonzero(item[a:b][np.minimum(k, b - a - 1)] == other)
        if len(inside):
            inside = inside[np.lexsort((-s[inside], k[inside]))]
            k, s = k[inside], s[inside]
            nth = np.arange(len(k)) - np.searchsorted(k, k)
            out["item_item_max"][a + k[nth == 0]] = s[nth == 0]
            out["item_item_sum5"][a:b] = np.bincount(k[nth < NEAREST], s[nth < NEAREST], b - a)
    per = np.maximum(size, 1)[at]
    out["genre_affinity"], out["genre_coverage"] = seen / np.maximum(per * many, 1), covered / np.maximum(many, 1)
    gap = np.where((year > 0) & (median[at] > 0), np.abs(year - median[at]) / 10, 0.0)
    return out | {"year_gap": gap, "year_close": ((gap > 0) & (gap <= 0.5)).astype(float)}


def _list_features(extra: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A block's lists (kind 0), profiles (1), lists of items that a profile's item is a neighbour of (2) and facts of all items (3) -> features."""

    def placed(ids: np.ndarray, asked: np.ndarray, missing: int) -> np.ndarray:
        order = np.argsort(ids)
        at = np.minimum(np.searchsorted(ids[order], asked), len(ids) - 1)
        return np.where(ids[order[at]] == asked, order[at], missing) if len(ids) else np.full(len(asked), missing)

    def block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        kind, table = table.column("kind").to_numpy(), table.drop_columns(["block", "kind"])
        table = table.rename_columns([c[1:] for c in table.column_names])
        lists, own, near, told = (table.filter(pa.array(kind == x)) for x in range(4))
        ordered = lambda t: t.take(pa.array(np.lexsort((t.column("item_id").to_numpy(), t.column("user_id").to_numpy()))))
        lists, own = ordered(lists.select(["user_id", "item_id", "score", *extra])), ordered(own.select(["user_id", "item_id"]))
        facts = told.select(["item_id", "genres", "studios", "source", "type", "year", *_KNOWN]).combine_chunks()
        for c in ("genres", "studios"):
            facts = facts.set_column(facts.column_names.index(c), c, pa.array([json.loads(x) for x in facts.column(c).to_pylist()], pa.list_(pa.string())))
        fact_ids, near_ids = facts.column("item_id").to_numpy(), near.column("item_id").to_numpy()
        facts, n = facts.drop_columns(["item_id"]), near.column("n").to_numpy().astype(np.int64)
        entries = pa.StructArray.from_arrays([pa.array(unpacked(near.column("others"), np.int64)), pa.array(unpacked(near.column("scores"), float))], ["item_id", "score"])
        near = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum([*n.tolist(), 0])), pa.int64()), entries)  # the last is empty
        ids, who = lists.column("user_id").to_numpy(), own.column("user_id").to_numpy()
        first = np.unique(ids, return_index=True)[1]
        for a, b in zip(first[::TOGETHER], [*first[TOGETHER::TOGETHER], len(ids)], strict=True):
            some, c, d = lists.slice(a, b - a), np.searchsorted(who, ids[a]), np.searchsorted(who, ids[b - 1], "right")
            theirs = own.slice(c, d - c)
            with_facts = lambda t: [*t.columns, *facts.take(pa.array(placed(fact_ids, t.column("item_id").to_numpy(), 0))).columns]
            left = pa.table(with_facts(some), [*some.column_names, *facts.column_names])
            right = pa.table([*with_facts(theirs), near.take(pa.array(placed(near_ids, theirs.column("item_id").to_numpy(), len(n))))], [*theirs.column_names, *facts.column_names, "near"])
            out = _compared(left, right)
            columns = [some.column(c).combine_chunks() for c in ("user_id", "item_id", *extra)] + [pa.array(out[c]) for c in FEATURES]
            yield from pa.Table.from_arrays(columns, ["user_id", "item_id", *extra, *FEATURES]).to_batches(max_chunksize=1 << 16)

    return lambda batches: by_block(batches, block)


# ---- the linear model


@dataclass
class Linear:
    """Weights over scaled features."""

    features: tuple[str, ...]
    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float

    def score(self) -> Column:
        terms = [F.lit(w) * ((F.col(f"`{c}`") - F.lit(m)) / F.lit(s)) for c, m, s, w in zip(self.features, self.mean, self.scale, self.weights, strict=True)]
        return sum(terms, F.lit(self.bias))


def fit_scaler(rows: DataFrame, features: tuple[str, ...] = FEATURES) -> tuple[list[float], list[float]]:
    """Means and population deviations of features (1 where nothing varies), in one aggregate."""
    found = rows.agg(*(x for c in features for x in (F.avg(c), F.stddev_pop(c)))).first()
    return [float(found[2 * i] or 0) for i in range(len(features))], [float(d) if (d := found[2 * i + 1] or 0) >= 1e-6 else 1.0 for i in range(len(features))]


def fit_linear(rows: DataFrame, features: tuple[str, ...] = FEATURES, l2: float = 1.0) -> Linear:
    """rows (features, label 0 or 1) -> the optimum of the mean weighted logistic loss plus l2 / (2 rows) of the squared weights; positives weigh as
    much as negatives in all, weights have mean 1, the bias isn't penalised. Spark's solver sums gradients over partitions."""
    n, positive = rows.agg(F.count(F.lit(1)), F.avg("label")).first()
    if not n:
        raise ValueError("no rows to learn from")
    mean, scale = fit_scaler(rows, features)
    if not 0 < positive < 1:
        return Linear(features, mean, scale, [0.0] * len(features), 0.0)
    up = (1 - positive) / positive
    average = positive * up + (1 - positive)
    vector = array_to_vector(F.array(*((F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(features, mean, scale, strict=True))))
    train = rows.select(vector.alias("features"), F.col("label").cast("double").alias("label"), (F.when(F.col("label") > 0, up).otherwise(1.0) / average).alias("weight"))
    model = LogisticRegression(regParam=l2 / n, elasticNetParam=0.0, standardization=False, weightCol="weight", maxIter=200, tol=1e-9).fit(train)
    return Linear(features, mean, scale, [float(x) for x in model.coefficients], float(model.intercept))


# ---- boosted trees on lambda gradients


@dataclass
class Forest:
    """Trees over named features. A tree is a list of nodes (feature, threshold, left, right, value); feature -1 is a leaf; a row goes
    left if its feature is at most the threshold."""

    features: tuple[str, ...]
    trees: list[list[tuple[int, float, int, int, float]]] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for tree in self.trees:
            out += tree_values(tree, x)
        return out


def tree_values(tree: list[tuple[int, float, int, int, float]], x: np.ndarray) -> np.ndarray:
    feature, threshold, left, right, value = (np.array(c) for c in zip(*tree, strict=True))
    at = np.zeros(len(x), int)
    while len(open_ := np.flatnonzero(feature[at] >= 0)):
        node = at[open_]
        at[open_] = np.where(x[open_, feature[node]] <= threshold[node], left[node], right[node])
    return value[at]


def forest_column(forest: Forest) -> Column:
    """The forest's score as a column expression: JVM-side, for forests of up to some hundred nodes."""

    def node(tree, i: int) -> Column:
        f, threshold, left, right, value = tree[i]
        return F.lit(float(value)) if f < 0 else F.when(F.col(f"`{forest.features[f]}`") <= F.lit(float(threshold)), node(tree, left)).otherwise(node(tree, right))

    return sum((node(t, 0) for t in forest.trees), F.lit(0.0))


def forest_scores(rows: DataFrame, forest: Forest, name: str = "score") -> DataFrame:
    """rows with the forest's score; larger forests are walked in Arrow batches. Missing features are refused."""
    if lost := [c for c in forest.features if c not in rows.columns]:
        raise ValueError(f"the model needs features that aren't there: {', '.join(lost)}")
    if sum(map(len, forest.trees)) <= 200:
        return rows.withColumn(name, forest_column(forest))

    @F.pandas_udf("double")
    def walk(*columns: pd.Series) -> pd.Series:
        return pd.Series(forest.predict(np.column_stack([c.to_numpy(float) for c in columns])))

    return rows.withColumn(name, walk(*(F.col(f"`{c}`") for c in forest.features)))


def save_forest(spark: SparkSession, forest: Forest, path: str) -> str:
    """Publishes a forest as a table of nodes under a new version."""
    rows = [(t, i, *map(float, n)) for t, tree in enumerate(forest.trees) for i, n in enumerate(tree)]
    nodes = spark.createDataFrame(rows, "tree int, node int, feature double, threshold double, `left` double, `right` double, value double")
    return publish(nodes.withColumn("features", F.lit(json.dumps(forest.features))).coalesce(1), path)


def load_forest(spark: SparkSession, path: str, features: tuple[str, ...] = FEATURES) -> Forest:
    """The published forest; refused if it was trained on other features, or holds broken trees."""
    rows = spark.read.parquet(published(spark, path)).orderBy("tree", "node").collect()  # a model: trees x nodes
    if not rows or tuple(json.loads(rows[0].features)) != tuple(features):
        raise ValueError(f"{path} holds no forest over these {len(features)} features")
    trees: list[list[tuple[int, float, int, int, float]]] = []
    for r in rows:
        if r.tree == len(trees):
            trees.append([])
        trees[-1].append((int(r.feature), r.threshold, int(r.left), int(r.right), r.value))
    for tree in trees:
        for i, (f, threshold, left, right, value) in enumerate(tree):
            if not math.isfinite(value) or f >= len(features) or (f >= 0 and not (math.isfinite(threshold) and i < left < len(tree) and i < right < len(tree))):
                raise ValueError(f"{path} holds a broken tree")
    return Forest(tuple(features), trees)


def lambda_gradients(scores: np.ndarray, labels: np.ndarray, truncation: int = 30, at: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and curvatures of a list: for each pair of a relevant and another row, one of them in the first `truncation`, the logistic
    loss of the scores' difference weighed by what swapping the two changes in NDCG@at; ties of scores stand in the rows' order."""
    g, h = np.zeros(len(scores)), np.zeros(len(scores))
    good, bad = np.flatnonzero(labels > 0), np.flatnonzero(labels <= 0)
    if not len(good) or not len(bad):
        return g, h
    place = np.empty(len(scores), int)
    place[np.argsort(-scores, kind="stable")] = np.arange(len(scores))
    discount = np.where(place < truncation, 1 / np.log2(place + 2), 0.0)
    ideal = (1 / np.log2(np.arange(min(len(good), at)) + 2)).sum()
    change = np.abs(discount[good][:, None] - discount[bad][None, :]) / ideal
    p = 1 / (1 + np.exp(np.clip(scores[good][:, None] - scores[bad][None, :], -50, 50)))
    pull, curve = p * change, p * (1 - p) * change
    g[good] -= pull.sum(1)
    g[bad] += pull.sum(0)
    h[good] += curve.sum(1)
    h[bad] += curve.sum(0)
    return g, h


def _grouped(rows: DataFrame, features: tuple[str, ...], edges: np.ndarray) -> DataFrame:
    """(user_id, bins, labels): a list a row, features as numbers of bins of one byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_users(batches):
            users, first = np.unique(table.column("user_id").to_numpy(), return_index=True)
            cuts = [*first.tolist(), table.num_rows]
            x = np.column_stack([np.searchsorted(edges[k], table.column(c).to_numpy().astype(float), side="left") for k, c in enumerate(features)]).astype(np.uint8)
            y = table.column("label").to_numpy().astype(np.uint8)
            each = lambda v: pa.array([v[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(users), each(x), each(y)], ["user_id", "bins", "labels"])

    ordered = rows.select(F.col("user_id").cast("long"), "item_id", "label", *(F.col(f"`{c}`") for c in features)).repartition("user_id").sortWithinPartitions("user_id", "item_id")
    with batches_by_rows(rows.sparkSession):
        return durable(ordered.mapInArrow(run, "user_id long, bins binary, labels binary"))


#: The most lists that a task looks at together.
LISTS = 256


def fit_lambdamart(rows: DataFrame, features: tuple[str, ...] = FEATURES, trees: int = 60, depth: int = 4, rate: float = 0.1, least: int = 50, bins: int = 64, l2: float = 1.0, truncation: int = 30) -> Forest:
    """rows (user_id, item_id, label, features) -> a forest that ranks each user's rows.

    Lists of one label have no gradients: they only count where a side holds too few rows of the others. So a level looks at the lists of both labels, and at
    all lists only if the split of the largest gain isn't sure to hold `least` rows on both sides. Features are cut at quantiles, lists are kept as bytes in a written table, and every level of a tree is one pass: tasks score their lists
    by the trees so far (broadcast), take the lists' lambda gradients and send sums per node, feature and bin. A level of a tree, not the
    data, reaches the driver, which takes the split of the largest gain whose sides hold `least` rows."""
    spark, width = rows.sparkSession, len(features)
    cuts = rows.approxQuantile(list(features), [i / bins for i in range(1, bins)], 0.001)
    edges = np.full((width, bins - 1), np.inf)
    for k, c in enumerate(cuts):
        distinct = np.unique(c)
        edges[k, : len(distinct)] = distinct
    lists, forest = _grouped(rows, features, edges), Forest(features)
    both = F.udf(lambda y: 0 < sum(y) < len(y), "boolean")
    mixed = durable(lists.where(both("labels")))
    binned: list[list[tuple[int, float, int, int, float]]] = []  # the same trees with bins as thresholds

    def pass_(lists: DataFrame, level: int, tree: list) -> dict[int, np.ndarray]:
        sent = spark.sparkContext.broadcast((binned, tree))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            done, growing = sent.value
            first, nodes = 2**level - 1, 2**level
            sums = np.zeros((nodes, width, bins, 3))
            for pdf in batches:
                for begin in range(0, len(pdf), LISTS):
                    some = pdf.iloc[begin : begin + LISTS]
                    ends = np.cumsum([len(v) for v in some["labels"]])
                    x, y = np.frombuffer(b"".join(some["bins"]), np.uint8).reshape(-1, width), np.frombuffer(b"".join(some["labels"]), np.uint8)
                    g, h, at = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x), int)
                    for a, b in zip([0, *ends[:-1]], ends, strict=True):
                        if 0 < np.count_nonzero(y[a:b]) < b - a:  # no other list has gradients
                            g[a:b], h[a:b] = lambda_gradients(sum((tree_values(t, x[a:b]) for t in done), np.zeros(b - a)), y[a:b], truncation)
                    for _ in range(level):
                        at = _below(growing, at, x)
                    inside = np.flatnonzero(at >= first)
                    cell = ((at[inside] - first)[:, None] * width + np.arange(width)[None, :]) * bins + x[inside]
                    sums[..., 2] += np.bincount(cell.ravel(), minlength=nodes * width * bins).reshape(nodes, width, bins)
                    pulled = np.flatnonzero((g[inside] != 0) | (h[inside] != 0))
                    for j, v in enumerate((g[inside[pulled]], h[inside[pulled]])):
                        sums[..., j] += np.bincount(cell[pulled].ravel(), np.repeat(v, width), nodes * width * bins).reshape(nodes, width, bins)
            used = np.flatnonzero(sums[:, 0, :, 2].sum(1))
            yield pd.DataFrame({"node": used + first, "sums": [sums[i].ravel() for i in used]})

        found = lists.select("bins", "labels").mapInPandas(run, "node long, sums array<double>").select("node", F.posexplode("sums").alias("i", "x")).groupBy("node", "i").agg(F.sum("x").alias("x"))
        out: dict[int, np.ndarray] = {}
        for node, values in found.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])).collect():
            out[node] = np.array(values).reshape(width, bins, 3)
        return out

    def gains(sums: np.ndarray) -> tuple[np.ndarray, ...]:
        left = np.cumsum(sums, 1)[:, :-1]
        total = sums[0].sum(0)
        right = total - left
        return total, left, right, left[..., 0] ** 2 / (left[..., 1] + l2) + right[..., 0] ** 2 / (right[..., 1] + l2) - total[0] ** 2 / (total[1] + l2)

    def sure(sums: np.ndarray) -> bool:
        """Whether more rows without gradients can't change the choice."""
        _, left, right, gain = gains(sums)
        best = np.unravel_index(np.argmax(gain), gain.shape)
        return gain[best] <= 1e-9 or (left[best][2] >= least and right[best][2] >= least)

    for _ in range(trees):
        tree: list[tuple[int, float, int, int, float]] = [(-1, 0.0, -1, -1, 0.0)] * (2 ** (depth + 1) - 1)
        grew = False
        for level in range(depth):
            found, whole = pass_(mixed, level, tree), None
            for node in sorted(found):
                sums = found[node]
                if not sure(sums):
                    whole = pass_(lists, level, tree) if whole is None else whole
                    sums = whole[node]
                total, left, right, gain = gains(sums)
                tree[node] = (-1, 0.0, -1, -1, -rate * total[0] / (total[1] + l2))
                gain[(left[..., 2] < least) | (right[..., 2] < least)] = -1
                f, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[f, b] > 1e-9:
                    grew = True
                    tree[node] = (int(f), float(b), 2 * node + 1, 2 * node + 2, 0.0)
                    for child, side in ((2 * node + 1, left[f, b]), (2 * node + 2, right[f, b])):
                        tree[child] = (-1, 0.0, -1, -1, -rate * side[0] / (side[1] + l2))
        if not grew:
            break
        binned.append(tree)
        forest.trees.append(_compact([(f, float(edges[f, int(t)]) if f >= 0 else 0.0, a, b, v) for f, t, a, b, v in tree]))
    return forest


def _below(tree: list, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One step down for rows that aren't in a leaf yet; those in a leaf get -1."""
    feature, threshold, left, right, _ = (np.array(c) for c in zip(*tree, strict=True))
    out, rows = np.full(len(at), -1), np.flatnonzero((at >= 0) & (feature[at] >= 0))
    node = at[rows]
    out[rows] = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])
    return out


def _compact(tree: list) -> list:
    """The nodes that can be reached, parents before children."""
    order = [0]
    for i in order:
        if tree[i][0] >= 0:
            order += tree[i][2:4]
    number = {old: new for new, old in enumerate(order)}
    return [(f, t, number[a] if f >= 0 else -1, number[b] if f >= 0 else -1, v) for f, t, a, b, v in (tree[i] for i in order)]


def reranked(rows: DataFrame, score: Column | str, k: int | None = None) -> DataFrame:
    """rows in learned order: a permutation of each user's candidates, ties in the retrieval order."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc(score), F.desc("als_score"), "item_id"))
    out = rows.withColumn("rank", place)
    return out if k is None else out.where(F.col("rank") <= k)


# ---- the evaluation lists of a folder


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, score): the first CANDIDATES unseen items of users with training and test positives, by their neighbours' votes."""

    def build() -> DataFrame:
        asked = run_sql(spark, sf_dir, f"WITH {RATINGS}, {SPLIT} SELECT user_id FROM split GROUP BY user_id HAVING count_if(fold = 'train') > 0 AND count_if(fold = 'test') > 0")
        likes = training_likes(spark, sf_dir).join(asked, "user_id", "left_semi")
        best = best_by_votes(likes, neighbour_lists(spark, sf_dir), seen_items(spark, sf_dir), CANDIDATES)
        return best.select("user_id", "item_id", (F.col("vote") / F.lit(1e6)).alias("score"))

    return fact(spark, sf_dir, "retrieved", build, written=True)


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id, the features, label (1 for a test positive) and part of the user: train, validation or confirmation; a written fact."""

    def build() -> DataFrame:
        candidates, neighbours = retrieved(spark, sf_dir), neighbour_lists(spark, sf_dir)
        facts = run_sql(spark, sf_dir, f"WITH {CATALOG} SELECT item_id, array_distinct(split(lower(title), ' ')) AS genres, array(lower(studio)) AS studios, lower(split_part(type, ' ', 1)) AS source, lower(split_part(type, ' ', -1)) AS type, year FROM catalog")
        profiles = run_sql(spark, sf_dir, f"WITH {RATINGS}, {SPLIT} SELECT user_id, item_id FROM split WHERE fold = 'train'")
        stats = run_sql(spark, sf_dir, f"WITH {RATINGS}, {SPLIT}, {STATS} SELECT s.item_id, s.positives, s.observed AS ratings, s.total * 1e0 / s.observed AS mean, (s.total + 50 * m.mu) / (s.observed + 50) AS bayes, m.mu AS global_mean FROM stats s, (SELECT sum(total) * 1e0 / sum(observed) AS mu FROM stats) m")
        test = run_sql(spark, sf_dir, f"WITH {RATINGS}, {SPLIT} SELECT user_id, item_id, 1 AS label FROM split WHERE fold = 'test'")
        fold = F.conv(F.left(F.md5(F.concat(F.lit("reranker:"), F.col("user_id").cast("string")).cast("binary")), F.lit(8)), 16, 10).cast("long") % 5
        part = F.when(fold < 3, "train").when(fold == 3, "validation").otherwise("confirmation")
        lists = candidates.join(test, ["user_id", "item_id"], "left").withColumns({"label": F.coalesce("label", F.lit(0)), "part": part})
        return rerank_features(lists, profiles, facts, neighbours, stats, extra=("label", "part"))

    return fact(spark, sf_dir, "rerank_rows", build, written=True)


def list_metrics(rows: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """rows (user_id, rank, label), relevant (user_id, relevant) -> user_id, ndcg, recall, hit at k."""
    hits = rows.where((F.col("rank") <= k) & (F.col("label") > 0)).groupBy("user_id").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.count(F.lit(1)).alias("hits"))
    ideal = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least("relevant", F.lit(k))), F.lit(0.0), lambda a, x: a + 1 / F.log2(x + 1))
    return relevant.join(hits, "user_id", "left").select("user_id", (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"), (F.coalesce("hits", F.lit(0)) / F.col("relevant")).alias("recall"), F.col("hits").isNotNull().cast("double").alias("hit"))


TREES, DEPTH = 8, 3


def _models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Forest]:
    """All rows, those of the training users, and the forest that these make."""
    rows = feature_rows(spark, sf_dir)
    train = rows.where("part = 'train'")
    return rows, train, fit_lambdamart(train, trees=TREES, depth=DEPTH)


def rerank_features18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_rows(spark, sf_dir).select("user_id", "item_id", *(F.round(c, 6).alias(c) for c in FEATURES))


def feature_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of each feature over the training users' rows."""
    rows = feature_rows(spark, sf_dir).where("part = 'train'")
    found = rows.agg(*(x for c in FEATURES for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_scale"))))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), (F.round(f"{c}_mean", 5) + 0.0).alias("mean"), F.round(F.when(F.col(f"{c}_scale") < 1e-6, 1.0).otherwise(F.col(f"{c}_scale")), 5).alias("scale")) for c in FEATURES)))
    return found.select(each.alias("x")).select("x.*")


def reranker_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG, recall and hits at 10 of the confirmation users' lists in retrieval order, by the linear model and by the forest."""
    rows, train, forest = _models(spark, sf_dir)
    linear, held = fit_linear(train), rows.where("part = 'confirmation'")
    relevant = run_sql(spark, sf_dir, f"WITH {RATINGS}, {SPLIT} SELECT user_id, count(*) AS relevant FROM split WHERE fold = 'test' GROUP BY user_id").join(held.select("user_id").distinct(), "user_id")
    scored = forest_scores(held, forest, "forest").withColumn("linear", linear.score())
    out = None
    for arm, score in (("retrieval", "als_score"), ("linear", "linear"), ("lambdamart", "forest")):
        m = list_metrics(reranked(scored, score), relevant).agg(F.count(F.lit(1)).alias("users"), *(F.avg(c).alias(f"{c}10") for c in ("ndcg", "recall", "hit"))).withColumn("arm", F.lit(arm))
        out = m if out is None else out.unionByName(m)
    return out.select("arm", "users", "ndcg10", "recall10", "hit10")


def reranked_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of every confirmation user by the forest."""
    rows, _, forest = _models(spark, sf_dir)
    return reranked(forest_scores(rows.where("part = 'confirmation'"), forest), "score", 10).select("user_id", "item_id", F.round("score", 6).alias("score"), "rank")


#: A forest that is written down, so that scoring can be held against SQL.
SAMPLE_FOREST = Forest(FEATURES, [
    [(2, 0.05, 1, 2, 0.0), (3, 0.2, 3, 4, 0.0), (11, 0.1, 5, 6, 0.0), (-1, 0, -1, -1, -0.25), (-1, 0, -1, -1, 0.125), (-1, 0, -1, -1, 0.0625), (-1, 0, -1, -1, 0.5)],
    [(9, 1.5, 1, 2, 0.0), (6, 0.5, 3, 4, 0.0), (-1, 0, -1, -1, -0.125), (-1, 0, -1, -1, 0.0), (-1, 0, -1, -1, 0.375)],
    [(13, 2.0, 1, 2, 0.0), (-1, 0, -1, -1, -0.0625), (-1, 0, -1, -1, 0.03125)],
])


def sample_forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a fixed forest over all rows, and the order they give."""
    return reranked(forest_scores(feature_rows(spark, sf_dir), SAMPLE_FOREST), "score").select("user_id", "item_id", "score", "rank")


_F = (rerank_features18, feature_scaler, reranker_arms, reranked_lists, sample_forest_scores)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _F}

#: The lists and features in another way: every candidate meets every title of its user's profile.
_LISTS = f"""{_FOLDS}, {_PARTS},
z AS (SELECT u, i, (x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 1) AS z FROM tr WINDOW w AS (PARTITION BY u)), m AS (SELECT i, sqrt(sum(z * z)) AS m FROM z GROUP BY i HAVING sqrt(sum(z * z)) > 1e-8),
s AS (SELECT a.i AS i, b.i AS j, round(sum(a.z / ma.m * b.z / mb.m), 6) AS s FROM z a JOIN z b ON a.u = b.u AND a.i <> b.i JOIN m ma ON ma.i = a.i JOIN m mb ON mb.i = b.i GROUP BY a.i, b.i),
g AS (SELECT i, j, s FROM s WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY i ORDER BY s DESC, j) <= 200),
l AS (SELECT u, i FROM f WHERE fold = 'l' AND u IN (SELECT u FROM f WHERE fold = 't')),
v AS (SELECT u, j AS i, sum(CAST(round(s * 1000000) AS BIGINT)) AS v FROM l JOIN g ON l.i = g.i GROUP BY u, j),
k AS (SELECT u, i, v / 1e6 AS sc, row_number() OVER (PARTITION BY u ORDER BY v DESC, i) AS k FROM v WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.u = v.u AND tr.i = v.i) QUALIFY k <= {CANDIDATES}),
t AS (SELECT item_id AS i, list_distinct(string_split(lower(title), ' ')) AS gs, lower(studio) AS st, lower(string_split(type, ' ')[1]) AS so, lower(string_split(type, ' ')[-1]) AS ty, year FROM c),
o AS (SELECT u, count(*) AS n, median(year) AS my, list_distinct(flatten(list(gs))) AS all_gs FROM l JOIN t USING (i) GROUP BY u),
y AS (SELECT k.u, k.i, sum(len(list_intersect(a.gs, b.gs))) AS met, max(len(list_intersect(a.gs, b.gs)) / len(list_distinct(list_concat(a.gs, b.gs)))) AS jac, max(CASE WHEN a.st = b.st THEN 1.0 ELSE 0.0 END) AS st, avg(CASE WHEN a.so = b.so THEN 1.0 ELSE 0.0 END) AS so,
  avg(CASE WHEN a.ty = b.ty THEN 1.0 ELSE 0.0 END) AS ty, coalesce(max(g.s), 0) AS near, coalesce(list_sum(list_sort(list(g.s) FILTER (g.s IS NOT NULL), 'DESC')[1:5]), 0) AS near5
  FROM k JOIN l ON l.u = k.u JOIN t a ON a.i = k.i JOIN t b ON b.i = l.i LEFT JOIN g ON g.i = k.i AND g.j = l.i GROUP BY k.u, k.i),
mu AS (SELECT avg(x) AS mu FROM tr), n AS (SELECT i, count(*) AS n, avg(x) AS mean FROM tr GROUP BY i),
e AS (SELECT k.u AS user_id, k.i AS item_id, sc AS als_score, (sc - avg(sc) OVER w) / CASE WHEN stddev_pop(sc) OVER w > 0 THEN stddev_pop(sc) OVER w ELSE 1 END AS als_score_z, 1 / k AS als_rank_recip, met / (o.n * len(t.gs)) AS genre_affinity,
  len(list_intersect(t.gs, all_gs)) / len(t.gs) AS genre_coverage, jac AS genre_jaccard_max, y.st AS studio_affinity, y.so AS source_affinity, y.ty AS type_affinity, abs(t.year - my) / 10 AS year_gap,
  CASE WHEN abs(t.year - my) > 0 AND abs(t.year - my) <= 5 THEN 1.0 ELSE 0.0 END AS year_close, near AS item_item_max, near5 AS item_item_sum5, ln(1 + q.likes) AS log_train_pop, ln(1 + n.n) AS log_train_ratings, n.mean - mu AS train_rating_mean, q.quality - mu AS train_bayes, ln(1 + o.n) AS profile_size
  FROM k JOIN y ON y.u = k.u AND y.i = k.i JOIN t ON t.i = k.i JOIN o ON o.u = k.u JOIN q ON q.i = k.i JOIN n ON n.i = k.i, mu WINDOW w AS (PARTITION BY k.u))"""
ORACLES: dict[str, str] = {
    "rerank_features18": f"WITH {_LISTS} SELECT user_id, item_id, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES)} FROM e",
    "feature_scaler": f"WITH {_LISTS}, d AS (SELECT * FROM e WHERE CAST('0x' || left(md5('reranker:' || user_id), 8) AS BIGINT) % 5 < 3) "
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 5) + 0.0 AS mean, round(CASE WHEN stddev_pop({c}) < 1e-6 THEN 1.0 ELSE stddev_pop({c}) END, 5) AS scale FROM d" for c in FEATURES),
    "sample_forest_scores": f"""WITH {_LISTS}, x AS (SELECT user_id, item_id, als_score, CASE WHEN als_rank_recip <= 0.05::DOUBLE THEN CASE WHEN genre_affinity <= 0.2::DOUBLE THEN -0.25 ELSE 0.125 END WHEN item_item_max <= 0.1::DOUBLE THEN 0.0625 ELSE 0.5 END
        + CASE WHEN year_gap > 1.5 THEN -0.125 WHEN studio_affinity > 0.5 THEN 0.375 ELSE 0 END + CASE WHEN log_train_pop <= 2 THEN -0.0625 ELSE 0.03125 END AS score FROM e)
        SELECT user_id, item_id, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, als_score DESC, item_id) AS rank FROM x""",
}
