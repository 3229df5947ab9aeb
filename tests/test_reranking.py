"""Features by hand, the linear model against Newton's method, lambda gradients by pairs, a forest that learns planted order, serving."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnflow.operators import reranking as R

SMALL = ("als_score", "genre_affinity", "year_gap")


def test_features_by_hand(spark):
    candidates = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.5), (1, 12, 0.1), (2, 10, 0.4)], "user_id long, item_id long, score double")
    profiles = spark.createDataFrame([(1, 20), (1, 21), (1, 21)], "user_id long, item_id long")
    items = spark.createDataFrame([(10, ["a", "b"], ["s"], "manga", "tv", 2000), (11, [], None, None, None, None), (20, ["a"], ["s", "t"], "manga", "tv", 1994), (21, ["a", "b", "c"], ["u"], "novel", "tv", 1996)], "item_id long, genres array<string>, studios array<string>, source string, type string, year int")
    neighbours = spark.createDataFrame([(10, 20, 0.5), (10, 21, 0.25), (10, 22, 0.9), (11, 20, -0.5)], "item_id long, neighbor_id long, score double")
    stats = spark.createDataFrame([(10, 3, 5, 8.0, 7.5, 7.0)], "item_id long, positives long, ratings long, mean double, bayes double, global_mean double")
    got = {(r.user_id, r.item_id): r for r in R.rerank_features(candidates, profiles, items, neighbours, stats).collect()}
    assert set(got) == {(1, 10), (1, 11), (1, 12), (2, 10)}
    r = got[1, 10]
    want = dict(als_score=0.9, als_score_z=0.4 / math.sqrt(0.32 / 3), als_rank_recip=1.0, genre_affinity=3 / 4, genre_coverage=1.0, genre_jaccard_max=2 / 3, studio_affinity=1.0, source_affinity=0.5, type_affinity=1.0, year_gap=0.5, year_close=1.0, item_item_max=0.5,
                item_item_sum5=0.75, log_train_pop=math.log(4), log_train_ratings=math.log(6), train_rating_mean=1.0, train_bayes=0.5, profile_size=math.log(3))
    assert all(math.isclose(r[c], want[c], abs_tol=1e-12) for c in R.FEATURES), r
    assert [got[1, 11][c] for c in R.FEATURES[3:9]] == [0] * 6 and got[1, 12].als_rank_recip == 1 / 3
    assert got[2, 10].als_score_z == 0 and got[2, 10].genre_affinity == 0 and got[2, 10].profile_size == 0


def planted(seed, users=120, n=40):
    """Relevance depends on the second feature, not on retrieval."""
    r = random.Random(seed)
    out = []
    for u in range(users):
        for i in range(n):
            x = r.random(), r.random(), r.random()
            out.append((u, i, *x, int(r.random() < (0.5 if x[1] > 0.85 else 0.02))))
    return out


SCHEMA = "user_id long, item_id long, als_score double, genre_affinity double, year_gap double, label int"


def test_linear_is_the_optimum(spark):
    data = planted(1)
    model = R.fit_linear(spark.createDataFrame(data, SCHEMA).repartition(3), SMALL, l2=2.0)
    x, y = np.array([d[2:5] for d in data]), np.array([d[5] for d in data], float)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0))
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(x))])
    w = np.where(y > 0, (1 - y.mean()) / y.mean(), 1.0)
    w /= w.mean()
    b = np.zeros(4)
    penalty = np.diag([2.0 / len(x)] * 3 + [0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z / len(x) + penalty, z.T @ (w * (p - y)) / len(x) + penalty @ b)
    assert np.allclose([*model.weights, model.bias], b, atol=1e-4)
    scored = spark.createDataFrame(data[:5], SCHEMA).select(model.score().alias("s")).collect()
    assert np.allclose([r.s for r in scored], (z @ [*model.weights, model.bias])[:5])


def test_scaler_of_a_constant_and_no_rows(spark):
    rows = spark.createDataFrame([(1, 1, 0.5, 1.0, 2.0, 0), (1, 2, 0.5, 3.0, 2.0, 0)], SCHEMA)
    assert R.fit_scaler(rows, SMALL) == ([0.5, 2.0, 2.0], [1.0, 1.0, 1.0])
    assert R.fit_linear(rows, SMALL).weights == [0.0] * 3
    with pytest.raises(ValueError):
        R.fit_linear(rows.limit(0), SMALL)


def test_lambda_gradients_by_pairs():
    r = np.random.default_rng(2)
    for _ in range(20):
        s, y = r.normal(size=12).round(1), (r.random(12) < 0.3).astype(int)
        order = sorted(range(12), key=lambda i: (-s[i], i))
        d = {i: 1 / math.log2(k + 2) if k < 4 else 0.0 for k, i in enumerate(order)}
        ideal = sum(1 / math.log2(k + 2) for k in range(min(10, y.sum())))
        g, h = np.zeros(12), np.zeros(12)
        for i in range(12):
            for j in range(12):
                if y[i] > y[j]:
                    p, c = 1 / (1 + math.exp(s[i] - s[j])), abs(d[i] - d[j]) / ideal
                    g[i] -= p * c
                    g[j] += p * c
                    h[i] += p * (1 - p) * c
                    h[j] += p * (1 - p) * c
        got = R.lambda_gradients(s, y, 4)
        assert np.allclose(got[0], g) and np.allclose(got[1], h)


def ndcg(data, score):
    lists = {}
    for d in data:
        lists.setdefault(d[0], []).append((-score(d), d[1], d[5]))
    out = []
    for rows in lists.values():
        if n := sum(x[2] for x in rows):
            out.append(sum(x[2] / math.log2(k + 2) for k, x in enumerate(sorted(rows)[:10])) / sum(1 / math.log2(k + 2) for k in range(min(10, n))))
    return sum(out) / len(out)


def test_forest_learns_planted_order_and_serves(spark, tmp_path):
    data, held = planted(3), planted(4)
    rows = spark.createDataFrame(data, SCHEMA).repartition(4)
    forest = R.fit_lambdamart(rows, SMALL, trees=4, depth=2, rate=0.3, least=20, bins=32)
    again = R.fit_lambdamart(rows.repartition(7), SMALL, trees=4, depth=2, rate=0.3, least=20, bins=32)
    assert [t[0][0] for t in forest.trees] == [t[0][0] for t in again.trees] and abs(forest.trees[0][0][1] - again.trees[0][0][1]) < 0.02 and 1 <= len(forest.trees) <= 4  # cuts are approximate quantiles
    values = dict(zip([d[:2] for d in held], forest.predict(np.array([d[2:5] for d in held])), strict=True))
    assert ndcg(held, lambda d: values[d[:2]]) > ndcg(held, lambda d: d[2]) + 0.2
    df = spark.createDataFrame(held, SCHEMA)
    by_column = {(r.user_id, r.item_id): r.score for r in R.forest_scores(df, forest).collect()}
    large = R.Forest(SMALL, forest.trees * 60)
    by_walk = {(r.user_id, r.item_id): r.score for r in R.forest_scores(df, large).collect()}
    assert all(math.isclose(by_column[k], v, abs_tol=1e-12) and math.isclose(by_walk[k], 60 * v, abs_tol=1e-9) for k, v in values.items())
    order = R.reranked(R.forest_scores(df, forest), "score")
    assert order.count() == len(held) and order.groupBy("user_id").agg(F.max("rank").alias("m"), F.count_distinct("item_id").alias("n")).where("m <> 40 or n <> 40").count() == 0
    path = str(tmp_path / "forest")
    R.save_forest(spark, forest, path)
    assert R.load_forest(spark, path, SMALL) == forest
    with pytest.raises(ValueError):
        R.load_forest(spark, path, R.FEATURES)
    R.save_forest(spark, R.Forest(SMALL, [[(0, 0.5, 1, 7, 0.0), (-1, 0.0, -1, -1, 1.0)]]), path)
    with pytest.raises(ValueError):
        R.load_forest(spark, path, SMALL)
    with pytest.raises(ValueError):
        R.forest_scores(df.drop("year_gap"), forest)
