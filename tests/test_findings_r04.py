import numpy as np
import pyarrow as pa
import pytest

from cairnflow.operators import neighbours, reranking

def _histories(seed: int):
    rng = np.random.default_rng(seed)
    rows = [(u, int(i), float(z)) for u in range(60) for i, z in zip(rng.choice(40, rng.integers(1, 12), replace=False), rng.choice([-0.5, 0.25, 0.5], 12))]
    return sorted(rows)


@pytest.mark.parametrize(("held", "sorted_", "best"), [(1 << 24, 1 << 18, 200), (50, 16, 3), (1, 1, 200)])
def test_neighbours_in_packed_blocks_are_the_pairs_summed_one_by_one(monkeypatch, held, sorted_, best):
    monkeypatch.setattr(neighbours, "HELD", held)
    monkeypatch.setattr(neighbours, "SORTED", sorted_)
    monkeypatch.setattr(neighbours, "NEIGHBOURS", best)
    monkeypatch.setattr(neighbours, "PACKED", 64)
    rows, bounds = _histories(held), np.array([9, 20])
    columns = [pa.array(c) for c in zip(*rows)]
    batch = pa.RecordBatch.from_arrays(columns, ["user_id", "item_id", "z"])
    packed = list(neighbours._pack(iter([batch.slice(0, 100), batch.slice(100)])))
    assert len(packed) > 1
    routed = list(neighbours._routed(bounds, (0, 3))(iter(packed)))
    assert {int(b) for r in routed for b in r.column("block").to_pylist()} == {0, 1, 2}
    lists = list(neighbours._best_pairs(bounds)(iter(routed)))
    got = [tuple(r.values()) for b in neighbours._flat(iter(lists)) for r in b.to_pylist()]
    want = []
    for i in range(40):
        sums: dict[int, tuple[float, int]] = {}
        for u, a, z in rows:
            for v, b, y in rows:
                if i == a and u == v and a != b:
                    s, n = sums.get(b, (0.0, 0))
                    sums[b] = (s + z * y, n + 1)
        good = sorted((-round(s, 6), b, n) for b, (s, n) in sums.items() if s > 0)[:best]
        want += [(i, b, n, -s, k + 1) for k, (s, b, n) in enumerate(good)]
    assert sorted(got) == sorted(want)


def test_votes_in_blocks_are_the_votes_summed_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_PAIRS", 1000)  # several waves
    monkeypatch.setattr(neighbours, "SORTED", 8)
    rng = np.random.default_rng(4)
    near = {i: [(int(j), int(m)) for j, m in zip(rng.choice(30, 5, replace=False), rng.integers(1, 4, 5) * 250000)] for i in range(25)}
    lists = spark.createDataFrame([(i, len(x), np.array([j for j, _ in x]).tobytes(), np.array([m for _, m in x], np.int32).tobytes()) for i, x in near.items()], "item_id long, n long, others binary, micros binary")
    likes = [(p, u, int(i)) for u in range(40) for p in (1, 3) for i in rng.choice(30, p, replace=False)]
    seen = [(u, int(i)) for u in range(0, 40, 2) for i in rng.choice(30, 8, replace=False)]
    got = neighbours.best_by_votes(spark.createDataFrame(likes, "part long, user_id long, item_id long"), lists, spark.createDataFrame(seen, "user_id long, item_id long"), 4)
    want = []
    for p, u in sorted({x[:2] for x in likes}):
        votes: dict[int, int] = {}
        for q, v, i in likes:
            for j, m in near.get(i, []) if (q, v) == (p, u) else []:
                votes[j] = votes.get(j, 0) + m
        want += [(p, u, j, m, k + 1) for k, (m, j) in enumerate(sorted(((m, j) for j, m in votes.items() if (u, j) not in seen), key=lambda x: (-x[0], x[1]))[:4])]
    assert sorted(map(tuple, got.collect())) == sorted(want)



def test_packed_lists_and_rows_of_neighbours_give_the_same_features(spark, monkeypatch):
    monkeypatch.setattr(reranking, "MOST_PAIRS", 500)  # several waves
    monkeypatch.setattr(reranking, "ROWS", 20)
    monkeypatch.setattr(reranking, "TOGETHER", 2)
    rng = np.random.default_rng(5)
    near = {i: [(int(j), int(m)) for j, m in zip(rng.choice(30, 6, replace=False), rng.integers(1, 10**6, 6))] for i in range(25)}
    lists = spark.createDataFrame([(i, len(x), np.array([j for j, _ in x]).tobytes(), np.array([m for _, m in x], np.int32).tobytes()) for i, x in near.items()], "item_id long, n long, others binary, micros binary")
    flat = spark.createDataFrame([(i, j, m / 1e6) for i, x in near.items() for j, m in x], "item_id long, neighbor_id long, score double")
    profiles = spark.createDataFrame([(u, int(i)) for u in range(20) for i in rng.choice(30, 4, replace=False)], "user_id long, item_id long")
    candidates = spark.createDataFrame([(u, int(i), float(i)) for u in range(22) for i in rng.choice(32, 9, replace=False)], "user_id long, item_id long, score double")
    items = spark.createDataFrame([(i, ["a", 'b"', "c,d"][: i % 4], None if i == 3 else [f"s{i % 3}"], f"o{i % 2}", None, 1990 + i) for i in range(30)], "item_id long, genres array<string>, studios array<string>, source string, type string, year int")
    stats = spark.createDataFrame([(i, 2, 3, 5.0, 6.0, 5.5) for i in range(28)], "item_id long, positives long, ratings long, mean double, bayes double, global_mean double")
    a, b = (sorted(map(tuple, reranking.rerank_features(candidates, profiles, items, x, stats).collect())) for x in (lists, flat))
    assert len(a) == 22 * 9 and a == b
    at, scores = reranking.FEATURES.index("item_item_max"), {(i, j): m / 1e6 for i, x in near.items() for j, m in x}
    own = {u: [r.item_id for r in profiles.where(f"user_id = {u}").collect()] for u in (0, 7, 21)}
    assert all(r[2 + at] == max([scores.get((r[1], p), 0.0) for p in own[r[0]]], default=0.0) for r in a if r[0] in own)


def test_lists_of_one_label_count_only_where_a_side_may_hold_too_few(spark):
    rng = np.random.default_rng(6)
    rows = [(u, i, int(u < 12 and i < 2), float(i < 2) + 0.01 * rng.random(), float(rng.random())) for u in range(60) for i in range(8)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, label int, x double, y double").repartition(3)
    few, many = (reranking.fit_lambdamart(df, ("x", "y"), trees=1, depth=1, least=n) for n in (5, 40))
    assert few.trees == many.trees and few.trees[0][0][0] == 0  # 24 rows of the 12 lists of both labels are above the cut, 120 of all
    assert not reranking.fit_lambdamart(df, ("x", "y"), trees=1, depth=1, least=241).trees
