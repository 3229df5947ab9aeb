import os
from datetime import datetime, timedelta
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnflow.functions import scalar as S
from cairnflow.operators import models, registry, text
from cairnflow.plans.views import RATINGS, SPLIT, run_sql
from cairnflow.sources import tables
from cairnflow.streaming import state

SF = "/root/testdata/sf0.001"


def oracle(name):
    con = duckdb.connect()
    for x in os.listdir(SF):
        con.execute(f"create view {x.split('.')[0]} as select * from '{SF}/{x}'")
    found = con.execute(registry.ORACLES[name])
    return [d[0] for d in found.description], found.fetchall()


def plain(rows, at):
    number = lambda v: isinstance(v, (int, float, Decimal)) and not isinstance(v, bool)
    return sorted(str([round(float(r[i]), 4) if number(r[i]) else r[i] for i in at]) for r in rows)


@pytest.mark.parametrize("name", ["rating_profile", "holdout_sizes", "bayes_quality", "popularity_bucket", "metrics_by_segment", "exposure_gini", "series_cap2", "idf", "metadata_refresh", "relaxation_probe", "rank_score", "required_people", "title_exclusion", "negative_pairs", "search_fallback", "hybrid_score", "residual_query", "constraint_inherit", "entity_index", "sliding_count"])
def test_oracle(spark, name):
    names, want = oracle(name)
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    cols = sorted(names)
    assert plain(got.collect(), [got.columns.index(c) for c in cols]) == plain(want, [names.index(c) for c in cols])


def test_holdout_boundaries(spark):
    for r in registry.QUERIES["holdout_sizes"](spark, SF).collect():
        want = (0, 0) if r.positives < 5 else (1, 1) if r.positives < 10 else (1, 2) if r.positives < 20 else (r.positives // 10,) * 2
        assert (r.validation, r.test) == want and r.train + r.validation + r.test == r.positives


def test_scalars(spark):
    row = spark.range(1).select(S.to_int(F.lit("12.0")).alias("a"), S.to_float(F.lit("Unknown")).alias("b"), S.clean_label(F.lit("x::School School")).alias("c"), S.year_of(F.lit("Aired 1998-04")).alias("d"), S.family_key(F.lit("The, Big-One!")).alias("e"), S.fix_text(F.lit("CafÃ©")).alias("f"), S.folded(F.lit("Straße É")).alias("g"), S.jaccard_distance(F.array(), F.array()).alias("h")).first()
    assert tuple(row) == (12, None, "School", 1998, "the big one", "Café", "strassee", 0.0)


def test_planted_clusters(spark):
    likes = [(u, i) for u in (1, 2, 3) for i in (1, 2, 3)] + [(u, i) for u in (4, 5, 6) for i in (4, 5, 6)]
    items = models.train_als(spark.createDataFrame(likes, "user_id long, item_id long"), 30, 8, 40.0, 0.01)
    asked = spark.createDataFrame([(9, [1, 2]), (10, [6])], "user_id long, seen array<long>")
    got = models.fold_in(asked, items, 3, 40.0, 0.01).collect()
    assert {(r.user_id, r.rank): r.item_id for r in got}[9, 1] == 3 and {r.item_id for r in got if r.user_id == 10 and r.rank <= 2} == {4, 5}
    assert not {(r.user_id, r.item_id) for r in got} & {(9, 1), (9, 2), (10, 6)}


def test_fold_in_equals_the_closed_form_in_one_block_and_in_many(spark, monkeypatch):
    r = np.random.default_rng(5)
    y = r.normal(size=(30, 4))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "item_id long, vec array<double>").repartition(3)
    seen = {u: sorted(set(r.integers(0, 30, 6).tolist())) for u in range(12)}
    asked = spark.createDataFrame(list(seen.items()), "user_id long, seen array<long>")
    want = {}
    for u, s in seen.items():
        x = np.linalg.solve(y.T @ y + models.REG * np.eye(4) + models.ALPHA * y[s].T @ y[s], models.ALPHA * y[s].sum(0))
        want[u] = sorted((i for i in range(30) if i not in s), key=lambda i: (-round(y[i] @ x, 9), i))[:5]
    for most in (1 << 30, 200):
        monkeypatch.setattr(models, "MOST_SENT", most)
        got = sorted((g.user_id, g.rank, g.item_id) for g in models.fold_in(asked, items, 5).collect())
        assert got == sorted((u, k, i) for u, ids in want.items() for k, i in enumerate(ids, 1))


def test_bootstrap_interval(spark):
    d = np.random.default_rng(1).normal(0.1, 1, 400)
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(d)], "user_id long, d double")
    means = [[m.mean for m in models.bootstrap_means(x).orderBy("b").collect()] for x in (rows, rows.repartition(5))]
    assert np.allclose(*means) and len(means[0]) == 2000
    assert abs(np.mean(means[0]) - d.mean()) < 0.01 and abs(np.std(means[0]) - d.std() / 20) < 0.005


def test_user_projection_follows_splitmix64(spark):
    mask, got = (1 << 64) - 1, spark.createDataFrame([(1,), (2**40 + 7,)], "user_id long").select("user_id", models.user_projection()("user_id").alias("p")).collect()
    for r in got:
        for k, p in enumerate(r.p):
            x = (r.user_id * 0x9E3779B185EBCA87 + (k + 1) * 0xC2B2AE3D27D4EB4F) & mask
            x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
            x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
            x ^= x >> 31
            assert (p.cell, p.sign) == (x % 128 + 128 * k, -1 if x >> 32 & 1 else 1)


def test_fuzzy_best_against_all_pairs(spark):
    import difflib

    names = ["almond steel", "almond metal", "blue ring", "green almond box", "rose water", "blue rang"]
    asked = ["almund steel", "blue rinng", "gren almond bx", "zzz"]
    got = {r.query_id: r.item_id for r in text.fuzzy_best(spark.createDataFrame(list(enumerate(names)), "item_id long, name string"), spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")).collect()}
    assert got == {q: max(range(len(names)), key=lambda i: difflib.SequenceMatcher(None, names[i], x).ratio()) for q, x in enumerate(asked) if x != "zzz"}


def test_adjusted_cosine_by_brute_force(spark):
    ratings = spark.sql("select * from values (1)").count() and registry.QUERIES["split_rows"](spark, SF).collect()
    assert ratings
    rows = run_sql(spark, SF, f"WITH {RATINGS}, {SPLIT} SELECT r.user_id, r.item_id, r.rating FROM ratings r LEFT JOIN split s ON r.user_id = s.user_id AND r.item_id = s.item_id WHERE coalesce(s.fold, 'train') = 'train'").collect()
    users, items = ({v: k for k, v in enumerate(sorted({r[j] for r in rows}))} for j in (0, 1))
    m, has = np.zeros((len(users), len(items))), np.zeros((len(users), len(items)), bool)
    for r in rows:
        m[users[r.user_id], items[r.item_id]], has[users[r.user_id], items[r.item_id]] = r.rating, True
    for u in range(len(users)):
        own = m[u, has[u]].astype(float)
        m[u, has[u]] = (own - own.mean()) / max(own.std(), 1.0)
    unit = m / np.where((n := np.sqrt((m * m).sum(0))) > 1e-8, n, 1)
    s = np.round(unit.T @ unit, 4)
    got = {(r.item_id, r.neighbor_id): r.score for r in registry.QUERIES["item_item_cosine_topk"](spark, SF).collect()}
    back = {v: k for k, v in items.items()}
    assert all(abs(s[items[a], items[b]] - x) < 1e-3 for (a, b), x in got.items())
    assert sum((s[i, j] > 1e-3 and i != j) and (back[i], back[j]) not in got for i in range(len(items)) for j in range(len(items))) <= sum(max(0, int((s[i] > 0).sum()) - 201) for i in range(len(items)))


def test_ratings_sources(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("user_id,item_id,rating\n1,1,5\n1,2,11\nx,2,3\n2,1,7\n")
    good, report = tables.lenient_ratings(spark, str(p))
    assert good.count() == 2 and tuple(report.first()) == (1, 1, 2)
    p.write_text("user_id,item_id,rating\n1,1,5\n1,1,6\n")
    with pytest.raises(ValueError):
        tables.strict_ratings(spark, str(p))


def test_limiter_refused_requests_use_no_quota(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, i, t + timedelta(seconds=s)) for i, s in enumerate((0, 10, 20, 59, 61, 71))]
    got = state.limited(spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp"), 2, 60).orderBy("event_id")
    assert [r.allowed for r in got.collect()] == [True, True, False, False, True, True]


def test_best_by_sketch_is_brute_force_in_one_block_and_in_many(spark):
    r = np.random.default_rng(3)
    made = lambda: {int(c): round(float(r.normal()), 6) for c in r.choice(models.PROJECTIONS * models.WIDTH, 12, replace=False)}
    users, items = {u: made() for u in range(30)}, {i: made() for i in range(200)}
    seen, known = {u: [int(i) for i in r.choice(200, 20)] for u in users}, {i: round(float(r.random()), 3) for i in items}
    want = set()
    for u, x in users.items():
        score = {i: round(sum(v * y[c] for c, v in x.items() if c in y) * known[i], 6) for i, y in items.items() if i not in seen[u] and set(x) & set(y)}
        want |= {(u, i, s) for i, s in sorted(score.items(), key=lambda z: (-z[1], z[0]))[:5]}
    profiles = spark.createDataFrame([(u, list(x), list(x.values()), seen[u]) for u, x in users.items()], "user_id long, cells array<int>, values array<double>, seen array<long>")
    rows = spark.createDataFrame([(i, list(y), list(y.values()), known[i]) for i, y in items.items()], "item_id long, cells array<int>, values array<double>, known double").repartition(3)
    for block in (4096, 7):
        got = models.best_by_sketch(profiles, rows, 5, block).orderBy(F.desc("score"), "item_id").collect()
        first = {u: [(g.item_id, g.score) for g in got if g.user_id == u][:5] for u in users}
        assert {(u, i, round(s, 6)) for u, x in first.items() for i, s in x} == want


def test_als_lets_go_of_every_iteration(spark, monkeypatch):
    asked = []

    class Noted(models.ALS):
        def fit(self, rows):
            asked.append(self.getCheckpointInterval())
            return super().fit(rows)

    monkeypatch.setattr(models, "ALS", Noted)
    likes = spark.createDataFrame([(u, i) for u in range(12) for i in range(8) if (u + i) % 3], "user_id long, item_id long")
    assert models.train_als(likes, 2, 4).count() == 8 and asked == [1]


def test_fold_in_by_blocks_of_users_is_the_closed_form(spark, monkeypatch):
    r = np.random.default_rng(5)
    y = {i: r.normal(size=6) for i in range(40)}
    seen = {u: sorted({int(i) for i in r.choice(40, 7)}) for u in range(50)}
    asked = spark.createDataFrame([(u, s) for u, s in seen.items()], "user_id long, seen array<long>").repartition(3)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in y.items()], "item_id long, vec array<double>")
    want = {}
    for u, s in seen.items():
        mine, every = np.array([y[i] for i in s]), np.array(list(y.values()))
        x = np.linalg.solve(every.T @ every + models.ALPHA * mine.T @ mine + models.REG * np.eye(6), models.ALPHA * mine.sum(0))
        score = {i: round(float(x @ v), 9) for i, v in y.items() if i not in s}
        want[u] = [i for i, _ in sorted(score.items(), key=lambda z: (-z[1], z[0]))[:4]]
    for most in (models.MOST_JOINED, 1500):  # one block, and some
        monkeypatch.setattr(models, "MOST_JOINED", most)
        got = models.fold_in(asked, items, 4).orderBy("user_id", "rank").collect()
        assert {u: [g.item_id for g in got if g.user_id == u] for u in seen} == want
