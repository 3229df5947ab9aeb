"""The seeded holdout and the samples against plain lists."""

import hashlib
import random

import pytest

from cairnflow.operators import holdout as H


def digest(text):
    return hashlib.blake2b(text.encode(), digest_size=8).digest()


def plain_split(user, positives, seed=42):
    rows = sorted(positives)
    n = len(rows)
    v, t = (0, 0) if n < 5 else (1, 1) if n < 10 else (1, 2) if n < 20 else (n // 10, n // 10)
    places = list(range(n))
    random.Random(int.from_bytes(digest(f"{seed}:{user}"), "little")).shuffle(places)
    fold = {p: "validation" if k < v else "test" for k, p in enumerate(places[: v + t])} if v else {}
    return {(user, i, r, fold.get(k, "train")) for k, (i, r) in enumerate(rows)}


def test_mersenne_split_at_the_boundaries(spark):
    r = random.Random(1)
    users = {u: [(i, 8 + i % 3) for i in r.sample(range(500), n)] for u, n in enumerate([0, 1, 4, 5, 9, 10, 19, 20, 29, 30, 105])}
    rows = [(u, i, x) for u, v in users.items() for i, x in v]
    r.shuffle(rows)
    want = set().union(*(plain_split(u, v) for u, v in users.items()))
    for parts in (1, 5):
        got = {tuple(x) for x in H.mersenne_split(spark.createDataFrame(rows, "user_id long, item_id long, rating int").repartition(parts)).select("user_id", "item_id", "rating", "fold").collect()}
        assert got == want
    sizes = {u: [sum(x[0] == u and x[3] == f for x in want) for f in ("validation", "test")] for u in users}
    assert [sizes[u] for u in (2, 3, 4, 5, 6, 7, 8)] == [[0, 0], [1, 1], [1, 1], [1, 2], [1, 2], [2, 2], [2, 2]]


def test_samples(spark):
    users = [(u, u % 30) for u in range(200)]
    df = spark.createDataFrame(users, "user_id long, n long")
    first = lambda ids, n, salt: set(sorted(ids, key=lambda u: (digest(f"{salt}:{u}"), u))[:n])
    assert {r[0] for r in H.uniform_sample(df, 17, 7).collect()} == first(range(200), 17, "sample:7") and H.uniform_sample(df, None).count() == 200
    got = {}
    for r in H.activity_sample(df, limit=20).collect():
        got.setdefault(r.stratum, set()).add(r.user_id)
    by = {"sparse": [u for u, n in users if n <= 4], "medium": [u for u, n in users if 4 < n <= 19], "heavy": [u for u, n in users if n > 19]}
    assert got == {s: first(by[s], k, "sample:42") for s, k in (("sparse", 7), ("medium", 7), ("heavy", 6))}
    with pytest.raises(ValueError):
        H.activity_sample(df, per_stratum=0)


@pytest.mark.parametrize("limit,per", [(None, 8), (31, None), (None, None), (None, 500)])
def test_popularity_sample_is_greedy_from_the_rarest(spark, limit, per):
    r = random.Random(2)
    bucket = {i: "head" if i < 5 else "mid" if i < 15 else "tail" if i < 38 else "unknown" for i in range(40)}
    held = [(u, i) for u in range(60) for i in r.sample(range(40), r.choice([1, 1, 2]))]
    groups = {b: sorted({u for u, i in held if bucket[i] == b}) for b in ("head", "mid", "tail")}
    want = {b: per if per else len(groups[b]) if limit is None else limit // 3 + (k < limit % 3) for k, b in enumerate(groups)}
    chosen = {}
    for b in ("tail", "mid", "head"):
        need = max(0, want[b] - sum(u in chosen for u in groups[b]))
        for u in sorted((u for u in groups[b] if u not in chosen), key=lambda u: (digest(f"sample:42:popularity:{b}:{u}"), u))[:need]:
            chosen[u] = b
    got = H.popularity_sample(spark.createDataFrame(held, "user_id long, item_id long"), spark.createDataFrame(list(bucket.items()), "item_id long, bucket string"), limit, per)
    assert {r.user_id: r.stratum for r in got.collect()} == chosen
