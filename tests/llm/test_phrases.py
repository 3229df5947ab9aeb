"""Phrases against plain counting, with small shards, filters and long pieces."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from cairnflow.llm import phrases

SCHEMA = "doc_id long, lang string, text string, phrase string, n long"


def plain(rows, longest=3, least=10, top=2000, covered=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, *w[i : i + k]] += 1
    found = {k: v for k, v in f.items() if v >= least and len(k) > 2}
    out = {}
    for key, a in found.items():
        lang, w = key[0], key[1:]
        longer = [v for x, v in found.items() if x[0] == lang and len(x) > len(key) and any(x[1 + i : 1 + i + len(w)] == w for i in range(len(x) - len(w)))]
        if any(100 * v >= covered * a for v in longer):
            continue
        score, _, l, r = min((1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), a, l, r, n[lang], score))
    return sorted((lang, i + 1, x[2].decode(), *x[3:]) for lang, v in out.items() for i, x in enumerate(sorted(v)[:top]))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    some = ["New York", "the the the", "a b c", "ä ö", "Über\tmut", "x\x1cy z", "of the", "one"]
    text = lambda k: "".join(r.choice(some) + r.choice([" ", " ", "  ", ". ", "\n", ",", " \x0c"]) for _ in range(k))
    out = [(r.choice(["en", "en", "de", None, "und", ""]), text(r.randrange(40))) for _ in range(150)]
    return [*out, ("en", None), ("en", ""), (None, " \t ."), ("en", "the " * 5000), *[("en", "Copy of a row. Copy of a row")] * 30, ("fr", "w" * 300 + " k l m" * 40)]


@pytest.mark.parametrize("limit,bits,longest", [(phrases.SHARD_BYTES, phrases.MOST_BITS, 3), (64, 1 << 15, 3), (700, 1 << 15, 4), (200, 1 << 15, 2)])
def test_equal_to_plain_counting(spark, rows, limit, bits, longest):
    df = spark.createDataFrame([(i, lang, text, "x", 1) for i, (lang, text) in enumerate(rows)], SCHEMA).repartition(3)
    got = phrases.collocations(df, longest=longest, limit=limit, most_bits=bits)
    assert sorted(map(tuple, got.collect())) == plain(rows, longest)


def test_dense_and_sparse_bitmaps_agree():
    r = np.random.default_rng(5)
    ids = r.choice([0, 1, 1, 1, 2, 2, 3, 4, 5, 6, 7, 300], 5000)
    every = lambda x: np.ones(len(x), bool)
    want = Counter()
    for k in (1, 2, 3, 4):
        want.update(tuple(ids[i : i + k].tolist()) for i in range(len(ids) - k + 1) if ids[i : i + k].all() and i + k - 1 >= 20)
    for dense, block in ((1, 1 << 18), (3, 50), (8, 1000), (5000, 700)):
        got = Counter()
        for words, counts in phrases.Shard(ids.astype(np.int64), 20, dense, block).phrases(4, every):
            for w, c in zip(words.tolist(), counts.tolist(), strict=True):
                assert tuple(w) not in got
                got[tuple(w)] = c
        assert +got == want


def test_first_of_large_languages(spark):
    rows = spark.range(5000).selectExpr("'en' AS lang", "cast(id AS string) AS phrase", "id % 700 AS score")
    order = [phrases.F.desc("score"), phrases.F.asc("phrase")]
    got = [r.phrase for r in phrases._first(rows, "lang", order, 40, part=200).orderBy("rank").collect()]
    assert got == [x for _, x in sorted((-(i % 700), str(i)) for i in range(5000))][:40]


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).count() == 0
