"""The ten channels against plain Python on a small catalogue; learned weights against the plain gradient."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cairnflow.functions import labels as L
from cairnflow.functions.scalar import STOPWORDS
from cairnflow.operators import fusion, hybrid
from cairnflow.plans.rank import against_all

ITEM = "item_id long, title string, synopsis string, genres array<string>, metadata_tokens array<string>, genre_groups map<string,array<string>>, type string, studios array<string>, staff array<struct<name:string,role:string>>, characters array<string>, voice_actors array<string>, producers array<string>, score double, members long, popularity long"
REQUEST = "user_id long, text string, genres array<string>, session_genres array<string>, excluded_genres array<string>, formats array<string>, studios array<string>, staff array<string>, characters array<string>, voice_actors array<string>, novelty string"
ITEMS = [
    (1, "Iron School", "A school of iron dreams, friends and battle", ["Drama", "Sci Fi"], ["genre_drama", "type_tv", "source_manga"], {"Theme": ["School"]}, "TV", ["Madhouse"], [("Ann Lee", "Director"), ("Bo", "Producer")], ["Rin"], ["Vic"], ["Prod A"], 8.5, 1000, 2),
    (2, "Iron School Returns", "More battle at school", ["Drama"], ["genre_drama"], {}, "TV", ["Madhouse", "Bones"], [("Ann Lee", "Music, Script")], [], [], [], 7.0, 400, 3),
    (3, "Sea of Rain", None, ["Slice of Life"], [], None, "Movie", ["Bones"], [("Cy", "Director")], None, None, None, 9.0, 5000, 1),
    (4, "Unknown", "", None, None, None, None, None, None, None, None, None, None, None, None),
    (5, "Battle city", "City crime and detective work in rain", ["Action", "Sci Fi"], ["theme_crime"], {"Theme": ["Crime"]}, "tv", ["Madhouse"], [], ["Rin"], [], ["Prod A", "Prod B"], 6.0, 90, 4),
    (6, "Dreams", "dreams dreams school", ["Drama", "Action"], ["genre_action"], {}, "OVA", ["Solo"], [("Dee", "Original Creator")], [], [], [], 5.0, 10, 5),
]
REQUESTS = [
    (100, "a dark school battle show", ["Drama"], ["Sci Fi"], ["Slice of Life"], [], ["Madhouse"], ["Ann Lee"], ["Rin"], ["Vic"], "less_famous"),
    (200, "recommend something drama", ["Drama"], None, None, ["TV"], None, None, None, None, "neutral"),
    (300, None, None, None, None, None, None, None, None, None, None),
    (400, "rain", None, None, ["Drama"], None, None, None, None, None, "mainstream"),
]
LIKES = [(100, 1), (100, 6), (300, 3), (300, 5)]
NEIGHBOURS = [(1, 2, 0.5), (1, 5, 0.25), (6, 5, 0.5), (3, 4, 0.1), (5, 1, 0.3)]
BAYES = [(1, 0.8), (2, 0.7), (5, 0.6)]
VECTORS = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0]), (6, [-1.0, 0.5])]


def tok(x):
    return [t for t in re.findall("[a-z0-9]+", (x or "").lower()) if t not in STOPWORDS]


def lab(x):
    return " ".join(tok(x))


def themes(text):
    return [t for t, w in L.THEMES.items() if set(tok(text)) & set(w.split())]


def roles(x):
    return sorted({lab(p) for p in re.split("[,/;|]+", x or "")} & set(hybrid.CREATOR_ROLES))


def dense(text):
    v, t = np.zeros(192), tok(text)

    def add(f, w):
        v[zlib.crc32(f.encode()) % 192] += w * (1 if zlib.crc32(b"sign:" + f.encode()) % 2 == 0 else -1)

    for x in t:
        add(x, 1)
        for i in range(len(x) - 2 if len(x) >= 5 else 0):
            add("char:" + x[i : i + 3], 0.18)
    for a, b in zip(t, t[1:], strict=False):
        add(f"{a}_{b}", 0.65)
    return v / np.linalg.norm(v) if v.any() else v


def cos(a, b):
    dot = sum(x * b.get(k, 0) for k, x in a.items())
    return max(0.0, min(1.0, dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())))) if dot else 0.0


def plain():
    items = [dict(zip([c.split()[0] for c in ITEM.split(", ")], r, strict=True)) for r in ITEMS]
    meta, story, made = {}, {}, {}
    for it in items:
        m, s, c, i = Counter(), Counter(), Counter(), it["item_id"]
        for t in it["metadata_tokens"] or []:
            m["metadata:" + lab(t.replace("_", " "))] += 8 if t.split("_")[0] in ("genre", "theme", "demographic") else 3 if t.startswith("type_") else 2
        for g, values in (it["genre_groups"] or {}).items():
            for v in values:
                m[f"{lab(g)}:{lab(v)}"] += 7
        for g in it["genres"] or []:
            m["genre:" + lab(g)] += 8
            for t in tok(g):
                m[t] += 2
        if it["type"]:
            m["type:" + lab(it["type"])] += 3
        for kind, names in (("studio", it["studios"]), ("staff", [p[0] for p in it["staff"] or []]), ("character", it["characters"]), ("voice_actor", it["voice_actors"])):
            for x in names or []:
                m[f"{kind}:{lab(x)}"] += 3
        for t in tok(it["title"]):
            s[t] += 1.6
        for t in tok(it["synopsis"])[:360]:
            s[t] += 1.2
        it["story"] = " ".join([it["title"], it["synopsis"] or "", " ".join(it["genres"] or [])])
        for t in themes(it["story"]):
            s["theme:" + t] += 6
        for x in it["studios"] or []:
            c["studio:" + lab(x)] += 4
        for name, role in it["staff"] or []:
            for r in roles(role):
                c[f"{r}:{lab(name)}"] += 4
        for x in (it["producers"] or [])[:4]:
            c["producer:" + lab(x)] += 0.45
        meta[i], story[i], made[i] = m, s, c
    idf = [{f: math.log((1 + 6) / (1 + sum(f in v for v in vs.values()))) + 1 for f in set().union(*vs.values())} for vs in (meta, story, made)]
    meta, story, made = ({i: {f: w * d[f] for f, w in v.items()} for i, v in vs.items()} for vs, d in zip((meta, story, made), idf, strict=True))
    top = [f for f, _ in sorted(sum((Counter(v) for v in story.values()), Counter()).items(), key=lambda x: (-x[1], x[0]))[:384]]
    m = np.array([[story[i["item_id"]].get(f, 0) for f in top] for i in items])
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    values, vectors = np.linalg.eigh(m.T @ m)
    axes = vectors[:, np.argsort(values)[::-1][:48]]
    latent = m @ axes
    latent = {it["item_id"]: v / np.linalg.norm(v) for it, v in zip(items, latent, strict=True) if np.linalg.norm(v) > 1e-9}
    vec = {i: np.array(v) / np.linalg.norm(v) for i, v in VECTORS}
    logm, logp, mean = math.log1p(5000), math.log1p(5), sum(it["score"] / 10 for it in items if it["score"]) / 5
    bayes = dict(BAYES)
    out = {}
    for r in REQUESTS:
        q = dict(zip([c.split()[0] for c in REQUEST.split(", ")], r, strict=True))
        u, liked = q["user_id"], [i for x, i in LIKES if x == q["user_id"]]
        pm, ps, pc = Counter(), Counter(), Counter()
        for i in liked:
            pm.update(meta[i]), ps.update(story[i]), pc.update(made[i])

        def add(p, d, f, w):
            p[f] += w * d.get(f, 1.0)

        for g in q["genres"] or []:
            add(pm, idf[0], "genre:" + lab(g), 12)
            for t in tok(g):
                add(pm, idf[0], t, 2.4)
        for g in q["session_genres"] or []:
            add(pm, idf[0], "genre:" + lab(g), 4)
            for t in tok(g):
                add(pm, idf[0], t, 0.8)
        for x in q["studios"] or []:
            add(pm, idf[0], "studio:" + lab(x), 8)
            add(pc, idf[2], "studio:" + lab(x), 8)
        for x in q["staff"] or []:
            add(pm, idf[0], "staff:" + lab(x), 8)
            for role in (*hybrid.CREATOR_ROLES, "creator", "producer"):
                add(pc, idf[2], f"{role}:{lab(x)}", 4)
        for x in q["characters"] or []:
            add(pm, idf[0], "character:" + lab(x), 8)
        for x in q["voice_actors"] or []:
            add(pm, idf[0], "voice_actor:" + lab(x), 8)
        for t in tok(q["text"]):
            add(pm, idf[0], t, 1.2)
            add(ps, idf[1], t, 4)
        for t in themes(q["text"] or ""):
            add(ps, idf[1], "theme:" + t, 8)
        query = " ".join([q["text"] or "", " ".join(q["genres"] or [])])
        pd_ = sum((1.4 * dense(items[i - 1]["story"]) for i in liked), np.zeros(192)) + dense(query)
        own = np.array([ps.get(f, 0.0) for f in top])
        pl = sum((1.4 * latent[i] for i in liked if i in latent), np.zeros(axes.shape[1])) + (own / np.linalg.norm(own) @ axes if own.any() else 0)
        pv = sum((1.4 * vec[i] for i in liked if i in vec), np.zeros(2))
        votes = Counter()
        for i in liked:
            for a, b, s in NEIGHBOURS:
                if a == i:
                    votes[b] += round(s * 1e6)
        saved = bool(liked or q["session_genres"] or q["studios"] or q["staff"] or q["characters"] or q["voice_actors"])
        known = {t for x in (q["genres"] or []) + (q["excluded_genres"] or []) + (q["formats"] or []) for t in tok(x)} | set(hybrid.GENERIC)
        moved = q["novelty"] in ("less_famous", "mainstream")
        taste = saved or moved or any(t not in known for t in tok(q["text"]))
        active = {"metadata": bool(pm), "synopsis": bool(ps), "lsa": np.abs(pl).max() > 0, "semantic_embedding": pv.any(), "dense": pd_.any(), "creator": bool(pc), "collaborative": bool(votes), "quality": True, "session": saved, "novelty": moved}
        lg = [g.lower() for i in liked for g in items[i - 1]["genres"] or []]
        ls = [g.lower() for i in liked for g in items[i - 1]["studios"] or []]
        lc = [n.lower() for i in liked for n, role in items[i - 1]["staff"] or [] if roles(role)]
        lt = {(items[i - 1]["type"] or "").lower() for i in liked} - {""}
        clamp = lambda x: max(0.0, min(1.0, float(x)))
        ang = lambda a, b: clamp(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) if b is not None and np.any(a) and np.any(b) else 0.0
        for it in items:
            i = it["item_id"]
            members, pop = math.log1p(it["members"] or 0) / logm, it["popularity"]
            sure = members / (members + 0.35) if members else 0
            quality = clamp(0.7 * (mean * (1 - sure) + (it["score"] or 0) / 10 * sure) + 0.18 * members + 0.12 * (1 - math.log1p(pop) / logp if pop else 0))
            quality = clamp(0.65 * quality + 0.35 * bayes[i]) if i in bayes else quality
            fame = clamp(0.7 * members + 0.3 * (1 - math.log1p(pop) / logp if pop else 0))
            g = {x.lower() for x in it["genres"] or []}
            session = 0.0
            if not g & {x.lower() for x in q["excluded_genres"] or []}:
                wanted = {x.lower() for x in q["session_genres"] or []}
                session += 0.3 * len(g & wanted) / max(1, len(wanted)) + (0.28 * min(sum(lg.count(x) for x in g) / len(lg), 1) if lg else 0)
                session += 0.12 * min(sum(ls.count(x.lower()) for x in it["studios"] or []), 2) / 2 + 0.12 * min(sum(lc.count(n.lower()) for n, role in it["staff"] or [] if roles(role)), 2) / 2 + (0.08 if (it["type"] or "").lower() in lt else 0)
            s = {"metadata": cos(pm, meta[i]), "synopsis": cos(ps, story[i]), "lsa": ang(pl, latent.get(i)), "semantic_embedding": ang(pv, vec.get(i)), "dense": ang(pd_, dense(it["story"])), "creator": cos(pc, made[i]), "collaborative": votes[i] / max(votes.values()) if votes else 0.0,
                 "quality": quality, "session": clamp(session), "novelty": {"less_famous": 1 - fame, "mainstream": fame}.get(q["novelty"], 0.0)}
            if not taste:
                total = quality
            else:
                total = sum(hybrid.WEIGHTS[c] * s[c] for c in s if active[c]) / sum(hybrid.WEIGHTS[c] for c in s if active[c])
            out[u, i] = s, taste, total, active
    return out


@pytest.fixture(scope="module")
def signals(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(2)
    return hybrid.channel_signals(
        frame(REQUESTS, REQUEST), frame([*LIKES, LIKES[0], (999, 1)], "user_id long, item_id long"), frame(ITEMS, ITEM), frame(NEIGHBOURS, "item_id long, neighbor_id long, score double"), frame(BAYES, "item_id long, bayes double"), frame(VECTORS, "item_id long, vec array<double>"),
    )


def test_channels_and_total(signals):
    got = {(r.user_id, r.item_id): r for r in hybrid.blended(signals).collect()}
    want = plain()
    assert set(got) == set(want)
    for key, (s, taste, total, active) in want.items():
        r = got[key]
        assert r.personal == taste and {c: r[f"active_{c}"] for c in s} == {c: bool(v) for c, v in active.items()}, key
        assert all(math.isclose(r[c], s[c], abs_tol=1e-6) for c in s), (key, {c: (r[c], s[c]) for c in s if abs(r[c] - s[c]) > 1e-6})
        assert math.isclose(r.total, total, abs_tol=1e-6), key
    with pytest.raises(ValueError):
        hybrid.blended(signals, hybrid.WEIGHTS | {"lsa": -0.1})


def test_ranking_leaves_out_what_is_known_and_blocks_agree(spark, signals):
    known = spark.createDataFrame(LIKES, "user_id long, item_id long")
    top = hybrid.ranked(hybrid.blended(signals), known, 3).collect()
    assert not {(r.user_id, r.item_id) for r in top} & set(LIKES) and all(sum(r.user_id == u for r in top) == 3 for u in (100, 200, 300, 400))
    users, items = spark.range(25).withColumnRenamed("id", "user_id"), spark.range(4).withColumnRenamed("id", "item_id")
    assert sorted(map(tuple, against_all(users, items, 6).select("user_id", "item_id").collect())) == [(u, i) for u in range(25) for i in range(4)]


def test_weights_are_learned(spark):
    r = random.Random(1)
    d = [[r.uniform(-1, 1) + (0.6 if k == 2 else 0) for k in range(10)] for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in d], "d array<double>").repartition(3)
    w = np.full(10, 0.1)
    m = np.array(d)
    margin = m @ w
    loss, gradient, right = fusion.loss_and_gradient(df, w, 0.01)
    assert math.isclose(loss, np.log1p(np.exp(-margin)).mean()) and np.allclose(gradient, -(m / (1 + np.exp(margin))[:, None]).mean(0) + 0.01 * w) and math.isclose(right, (margin > 0).mean())
    step = 1e-6
    for k in range(10):
        up = w.copy()
        up[k] += step
        assert math.isclose((np.log1p(np.exp(-m @ up)).mean() + 0.005 * up @ up - loss - 0.005 * w @ w) / step, gradient[k], abs_tol=1e-4)
    fit = fusion.fit_weights(df, iterations=25)
    assert math.isclose(sum(fit.weights.values()), 1) and min(fit.weights.values()) >= 0 and max(fit.weights, key=fit.weights.get) == list(hybrid.WEIGHTS)[2] and fit.last_loss < fit.first_loss
    with pytest.raises(ValueError):
        fusion.fit_weights(df, start=hybrid.WEIGHTS | {"lsa": -1.0})
    with pytest.raises(ValueError):
        fusion.fit_weights(df.limit(0))


def test_pairs(spark):
    channels = list(hybrid.WEIGHTS)
    rows = spark.createDataFrame([(1, i, i / 20, *([i / 10] * 10)) for i in range(20)], ["user_id", "item_id", "total", *channels])
    frame = lambda rows: spark.createDataFrame(rows, "user_id long, item_id long")
    got = fusion.pairs(rows, frame([(1, 15), (1, 2), (1, 19)]), frame([(1, 18), (1, 19)]), shortlist=10, negatives=4).collect()
    assert {r.positive_id for r in got} == {15} and len(got) == 4 and all(8 <= r.negative_id <= 17 and np.allclose(r.d, [(15 - r.negative_id) / 10] * 10) for r in got)
