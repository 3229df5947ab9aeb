"""Ten-channel hybrid ranking: feature vectors, profiles, channel scores per (request, item), weights renormalised over active channels.

Sparse vectors are rows (id, feature, weight). Requests meet all items once, in blocks of some USERS users whose profiles are sent to the tasks, which
multiply them with their items' vectors; everything else joins by keys."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import scalar as S
from ..plans.session import durable
from ..plans.views import CATALOG, RATINGS, SPLIT, STATS, fact, run_sql
from .catalogue import _FOLDS, _STOP
from .neighbours import written_neighbours

#: Channels and their weights.
WEIGHTS = {"metadata": 0.16, "synopsis": 0.10, "lsa": 0.04, "semantic_embedding": 0.0, "dense": 0.08, "creator": 0.05, "collaborative": 0.22, "quality": 0.13, "session": 0.05, "novelty": 0.03}
#: Words of a request that say nothing about taste.
GENERIC = tuple("""anime show shows series something some want watch watching looking look recommend recommendation recommendations suggest give find please good great nice best short shorter
long longer new newer old older recent title titles like preferably i but no not me my would need really prefer any more else anything""".split())
#: The users whose profiles a task holds at once, and the most items of a partition.
USERS, PACKED = 256, 4096
SYNOPSIS_TOKENS, PEOPLE, PRODUCERS, LSA_FEATURES, LSA_WIDTH, DENSE_WIDTH = 360, 16, 4, 384, 48, 192
_GENERIC_SQL = ", ".join(f"'{w}'" for w in GENERIC)
#: Columns of items, all but item_id may be null.
ITEMS = "item_id, title, synopsis, genres, metadata_tokens, genre_groups, type, studios, staff, characters, voice_actors, producers, score, members, popularity"
#: Columns of requests, all but user_id may be null.
REQUESTS = "user_id, text, genres, session_genres, excluded_genres, formats, studios, staff, characters, voice_actors, novelty"


def label(x: Column) -> Column:
    return F.array_join(S.tokens(x), " ")


def _exploded(items: DataFrame, array: Column, feature: Callable[[Column], Column], weight: Column | float) -> DataFrame:
    rows = items.select("item_id", F.explode(array).alias("x"))
    return rows.where(F.col("x").isNotNull()).select("item_id", feature(F.col("x")).alias("feature"), (F.lit(weight) if isinstance(weight, float) else weight).alias("w"))


def _labelled(items: DataFrame, array: Column, prefix: str | Column, weight: float) -> DataFrame:
    rows = _exploded(items.withColumn("p", F.lit(prefix) if isinstance(prefix, str) else prefix), array, label, weight)
    return rows.where(F.col("feature") != "").withColumn("feature", F.concat(F.lit(f"{prefix}:"), "feature"))


def _summed(parts: list[DataFrame], key: str = "item_id") -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy(key, "feature").agg(F.sum("w").alias("w"))


def metadata_features(items: DataFrame) -> DataFrame:
    """(item_id, feature, w) of tokens, groups, genres, type, studios and the first people of each kind."""
    tokens = items.select("item_id", F.explode("metadata_tokens").alias("t")).select("item_id", label(F.replace("t", F.lit("_"), F.lit(" "))).alias("k"), "t").where("k <> ''")
    weight = F.when(F.col("t").rlike("^(genre|theme|demographic)_"), 8.0).when(F.col("t").startswith("type_"), 3.0).otherwise(2.0)
    groups = items.select("item_id", F.explode("genre_groups").alias("g", "v")).select("item_id", F.coalesce(F.nullif(label(F.col("g")), F.lit("")), F.lit("genre")).alias("g"), F.explode("v").alias("v")).select("item_id", "g", label(F.col("v")).alias("k")).where("k <> ''")
    words = _exploded(items, F.flatten(F.transform("genres", S.tokens)), lambda x: x, 2.0)
    first = lambda c: F.slice(c, 1, PEOPLE)
    return _summed([
        tokens.select("item_id", F.concat(F.lit("metadata:"), "k").alias("feature"), weight.alias("w")), groups.select("item_id", F.concat_ws(":", "g", "k").alias("feature"), F.lit(7.0).alias("w")), words,
        _labelled(items, F.col("genres"), "genre", 8.0), _labelled(items, F.array("type"), "type", 3.0), _labelled(items, F.col("studios"), "studio", 3.0),
        _labelled(items, F.transform(first("staff"), lambda p: p["name"]), "staff", 3.0), _labelled(items, first("characters"), "character", 3.0), _labelled(items, first("voice_actors"), "voice_actor", 3.0),
    ])


def selected_creators(items: DataFrame) -> DataFrame:
    """(item_id, name, roles) of staff with a creator's role."""
    people = items.select("item_id", F.explode("staff").alias("p")).select("item_id", F.col("p.name").alias("name"), L.creator_roles(F.col("p.role")).alias("roles"))
    return people.where((F.size("roles") > 0) & F.col("name").isNotNull())


def creator_features(items: DataFrame, least: int = 2) -> DataFrame:
    """Studios and people by role that occur at least `least` times in the catalogue, and the first producers."""
    studios = items.select("item_id", F.explode("studios").alias("x"))
    often = studios.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    people = selected_creators(items)
    known = people.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("name")
    roles = people.join(known, "name").select("item_id", label(F.col("name")).alias("k"), F.explode("roles").alias("role")).where("k <> ''")
    return _summed([
        studios.join(often.select("x"), "x").select("item_id", label(F.col("x")).alias("k")).where("k <> ''").select("item_id", F.concat(F.lit("studio:"), "k").alias("feature"), F.lit(4.0).alias("w")),
        roles.select("item_id", F.concat_ws(":", "role", "k").alias("feature"), F.lit(4.0).alias("w")), _labelled(items, F.slice("producers", 1, PRODUCERS), "producer", 0.45),
    ])


def _story(items: DataFrame) -> Column:
    return L.story_text(F.col("title"), F.col("synopsis"), F.coalesce("genres", F.array().cast("array<string>")))


def story_features(items: DataFrame) -> DataFrame:
    """Words of the title, the first words of the synopsis, themes of all."""
    same = lambda x: x
    return _summed([
        _exploded(items, S.tokens(F.col("title")), same, 1.6), _exploded(items, F.slice(S.tokens(F.col("synopsis")), 1, SYNOPSIS_TOKENS), same, 1.2),
        _exploded(items, L.story_themes(_story(items)), lambda x: F.concat(F.lit("theme:"), x), 6.0),
    ])


def idf_of(features: DataFrame, total: int) -> DataFrame:
    """(feature, idf): ln((1 + N) / (1 + items that have it)) + 1."""
    return features.groupBy("feature").agg((F.log((1 + total) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))


def weighted(features: DataFrame, idf: DataFrame) -> DataFrame:
    return features.join(idf, "feature").select("item_id", "feature", (F.col("w") * F.col("idf")).alias("w"))


def dense_features(texts: DataFrame, key: str, text: str, width: int = DENSE_WIDTH) -> DataFrame:
    """M3: (key, bucket, v): words 1, letter triples .18 of words of 5 and more, pairs .65, signed and hashed, of unit length."""
    t = texts.select(key, S.tokens(F.col(text)).alias("t"))
    words = t.select(key, F.explode("t").alias("f"))
    triples = words.where("length(f) >= 5").select(key, F.explode(F.transform(F.sequence(F.lit(1), F.length("f") - 2), lambda i: F.concat(F.lit("char:"), F.substring("f", i, F.lit(3))))).alias("f"))
    pairs = t.where("size(t) > 1").select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat(F.get("t", i - 1), F.lit("_"), F.get("t", i)))).alias("f"))
    counted = words.withColumn("w", F.lit(1.0)).unionByName(triples.withColumn("w", F.lit(0.18))).unionByName(pairs.withColumn("w", F.lit(0.65))).groupBy(key, "f").agg(F.sum("w").alias("w"))
    bucket = (F.crc32(F.col("f").cast("binary")) % width).cast("int")
    sign = F.when(F.crc32(F.concat(F.lit("sign:"), "f").cast("binary")) % 2 == 0, 1.0).otherwise(-1.0)
    v = counted.select(key, bucket.alias("bucket"), (sign * F.col("w")).alias("v")).groupBy(key, "bucket").agg(F.sum("v").alias("v"))
    return unit(v, key, "v")


def unit(rows: DataFrame, key: str, v: str) -> DataFrame:
    """Vectors of unit length; those of length 0 have no rows."""
    norm = F.sqrt(F.sum(F.col(v) * F.col(v)).over(W.partitionBy(key)))
    return rows.withColumn("_n", norm).where("_n > 0").withColumn(v, F.col(v) / F.col("_n")).drop("_n")


def lsa(story: DataFrame, features: int = LSA_FEATURES, width: int = LSA_WIDTH) -> tuple[DataFrame, np.ndarray, list[str]]:
    """Story vectors (weighted) -> latent vectors (item_id, k, v) of unit length, the components (features x width), the features.

    Only the `features` most weighty features count (ties by name); tasks sum the Gram matrix of their items' unit rows, which has
    features x features numbers however many items there are; it alone is decomposed on the driver."""
    top = [r.feature for r in story.groupBy("feature").agg(F.sum("w").alias("s")).orderBy(F.desc("s"), "feature").limit(features).collect()]
    spark = story.sparkSession
    if not top:
        return spark.createDataFrame([], "item_id long, k int, v double"), np.zeros((0, 0)), []
    numbers = spark.createDataFrame(list(enumerate(top)), "i int, feature string")
    rows = unit(story.join(F.broadcast(numbers), "feature").select("item_id", "i", "w"), "item_id", "w")
    rows = durable(rows.groupBy("item_id").agg(F.collect_list(F.struct("i", "w")).alias("x")).select("item_id", F.col("x.i").alias("i"), F.col("x.w").alias("w")))
    n = len(top)

    def matrix(pdf: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(pdf), n))
        for r, (i, w) in enumerate(zip(pdf["i"], pdf["w"], strict=True)):
            out[r, i] = w
        return out

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n))
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                m = matrix(pdf.iloc[at : at + 4096])
                total += m.T @ m
        yield pd.DataFrame({"i": np.arange(n), "row": list(total)})

    sums = rows.select("i", "w").mapInPandas(gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    total = np.zeros((n, n))
    for r in sums.collect():  # features x features numbers
        total[r.i, r.j] = r.x
    values, vectors = np.linalg.eigh(total)
    components = vectors[:, np.argsort(values)[::-1][: min(width, n)]]
    components = components * np.where(components[np.abs(components).argmax(0), np.arange(components.shape[1])] < 0, -1.0, 1.0)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = matrix(pdf) @ components
            yield pd.DataFrame({"item_id": np.repeat(pdf["item_id"].to_numpy(), v.shape[1]), "k": np.tile(np.arange(v.shape[1]), len(pdf)), "v": v.ravel()})

    return unit(rows.mapInPandas(project, "item_id long, k int, v double"), "item_id", "v"), components, top


def profile_of(likes: DataFrame, vectors: DataFrame, boosts: list[DataFrame], idf: DataFrame) -> DataFrame:
    """M4: (user_id, feature, w): the liked items' vectors and boosts (user_id, feature, w), the latter times the feature's idf (1 if unknown)."""
    own = likes.join(vectors, "item_id").select("user_id", "feature", "w")
    if boosts:
        more = reduce(DataFrame.unionByName, boosts)
        own = own.unionByName(more.join(idf, "feature", "left").select("user_id", "feature", (F.col("w") * F.coalesce("idf", F.lit(1.0))).alias("w")))
    return own.groupBy("user_id", "feature").agg(F.sum("w").alias("w"))


def _boost(requests: DataFrame, values: Column, weight: float, *prefixes: str) -> DataFrame:
    """Boosts of labels under each prefix; without a prefix, of the labels' words."""
    rows = requests.select("user_id", F.explode(values).alias("x"))
    if not prefixes:
        return rows.select("user_id", F.explode(S.tokens(F.col("x"))).alias("feature"), F.lit(weight).alias("w"))
    keyed = rows.select("user_id", label(F.col("x")).alias("k")).where("k <> ''")
    return keyed.select("user_id", F.explode(F.array(*(F.concat(F.lit(f"{p}:"), "k") for p in prefixes))).alias("feature"), F.lit(weight).alias("w"))


CREATOR_ROLES = ("director", "original creator", "creator", "series composition", "script", "music", "character design")


def profiles(requests: DataFrame, likes: DataFrame, metadata: DataFrame, story: DataFrame, creators: DataFrame, idfs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """M4: the three sparse profiles of each request."""
    distinct = lambda *c: F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in c)))
    genres, session = distinct("genres"), F.array_except(distinct("session_genres"), distinct("genres"))
    text = F.array("text")
    staff = F.col("staff")
    of_metadata = [_boost(requests, genres, 12.0, "genre"), _boost(requests, genres, 2.4), _boost(requests, session, 4.0, "genre"), _boost(requests, session, 0.8), _boost(requests, F.col("studios"), 8.0, "studio"), _boost(requests, staff, 8.0, "staff")]
    of_metadata += [_boost(requests, F.col("characters"), 8.0, "character"), _boost(requests, F.col("voice_actors"), 8.0, "voice_actor"), _boost(requests, text, 1.2)]
    themes = requests.select("user_id", F.explode(L.story_themes(F.coalesce("text", F.lit("")))).alias("t")).select("user_id", F.concat(F.lit("theme:"), "t").alias("feature"), F.lit(8.0).alias("w"))
    of_creators = [_boost(requests, F.col("studios"), 8.0, "studio"), _boost(requests, staff, 4.0, *CREATOR_ROLES), _boost(requests, staff, 4.0, "creator", "producer")]
    return {
        "metadata": profile_of(likes, metadata, of_metadata, idfs["metadata"]), "synopsis": profile_of(likes, story, [_boost(requests, text, 4.0), themes], idfs["synopsis"]),
        "creator": profile_of(likes, creators, of_creators, idfs["creator"]),
    }


def _sides(channel: str, profile: DataFrame, vectors: DataFrame, feature: str, p: str, v: str, length: bool = True) -> tuple[DataFrame, DataFrame]:
    """M2: both sides of a channel's products as (user_id or item_id, channel, f, w), f a 64-bit hash of channel and feature; of unit length for cosines."""
    key = F.xxhash64(F.lit(channel), F.col(feature).cast("string")).alias("f")

    def side(rows: DataFrame, id_: str, w: str) -> DataFrame:
        rows = rows.select(id_, feature, F.col(w).cast("double").alias("_w"))
        rows = unit(rows, id_, "_w") if length else rows
        return rows.select(id_, F.lit(channel).alias("channel"), key, F.col("_w").alias("w"))

    return side(profile, "user_id", p), side(vectors, "item_id", v)


def _products(mine: pd.DataFrame, channels: list[str], users: np.ndarray) -> dict:
    """Profiles of a block as entries sorted by f: keys, where each one's entries begin and end, users' places, weights."""
    mine = mine.sort_values("f", kind="stable")
    f = mine["f"].to_numpy(np.int64)
    keys, begin = np.unique(f, return_index=True)
    return {"keys": keys, "begin": np.append(begin, len(f)), "user": np.searchsorted(users, mine["user_id"].to_numpy(np.int64)), "w": mine["w"].to_numpy(float), "users": users, "channels": channels}


def _dots(block: dict, items: pd.DataFrame) -> dict[str, np.ndarray]:
    """channel -> items x users: sums of products over the features that both have."""
    n, sizes = len(block["users"]), items["f"].map(len).to_numpy()
    out = {c: np.zeros((len(items), n)) for c in block["channels"]}
    if not sizes.sum() or not len(block["keys"]):
        return out
    row, f, w, c = np.repeat(np.arange(len(items)), sizes), np.concatenate(items["f"].to_numpy()), np.concatenate(items["w"].to_numpy()), np.concatenate(items["c"].to_numpy())
    at = np.minimum(np.searchsorted(block["keys"], f), len(block["keys"]) - 1)
    met = block["keys"][at] == f
    for k, name in enumerate(block["channels"]):
        mine = met & (c == k)
        if mine.any():
            used, column = np.unique(at[mine], return_inverse=True)
            many = block["begin"][used + 1] - block["begin"][used]
            entry = np.repeat(block["begin"][used] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
            left, right = np.zeros((len(items), len(used))), np.zeros((len(used), n))
            np.add.at(left, (row[mine], column), w[mine])
            np.add.at(right, (np.repeat(np.arange(len(used)), many), block["user"][entry]), block["w"][entry])
            out[name] = left @ right
    return out


def positive(x: Column) -> Column:
    """F20"""
    return F.least(F.greatest(F.nanvl(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def informative(text: Column, genres: Column, excluded: Column, formats: Column) -> Column:
    """M9: whether a text says something that the filters don't say already: a word that is neither generic nor part of a genre or format."""
    none = F.array().cast("array<string>")
    known = F.flatten(F.transform(F.concat(*(F.coalesce(x, none) for x in (genres, excluded, formats))), S.tokens))
    return F.exists(S.tokens(F.coalesce(text, F.lit(""))), lambda t: ~t.isin(*GENERIC) & ~F.array_contains(known, t))


def quality_signal(items: DataFrame, collaborative: DataFrame) -> DataFrame:
    """M6: (item_id, quality, fame): the score shrunk to the mean by how well it is known, members, popularity; with the ratings' own
    Bayesian quality (item_id, bayes) where there is one. fame is what novelty turns round (M7)."""
    top = items.agg(F.log1p(F.greatest(F.max(F.coalesce("members", F.lit(0))), F.lit(1))).alias("m"), F.log1p(F.greatest(F.max(F.coalesce("popularity", F.lit(0))), F.lit(1))).alias("p"), F.coalesce(F.avg(F.col("score") / 10), F.lit(0.7)).alias("mean"))
    rows = items.select("item_id", "score", "members", "popularity").join(F.broadcast(top)).join(collaborative, "item_id", "left")
    members = F.log1p(F.coalesce("members", F.lit(0))) / F.col("m")
    sure = members / (members + 0.35)
    known = F.coalesce("popularity", F.lit(0)) > 0
    popular = F.when(known, 1 - F.log1p("popularity") / F.col("p")).otherwise(0.0)
    own = positive(0.70 * (F.col("mean") * (1 - sure) + F.coalesce("score", F.lit(0.0)) / 10 * sure) + 0.18 * members + 0.12 * popular)
    return rows.select("item_id", F.when(F.col("bayes").isNotNull(), positive(0.65 * own + 0.35 * F.col("bayes"))).otherwise(own).alias("quality"), positive(0.7 * members + 0.3 * popular).alias("fame"))


#: The sums that the session's signal is made of.
SESSION = ("preferred", "refused", "liked_genres", "liked_studios", "liked_creators", "liked_type")


def session_sides(requests: DataFrame, likes: DataFrame, items: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """M8: preferred and refused genres, and genres, studios, creators and types of what is liked, as products; liked genres by all that are."""
    none, fold = F.array().cast("array<string>"), lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower))
    slim = items.select("item_id", fold(F.col("genres")).alias("genres"), fold(F.col("studios")).alias("studios"), F.lower(F.coalesce("type", F.lit(""))).alias("type"))
    creators = selected_creators(items).select("item_id", F.lower("name").alias("x"))
    slim = durable(slim.join(creators.groupBy("item_id").agg(F.collect_set("x").alias("creators")), "item_id", "left").withColumn("creators", F.coalesce("creators", none)))
    liked = likes.join(items.select("item_id", F.transform(F.coalesce("genres", none), F.lower).alias("genres"), F.transform(F.coalesce("studios", none), F.lower).alias("studios"), F.lower(F.coalesce("type", F.lit(""))).alias("type")), "item_id")
    liked = durable(liked.join(creators.groupBy("item_id").agg(F.collect_list("x").alias("creators")), "item_id", "left").withColumn("creators", F.coalesce("creators", none)))
    counted = lambda c: liked.select("user_id", F.explode(c).alias("x")).groupBy("user_id", "x").agg(F.count(F.lit(1)).alias("w"))
    total = liked.groupBy("user_id").agg(F.greatest(F.sum(F.size("genres")), F.lit(1)).alias("n"))
    wanted = requests.select("user_id", fold(F.col("session_genres")).alias("preferred"), fold(F.col("excluded_genres")).alias("refused"))
    mine = {
        "preferred": (wanted.select("user_id", (1 / F.size("preferred")).alias("w"), F.explode("preferred").alias("x")), "genres"), "refused": (wanted.select("user_id", F.explode("refused").alias("x"), F.lit(1.0).alias("w")), "genres"),
        "liked_genres": (counted("genres").join(total, "user_id").select("user_id", "x", (F.col("w") / F.col("n")).alias("w")), "genres"), "liked_studios": (counted("studios"), "studios"), "liked_creators": (counted("creators"), "creators"),
        "liked_type": (liked.where("type <> ''").select("user_id", F.col("type").alias("x"), F.lit(1.0).alias("w")).distinct(), None),
    }
    of = lambda c: slim.select("item_id", (F.explode(c) if c else F.col("type")).alias("x"), F.lit(1.0).alias("v"))
    return [_sides(name, mine[name][0], of(mine[name][1]), "x", "w", "v", False) for name in SESSION]


def _session(d: dict[str, np.ndarray]) -> np.ndarray:
    score = 0.30 * d["preferred"] + 0.28 * np.minimum(d["liked_genres"], 1.0) + 0.12 * np.minimum(d["liked_studios"], 2) / 2 + 0.12 * np.minimum(d["liked_creators"], 2) / 2 + 0.08 * (d["liked_type"] > 0)
    return np.where(d["refused"] > 0, 0.0, np.clip(score, 0.0, 1.0))


def blended(rows: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """M5: rows with a signal per channel and the flags active_<channel> and personal -> with total. Weights are renormalised over the
    active channels; a request that says nothing about taste is ranked by quality alone."""
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    on = lambda c: F.when(F.col(f"active_{c}"), F.lit(float(weights[c]))).otherwise(0.0)
    all_ = reduce(Column.__add__, [on(c) for c in weights])
    mixed = reduce(Column.__add__, [on(c) * F.col(c) for c in weights])
    return rows.withColumn("total", F.when(F.col("personal"), F.coalesce(F.try_divide(mixed, all_), F.lit(0.0))).otherwise(F.col("quality")))


def channel_signals(requests: DataFrame, likes: DataFrame, items: DataFrame, neighbours: DataFrame, quality: DataFrame, embeddings: DataFrame | None, with_lsa: bool = True) -> DataFrame:
    """Every request against every item: user_id, item_id, the ten signals, active_<channel>, personal.

    requests (REQUESTS), likes (user_id, item_id), items (ITEMS), neighbours (item_id, neighbor_id, score), quality (item_id, bayes), embeddings
    (item_id, vec of equal length) or None. A channel without material for a request is inactive and 0."""
    requests, items = durable(requests), durable(items)
    likes = durable(likes.join(requests.select("user_id"), "user_id", "left_semi").distinct())
    total = items.count()
    raw = {"metadata": metadata_features(items), "synopsis": story_features(items), "creator": creator_features(items, 2 if total >= 100 else 1)}
    idfs = {k: durable(idf_of(durable(v), total)) for k, v in raw.items()}
    vectors = {k: durable(weighted(v, idfs[k])) for k, v in raw.items()}
    own = {k: durable(v) for k, v in profiles(requests, likes, vectors["metadata"], vectors["synopsis"], vectors["creator"], idfs).items()}
    sides = [_sides(k, own[k], vectors[k], "feature", "w", "w") for k in own]

    asked = requests.select("user_id", F.array_join(F.concat(F.array(F.coalesce("text", F.lit(""))), F.coalesce("genres", F.array().cast("array<string>"))), " ").alias("query"))
    dense = durable(dense_features(items.select("item_id", _story(items).alias("story")), "item_id", "story"))
    mine = likes.join(dense, "item_id").select("user_id", "bucket", (1.4 * F.col("v")).alias("v")).unionByName(dense_features(asked, "user_id", "query"))
    mine = durable(mine.groupBy("user_id", "bucket").agg(F.sum("v").alias("v")))
    own["dense"] = mine
    sides.append(_sides("dense", mine, dense, "bucket", "v", "v"))
    if with_lsa:
        latent, components, top = lsa(vectors["synopsis"])
        latent = durable(latent)
        rows = likes.join(latent, "item_id").select("user_id", "k", (1.4 * F.col("v")).alias("v"))
        if top:
            axes = requests.sparkSession.createDataFrame([(f, components[i].tolist()) for i, f in enumerate(top)], "feature string, axis array<double>")
            story = unit(own["synopsis"].join(F.broadcast(axes), "feature"), "user_id", "w")
            rows = rows.unionByName(story.select("user_id", F.posexplode("axis").alias("k", "a"), "w").groupBy("user_id", "k").agg(F.sum(F.col("a") * F.col("w")).alias("v")))
        mine = durable(rows.groupBy("user_id", "k").agg(F.sum("v").alias("v")))
        own["lsa"] = mine
        sides.append(_sides("lsa", mine, latent, "k", "v", "v"))
    if embeddings is not None:
        vec = durable(unit(embeddings.select("item_id", F.posexplode("vec").alias("k", "v")), "item_id", "v"))
        mine = durable(likes.join(vec, "item_id").groupBy("user_id", "k").agg(F.sum(1.4 * F.col("v")).alias("v")))
        own["semantic_embedding"] = mine
        sides.append(_sides("semantic_embedding", mine, vec, "k", "v", "v"))
    votes = likes.join(neighbours.select("item_id", "neighbor_id", "score"), "item_id").groupBy("user_id", F.col("neighbor_id").alias("item_id")).agg(F.sum(F.round(F.col("score") * 1000000).cast("long")).alias("vote"))
    votes = durable(votes.where("vote > 0"))
    own["collaborative"] = votes
    scaled = votes.select("user_id", "item_id", (F.col("vote") / F.max("vote").over(W.partitionBy("user_id"))).alias("w"))
    alone = items.select("item_id", F.col("item_id").alias("x"), F.lit(1.0).alias("v"))  # an item's only feature is itself
    sides.append(_sides("collaborative", scaled.withColumnRenamed("item_id", "x"), alone, "x", "w", "v", False))
    sides += session_sides(requests, likes, items)

    has = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    liked = likes.select("user_id").distinct().withColumn("liked", F.lit(True))
    saved = has("session_genres") | F.coalesce("liked", F.lit(False)) | has("studios") | has("staff") | has("characters") | has("voice_actors")
    head = requests.join(liked, "user_id", "left")
    for k, df in own.items():
        head = head.join(df.select("user_id").distinct().withColumn(f"active_{k}", F.lit(True)), "user_id", "left")
    flags = {f"active_{k}": F.coalesce(f"active_{k}", F.lit(False)) if k in own else F.lit(False) for k in ("metadata", "synopsis", "lsa", "semantic_embedding", "dense", "creator", "collaborative")}
    flags |= {"active_quality": F.lit(True), "active_session": saved, "active_novelty": F.coalesce(F.col("novelty").isin("less_famous", "mainstream"), F.lit(False))}
    taste = saved | informative(F.col("text"), F.col("genres"), F.col("excluded_genres"), F.col("formats")) | flags["active_novelty"]
    head = durable(head.select("user_id", F.coalesce("novelty", F.lit("neutral")).alias("novelty"), taste.alias("personal"), *(c.alias(k) for k, c in flags.items())))

    return _met(head, sides, [*own, *SESSION], quality_signal(items, quality))


def _met(head: DataFrame, sides: list[tuple[DataFrame, DataFrame]], channels: list[str], quality: DataFrame) -> DataFrame:
    """Every request of head with every item: packed items meet the profiles of a block of some USERS users, which are sent to the tasks, as
    matrices; no pair is shuffled or written. quality (item_id, quality, fame) has every item."""
    spark = head.sparkSession
    number = F.array_position(F.array(*map(F.lit, channels)), F.col("channel")).cast("int") - 1
    packed = reduce(DataFrame.unionByName, [v for _, v in sides]).groupBy("item_id").agg(F.collect_list(F.struct(number.alias("c"), "f", "w")).alias("x"))
    none = lambda t: F.array().cast(f"array<{t}>")
    items = quality.join(packed, "item_id", "left").select("item_id", "quality", "fame", F.coalesce("x.c", none("int")).alias("c"), F.coalesce("x.f", none("long")).alias("f"), F.coalesce("x.w", none("double")).alias("w"))
    items = durable(items.repartition(max(spark.sparkContext.defaultParallelism * 4, math.ceil(items.count() / PACKED))))
    blocks = max(1, math.ceil(head.count() / USERS))
    at = F.pmod(F.xxhash64("user_id"), F.lit(blocks))
    mine = durable(reduce(DataFrame.unionByName, [p for p, _ in sides]).withColumn("b", at).repartition("b"))
    flags = [f"active_{c}" for c in WEIGHTS]
    schema = ", ".join(["user_id long, item_id long", *(f"{c} double" for c in WEIGHTS), *(f"{c} boolean" for c in flags), "personal boolean"])

    def block(b: int) -> DataFrame | None:
        about = head.where(at == b).orderBy("user_id").toPandas()  # about USERS rows
        if about.empty:
            return None
        users = about["user_id"].to_numpy(np.int64)
        sent = spark.sparkContext.broadcast((_products(mine.where(F.col("b") == b).select("user_id", "f", "w").toPandas(), channels, users), about))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, about = sent.value
            n, novelty = len(about), about["novelty"].to_numpy()
            for whole in batches:
                for start in range(0, len(whole), 256):
                    pdf = whole.iloc[start : start + 256]
                    d = _dots(held, pdf)
                    fame = pdf["fame"].to_numpy(float)[:, None]
                    d = {c: np.clip(x, 0.0, 1.0) if c in WEIGHTS else x for c, x in d.items()}
                    d |= {"session": _session(d), "quality": np.repeat(pdf["quality"].to_numpy(float)[:, None], n, 1), "novelty": np.where(novelty == "less_famous", 1 - fame, np.where(novelty == "mainstream", fame, 0.0))}
                    zero = np.zeros((len(pdf), n))
                    out = {"user_id": np.tile(about["user_id"].to_numpy(), len(pdf)), "item_id": np.repeat(pdf["item_id"].to_numpy(), n), **{c: d.get(c, zero).ravel() for c in WEIGHTS}}
                    yield pd.DataFrame(out | {c: np.tile(about[c].to_numpy(bool), len(pdf)) for c in (*flags, "personal")})

        return items.mapInPandas(run, schema)

    met = [df for df in map(block, range(blocks)) if df is not None]
    return reduce(DataFrame.unionByName, met) if met else spark.createDataFrame([], schema)


def ranked(rows: DataFrame, known: DataFrame, k: int = 20) -> DataFrame:
    """The first k of each request, without what the user knows; ties by quality, then the smaller item."""
    left = rows.join(known, ["user_id", "item_id"], "left_anti")
    return left.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc(F.round("total", 9)), F.desc(F.round("quality", 9)), "item_id"))).where(F.col("rank") <= k)


# ---- the folder's requests: users with an id divisible by 100 against all items


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        rows = run_sql(spark, sf_dir, f"WITH {RATINGS}, {SPLIT}, {STATS}, {CATALOG} SELECT c.*, s.observed AS members, s.pop_rank AS popularity FROM catalog c LEFT JOIN ranked s ON c.item_id = s.item_id")
        texts = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(F.col("doc_id").alias("item_id")).agg(F.min("text").alias("synopsis"))
        people = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("p")).distinct()
        role = F.get(F.array(*map(F.lit, ("Director", "Music, Script", "Producer"))), (F.col("p") % 3).cast("int"))
        staff = people.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("p", F.concat(F.lit("person "), F.col("p").cast("string")).alias("name"), role.alias("role")))).alias("staff"))
        words = F.split(F.lower("type"), " ")
        none = F.array().cast("array<string>")
        return rows.join(texts, "item_id", "left").join(staff, "item_id", "left").select(
            "item_id", "title", "synopsis", words.alias("genres"), F.transform(words, lambda g: F.concat(F.lit("genre_"), g)).alias("metadata_tokens"), F.create_map(F.lit("Theme"), F.array(F.substring_index("title", " ", 1))).alias("genre_groups"), F.element_at(words, -1).alias("type"),
            F.array("studio").alias("studios"), "staff", none.alias("characters"), none.alias("voice_actors"), none.alias("producers"), "score", "members", "popularity",
        )

    return fact(spark, sf_dir, "hybrid_items", build)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    pick = lambda every, *values: F.get(F.array(*(F.lit(v) for v in values)), ((u / 100) % every).cast("int"))
    one = lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(F.array().cast("array<string>"))
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id")).where("user_id % 100 = 0")
    return users.select(
        u, pick(4, "a show about a secret school of dreams", "please recommend something good", "something blue").alias("text"), one(pick(5, "promo", "small")).alias("genres"), one(pick(3, "large")).alias("session_genres"), one(pick(7, "economy")).alias("excluded_genres"),
        F.array().cast("array<string>").alias("formats"), one(pick(6, "Brand#1", "Brand#3")).alias("studios"), one(pick(8, "person 3", "person 7")).alias("staff"), F.array().cast("array<string>").alias("characters"), F.array().cast("array<string>").alias("voice_actors"),
        pick(4, "neutral", "less_famous", "mainstream").alias("novelty"),
    )


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        likes = run_sql(spark, sf_dir, f"WITH {RATINGS}, {SPLIT} SELECT user_id, item_id FROM split WHERE fold = 'train' AND user_id % 300 <> 0")
        bayes = run_sql(spark, sf_dir, f"WITH {RATINGS}, {SPLIT}, {STATS} SELECT s.item_id, (s.total + 50 * m.mu) / (s.observed + 50) / 10 AS bayes FROM stats s, (SELECT sum(total) * 1e0 / sum(observed) AS mu FROM stats) m")
        vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vec")).where("vec is not null")
        return channel_signals(_requests(spark, sf_dir), likes, _catalogue(spark, sf_dir), written_neighbours(spark, sf_dir), bayes, vectors)

    return fact(spark, sf_dir, "hybrid_signals", build, written=True)  # a view: pairs are made where they are used


def hybrid_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, M4, M9: the ten signals of every hundredth user's request against all items, and the blended total."""
    return blended(_signals(spark, sf_dir)).select("user_id", "item_id", *(F.round(c, 5).alias(c) for c in WEIGHTS), "personal", F.round("total", 5).alias("total"))


def hybrid_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: the first twenty of every hundredth user's request."""
    known = F.broadcast(run_sql(spark, sf_dir, f"WITH {RATINGS} SELECT user_id, item_id FROM ratings WHERE user_id % 100 = 0"))
    return ranked(blended(_signals(spark, sf_dir)).select("user_id", "item_id", "total", "quality"), known).select("user_id", "item_id", F.round("total", 6).alias("total"), "rank")


def hybrid_without_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5 with the channels that SQL can express: metadata, creator, collaborative, quality, session, novelty; the others weigh nothing."""
    weights = WEIGHTS | {"synopsis": 0.0, "lsa": 0.0, "dense": 0.0, "semantic_embedding": 0.0}
    rows = blended(_signals(spark, sf_dir), weights)
    return rows.select("user_id", "item_id", *(F.round(c, 5).alias(c) for c in ("metadata", "creator", "collaborative", "quality", "session", "novelty")), "personal", F.round("total", 5).alias("total"))


_F = (hybrid_channels, hybrid_ranking, hybrid_without_text)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _F}

#: The channels without text in another way: every request meets every item, features as lists.
ORACLES: dict[str, str] = {
    "hybrid_without_text": f"""WITH {_FOLDS},
c AS (SELECT p_partkey AS i, p_name AS title, lower(p_type) AS ty, p_brand AS st, replace(lower(p_brand), '#', ' ') AS sk, round(p_retailprice / 200, 4) AS score FROM part),
po AS (SELECT i, likes, row_number() OVER (ORDER BY likes DESC, i) AS pop, quality FROM q), ob AS (SELECT i, count(*) AS members FROM tr GROUP BY i),
pe AS (SELECT DISTINCT l_partkey AS i, l_suppkey AS p FROM lineitem), ps AS (SELECT i, p FROM pe QUALIFY row_number() OVER (PARTITION BY i ORDER BY p) <= 16),
raw AS (SELECT i, 'metadata:genre ' || ty AS f, 8.0::DOUBLE AS w FROM c UNION ALL SELECT i, 'theme:' || split_part(title, ' ', 1), 7 FROM c UNION ALL SELECT i, 'genre:' || ty, 8 FROM c UNION ALL SELECT i, ty, 2 FROM c UNION ALL SELECT i, 'type:' || ty, 3 FROM c UNION ALL SELECT i, 'studio:' || sk, 3 FROM c
  UNION ALL SELECT i, 'staff:person ' || p, 3 FROM ps),
me AS (SELECT i, f, sum(w) AS w FROM raw GROUP BY i, f), mi AS (SELECT f, ln((1 + (SELECT count(*) FROM c)) / (1 + count(*))) + 1 AS idf FROM me GROUP BY f), mv AS (SELECT i, f, w * idf AS w FROM me JOIN mi USING (f)),
often AS (SELECT p FROM pe WHERE p % 3 < 2 GROUP BY p HAVING count(*) >= 2),
cr AS (SELECT i, 'studio:' || sk AS f, 4.0::DOUBLE AS w FROM c WHERE st IN (SELECT st FROM c GROUP BY st HAVING count(*) >= 2) UNION ALL SELECT i, unnest(CASE p % 3 WHEN 0 THEN ['director:person ' || p] ELSE ['music:person ' || p, 'script:person ' || p] END), 4 FROM pe JOIN often USING (p)),
ci AS (SELECT f, ln((1 + (SELECT count(*) FROM c)) / (1 + count(*))) + 1 AS idf FROM cr GROUP BY f), cv AS (SELECT i, f, w * idf AS w FROM cr JOIN ci USING (f)),
u AS (SELECT c_custkey AS u, CAST(floor(c_custkey / 100) AS BIGINT) AS k FROM customer WHERE c_custkey % 100 = 0),
rq AS (SELECT u, ['a show about a secret school of dreams', 'please recommend something good', 'something blue', NULL][k % 4 + 1] AS text, ['promo', 'small', NULL, NULL, NULL][k % 5 + 1] AS g, ['large', NULL, NULL][k % 3 + 1] AS sg, ['economy', NULL, NULL, NULL, NULL, NULL, NULL][k % 7 + 1] AS ex,
  ['Brand#1', 'Brand#3', NULL, NULL, NULL, NULL][k % 6 + 1] AS st, ['person 3', 'person 7', NULL, NULL, NULL, NULL, NULL, NULL][k % 8 + 1] AS sf, coalesce(['neutral', 'less_famous', 'mainstream', NULL][k % 4 + 1], 'neutral') AS nov FROM u),
li AS (SELECT u, i FROM f WHERE fold = 'l' AND u % 300 <> 0 AND u IN (SELECT u FROM u)),
tk AS (SELECT u, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM rq), ts AS (SELECT u, t FROM tk WHERE t NOT IN ({_STOP})),
bm AS (SELECT u, 'genre:' || g AS f, 12.0::DOUBLE AS w FROM rq WHERE g IS NOT NULL UNION ALL SELECT u, g, 2.4 FROM rq WHERE g IS NOT NULL UNION ALL SELECT u, 'genre:' || sg, 4 FROM rq WHERE sg IS NOT NULL UNION ALL SELECT u, sg, 0.8 FROM rq WHERE sg IS NOT NULL UNION ALL SELECT u, 'studio:' || replace(lower(st), '#', ' '), 8 FROM rq WHERE st IS NOT NULL
  UNION ALL SELECT u, 'staff:' || sf, 8 FROM rq WHERE sf IS NOT NULL UNION ALL SELECT u, t, 1.2 FROM ts),
bc AS (SELECT u, 'studio:' || replace(lower(st), '#', ' ') AS f, 8.0::DOUBLE AS w FROM rq WHERE st IS NOT NULL UNION ALL SELECT u, r || ':' || sf, 4 FROM rq, (SELECT unnest(['director', 'original creator', 'creator', 'series composition', 'script', 'music', 'character design', 'creator', 'producer']) AS r) WHERE sf IS NOT NULL),
pm AS (SELECT u, f, sum(w) AS w FROM (SELECT u, f, w FROM li JOIN mv USING (i) UNION ALL SELECT u, f, w * coalesce(idf, 1) FROM bm LEFT JOIN mi USING (f)) GROUP BY u, f), pc AS (SELECT u, f, sum(w) AS w FROM (SELECT u, f, w FROM li JOIN cv USING (i) UNION ALL SELECT u, f, w * coalesce(idf, 1) FROM bc LEFT JOIN ci USING (f)) GROUP BY u, f),
sm AS (SELECT u, i, greatest(0, least(1, sum(pm.w * mv.w) / any_value(a.n) / any_value(b.n))) AS s FROM pm JOIN mv USING (f) JOIN (SELECT u, sqrt(sum(w * w)) AS n FROM pm GROUP BY u) a USING (u) JOIN (SELECT i, sqrt(sum(w * w)) AS n FROM mv GROUP BY i) b USING (i) GROUP BY u, i),
sc AS (SELECT u, i, greatest(0, least(1, sum(pc.w * cv.w) / any_value(a.n) / any_value(b.n))) AS s FROM pc JOIN cv USING (f) JOIN (SELECT u, sqrt(sum(w * w)) AS n FROM pc GROUP BY u) a USING (u) JOIN (SELECT i, sqrt(sum(w * w)) AS n FROM cv GROUP BY i) b USING (i) GROUP BY u, i),
z AS (SELECT u, i, (x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 1) AS z FROM tr WINDOW w AS (PARTITION BY u)), m AS (SELECT i, sqrt(sum(z * z)) AS m FROM z GROUP BY i HAVING sqrt(sum(z * z)) > 1e-8),
s AS (SELECT a.i AS i, b.i AS j, round(sum(a.z / ma.m * b.z / mb.m), 6) AS s FROM z a JOIN z b ON a.u = b.u AND a.i <> b.i JOIN m ma ON ma.i = a.i JOIN m mb ON mb.i = b.i GROUP BY a.i, b.i), g AS (SELECT i, j, s FROM s WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY i ORDER BY s DESC, j) <= 200),
v AS (SELECT u, j AS i, sum(CAST(round(s * 1000000) AS BIGINT)) AS v FROM li JOIN g ON li.i = g.i GROUP BY u, j), co AS (SELECT u, i, v / max(v) OVER (PARTITION BY u) AS s FROM v),
it AS (SELECT c.*, ln(1 + coalesce(members, 0)) / ln(1 + max(members) OVER ()) AS m, CASE WHEN pop IS NULL THEN 0 ELSE 1 - ln(1 + pop) / ln(1 + max(pop) OVER ()) END AS pp, avg(score / 10) OVER () AS gm, quality / 10 AS bayes FROM c LEFT JOIN ob USING (i) LEFT JOIN po USING (i)),
qu AS (SELECT it.*, 0.7::DOUBLE * (gm * (1 - m / (m + 0.35::DOUBLE)) + score / 10 * m / (m + 0.35::DOUBLE)) + 0.18::DOUBLE * m + 0.12::DOUBLE * pp AS own, 0.7::DOUBLE * m + 0.3::DOUBLE * pp AS fame FROM it),
he AS (SELECT rq.*, EXISTS (SELECT 1 FROM li WHERE li.u = rq.u) AS liked FROM rq),
hh AS (SELECT *, liked OR sg IS NOT NULL OR st IS NOT NULL OR sf IS NOT NULL AS saved, (SELECT count(*) FROM ts WHERE ts.u = he.u AND t NOT IN ({_GENERIC_SQL}) AND t IS DISTINCT FROM g AND t IS DISTINCT FROM ex) > 0 AS says FROM he),
lt AS (SELECT li.u, c.ty, c.st, li.i FROM li JOIN c USING (i)),
fi AS (SELECT hh.*, qu.i, qu.ty, qu.st AS item_st, coalesce(0.65::DOUBLE * greatest(0, least(1, own)) + 0.35::DOUBLE * bayes, greatest(0, least(1, own))) AS quality, fame, coalesce(sm.s, 0) AS metadata, coalesce(sc.s, 0) AS creator, coalesce(co.s, 0) AS collaborative
  FROM hh CROSS JOIN qu LEFT JOIN sm ON sm.u = hh.u AND sm.i = qu.i LEFT JOIN sc ON sc.u = hh.u AND sc.i = qu.i LEFT JOIN co ON co.u = hh.u AND co.i = qu.i),
cl AS (SELECT li.u, p, count(*) AS n FROM li JOIN pe USING (i) WHERE p % 3 < 2 GROUP BY li.u, p), cs AS (SELECT u, i, sum(n) AS n FROM cl JOIN pe USING (p) GROUP BY u, i),
n AS (SELECT u, count(*) AS n FROM lt GROUP BY u), nt AS (SELECT u, ty, count(*) AS n FROM lt GROUP BY u, ty), ns AS (SELECT u, st, count(*) AS n FROM lt GROUP BY u, st),
x AS (SELECT fi.*, CASE WHEN ex = fi.ty THEN 0 ELSE least(1, 0.3::DOUBLE * CASE WHEN sg = fi.ty THEN 1 ELSE 0 END + 0.28::DOUBLE * coalesce(nt.n / n.n, 0) + 0.12::DOUBLE * least(coalesce(ns.n, 0), 2) / 2 + 0.12::DOUBLE * least(coalesce(cs.n, 0), 2) / 2 + CASE WHEN nt.n > 0 THEN 0.08::DOUBLE ELSE 0 END) END AS session,
  CASE nov WHEN 'less_famous' THEN 1 - fame WHEN 'mainstream' THEN fame ELSE 0 END AS novelty, EXISTS (SELECT 1 FROM pm WHERE pm.u = fi.u) AS am, EXISTS (SELECT 1 FROM pc WHERE pc.u = fi.u) AS ac, EXISTS (SELECT 1 FROM v WHERE v.u = fi.u) AS av
  FROM fi LEFT JOIN n ON n.u = fi.u LEFT JOIN nt ON nt.u = fi.u AND nt.ty = fi.ty LEFT JOIN ns ON ns.u = fi.u AND ns.st = fi.item_st LEFT JOIN cs ON cs.u = fi.u AND cs.i = fi.i),
y AS (SELECT *, saved OR says OR nov <> 'neutral' AS personal, CASE WHEN am THEN 0.16::DOUBLE ELSE 0 END AS wm, CASE WHEN ac THEN 0.05::DOUBLE ELSE 0 END AS wc, CASE WHEN av THEN 0.22::DOUBLE ELSE 0 END AS wv, CASE WHEN saved THEN 0.05::DOUBLE ELSE 0 END AS ws, CASE WHEN nov <> 'neutral' THEN 0.03::DOUBLE ELSE 0 END AS wn FROM x)
SELECT u AS user_id, i AS item_id, round(metadata, 5) AS metadata, round(creator, 5) AS creator, round(collaborative, 5) AS collaborative, round(quality, 5) AS quality, round(session, 5) AS session, round(novelty, 5) AS novelty, personal,
  round(CASE WHEN personal THEN (wm * metadata + wc * creator + wv * collaborative + 0.13::DOUBLE * quality + ws * session + wn * novelty) / (wm + wc + wv + 0.13::DOUBLE + ws + wn) ELSE quality END, 5) AS total FROM y""",
}
