"""Typed requests: JSON intents checked against a grammar with reasons for refusal, compiled to catalogue queries, and relaxed where nothing is found.

Requests are rows. Values are read as variants, so a number in quotes or a list with an object isn't taken for what it isn't. A batch of requests
meets the items in blocks, once, whatever the requests ask; a request's predicates are one bit each."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..plans.rank import against_all
from ..plans.session import durable
from ..plans.views import CATALOG, run_sql

#: The grammar.
INTENTS = ("recommend", "rank_catalog", "search", "details", "update_preferences", "conversational")
RETRIEVAL = ("recommend", "rank_catalog", "search")
RANK_FIELDS = ("score", "popularity", "rank", "members", "start_year", "title")
NOVELTY, ORDERS = ("neutral", "less_famous", "mainstream"), ("asc", "desc")
LISTS = (
    "reference_titles", "include_genres", "exclude_genres", "required_studios", "preferred_studios", "required_staff", "preferred_staff", "required_characters",
    "preferred_characters", "required_voice_actors", "preferred_voice_actors", "formats", "excluded_titles", "seen_titles",
)
NUMBERS = {"min_score": (0.0, 10.0), "min_year": (1900, 2100), "max_year": (1900, 2100), "max_episodes": (1, 100000), "top_k": (1, 50)}
BOOLEANS, INDEXES = ("exclude_related_series", "one_per_series"), ("reference_result_indices", "watched_result_indices")
OBJECTS = {"entity_mentions": ("text", "entity_type", "relation", "index"), "inferred_constraints": ("field", "value", "confidence", "source_text")}
FIELDS = ("intent", "catalog_query", "rank_by", "sort_order", "free_text_preferences", "novelty_preference", "preference_update", *LISTS, *NUMBERS, *BOOLEANS, *INDEXES, *OBJECTS)
UPDATES = ("liked_titles", "disliked_titles", "watched_titles", "excluded_titles", "preferred_genres", "excluded_genres")
ENTITIES = ("anime", "character", "staff", "director", "original_creator", "studio", "producer", "voice_actor", "genre", "theme", "demographic", "result_index")
RELATIONS = ("direct", "reference", "exclude", "watched", "director_of", "related_to")
INFERRED = ("max_episodes", "min_score", "min_year", "max_year")
#: What may be relaxed, what costs least to lose first.
LADDER = ("min_score", "max_episodes", "min_year", "max_year", "formats", "preferred_studios", "preferred_staff", "preferred_voice_actors", "preferred_characters", "exclude_genres", "include_genres")
MOST_ENTRIES, MOST_CHARS = 50, 240


def _kind(v: Column, path: str) -> Column:
    """The type of a variant's value as SQL spells it; VOID for null, SQL null where nothing stands."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _given(v: Column, field: str) -> Column:
    """Whether a field holds something: not null, not an empty text."""
    return F.coalesce((_kind(v, f"$.{field}") != "VOID") & ~((_kind(v, f"$.{field}") == "STRING") & (F.try_variant_get(v, f"$.{field}", "string") == "")), F.lit(False))


def _strings(v: Column, field: str) -> Column:
    """The list's texts, trimmed, without empty ones and repeats in other capitals, cut to MOST_CHARS and MOST_ENTRIES."""
    raw = F.coalesce(F.try_variant_get(v, f"$.{field}", "array<string>"), F.array().cast("array<string>"))
    clean = F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x != "")  # noqa: PLW0108  trim would take the place as its second argument
    once = F.filter(clean, lambda x, i: ~F.exists(F.slice(clean, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))
    return F.slice(F.transform(once, lambda x: F.left(x, F.lit(MOST_CHARS))), 1, MOST_ENTRIES)


def _canonical(values: Column, known: list[str]) -> Column:
    """Values as the catalogue spells them; unknown ones go. With no catalogue all stay."""
    if not known:
        return values
    spelt = F.create_map(*(x for k in known for x in (F.lit(k.lower()), F.lit(k))))
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.try_element_at(spelt, F.lower(x))), lambda x: x.isNotNull()))


def _word(v: Column, field: str, default: str | None) -> Column:
    text = F.lower(F.trim(F.try_variant_get(v, f"$.{field}", "string")))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default).cast("string"))


def parsed_intents(rows: DataFrame, text: str, genres: list[str] | None = None, formats: list[str] | None = None) -> DataFrame:
    """Rows with `refused` (the first reason, or null) and `intent`, a struct of typed fields (null if refused). The JSON object may be
    fenced or stand inside other text."""
    rows = rows.withColumn("_v", F.try_parse_json(L.json_object(F.col(text))))
    v = F.col("_v")
    top = F.schema_of_variant(v)
    keys = F.json_object_keys(F.to_json(v))
    unknown = F.array_sort(F.array_except(keys, F.array(*map(F.lit, FIELDS))))
    checks: list[tuple[Column, Column]] = [
        (v.isNull() | ~F.coalesce(top.startswith("OBJECT"), F.lit(False)), F.lit("no JSON object")),
        (F.size(unknown) > 0, F.concat(F.lit("unknown fields: "), F.array_join(unknown, ", "))),
        (~F.coalesce(_word(v, "intent", "").isin(*INTENTS), F.lit(False)), F.concat(F.lit("unsupported intent: "), F.coalesce(F.nullif(_word(v, "intent", ""), F.lit("")), F.lit("<empty>")))),
    ]
    for f in LISTS:
        kind = _kind(v, f"$.{f}")
        checks.append((_given(v, f) & ~kind.startswith("ARRAY"), F.lit(f"{f} must be an array")))
        whole = F.coalesce(F.try_variant_get(v, f"$.{f}", "array<variant>"), F.array().cast("array<variant>"))
        checks.append((_given(v, f) & F.exists(whole, lambda x: F.schema_of_variant(x) != "STRING"), F.lit(f"{f} must contain only strings")))
    for f, (low, high) in NUMBERS.items():
        kind, value = _kind(v, f"$.{f}"), F.try_variant_get(v, f"$.{f}", "double")
        whole = F.lit(True) if f == "min_score" else value == F.floor(value)
        checks.append((_given(v, f) & ((kind == "BOOLEAN") | value.isNull() | ~F.coalesce(whole, F.lit(False))), F.lit(f"{f} must be a number" if f == "min_score" else f"{f} must be a whole number")))
        checks.append((_given(v, f) & ((value < low) | (value > high)), F.lit(f"{f} must be between {low:g} and {high:g}")))
    year = lambda f: F.try_variant_get(v, f"$.{f}", "double")
    checks.append((F.coalesce(year("min_year") > year("max_year"), F.lit(False)), F.lit("min_year cannot be greater than max_year")))
    for f, allowed, default in (("novelty_preference", NOVELTY, "neutral"), ("rank_by", RANK_FIELDS, "score"), ("sort_order", ORDERS, None)):
        word = _word(v, f, default)
        checks.append((word.isNotNull() & ~word.isin(*allowed), F.concat(F.lit(f"unsupported {f}: "), word)))
    for f in BOOLEANS:
        checks.append((_given(v, f) & (_kind(v, f"$.{f}") != "BOOLEAN"), F.lit(f"{f} must be true or false")))
    for f in INDEXES:
        entries = F.coalesce(F.try_variant_get(v, f"$.{f}", "array<variant>"), F.array().cast("array<variant>"))
        bad = F.exists(entries, lambda x: (F.schema_of_variant(x) != "BIGINT") | (F.try_variant_get(x, "$", "long") < 1))
        checks.append((_given(v, f) & (~_kind(v, f"$.{f}").startswith("ARRAY") | bad), F.lit(f"{f} must be an array of whole numbers from 1")))
    for f, allowed in OBJECTS.items():
        entries = F.coalesce(F.try_variant_get(v, f"$.{f}", "array<variant>"), F.array().cast("array<variant>"))
        kind = F.schema_of_variant
        loose = F.exists(entries, lambda x: ~kind(x).startswith("OBJECT") & ~((kind(x) == "STRING") & F.lit(f == "entity_mentions")))
        known = F.array(*map(F.lit, allowed))
        more = F.exists(entries, lambda x: F.coalesce(F.size(F.array_except(F.json_object_keys(F.to_json(x)), known)) > 0, F.lit(False)))  # noqa: B023
        checks.append((_given(v, f) & (~_kind(v, f"$.{f}").startswith("ARRAY") | loose | more), F.lit(f"{f} has entries that don't fit")))
    of = lambda x, p, t: F.try_variant_get(x, f"$.{p}", t)
    mentions = F.coalesce(F.try_variant_get(v, "$.entity_mentions", "array<variant>"), F.array().cast("array<variant>"))
    as_object = lambda x: F.schema_of_variant(x).startswith("OBJECT")
    checks.append((F.exists(mentions, lambda x: as_object(x) & (~F.coalesce(F.lower(of(x, "entity_type", "string")), F.lit("anime")).isin(*ENTITIES) | ~F.coalesce(F.lower(of(x, "relation", "string")), F.lit("direct")).isin(*RELATIONS))), F.lit("entity_mentions has an unsupported type or relation")))
    inferred = F.coalesce(F.try_variant_get(v, "$.inferred_constraints", "array<variant>"), F.array().cast("array<variant>"))
    unfit = lambda x: ~F.coalesce(of(x, "field", "string").isin(*INFERRED) & of(x, "value", "double").isNotNull() & of(x, "confidence", "double").between(0, 1), F.lit(False))
    checks.append((F.exists(inferred, unfit), F.lit("inferred_constraints has an unsupported field, value or confidence")))
    update = F.json_object_keys(F.to_json(F.try_variant_get(v, "$.preference_update", "variant")))
    checks.append((_given(v, "preference_update") & (~_kind(v, "$.preference_update").startswith("OBJECT") | (F.size(F.array_except(update, F.array(*map(F.lit, UPDATES)))) > 0)), F.lit("preference_update has fields that don't fit")))
    refused = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), reason) for c, reason in checks))

    number = lambda f, t: F.try_variant_get(v, f"$.{f}", "double").cast(t)
    lists = {f: _strings(v, f) for f in LISTS}
    lists |= {"include_genres": _canonical(lists["include_genres"], genres or []), "exclude_genres": _canonical(lists["exclude_genres"], genres or []), "formats": _canonical(lists["formats"], formats or [])}
    text_of = lambda f, n: F.left(F.trim(F.coalesce(F.try_variant_get(v, f"$.{f}", "string"), F.lit(""))), F.lit(n))
    entry = lambda x: F.struct(
        F.trim(F.when(as_object(x), of(x, "text", "string")).otherwise(F.try_variant_get(x, "$", "string"))).alias("text"),
        F.coalesce(F.when(as_object(x), F.lower(of(x, "entity_type", "string"))), F.lit("anime")).alias("entity_type"), F.coalesce(F.when(as_object(x), F.lower(of(x, "relation", "string"))), F.lit("direct")).alias("relation"), F.when(as_object(x), of(x, "index", "int")).alias("index"),
    )
    intent = F.struct(
        _word(v, "intent", "").alias("intent"), text_of("catalog_query", 300).alias("catalog_query"), _word(v, "rank_by", "score").alias("rank_by"), _word(v, "sort_order", None).alias("sort_order"), text_of("free_text_preferences", 1200).alias("free_text_preferences"),
        _word(v, "novelty_preference", "neutral").alias("novelty_preference"), *(c.alias(f) for f, c in lists.items()), number("min_score", "double").alias("min_score"), *(number(f, "int").alias(f) for f in ("min_year", "max_year", "max_episodes")),
        F.coalesce(number("top_k", "int"), F.lit(10)).alias("top_k"), *(F.coalesce(F.try_variant_get(v, f"$.{f}", "boolean"), F.lit(True)).alias(f) for f in BOOLEANS), *(F.coalesce(F.try_variant_get(v, f"$.{f}", "array<int>"), F.array().cast("array<int>")).alias(f) for f in INDEXES),
        F.transform(F.slice(mentions, 1, 30), entry).alias("entity_mentions"),
        F.transform(inferred, lambda x: F.struct(of(x, "field", "string").alias("field"), of(x, "value", "double").alias("value"), of(x, "confidence", "double").alias("confidence"))).alias("inferred_constraints"),
    )
    return rows.withColumn("refused", refused).withColumn("intent", F.when(F.col("refused").isNull(), intent)).drop("_v")


def _folded(c: Column) -> Column:
    return F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)


#: What `_failed` looks at of an item.
FACTS = ("genres", "type", "studios", "score", "year", "episodes")


def _small(items: DataFrame) -> DataFrame:
    """Items with their lists and type in small letters, so that no pair has to fold them."""
    return items.withColumns({"genres": _folded(F.col("genres")), "studios": _folded(F.col("studios")), "type": F.lower("type")})


def _wishes(i: Column) -> Column:
    """What `_failed` looks at of an intent, lists in small letters."""
    return F.struct(*(i[f].alias(f) for f in ("min_score", "max_episodes", "min_year", "max_year")), *(_folded(i[f]).alias(f) for f in ("formats", "exclude_genres", "include_genres", "required_studios")))


def _failed(w: Column) -> dict[str, Column]:
    """field -> whether an item (folded genres, type and studios; score, year, episodes) fails what wishes ask of it; a null of the item fails."""
    fails = lambda c: ~F.coalesce(c, F.lit(False))
    asked = lambda f: F.size(w[f]) > 0
    return {
        "min_score": w["min_score"].isNotNull() & fails(F.col("score") >= w["min_score"]), "max_episodes": w["max_episodes"].isNotNull() & fails(F.col("episodes") <= w["max_episodes"]),
        "min_year": w["min_year"].isNotNull() & fails(F.col("year") >= w["min_year"]), "max_year": w["max_year"].isNotNull() & fails(F.col("year") <= w["max_year"]),
        "formats": asked("formats") & fails(F.array_contains(w["formats"], F.col("type"))), "exclude_genres": asked("exclude_genres") & F.arrays_overlap("genres", w["exclude_genres"]),
        "include_genres": asked("include_genres") & ~F.arrays_overlap("genres", w["include_genres"]), "required_studios": asked("required_studios") & (F.size(F.array_except(w["required_studios"], F.col("studios"))) > 0),
    }


def _classes(asked: DataFrame, *same: str) -> tuple[DataFrame, DataFrame]:
    """asked (request_id, same ...) -> (user_id, same ...): equal requests once, under the smallest id of them; and (request_id, user_id)."""
    once = durable(asked.groupBy(*same).agg(F.min("request_id").alias("user_id")))
    key = F.sha2(F.to_json(F.struct(*same), {"ignoreNullFields": "false"}), 256)
    return once, asked.select("request_id", key.alias("_k")).join(once.select("user_id", key.alias("_k")), "_k").select("request_id", "user_id")


def relaxed(requests: DataFrame, items: DataFrame, steps: int = 2) -> DataFrame:
    """Requests (request_id, intent, protected: fields) -> request_id, found, dropped: the fields given up, in order.

    An empty result gives up the ladder's first field that the request uses and that isn't protected, then the next, `steps` at most. Every item
    is looked at once: the bits of what it fails say after which step it would be found. Equal requests meet equal items once."""
    if steps < 0:
        raise ValueError("steps cannot be negative")
    i = F.col("intent")
    used = {f: F.size(i[f]) > 0 if f in LISTS else i[f].isNotNull() for f in LADDER}
    free = F.array_compact(F.array(*(F.when(used[f] & ~F.array_contains(F.coalesce("protected", F.array().cast("array<string>")), f), f) for f in LADDER)))
    can = F.when(i["intent"].isin(*RETRIEVAL), F.slice(free, 1, steps)).otherwise(F.array().cast("array<string>")) if steps else F.array().cast("array<string>")
    every = durable(requests.select("request_id", _wishes(i).alias("wishes"), can.alias("ladder")))
    asked, who = _classes(every, "wishes", "ladder")
    kinds = durable(_small(items).groupBy(*FACTS).agg(F.count(F.lit(1)).alias("n")))  # items that are equal in all this, once
    failed = F.array_compact(F.array(*(F.when(c, f) for f, c in _failed(F.col("wishes")).items())))
    left = against_all(asked, kinds).select("user_id", "ladder", "n", failed.alias("failed")).select("user_id", "n", F.array_max(F.transform("failed", lambda f: F.coalesce(F.nullif(F.array_position("ladder", f), F.lit(0)), F.lit(99)))).alias("step"))
    step = F.coalesce("step", F.lit(0)).cast("int")  # the step after which the item is found; 99 never
    counts = left.groupBy("user_id").agg(*(F.sum(F.when(step <= k, F.col("n"))).alias(f"n{k}") for k in range(steps + 1)))
    rows = asked.join(counts, "user_id", "left")
    n = lambda k: F.coalesce(F.col(f"n{k}"), F.lit(0))
    taken = reduce(lambda a, k: F.when((n(k) > 0) | (F.size("ladder") <= k), F.lit(k)).otherwise(a), range(steps - 1, -1, -1), F.lit(steps))
    rows = rows.withColumn("taken", taken)
    found = reduce(lambda a, k: F.when(F.col("taken") == k, n(k)).otherwise(a), range(steps + 1), F.lit(0).cast("long"))
    return who.join(rows.select("user_id", found.alias("found"), F.slice("ladder", F.lit(1), F.col("taken")).alias("dropped")), "user_id").select("request_id", "found", "dropped")


def answered(requests: DataFrame, items: DataFrame) -> DataFrame:
    """N1 compiled, K2: requests (request_id, intent) that retrieve -> their first top_k items by rank_by: request_id, item_id, rank. What an item lacks
    stands last in either direction; popularity, rank and title go upwards unless told; ties by title, then the smaller item. Equal requests are answered once."""
    i = F.col("intent")
    fields = F.struct(*(i[f].alias(f) for f in ("rank_by", "sort_order", "top_k")), F.lower(i["catalog_query"]).alias("catalog_query"))
    every = durable(requests.where(i["intent"].isin(*RETRIEVAL)).select("request_id", _wishes(i).alias("wishes"), fields.alias("intent")))
    asked, who = _classes(every, "wishes", "intent")
    most = asked.agg(F.max(i["top_k"])).first()[0] or 0
    met = against_all(asked, _small(items)).where(~reduce(Column.__or__, _failed(F.col("wishes")).values()))
    met = met.where((i["catalog_query"] == "") | F.contains(F.lower("title"), i["catalog_query"]))
    numbers = {"score": F.col("score"), "popularity": F.col("popularity"), "rank": F.col("popularity"), "members": F.col("members"), "start_year": F.col("year")}
    number = F.coalesce(*(F.when(i["rank_by"] == f, c.cast("double")) for f, c in numbers.items()))
    up = F.coalesce(i["sort_order"], F.when(i["rank_by"].isin("popularity", "rank", "title"), "asc").otherwise("desc")) == "asc"
    by_title = i["rank_by"] == "title"
    missing = F.when(by_title, F.col("title").isNull()).otherwise(number.isNull())
    order = [missing, F.when(~by_title, F.when(up, number).otherwise(-number)), F.when(by_title & up, F.col("title")).asc(), F.when(by_title & ~up, F.col("title")).desc(), F.lower("title").asc(), F.col("item_id").asc()]
    place = F.row_number().over(W.partitionBy("user_id").orderBy(*order))
    best = met.withColumn("rank", place).where((F.col("rank") <= most) & (F.col("rank") <= i["top_k"]))  # the first bound holds before rows are sorted
    return who.join(best.select("user_id", "item_id", "rank"), "user_id").select("request_id", "item_id", "rank")


# ---- requests made of conversation turns

#: What a model might answer; %y is a year, %e a number of episodes. The last ones are to be refused.
TEMPLATES = (
    '{"intent":"recommend","include_genres":["promo"," BLUE","blue"],"min_year":%y,"top_k":5}',
    'Sure!\n```json\n{"intent":"rank_catalog","rank_by":"start_year","sort_order":"asc","formats":["Small"],"max_episodes":%e}\n```',
    '{"intent":"search","catalog_query":"a","min_score":4.9,"max_year":%y,"exclude_genres":["anvil"],"required_studios":["Brand#1"]}',
    '{"intent":"recommend","min_score":4.999,"min_year":2024,"formats":["medium"],"include_genres":["nothing"]}',
    '{"intent":"conversational","min_score":5}',
    '{"intent":"rank_catalog","rank_by":"title","top_k":3,"min_score":4.99,"entity_mentions":["One",{"text":"Two","entity_type":"staff"}]}',
    '{"intent":"recommend","mood":"dark","colour":1}', '{"intent":"dance"}', '{"intent":"search","min_year":"soon"}', '{"intent":"search","min_score":11}', '{"intent":"search","min_year":2010,"max_year":2000}', '{"intent":"search","formats":"TV"}', "no answer",
    '{"intent":"recommend","rank_by":"fame"}', '{"intent":"recommend","include_genres":["x",3]}', '{"intent":"recommend","one_per_series":"yes"}', '{"intent":"recommend","top_k":2.5}', '{"intent":"recommend","entity_mentions":[{"text":"x","relation":"friend"}]}',
)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "conv_id", "turn").distinct()
    k = F.pmod(F.col("conv_id") * 5 + F.col("turn"), F.lit(len(TEMPLATES))).cast("int")
    text = F.replace(F.replace(F.get(F.array(*map(F.lit, TEMPLATES)), k), F.lit("%y"), (1960 + F.col("conv_id") % 60).cast("string")), F.lit("%e"), (F.col("turn") + 1).cast("string"))
    return turns.select("request_id", k.alias("k"), text.alias("text"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, f"WITH {CATALOG} SELECT * FROM catalog")
    return rows.select("item_id", "title", F.concat(F.split(F.lower("type"), " "), F.split(F.lower("title"), " ")).alias("genres"), F.element_at(F.split("type", " "), -1).alias("type"), F.array("studio").alias("studios"), "score", "year", "episodes", F.col("item_id").alias("popularity"), F.col("episodes").alias("members"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_intents(_asked(spark, sf_dir), "text")


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's answer as a typed request, or why it's refused."""
    i = F.col("intent")
    return _parsed(spark, sf_dir).select("request_id", "refused", i["intent"].alias("kind"), i["rank_by"].alias("rank_by"), F.array_join(i["include_genres"], "|").alias("genres"), i["min_year"].alias("min_year"), i["max_episodes"].alias("max_episodes"), i["min_score"].alias("min_score"), i["top_k"].alias("top_k"), F.size(i["entity_mentions"]).alias("mentions"))


def _hundredths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted requests with an id divisible by 100: conversations' first turns."""
    return _parsed(spark, sf_dir).where("refused is null and request_id % 100 = 0")


def relaxation_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the accepted requests with an id divisible by 100 find among all items, and what they give up for it; the year is protected in even conversations."""
    protected = F.when(F.floor(F.col("request_id") / 1000) % 2 == 0, F.array(F.lit("min_year"))).otherwise(F.array().cast("array<string>"))
    return relaxed(_hundredths(spark, sf_dir).withColumn("protected", protected), _items(spark, sf_dir)).select("request_id", "found", F.array_join("dropped", ",").alias("dropped"))


def request_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that the accepted requests with an id divisible by 100 get."""
    return answered(_hundredths(spark, sf_dir), _items(spark, sf_dir))


_F = (intents, relaxation_ladder, request_answers)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _F}

#: What each template comes to, by hand.
_EXPECTED = """t AS (SELECT DISTINCT conv_id * 1000 + turn AS request_id, (conv_id * 5 + turn) % 18 AS k, 1960 + conv_id % 60 AS y, turn + 1 AS e, conv_id FROM conversations),
x(k, refused, kind, rank_by, genres, min_score, top_k, mentions) AS (VALUES (0, NULL, 'recommend', 'score', 'promo|BLUE', NULL, 5, 0), (1, NULL, 'rank_catalog', 'start_year', '', NULL, 10, 0), (2, NULL, 'search', 'score', '', 4.9, 10, 0), (3, NULL, 'recommend', 'score', 'nothing', 4.999, 10, 0),
  (4, NULL, 'conversational', 'score', '', 5, 10, 0), (5, NULL, 'rank_catalog', 'title', '', 4.99, 3, 2), (6, 'unknown fields: colour, mood', NULL, NULL, NULL, NULL, NULL, NULL), (7, 'unsupported intent: dance', NULL, NULL, NULL, NULL, NULL, NULL), (8, 'min_year must be a whole number', NULL, NULL, NULL, NULL, NULL, NULL),
  (9, 'min_score must be between 0 and 10', NULL, NULL, NULL, NULL, NULL, NULL), (10, 'min_year cannot be greater than max_year', NULL, NULL, NULL, NULL, NULL, NULL), (11, 'formats must be an array', NULL, NULL, NULL, NULL, NULL, NULL), (12, 'no JSON object', NULL, NULL, NULL, NULL, NULL, NULL),
  (13, 'unsupported rank_by: fame', NULL, NULL, NULL, NULL, NULL, NULL), (14, 'include_genres must contain only strings', NULL, NULL, NULL, NULL, NULL, NULL), (15, 'one_per_series must be true or false', NULL, NULL, NULL, NULL, NULL, NULL), (16, 'top_k must be a whole number', NULL, NULL, NULL, NULL, NULL, NULL),
  (17, 'entity_mentions has an unsupported type or relation', NULL, NULL, NULL, NULL, NULL, NULL)),
c AS (SELECT p_partkey AS i, p_name AS title, list_concat(string_split(lower(p_type), ' '), string_split(lower(p_name), ' ')) AS gs, lower(string_split(p_type, ' ')[-1]) AS ty, p_brand AS st, round(p_retailprice / 200, 4) AS score, 1950 + p_partkey % 75 AS year, p_size AS ep FROM part)"""
_MEETS = f"""{_EXPECTED}, a AS (SELECT * FROM t WHERE request_id % 100 = 0 AND k < 6),
m AS (SELECT a.*, c.*, list_filter([CASE WHEN k = 2 AND score < 4.9::DOUBLE OR k = 3 AND score < 4.999::DOUBLE OR k = 4 AND score < 5 OR k = 5 AND score < 4.99::DOUBLE THEN 'min_score' END, CASE WHEN k = 1 AND ep > e THEN 'max_episodes' END, CASE WHEN k = 0 AND year < y OR k = 3 AND year < 2024 THEN 'min_year' END,
  CASE WHEN k = 2 AND year > y THEN 'max_year' END, CASE WHEN k = 1 AND ty <> 'small' OR k = 3 AND ty <> 'medium' THEN 'formats' END, CASE WHEN k = 2 AND list_contains(gs, 'anvil') THEN 'exclude_genres' END, CASE WHEN k = 0 AND NOT list_has_any(gs, ['promo', 'blue']) OR k = 3 THEN 'include_genres' END,
  CASE WHEN k = 2 AND st <> 'Brand#1' THEN 'studio' END], lambda z: z IS NOT NULL) AS f FROM a, c)"""
ORACLES: dict[str, str] = {
    "intents": f"WITH {_EXPECTED} SELECT request_id, refused, kind, rank_by, genres, CAST(CASE k WHEN 0 THEN y WHEN 3 THEN 2024 END AS INT) AS min_year, CAST(CASE k WHEN 1 THEN e END AS INT) AS max_episodes, CAST(min_score AS DOUBLE) AS min_score, CAST(top_k AS INT) AS top_k, CAST(mentions AS INT) AS mentions FROM t JOIN x USING (k)",
    "relaxation_ladder": f"""WITH {_MEETS}, l AS (SELECT request_id, list_filter(CASE k WHEN 0 THEN ['min_year', 'include_genres'] WHEN 1 THEN ['max_episodes', 'formats'] WHEN 2 THEN ['min_score', 'max_year', 'exclude_genres'] WHEN 3 THEN ['min_score', 'min_year', 'formats', 'include_genres'] WHEN 5 THEN ['min_score'] ELSE CAST([] AS VARCHAR[]) END,
        lambda z: z <> 'min_year' OR conv_id % 2 = 1)[1:2] AS l FROM a), n AS (SELECT request_id, any_value(l) AS l, count(*) FILTER (len(f) = 0) AS n0, count(*) FILTER (list_has_all(l[1:1], f)) AS n1, count(*) FILTER (list_has_all(l, f)) AS n2 FROM m JOIN l USING (request_id) GROUP BY request_id),
        s AS (SELECT *, CASE WHEN n0 > 0 OR len(l) = 0 THEN 0 WHEN n1 > 0 OR len(l) = 1 THEN 1 ELSE 2 END AS s FROM n) SELECT request_id, CASE s WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END AS found, array_to_string(l[1:s], ',') AS dropped FROM s""",
    "request_answers": f"""WITH {_MEETS} SELECT request_id, i AS item_id, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN k = 1 THEN year WHEN k <> 5 THEN -score END, CASE WHEN k = 5 THEN title END, lower(title), i) AS rank FROM m
        WHERE k <> 4 AND len(f) = 0 AND (k <> 2 OR contains(lower(title), 'a')) QUALIFY rank <= CASE k WHEN 0 THEN 5 WHEN 5 THEN 3 ELSE 10 END""",
}
