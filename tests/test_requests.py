"""Requests: what is refused and why, what is read; the ladder against trying every step."""

import json
import random

import pytest

from cairnflow.operators import requests as Q

ITEMS = [(i, f"Title {i % 7}", [["a", "b"], ["b"], [], None][i % 4], ["TV", "Movie", None][i % 3], [f"S{i % 2}"], None if i % 11 == 0 else i / 10, 1990 + i % 30, i % 25) for i in range(60)]
SCHEMA = "item_id long, title string, genres array<string>, type string, studios array<string>, score double, year int, episodes int"


def read(spark, *texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "request_id long, t string").repartition(2)
    return [r for _, r in sorted((r.request_id, r) for r in Q.parsed_intents(df, "t", **more).collect())]


def test_refusals(spark):
    bad = {
        "": "no JSON object", "[1]": "no JSON object", "{}": "unsupported intent: <empty>", '{"intent":" Fly "}': "unsupported intent: fly", '{"intent":"search","b":1,"a":2}': "unknown fields: a, b", '{"intent":"search","include_genres":"a"}': "include_genres must be an array",
        '{"intent":"search","formats":[1]}': "formats must contain only strings", '{"intent":"search","formats":[{"a":1}]}': "formats must contain only strings", '{"intent":"search","min_score":-0.1}': "min_score must be between 0 and 10", '{"intent":"search","min_score":"high"}': "min_score must be a number",
        '{"intent":"search","max_year":1899}': "max_year must be between 1900 and 2100", '{"intent":"search","min_year":2001.5}': "min_year must be a whole number", '{"intent":"search","min_year":2001,"max_year":2000}': "min_year cannot be greater than max_year", '{"intent":"search","max_episodes":0}': "max_episodes must be between 1 and 100000",
        '{"intent":"search","top_k":51}': "top_k must be between 1 and 50", '{"intent":"search","top_k":true}': "top_k must be a whole number", '{"intent":"search","sort_order":"up"}': "unsupported sort_order: up", '{"intent":"search","novelty_preference":"odd"}': "unsupported novelty_preference: odd",
        '{"intent":"search","one_per_series":1}': "one_per_series must be true or false", '{"intent":"search","watched_result_indices":[0]}': "watched_result_indices must be an array of whole numbers from 1", '{"intent":"search","entity_mentions":[3]}': "entity_mentions has entries that don't fit",
        '{"intent":"search","entity_mentions":[{"text":"x","age":3}]}': "entity_mentions has entries that don't fit", '{"intent":"search","entity_mentions":[{"text":"x","entity_type":"cat"}]}': "entity_mentions has an unsupported type or relation",
        '{"intent":"search","inferred_constraints":[{"field":"min_year","value":2000,"confidence":1.5}]}': "inferred_constraints has an unsupported field, value or confidence", '{"intent":"search","preference_update":{"loved":["x"]}}': "preference_update has fields that don't fit",
    }
    for (text, reason), r in zip(bad.items(), read(spark, *bad), strict=True):
        assert r.refused == reason and r.intent is None, (text, r.refused)


def test_what_is_read(spark):
    text = 'Well: {"intent":"Recommend","include_genres":[" Action ","ACTION","","odd"],"formats":[],"min_score":"7.5","min_year":1999,"max_year":null,"top_k":"","preferred_staff":null,"one_per_series":false,"reference_result_indices":[2,4],"sort_order":"","entity_mentions":[" Monster ",{"text":"Ann","entity_type":"Staff","relation":"exclude","index":2}],"inferred_constraints":[{"field":"max_episodes","value":24,"confidence":0.6,"source_text":"short"}],"preference_update":{"liked_titles":["x"]}} ok'
    r = read(spark, text, genres=["Action", "Drama"])[0]
    i = r.intent
    assert r.refused is None and i.intent == "recommend" and i.include_genres == ["Action"] and i.formats == [] and (i.min_score, i.min_year, i.max_year, i.top_k) == (7.5, 1999, None, 10) and i.one_per_series is False and i.exclude_related_series is True
    assert i.reference_result_indices == [2, 4] and i.sort_order is None and i.rank_by == "score" and i.novelty_preference == "neutral"
    assert [tuple(m) for m in i.entity_mentions] == [("Monster", "anime", "direct", None), ("Ann", "staff", "exclude", 2)] and [tuple(x) for x in i.inferred_constraints] == [("max_episodes", 24.0, 0.6)]
    assert read(spark, '{"intent":"search","include_genres":[" x ","X","y"]}')[0].intent.include_genres == ["x", "y"]


def meets(item, q):
    _, _, genres, kind, studios, score, year, episodes = item
    g = set(genres or [])
    return not (("min_score" in q and not (score is not None and score >= q["min_score"])) or ("max_episodes" in q and episodes > q["max_episodes"]) or ("min_year" in q and year < q["min_year"]) or ("max_year" in q and year > q["max_year"])
                or (q.get("formats") and (kind or "").lower() not in [x.lower() for x in q["formats"]]) or (q.get("exclude_genres") and g & set(q["exclude_genres"])) or (q.get("include_genres") and not g & set(q["include_genres"]))
                or (q.get("required_studios") and not set(q["required_studios"]) <= set(studios)))


@pytest.mark.parametrize("steps", [0, 1, 2, 3])
def test_ladder_by_trying(spark, steps):
    r = random.Random(4)
    asked = []
    for k in range(40):
        q = {"intent": r.choice(["search", "recommend", "rank_catalog", "details"])}
        for f, v in (("min_score", 5.95), ("max_episodes", 2), ("min_year", 2018), ("max_year", 1992), ("formats", ["Movie"]), ("preferred_staff", ["x"]), ("exclude_genres", ["b"]), ("include_genres", ["a"]), ("required_studios", ["S1"])):
            if r.random() < 0.4 and not (f == "max_year" and "min_year" in q):
                q[f] = v
        asked.append((k, q, r.sample(Q.LADDER, r.randrange(4))))
    df = spark.createDataFrame([(k, json.dumps(q), p) for k, q, p in asked], "request_id long, t string, protected array<string>")
    got = {x.request_id: (x.found, list(x.dropped)) for x in Q.relaxed(Q.parsed_intents(df, "t"), spark.createDataFrame(ITEMS, SCHEMA), steps).collect()}
    for k, q, protected in asked:
        q, dropped = dict(q), []
        while (n := sum(bool(meets(i, q)) for i in ITEMS)) == 0 and len(dropped) < steps and q["intent"] in Q.RETRIEVAL and (left := [f for f in Q.LADDER if f in q and f not in protected]):
            dropped.append(left[0])
            del q[left[0]]
        assert got[k] == (n, dropped), (k, q)


def test_answers_order_missing_last(spark):
    df = spark.createDataFrame([(1, '{"intent":"rank_catalog","rank_by":"score","sort_order":"asc","top_k":50}'), (2, '{"intent":"rank_catalog","rank_by":"score","top_k":50}'), (3, '{"intent":"details"}'), (4, '{"intent":"search","catalog_query":"TITLE 3","required_studios":["s1"],"rank_by":"title","sort_order":"desc","top_k":2}')], "request_id long, t string")
    items = spark.createDataFrame(ITEMS[:40], SCHEMA).selectExpr("*", "item_id AS popularity", "item_id AS members")
    got = {}
    for r in sorted(Q.answered(Q.parsed_intents(df, "t"), items).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.request_id, []).append(r.item_id)
    lost = [i for i in range(40) if i % 11 == 0]
    missing = sorted(lost, key=lambda i: (i % 7, i))
    there = [i for i in range(40) if i % 11]
    assert got[1] == there + missing and got[2] == there[::-1] + missing and 3 not in got and got[4] == [3, 17]
    with pytest.raises(ValueError):
        Q.relaxed(df, items, -1)
