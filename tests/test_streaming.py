"""Streams from files, a micro-batch a file: windows with late data, sessions, profiles that expire, the limiter."""

import json
from datetime import datetime, timedelta

import pytest

from cairnflow.streaming import profiles as P
from cairnflow.streaming import state as S

T0 = datetime(2024, 1, 1)
EVENTS = "event_id long, user_id long, ts timestamp, event_type string, value double"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def streamed(spark, tmp_path, schema, batches, make, mode="append"):
    """Rows that a stream gives, a list a micro-batch."""
    source, out = tmp_path / "in", []
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    query = make(stream).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, _: out.append(df.collect())).start()
    try:
        for k, rows in enumerate(batches):
            lines = [json.dumps({c.split()[0]: v.isoformat() if isinstance(v, datetime) else v for c, v in zip(schema.split(", "), r, strict=True)}) for r in rows]
            (tmp_path / f"{k}.json").write_text("\n".join(lines))
            (tmp_path / f"{k}.json").rename(source / f"{k}.json")
            query.processAllAvailable()
    finally:
        query.stop()
    return out


def test_tumbling_drops_what_is_too_late(spark, tmp_path):
    batches = [[(1, 1, at(5), "a", 1.0), (2, 1, at(50), "a", 2.0)], [(3, 1, at(200), "b", 1.0)], [(4, 1, at(10), "a", 100.0), (5, 1, at(190), "b", 4.0)], [(6, 1, at(500), "c", 1.0)], [(7, 1, at(501), "c", 1.0)]]
    got = [r for rows in streamed(spark, tmp_path, EVENTS, batches, S.tumbling) for r in rows]
    assert sorted((r.start, r.event_type, r.n, r.value) for r in got) == [(at(0), "a", 2, 3.0), (at(180), "b", 2, 5.0)]


def test_sessions_merge_over_batches(spark, tmp_path):
    batches = [[(1, 1, at(0), "a", 1.0)], [(2, 1, at(20), "a", 1.0), (3, 2, at(25), "a", 1.0)], [(4, 1, at(400), "a", 1.0)], [(5, 1, at(800), "a", 1.0)], [(6, 1, at(801), "a", 1.0)]]
    got = sorted((r.user_id, r.start, r.end, r.n) for rows in streamed(spark, tmp_path, EVENTS, batches, S.sessions) for r in rows)
    assert got == [(1, at(0), at(50), 2), (1, at(400), at(430), 1), (2, at(25), at(55), 1)]


def test_limiter_on_a_stream_is_the_limiter_on_a_batch(spark, tmp_path):
    rows = [(i, i % 2, T0 + timedelta(seconds=s), "a", 1.0) for i, s in enumerate([0, 1, 2, 3, 30, 31, 59, 60, 61, 62, 63, 90, 91, 120])]
    want = {(r.event_id, r.allowed) for r in S.limited(spark.createDataFrame(rows, EVENTS), 2, 60).collect()}
    got = {(r.event_id, r.allowed) for b in streamed(spark, tmp_path, EVENTS, [rows[:5], rows[5:9], rows[9:]], lambda df: S.limited(df, 2, 60)) for r in b}
    assert got == want and {a for _, a in want} == {True, False}


def test_patches():
    p = P.patched(P.empty_profile(), {"liked_titles": ["Monster", " monster ", "", "Akira"], "temporary_ratings": {"Monster": 9}, "last_recommendations": [1, 2], "watched_titles": ["Akira"], "preferred_genres": "Drama", "odd": 1})
    assert p["liked_titles"] == ["Monster", "Akira"] and p["seen_titles"] == ["Akira"] and p["preferred_genres"] == ["Drama"] and "odd" not in p
    q = P.patched(p, {"replace": True, "liked_titles": ["X"]})
    assert q["liked_titles"] == ["X"] and q["temporary_ratings"] == {} and q["last_recommendations"] == [1, 2] and p["liked_titles"] == ["Monster", "Akira"]
    assert P.patched(q, {"reset": True, "liked_titles": ["Y"]}) == P.empty_profile() and P.patched(p, {"liked_titles": None, "temporary_ratings": 3}) == p


PATCHES = "session_id string, patch_id long, ts timestamp, patch string"


def test_profiles_on_stream_and_batch(spark, tmp_path):
    day = 24 * 60
    batches = [
        [("s", 2, at(1), '{"liked_titles":["B"]}'), ("s", 1, at(0), '{"liked_titles":["A"]}'), ("t", 3, at(2), '{"seen_titles":["Z"]}'), (None, 4, at(2), "{}"), ("", 5, at(2), "{}")],
        [("s", 6, at(5), '{"liked_titles":["a","C"],"last_recommendation_intent":"x"}'), ("t", 7, at(6), "broken {"), ("t", 8, at(7), "[1]")],
        [("s", 9, at(20 * day), '{"replace":true,"preferred_genres":["Drama"]}')],
        [("u", 10, at(40 * day), '{"reset":true}')], [("u", 11, at(40 * day + 1), "{}")], [("u", 12, at(60 * day), "{}")], [("u", 13, at(60 * day + 1), "{}")],
    ]
    out = streamed(spark, tmp_path, PATCHES, batches, P.session_profiles)
    rows = [(r.session_id, r.patches, json.loads(r.profile), r.expired) for b in out for r in b]
    assert [x for x in rows if x[0] == "s" and not x[3]] == [("s", 2, {"liked_titles": ["A", "B"]}, False), ("s", 3, {"liked_titles": ["A", "B", "C"], "last_recommendation_intent": "x"}, False), ("s", 4, {"preferred_genres": ["Drama"], "last_recommendation_intent": "x"}, False)]
    assert [x for x in rows if x[3]] == [("t", 3, {"seen_titles": ["Z"]}, True), ("s", 4, {"preferred_genres": ["Drama"], "last_recommendation_intent": "x"}, True)]
    whole = P.session_profiles(spark.createDataFrame([x for b in batches for x in b], PATCHES).repartition(3))
    assert {r.session_id: json.loads(r.profile) for r in whole.collect()} == {"s": {"preferred_genres": ["Drama"], "last_recommendation_intent": "x"}, "t": {"seen_titles": ["Z"]}, "u": {}}
    with pytest.raises(StopIteration):
        next(r for r in whole.collect() if r.expired)
