"""Session profiles as keyed state on a stream: patches merge, replace or reset a profile; sessions that stay silent expire."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A profile's lists and what belongs to the conversation.
LISTS = ("liked_titles", "disliked_titles", "seen_titles", "excluded_titles", "preferred_genres", "excluded_genres", "preferred_studios", "preferred_staff", "preferred_characters", "preferred_voice_actors", "previous_reference_titles")
CONTEXT = ("last_recommendation_intent", "last_recommendations")
RETENTION_DAYS = 30
_SCHEMA = "session_id string, ts timestamp, patches long, profile string, expired boolean"


def empty_profile() -> dict[str, Any]:
    return {f: [] for f in LISTS} | {"temporary_ratings": {}} | dict.fromkeys(CONTEXT)


def patched(profile: dict[str, Any], patch: dict[str, Any]) -> dict[str, Any]:
    """`reset` empties all; `replace` empties all but the conversation's context; lists take new values that they don't hold in other capitals;
    watched titles count as seen; ratings and context are overwritten key by key. What isn't a list or an object is left out."""
    if patch.get("reset"):
        return empty_profile()
    out = {k: list(v) if isinstance(v, list) else dict(v) if isinstance(v, dict) else v for k, v in profile.items()}
    if patch.get("replace"):
        out = empty_profile() | {k: profile.get(k) for k in CONTEXT}
    for field in LISTS:
        values = patch.get(field)
        held = {str(v).casefold() for v in out[field]}
        for v in values if isinstance(values, list) else [values] if isinstance(values, str) else []:
            text = str(v).strip() if v is not None else ""
            if text and text.casefold() not in held:
                out[field].append(text)
                held.add(text.casefold())
    if isinstance(patch.get("watched_titles"), list):
        out["seen_titles"] = list(dict.fromkeys([*out["seen_titles"], *map(str, patch["watched_titles"])]))
    if isinstance(patch.get("temporary_ratings"), dict):
        out["temporary_ratings"] |= patch["temporary_ratings"]
    return out | {k: patch[k] for k in CONTEXT if k in patch}


def _apply(profile: dict[str, Any], rows: pd.DataFrame) -> dict[str, Any]:
    for text in rows.sort_values(["ts", "patch_id"])["patch"]:
        try:
            patch = json.loads(text) if text else {}
        except ValueError:
            patch = {}
        profile = patched(profile, patch if isinstance(patch, dict) else {})
    return profile


def _line(profile: dict[str, Any]) -> str:
    return json.dumps({k: v for k, v in profile.items() if v}, sort_keys=True, ensure_ascii=False)


def session_profiles(patches: DataFrame, late: str = "1 hour", days: int = RETENTION_DAYS) -> DataFrame:
    """patches (session_id, patch_id, ts, patch: JSON) -> session_id, ts, patches, profile (JSON of what isn't empty, sorted keys), expired.

    On a batch: the profile of each session after all its patches in the order of ts and patch_id. On a stream: a row for each session and
    micro-batch with patches; within a batch they are ordered, patches later than the watermark are dropped. A session without
    a patch for `days` of event time gives a last row, expired, and its state goes. Broken patches change nothing."""
    slim = patches.select(F.col("session_id").cast("string"), "patch_id", "ts", "patch").where("session_id IS NOT NULL AND session_id <> ''")
    if not patches.isStreaming:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(pdf["session_id"].iloc[0], pdf["ts"].max(), len(pdf), _line(_apply(empty_profile(), pdf)), False)], columns=[x.split()[0] for x in _SCHEMA.split(", ")])

        return slim.groupBy("session_id").applyInPandas(whole, _SCHEMA)

    def step(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in _SCHEMA.split(", ")]
        if state.hasTimedOut:
            text, n, last = state.get
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(last, unit="ms"), n, text, True)], columns=columns)
            return
        rows = pd.concat(list(frames))
        text, n, last = state.get if state.exists else ("{}", 0, 0)
        profile, n = _apply(empty_profile() | json.loads(text), rows), n + len(rows)
        last = max(last, int(rows["ts"].max().timestamp() * 1000))
        state.update((_line(profile), n, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + days * 86_400_000)
        yield pd.DataFrame([(key[0], pd.Timestamp(last, unit="ms"), n, _line(profile), False)], columns=columns)

    marked = slim.withWatermark("ts", late)
    return marked.groupBy("session_id").applyInPandasWithState(step, _SCHEMA, "profile string, patches long, last long", "append", GroupStateTimeout.EventTimeTimeout)
