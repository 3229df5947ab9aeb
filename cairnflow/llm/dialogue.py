"""Repair of conversation structure by shortest paths with small whole costs.

A conversation's rows, ordered by turn (nulls first, then role, then text), are read by a small automaton that accepts role initials
`(s?(ua)+)?`. A node is (rows read, state); its arcs are the edits: keep 0, rerole 1, delete 2, insert 5, and 5 more for keeping or
reroling a row that is cut off. Dial's bucket queue gives every node's distance to acceptance: nodes wait in buckets by distance, and
since arcs cost at most 6, a bucket is final when it is reached. The audit then walks tight arcs only (distance here equals cost plus distance
there) and takes the smallest initial each time (D < I < K < R); a state allows one role next, so an initial leads to one node, and
the walk gives the smallest audit of all cheapest ones. Rows that must go (blank, duplicate) aren't nodes: deleting them is tight and the
smallest initial wherever they stand.

Conversations of up to LONG rows are repaired one after the other from sorted partitions. Longer ones are cut into blocks of BLOCK entries
by a global order: every block gives the cheapest costs between states (a 4 x 4 table), a conversation's tables give the distances at the
blocks' ends, from which every block walks for each state it may be entered in, and the chain of entered states picks one walk each. Only the
tables of a conversation meet in a task, and the hash of its repaired text is taken piece by piece, in order, since that is what SHA-256
needs. Rows that agree in turn, role and text are one entry with a number there.

Nulls: a null role or text is one space, a null conv_id or turn is one space in the damage's key; rows without conv_id are a conversation;
null turns come first and don't count for gaps. Empty roles have no initial and fit nothing. Ties of turn go by role, then text (UTF-8 order), so
repeated rows stand side by side and all but the first are duplicates. Very long texts are taken whole; other columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.rank import global_rank
from .shared import SPACE, durable, small_batches

LONG, BLOCK = 10_000, 4096
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: States: nothing yet, after system, after user, after assistant; what each role's initial leads to, and what leads there.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
INTO = {r: {q: [p for p, x in to.items() if x == q] for q in range(4)} for r, to in NEXT.items()}
ROLES = {"u": "user", "a": "assistant"}
#: The one role that may be put in at each state.
ALLOWED = {0: "u", 1: "u", 2: "a", 3: "u"}
FAR = 1 << 40
ACCEPTED = (0, FAR, FAR, 0)
LEGAL = {"su", "ua", "au"}
Live = tuple[str, bool]  # a row's role initial, and whether it is cut off


def distances(live: list[Live], end: tuple[int, ...] | list[int] = ACCEPTED) -> list[list[int]]:
    """dist[i][q]: the cheapest edits from row i in state q on, where ending in state q costs end[q] more. Dial's bucket queue, backwards."""
    n = len(live)
    dist = [[FAR] * 4 for _ in range(n + 1)]
    buckets: list[list[tuple[int, int]]] = []

    def reach(d: int, i: int, q: int) -> None:
        if d < dist[i][q]:
            dist[i][q] = d
            while len(buckets) <= d:
                buckets.append([])
            buckets[d].append((i, q))

    low = min(end)
    if low >= FAR:
        return dist
    for q in range(4):
        if end[q] < FAR:
            reach(end[q] - low, n, q)
    at = 0
    while at < len(buckets):
        for i, q in buckets[at]:  # no arc is free of cost and stays in a layer, so what a bucket adds to itself is read too
            if dist[i][q] < at:
                continue
            for role in "ua":
                for p in INTO[role][q]:
                    reach(at + INSERT, i, p)
            if i:
                initial, cut = live[i - 1]
                extra = CUT_OFF if cut else 0
                reach(at + DELETE, i - 1, q)
                for p in INTO.get(initial, {}).get(q, ()):
                    reach(at + KEEP + extra, i - 1, p)
                for role in "ua":
                    for p in INTO[role][q]:
                        reach(at + REROLE + extra, i - 1, p)
        buckets[at] = []
        at += 1
    return [[min(FAR, d + low) for d in row] for row in dist]


def walk(live: list[Live], dist: list[list[int]], state: int, last: bool = True) -> tuple[list[tuple[str, int, str]], int]:
    """The edits with the smallest initials along tight arcs: (initial, row, role put in or ''), and the state at the end. Inserts after the
    last row are made only if it is the conversation's last."""
    out, i, q, n = [], 0, state, len(live)
    while i < n or last:
        here = dist[i][q]
        if i == n and here == 0:
            break
        initial, cut = live[i] if i < n else ("", False)
        extra = CUT_OFF if cut else 0
        allowed = ALLOWED[q]
        to = NEXT[allowed][q]
        if i < n and dist[i + 1][q] + DELETE == here:
            out.append(("D", i, ""))
            i += 1
        elif dist[i][to] + INSERT == here:
            out.append(("I", i, ROLES[allowed]))
            q = to
        elif i < n and (kept := NEXT.get(initial, {}).get(q)) is not None and dist[i + 1][kept] + KEEP + extra == here:
            out.append(("K", i, ""))
            i, q = i + 1, kept
        elif i < n:
            out.append(("R", i, ROLES[allowed]))
            i, q = i + 1, to
        else:
            raise AssertionError("no tight arc")
    return out, q


def applied(edits: list[tuple[str, int, str]], rows: list[tuple[str, str]], gone: list[int]) -> tuple[str, list[str]]:
    """The audit with the deletions of rows that must go (gone[i] of them before live row i, the last number after all), and the repaired lines."""
    audit, lines, left = [], [], list(gone)
    for what, i, role in edits:
        audit.append("D" * left[i] + what)
        left[i] = 0
        if what != "D":
            lines.append(f"{rows[i][0]}:{rows[i][1]}" if what == "K" else f"{role}:{rows[i][1] if what == 'R' else ''}")
    return "".join(audit) + "D" * sum(left), lines


def repair(rows: list[tuple[int | None, str, str]]) -> tuple:
    """(turn, role, text) in order -> gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    seen: set[tuple[str, str]] = set()
    counts, live, kept, gone = [0, 0, 0], [], [], [0]
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        if fault in (0, 1):
            gone[-1] += 1
        else:
            live.append((role[:1], fault == 2))
            kept.append((role, text))
            gone.append(0)
    dist = distances(live)
    audit, lines = applied(walk(live, dist, 0)[0], kept, gone)
    return gaps, *counts, illegal, dist[0][0] + DELETE * sum(gone), audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> key, conv_id, turn, role, text, copies: 0 for rows that the damage drops."""
    space = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    rows = rows.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), space))
    what = F.crc32(F.concat("key", F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    rows = rows.withColumn("what", what)
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role")
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text")
    return rows.select("key", "conv_id", "turn", role, text, F.when(F.col("what") == 0, 0).when(F.col("what") == 3, 2).otherwise(1).alias("copies"))


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form of `damaged`."""
    space = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    return rows.select(F.coalesce(F.col("conv_id").cast("string"), space).alias("key"), "*", F.lit(1).alias("copies"))


def _short(rows: DataFrame) -> DataFrame:
    """Conversations one after the other, from partitions sorted by conversation and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, conv, own, out = None, None, [], []

        def flushed() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 7 else pa.string()) for i, c in enumerate(zip(*out, strict=True))], _NAMES)
            out.clear()
            return done

        for batch in batches:
            for k, c, turn, role, text, copies in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if k != key:
                    if key is not None:
                        out.append((conv, *repair(own)))
                    key, conv, own = k, c, []
                own += [(turn, role, text)] * copies
            if len(out) > 1000:
                yield flushed()
        if key is not None:
            out.append((conv, *repair(own)))
        if out:
            yield flushed()

    return rows.repartition("key").sortWithinPartitions("key", F.col("turn").asc_nulls_first(), "role", "text").mapInArrow(run, _RESULT)


def _entries(rows: DataFrame, block: int) -> DataFrame:
    """Rows of long conversations -> an entry per different (key, turn, role, text): with initial, live (whether its first copy may stay), cut,
    gone (copies that must go), copies, place and block."""
    entries = rows.where("copies > 0").groupBy("key", "conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    when = F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce("turn", F.lit(0)).alias("b"))
    entries = entries.withColumns({"digest": F.sha2("text", 256), "when": when})
    first = entries.groupBy("key", "role", "digest").agg(F.min("when").alias("first"))
    entries = entries.join(first, ["key", "role", "digest"])
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    live = ~blank & (F.col("when") == F.col("first"))
    entries = entries.select("key", "conv_id", "turn", "role", "text", "copies", F.left("role", F.lit(1)).alias("initial"), blank.alias("blank"), live.alias("live"), (live & ~F.col("text").rlike(f"[.!?][{SPACE}]*\\z")).alias("cut"), (F.col("copies") - live.cast("long")).alias("gone"))
    ranked = global_rank(entries, [F.asc("key"), F.col("turn").asc_nulls_first(), F.asc("role"), F.asc("text")], "place", "every")
    starts = ranked.groupBy("key").agg(F.min("place").alias("start"))
    return durable(ranked.join(starts, "key").withColumn("block", F.floor((F.col("place") - F.col("start")) / block)).drop("start", "every"))


def _block(pdf: pd.DataFrame) -> tuple[list[Live], list[int], list[tuple[str, str]]]:
    """The live rows of a block's entries (sorted), how many rows must go before each and after all, and the live rows' roles and texts."""
    live, gone, rows = [], [0], []
    texts = pdf["text"] if "text" in pdf else [""] * len(pdf)
    roles = pdf["role"] if "role" in pdf else pdf["initial"]
    for initial, alive, cut, more, role, text in zip(pdf["initial"], pdf["live"], pdf["cut"], pdf["gone"], roles, texts, strict=True):
        if alive:
            live.append((initial, bool(cut)))
            rows.append((role, text))
            gone.append(0)
        gone[-1] += int(more)
    return live, gone, rows


def _long(rows: DataFrame, block: int) -> DataFrame:
    """Long conversations block by block."""
    entries = _entries(rows, block)
    slim = entries.select("key", "block", "place", "initial", "live", "cut", "gone", "copies")

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        live, _, _ = _block(pdf)
        columns = [distances(live, [0 if p == q else FAR for p in range(4)])[0] for q in range(4)]
        initials = list(pdf["initial"])
        bad = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)) + int(pdf["copies"].sum()) - len(pdf)
        return pd.DataFrame([(pdf["key"].iloc[0], int(pdf["block"].iloc[0]), [columns[q][p] for p in range(4) for q in range(4)], initials[0], initials[-1], bad)], columns=["key", "block", "costs", "first", "last", "bad"])

    tables = durable(slim.groupBy("key", "block").applyInPandas(table, "key string, block long, costs array<long>, first string, last string, bad long"))

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        end, out, total = list(ACCEPTED), [], 0
        for costs in reversed(list(pdf["costs"])):
            out.append(end)
            end = [min(FAR, *(int(costs[4 * p + q]) + end[q] for q in range(4))) for p in range(4)]
        total = end[0]
        first, last = list(pdf["first"]), list(pdf["last"])
        bad = int(pdf["bad"].sum()) + sum(a + b not in LEGAL for a, b in zip(last, first[1:], strict=False))
        n = len(pdf)
        return pd.DataFrame({"key": pdf["key"], "block": pdf["block"], "end": out[::-1], "blocks": n, "total": total, "illegal": bad})

    known = durable(tables.groupBy("key").applyInPandas(ends, "key string, block long, end array<long>, blocks long, total long, illegal long"))

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        live, _, _ = _block(pdf)
        dist = distances(live, [int(x) for x in pdf["end"].iloc[0]])
        to = [walk(live, dist, q, last=False)[1] if dist[0][q] < FAR else -1 for q in range(4)]
        return pd.DataFrame([(pdf["key"].iloc[0], int(pdf["block"].iloc[0]), to)], columns=["key", "block", "exits"])

    left = durable(slim.join(known, ["key", "block"]).groupBy("key", "block").applyInPandas(exits, "key string, block long, exits array<int>"))

    def entered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        state, out = 0, []
        for to in pdf["exits"]:
            out.append(state)
            state = int(to[state])
        return pd.DataFrame({"key": pdf["key"], "block": pdf["block"], "state": out})

    states = left.groupBy("key").applyInPandas(entered, "key string, block long, state int")
    known = durable(known.join(states, ["key", "block"]))

    def piece(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        live, gone, own = _block(pdf)
        r = pdf.iloc[0]
        dist = distances(live, [int(x) for x in r["end"]])
        audit, lines = applied(walk(live, dist, int(r["state"]), last=bool(r["block"] == r["blocks"] - 1))[0], own, gone)
        return pd.DataFrame([(r["key"], int(r["block"]), audit, len(lines), "\n".join(lines))], columns=["key", "block", "audit", "lines", "repaired"])

    whole = entries.select("key", "block", "place", "role", "text", "initial", "live", "cut", "gone")
    pieces = whole.join(known.select("key", "block", "end", "blocks", "state"), ["key", "block"]).groupBy("key", "block").applyInPandas(piece, "key string, block long, audit string, lines long, repaired string")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audits, digest, some = None, [], hashlib.sha256(), False
        done = lambda: pa.RecordBatch.from_arrays([pa.array([x]) for x in (key, "".join(audits), digest.hexdigest())], ["key", "audit", "repaired_sha256"])
        for batch in batches:
            for k, audit, lines, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if k != key:
                    if key is not None:
                        yield done()
                    key, audits, digest, some = k, [], hashlib.sha256(), False
                audits.append(audit)
                if lines:
                    digest.update((b"\n" if some else b"") + text.encode())
                    some = True
        if key is not None:
            yield done()

    texts = pieces.repartition("key").sortWithinPartitions("key", "block").select("key", "audit", "lines", "repaired").mapInArrow(joined, "key string, audit string, repaired_sha256 string")
    count = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    copies, live = F.col("copies"), F.col("live").cast("long")
    sums = entries.groupBy("key").agg(
        F.first("conv_id", True).alias("conv_id"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"), count(F.when(F.col("blank"), copies)).alias("blank"),
        count(F.when(~F.col("blank"), copies - live)).alias("duplicate"), count(F.col("cut").cast("long")).alias("truncated"), count("gone").alias("gone"),
    )
    totals = known.where("block = 0").select("key", "total", "illegal")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    return texts.join(sums, "key").join(totals, "key").select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", (F.col("total") + DELETE * F.col("gone")).alias("cost"), "audit", "repaired_sha256")


def repaired(rows: DataFrame, long: int = LONG, block: int = BLOCK) -> DataFrame:
    """rows in the form of `damaged` -> a row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    small_batches(rows.sparkSession)
    large = durable(rows.groupBy("key").agg(F.sum("copies").alias("n")).where(F.col("n") > long).select("key"))
    if large.isEmpty():
        return _short(rows.select("key", "conv_id", "turn", "role", "text", "copies"))
    short = rows.join(large, "key", "left_anti").select("key", "conv_id", "turn", "role", "text", "copies")
    return _short(short).unionByName(_long(rows.join(large, "key", "left_semi"), block))


def _oracle() -> str:
    """The contract in SQL: a table of the best (cost, audit, lines) for each state, row by row from the end; CRC-32 by shifts."""
    step = lambda q, c, a, o: f"{{'c': b{q}.c + {c}, 'a': '{a}' || b{q}.a, 'o': {o} || b{q}.o}}"
    line = lambda role: f"chr(10) || {role} || ':' || text"
    own = []
    for q in range(4):
        kept = " ".join(f"WHEN initial = '{r}' THEN {step(to[q], 'cut', 'K', line('role'))}" for r, to in NEXT.items() if q in to)
        r = ALLOWED[q]
        moved = step(NEXT[r][q], "1 + cut", "R", line(f"'{ROLES[r]}'"))
        own.append(f"list_min(list_filter([{step(q, 2, 'D', chr(39) * 2)}, CASE WHEN NOT must THEN {moved} END, CASE WHEN must THEN NULL {kept} END], lambda x: x IS NOT NULL)) AS c{q}")
    put = lambda x, role: f"{{'c': {x}.c + 5, 'a': 'I' || {x}.a, 'o': chr(10) || '{role}:' || {x}.o}}"
    closed = f"SELECT conv, i, list_min([c0, {put('b2', 'user')}]) AS b0, list_min([c1, {put('b2', 'user')}]) AS b1, b2, list_min([c3, {put('c2', 'user')}]) AS b3"
    start, far = "{'c': CAST(0 AS BIGINT), 'a': '', 'o': ''}", "{'c': CAST(1000000000 AS BIGINT), 'a': '', 'o': ''}"
    middle = f"SELECT *, list_min([c2, {put('c3', 'assistant')}]) AS b2"
    crc = "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))), lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda v, _: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"
    return f"""
WITH RECURSIVE a AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
h AS (SELECT conv, turn, {crc} % 20 AS h FROM (SELECT DISTINCT conv, turn, conv || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM a) x),
d AS (SELECT a.conv, a.turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM a JOIN h ON h.conv = a.conv AND h.turn IS NOT DISTINCT FROM a.turn WHERE h <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM d),
r AS (SELECT *, blank OR dup AS must, CASE WHEN NOT blank AND NOT dup AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 5 ELSE 0 END AS cut, lag(initial) OVER (PARTITION BY conv ORDER BY i) AS before
  FROM (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS dup FROM n) x),
w AS ({closed} FROM ({middle} FROM (SELECT conv, max(i) AS i, {start} AS c0, {far} AS c1, {far} AS c2, {start} AS c3 FROM r GROUP BY conv) x) y
  UNION ALL {closed} FROM ({middle.replace("*,", "conv, i, c0, c1, c2, c3,")} FROM (SELECT w.conv, w.i - 1 AS i, {", ".join(own)} FROM w JOIN r ON r.conv = w.conv AND r.i = w.i) x) y),
s AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut > 0) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b0.c, 0) AS cost, coalesce(b0.a, '') AS audit, sha256(coalesce(substr(b0.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM a) e LEFT JOIN s USING (conv) LEFT JOIN (SELECT * FROM w WHERE i = 0) z USING (conv)
"""


ORACLE = _oracle()
