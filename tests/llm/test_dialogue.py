"""Conversation repair against every edit sequence of small cases, against a plain table of best audits, and long against short."""

import hashlib
import random
import zlib
from functools import cache

import pytest

from cairnflow.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Cost and audit by a table of (cost, audit) from the end; roles of the audit by replaying it."""
    state = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    seen, must, cut = set(), [], []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        must.append(not bare or (role, text) in seen)
        cut.append(bool(bare) and bare[-1] not in ".!?")
        seen.add((role, text))

    @cache
    def best(i, q, inserted=0):
        out = [(0, "", ())] if i == len(rows) and q in (0, 3) else []
        add = lambda cost, what, role, text, rest: out.append((cost + rest[0], what + rest[1], ((role, text), *rest[2]) if role is not None else rest[2])) if rest else None
        if inserted < 3:
            for r, name in (("u", "user"), ("a", "assistant")):
                if q in state[r]:
                    add(5, "I", name, "", best(i, state[r][q], inserted + 1))
        if i < len(rows):
            _, role, text = rows[i]
            add(2, "D", None, None, best(i + 1, q))
            if not must[i]:
                if q in state.get(role[:1], {}):
                    add(5 * cut[i], "K", role, text, best(i + 1, state[role[:1]][q]))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if q in state[r]:
                        add(1 + 5 * cut[i], "R", name, text, best(i + 1, state[r][q]))
        return min(out, key=lambda x: x[:2]) if out else None

    cost, audit, lines = best(0, 0)
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def damage(rows):
    """The contract's damage, by plain Python; conversations in order."""
    out = {}
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
        own = out.setdefault(conv, [])
        own += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for k, v in out.items()}


def made(seed, n, conv=0):
    r = random.Random(seed)
    return [(conv, r.choice([i, i, i, max(0, i - 1), None]), r.choice(["user", "assistant", "assistant", "system", "tool", None, ""]), r.choice(["One.", "Two!", "three", "", " \t", f"No {i}?", f"open {i}", None])) for i in range(n)]


def test_distances_and_walks_give_the_cheapest_and_smallest():
    for seed in range(400):
        rows = [(t, r or " ", x or " ") for _, t, r, x in made(seed, seed % 9)]
        gaps, blank, duplicate, truncated, illegal, cost, audit, sha = dialogue.repair(rows)
        assert (cost, audit, sha) == plain(rows), rows


@pytest.fixture(scope="module")
def rows():
    out = [x for seed in range(30) for x in made(seed, seed % 12, seed)]
    return out + [x for x in made(99, 120, 900)] + made(5, 6, None) + [(901, 3, "user", "Same."), (901, 3, "user", "Same.")] * 20


def as_dict(df):
    return {r.conv_id: tuple(r[1:]) for r in df.collect()}


def test_repair_equals_plain_python(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", cost string").repartition(3)
    got, want = as_dict(dialogue.repaired(dialogue.damaged(df))), damage(rows)
    assert set(got) == set(want) and len(got) == 30
    for conv, own in want.items():
        turns = {t for t, _, _ in own if t is not None}
        pairs = list(zip(own, own[1:], strict=False))
        assert got[conv][0] == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        assert got[conv][4] == sum((a[1][:1], b[1][:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in pairs)
        assert got[conv][5:] == plain(own), conv
        assert got[conv][1] == sum(not x.strip(" \t\n\x0b\x0c\r") for _, _, x in own)
    gone = [c for c, own in want.items() if not own]
    assert all(got[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone)


def test_long_conversations_equal_short_ones(spark, rows):
    df = dialogue.damaged(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert as_dict(dialogue.repaired(df, long=3, block=4)) == as_dict(dialogue.repaired(df))
    assert as_dict(dialogue.repaired(df, long=20, block=7)) == as_dict(dialogue.repaired(df))


def test_empty_and_undamaged(spark):
    assert dialogue.repaired(dialogue.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    one = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Hello."), (1, 4, "user", "x" * 100_000)], SCHEMA)
    got = dialogue.repaired(dialogue.undamaged(one)).first()
    assert (got.gaps, got.truncated, got.illegal, got.cost, got.audit) == (1, 1, 0, 2, "KKKD")
