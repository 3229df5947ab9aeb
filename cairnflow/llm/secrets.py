"""Secret scans: a linear-chain conditional random field tags tokens as begin, inside or outside of a secret; Viterbi decodes.

Base spans come from the three patterns and always stay. The field is trained here on windows of a bounded sample (SAMPLE documents
that hold a cue and SAMPLE others, first by a hash of the text, of at most MAX_CHARS code points). Its labels aren't the patterns'
echo: into windows of ordinary text, and in place of half the base spans, made-up secrets are planted, in formats and after cues
that the patterns don't know, beside made-up words that only look like secrets. A token's features are its shape, length,
character classes, how often its classes change, its first characters and its word, those of its neighbours (two before, one
after), and how much of the file looks like code. Weights are tables over token classes, so a text is scored by lookups. A token
that no run of tags with a gain over outside can pass through is outside on the best path, so Viterbi runs on what lies
between such tokens and is still exact. `held_out` measures recall on planted secrets that no pattern covers.

A decoded span that overlaps no base span is added as kind `crf`, without the quotes and brackets around it and a name before
a sign of assignment. Null and empty texts have no spans; very long texts and tokens are taken whole. Equal paths tie by the lower
tag. Repeated rows and rows without an id each get a row; other columns are ignored; an empty table gives an empty result, and one
without a text to train on adds nothing.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hash_sample, small_batches

SAMPLE, MAX_CHARS, WINDOW, WINDOWS, STEPS = 1000, 20_000, 24, 4000, 60
KINDS = ("assign", "access", "hex")
#: Features of the token itself, the one before, the one after, the one before the one before.
PLACES = "cpnq"
_ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CUES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted: leftmost non-overlapping matches per kind, failing ones dropped."""
    out = []
    low = text.lower().encode("utf-8", "surrogatepass") if not text.isascii() else text.encode().lower()
    if any(c in low for c in _CUES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if b"akia" in low:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class _Shapes(dict):
    def __missing__(self, code: int) -> str:
        ch = chr(code)
        self[code] = k = "a" if "a" <= ch <= "z" else "A" if "A" <= ch <= "Z" else "9" if "0" <= ch <= "9" else ch if ch in "\"'=:_-+/." else "u" if code > 127 else "p"
        return k


_SHAPES, _REPEAT, _PLAIN_HEX = _Shapes(), re.compile(r"(.)\1+"), re.compile("[0-9a-f]+")
_SINGLE, _LETTERS = ("a", "A", "9", "u", ""), set("aA9u")
_AROUND = "\"'=:;,.()[]{}<>#&%$*!|`"
#: What stands around a secret: quotes and brackets, a name with a sign of assignment, a trailing mark.
_NAMED = re.compile(r"""^["'({\[<`]*(?:[A-Za-z0-9_.-]{1,40}["']?(?::=|=>|[=:]))?["'({\[<`]*""")


def token_features(token: str) -> tuple[str, ...]:
    """Shape, length, character classes and their changes, first characters, and the bare word if it is short."""
    value = token.strip(_AROUND)
    if not value.isalnum():  # else the name before a sign, if any, is all that there is
        value = token[_NAMED.match(token).end() :].strip(_AROUND) or value
    shape = value.translate(_SHAPES)
    short = shape[:1] if shape.count(shape[:1]) == len(shape) else _REPEAT.sub(r"\1", shape)
    n, digits, changes = len(value), shape.count("9"), len(short)
    size = (n >= 4) + (n >= 8) + (n >= 12) + (n >= 16) + (n >= 24) + (n >= 40)
    mix = short if short in _SINGLE else "".join([k for k in "aA9u" if k in short]) + ("+" if set(short) - _LETTERS else "")
    rate = (5 * changes > n) + (3 * changes > n) + (2 * changes > n) if n else 0
    named = "=" if value and len(token) > n and token.find(value) > 0 and token[token.find(value) - 1] in "=:>\"'" else ""
    first = "p=" + value[:4] if size >= 3 and mix not in ("a", "Aa", "u", "au", "aAu", "9") else "p="
    return f"s={named}{short[:6]}", f"l={size}{mix}", f"d={_PLAIN_HEX.fullmatch(value) is not None}{min(digits, 1) + (2 * digits > n)}{size}", f"r={rate}{mix}{size}", first, "w=" + (value.lower() if n < 16 and not digits else "") + named


class Field:
    """Weights of a chain over outside 0, begin 1, inside 2."""

    def __init__(self, number: dict[str, int], unary: np.ndarray, pairs: np.ndarray) -> None:
        self.number, self.unary, self.pairs = number, unary, pairs
        stay = pairs[0, 0]
        self.inner = pairs[1:, 1:].max() - stay
        self.ends = max(0.0, pairs[0, 1:].max() - stay) + max(0.0, pairs[1:, 0].max() - stay) - self.inner
        self.cache: dict[str, int] = {}
        self.kinds: dict[tuple, int] = {}
        self.rows: list[np.ndarray] = []
        self.known = {n[1:] for n in number}
        self.table, self.filled = np.zeros((256, len(PLACES), 3)), 0

    def classes(self, tokens: list[str]) -> np.ndarray:
        """Numbers of the tokens' classes: tokens with equal known features share one."""
        cache, out = self.cache, np.empty(len(tokens), np.int64)
        if len(cache) > 600_000:
            cache.clear()
        for i, t in enumerate(tokens):
            k = cache.get(t)
            if k is None:
                known = tuple(f for f in token_features(t) if f in self.known)
                k = self.kinds.get(known)
                if k is None:
                    k = self.kinds[known] = len(self.rows)
                    self.rows.append(np.array([sum((self.unary[self.number[p + f]] for f in known if p + f in self.number), np.zeros(3)) for p in PLACES]))
                if len(t) < 64:
                    cache[t] = k
            out[i] = k
        return out

    def scores(self, tokens: list[str], file: str) -> np.ndarray:
        c = self.classes(tokens)
        if len(self.table) < len(self.rows):
            self.table = np.concatenate((self.table, np.zeros((len(self.rows), len(PLACES), 3))))
        for k in range(self.filled, len(self.rows)):
            self.table[k] = self.rows[k]
        self.filled = len(self.rows)
        e = self.table[c, 0].copy()
        e[1:] += self.table[c[:-1], 1]
        e[:-1] += self.table[c[1:], 2]
        e[2:] += self.table[c[:-2], 3]
        if file in self.number:
            e += self.unary[self.number[file]]
        return e

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best path of tags."""
        tags = np.zeros(len(e), np.int8)
        # the most that a run of tags other than outside through a token can gain over outside: best sums up to it and from it
        gain = np.maximum(e[:, 1], e[:, 2]) - e[:, 0] + self.inner
        total = np.concatenate(([0.0], np.cumsum(gain)))
        most = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total[:-1])
        open_ = np.flatnonzero(most + self.ends >= -1e-9)
        if not len(open_):
            return tags
        cuts = np.flatnonzero(np.diff(open_) > 1) + 1
        for part in np.split(open_, cuts):
            a, b = part[0], part[-1] + 1
            lo, hi = max(0, a - 1), min(len(e), b + 1)  # with the outside tokens on both sides
            best, back = e[lo].copy(), []
            if lo < a:
                best[1:] = -1e9
            for i in range(lo + 1, hi):
                step = best[:, None] + self.pairs
                back.append(step.argmax(0))
                best = step.max(0) + e[i]
            if hi > b:
                best[1:] = -1e9
            k = int(best.argmax())
            for i in range(hi - 1, lo - 1, -1):
                tags[i] = k
                if i > lo:
                    k = int(back[i - lo - 1][k])
        return tags


def file_feature(text: str, tokens: int) -> str:
    """How many assignment and quote signs the file has for its tokens, in coarse steps."""
    n = text.count("=") + text.count('"')
    return "f=" + str(sum(n * k > tokens for k in (4, 20, 100)))


#: Alphabets and prefixes of made-up secrets, cues before them, and cues that say nothing of the sort.
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_PREFIXES = (("ghp_", 36), ("gho_", 36), ("glpat-", 20), ("sk_live_", 24), ("pk_live_", 24), ("sk-", 48), ("xoxb-", 40), ("AIza", 35), ("npm_", 36), ("hf_", 34), ("SG.", 40), ("eyJ", 90))
_CUE_WORDS = ("credential", "credentials", "auth", "bearer", "Bearer", "Authorization", "aws_key", "AWS_KEY", "aws_secret_access_key", "private_key", "access_key", "client_key", "pwd", "PWD", "pass", "passphrase", "key", "signing_key", "webhook", "session", "login", "dsn", "DB_PASS", "auth_code")
_SIGNS = (" = ", "=", ": ", " : ", ":", " => ", " -> ", " is ", " ", " := ", '="', ': "', " = '")
_EMPTY = ("none", "required", "optional", "null", "missing", "expired", "here", "value", "changed", "<redacted>", "true", "not set", "****")


def _value(r: random.Random, cued: bool) -> str:
    """A made-up secret; without a cue only of a format that stands for itself."""
    kind = r.randrange(6 if cued else 3)
    if kind == 0:
        prefix, n = r.choice(_PREFIXES)
        return prefix + "".join(r.choice(_LOWER + _UPPER + _DIGITS + "_-") if prefix == "eyJ" else r.choice(_LOWER + _UPPER + _DIGITS) for _ in range(n))
    if kind == 1:  # a signed token of three parts
        part = lambda n: "".join(r.choice(_LOWER + _UPPER + _DIGITS + "_-") for _ in range(n))
        return f"eyJ{part(r.randrange(17, 40))}.eyJ{part(r.randrange(20, 120))}.{part(r.randrange(22, 60))}"
    if kind == 2:
        return "".join(r.choice(_LOWER + _UPPER + _DIGITS + "+/") for _ in range(40)) + r.choice(("", "=", "=="))
    if kind == 3:
        return "".join(r.choice(_UPPER + _DIGITS) for _ in range(r.randrange(16, 40)))
    if kind == 4:
        return "".join(r.choice(_LOWER + _UPPER + _DIGITS) for _ in range(r.randrange(12, 44)))
    return "".join(r.choice(_LOWER + _UPPER + _DIGITS + "!@$%^&*?-_") for _ in range(r.randrange(10, 20)))


def _lookalike(r: random.Random) -> str:
    """Words that only look like secrets, some after a cue."""
    word = lambda a, b: "".join(r.choice(_LOWER) for _ in range(r.randrange(a, b)))
    number = lambda n: "".join(r.choice(_DIGITS) for _ in range(n))
    day = f"{r.randrange(1990, 2030)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}"
    kinds = (
        lambda: f"{r.choice(_CUE_WORDS)}{r.choice(_SIGNS)}{r.choice(_EMPTY)}", lambda: f"https://www.{word(4, 12)}.{r.choice(('com', 'org', 'net'))}/{word(3, 9)}/{number(4)}/{word(4, 14)}-{word(3, 9)}?{word(2, 5)}={number(3)}",
        lambda: f"{word(4, 10)}_{word(3, 9)}_{day[:4]}_v{r.randrange(9)}.{r.choice(('docx', 'pdf', 'py', 'json'))}", lambda: f"{day}T{r.randrange(24):02}:{r.randrange(60):02}:00Z", lambda: f"v{r.randrange(9)}.{r.randrange(30)}.{r.randrange(30)}-{word(3, 6)}.{r.randrange(9)}",
        lambda: "".join(word(3, 9).capitalize() for _ in range(r.randrange(2, 6))), lambda: "_".join(word(3, 9) for _ in range(r.randrange(3, 7))), lambda: word(14, 36).capitalize(), lambda: word(10, 24).upper(), lambda: number(r.randrange(7, 15)),
        lambda: f"{word(3, 9)}.{number(2)}@{word(4, 9)}.example.com", lambda: f"+{number(2)} ({number(3)}) {number(3)}-{number(4)}", lambda: f"/usr/{word(3, 9)}/{word(3, 9)}/{word(3, 9)}-{number(2)}.{word(2, 4)}", lambda: f"{word(3, 8)}{number(2)}", lambda: f"{word(3, 8).upper()}-{number(4)}", lambda: "".join(r.choice(_LOWER + "     ") for _ in range(20)), lambda: f"{word(5, 12)}!!! {word(3, 9)}***{word(2, 5)}",
    )
    return r.choice(kinds)()


def planted(r: random.Random) -> tuple[str, str]:
    """(text, the secret in it)"""
    cued = r.random() < 0.75
    value = _value(r, cued)
    if not cued:
        return value, value
    sign, quote = r.choice(_SIGNS), ""
    if sign[-1] in "\"'":
        quote = sign[-1]
    cue = r.choice(_CUE_WORDS)
    return f"{cue.upper() if r.random() < 0.2 else cue}{sign}{value}{quote}{r.choice(('', '', '', ',', ';', '.'))}", value


def _tagged(text: str, secret: list[tuple[int, int]], at: int, end: int) -> tuple[list[tuple[str, ...]], list[int], str, tuple[int, int]] | None:
    """The window around code points `at` to `end`, and the tokens of it that stand there: features, tags, file, places."""
    found = list(_TOKEN.finditer(text))
    if len(found) < 2:
        return None
    starts, ends, tags = np.array([m.start() for m in found]), np.array([m.end() for m in found]), [0] * len(found)
    for a, b in secret:
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        for k in range(i, j):
            tags[k] = tags[k] or (1 if k == i else 2)
    middle = int(np.searchsorted(ends, at, "right"))
    lo = max(0, min(middle - WINDOW // 2, len(found) - WINDOW))
    places = middle - lo, int(np.searchsorted(starts, end, "left")) - lo
    return [token_features(m.group()) for m in found[lo : lo + WINDOW]], tags[lo : lo + WINDOW], file_feature(text, len(found)), places


def _values(text: str) -> list[tuple[int, int]]:
    """Base spans without the cues: where the secrets themselves stand."""
    out = [m.span(1) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12] + [(a, b) for a, k, b in base_spans(text) if k]
    return sorted(out)


def _windows(texts: list[str]) -> list[tuple[list[tuple[str, ...]], list[int], str, tuple[int, int], int]]:
    """Windows of a text: around base spans as they are, with something made-up in a base span's place or between words, and plain."""
    out = []
    for number, text in enumerate(texts):
        done = len(out)
        r = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
        values = _values(text)
        for a, b in values[:6]:
            out.append(_tagged(text, values, a, b))
            new, value = planted(r)
            start = max((x for x, _, y in base_spans(text) if x <= a and b <= y), key=lambda x: -x)
            if b - start < 400:
                changed = text[:start] + new + text[b:]
                kept = [(x, y) for x, y in values if y <= start] + [(start + new.index(value), start + new.index(value) + len(value))]
                out.append(_tagged(changed, [*kept, *((x + len(changed) - len(text), y + len(changed) - len(text)) for x, y in values if x >= b)], *kept[-1]))
        gaps = [m.start() for m in re.finditer(r"\x20", text)][:5000]
        for kind in range(3):
            at = r.choice(gaps) + 1 if gaps else 0
            if any(a <= at <= b for a, _, b in base_spans(text)):
                continue
            new, value = planted(r) if kind == 0 else (_lookalike(r), "")
            changed = text[:at] + new + " " + text[at:]
            moved = [(a + (len(new) + 1) * (a >= at), b + (len(new) + 1) * (a >= at)) for a, b in values]
            own = [(at + new.index(value), at + new.index(value) + len(value))] if value else []
            out.append(_tagged(changed, sorted(moved + own), at, at + len(new)))
        out[done:] = [(*w, number) for w in out[done:] if w]
    return out


def fit(texts: list[str]) -> Field | None:
    """Adagrad on the conditional likelihood of the windows, all at once; features seen in under 3 texts are left out. Early on,
    windows go in which the field finds a secret where nothing was planted: most likely one that the labels don't know."""
    windows = [w for w in _windows(texts) if len(w[0]) >= 2]
    windows = windows[:: -(-len(windows) // WINDOWS)] if windows else []  # evenly, at most WINDOWS of them
    if not any(1 in tags for _, tags, *_ in windows):
        return None
    seen: dict[str, set[int]] = {}
    rows = []
    for feats, _, file, _, text in windows:
        row = []
        for i in range(len(feats)):
            names = ["c" + f for f in feats[i]] + (["p" + f for f in feats[i - 1]] if i else []) + (["n" + f for f in feats[i + 1]] if i + 1 < len(feats) else []) + (["q" + f for f in feats[i - 2]] if i > 1 else []) + [file]
            row.append(names)
        rows.append(row)
        for name in {n for names in row for n in names}:
            seen.setdefault(name, set()).add(text)
    number = {n: i for i, n in enumerate(sorted(n for n, c in seen.items() if len(c) >= 3))}
    nf, size = len(number), len(windows)
    index = np.full((size, WINDOW, 6 * len(PLACES) + 1), nf, np.int32)
    gold, real = np.zeros((size, WINDOW), np.int64), np.zeros((size, WINDOW), bool)
    for r, (row, (_, tags, *_)) in enumerate(zip(rows, windows, strict=True)):
        for i, names in enumerate(row):
            known = [number[n] for n in names if n in number]
            index[r, i, : len(known)] = known
            gold[r, i], real[r, i] = tags[i], True
    unary, pairs = np.zeros((nf + 1, 3)), np.zeros((3, 3))
    gu, gp = np.full((nf + 1, 3), 1e-8), np.full((3, 3), 1e-8)
    hot = np.eye(3)[gold] * real[:, :, None]
    both = real[:, 1:] & real[:, :-1]
    seen_pairs = np.zeros((3, 3))
    np.add.at(seen_pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    for step in range(STEPS):
        e = unary[index].sum(2) * real[:, :, None]
        if step == STEPS // 6:
            now, keep = Field(number, unary[:nf], pairs), np.ones(size, bool)
            for w, (_, tags, _, (a, b), _) in enumerate(windows):
                found = np.flatnonzero(now.decode(e[w, : len(tags)]))
                keep[w] = not any(not tags[k] and not a <= k < b for k in found)
            if (hot[keep].sum((0, 1))[:2] > 0).all():
                index, gold, real, hot, both, e = (x[keep] for x in (index, gold, real, hot, both, e))
                size, seen_pairs = len(index), np.zeros((3, 3))
                np.add.at(seen_pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        fwd, bwd = np.zeros((size, WINDOW, 3)), np.zeros((size, WINDOW, 3))
        fwd[:, 0] = e[:, 0]
        for i in range(1, WINDOW):
            here = np.logaddexp.reduce(fwd[:, i - 1, :, None] + pairs, axis=1) + e[:, i]
            fwd[:, i] = np.where(real[:, i, None], here, fwd[:, i - 1])
        for i in range(WINDOW - 2, -1, -1):
            here = np.logaddexp.reduce(pairs[None] + (e[:, i + 1] + bwd[:, i + 1])[:, None, :], axis=2)
            bwd[:, i] = np.where(real[:, i + 1, None], here, bwd[:, i + 1])
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        p = np.exp(fwd + bwd - z[:, None, None]) * real[:, :, None]
        edge = fwd[:, :-1, :, None] + pairs + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]
        expected = (np.exp(np.minimum(edge, 0)) * both[:, :, None, None]).sum((0, 1))
        diff = hot - p
        grad = np.zeros((nf + 1, 3))
        for k in range(3):
            grad[:, k] = np.bincount(index.ravel(), np.repeat(diff[:, :, k].ravel(), index.shape[2]), nf + 1)
        grad -= 0.5 * unary
        gpair = seen_pairs - expected - 0.5 * pairs
        gu += grad**2
        gp += gpair**2
        unary += 0.4 * grad / np.sqrt(gu)
        pairs += 0.4 * gpair / np.sqrt(gp)
        unary[nf] = 0
    return Field(number, unary[:nf], pairs)


def sample_texts(docs: DataFrame, sample: int = SAMPLE, max_chars: int = MAX_CHARS) -> list[str]:
    """At most 2 * sample different texts of at most max_chars code points, in an order of their own: reruns agree."""
    short = docs.select(F.col("text").cast("string").alias("text")).where(F.length("text").between(1, max_chars))
    cue = F.lower("text").rlike("password|passwd|secret|token|api_?key|akia|[0-9a-f]{16}")
    chosen = hash_sample(short, cue, sample).orderBy(F.desc("gated"), F.xxhash64("text"), "text")
    return [r.text for r in chosen.toLocalIterator()]


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    tokens = _TOKEN.findall(text)
    if not tokens:
        return []
    tags = field.decode(field.scores(tokens, file_feature(text, len(tokens))))
    marked = np.flatnonzero(tags).tolist()
    if not marked:
        return []
    found, out = list(_TOKEN.finditer(text)), []
    runs: list[list[int]] = []
    for i in marked:
        if runs and runs[-1][-1] == i - 1 and tags[i] == 2:
            runs[-1].append(i)
        else:
            runs.append([i])
    for run in runs:
        a, b = found[run[0]].start(), found[run[-1]].end()
        a += _NAMED.match(text[a:b]).end()
        b -= len(text[a:b]) - len(text[a:b].rstrip("\"'),;.]}>`"))
        if a < b and not any(x < b and a < y for x, _, y in base):
            out.append((a, 3, b))
    return out


def held_out(texts: list[str], seed: int = 5) -> dict[str, float]:
    """Trains on four fifths of the texts; in the others plants a secret each that no base pattern covers and a look-alike each.
    Shares of secrets found and of look-alikes taken for one, and added spans for 1,000 tokens of the texts as they are."""
    fold = lambda t: zlib.crc32(t.encode("utf-8", "surrogatepass")) % 5 == 0
    field, r = fit([t for t in texts if not fold(t)]), random.Random(seed)
    found = secrets = wrong = plain = added = tokens = 0
    for text in filter(fold, texts):
        gaps = [m.start() for m in re.finditer(r"\x20", text)]
        if not gaps or field is None:
            continue
        added += len(added_spans(text, base_spans(text), field))
        tokens += len(text.split())
        for new, value in (planted(r), (_lookalike(r), "")):
            at = r.choice(gaps) + 1
            changed = text[:at] + new + " " + text[at:]
            base = base_spans(changed)
            a = at + new.index(value)
            b = a + len(value) if value else at + len(new)
            if any(x < b and a < y for x, _, y in base):
                continue
            hit = any(x < b and a < y for x, _, y in added_spans(changed, base, field))
            found, secrets, wrong, plain = found + (hit and bool(value)), secrets + bool(value), wrong + (hit and not value), plain + (not value)
    return {"found": found / max(1, secrets), "wrong": wrong / max(1, plain), "added_per_1000": 1000 * added / max(1, tokens), "secrets": secrets}


def secret_spans(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf; spans is kind:start:end in code points."""
    spark = docs.sparkSession
    small_batches(spark)
    field = field or fit(sample_texts(docs))
    sent = spark.sparkContext.broadcast(field and (field.number, field.unary, field.pairs))
    names = (*KINDS, "crf")

    def line(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value and Field(*sent.value)
        for batch in batches:
            out = []
            for cell in batch.column(1):
                text = cell.as_py() or ""
                base = base_spans(text)
                more = added_spans(text, base, own) if own and text else []
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                out.append((*n, hashlib.sha256(line(base).encode()).hexdigest(), line(base + more), len(more)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")
