"""Line dedup by a segment-partition edit join.

A line is dropped if it occurred before and isn't blank, or if it and another line that occurred before have at least MIN_CHARS
code points and are within TAU edits; before means a smaller (doc_id, row key, line number) of the first occurrence. Blank lines of
fewer code points stay as they are. Lines end at "\\n".

A line is cut into TAU + 1 segments, so a line within TAU edits holds one of them unchanged. Each distinct line sends its own
segments and, for each length it may match, the substrings at the positions where a segment can stand (multi-match-aware
windows), as hashes of (length, segment number, content). Lines that meet under a hash are filtered by the parity of their
character counts (an edit flips at most two bits). The hashes are dealt once, sorted by key; a run keeps numbers only. Copies are
merged before any comparison. What goes on is the lines that met another one, once for each key, never the pairs: a group of n
near copies makes n rows. A key under which more than HOT different lines meet is only named in that pass; a second one deals
its lines to pair tasks. Contents are fetched for the lines that met: a filter of bits, of a bounded size, keeps other lines out
of that shuffle; a join decides. Then the lines of a key come in the order of their first occurrences, and each is compared with
the ones before it, likeliest first, by a banded bit-parallel edit distance until one is near: all that the verdict needs.

Rows are told apart by (doc_id, row key), the key a hash of id and text: rows that agree in both are copies of one document and are
judged alike, different texts under one id are judged each for itself, and rows without an id are judged like any other, last in
the order. A null text has no lines and stays null. Empty texts and tables stay so. Very long texts and lines are whole: an edit
comparison needs memory in proportion to a line. Equal first occurrences can't tie, as (doc_id, row key, line) is one place.
Other columns are passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, durable, fresh_name, pair_tasks, place_of, row_key, small_batches
from .simhash import runs

TAU, MIN_CHARS, BLOCK, HOT = 2, 24, 2048, 20_000
_BUCKETS = 61
#: Bits for each wanted line in the filter that goes before the shuffle of contents, and the most it has (16 MB).
SPREAD, MOST_BITS = 16, 1 << 27


def segments(n: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of an even partition; the last ones are a code point longer."""
    base, more = divmod(n, parts)
    out, at = [], 0
    for i in range(parts):
        size = base + (i >= parts - more)
        out.append((at, size))
        at += size
    return out


def probes(n: int, tau: int) -> list[tuple[int, int, int, int]]:
    """(length of the other line, segment number, start, size) of the substrings that a line of n code points probes with."""
    out = []
    for other in range(n - tau, n + 1):
        shift = n - other
        for i, (at, size) in enumerate(segments(other, tau + 1)):
            low = max(0, at - i, at + shift - (tau - i))
            high = min(n - size, at + i, at + shift + (tau - i))
            out += [(other, i, start, size) for start in range(low, high + 1)]
    return out


def edits_within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most k: a band of 2k + 1 bits moves down the diagonal, a column at a time."""
    if abs(len(a) - len(b)) > k:
        return False
    if a == b:
        return True
    low, high = 0, min(len(a), len(b))
    while low < high:  # common prefix by bisection
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[-mid:] == b[-mid:] else (low, mid - 1)
    if low:
        a, b = a[:-low], b[:-low]
    if len(a) > len(b):
        a, b = b, a
    m, width = len(a), 2 * k + 1
    if m <= k:
        return _small(a, b) <= k
    padded = [None] * k + list(a) + [None] * (k + 1 + len(b) - m)  # the band below and above the pattern matches nothing
    full, top = (1 << width) - 1, 1 << (width - 1)
    vp, vn, score = ((1 << (k + 1)) - 1) << k, 0, k
    for j, ch in enumerate(b, 1):
        x = 0
        for t in range(width):  # bit t: pattern row j - k + t
            if padded[j - 1 + t] == ch:
                x |= 1 << t
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        if j + k <= m:
            score += not d0 & top
        else:
            row = m - j + k
            if row < 0:
                return False
            score += (hp >> row & 1) - (hn >> row & 1)
        vp, vn = (hn | ~((d0 >> 1) | hp)) & full, (d0 >> 1) & hp
    return score <= k


def _small(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _keys(tau: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from functools import lru_cache

        from xxhash import xxh3_64_intdigest as digest
        from xxhash import xxh64_intdigest

        plan = lru_cache(1 << 14)(lambda n: tuple(probes(n, tau)))
        own = lru_cache(1 << 14)(lambda n: frozenset((n, i, at, size) for i, (at, size) in enumerate(segments(n, tau + 1))))
        for batch in batches:
            lines = {x for text in batch.column(0).to_pylist() if text for x in text.split("\n") if len(x) >= min_chars}
            keys, ids, marks = [], [], []
            for line in lines:
                n, raw = len(line), line.encode("utf-32-le", "surrogatepass")
                odd = np.bincount(np.frombuffer(raw, np.uint32) % _BUCKETS, minlength=_BUCKETS) & 1
                sig = int(np.packbits(odd, bitorder="little").view(np.uint8).tobytes().ljust(8, b"\0")[:8][::-1].hex(), 16) << 2
                me, mine = xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42), own(n)
                for p in plan(n):
                    other, i, start, size = p
                    keys.append(digest(raw[4 * start : 4 * (start + size)], other * (tau + 1) + i))
                    ids.append(me)
                    marks.append(sig | (3 if p in mine else 2))
            cols = [np.array(x, np.uint64).view(np.int64) for x in (keys, ids, marks)]
            for i in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in cols], ["key", "h", "mark"])

    return run


def bit_filter(wanted: DataFrame, most_bits: int) -> np.ndarray:
    """Bits of the column h, one set for each value modulo the size; past most_bits it lets more through, never less."""
    bits = min(most_bits, 1 << max(15, (SPREAD * wanted.count()).bit_length()))
    at = F.pmod(F.col("h"), F.lit(bits)) + 1
    parts = wanted.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros((bits >> 15, 4096), np.uint8)
    for r in parts.toLocalIterator():
        out[r.part - 1] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _wanted(sent, min_chars: int):
    """(doc_id, row, text) -> the lines (doc_id, row, line, h, content) whose hash the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        bits = sent.value
        last = 8 * len(bits) - 1
        for batch in batches:
            for doc_id, row, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                lines = [(i, x) for i, x in enumerate((cell.as_py() or "").split("\n")) if len(x) >= min_chars]
                if not lines:
                    continue
                h = np.array([xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) for _, x in lines], np.uint64)
                at = h & np.uint64(last)
                ok = np.flatnonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                if len(ok):
                    cols = pa.array([doc_id] * len(ok), pa.int64()), pa.array([row] * len(ok), pa.int64()), pa.array([lines[i][0] for i in ok], pa.int32()), pa.array(h[ok].view(np.int64)), pa.array([lines[i][1] for i in ok], pa.string())
                    yield pa.RecordBatch.from_arrays(list(cols), ["doc_id", "row", "line", "h", "content"])

    return run


def _distinct(h: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines once each; a line that is an index entry and a probe stays both."""
    order = np.argsort(h, kind="stable")
    h, mark = h[order], mark[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[first], np.bitwise_or.reduceat(mark, first)


def _near(h: np.ndarray, mark: np.ndarray, left: np.ndarray, right: np.ndarray, tau: int) -> np.ndarray:
    """Places, in order, of lines of left and right that meet a different line of the other side, one of both an index entry, whose parities allow tau edits."""
    met = np.zeros(len(h), bool)
    for s in range(0, len(left), BLOCK):
        for t in range(0, len(right), BLOCK):
            rows, other = left[s : s + BLOCK], right[t : t + BLOCK]
            near = np.bitwise_count((mark[rows][:, None] ^ mark[other][None, :]) >> np.uint64(2)) <= 2 * tau
            near &= (h[rows][:, None] != h[other][None, :]) & (((mark[rows][:, None] | mark[other][None, :]) & np.uint64(1)) > 0)
            met[rows[near.any(1)]] = met[other[near.any(0)]] = True
    return np.flatnonzero(met)


def _batch(group: np.ndarray, h: np.ndarray | None, mark: np.ndarray | None) -> pa.RecordBatch:
    rest = [pa.nulls(len(group), pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in (h, mark)]
    return pa.RecordBatch.from_arrays([pa.array(group.view(np.int64)), *rest], ["g", "h", "mark"])


def _meet(tau: int, hot: int):
    """Sorted (key, h, mark) -> (key, h, mark) of the lines that meet a different one, one of both an index entry, whose parities allow
    tau edits; a key of more than hot lines goes out as (key, null, null)."""

    def solve(key: np.ndarray, h: np.ndarray, mark: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts, stops = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
        many = np.flatnonzero(stops - starts > 1)
        some = np.array([(h[a:b] != h[a]).any() for a, b in zip(starts[many], stops[many], strict=True)], bool)
        for r in many[some] if len(many) else []:
            hh, mm = _distinct(h[starts[r] : stops[r]], mark[starts[r] : stops[r]])
            if len(hh) > hot:
                yield _batch(key[starts[r] : starts[r] + 1], None, None)
                continue
            met = _near(hh, mm, np.flatnonzero(mm & np.uint64(1)), np.arange(len(hh)), tau)
            if len(met):
                yield _batch(np.repeat(key[starts[r]], len(met)), hh[met], mm[met])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        passed = None  # a hot key whose rows go by

        for batch in batches:
            new = tuple(batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
            if passed is not None:
                stays = new[0] != passed
                new = tuple(c[stays] for c in new)
            if not len(new[0]):
                continue
            held.append(new)
            if new[0][-1] != held[0][0][0]:  # keep the last run, it may go on
                key, h, mark = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.flatnonzero(key != key[-1])[-1]) + 1
                held[:] = [(key[cut:], h[cut:], mark[cut:])]
                yield from solve(key[:cut], h[:cut], mark[:cut])
            if sum(len(x[0]) for x in held) > 2 * hot:
                key = held[0][0][:1]
                h, mark = _distinct(*(np.concatenate(x) for x in list(zip(*held, strict=True))[1:]))
                held[:] = [(np.repeat(key, len(h)), h, mark)]
                if len(h) > hot:
                    yield _batch(key, None, None)
                    held.clear()
                    passed = key[0]
        if held:
            yield from solve(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _meet_task(tau: int):
    def solve(t: pa.Table) -> pa.RecordBatch | None:
        h, mark, chunk = t["h"].to_numpy().view(np.uint64), t["mark"].to_numpy().view(np.uint64), t["chunk"].to_numpy()
        met = _near(h, mark, *(np.flatnonzero(chunk == t[k][0].as_py()) for k in ("task_a", "task_b")), tau)
        return _batch(t["g"].to_numpy()[met], h[met], mark[met]) if len(met) else None

    return lambda batches: runs(batches, ["key", "task_a", "task_b"], solve)


def met_lines(texts: DataFrame, tau: int, min_chars: int, hot: int) -> DataFrame:
    """(text) -> (g, h, mark): the lines, by hash, that meet another line in the group g, a key or one of its pair tasks, and may be near it.
    Every two lines that may be near share a group."""
    keyed = texts.select("text").mapInArrow(_keys(tau, min_chars), "key long, h long, mark long")
    met = durable(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_meet(tau, hot), "g long, h long, mark long"))
    few, large = met.where("h is not null"), met.where("h is null").select(F.col("g").alias("key")).distinct()
    if large.isEmpty():
        return few
    lines = keyed.join(large, "key").groupBy("key", "h").agg(F.bit_or("mark").alias("mark"))
    tasks = pair_tasks(durable(lines), "key", "h", BLOCK).withColumn("g", F.xxhash64("key", "task_a", "task_b"))
    tasks = tasks.repartition("key", "task_a", "task_b").sortWithinPartitions("key", "task_a", "task_b")
    return durable(few.unionByName(tasks.mapInArrow(_meet_task(tau), "g long, h long, mark long")))


def _verified(tau: int):
    """Lines (g, h, mark, c, content), in each group by first occurrence -> (h, c) of those near an earlier one."""

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        sig, texts = t["mark"].to_numpy().view(np.uint64) >> np.uint64(2), t["content"].to_pylist()
        later = []
        for i in range(1, len(texts)):
            apart = np.bitwise_count(sig[:i] ^ sig[i])
            may = np.flatnonzero(apart <= 2 * tau)
            if any(texts[j] != texts[i] and edits_within(texts[j], texts[i], tau) for j in may[np.argsort(apart[may], kind="stable")]):
                later.append(i)
        return pa.RecordBatch.from_arrays([t[k].combine_chunks().take(pa.array(later)) for k in ("h", "c")], ["h", "c"]) if later else None

    return lambda batches: runs(batches, ["g"], solve)


def dropped_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, hot: int = HOT) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, row, line, near): numbers (from 0) of the lines that go; near: no earlier equal line, only a near one."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), F.col("text").cast("string"))
    lines = texts.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("line", "content")).where((F.length("content") >= min_chars) | F.col("content").rlike(f"[^{SPACE}]"))
    lines = lines.select("doc_id", "row", "line", F.xxhash64("content").alias("h"), F.crc32(F.col("content").cast("binary")).alias("c"), "content")
    here = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line")
    occurrences = durable(lines.drop("content"))
    known = durable(occurrences.groupBy("h", "c").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")))

    met = met_lines(texts, tau, min_chars, hot)
    ids = durable(met.select("h").distinct())
    wanted = known.join(ids, "h", "left_semi").select(F.col("h").alias("wh"), F.col("c").alias("wc"), "first")
    there = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row")) & (F.col("line") == F.col("first.line")) & (F.col("h") == F.col("wh")) & (F.col("c") == F.col("wc"))
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(ids, MOST_BITS))
    lines = texts.mapInArrow(_wanted(sent, min_chars), "doc_id long, row long, line int, h long, content string").withColumn("c", F.crc32(F.col("content").cast("binary")))
    contents = durable(lines.join(wanted, there).select("h", "c", "first", "content").dropDuplicates(["h", "c"]))
    groups = met.join(contents, "h").repartition("g").sortWithinPartitions("g", "first").select("g", "h", "mark", "c", "content")
    near = groups.mapInArrow(_verified(tau), "h long, c long").distinct().withColumn("is_near", F.lit(True))

    judged = durable(known.join(near, ["h", "c"], "left").where("n > 1 or is_near").select("h", "c", "first", F.coalesce("is_near", F.lit(False)).alias("is_near")))
    out = occurrences.join(judged, ["h", "c"]).where(F.col("is_near") | ~here.eqNullSafe(F.col("first")))
    return out.select("doc_id", "row", "line", F.col("is_near").alias("near"))


def _without(place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(place).to_pylist(), []
            for text, numbers in zip(texts, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if text is not None and numbers:
                    drop = set(numbers)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
                out.append(text)
            batch = batch.set_column(place, batch.schema.field(place), pa.array(out, pa.string()))
            yield batch.select(range(batch.num_columns - 1))

    return run


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the dropped lines taken out of their texts; every row stays, with all its columns (n_chars follows the text)."""
    gone_, row_, id_ = (fresh_name(docs, x) for x in ("gone", "row", "id"))
    gone = dropped_lines(docs).groupBy(F.col("doc_id").alias(id_), F.col("row").alias(row_)).agg(F.collect_set("line").alias(gone_))
    out = docs.join(gone, (row_key() == F.col(row_)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_)), "left").select(*docs.columns, gone_)
    out = out.mapInArrow(_without(place_of(docs, "text")), docs.schema)
    if "n_chars" in (names := [x.lower() for x in docs.columns]):
        at = names.index("n_chars")
        out = out.withColumn(docs.columns[at], F.length("text").cast(docs.schema[at].dataType))
    return out.select(*docs.columns)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, n_near, dropped_sha256 (of the dropped numbers in order, comma-joined), one row per row of docs."""
    gone = dropped_lines(docs).groupBy(F.col("doc_id").alias("id"), "row").agg(F.array_sort(F.collect_set("line")).alias("gone"), F.count_distinct(F.when(F.col("near"), F.col("line"))).alias("n_near"))
    all_ = docs.select(F.col("doc_id").cast("long"), row_key().alias("r"), F.size(F.split(F.col("text").cast("string"), "\n", -1)).alias("n"), F.col("text").isNull().alias("none"))
    out = all_.join(gone, (F.col("r") == F.col("row")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    numbers = F.array_join(F.coalesce("gone", F.array().cast("array<int>")), ",")
    return out.select("doc_id", F.when(F.col("none"), 0).otherwise(F.col("n")).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.sha2(numbers.cast("binary"), 256).alias("dropped_sha256"))
