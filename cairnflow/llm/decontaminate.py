"""Benchmark decontamination: broadcast set of normalised test n-grams, window scan, verified hits, removal.

The set is arrays: the windows' 64-bit hashes in order, where each stands in the items' normalised text, and its item. A document's
windows are looked up by hash and verified by comparing the words. A benchmark of at most `max_windows` windows is broadcast
so (about 25 bytes a window and its text). A larger one isn't: its windows are dealt by hash, a filter of at most MOST_BITS
bits is broadcast instead, and the documents' windows that pass it are joined to the benchmark's, verified by a second,
independent hash. Either way the documents are scanned once, and results are the same.

Nulls: a null text has no words; a null item_id counts as an item of its own named ''. Repeated items count once, ties of windows
between items count for each item. Items without words occur nowhere. Repeated document rows each get a row. Very long texts are
scanned whole. Empty tables give empty results, other columns are ignored, or passed on by the removing functions, which judge a
row by its own text, so rows without an id or with a shared one too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import durable, fresh_name, place_of, row_key, small_batches

WINDOW, MAX_WINDOWS, MOST_BITS = 10, 2_000_000, 1 << 27
#: A-Z lowered; all but digits, letters and bytes of code points over 0x7F become spaces.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_NOT_A_WORD = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def word_hashes(parts: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, parts), np.uint64, len(parts))


def window_hashes(words: np.ndarray, width: int, multiplier: np.uint64 = _MULTIPLIERS[0]) -> np.ndarray:
    """A 64-bit hash of each window of words."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * multiplier + words[k : k + n]
    return out ^ out >> np.uint64(31)


class NgramSet:
    """Windows of test items by their length, as arrays: hash, place in the text, item."""

    def __init__(self, items: Iterator[tuple[str, str | None]], window: int = WINDOW) -> None:
        self.names: list[str] = []
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        pieces, at = [], 0
        for item, text in items:
            words = normal_words(text)
            if not words:
                continue
            width = min(window, len(words))
            starts = at + np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))
            hashes = window_hashes(word_hashes(words), width)
            _, once = np.unique(hashes, return_index=True) if len(hashes) > 1 else (None, np.arange(len(hashes)))
            if len(once) < len(hashes):  # windows that repeat within the item, not just their hashes, stand once
                joined, seen, once = b" ".join(words), set(), []
                for i in range(len(hashes)):
                    window_ = joined[starts[i] - at : starts[i + width] - at - 1]
                    if window_ not in seen:
                        seen.add(window_)
                        once.append(i)
            places = np.sort(np.asarray(once, np.int64))
            parts.setdefault(width, []).append((hashes[places], starts[places], np.full(len(places), len(self.names), np.int32)))
            self.names.append(item)
            pieces += [b" ".join(words), b"\n"]
            at = int(starts[-1])
        self.text = b"".join(pieces)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width, rows in parts.items():
            h, place, item_ = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.argsort(h, kind="stable")
            place = place.astype(np.uint32 if at < 1 << 32 else np.int64)
            self.windows[width] = (h[order], place[order], item_[order])

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit windows as (start, width), items found."""
        parts = normal_words(text)
        words = word_hashes(parts) if self.windows else ()
        hits, items = [], set()
        for width, (hashes, places, names) in self.windows.items():
            if len(parts) < width:
                continue
            rolled = window_hashes(words, width)
            at = np.searchsorted(hashes, rolled)
            at[at == len(hashes)] = 0
            for i in np.flatnonzero(hashes[at] == rolled).tolist():
                window, k, hit = b" ".join(parts[i : i + width]), int(at[i]), False
                while k < len(hashes) and hashes[k] == rolled[i]:
                    place = int(places[k])
                    if self.text[place : place + len(window)] == window and self.text[place + len(window)] in b" \n":
                        items.add(self.names[names[k]])
                        hit = True
                    k += 1
                if hit:
                    hits.append((i, width))
        return len(parts), hits, items


def _merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Windows as disjoint spans [start, stop)."""
    out: list[list[int]] = []
    for a, width in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + width)
        else:
            out.append([a, a + width])
    return [(a, b) for a, b in out]


_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))


def _n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), _NOT_A_WORD), lambda x: x != ""))


def broadcast_set(benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS):
    """The benchmark's set as a broadcast variable, or None if it has more than max_windows words. Counted before it is fetched."""
    items = _items(benchmark)
    if (items.agg(F.sum(_n_words(F.col("text")))).first()[0] or 0) > max_windows:
        return None
    return benchmark.sparkSession.sparkContext.broadcast(NgramSet(((r.item, r.text) for r in items.distinct().orderBy("item", "text").toLocalIterator()), window))


def _benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct (width, h, g, item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if words := normal_words(text.as_py()):
                    width, hashed = min(window, len(words)), word_hashes(words)
                    h, g = (window_hashes(hashed, width, m).view(np.int64) for m in _MULTIPLIERS)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), width, np.int32)), pa.array(h), pa.array(g), pa.array([item] * len(h), pa.string())], ["width", "h", "g", "item"])

    return durable(_items(benchmark).mapInArrow(run, "width int, h long, g long, item string").distinct())


def _dealt(docs: DataFrame, benchmark: DataFrame, window: int, most_bits: int) -> tuple[DataFrame, DataFrame]:
    """For a benchmark too large to broadcast: (doc_id, row, n) a row per row of docs, and distinct hits (doc_id, row, pos, width, item)."""
    from .linededup import bit_filter

    known = _benchmark_windows(benchmark, window)
    widths = sorted(r.width for r in known.select("width").distinct().collect())  # at most `window` of them
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(known.select("h").distinct(), most_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        last = np.uint64(8 * len(bits) - 1)
        for batch in batches:
            for doc_id, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = normal_words(text.as_py())
                hashed = word_hashes(words)
                cols = [[np.array([-1])], [np.array([len(words)])], [np.array([0])], [np.array([0])]]
                for width in widths:
                    h = window_hashes(hashed, width)
                    at = h & last
                    ok = np.flatnonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                    g = window_hashes(hashed, width, _MULTIPLIERS[1])
                    for c, x in zip(cols, (ok, np.full(len(ok), width), h[ok].view(np.int64), g[ok].view(np.int64)), strict=True):
                        c.append(x)
                pos, width_, h, g = (np.concatenate(c).astype(np.int64) for c in cols)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(pos), pa.int64()), pa.array([row] * len(pos), pa.int64()), pa.array(pos), pa.array(width_), pa.array(h), pa.array(g)], ["doc_id", "row", "pos", "width", "h", "g"])

    texts = docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), F.col("text").cast("string"))
    found = durable(texts.mapInArrow(run, "doc_id long, row long, pos long, width long, h long, g long"))
    hits = found.where("pos >= 0").join(known, ["width", "h", "g"]).select("doc_id", "row", "pos", "width", "item").distinct()
    return found.where("pos < 0").select("doc_id", "row", F.col("width").alias("n")), durable(hits)


def _spans(hits: DataFrame) -> DataFrame:
    """Hits -> (doc_id, row, pos, fresh, stop): windows in order, with how many words no earlier one has."""
    order = W.partitionBy("doc_id", "row").orderBy("pos", "width")
    before = F.coalesce(F.max(F.col("pos") + F.col("width")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    stop = F.col("pos") + F.col("width")
    return hits.select("doc_id", "row", "pos", "width").distinct().select("doc_id", "row", "pos", F.greatest(F.lit(0), stop - F.greatest(before, "pos")).alias("fresh"), stop.alias("stop"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    small_batches(docs.sparkSession)
    known = broadcast_set(benchmark, window, max_windows)
    if known is not None:

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for n, hits, items in (known.value.scan(x.as_py()) for x in batch.column(1)):
                    spans = _merged(hits)
                    rows.append((n, sum(b - a for a, b in spans), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(spans)))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], _NAMES)

        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, _SCHEMA)
    rows, hits = _dealt(docs, benchmark, window, most_bits)
    covered = _spans(hits).groupBy(F.col("doc_id").alias("id"), F.col("row").alias("key")).agg(F.sum("fresh").alias("n_hit"))
    items = hits.groupBy(F.col("doc_id").alias("i"), F.col("row").alias("k")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    of = F.col("key").eqNullSafe(F.col("k")) & F.col("id").eqNullSafe(F.col("i"))
    found = covered.join(items, of)
    out = rows.join(found, F.col("row").eqNullSafe(F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", F.col("n").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS, most_bits: int = MOST_BITS) -> DataFrame:
    """docs without those that hold a benchmark window; texts aren't shuffled if the set is broadcast."""
    small_batches(docs.sparkSession)
    known, place = broadcast_set(benchmark, window, max_windows), place_of(docs, "text")
    if known is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not known.value.scan(x.as_py())[1] for x in batch.column(place)], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    _, hits = _dealt(docs, benchmark, window, most_bits)
    id_, row_ = fresh_name(docs, "id"), fresh_name(docs, "row")
    hit = hits.select(F.col("doc_id").alias(id_), F.col("row").alias(row_)).distinct()
    return docs.join(hit, (row_key() == F.col(row_)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_)), "left_anti").select(*docs.columns)


#: As the lowered pattern, on the text as it is.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    places = [m.span() for m in _WORD.finditer(text)]
    for a, b in reversed(spans):
        text = text[: places[a][0]] + text[places[b - 1][1] :]
    return text


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS, most_bits: int = MOST_BITS) -> DataFrame:
    """docs whose texts lack the words inside hit windows; what stood between two words that stay is kept."""
    small_batches(docs.sparkSession)
    known, place, n = broadcast_set(benchmark, window, max_windows), place_of(docs, "text"), len(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            found = [known.value.scan(t)[1] for t in texts] if known is not None else [list(zip(x or (), y or (), strict=True)) for x, y in zip(*(batch.column(k).to_pylist() for k in (-2, -1)), strict=True)]
            texts = [_without(t, _merged(h)) if h else t for t, h in zip(texts, found, strict=True)]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, pa.string())).select(range(n))

    if known is not None:
        return docs.mapInArrow(cut, docs.schema)
    _, hits = _dealt(docs, benchmark, window, most_bits)
    id_, row_, at_, width_ = (fresh_name(docs, x) for x in ("id", "row", "at", "width"))
    spans = _spans(hits).where("fresh > 0").groupBy(F.col("doc_id").alias(id_), F.col("row").alias(row_)).agg(F.sort_array(F.collect_list(F.struct("pos", (F.col("stop") - F.col("pos")).alias("w")))).alias("x"))
    spans = spans.select(id_, row_, F.transform("x", lambda v: v["pos"]).alias(at_), F.transform("x", lambda v: v["w"]).alias(width_))
    out = docs.join(spans, (row_key() == F.col(row_)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_)), "left").select(*docs.columns, at_, width_)
    return out.mapInArrow(cut, docs.schema)


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM g),
p AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
h AS (SELECT p.doc_id, p.i, p.k, g.item FROM p JOIN g ON p.k = g.k AND p.s = g.s),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
