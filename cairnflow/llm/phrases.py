"""Phrase collocations by position bitmaps per word, extended depth-first, counts summed over shards.

Texts are lower-cased (A-Z) and cut into pieces and words. Every task gathers the texts of a language into shards of about SHARD_BYTES;
within a shard each word has a bitmap of the positions where it stands, pieces are kept apart by an empty position, and a phrase's bitmap
marks its last words. Shifting a phrase's bitmap by one and intersecting it with a word's gives the longer phrase's bitmap, its number of bits
the occurrences, overlaps included; phrases are extended depth-first, block by block of first words. Bitmaps are compressed:
packed 64 to a number where at least one in DENSE positions is set, as sorted positions otherwise; a result takes the form that
suits it. Counts of shards are summed by Spark.

A phrase can't be frequent unless its parts are. Shorter phrases are counted first by a 64-bit hash; a filter of at most MOST_BITS bits holds
the frequent ones, is broadcast, and prunes the extension. Hashes that meet and a full filter let more through, never less: the last
pass counts the phrases themselves. A vocabulary or a list of phrases is never gathered anywhere.

A candidate is cut after each of its words; its score is the lowest floor(SCALE a a / (l r)) in decimal numbers of 38 digits (so exact up
to 10^16 occurrences), ties to the first cut. A candidate goes if a longer one that contains it has half its occurrences or more.

Nulls: a null text is empty, a null language is `und` (as is the language of that name). Repeated rows count as often as they stand there. Very
long texts fill several shards, cut between pieces or, within a piece, between words with the words before repeated as context. Ties of score
and occurrences go by phrase in byte order. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .linededup import bit_filter
from .shared import durable, small_batches, tidy

LONGEST, LEAST, TOP, SCALE, COVERED = 3, 10, 2000, 1_000_000, 50
SHARD_BYTES, BLOCK, DENSE, MOST_BITS, PART = 1 << 21, 1 << 18, 64, 1 << 27, 10_000
#: Upper case to lower case, tab to space, what ends a piece to a line feed.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
_SHIFT, _MASK = np.int64(21), np.int64((1 << 21) - 1)


def chunks(data: bytes, longest: int, limit: int = SHARD_BYTES) -> Iterator[tuple[bytes, int]]:
    """Folded text in parts of about `limit` bytes, each with the number of its first words that were counted in the part before."""
    at, context = 0, b""
    while len(data) - at > limit:
        cut = data.rfind(b"\n", at, at + limit)
        if cut > at:
            yield context + data[at:cut], len(context.split(b" ")) - 1 if context else 0
            at, context = cut + 1, b""
            continue
        cut = data.rfind(b" ", at, at + limit)
        if cut <= at:  # a word longer than a part, or nothing before it
            ends = [x for x in (data.find(b" ", at + limit), data.find(b"\n", at + limit)) if x >= 0]
            cut = min(ends, default=len(data))
        part = context + data[at:cut]
        yield part, len(context.split(b" ")) - 1 if context else 0
        if data[cut : cut + 1] == b"\n":
            at, context = cut + 1, b""
        else:
            last = part.rpartition(b"\n")[2].split(b" ")
            last = [x for x in last if x][-(longest - 1) :] if longest > 1 else []
            at, context = cut, b"".join(x + b" " for x in last)
    if at < len(data):
        yield context + data[at:], len(context.split(b" ")) - 1 if context else 0


def word_ids(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """Words by number from 1, and the numbers in order; 0 stands between pieces."""
    parts = pc.split_pattern(pa.array([data.replace(b"\n", b" \n ")], pa.large_binary()), b" ").flatten().dictionary_encode()
    words, ids = parts.dictionary, parts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    number = np.arange(1, len(words) + 1)
    none, end = (pc.index(words, pa.scalar(x, words.type)).as_py() for x in (b"", b"\n"))
    for i in (none, end):
        if i >= 0:
            number[i] = 0
    ids = ids[ids != none]
    return words, number[ids]


def word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    """By number of the word; that of 0 is unused."""
    from xxhash import xxh64_intdigest

    seed = xxh64_intdigest(lang.encode(), 7)
    return np.array([0, *(xxh64_intdigest(x, seed) for x in words.to_pylist())], np.uint64)


def phrase_hashes(hashes: np.ndarray, phrases: np.ndarray) -> np.ndarray:
    """phrases: word numbers, a row each."""
    h = hashes[phrases[:, 0]]
    for k in range(1, phrases.shape[1]):
        h = (h ^ h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) + hashes[phrases[:, k]] * np.uint64(2 * k + 1)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h


def in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Shard:
    """ids: word numbers by position, 0 where nothing that matters stands; the first `lead` positions are context: they extend but don't count."""

    def __init__(self, ids: np.ndarray, lead: int = 0, dense: int = DENSE, block: int = BLOCK):
        self.n, self.lead, self.block = len(ids), lead, block
        self.next = np.concatenate((ids, [0]))
        keys = np.sort(ids[(at := np.flatnonzero(ids))] << _SHIFT | at)
        self.place, word = keys & _MASK, keys >> _SHIFT
        self.start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.zeros(0, np.int64)
        self.stop = np.append(self.start[1:], len(word)) if len(word) else self.start
        self.word = word[self.start]
        self.least = max(64, self.n // dense)
        size = self.stop - self.start
        self.packed = {int(w): self._pack(self.place[a:b]) for w, a, b in zip(self.word[size >= self.least], self.start[size >= self.least], self.stop[size >= self.least], strict=True)}
        self.any = np.bitwise_or.reduce(list(self.packed.values())) if self.packed else None
        self.own = self._pack(np.arange(lead, self.n))

    def _pack(self, places: np.ndarray) -> np.ndarray:
        bits = np.zeros((self.n + 64) // 64 * 64, bool)
        bits[places] = True
        return np.packbits(bits, bitorder="little").view(np.uint64)

    def _unpack(self, bits: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little")[: self.n])

    @staticmethod
    def _shifted(bits: np.ndarray) -> np.ndarray:
        return bits << np.uint64(1) | np.concatenate(([np.uint64(0)], bits[:-1] >> np.uint64(63)))

    def _meet(self, phrases: np.ndarray, tag: np.ndarray, after: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted positions after each phrase's (tagged) met with all words' bitmaps: longer phrases, their counts, and bitmaps (tags, positions)."""
        word = self.next[after]
        ok = word > 0
        keys = tag[ok] * np.int64(len(self.word) + 1) + np.searchsorted(self.word, word[ok])
        keys = np.sort(keys << _SHIFT | after[ok])
        place, group = keys & _MASK, keys >> _SHIFT
        if not len(keys):
            return np.zeros((0, phrases.shape[1] + 1), np.int64), group, group, place
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(first, len(group)))
        longer = np.column_stack((phrases[group[first] // (len(self.word) + 1)], self.word[group[first] % (len(self.word) + 1)]))
        kept = keep(longer)
        counts = np.add.reduceat((place >= self.lead).astype(np.int64), first)
        inside = np.repeat(kept, size)
        return longer[kept], counts[kept], np.repeat(np.arange(kept.sum()), size[kept]), place[inside]

    def _grow(self, phrases: np.ndarray, tag: np.ndarray, after: np.ndarray, depth: int, keep) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        longer, counts, tag, place = self._meet(phrases, tag, after, keep)
        if len(longer):
            yield longer, counts
            if longer.shape[1] < depth:
                yield from self._grow(longer, tag, place + 1, depth, keep)

    def _grow_packed(self, phrase: list[int], bits: np.ndarray, depth: int, keep) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        moved = self._shifted(bits)
        longer = np.array([[*phrase, w] for w in self.packed], np.int64)
        sparse: list[tuple[list[int], np.ndarray]] = []
        for row, ok in zip(longer, keep(longer), strict=True):
            if not ok:
                continue
            met = moved & self.packed[int(row[-1])]
            if n := int(np.bitwise_count(met).sum()):
                yield row[None, :], np.array([int(np.bitwise_count(met & self.own).sum())])
                if len(row) < depth:
                    if n >= self.least:
                        yield from self._grow_packed(row.tolist(), met, depth, keep)
                    else:
                        sparse.append((row.tolist(), self._unpack(met) + 1))
        if sparse:
            tag = np.repeat(np.arange(len(sparse)), [len(x) for _, x in sparse])
            yield from self._grow(np.array([x for x, _ in sparse], np.int64), tag, np.concatenate([x for _, x in sparse]), depth, keep)
        rest = self._unpack(moved & ~self.any)
        yield from self._grow(np.array([phrase], np.int64), np.zeros(len(rest), np.int64), rest, depth, keep)

    def phrases(self, depth: int, keep) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word numbers, a phrase a row; counts) of the phrases of 1 to depth words; keep(phrases) says which may matter."""
        if len(self.word):
            yield self.word[:, None], np.add.reduceat((self.place >= self.lead).astype(np.int64), self.start)
        if depth < 2 or not len(self.word):
            return
        thin = np.flatnonzero(self.stop - self.start < self.least)
        size = (self.stop - self.start)[thin]
        for part in np.split(thin, np.flatnonzero(np.diff(np.cumsum(size) // self.block)) + 1) if len(thin) else []:
            tag = np.repeat(np.arange(len(part)), (self.stop - self.start)[part])
            places = np.concatenate([self.place[self.start[i] : self.stop[i]] for i in part])
            yield from self._grow(self.word[part][:, None], tag, places + 1, depth, keep)
        for w, bits in self.packed.items():
            yield from self._grow_packed([w], bits, depth, keep)


def _shards(batches: Iterator[pa.RecordBatch], longest: int, limit: int) -> Iterator[tuple[str, pa.Array, np.ndarray, int]]:
    """(lang, words, ids, lead) of the shards of a task."""
    waiting: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def of(lang: str) -> tuple[str, pa.Array, np.ndarray, int]:
        size.pop(lang)
        return (lang, *word_ids(b"\n".join(waiting.pop(lang))), 0)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(FOLD)
            if len(data) > limit:
                for part, lead in chunks(data, longest, limit):
                    yield (lang, *word_ids(part), lead)
                continue
            if size.get(lang, 0) + len(data) > limit:
                yield of(lang)
            waiting.setdefault(lang, []).append(data)
            size[lang] = size.get(lang, 0) + len(data) + 1
            if sum(size.values()) > 4 * limit:
                yield of(max(size, key=size.get))
    for lang in list(waiting):
        yield of(lang)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def _pruned(lang: str, words: pa.Array, ids: np.ndarray, filters: list):
    """The ids without words that can't matter, and which longer phrases can."""
    hashes = word_hashes(lang, words)
    if filters:
        good = in_filter(filters[0].value, hashes)
        good[0] = False
        ids = np.where(good[ids], ids, 0)

    def keep(phrases: np.ndarray) -> np.ndarray:
        ok = np.ones(len(phrases), bool)
        d = phrases.shape[1]
        for size, part in ((d, phrases), (d - 1, phrases[:, 1:])):
            if 2 <= size <= len(filters):
                ok[ok] = in_filter(filters[size - 1].value, phrase_hashes(hashes, part[ok]))
        return ok

    return ids, hashes, keep


def _hash_counts(docs: DataFrame, depth: int, filters: list, limit: int) -> DataFrame:
    """(h, n), for single words (lang, h, n): occurrences of the phrases of `depth` words by hash, which the language is part of."""
    keys = ["lang", "h"] if depth == 1 else ["h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, ids, lead in _shards(batches, depth, limit):
            ids, hashes, keep = _pruned(lang, words, ids, filters)
            for phrases, counts in Shard(ids, lead).phrases(depth, keep):
                if phrases.shape[1] == depth:
                    h = phrase_hashes(hashes, phrases).view(np.int64)
                    own = [pa.array([lang] * len(h), pa.string())] if depth == 1 else []
                    yield pa.RecordBatch.from_arrays([*own, pa.array(h), pa.array(counts)], [*keys, "n"])

    return _texts(docs).mapInArrow(run, f"{'lang string, ' if depth == 1 else ''}h long, n long").groupBy(*keys).agg(F.sum("n").alias("n"))


def frequencies(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, limit: int = SHARD_BYTES, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """docs (lang, text) -> (lang, phrase, words, f) of phrases of 1 to `longest` words that occur `least` times and more, and (lang, n)."""
    spark = docs.sparkSession
    small_batches(spark)
    with tidy(spark):
        return _frequencies(spark, docs, longest, least, limit, most_bits)


def _frequencies(spark: SparkSession, docs: DataFrame, longest: int, least: int, limit: int, most_bits: int) -> tuple[DataFrame, DataFrame]:
    filters: list = []
    words = durable(_hash_counts(docs, 1, [], limit))
    totals = durable(words.groupBy("lang").agg(F.sum("n").alias("n")))
    for depth in range(1, longest):
        counts = words if depth == 1 else _hash_counts(docs, depth, filters, limit)
        filters.append(spark.sparkContext.broadcast(bit_filter(durable(counts.where(F.col("n") >= least).select("h").distinct()), most_bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, ids, lead in _shards(batches, longest, limit):
            ids, _, keep = _pruned(lang, words, ids, filters)
            for phrases, counts in Shard(ids, lead).phrases(longest, keep):
                text = pc.binary_join_element_wise(*(words.take(pa.array(phrases[:, k] - 1)) for k in range(phrases.shape[1])), pa.scalar(b" ", words.type)).cast(pa.large_string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(text), pa.string()), text.cast(pa.string()), pa.array(counts)], ["lang", "phrase", "f"])

    found = _texts(docs).mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return durable(found.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "f")), totals


def _part(words: Column, start: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _first(rows: DataFrame, key: str, order: list[Column], top: int, part: int = PART) -> DataFrame:
    """The first `top` rows of each key with their rank; large keys are cut into parts by a hash, whose firsts are ranked again."""
    rows, rank = durable(rows), F.row_number().over(W.partitionBy(key, "_part").orderBy(*order))
    parts = math.ceil((rows.groupBy(key).count().agg(F.max("count")).first()[0] or 0) / max(part, 4 * top))
    while parts > 1:
        rows = durable(rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", rank).where(F.col("rank") <= top).drop("rank", "_part"))
        parts = math.ceil(parts * top / max(part, 4 * top))
    return rows.withColumn("_part", F.lit(0)).withColumn("rank", rank).where(F.col("rank") <= top).drop("_part")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, scale: int = SCALE, covered: int = COVERED, limit: int = SHARD_BYTES, most_bits: int = MOST_BITS) -> DataFrame:
    """docs (lang, text) -> lang, rank, phrase, a, l, r, n, score: each language's first `top` candidates."""
    found, totals = frequencies(docs, longest, least, limit, most_bits)
    several = found.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = several.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"left": _part(F.col("w"), F.lit(1), F.col("cut")), "right": _part(F.col("w"), F.col("cut") + 1, F.col("words") - F.col("cut"))})
    part = lambda name, f: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    whole = lambda x: F.col(x).cast("decimal(38,0)")
    cuts = cuts.withColumn("score", F.call_function("div", whole("a") * whole("a") * F.lit(scale).cast("decimal(38,0)"), whole("l") * whole("r")))
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    inner = several.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inner = inner.select("lang", _part(F.col("w"), F.col("start"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    rows = left.select("lang", "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), F.col("x.score").alias("score"))
    ranked = _first(rows, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, doc, generate_subscripts(x, 1) AS piece, unnest(x) AS t FROM (SELECT lang, doc, string_split_regex(t, '[.,;:!?\\x0A-\\x0D]') AS x FROM d)),
w AS (SELECT lang, doc, piece, generate_subscripts(x, 1) AS i, unnest(x) AS w FROM (SELECT lang, doc, piece, regexp_extract_all(t, '[^\\x20\\x09]+') AS x FROM p)),
g AS (SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY lang, doc, piece ORDER BY i)),
f1 AS (SELECT lang, w, count(*) AS f FROM g GROUP BY ALL), f2 AS (SELECT lang, w, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL), f3 AS (SELECT lang, w, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
c AS (SELECT f2.lang, f2.w || ' ' || f2.w2 AS phrase, 1 AS k, f2.f AS a, x.f AS l, y.f AS r FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w = f2.w JOIN f1 y ON y.lang = f2.lang AND y.w = f2.w2 WHERE f2.f >= 10
  AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND 2 * f3.f >= f2.f AND (f3.w = f2.w AND f3.w2 = f2.w2 OR f3.w2 = f2.w AND f3.w3 = f2.w2))
  UNION ALL SELECT f3.lang, f3.w || ' ' || f3.w2 || ' ' || f3.w3, 1, f3.f, x.f, y.f FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w = f3.w JOIN f2 y ON y.lang = f3.lang AND y.w = f3.w2 AND y.w2 = f3.w3
  UNION ALL SELECT f3.lang, f3.w || ' ' || f3.w2 || ' ' || f3.w3, 2, f3.f, x.f, y.f FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w = f3.w AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w = f3.w3),
s AS (SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM c),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b JOIN n USING (lang) QUALIFY rank <= 2000
"""
