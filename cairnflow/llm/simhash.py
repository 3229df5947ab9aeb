"""SimHash near-duplicates: pivot distance tables over blocks, exact verification, connected components.

Every two fingerprints within the limit agree on `64 bits / (limit + k)` blocks, k of them at least (pigeonhole), so pairs are
sought among fingerprints that agree on k blocks: exact, and no all-pairs scan. Inside such a group the pivot table decides:
each distinct fingerprint carries its Hamming distances to PIVOTS reference fingerprints, a pair whose distances to any
pivot differ by more than the limit is discarded (triangle inequality), survivors are verified by XOR and bit count.
Only distinct fingerprints are compared, groups over CHUNK rows are cut into pair tasks, and a task sends on a spanning
forest of what it linked, so neither copies nor near copies expand into pairs.

Nulls: a null text is empty; no words give fingerprint zero, linked like any other. A null doc_id keeps its row and takes the
component of its class; a component with only null ids has a null name. Repeated rows each get a row. Very long texts are hashed
whole, in blocks. Other columns are ignored. An empty table gives an empty result. `keep_one` keeps exactly one row of each
component: that of the smallest (doc_id, row key), ids before null; of rows that agree in id and text, any one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, durable, fresh_name, pair_tasks, row_key, small_batches

WIDTH, LIMIT, SEED, PIVOTS, CHUNK = 4, 4, 42, 32, 2048
#: References for the distance table: fixed by a seed, alike on every executor.
REFERENCES = np.random.default_rng(20240).integers(0, 2**64, PIVOTS, dtype=np.uint64)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """A bit is 1 if it is set in over half the shingles' XXH64, repeats included."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[width - 1 :].tolist() if len(parts) >= width else [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        block = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x.as_py()) for x in batch.column(2)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "row", "fp"])


def _pivot_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        table = np.bitwise_count(fps[:, None] ^ REFERENCES[None, :])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in table], pa.binary())], ["fp", "rep", "pivots"])


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], solve: Callable[[pa.Table], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """Calls solve for each run of equal keys in sorted batches; keeps one run in memory, and pair_tasks bounds a run."""
    held: list[pa.RecordBatch] = []

    def last(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(k)[i].as_py() for k in keys)

    def end() -> Iterator[pa.RecordBatch]:
        if held and (out := solve(pa.Table.from_batches(held))) is not None and out.num_rows:
            yield out
        held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and last(held[-1], held[-1].num_rows - 1) != last(batch, 0):
            yield from end()
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            col = batch.column(k).to_numpy(zero_copy_only=False)
            change |= col[1:] != col[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a:
                yield from end()
            held.append(batch.slice(a, b - a))
    yield from end()


def spanning(n: int, neighbours: Iterator[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links of a spanning forest of what (i, its partners) give; memory and output are linear in n."""
    label, out = np.arange(n), []
    for i, js in neighbours:
        labels, first = np.unique(label[js], return_index=True)
        new = labels != label[i]
        if new.any():
            out += [(i, int(js[k])) for k in first[new]]
            label[np.isin(label, labels[new])] = label[i]
    return out


def partners(fps: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray, limit: int, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For rows of left, the rows of right within the limit. The pivot table discards, XOR verifies."""
    for s in range(0, len(left), 256):
        rows = left[s : s + 256]
        near = np.ones((len(rows), len(right)), bool)
        for p in range(3):
            near &= np.abs(table[rows, p][:, None] - table[right, p][None, :]) <= limit
        if same:
            near &= rows[:, None] < right[None, :]
        i, j = np.nonzero(near)
        i, j = rows[i], right[j]
        for p in range(3, table.shape[1], 4):
            if not len(i):
                break
            fits = (np.abs(table[i, p : p + 4] - table[j, p : p + 4]) <= limit).all(1)
            i, j = i[fits], j[fits]
        fits = np.bitwise_count(fps[i] ^ fps[j]) <= limit
        i, j = i[fits], j[fits]
        if len(i):
            cuts = np.flatnonzero(np.diff(i)) + 1
            yield from zip(i[np.concatenate(([0], cuts))].tolist(), np.split(j, cuts), strict=True)


def _solver(limit: int) -> Callable:
    def solve(t: pa.Table) -> pa.RecordBatch | None:
        fps = t["fp"].to_numpy().view(np.uint64)
        rep = t["rep"].to_numpy()
        chunk = t["chunk"].to_numpy()
        a, b = t["task_a"][0].as_py(), t["task_b"][0].as_py()
        table = np.frombuffer(b"".join(t["pivots"].to_pylist()), np.uint8).reshape(len(fps), -1).astype(np.int16)
        left, right = np.flatnonzero(chunk == a), np.flatnonzero(chunk == b)
        links = spanning(len(fps), partners(fps, table, left, right, limit, a == b))
        if not links:
            return None
        i, j = np.array(links).T
        return pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], ["u", "v"])

    return lambda batches: runs(batches, ["key", "task_a", "task_b"], solve)


def agreed_blocks(n: int) -> int:
    """k, of limit + k blocks, that two near fingerprints must agree on: larger corpora take longer keys, results are the same."""
    return 1 if n < 1 << 24 else 2 if n < 1 << 33 else 3


def block_keys(fp: str, limit: int, k: int):
    """Array of long keys, one for each choice of k of limit + k blocks of the 64 bits."""
    m = limit + k
    cuts = [64 * i // m for i in range(m + 1)]
    keys = []
    for t, chosen in enumerate(combinations(range(m), k)):
        key, used = F.lit(t).cast("long"), 0
        for i in chosen:
            bits = cuts[i + 1] - cuts[i]
            key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned(F.col(fp), cuts[i]).bitwiseAND(F.lit((1 << bits) - 1)))
            used += bits
        keys.append(key)
    return F.array(*keys)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row, fp): one row per row of docs, over whole texts; row is the row key."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, row long, fp long")


def near_links(classes: DataFrame, limit: int = LIMIT, chunk: int = CHUNK, blocks: int | None = None) -> DataFrame:
    """classes (fp, rep): spanning links (u, v) between the reps of different fingerprints within the limit."""
    table = durable(classes.mapInArrow(_pivot_table, "fp long, rep long, pivots binary"))
    keyed = table.withColumn("key", F.explode(block_keys("fp", limit, blocks or agreed_blocks(table.count()))))
    tasks = pair_tasks(keyed, "key", "fp", chunk).repartition("key", "task_a", "task_b").sortWithinPartitions("key", "task_a", "task_b")
    return tasks.mapInArrow(_solver(limit), "u long, v long")


def _classed(docs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, fp) and (fp, group): every fingerprint's component, named by one of its fingerprints."""
    fps = durable(fingerprints(docs))
    found = connected_components(near_links(fps.select("fp", F.col("fp").alias("rep")).distinct(), limit))
    of = fps.select("fp").distinct().join(found.withColumnRenamed("id", "fp"), "fp", "left")
    return fps, durable(of.select("fp", F.coalesce("component", "fp").alias("group")))


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, fingerprint, component_id."""
    fps, of = _classed(docs, limit)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).join(of, "fp")
    names = durable(of.join(least.groupBy("group").agg(F.min("rep").alias("component_id")), "group").select("fp", "component_id"))
    return fps.join(names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row of each component of near-duplicates, with all its columns."""
    fps, of = _classed(docs, limit)
    here = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    rows = fps.groupBy("fp", "doc_id", "row").agg(F.count(F.lit(1)).alias("n"))
    best = rows.groupBy("fp").agg(F.min_by(F.struct("doc_id", "row", "n"), here).alias("x"), F.min(here).alias("h")).join(of, "fp")
    id_, row_, n_ = (fresh_name(docs, x) for x in ("id", "row", "n"))
    best = best.groupBy("group").agg(F.min_by("x", "h").alias("x")).select(F.col("x.doc_id").alias(id_), F.col("x.row").alias(row_), F.col("x.n").alias(n_))
    best = durable(best)
    kept = docs.join(best, (row_key() == F.col(row_)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_)))
    once = kept.where(F.col(n_) == 1).select(*docs.columns)
    if best.where(F.col(n_) > 1).isEmpty():
        return once
    copies = kept.where(F.col(n_) > 1).dropDuplicates([id_, row_]).select(*docs.columns)
    return once.unionByName(copies)
