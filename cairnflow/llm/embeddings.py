"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine verification, connected components.

Equal vectors of one label are merged into a class row first, with their number. A class's code in a table is the signs of its
products with `bits` hyperplanes; classes of one label and dimension that share a code are compared exactly in double precision.
A pair that meets in several tables counts in the first of them only. Large buckets are cut into pair tasks; a task sends on
counts per class and the component that each class has in the task, never pairs.

The number of bits follows the largest label's number of classes (about one chance partner to a bucket), and the number of
tables follows from the bits, such that a pair at the least cosine is missed with probability at most MISS; nearer pairs are
missed far less. So the promised recall is the same at every size; only cost depends on it. Past 2**23 classes of a label, bits
stay at MOST_BITS and buckets grow in proportion.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows without a label or an id, link with nothing.
Rows of one vec_id are one vector (the smallest label and embedding); rows without an id are one row, kept. Ties need no rule, since
a component's name is its smallest id. An empty table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, durable, merge_labels, pair_tasks, small_batches

LEAST, MISS, CHUNK, LEAST_BITS, MOST_BITS = 0.93, 0.005, 256, 10, 24
#: Rows that a task gathers before it compares, and the longest run that is compared pair by pair instead of by blocks.
GATHERED, SHORT = 4096, 32


def plan(n: int, least: float = LEAST, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for labels of up to n classes."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(n, 1))) + 1))
    agree = (1 - math.acos(least) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-agree))


def codes(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(n, tables) uint32 codes of the rows; hyperplanes are fixed by the dimension."""
    planes = np.random.default_rng([x.shape[1], 7]).standard_normal((x.shape[1], bits * tables))
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    return (signs * (np.uint32(1) << np.arange(bits, dtype=np.uint32))).sum(2, dtype=np.uint32)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows(cells: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length of a binary column's cells, as bytes."""
    ends = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64)
    data, sizes = np.frombuffer(cells.buffers()[2], np.uint8), np.diff(ends)
    return [(at, data[ends[:-1][at][:, None] + np.arange(n)]) for n in np.unique(sizes) for at in [np.flatnonzero(sizes == n)]]


def _coded(bits: int, tables: int):
    """(rep, m, lab, e) -> with dim, codes and the vector as bytes, in single precision where that loses nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("e")
            flat, ends = cells.values.to_numpy(zero_copy_only=False), np.asarray(cells.offsets)
            sizes = np.diff(ends)
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                x = np.ascontiguousarray(flat[ends[:-1][at][:, None] + np.arange(d)], float)
                with np.errstate(over="ignore"):
                    single = x.astype(np.float32)
                exact = (single == x).all(1)
                vec = pa.array([single[i].tobytes() if ok else x[i].tobytes() for i, ok in enumerate(exact)], pa.binary())
                c = pa.array([r.tobytes() for r in codes(_units(x), bits, tables)], pa.binary())
                own = [batch.column(k).take(pa.array(at)) for k in ("rep", "m", "lab")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(at), d, np.int32)), c, vec], ["rep", "m", "lab", "dim", "codes", "vec"])

    return run


def _keyed(tables: int):
    """(rep, lab, dim, codes) -> (rep, t, key): a row for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(tables, dtype=np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            c = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint32).reshape(-1, tables).astype(np.uint64)
            own = batch.column("lab").to_numpy(zero_copy_only=False).view(np.uint64) ^ (batch.column("dim").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            key = (c | t << np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
            key = (key ^ key >> np.uint64(29) ^ own[:, None]) * np.uint64(0x94D049BB133111EB)
            rep = np.repeat(batch.column("rep").to_numpy(), tables)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.tile(t.astype(np.int32), len(c))), pa.array((key ^ key >> np.uint64(31)).ravel().view(np.int64))], ["rep", "t", "key"])

    return run


def _pairs(starts: np.ndarray, stops: np.ndarray, a: np.ndarray, b: np.ndarray, chunk: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
    """Blocks (i, j, None) of the short runs' pairs, and (rows of chunk a, rows of chunk b, run) of the long runs."""
    size = stops - starts
    for n in np.unique(size[(size > 1) & (size <= SHORT)]).tolist():
        i, j = np.triu_indices(n, 1)
        first = starts[size == n]
        for s in range(0, len(first), max(1, 65536 // len(i))):
            at = first[s : s + max(1, 65536 // len(i)), None]
            x, y = (at + i).ravel(), (at + j).ravel()
            meet = (a[x] == b[x]) | (chunk[x] != chunk[y])
            yield x[meet], y[meet], None
    for r in np.flatnonzero(size > SHORT).tolist():
        at = np.arange(starts[r], stops[r])
        left, right = at[chunk[at] == a[at[0]]], at[chunk[at] == b[at[0]]]
        for s in range(0, len(left), 256):
            yield left[s : s + 256], right, r


def _solved(t: pa.Table, least: float) -> pa.RecordBatch | None:
    """Whole runs of (key, task_a, task_b) -> (u, v, n): partners of class u counted with their copies, or v in u's component."""
    key, a, b, chunk, table, rep, m, lab = (t[k].to_numpy() for k in ("key", "task_a", "task_b", "chunk", "t", "rep", "m", "lab"))
    dims, n = t["dim"].to_numpy(), len(t)
    count, label = np.zeros(n, np.int64), np.arange(n)
    c = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint32).reshape(n, -1)
    parts = _rows(t["vec"].combine_chunks())
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        x = np.zeros((n if len(at) == n else len(at), d))
        place = np.full(n, -1)
        place[at] = np.arange(len(at))
        for rows, raw in parts:
            if raw.shape[1] in (4 * d, 8 * d) and len(own := np.flatnonzero(dims[rows] == d)):
                x[place[rows[own]]] = np.ascontiguousarray(raw[own]).view(np.float32 if raw.shape[1] == 4 * d else np.float64)
        x = _units(x)
        change = np.flatnonzero((key[at][1:] != key[at][:-1]) | (a[at][1:] != a[at][:-1]) | (b[at][1:] != b[at][:-1])) + 1
        starts, stops = np.concatenate(([0], change)), np.concatenate((change, [len(at)]))
        for i, j, run in _pairs(starts, stops, a[at], b[at], chunk[at]):
            if run is None:
                near = np.einsum("ij,ij->i", x[i], x[j]) >= least
            else:
                grid = x[i] @ x[j].T >= least
                if a[at[i[0]]] == b[at[i[0]]]:
                    grid &= i[:, None] < j[None, :]
                p, q = np.nonzero(grid)
                i, j, near = i[p], j[q], np.ones(len(p), bool)
            i, j = at[i[near]], at[j[near]]
            same = c[i] == c[j]
            first = same.argmax(1)  # a pair counts in the first table where it agrees
            new = (first == table[i]) & same[np.arange(len(i)), first] & (lab[i] == lab[j])
            i, j = i[new], j[new]
            np.add.at(count, i, m[j])
            np.add.at(count, j, m[i])
            merge_labels(label, i, j)
    some, moved = np.flatnonzero(count), np.flatnonzero(label != np.arange(n))
    if not len(some):
        return None
    u, v = np.concatenate((rep[some], rep[moved])), pa.array([None] * len(some) + rep[label[moved]].tolist(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(u), v, pa.array(np.concatenate((count[some], np.zeros(len(moved), np.int64))))], ["u", "v", "n"])


def _solver(least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) < GATHERED:
                continue
            t = pa.Table.from_batches(held)
            last = np.ones(len(t), bool)
            for k in ("key", "task_a", "task_b"):
                col = t[k].to_numpy()
                last &= col == col[-1]
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0  # the last run may go on
            if cut and (out := _solved(t.slice(0, cut), least)) is not None:
                yield out
            held = t.slice(cut).combine_chunks().to_batches()
        if held and (out := _solved(pa.Table.from_batches(held), least)) is not None:
            yield out

    return run


def near_vectors(vectors: DataFrame, least: float = LEAST, miss: float = MISS, chunk: int = CHUNK) -> DataFrame:
    """vectors (vec_id, embedding, label) -> vec_id, n_links, component_id, kept."""
    small_batches(vectors.sparkSession, 2048)
    one = F.min(F.struct(F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("e"))).alias("x")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").groupBy("vec_id").agg(one).select("vec_id", "x.label", "x.e")
    finite = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("e", lambda v: v != 0)
    fit = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & finite, F.lit(False))
    rows = rows.select("vec_id", F.xxhash64(F.lit("label"), "label").alias("lab"), "e", fit.alias("fit"), F.xxhash64("label", "e").alias("h"), F.xxhash64(F.lit(5), "e", "label").alias("g"))
    rows = durable(rows.withColumn("e", F.when(F.col("fit"), F.col("e"))))
    classes = rows.where("fit").groupBy("h", "g").agg(F.min(F.struct("vec_id", "lab", "e")).alias("x"), F.count(F.lit(1)).alias("m"))
    classes = durable(classes.select("h", "g", F.col("x.vec_id").alias("rep"), "m", "x.lab", "x.e"))
    bits, tables = plan(classes.groupBy("lab").count().agg(F.max("count")).first()[0] or 0, least, miss)

    coded = durable(classes.select("rep", "m", "lab", "e").mapInArrow(_coded(bits, tables), "rep long, m long, lab long, dim int, codes binary, vec binary"))
    keyed = coded.select("rep", "lab", "dim", "codes").mapInArrow(_keyed(tables), "rep long, t int, key long")
    tasks = pair_tasks(keyed, "key", "rep", chunk).join(coded, "rep").repartition("key", "task_a", "task_b").sortWithinPartitions("key", "task_a", "task_b")
    found = durable(tasks.mapInArrow(_solver(least), "u long, v long, n long"))
    component = connected_components(found.where("v is not null").select("u", "v"))
    counts = found.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    known = classes.select("h", "g", "rep", "m").join(counts, "rep", "left").join(component.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("h", "g", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = rows.where("fit").select("vec_id", "h", "g").join(known, ["h", "g"]).select("vec_id", "n", "component")
    out = out.unionByName(rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component")))
    return out.select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


#: All pairs of one label by brute force, components by reachability; vectors of one id are taken to be one row.
ORACLE = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fit AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL
  AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM fit a JOIN fit b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach AS (SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u),
root AS (SELECT u AS vec_id, min(w) AS component_id FROM reach GROUP BY u),
degree AS (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u)
SELECT r.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, r.component_id, r.vec_id = r.component_id AS kept FROM root r LEFT JOIN degree d ON r.vec_id = d.vec_id"""
