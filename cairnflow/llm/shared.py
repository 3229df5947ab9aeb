"""What several training-data operators share: durable cuts of lineage, blocked pair tasks, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs without these; the same set as Python's bytes.split() uses.
SPACE = "\\x20\\x09-\\x0D"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; a machine-local one only where all runs in one process."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="cairnflow-"))
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder: survives the loss of any executor, removed by Spark's cleaner."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written table."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds what a Python worker holds at once: texts come in batches of so many rows. The setting is read when a query
    runs, after the operator has returned, so it stays set for the session; a smaller one of the user's is left."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is run inside drops its shuffle files when it ends, instead of when the driver happens to collect its garbage: for steps that each
    end in `durable`. The setting before is put back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hash_sample(texts: DataFrame, gate: Column, size: int) -> DataFrame:
    """texts (text, not null) -> (text, gated): up to size distinct texts that pass the gate and up to size that don't, those first by a hash.

    A first pass estimates how many distinct texts there are of both sorts; by that, the second passes on only about 4 * size of
    each, copies merged before the shuffle, so no task gets more than a few samples' worth however large the table is.
    """
    rows = texts.select("text", gate.alias("gated"), F.xxhash64(F.lit("sample"), "text").alias("u"))
    n = rows.agg(*(F.approx_count_distinct(F.when(F.col("gated") == x, F.col("u"))) for x in (True, False))).first()
    with_gate, without = (min(1.0, 4 * size / max(1, x)) for x in n)
    unit = F.shiftrightunsigned("u", 32) / float(1 << 32)
    share = F.when(F.col("gated"), with_gate).otherwise(without)
    few = durable(rows.where((unit < max(with_gate, without)) & (unit < share)).dropDuplicates(["text"]))
    first = lambda x: few.where(F.col("gated") == x).orderBy("u", "text").limit(size)
    return durable(first(True).unionByName(first(False)).select("text", "gated"))


def words(text: Column | str) -> Column:
    """`[^\\x20\\x09-\\x0D]+` of a text; null gives none."""
    return F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(f"[^{SPACE}]+"), F.lit(0))


def ascii_lower(text: Column | str) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(id_: str = "doc_id", text: str = "text") -> Column:
    """A number of a row's id and text: rows that agree in both are copies of one row, rows that don't are told apart even if
    they share an id or have none (64 bits beside the id, so only the rows of one id could clash)."""
    return F.xxhash64(F.col(id_).cast("long"), F.lit("|"), F.col(text).cast("string"), F.col(text).isNull())


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df hasn't, in any capitals."""
    known, name = {x.lower() for x in df.columns}, "_" + name
    while name in known:
        name += "_"
    return name


def place_of(df: DataFrame, name: str) -> int:
    """The place of a column, in any capitals, as Spark resolves names."""
    return [x.lower() for x in df.columns].index(name)


def pair_tasks(rows: DataFrame, key: str, id_: str, chunk: int) -> DataFrame:
    """Deals the rows of each key to tasks such that every two rows of a key meet in exactly one task and no task gets
    more than about 32 * chunk rows, however large the key's group is.

    A group of n rows is cut into chunks of `chunk` rows by a hash of the id, in large groups of n / 16 rows, at most
    16 * chunk: fewer, longer chunks send fewer copies of a row. Task (key, a, b), a <= b, gets chunks a and b. Adds columns
    task_a, task_b and chunk. Keys with one row are left out. Exact: no row and no pair is dropped.
    """
    size = F.least(F.greatest(F.lit(chunk), F.col("_n") / 16), F.lit(16 * chunk))
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key, F.ceil(F.col("_n") / size).cast("int").alias("_c"))
    dealt = rows.join(counts, key).withColumn("chunk", F.pmod(F.xxhash64(F.lit(17), id_), F.col("_c")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_c") - 1))
    return dealt.withColumn("_o", other).withColumns({"task_a": F.least("chunk", "_o"), "task_b": F.greatest("chunk", "_o")}).drop("_c", "_o")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) long links -> (id, component): each linked id with the smallest id that it reaches.

    Alternates large-star and small-star steps. Neighbours are never gathered: a step is a minimum per node (combined before
    the shuffle) and a join, so a hub with any number of links is split by the adaptive skew join. Every round is written
    to the shared folder. Ends when a round changes nothing.
    """
    e = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    seen = mark(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = durable(small.distinct())
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of the linked rows i[k], j[k] in place: label[x] is the smallest row of x's component."""
    while True:
        a, b = label[i], label[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if not (differ := low < high).any():
            return
        np.minimum.at(label, high[differ], low[differ])
        while (label != (up := label[label])).any():
            label[:] = up
