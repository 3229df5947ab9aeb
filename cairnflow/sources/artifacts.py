"""Artifacts: discovery, JSON and CSV sources, load-or-build, validated vectors, published tables, digests, reuse checks, reports."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def discover(spark: SparkSession, folders: list[str], required: list[str]) -> str:
    """The first folder that holds all required files; any store that Spark reads."""
    for folder in folders:
        if all(exists(spark, f"{folder}/{name}") for name in required):
            return folder
    raise FileNotFoundError(f"no folder of {folders} holds {required}")


def published(spark: SparkSession, path: str) -> str:
    """The version of a published table that readers see."""
    fs, at = _file_system(spark, path)
    versions = sorted((x.getPath().getName() for x in fs.listStatus(at) if x.getPath().getName().startswith("v") and fs.exists(_file_system(spark, f"{path}/{x.getPath().getName()}/_SUCCESS")[1])), reverse=True)
    if not versions:
        raise FileNotFoundError(f"{path} has no complete version")
    return f"{path}/{versions[0]}"


def publish(df: DataFrame, path: str, keep: int = 2) -> str:
    """Writes a new version beside the old ones and lets it be seen by one rename, so a failed job leaves the old version in place;
    of the complete versions the last `keep` stay."""
    spark = df.sparkSession
    fs, root = _file_system(spark, path)
    fs.mkdirs(root)
    names = sorted(x.getPath().getName() for x in fs.listStatus(root))
    number = 1 + max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)
    hidden, final = f"{path}/_new-{uuid.uuid4().hex}", f"{path}/v{number:08d}"
    df.write.parquet(hidden)
    if not fs.rename(_file_system(spark, hidden)[1], _file_system(spark, final)[1]):
        raise OSError(f"{final} could not be put in place")
    old = [n for n in names if n[:1] == "v" and n[1:].isdigit()][: -(keep - 1) or None]
    for n in old:
        fs.delete(_file_system(spark, f"{path}/{n}")[1], True)
    return final


def load_or_build(spark: SparkSession, path: str, builders: list[Callable[[], DataFrame]]) -> DataFrame:
    """The published catalogue, else the first builder whose sources are there, published for the next time."""
    if exists(spark, path):
        return spark.read.parquet(published(spark, path))
    for build in builders:
        try:
            df = build()
        except FileNotFoundError:
            continue
        return spark.read.parquet(publish(df, path))
    raise FileNotFoundError(f"nothing at {path}, and no source to build it from")


def id_keyed(spark: SparkSession, path: str, id_: str, columns: list[str]) -> DataFrame:
    """JSON (a list, or an object with a list under "data"), JSON lines, or CSV with a header; the id as long, the rest as strings, absent
    columns null."""
    if path.lower().endswith((".json", ".jsonl")):
        raw = spark.read.option("multiLine", path.lower().endswith(".json")).json(path)
        if "data" in raw.columns and id_ not in raw.columns:
            raw = raw.select(F.explode("data").alias("x")).select("x.*")
    else:
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
        raw = raw.toDF(*(c.removeprefix("﻿") for c in raw.columns))
    has = set(raw.columns)
    return raw.select(F.col(id_).try_cast("long").alias(id_), *((F.col(c).cast("string") if c in has else F.lit(None).cast("string")).alias(c) for c in columns if c != id_)).where(F.col(id_).isNotNull())


def checked_vectors(vectors: DataFrame, catalog: DataFrame, id_: str = "item_id", vec: str = "vec", overlap: float = 0.9, width: int | None = None) -> DataFrame:
    """Vectors if they hold items, once each, of one width, all finite, and at least `overlap` of the catalogue; else ValueError. One pass, and one join."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    n = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_).alias("ids"), F.min(F.size(vec)).alias("low"), F.max(F.size(vec)).alias("high"), F.count_if(~F.coalesce(finite, F.lit(False))).alias("bad")).first()
    held = catalog.select(id_).distinct().join(vectors.select(id_, F.lit(True).alias("there")).distinct(), id_, "left").agg(F.avg(F.coalesce("there", F.lit(False)).cast("int"))).first()[0] or 0.0
    faults = [(not n.n, "it holds no items"), (n.n != n.ids, "an id is missing or repeated"), (n.low != n.high or (width and n.low != width), "widths differ"), (n.bad, f"{n.bad} vectors aren't finite"), (held < overlap, f"it covers {held:.3f} of the catalogue")]
    if wrong := [text for fault, text in faults if fault]:
        raise ValueError("; ".join(wrong))
    return vectors


def _digest(rows: DataFrame, lines: Callable[..., bytes]) -> DataFrame:
    """SHA-256 of the rows' bytes in order. A digest of a stream is sequential, so sorted partitions pass through the driver one
    after the other; it holds one at a time, and a catalogue's ids and texts, not its ratings, are what is digested."""
    h = hashlib.sha256()
    for r in rows.toLocalIterator():
        h.update(lines(*r))
    return rows.sparkSession.range(1).select(F.lit(h.hexdigest()).alias("digest"))


def ids_digest(df: DataFrame, id_: str) -> DataFrame:
    """SHA-256 over the sorted distinct ids, each ended by a line feed."""
    return _digest(df.select(F.col(id_).cast("long").alias("id")).distinct().orderBy("id"), lambda i: f"{i}\n".encode())


def joined_ids_digest(df: DataFrame, id_: str) -> DataFrame:
    """S13, the other encoding: the ids are ended by a zero byte."""
    return _digest(df.select(F.col(id_).cast("long").alias("id")).distinct().orderBy("id"), lambda i: f"{i}\0".encode())


def story_digest(df: DataFrame, id_: str, text: str) -> DataFrame:
    """SHA-256 over id and text of each item in the ids' order, each ended by a zero byte."""
    return _digest(df.select(F.col(id_).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).orderBy("id", "t"), lambda i, t: f"{i}\0{t}\0".encode("utf-8", "replace"))


def split_matches(spark: SparkSession, path: str, source: str, config: dict[str, str]) -> bool:
    """Whether a split at `path` was made of this source (length and time of change) by this configuration."""
    if not exists(spark, f"{path}/meta"):
        return False
    known = {r.key: r.value for r in spark.read.parquet(f"{path}/meta").collect()}
    return known == _identity(spark, source) | config


def _identity(spark: SparkSession, source: str) -> dict[str, str]:
    fs, at = _file_system(spark, source)
    s = fs.getContentSummary(at)
    return {"length": str(s.getLength()), "changed": str(fs.getFileStatus(at).getModificationTime())}


def write_split(split: DataFrame, path: str, source: str, config: dict[str, str]) -> None:
    """The split by fold, then what it was made of: without the second, split_matches says no."""
    spark = split.sparkSession
    split.write.mode("overwrite").partitionBy("fold").parquet(f"{path}/rows")
    spark.createDataFrame(sorted((_identity(spark, source) | config).items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_split(spark: SparkSession, path: str, users: DataFrame | None = None) -> DataFrame:
    """All rows, or those of some users."""
    rows = spark.read.parquet(f"{path}/rows")
    return rows if users is None else rows.join(users.select("user_id").distinct(), "user_id", "left_semi")


def report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """One file of a small result (csv, csv.gz or json)."""
    writer = df.coalesce(1).write.mode("overwrite")
    if kind == "json":
        writer.json(path)
    else:
        writer.option("header", True).option("compression", "gzip" if kind.endswith("gz") else "none").csv(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a table; more rows than `most` are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)]) + "\n"
