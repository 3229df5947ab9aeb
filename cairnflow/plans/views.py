"""The recommender's facts, derived from the driver's tables by SQL that Spark and the oracle both run."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rank import global_rank
from .session import durable

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations")

#: user_id, item_id, rating 1..10, one row a pair
RATINGS = """ratings AS (SELECT o_custkey AS user_id, l_partkey AS item_id, max(1 + (CAST(l_quantity AS INT) - 1) % 10) AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey)"""
#: item_id, title, studio, type, episodes, score, year, status; the year and the season come from the part's numbers
CATALOG = """catalog AS (SELECT p_partkey AS item_id, p_name AS title, p_brand AS studio, p_type AS type, p_size AS episodes, round(p_retailprice / 200, 4) AS score,
  1950 + CAST(p_partkey % 75 AS INT) AS year FROM part)"""
#: F32 and F33 and the hash holdout: class, and for positives the fold
SPLIT = """classed AS (SELECT user_id, item_id, rating, CASE WHEN rating >= 8 THEN 'positive' WHEN rating <= 4 THEN 'explicit_negative' WHEN rating BETWEEN 5 AND 7 THEN 'neutral' ELSE 'ignored' END AS class FROM ratings),
ordered AS (SELECT user_id, item_id, rating, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY md5(concat('42:', CAST(user_id AS STRING), ':', CAST(item_id AS STRING))), item_id) AS rn FROM classed WHERE class = 'positive'),
sized AS (SELECT *, CASE WHEN n < 5 THEN 0 WHEN n < 20 THEN 1 ELSE CAST(floor(n / 10) AS INT) END AS v, CASE WHEN n < 5 THEN 0 WHEN n < 10 THEN 1 WHEN n < 20 THEN 2 ELSE CAST(floor(n / 10) AS INT) END AS t FROM ordered),
split AS (SELECT user_id, item_id, rating, n, CASE WHEN rn <= v THEN 'validation' WHEN rn <= v + t THEN 'test' ELSE 'train' END AS fold FROM sized)"""
#: Train statistics, ranks and buckets
STATS = """stats AS (SELECT r.item_id, sum(CASE WHEN s.fold = 'train' THEN 1 ELSE 0 END) AS positives, count(*) AS observed, sum(r.rating) AS total FROM ratings r LEFT JOIN split s ON r.user_id = s.user_id AND r.item_id = s.item_id WHERE coalesce(s.fold, 'train') = 'train' GROUP BY r.item_id),
ranked AS (SELECT *, row_number() OVER (ORDER BY positives DESC, item_id) AS pop_rank, count(*) OVER () AS n_items FROM stats),
bucketed AS (SELECT *, CASE WHEN pop_rank <= ceil(n_items * 2e-1) THEN 'head' WHEN pop_rank <= ceil(n_items * 5e-1) THEN 'mid' ELSE 'tail' END AS bucket FROM ranked)"""
def _top(name: str, ranking: str, place: str, n: int = 10) -> str:
    """The top n of what a user hasn't seen, by a ranking with places 1, 2, ...: a user who knows m items finds n among the first
    n + m places, so these places are listed and joined by equality; the work is in proportion to what users know."""
    return f"""pool_{name} AS (SELECT user_id, explode(sequence(1, {n} + m)) AS place FROM reach),
unseen_{name} AS (SELECT p.user_id, h.item_id, h.{place} AS place FROM pool_{name} p JOIN {ranking} h ON h.{place} = p.place LEFT JOIN known k ON p.user_id = k.user_id AND h.item_id = k.item_id WHERE k.item_id IS NULL),
{name} AS (SELECT user_id, item_id, rank FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY place) AS rank FROM unseen_{name}) x WHERE rank <= {n})"""


#: what users know at evaluation, who is evaluated, and how much each knows
KNOWN = """known AS (SELECT r.user_id, r.item_id FROM ratings r LEFT JOIN split s ON r.user_id = s.user_id AND r.item_id = s.item_id WHERE coalesce(s.fold, 'train') = 'train'),
evaluated AS (SELECT user_id, count(*) AS relevant FROM split WHERE fold = 'test' GROUP BY user_id),
reach AS (SELECT e.user_id, e.relevant, count(k.item_id) AS m FROM evaluated e LEFT JOIN known k ON e.user_id = k.user_id GROUP BY e.user_id, e.relevant)"""
#: Popularity top-10 of what a user hasn't seen
TOP10 = f"""{KNOWN}, {_top("top", "ranked", "pop_rank")}"""
#: the same by Bayesian quality
QUALITY10 = f"""mean AS (SELECT sum(total) * 1e0 / sum(observed) AS mu FROM stats),
by_quality AS (SELECT s.item_id, row_number() OVER (ORDER BY round((s.total + 50 * m.mu) / (s.observed + 50), 9) DESC, s.item_id) AS quality_rank FROM stats s, mean m), {_top("best", "by_quality", "quality_rank")}"""


def metrics(name: str, top: str) -> str:
    """Binary metrics per user; the ideal has min(relevant, 10) hits."""
    return f"""hits_{name} AS (SELECT t.user_id, sum(1 / log2(t.rank + 1)) AS dcg, count(*) AS hits, min(t.rank) AS first FROM {top} t JOIN split s ON t.user_id = s.user_id AND t.item_id = s.item_id AND s.fold = 'test' GROUP BY t.user_id),
{name} AS (SELECT e.user_id, e.relevant, coalesce(h.dcg, 0e0) / i.idcg AS ndcg10, coalesce(h.hits, 0) * 1e0 / e.relevant AS recall10, CASE WHEN h.hits > 0 THEN 1e0 ELSE 0e0 END AS hit10, coalesce(1e0 / h.first, 0e0) AS mrr10
  FROM evaluated e JOIN ideal i ON i.k = least(e.relevant, 10) LEFT JOIN hits_{name} h ON h.user_id = e.user_id)"""


#: DCG of k hits at the first k places, up to 20
IDEAL = "ideal AS (" + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS k, CAST('{sum(1 / math.log2(i + 1) for i in range(1, k + 1))!r}' AS DOUBLE) AS idcg" for k in range(1, 21)) + ")"
#: A15 with both depths, over the first twenty
METRICS20 = f"""{_top("top20", "ranked", "pop_rank", 20)}, {IDEAL},
hits20 AS (SELECT t.user_id, sum(CASE WHEN t.rank <= 10 THEN 1 / log2(t.rank + 1) ELSE 0e0 END) AS dcg10, sum(1 / log2(t.rank + 1)) AS dcg20, count(CASE WHEN t.rank <= 10 THEN 1 END) AS n10, count(*) AS n20, min(t.rank) AS first
  FROM top20 t JOIN split s ON t.user_id = s.user_id AND t.item_id = s.item_id AND s.fold = 'test' GROUP BY t.user_id),
metrics20 AS (SELECT e.user_id, e.relevant, coalesce(h.dcg10, 0e0) / i.idcg AS ndcg10, coalesce(h.dcg20, 0e0) / j.idcg AS ndcg20, coalesce(h.n10, 0) * 1e0 / e.relevant AS recall10, coalesce(h.n20, 0) * 1e0 / e.relevant AS recall20,
  CASE WHEN h.n10 > 0 THEN 1e0 ELSE 0e0 END AS hit10, coalesce(1e0 / h.first, 0e0) AS mrr20
  FROM evaluated e JOIN ideal i ON i.k = least(e.relevant, 10) JOIN ideal j ON j.k = least(e.relevant, 20) LEFT JOIN hits20 h ON h.user_id = e.user_id)"""
METRICS = f"""{IDEAL}, {metrics("metrics", "top")}"""
#: The tops that are written once instead of joined in a query: (name, ranking, place, n)
TOPS = (("top", "ranked", "pop_rank", 10), ("top20", "ranked", "pop_rank", 20), ("best", "by_quality", "quality_rank", 10))


#: The most bytes of input files for one shuffle partition, and the most shuffled bytes that are read as one: a row in the memory of an
#: aggregate takes some 20 times what it takes in a file.
ROOM = 8 << 20


def make_room(spark: SparkSession, sf_dir: str, tables: list[str]) -> None:
    """As many shuffle partitions as the tables need for a task to hold no more of a large folder than of a small one. The settings are read when a
    query runs, after the operator has returned, so they stay set for the session; more partitions or a smaller size of the user's are left."""
    size = 0
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    partitions, advised = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if int(spark.conf.get(partitions)) < (needed := math.ceil(size / ROOM)):
        spark.conf.set(partitions, str(needed))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(advised)) > ROOM:
        spark.conf.set(advised, f"{ROOM}b")


def bind(spark: SparkSession, sf_dir: str, text: str | None = None) -> None:
    """Registers the tables of a folder, or those that a text names, as temporary views."""
    named = TABLES if text is None else [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    for t in named:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    if text is not None:
        make_room(spark, sf_dir, named)


_facts: dict[tuple, dict[str, DataFrame]] = {}


def _sources(spark: SparkSession, sf_dir: str) -> tuple:
    """Which application reads which files: paths, lengths and times of change of what ratings are made of."""
    out: list = [spark.sparkContext.applicationId, sf_dir]
    for name in ("lineitem", "orders"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        out += [fs.getContentSummary(path).getLength(), fs.getFileStatus(path).getModificationTime()]
    return tuple(out)


def _held(spark: SparkSession) -> bool:
    """Whether the folder that the facts were written to is still there."""
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        return False
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def forget() -> None:
    """The next query writes its facts anew."""
    _facts.clear()


def facts(spark: SparkSession, sf_dir: str, ranked: bool) -> dict[str, DataFrame]:
    """Ratings, split and, if asked for, ranked statistics, written once for each application and state of the source files: a
    materialised view that a change of a source replaces."""
    key = _sources(spark, sf_dir)
    if key not in _facts or not _held(spark):
        _facts.clear()  # of another folder, state or application
        bind(spark, sf_dir, "lineitem orders")
        ratings = durable(spark.sql(f"WITH {RATINGS} SELECT * FROM ratings"))
        ratings.createOrReplaceTempView("ratings")
        _facts[key] = {"ratings": ratings, "split": durable(spark.sql(f"WITH {SPLIT} SELECT * FROM split"))}
    known = _facts[key]
    for name, df in known.items():
        df.createOrReplaceTempView(name)
    if ranked and "ranked" not in known:
        stats = spark.sql(f"WITH {STATS.split('ranked AS (')[0].rstrip().removesuffix(',')} SELECT * FROM stats")
        known["ranked"] = global_rank(stats, [F.desc("positives"), F.asc("item_id")], "pop_rank", "n_items")
        known["stats"] = known["ranked"].drop("pop_rank", "n_items")
        for name in ("ranked", "stats"):
            known[name].createOrReplaceTempView(name)
        known["bucketed"] = spark.sql(STATS.partition("bucketed AS (")[2].removesuffix(")"))
        known["bucketed"].createOrReplaceTempView("bucketed")
    return known


def fact(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], written: bool = False) -> DataFrame:
    """A further fact over the same sources, written once (by the build itself if it says so) and kept as a view of that name like the others."""
    known = facts(spark, sf_dir, True)
    if name not in known:
        known[name] = build() if written else durable(build())
        known[name].createOrReplaceTempView(name)
    return known[name]


def first_unseen(users: DataFrame, ratings: DataFrame, held_out: DataFrame, ranking: DataFrame, n: int) -> DataFrame:
    """users (user_id), ratings and held_out (user_id, item_id: what isn't known though rated), ranking (item_id, place 1, 2, ...) -> user_id, item_id, rank: the first
    n that a user doesn't know. A user who knows c items of the ranking's head finds n among the first n + c places, so only what users know
    there is joined; the head reaches as far as the user with the most ratings can see."""
    most = ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0] or 0
    head = durable(ranking.where(F.col("place") <= n + most).select("item_id", F.col("place").cast("long").alias("place")))
    head = F.broadcast(head) if n + most <= MOST_HEAD else head
    met = ratings.select("user_id", "item_id").join(head, "item_id").join(held_out.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    known = met.groupBy("user_id").agg(F.collect_list("place").alias("known"))
    known = users.select("user_id").distinct().join(known, "user_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<bigint>")))
    places = F.slice(F.array_except(F.sequence(F.lit(1).cast("long"), n + F.size("known").cast("long")), F.col("known")), 1, n)
    return known.select("user_id", F.posexplode(places).alias("k", "place")).join(head, "place").select("user_id", "item_id", (F.col("k") + 1).alias("rank"))


#: The most places of a ranking's head that are broadcast.
MOST_HEAD = 1 << 20


def _top_view(spark: SparkSession, sf_dir: str, name: str, ranking: str, place: str, n: int) -> None:
    """A top of TOPS as a written view."""

    def build() -> DataFrame:
        known = facts(spark, sf_dir, True)
        if ranking == "by_quality":
            mu = known["stats"].agg(F.sum("total") * 1.0 / F.sum("observed")).first()[0]
            scored = known["stats"].select("item_id", F.round((F.col("total") + 50 * F.lit(mu).cast("double")) / (F.col("observed") + 50), 9).alias("quality"))
            ranked = global_rank(scored, [F.desc("quality"), F.asc("item_id")], place, "n_items")
        else:
            ranked = known["ranked"]
        split = known["split"]
        return first_unseen(split.where("fold = 'test'"), known["ratings"], split.where("fold <> 'train'"), ranked.select("item_id", F.col(place).alias("place")), n)

    fact(spark, sf_dir, name, build)


def _written(spark: SparkSession, sf_dir: str, text: str) -> str:
    """Takes the definitions of what is written out of a text that builds on the split: it reads the views instead."""
    if f"{RATINGS}, {SPLIT}" not in text:
        return text
    facts(spark, sf_dir, STATS in text)
    for top in TOPS:
        if (definition := _top(*top)) in text:
            _top_view(spark, sf_dir, *top)
            text = re.sub(rf",\s*{re.escape(definition)}|{re.escape(definition)}\s*,", "", text)
    left = text.replace(f"{RATINGS}, {SPLIT}", "").replace(STATS, "")
    if re.search("(FROM|JOIN) (classed|ordered)", left):  # what the split is made of is asked for too
        left = text.replace(f"{RATINGS}, {SPLIT}", SPLIT.rpartition("split AS (")[0].rstrip().removesuffix(",")).replace(STATS, "")
    left = re.sub(r"(,\s*)+", ", ", re.sub(r"^WITH[\s,]+", "WITH ", left))
    return re.sub(r"^WITH\s+SELECT", "SELECT", left)


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    bind(spark, sf_dir, text)
    return spark.sql(_written(spark, sf_dir, text))
