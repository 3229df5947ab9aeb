"""Sources and sinks: strict and lenient ratings, string CSV catalogues, nested catalogue build, digests, durable writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S

RATING = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("rating", T.IntegerType())])


def strict_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Fails on a malformed row, a rating outside 1..10, or a repeated pair."""
    df = spark.read.schema(RATING).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    bad = df.where(~F.col("rating").between(1, 10) | F.col("rating").isNull()).count()
    twice = df.groupBy("user_id", "item_id").count().where("count > 1").limit(1).count()
    if bad or twice:
        raise ValueError(f"{bad} ratings outside 1..10" if bad else "a pair is repeated")
    return df


def lenient_ratings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, one row with the numbers of malformed and out-of-range rows)."""
    raw = string_csv(spark, path, [f.name for f in RATING.fields])
    df = raw.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in RATING.fields))
    whole = F.col("user_id").isNotNull() & F.col("item_id").isNotNull() & F.col("rating").isNotNull()
    ok = whole & F.col("rating").between(1, 10)
    report = df.agg(F.count_if(~whole).alias("malformed"), F.count_if(whole & ~F.col("rating").between(1, 10)).alias("out_of_range"), F.count_if(ok).alias("good"))
    return df.where(ok), report


def string_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as strings, so that cleaning decides what is a number."""
    return spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def build_catalog(items: DataFrame, genres: DataFrame, companies: DataFrame, entities: DataFrame, people: DataFrame) -> DataFrame:
    """items(item_id, title, score, rank), genres(item_id, genre), companies(item_id, company_id), people(item_id, person_id, role), entities(entity_id,
    name) -> one nested row per item. Placeholders and missing entities are dropped, lists are sorted and cut to 12 people."""
    real = entities.where(~F.lower("name").isin("none found", "add some", *S.UNKNOWN)).select("entity_id", S.clean_label(F.col("name")).alias("name"))
    g = genres.groupBy("item_id").agg(F.array_sort(F.collect_set(S.clean_label(F.col("genre")))).alias("genres"))
    c = companies.join(real, F.col("company_id") == F.col("entity_id")).groupBy("item_id").agg(F.array_sort(F.collect_set("name")).alias("studios"))
    p = people.join(real, F.col("person_id") == F.col("entity_id")).groupBy("item_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("name", "role", F.col("person_id").alias("id")))), 1, 12).alias("people"))
    out = items.select("item_id", S.fix_text("title").alias("title"), S.to_float(F.col("score")).alias("score"), S.to_int(F.col("rank")).alias("rank"))
    return out.join(g, "item_id", "left").join(c, "item_id", "left").join(p, "item_id", "left")


def enrich(archive: DataFrame, legacy: DataFrame) -> DataFrame:
    """Archive rows with legacy score and rank first and the larger members; legacy-only rows appended."""
    old = legacy.select("item_id", F.col("score").alias("old_score"), F.col("rank").alias("old_rank"), F.col("members").alias("old_members"))
    both = archive.join(old, "item_id", "left").withColumns({"score": F.coalesce("old_score", "score"), "rank": F.coalesce("old_rank", "rank"), "members": F.greatest("members", "old_members")})
    return both.drop("old_score", "old_rank", "old_members").unionByName(legacy.join(archive, "item_id", "left_anti"), allowMissingColumns=True)
