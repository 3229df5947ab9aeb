"""URL filters: fixed rules first, then association rules mined by FP-growth over URL tokens.

The pages that a fixed rule decides are the labelled ones; pages that none decides teach nothing. A labelled page's basket holds its
tokens without those that the rule itself names (its host's labels and its path's segments), so that what is mined says something
about other pages instead of repeating the rule. Baskets with their verdict go through FP-growth, tokens that always go together as one; rules that conclude a verdict are
kept above a support and a confidence, and a rule goes if a part of its tokens concludes the same no less surely. Each rule
is posted under its rarest token only (inverted index), then verified in full; of the rules all of whose tokens an open page has,
the one with the highest confidence, then support, then fewest tokens decides, and without one the page is allowed.
`held_out` learns from the pages whose crc32(page_id) mod 5 is not 0 and counts verdicts on the labelled others.

A null url, or one without "://", has an empty host and path, fits no rule and is allowed. Ties of confidence, support and length go
to the later antecedent by code point, then to block. Repeated rows each get a row; rows are numbered by url, so equal urls are
judged once. Very long urls are taken whole. Empty tables, and tables without labelled pages, give no mined rules. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import durable

#: The rules as host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
SUPPORT, CONFIDENCE, HOT = 0.005, 0.9, 1024


def host_path(url: Column) -> tuple[Column, Column]:
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict, labels, segments) of the longest rule that fits, with the numbers of labels and segments it names, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    cases = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h.count(".") + 1).alias("labels"), F.lit(len([x for x in p.split("/") if x])).alias("segments"))) for h, p, v in ordered]
    return F.coalesce(*cases) if cases else F.lit(None).cast("struct<rule:string,verdict:string,labels:int,segments:int>")


def tokens(url: Column, host: Column, path: Column, labels: Column | None = None, segments: Column | None = None) -> Column:
    """Items of a URL: labels of the host by place, path segments, query keys, fragment, scheme; without the host's last labels
    and the path's first segments, as many as told."""
    labels, segments = (F.coalesce(x, F.lit(0)) if x is not None else F.lit(0) for x in (labels, segments))
    parts = F.filter(F.split(host, "\\."), lambda x: x != "")
    top = F.when((labels == 0) & (F.size(parts) > 0), F.array(F.concat(F.lit("top:"), F.element_at(parts, -1)))).otherwise(F.array().cast("array<string>"))
    rest = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.greatest(labels, F.lit(1)), F.lit(0))), lambda x: F.concat(F.lit("host:"), x))
    steps = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(F.lower(x), "[0-9]+", "0")))
    steps = F.slice(steps, segments + 1, F.greatest(F.size(steps) - segments, F.lit(0)))
    query = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit("[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("query:"), F.lower(x)))
    other = F.filter(F.array(F.when(url.contains("#"), F.lit("fragment")), F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(url, "^([A-Za-z]+)://", 1)))), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(top, rest, steps, query, other))


def _classes(rows: DataFrame, least: float) -> DataFrame:
    """rows (basket, items, verdict) -> token, class (the smallest token that stands in exactly the same baskets), n, blocked: the baskets that hold
    it, and those of them with the verdict block. Tokens in fewer than `least` baskets are left out. Sets of baskets are told apart by their
    number and two 64-bit sums of hashes."""
    each = rows.select("basket", "verdict", F.explode("items").alias("token"))
    held = each.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked"), F.count_if(F.col("verdict") == "allow").alias("allowed"), F.bit_xor(F.xxhash64("basket")).alias("x"), F.bit_xor(F.xxhash64(F.lit("again"), "basket")).alias("y"),
    ).where(F.col("n") >= least)
    return held.withColumn("class", F.min("token").over(W.partitionBy("n", "x", "y")))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """labelled (items, verdict) -> (rule_id, antecedent, rarest, verdict, confidence, support).

    Tokens that always go together would give as many itemsets as there are sets of them, all with the same counts, so they go through
    FP-growth as one; of those itemsets the ones that survive the pruning name a single one of the tokens, and these are put back. A token all
    of whose pages have one verdict needs no company: nothing that it is part of can be surer. It makes its rule at once and
    doesn't go through FP-growth. Neither step loses a rule."""
    from pyspark.ml.fpm import FPGrowth

    rows = durable(labelled.select("items", "verdict").withColumn("basket", F.monotonically_increasing_id()))
    total = rows.count()
    classes = durable(_classes(rows, support * total))
    pure = classes.where((F.col("blocked") == F.col("n")) | (F.col("allowed") == F.col("n")))
    sure = pure.select(F.array("class").alias("antecedent"), F.when(F.col("blocked") > 0, "block").otherwise("allow").alias("verdict"), F.lit(1.0).alias("confidence"), (F.col("n") / max(1, total)).alias("support")).distinct()
    mixed = classes.where((F.col("blocked") < F.col("n")) & (F.col("allowed") < F.col("n")))
    found = rows.select("basket", F.explode("items").alias("token")).join(mixed.select("token", "class"), "token").groupBy("basket").agg(F.collect_set("class").alias("items"))
    baskets = rows.select("basket", "verdict").join(found, "basket", "left").select(F.array_append(F.coalesce("items", F.array().cast("array<string>")), F.concat(F.lit("verdict:"), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith("verdict:")).where(~F.exists("antecedent", lambda x: x.startswith("verdict:")))
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), F.substring_index(F.element_at("consequent", 1), ":", -1).alias("verdict"), "confidence", "support")
    rules = durable(rules.withColumn("n", F.monotonically_increasing_id()))
    part = rules.select(F.col("antecedent")[0].alias("first"), F.col("antecedent").alias("part"), F.col("verdict").alias("part_verdict"), F.col("confidence").alias("part_confidence"))
    whole = rules.where("size(antecedent) > 1").select("n", "antecedent", "verdict", "confidence", F.explode("antecedent").alias("first"))
    better = (F.col("verdict") == F.col("part_verdict")) & (F.col("part_confidence") >= F.col("confidence")) & (F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0)
    left = rules.join(whole.join(part, "first").where(better).select("n").distinct(), "n", "left_anti").drop("n").unionByName(sure)

    members = classes.groupBy("class").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    spelt = durable(left.withColumn("n", F.monotonically_increasing_id()))
    by_place = spelt.select("n", F.posexplode("antecedent").alias("k", "class")).join(members, "class").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("k", "tokens"))).alias("t"))
    one_of_each = F.aggregate(F.col("t")["tokens"], F.array(F.array().cast("array<string>")), lambda made, tokens: F.flatten(F.transform(made, lambda m: F.transform(tokens, lambda x: F.array_append(m, x)))))
    chosen = spelt.join(by_place, "n").withColumn("antecedent", F.explode(one_of_each)).select(F.array_sort("antecedent").alias("antecedent"), "verdict", "confidence", "support")
    chosen = chosen.withColumn("rule_id", F.xxhash64(F.array_join("antecedent", "\x01"), "verdict"))
    posted = chosen.select("rule_id", F.explode("antecedent").alias("item")).join(classes.select(F.col("token").alias("item"), "n"), "item").groupBy("rule_id").agg(F.min_by("item", F.struct("n", "item")).alias("rarest"))
    return durable(chosen.join(posted, "rule_id").select("rule_id", "antecedent", "rarest", "verdict", "confidence", "support"))


def _rows(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).withColumns({"host": host, "path": path})
    rows = rows.withColumn("fits", fixed_rule(F.col("host"), F.col("path"), rules))
    return rows.withColumn("items", tokens(F.col("url"), F.col("host"), F.col("path"), F.col("fits.labels"), F.col("fits.segments")))


def matched(sets: DataFrame, mined: DataFrame) -> DataFrame:
    """sets (set, items) -> (set, learned, mined): the verdict and antecedent of the deciding rule of each set that has one."""
    hits = sets.select("set", "items", F.explode("items").alias("rarest")).join(mined, "rarest").where(F.size(F.array_except("antecedent", "items")) == 0)
    best = hits.groupBy("set").agg(F.max(F.struct("confidence", "support", (-F.size("antecedent")).alias("short"), "antecedent", "verdict")).alias("best"))
    return best.select("set", F.col("best.verdict").alias("learned"), F.array_join("best.antecedent", " ").alias("mined"))


def held_out(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(verdict, learned, n) on labelled pages of the fold crc32(page_id) mod 5 = 0, by rules mined from the others; learned is null where no rule decides."""
    fold = F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    rows = durable(_rows(pages, rules).where("fits is not null").select("items", "fits.verdict", fold.alias("fold"), F.xxhash64(F.array_join("items", "\x01")).alias("set")))
    best = matched(rows.where("fold").select("set", "items").dropDuplicates(["set"]), durable(mine(rows.where("not fold"), support, confidence)))
    return rows.where("fold").join(best, "set", "left").groupBy("verdict", "learned").agg(F.count(F.lit(1)).alias("n"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, verdict, mined (the deciding association rule, if any)."""
    rows = durable(_rows(pages, rules).select("page_id", "host", "path", "fits", "items"))
    mined = durable(mine(rows.where("fits is not null").select("items", "fits.verdict"), support, confidence))
    set_, is_open = F.xxhash64(F.array_join("items", "\x01")), F.col("fits").isNull() & (F.col("host") != "")
    best = durable(matched(rows.where(is_open).select(set_.alias("set"), "items").dropDuplicates(["set"]), mined))  # read twice
    keyed = rows.withColumns({"open": is_open, "set": F.when(is_open, set_).otherwise(F.xxhash64("page_id", "host", "path"))})  # no pile of null keys
    # sets that hold over 1/HOT of the pages, so fewer than HOT of them, are joined by broadcast; the rest by shuffle
    least = rows.count() / HOT
    hot = keyed.where("open").groupBy("set").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("set").join(best, "set", "left")
    hot = F.broadcast(durable(hot.select(F.col("set").alias("hot_set"), F.col("learned").alias("hot_learned"), F.col("mined").alias("hot_mined"))))
    split = keyed.join(hot, F.col("open") & (F.col("set") == F.col("hot_set")), "left")
    split = split.withColumn("open", F.col("open") & F.col("hot_set").isNull()).withColumn("set", F.when(F.col("hot_set").isNull(), F.col("set")).otherwise(F.xxhash64("page_id", "host", "path")))
    cold = best.select(F.col("set").alias("cold_set"), "learned", "mined")
    out = split.join(cold, F.col("open") & (F.col("set") == F.col("cold_set")), "left")
    verdict = F.coalesce("fits.verdict", "hot_learned", "learned", F.lit("allow")).alias("verdict")
    return out.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), verdict, F.coalesce("hot_mined", "mined").alias("mined"))
