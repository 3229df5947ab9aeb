"""Mixing sources to target weights by weighted fair queueing.

Documents are shuffled by a digest of id and text; each turn of a source (an epoch) serves its documents in that order, in packets
of at most PACKET words, and a packet's virtual finish time is the source's cumulative words divided by the source's target.
The mix is the global order of all packets by finish time, then source, then place, truncated at the total budget; the packet at the
cut is taken in part. A source gets at most `epochs` turns; what it can't give is shared among the others by weight.

The order is global, but only what decides is sorted: words are summed by RANGES ranges of finish time, the range in which
the budget runs out is sorted, and its cut (finish time, source, place, words) decides for every packet what is taken. Cumulative
sums are prefix sums over a tree of digest prefixes (4096 wide), so no task gets a whole source, and rows that agree in id and
text are one entry with a number there, so no pile of them meets in a task.

Nulls: a null text has size 0, a null source is a source of its own, ordered last; a null doc_id is shuffled as ''. Repeated rows
are rows of their own, each with its own place; which of them is which doesn't matter. Ties of finish times go by source, then by
place. Empty texts are never taken (0). Very long texts are counted whole and served packet by packet. An empty table gives an empty
result. Other columns are ignored by `mix` and passed on by `mixed_documents`, where rows that agree in id and text each get the
mean, rounded up, of what the mix takes of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import durable, fresh_name, words

SHARE, WEIGHTS, EPOCHS, LEAF, PACKET, RANGES = 1.5, (5.0, 2.0, 1.0), 2, 4096, 64, 1 << 16


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, size) -> one row per source: source, place, source_size, weight, target. Its windows run over sources, not documents."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    turn = F.pmod(F.col("place") - 1, F.lit(len(weights)))
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    by = by.withColumn("cap", epochs * F.col("source_size"))
    filled = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    before = F.coalesce(F.sum("cap").over(filled.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(filled.rowsBetween(0, W.unboundedFollowing))
    by = by.withColumn("budget", share * F.sum("source_size").over(whole)).withColumn("level", (F.col("budget") - before) / rest)
    level = F.max("level").over(whole)
    return by.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select("source", "place", "source_size", "weight", "target")


def _starts(items: DataFrame, levels: int) -> DataFrame:
    """items (k, u, doc_id, size, copies) with start: the words of the same source that come before by (u, doc_id, size)."""
    items = items.withColumn("own", F.col("size") * F.col("copies"))
    sums = [items.groupBy("k", F.substring("u", 1, 3 * n).alias("p")).agg(F.sum("own").alias("s")) for n in range(1, levels + 1)]
    offsets = None
    for n, level in enumerate(sums, 1):
        own = level.withColumn("q", F.substring("p", 1, 3 * (n - 1)))
        inside = F.coalesce(F.sum("s").over(W.partitionBy("k", "q").orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        own = own.withColumn("o", inside)
        offsets = own.select("k", "p", "o") if offsets is None else own.join(offsets.select("k", F.col("p").alias("q"), F.col("o").alias("oo")), ["k", "q"]).select("k", "p", (F.col("o") + F.col("oo")).alias("o"))
    leaf = W.partitionBy("k", "p").orderBy("u", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("own").over(leaf), F.lit(0))
    items = items.withColumn("p", F.substring("u", 1, 3 * levels)).withColumn("start", inside)
    return items.join(offsets, ["k", "p"]).withColumn("start", F.col("start") + F.col("o")).drop("o", "p", "own")


def _digest() -> Column:
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))


def _packets(epochs: int, packet: int) -> Column:
    """array<struct<end, words>> of a row: the source's words up to the packet's end, and the packet's words."""
    n = F.ceil(F.col("size") / packet).cast("int")
    own = lambda p: F.least(F.col("size") - (p - 1) * packet, F.lit(packet)).cast("long")

    def turn(e: int) -> Column:
        end = lambda p: e * F.col("source_size") + F.col("start") + F.least(p * packet, F.col("size"))
        return F.transform(F.sequence(F.lit(1), n), lambda p: F.struct(end(p).alias("end"), own(p).alias("words")))

    turns = [turn(e) for e in range(epochs)]
    return F.when(F.col("size") > 0, F.concat(*turns)).otherwise(F.array().cast("array<struct<end:bigint,words:bigint>>"))


def _entries(docs: DataFrame, share: float, weights: tuple[float, ...], epochs: int, packet: int) -> DataFrame:
    """docs -> a row per different (source, id, text): doc_id, u, size, copies, source_size, target, place, start, and the cut."""
    sized = durable(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.size(words("text")).cast("long").alias("size"), _digest().alias("u")).groupBy("doc_id", "source", "size", "u").agg(F.count(F.lit(1)).alias("copies")))
    levels = max(1, math.ceil(math.log(max(1, sized.count() / LEAF), 4096)))
    goals = durable(targets(sized.withColumn("size", F.col("size") * F.col("copies")), share, weights, epochs))
    items = sized.join(goals.withColumn("k", F.col("place")), sized["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    items = durable(_starts(items, levels))

    each = items.withColumn("start", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda i: F.col("start") + i * F.col("size"))))
    queue = each.select("target", "place", F.explode(_packets(epochs, packet)).alias("x")).select((F.col("x.end") / F.col("target")).alias("finish"), "place", "x.end", "x.words")
    queue = queue.withColumn("range", F.least(F.col("finish") * RANGES, F.lit(4.0 * RANGES)).cast("long"))
    budget = math.floor(min(share, epochs) * (goals.agg(F.sum("source_size")).first()[0] or 0))
    sums = queue.groupBy("range").agg(F.sum("words").alias("words"))  # at most 4 * RANGES rows
    sums = sums.withColumn("after", F.sum("words").over(W.orderBy("range")))
    last = sums.where(F.col("after") >= budget).orderBy("range").first() if budget else None
    if last is None:  # nothing to take, or the budget takes all
        cut = (math.inf if budget else -1.0, 0, 0, 0)
    else:
        before = F.sum("words").over(W.orderBy("finish", "place", "end").rowsBetween(W.unboundedPreceding, -1))
        at = queue.where(F.col("range") == last.range).withColumn("before", F.coalesce(before, F.lit(0)) + (last.after - last.words))
        row = at.where(F.col("before") < budget).orderBy(F.desc("finish"), F.desc("place"), F.desc("end")).first()
        cut = (row.finish, row.place, row.end, min(row.words, budget - row.before))
    return items.withColumn("cut", F.struct(F.lit(float(cut[0])).alias("finish"), F.lit(cut[1]).cast("long").alias("place"), F.lit(cut[2]).cast("long").alias("end"))).withColumn("part", F.lit(cut[3]).cast("long"))


def _taken(epochs: int, packet: int) -> Column:
    """What the cut leaves of a row's packets."""

    def of(x: Column) -> Column:
        here = F.struct((x["end"] / F.col("target")).alias("finish"), F.col("place"), x["end"].alias("end"))
        return F.when(here < F.col("cut"), x["words"]).when(here == F.col("cut"), F.col("part")).otherwise(F.lit(0).cast("long"))

    return F.aggregate(_packets(epochs, packet), F.lit(0).cast("long"), lambda a, x: a + of(x))


def mix(docs: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, packet: int = PACKET) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, size, source_size, target, taken, finish (virtual finish time of its first turn)."""
    items = _entries(docs, share, weights, epochs, packet)
    each = items.withColumn("start", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda i: F.col("start") + i * F.col("size"))))
    finish = F.try_divide(F.col("start") + F.col("size"), F.col("target"))
    return each.select("doc_id", "size", "source_size", "target", _taken(epochs, packet).alias("taken"), finish.alias("finish"))


def mixed_documents(docs: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, packet: int = PACKET) -> DataFrame:
    """docs with taken (words the mix takes, repeats counted) and finish, its virtual finish time; documents not taken go. Columns of these names are replaced."""
    id_, u_, source_ = (fresh_name(docs, x) for x in ("id", "u", "source"))
    items = _entries(docs, share, weights, epochs, packet)
    each = items.withColumn("start", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda i: F.col("start") + i * F.col("size"))))
    taken_, finish_ = "taken", "finish"
    plan = each.select(F.col("doc_id").alias(id_), F.col("u").alias(u_), F.col("source").alias(source_), _taken(epochs, packet).alias(taken_), F.try_divide(F.col("start") + F.col("size"), F.col("target")).alias(finish_))
    plan = plan.groupBy(id_, u_, source_).agg(F.ceil(F.avg(taken_)).cast("long").alias(taken_), F.min(finish_).alias(finish_)).where(F.col(taken_) > 0)
    own = docs.drop(taken_, finish_)
    there = (_digest() == F.col(u_)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & own["source"].cast("string").eqNullSafe(F.col(source_))
    return own.join(plan, there).select(*own.columns, taken_, finish_)


#: The whole order, by brute force.
ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))) AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM d GROUP BY source),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER w, 0)) / sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM s WINDOW w AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, place, source_size, least(CAST(2 * source_size AS DOUBLE), max(level) OVER () * weight) AS target FROM l),
p AS (SELECT row_number() OVER () AS r, d.doc_id, d.size, t.place, t.source_size, t.target, CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT r, place, target, e * source_size + start + least(k * 64, size) AS stop, least(size - (k - 1) * 64, 64) AS words
      FROM (SELECT *, unnest(range(1, CAST(ceil(size / 64) AS BIGINT) + 1)) AS k FROM p) a, (SELECT unnest([0, 1]) AS e) b),
o AS (SELECT r, words, sum(words) OVER (ORDER BY CAST(stop AS DOUBLE) / target, place, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM q),
b AS (SELECT CAST(floor(1.5::DOUBLE * sum(size)) AS BIGINT) AS budget FROM d),
x AS (SELECT r, CAST(sum(greatest(0, least(words, budget - coalesce(before, 0)))) AS BIGINT) AS taken FROM o, b GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, CASE WHEN target > 0 THEN CAST(start + size AS DOUBLE) / target END AS finish FROM p LEFT JOIN x USING (r)
"""
