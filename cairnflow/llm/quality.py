"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Base figures are counted for every whole text: words, their code points, symbols, lines equal to an earlier one, and words in
five-word windows that occur twice or more. A text with few words or mostly repeated windows fails at once. The others go through
further rules, each a condition that rejects: on a hash sample of at most SAMPLE documents every rule is run by itself, its seconds (less
those of only reading the sample) are its cost and the share of documents that it rejects is its selectivity; the rules are
then ordered by rejection per cost, and a document is judged by one after the other until a rule rejects it (a CASE, whose later branches
aren't evaluated). A document is kept if no rule rejects it, so the order decides how long the work takes, never the verdict.

Windows are told apart by the words themselves: numbers made of a window's 64-bit hash and its place are sorted, neighbours with the
same hash bits are compared word by word, and where one differs from its neighbours though the bits agree, from all others.
Work is in proportion to a text's words times their logarithm; very long texts are taken whole, inside one row.

A null text counts as an empty one, has no words and fails. Repeated rows each get a row, null and repeated ids don't matter, other columns
are ignored by `judge` and passed on by `keep_good`. Equal costs (ties) go by the rule's name. An empty table gives an empty result; rules
are then in the order of their names.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, durable, fresh_name, words

WINDOW, LEAST_WORDS, MOST_REPEATED, SAMPLE = 5, 10, 20, 2000
SYMBOLS, BASE = "[#*$%&|<>]", ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Repeats of a timed run, the shortest counts; the least cost of a rule in seconds.
TIMED, LEAST_COST = 2, 1e-3


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body names it, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """How many of the words w (an array, bound by `let`) are in windows that occur twice or more."""
    n = F.size(w) - (window - 1)
    bits = F.length(F.bin(n.cast("long")))

    def counted(b: Column) -> Column:
        high = F.call_function("shiftleft", F.lit(-1).cast("long"), b)
        same = lambda x, y: F.coalesce(F.call_function("shiftrightunsigned", x.bitwiseXOR(y), b) == 0, F.lit(False))
        at = lambda x: x.bitwiseAND(F.bitwise_not(high)).cast("int")
        equal = lambda x, y: same(x, y) & (F.slice(w, at(x) + 1, window) == F.slice(w, at(y) + 1, window))
        keys = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(window))).bitwiseAND(high).bitwiseOR(i.cast("long")))

        def flagged(s: Column) -> Column:
            def twice(x: Column, j: Column) -> Column:
                before, after = F.get(s, j - 1), F.get(s, j + 1)
                near = same(x, before) | same(x, after)
                return F.when(near, F.when(F.coalesce(equal(x, before), F.lit(False)) | F.coalesce(equal(x, after), F.lit(False)), True).otherwise(F.exists(s, lambda y: (y != x) & equal(x, y)))).otherwise(False)

            return F.sort_array(F.transform(F.filter(s, twice), lambda x: at(x)))

        def covered(p: Column) -> Column:
            return _total(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(window)), F.lit(window)).cast("long")))

        return let(let(F.sort_array(keys), flagged), covered)

    return F.when(n > 1, let(bits, counted)).otherwise(F.lit(0).cast("long"))


def measures(text: Column, window: int = WINDOW) -> Column:
    """struct of the base figures of a text that isn't null."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    figures = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        (F.length(text) - F.regexp_count(text, F.lit(f"[{SPACE}]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeated_words(w, window).alias("n_repeat_words"),
    )
    return let(words(text), figures)


def base_failed(least: int = LEAST_WORDS, most: int = MOST_REPEATED) -> Column:
    return (F.col("n_words") < least) | (100 * F.col("n_repeat_words") > most * F.col("n_words"))


def _lines(pattern: str) -> tuple[Column, Column]:
    """How many lines with a word there are, and how many of them fit a pattern."""
    text = F.col("text")
    return F.regexp_count(text, F.lit(f"(?m)^[^\\n]*?[^{SPACE}]")), F.regexp_count(text, F.lit(f"(?m){pattern}"))


def default_rules() -> dict[str, Column]:
    """name -> condition that rejects, over text (not null) and the base figures."""
    text, n = F.col("text"), F.col("n_words")
    stutter = let(words(text), lambda w: F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False)))))
    lines, ends = _lines("(?:\\.\\.\\.|\\u2026)[\\x20\\x09\\x0D]*$")
    _, bullets = _lines("^[\\x20\\x09]*[-*\\u2022\\u2023\\u25AA][\\x20\\x09]")
    letters = F.regexp_count(text, F.lit("\\p{L}"))
    return {
        "capitals": 100 * F.regexp_count(text, F.lit("\\p{Lu}")) > 60 * letters,
        "copied_lines": 2 * F.col("n_dup_lines") > lines,
        "cut_lines": 10 * ends > 3 * lines,
        "filler": F.lower(text).contains("lorem ipsum"),
        "listing": 10 * bullets > 9 * lines,
        "no_letters": 2 * F.regexp_count(text, F.lit(f"[^{SPACE}\\p{{L}}]*\\p{{L}}[^{SPACE}]*")) < n,
        "stutter": 10 * stutter > 3 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
    }


def _measured(docs: DataFrame, window: int) -> DataFrame:
    """docs -> doc_id, text (nulls empty), the base figures."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("m", measures(F.col("text"), window)).select("doc_id", "text", *(F.col(f"m.{c}") for c in BASE))


def sample_of(docs: DataFrame, size: int) -> DataFrame:
    """At most size documents, those first by a hash of id and text among all."""
    share, unit = 4 * size / max(1, docs.count()), F.shiftrightunsigned(F.xxhash64(F.lit("quality"), "doc_id", "text"), 32) / float(1 << 32)
    return docs.select("doc_id", "text").withColumn("_u", unit).where(F.col("_u") < share).orderBy("_u", "text").limit(size).drop("_u")


def cascade(docs: DataFrame, rules: dict[str, Column] | None = None, size: int = SAMPLE, window: int = WINDOW) -> list[tuple[str, float, float]]:
    """(rule, seconds for the sample, share that it rejects), best first by rejection per cost. Only figures of the bounded sample are
    read by the driver."""
    rules = default_rules() if rules is None else rules
    if not rules:
        return []
    few = durable(_measured(sample_of(docs, size), window).where(~base_failed()).repartition(4))
    shares = few.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items())).first()

    def seconds(column: Column) -> float:
        took = []
        for _ in range(TIMED):
            began = time.perf_counter()
            few.select(column.alias("x")).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return min(took)

    idle = seconds(F.length("text")) if shares.n else 0.0
    found = [(k, max(LEAST_COST, (seconds(c) if shares.n else 0.0) - idle), shares[k] / max(1, shares.n)) for k, c in sorted(rules.items())]
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1] if shares.n else 0, x[0]))


def _first_failure(order: list[str], rules: dict[str, Column]) -> Column:
    """The first rule, in order, that rejects; conditions after it aren't evaluated."""
    case = F.when(base_failed(), "base")
    for name in order:
        case = case.when(F.coalesce(rules[name], F.lit(False)), name)
    return case


def judge(docs: DataFrame, rules: dict[str, Column] | None = None, size: int = SAMPLE, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text) -> doc_id, the base figures, base_failed, kept."""
    rules = default_rules() if rules is None else rules
    order = [k for k, _, _ in cascade(docs, rules, size, window)]
    failed = _first_failure(order, rules)
    return _measured(docs, window).select("doc_id", *BASE, base_failed().alias("base_failed"), failed.isNull().alias("kept"))


def keep_good(docs: DataFrame, rules: dict[str, Column] | None = None, size: int = SAMPLE, window: int = WINDOW) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    rules = default_rules() if rules is None else rules
    order = [k for k, _, _ in cascade(docs, rules, size, window)]
    row = fresh_name(docs, "row")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = whole.withColumn("m", measures(F.col("text"), window)).select(row, "text", *(F.col(f"m.{c}") for c in BASE))
    return whole.where(_first_failure(order, rules).isNull()).select(f"{row}.*")


def why(docs: DataFrame, rules: dict[str, Column] | None = None, window: int = WINDOW) -> DataFrame:
    """docs -> doc_id, failed: every rule that rejects, by name, with `base` first; for audits, where nothing is cut short."""
    rules = default_rules() if rules is None else rules
    named = [F.when(base_failed(), "base"), *(F.when(F.coalesce(c, F.lit(False)), k) for k, c in sorted(rules.items()))]
    return _measured(docs, window).select("doc_id", F.array_compact(F.array(*named)).alias("failed"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d) x),
c AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
v AS (SELECT r, count(DISTINCT i + k) AS n FROM c, (SELECT unnest([0, 1, 2, 3, 4]) AS k) k GROUP BY r),
b AS (SELECT d.*, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l.l) - len(list_distinct(l.l)) AS BIGINT) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words, l.l AS l FROM d JOIN l USING (r) LEFT JOIN v USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  100 * length(regexp_replace(t, '\\P{Lu}', '', 'g')) > 60 * length(regexp_replace(t, '\\P{L}', '', 'g')) OR 2 * n_dup_lines > len(l)
  OR 10 * len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|\\x{2026})[\\x20\\x09\\x0D]*$'))) > 3 * len(l) OR contains(lower(t), 'lorem ipsum')
  OR 10 * len(list_filter(l, lambda x: regexp_matches(x, '^[\\x20\\x09]*[-*\\x{2022}\\x{2023}\\x{25AA}][\\x20\\x09]'))) > 9 * len(l)
  OR 2 * len(list_filter(w, lambda x: regexp_matches(x, '\\pL'))) < n_words OR 10 * len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) > 3 * n_words
  OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS rejected FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM f
"""
