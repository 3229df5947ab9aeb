"""PII by candidate gradient boosting, in DataFrame functions only.

Base spans come from four patterns (email, ip, card, phone) and always stay. High-recall generators propose further, overlapping
candidates; each becomes a few small whole-number features of its format and its context. Boosted trees are fitted to counts of
feature combinations, of two kinds of evidence: made-up sentences with personal data in formats that the patterns miss (spelt-out
addresses, national phone numbers, account and social security numbers) and look-alikes that aren't personal (dates, versions,
prices, book and order numbers), labelled by construction; and the corpus' candidates, of which those that overlap a base span count as
positive and the others, which may hold what no pattern knows, as negative with little weight (UNKNOWN_WEIGHT of the made-up ones in all).
The tables of counts are bounded by the product of the features' ranges, not by the input. Per generator the cut is the lowest score
from which precision on the calibration folds (made-up sentences of every fifth number, and documents with crc32(doc_id) mod 5 = 0)
is at least PRECISION. Trees become column expressions. A candidate above its cut that overlaps no base span and no earlier added one
(by start, then end) is added as kind `model`. `held_out` counts what is found of made-up sentences that neither fit nor cuts have seen.

Patterns are possessive and anchored at the start of a run, so they find what the greedy patterns find in linear time, and spans of a text are sorted and gone through once; very long
texts are taken whole. Null and empty texts have no spans; a null doc_id is in the calibration fold of ''. Repeated rows each get a
row, other columns are ignored, an empty table gives an empty result. Equal scores are taken or left together.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import durable

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates: anything around an at sign, spelt-out addresses, groups of digits with separators, dotted numbers, account numbers.
GENERATORS = {
    "at": r"(?:\G|(?<![^\x20\x09-\x0D@]))[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D@]++",
    "spelt": r"(?i)(?<![a-z0-9._+-])[a-z0-9._+-]{1,40}+\x20?[\x28\x5B{<]\x20?(?:at|@)\x20?[\x29\x5D}>]\x20?[a-z0-9-]{1,40}+(?:(?:\x20?[\x28\x5B{<]\x20?(?:dot|\.)\x20?[\x29\x5D}>]\x20?|\x20dot\x20|\.)[a-z0-9-]{2,20}+){1,3}",
    "worded": r"(?i)(?<![a-z0-9._+-])[a-z0-9._+-]{1,40}+\x20(?:at|@)\x20[a-z0-9-]{1,40}+(?:(?:\x20?[\x28\x5B{<]\x20?(?:dot|\.)\x20?[\x29\x5D}>]\x20?|\x20dot\x20|\.)[a-z0-9-]{2,20}+){1,3}",
    "digits": r"(?<![0-9])[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,24}",
    "dotted": r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){2,}+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: A text without these has no match, so that the patterns needn't run.
NEEDS = {"email": "@", "phone": "+", "at": "@"}
FEATURES = ("generator", "length", "digits", "groups", "opens", "dots", "check", "cue", "before", "after")
ROUNDS, RATE, DEPTH, LEAST, PRECISION, MADE_UP, UNKNOWN_WEIGHT = 40, 0.3, 3, 5.0, 0.98, 4000, 0.25


#: Rows of an array that one step of `folded` takes: appending is done within such a part, and once for each part.
PART = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body names it, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def folded(items: Column, none: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Goes through items with a running number: step(struct(at, out), item) -> struct(at, out), out growing by at most one; the last out.

    Appending copies an array, so n items appended one by one cost n squared; here parts of PART items append to arrays of their own, which are
    put together at the end: n times PART plus n squared over PART pointers, 0.1 s for 100,000 items."""

    def whole(all_: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(all_) / PART).cast("int") - 1, F.lit(0))), lambda k: F.slice(all_, k * PART + 1, F.lit(PART)))

        def next_(acc: Column, part: Column) -> Column:
            own = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), step)
            return let(own, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], x["out"]).alias("out")))

        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), next_, lambda acc: acc["out"])

    return let(items, whole)


def located(text: Column, pattern: str, needs: str | None = None) -> Column:
    """array<struct<start,end,value,before,after>> of all matches, offsets in code points; before and after are 24 and 8 of the surroundings."""
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(24)).alias("tail"), F.left(g, F.lit(8)).alias("head")))
    pieces = F.arrays_zip(found.alias("value"), gaps.alias("gap"), F.slice(gaps, 2, 1 << 30).alias("next"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]["n"]
        end = start + F.length(p["value"])
        item = F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value"), p["gap"]["tail"].alias("before"), F.coalesce(p["next"]["head"], F.lit("")).alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

    zipped = F.filter(pieces, lambda p: p["value"].isNotNull())
    out = folded(zipped, none, step)
    has = text.contains(needs) if needs else text.rlike(pattern)
    return F.when(has, out).otherwise(none)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes; the second digit from the end counts double, and so on."""
    parts = F.split(F.reverse(digits), "")
    values = F.transform(parts, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def passes(kind: str) -> Callable[[Column], Column]:
    if kind == "ip":
        return lambda m: F.forall(F.split(m["value"], "\\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return lambda m: F.when(F.length(digits_of(m["value"])).between(16, 19), luhn(digits_of(m["value"]))).otherwise(False)
    if kind == "phone":
        return lambda m: F.length(digits_of(m["value"])).between(8, 15)
    return lambda m: F.lit(True)


def _level(value: Column, *cuts: int) -> Column:
    """How many of the cuts the value reaches."""
    return sum((F.when(value >= c, 1).otherwise(0) for c in cuts), F.lit(0))


def _side(ch: Column) -> Column:
    return F.when(ch == "", 0).when(ch.rlike(r"[\x20\x09-\x0D]"), 1).when(ch.rlike("[0-9A-Za-z]"), 2).otherwise(3)


def _check(d: Column) -> Column:
    """0 where a checksum says nothing, 1 where a card's fails, 2 where it holds."""
    return F.when(~F.length(d).between(13, 19), 0).otherwise(F.when(luhn(d), 2).otherwise(1))


#: Layouts of digit groups that say something, and words before personal data of a kind.
LAYOUTS = ("333?4", "324", "4444|465|4453", "42+2+|2+2+4", "22222?|2222")
CUES = ("mail|write|reach|contact", "call|tel|phone|mobile|fax|cell|dial|ring", "ssn|social|security|tax|id no|passport", "iban|account|bank|card|visa|acct", "order|item|range|pages?|part|invoice|ref|serial|version|model")


def featured(m: Column, generator: int) -> Column:
    """struct of start, end and the whole-number features of a candidate."""
    value, before = m["value"], F.lower(m["before"])
    digits = digits_of(value)
    sizes = F.array_join(F.transform(F.filter(F.split(value, "[^0-9]+"), lambda x: x != ""), lambda x: F.least(F.length(x), F.lit(9)).cast("string")), "")
    groups, cue = F.lit(0), F.lit(0)
    for k, layout in reversed(list(enumerate(LAYOUTS, 1))):
        groups = F.when(sizes.rlike(f"^(?:{layout})$"), k).otherwise(groups)
    for k, words in reversed(list(enumerate(CUES, 1))):
        cue = F.when(before.rlike(f"(?:{words})[^0-9]*$"), k).otherwise(cue)
    of = {"generator": F.lit(generator), "length": _level(F.length(value), 10, 15, 20, 30), "digits": _level(F.length(digits), 1, 8, 9, 10, 11, 16, 20), "groups": groups,
          "opens": F.when(value.startswith("+"), 2).when(value.startswith("("), 1).when(value.rlike("^[A-Z]{2}[0-9]"), 3).otherwise(0), "dots": _level(F.length(value) - F.length(F.replace(value, F.lit("."), F.lit(""))), 1, 2, 3, 4) + F.when(value.rlike("(?i)dot"), 5).otherwise(0),
          "check": _check(digits), "cue": cue, "before": _side(F.right(m["before"], F.lit(1))), "after": _side(F.left(m["after"], F.lit(1)))}
    return F.struct(m["start"].alias("start"), m["end"].alias("end"), *(of[n].cast("int").alias(n) for n in FEATURES))


def _featured(generator: int) -> Callable[[Column], Column]:
    return lambda m: featured(m, generator)


def _written(kind: str) -> Callable[[Column], Column]:
    return lambda m: F.concat(F.lit(f"{kind}:"), m["start"].cast("string"), F.lit(":"), m["end"].cast("string"))


_CANDIDATE = f"struct<start:int,end:int,{','.join(f'{n}:int' for n in FEATURES)},hit:boolean>"


def marked(candidates_: Column, spans: Column) -> Column:
    """The candidates, by end, with `hit`: whether one of the spans overlaps. Both are sorted together by where a span starts and a candidate
    ends; a candidate is hit if of the spans that start before its end the one reaching furthest ends after its start."""
    none = F.array().cast(f"array<{_CANDIDATE}>")
    empty = F.lit(None).cast(_CANDIDATE.replace(",hit:boolean", ""))
    events = F.concat(F.transform(candidates_, lambda c: F.struct(c["end"].alias("at"), F.lit(0).alias("span"), F.lit(0).alias("end"), c.alias("c"))), F.transform(spans, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("span"), b["end"].alias("end"), empty.alias("c"))))

    def step(acc: Column, e: Column) -> Column:
        item = F.struct(*(e["c"][n].alias(n) for n in ("start", "end", *FEATURES)), (acc["at"] > e["c"]["start"]).alias("hit"))
        return F.when(e["span"] == 1, F.struct(F.greatest(acc["at"], e["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(acc["at"].alias("at"), F.concat(acc["out"], F.array(item)).alias("out")))

    return F.when(F.size(candidates_) > 0, folded(F.array_sort(events), none, step)).otherwise(none)


#: Names, hosts and words of made-up sentences.
_NAMES = "anna bob carla dev emil fatima greg hana ivan jo kim liu maria nils omar pia quinn rosa sam tara uwe vera will xin yara zoe".split()
_HOSTS = "example mail corp post web acme home inbox".split()
_TOPS = "com org net de fr io".split()
_WORDS = "the report was sent and we met in it is on for a new page of all that they had to see but then some more came after this one with no other".split()


def made_up(n: int, seed: int = 11) -> list[dict]:
    """n sentences: text, and where personal data stands in it (from, to; both -1 in a look-alike)."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    upper = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(k))
    name = lambda: r.choice(_NAMES) + r.choice(("", "." + r.choice(_NAMES), num(2)))
    at, dot = lambda: r.choice((" at ", " AT ", " [at] ", "(at)", " (at) ", "[at]")), lambda: r.choice((" dot ", " DOT ", " [dot] ", "(dot)", "[dot]"))

    def card() -> str:
        d = [int(x) for x in num(15)]
        total = sum(x if i % 2 else 2 * x - 9 * (x > 4) for i, x in enumerate(d))
        return "".join(map(str, d)) + str(-total % 10)

    spaced = lambda x, sep: sep.join(x[i : i + 4] for i in range(0, len(x), 4))
    phone = lambda: r.choice(("({}) {}-{}", "({}){}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}")).format(str(r.randrange(2, 10)) + num(2), num(3), num(4))
    mail_cue, call_cue, id_cue, bank_cue = (lambda xs=xs: r.choice(xs) for xs in (("mail ", "write to ", "contact: ", "", "", "reach me: "), ("call ", "tel. ", "phone: ", "fax ", "my mobile is ", "cell "), ("SSN ", "SSN: ", "social security number ", "tax id "), ("IBAN ", "iban: ", "account ", "bank account ", "")))
    personal = [lambda: (mail_cue(), name() + at() + r.choice(_HOSTS) + dot() + r.choice(_TOPS)), lambda: (call_cue(), phone()), lambda: ("", f"({r.randrange(2, 10)}{num(2)}) {num(3)}-{num(4)}"), lambda: (id_cue(), f"{num(3)}-{num(2)}-{num(4)}"), lambda: (r.choice(("", "no. ")), f"{num(3)}-{num(2)}-{num(4)}"),
                lambda: (bank_cue(), spaced(r.choice(("DE", "FR", "GB", "ES", "NL")) + num(2) + r.choice((num(16), upper(4) + num(14), num(18), num(23))), r.choice((" ", "")))), lambda: (call_cue(), f"0{num(3)} {num(3)} {num(4)}"), lambda: (r.choice(("card ", "visa ", "")), spaced(card(), r.choice((" ", "-", "")))), lambda: (call_cue(), f"+{r.randrange(1, 99)} {num(3)} {num(3)} {num(4)}")]
    day = lambda: (str(r.randrange(1950, 2040)), f"{r.randrange(1, 13):02}", f"{r.randrange(1, 29):02}")
    alike = [lambda: ("", "-".join(day())), lambda: ("on ", ".".join(reversed(day()))), lambda: ("from ", f"{r.randrange(1900, 2000)}-{r.randrange(2000, 2040)}"), lambda: ("", f"{day()[0]}/{day()[1]}/{day()[2]} {num(2)}:{num(2)}"), lambda: ("version ", ".".join(num(r.randrange(1, 4)) for _ in range(r.randrange(3, 6)))), lambda: ("section ", ".".join(str(r.randrange(1, 30)) for _ in range(3))),
             lambda: ("ISBN ", f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}"), lambda: ("order ", f"{num(4)}-{num(4)}-{num(2)}"), lambda: (r.choice(("order ", "part ", "item ", "ref ")), f"{num(3)}-{num(2)}-{num(4)}"), lambda: (r.choice(("range ", "serial ", "invoice ")), f"{num(3)}-{num(3)}-{num(4)}"), lambda: ("order ", num(r.randrange(7, 13))), lambda: ("", num(16)), lambda: ("", spaced(num(16), " ")), lambda: ("", f"{num(2)} {num(3)} {num(3)}"), lambda: ("price ", f"{num(3)}.{num(3)}.{num(2)}"), lambda: ("id ", num(r.randrange(7, 25))), lambda: ("", f"{r.choice(_WORDS)} at {r.choice(_WORDS)} dot {r.choice(_WORDS)}"),
             lambda: ("", f"{r.choice(_WORDS)} at {r.choice(_WORDS)}. {r.choice(_WORDS).capitalize()}"), lambda: ("model ", f"{upper(2)}{num(2)} {upper(4)} {upper(4)}"), lambda: ("", f"password={upper(3)}@{num(3)}!"), lambda: ("", f"{r.choice(_WORDS)}@{r.choice(_WORDS)}"), lambda: ("pages ", f"{num(3)}-{num(3)}, {num(4)}"), lambda: ("at ", f"{num(2)}.{num(4)}, {num(2)}.{num(4)}")]
    rows = []
    kinds = personal + alike
    for i in range(n):
        k = r.randrange(len(personal)) if i % 2 else len(personal) + r.randrange(len(alike))
        cue, value = kinds[k]()
        head = " ".join(r.choice(_WORDS) for _ in range(r.randrange(0, 6)))
        head = (head + " " if head else "") + cue
        tail = r.choice((" ", ". ", ", ", "")) + " ".join(r.choice(_WORDS) for _ in range(r.randrange(0, 4)))
        own = k < len(personal)
        rows.append({"i": i, "text": head + value + tail, "a": len(head) if own else -1, "b": len(head) + len(value) if own else -1})
    return rows


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A tree over whole-number features: (feature, cut, below, from there on) or a number."""
    whole, best, chosen = g.sum() ** 2 / (h.sum() + 1), 1e-6, None
    for f in range(x.shape[1]) if depth else ():
        for cut in np.unique(x[:, f])[1:].tolist():
            low = x[:, f] < cut
            gl, hl = g[low].sum(), h[low].sum()
            gr, hr = g.sum() - gl, h.sum() - hl
            if min(hl, hr) < LEAST / 100:
                continue
            gain = gl * gl / (hl + 1) + gr * gr / (hr + 1) - whole
            if gain > best:
                best, chosen = gain, (f, cut)
    if not chosen:
        return float(RATE * g.sum() / (h.sum() + 1))
    f, cut = chosen
    low = x[:, f] < cut
    return f, cut, _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1)


def tree_value(tree, x: tuple[int, ...]) -> float:
    while not isinstance(tree, float):
        tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
    return tree


def tree_column(tree, of: Callable[[str], Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, cut, below, above = tree
    return F.when(of(FEATURES[f]) < cut, tree_column(below, of)).otherwise(tree_column(above, of))


Counts = dict[tuple[int, ...], tuple[float, float]]


def boost(counts: Counts) -> list:
    """counts: features -> (negatives, positives). Newton boosting of the logistic loss."""
    if not any(p for _, p in counts.values()):
        return []
    keys = sorted(counts)
    x, neg, pos = np.array(keys), np.array([counts[k][0] for k in keys]), np.array([counts[k][1] for k in keys])
    trees, score = [], np.zeros(len(keys))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        trees.append(_grow(x, pos - (neg + pos) * p, (neg + pos) * p * (1 - p) + 1e-9, DEPTH))
        score += [tree_value(trees[-1], k) for k in keys]
    return trees


def score(trees: list, x: tuple[int, ...]) -> float:
    return sum(tree_value(t, x) for t in trees)


def cuts(counts: Counts, trees: list) -> dict[int, float]:
    """Per generator the lowest score from which precision holds; none if it never does."""
    out = {}
    for g in {x[0] for x in counts}:
        by: dict[float, list[float]] = {}
        for x, c in counts.items():
            if x[0] == g:
                old = by.setdefault(round(score(trees, x), 9), [0.0, 0.0])
                old[0], old[1] = old[0] + c[0], old[1] + c[1]
        neg = pos = 0.0
        for s in sorted(by, reverse=True):
            neg, pos = neg + by[s][0], pos + by[s][1]
            if pos >= LEAST and pos >= PRECISION * (pos + neg):
                out[g] = s
    return out


def candidates(text: Column) -> Column:
    return F.concat(*(F.transform(located(text, p, NEEDS.get(g)), _featured(i)) for i, (g, p) in enumerate(GENERATORS.items())))


def _counted(rows: DataFrame) -> list:
    """rows (fold, y, c) -> (fold, y, features, n), summed."""
    return rows.groupBy("fold", "y", *(F.col("c")[n].alias(n) for n in FEATURES)).agg(F.count(F.lit(1)).alias("n")).collect()


def _tables(found: list, known: float = 1.0, unknown: float = 1.0) -> dict[bool, Counts]:
    out: dict[bool, Counts] = {False: {}, True: {}}
    for r in sorted(found, key=tuple):
        x = tuple(r[n] for n in FEATURES)
        old = out[r.fold].get(x, (0.0, 0.0))
        out[r.fold][x] = (old[0] + (not r.y) * r.n * unknown, old[1] + r.y * r.n * known)
    return out


def _sentences(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(fold, y, c) of the candidates of made-up sentences; y: it covers most of the personal data and little else."""
    rows = F.from_json(F.lit(json.dumps(made_up(n, seed))), "array<struct<i:int,text:string,a:int,b:int>>")
    rows = spark.range(1).select(F.explode(rows).alias("x")).select("x.*").withColumn("c", F.explode(candidates(F.col("text"))))
    both = F.least("c.end", "b") - F.greatest("c.start", "a")
    y = (F.col("a") >= 0) & (both * 10 >= (F.col("b") - F.col("a")) * 8) & (both * 10 >= (F.col("c.end") - F.col("c.start")) * 7)
    return rows.select((F.col("i") % 10 >= 8).alias("fold"), y.alias("y"), "c", "i", "a")


def _merge(a: Counts, b: Counts) -> Counts:
    return {k: tuple(x + y for x, y in zip(a.get(k, (0.0, 0.0)), b.get(k, (0.0, 0.0)), strict=True)) for k in {*a, *b}}


class Model:
    """Trees and cuts from made-up sentences and the corpus' candidates: rows (fold, y, c)."""

    def __init__(self, seen: DataFrame, n: int = MADE_UP, seed: int = 11) -> None:
        ours = _counted(_sentences(seen.sparkSession, n, seed))
        theirs = _counted(seen)
        total = {y: max(1.0, sum(r.n for r in theirs if r.y == y)) for y in (False, True)}
        weight = UNKNOWN_WEIGHT * sum(r.n for r in ours)
        made, corpus = _tables(ours), _tables(theirs, min(1.0, weight / total[True]), min(1.0, weight / total[False]))
        self.trees = boost(_merge(made[False], corpus[False]))
        # what the corpus' other candidates are isn't known, so precision is taken of the made-up ones and of base spans
        known = {k: (0.0, p) for k, (_, p) in corpus[True].items() if p}
        self.cuts = cuts(_merge(made[True], known), self.trees)

    def takes(self, c: Column) -> Column:
        total = sum((tree_column(t, lambda n: c[n]) for t in self.trees), F.lit(0.0))
        high = F.lit(False)
        for g, s in sorted(self.cuts.items()):
            high = high | ((c["generator"] == g) & (total >= s - 1e-6))
        return high


def held_out(docs: DataFrame, n: int = 2000, seed: int = 99) -> dict[str, float]:
    """On made-up sentences of another seed: the share of personal data found and of look-alikes taken for it."""
    spark = docs.sparkSession
    model = Model(_seen(_spans(docs)))
    rows = _sentences(spark, n, seed).withColumn("hit", model.takes(F.col("c")))
    by = rows.groupBy("i", "a").agg(F.max((F.col("hit") & F.col("y")).cast("int")).alias("found"), F.max((F.col("hit") & ~F.col("y")).cast("int")).alias("wrong"))
    got = by.agg(F.sum(F.when(F.col("a") >= 0, F.col("found"))), F.sum(F.when(F.col("a") < 0, F.col("wrong")))).first()
    return {"found": (got[0] or 0) / (n // 2), "wrong": (got[1] or 0) / (n - n // 2)}


def _spans(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans by kind and together, candidates."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))
    rows = rows.withColumns({k: F.transform(F.filter(located(F.col("text"), PATTERNS[k], NEEDS.get(k)), passes(k)), place) for k in KINDS} | {"candidates": candidates(F.col("text"))})
    rows = rows.withColumn("base", F.concat(*KINDS))
    return durable(rows.select("doc_id", *KINDS, marked(F.col("candidates"), F.col("base")).alias("candidates")))


def _seen(rows: DataFrame) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return rows.where(F.size("candidates") > 0).select(fold.alias("fold"), F.explode("candidates").alias("c")).select("fold", F.col("c.hit").alias("y"), "c")


def pii_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_model."""
    rows = _spans(docs)
    model = Model(_seen(rows))
    none = F.array().cast("array<struct<start:int,end:int>>")
    chosen = lambda c: model.takes(c) & ~c["hit"]
    picked = F.array_sort(F.transform(F.filter("candidates", chosen), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))))
    free = folded(picked, none, lambda a, c: F.when(c["start"] >= a["at"], F.struct(c["end"].alias("at"), F.concat(a["out"], F.array(c)).alias("out"))).otherwise(a))
    rows = rows.withColumn("model", F.when(F.size("candidates") > 0, free).otherwise(none))
    written = {k: F.transform(k, _written(k)) for k in (*KINDS, "model")}
    base = F.array_join(F.concat(*(written[k] for k in KINDS)), ",")
    all_ = F.array_join(F.concat(*written.values()), ",")
    return rows.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), all_.alias("spans"), F.size("model").cast("long").alias("n_model"))
