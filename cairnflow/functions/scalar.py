"""Cleaning and scalar functions over columns; JVM-side unless a Unicode form that Spark lacks needs an Arrow UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as no value, marks of wrongly decoded text, and words that carry no meaning in a title.
UNKNOWN = ("", "unknown", "nan", "none")
MOJIBAKE = "[ÃÂâð�]"
STOPWORDS = tuple("a an and are as at be by for from has in into is it its anime like liked next of on or recommend recommendation recommendations series show shows that the their this to watch with".split())


def to_float(x: Column) -> Column:
    """Unknown spellings and what is no number become null."""
    return F.when(~F.lower(F.trim(x)).isin(*UNKNOWN), F.trim(x).try_cast("double"))


def to_int(x: Column) -> Column:
    """As to_float, cut to a whole number: "12.0" is 12."""
    return to_float(x).try_cast("int")


def year_of(*xs: Column) -> Column:
    """The first year 1900..2099 in the first column that has one."""
    return F.coalesce(*(F.nullif(F.regexp_extract(F.coalesce(x.cast("string"), F.lit("")), r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int") for x in xs))


def clean_label(x: Column) -> Column:
    """What follows the last "::", a doubled phrase once."""
    last = F.trim(F.element_at(F.split(x, "::"), -1))
    words = F.split(last, r"\s+")
    half = (F.size(words) / 2).cast("int")
    doubled = (F.size(words) % 2 == 0) & (F.slice(words, F.lit(1), F.greatest(half, F.lit(1))) == F.slice(words, F.greatest(half, F.lit(1)) + 1, F.greatest(half, F.lit(1))))
    return F.when((F.size(words) > 1) & doubled, F.array_join(F.slice(words, F.lit(1), F.greatest(half, F.lit(1))), " ")).otherwise(last)


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_|_$", "")


def tokens(x: Column) -> Column:
    """Lower-case letters and digits, without stopwords."""
    found = F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS))


def family_key(x: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def name_variants(x: Column) -> Column:
    """Keys of a name: as written, and "Last, First" also the other way round."""
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    parts = F.split(x, ",", 2)
    return F.array_distinct(F.when(F.size(parts) == 2, F.array(key(x), key(F.concat(parts[1], parts[0])))).otherwise(F.array(key(x))))


def positive_score(x: Column) -> Column:
    return F.least(F.greatest(F.nanvl(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def decade(year: Column) -> Column:
    return F.when(year.between(1900, 2100), F.concat(F.lit("decade:"), (F.floor(year / 10) * 10).cast("string"), F.lit("s"))).otherwise("decade:unknown")


def shortened(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.rtrim(F.substring(x, 1, n - 3)), F.lit("..."))).otherwise(x)


def signed_bucket(x: Column, width: int) -> tuple[Column, Column]:
    """Hashed feature: bucket by CRC-32, sign by the CRC-32 of "sign:" before it."""
    return F.crc32(x.cast("binary")) % width, F.when(F.crc32(F.concat(F.lit("sign:"), x).cast("binary")) % 2 == 0, 1.0).otherwise(-1.0)


def jaccard_distance(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


@F.pandas_udf(T.StringType())
def fix_text(x: pd.Series) -> pd.Series:
    """Undoes up to two wrong decodings if that leaves fewer marks; white space collapsed."""
    import re

    marks = re.compile(MOJIBAKE)

    def fixed(s: str | None) -> str | None:
        if s is None:
            return None
        for _ in range(2):
            best = s
            for codec in ("latin-1", "cp1252"):
                try:
                    other = s.encode(codec).decode("utf-8")
                except (UnicodeEncodeError, UnicodeDecodeError):
                    continue
                if len(marks.findall(other)) < len(marks.findall(best)):
                    best = other
            if best == s:
                break
            s = best
        return " ".join(s.split())

    return x.map(fixed)


@F.pandas_udf(T.StringType())
def folded(x: pd.Series) -> pd.Series:
    """Key for comparison: compatibility form, no marks, case folded, letters and digits only."""
    import unicodedata

    return x.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s).casefold() if c.isalnum() and not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def stable_order(x: pd.Series) -> pd.Series:
    """Hex of the 8-byte BLAKE2b digest."""
    import hashlib

    return x.map(lambda s: hashlib.blake2b((s or "").encode(), digest_size=8).hexdigest())


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity."""
    import difflib

    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])
