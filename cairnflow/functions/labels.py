"""Labels, roles, series, themes, cursors: cleaning functions over columns, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalar as S

#: Staff roles that count and what they are called, character roles, roles that a character can't have.
STAFF_ROLES = {"director": "Director", "original creator": "Original Creator", "creator": "Original Creator", "series composition": "Series Composition", "script": "Script", "music": "Music", "character design": "Character Design"}
CHARACTER_ROLES = {"main": "Main", "supporting": "Supporting", "unknown": "Unknown", "": "Unknown"}
STAFF_LIKE = ("director", "producer", "key animation", "music", "script", "series composition", "character design", "original creator")
#: Where a series' title ends, and the words of each theme.
SERIES_STOP = ("movie", "season", "special", "specials", "ova", "ona", "tv", "recap", "remix", "part", "chapter", "episode", "episodes")
SERIES_CUT = r"\s*[:：]\s*|\s+-\s+|\b(?:movie|season|specials?|ova|ona|recap|remix|part|chapter|episode|episodes)\b"
THEMES = {
    "romantic tension": "affection attraction couple crush dating feelings love relationship romance romantic",
    "close friendship": "bond friend friends friendship together trust",
    "creative passion": "art artist cosplay craft create design doll hobby outfit outfits passion sewing",
    "self-expression": "accept confidence dream identity passions ridicule ridiculed secret unique",
    "school life": "class classmate club high school student students",
    "opposites attract": "contrast different friendless meek popular shy worlds",
    "supernatural connection": "destiny dream fate miracle mysterious phenomenon spirit supernatural",
    "coming of age": "adolescence childhood grow student teen teenage teenager youth",
    "separation and reunion": "apart distance missing reunite reunion separate separated",
    "weather and the sky": "cloud rain sky storm sunlight weather",
    "city and countryside": "city countryside rural tokyo village",
}


def let(value: Column, of) -> Column:
    """of(value), the value computed once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def split_category(x: Column) -> tuple[Column, Column]:
    """"Theme::Isekai" -> (theme, Isekai); without a mark (genre, label)."""
    marked = x.contains("::")
    category = F.coalesce(F.nullif(S.slug(S.clean_label(F.substring_index(x, "::", 1))), F.lit("")), F.lit("genre"))
    return F.when(marked, category).otherwise("genre"), S.clean_label(F.when(marked, F.regexp_replace(x, "(?s)^.*?::", "")).otherwise(x))


def metadata_token(category: Column, label: Column) -> Column:
    """category_label as slugs; empty if either is."""
    slug = S.slug(S.clean_label(label))
    return F.when((category != "") & (slug != ""), F.concat(category, F.lit("_"), slug)).otherwise("")


def unique_labels(labels: Column) -> Column:
    """Without those that came before in other capitals; the order stays."""
    step = lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.array_append(a, x))
    return F.aggregate(labels, F.array().cast("array<string>"), step)


def split_labels(x: Column) -> Column:
    """a comma list, cleaned, empty parts and repeats left out; unknown is empty."""
    parts = F.filter(F.transform(F.split(F.trim(x), ","), lambda p: S.clean_label(F.trim(p))), lambda p: p != "")
    return F.when(x.isNull() | F.lower(F.trim(x)).isin("", "unknown"), F.array().cast("array<string>")).otherwise(unique_labels(parts))


def date_range(x: Column) -> tuple[Column, Column]:
    """F8: "A to B" -> A, B; one date has no end."""
    parts = F.split(x, " to ", 2)
    return F.nullif(F.trim(parts[0]), F.lit("")), F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit(""))


def _roles(x: Column) -> Column:
    return F.transform(F.split(F.coalesce(x, F.lit("")), r"[,/;|]+"), lambda p: F.lower(S.clean_label(F.trim(p))))


def staff_role(x: Column) -> Column:
    """the first role in STAFF_ROLES' order that a list of roles holds; null without one."""
    return let(_roles(x), lambda roles: F.coalesce(*(F.when(F.array_contains(roles, k), F.lit(v)) for k, v in STAFF_ROLES.items())))


def character_role(x: Column) -> Column:
    """Main, Supporting or Unknown; null for what only staff can be."""
    role = F.lower(S.clean_label(F.coalesce(x, F.lit(""))))
    known = F.coalesce(*(F.when(role == k, F.lit(v)) for k, v in CHARACTER_ROLES.items()), F.lit("Unknown"))
    return F.when(~role.isin(*STAFF_LIKE), known)


def creator_roles(x: Column) -> Column:
    """the roles of STAFF_ROLES that a list holds, in order, once each."""
    return F.array_sort(F.array_distinct(F.filter(_roles(x), lambda p: p.isin(*STAFF_ROLES))))


def score_map(counts: list[Column]) -> Column:
    """counts of scores 1, 2, ... -> map of score to count, without what is no count."""
    pairs = F.array(*(F.struct(F.lit(str(i)).alias("key"), S.to_int(c.cast("string")).alias("value")) for i, c in enumerate(counts, 1)))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"] >= 0))


def series_key(title: Column) -> Column:
    """the title up to a colon, dash or format word, without stopwords, up to a season or ordinal; if that leaves one token, the first two."""
    low = F.lower(title)

    def of(tokens: Column) -> Column:
        ends = F.transform(tokens, lambda t: t.isin(*SERIES_STOP) | t.rlike(r"^\d+(?:st|nd|rd|th)?$"))
        first = F.array_position(ends, F.lit(True))
        key = F.when(first > 0, F.slice(tokens, F.lit(1), (first - 1).cast("int"))).otherwise(tokens)
        return F.when(F.size(key) >= 2, F.array_join(key, " ")).when(F.size(tokens) > 0, F.array_join(F.slice(tokens, 1, 2), " ")).otherwise(low)

    return let(S.tokens(F.split(low, SERIES_CUT, 2)[0]), of)


def story_text(title: Column, synopsis: Column, genres: Column) -> Column:
    """F16: title, synopsis and genres, a blank between them even where one is missing."""
    empty = lambda x: F.coalesce(x, F.lit(""))
    return F.concat(empty(title), F.lit(" "), empty(synopsis), F.lit(" "), F.coalesce(F.array_join(genres, " "), F.lit("")))


def story_themes(text: Column) -> Column:
    """F16: the themes one of whose words a text has."""
    rows = lambda tokens: F.filter(F.array(*(F.when(F.arrays_overlap(tokens, F.split(F.lit(words), " ")), F.lit(theme)) for theme, words in THEMES.items())), lambda x: x.isNotNull())
    return let(S.tokens(F.coalesce(text, F.lit(""))), rows)


def natural_join(values: Column) -> Column:
    """"a, b, and c"; null and empty values are left out."""
    kept = F.filter(values, lambda v: v.isNotNull() & (v != ""))

    def of(v: Column) -> Column:
        long = F.concat(F.array_join(F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(v, -1))
        return F.when(F.size(v) == 0, "").when(F.size(v) == 1, F.get(v, F.lit(0))).when(F.size(v) == 2, F.array_join(v, " and ")).otherwise(long)

    return let(kept, of)


def json_object(text: Column) -> Column:
    """the first of a fenced object, the whole text, and what stands between the outer braces that is a JSON object; else null."""
    low = F.trim(F.coalesce(text, F.lit("")))
    fenced = F.regexp_extract(low, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)
    inline = F.regexp_extract(low, r"(?s)\{.*\}", 0)
    valid = lambda x: F.when((F.json_object_keys(x).isNotNull()) & x.startswith("{"), x)
    return F.coalesce(valid(fenced), valid(low), valid(inline))


def fingerprint(canonical: Column) -> Column:
    """the first 32 hex digits of the SHA-256 of canonical JSON."""
    return F.left(F.sha2(canonical.cast("binary"), 256), F.lit(32))


def encode_cursor(mark: Column, offset: Column, version: int = 1) -> Column:
    """base64url without padding of {"v", "f", "o"}."""
    raw = F.concat(F.lit(f'{{"v":{version},"f":"'), mark, F.lit('","o":'), offset.cast("string"), F.lit("}"))
    return F.rtrim(F.translate(F.base64(raw.cast("binary")), "+/\r\n", "-_"), F.lit("="))


def decode_cursor(cursor: Column, version: int = 1, most: int = 100_000) -> Column:
    """struct(mark, offset); null for what is no cursor of this version, or an offset outside 0..most."""
    padded = F.rpad(F.translate(cursor, "-_", "+/"), (F.ceil(F.length(cursor) / 4) * 4).cast("int"), F.lit("="))
    fields = F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), "v int, f string, o long")
    ok = (fields["v"] == version) & (F.length(fields["f"]) == 32) & fields["o"].between(0, most)
    return F.when(ok, F.struct(fields["f"].alias("mark"), fields["o"].alias("offset")))
