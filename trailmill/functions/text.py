"""Text functions: folding for search, match ranks, names, versions, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import substring_distance


def folded(text: Column) -> Column:
    """Text for search: lower case, umlauts and their spellings alike, letters a-z and digits only."""
    plain = F.translate(F.lower(text), "äöü", "aou")
    for spelling, letter in (("ß", "ss"), ("ae", "a"), ("oe", "o"), ("ue", "u"), ("ss", "s")):
        plain = F.replace(plain, F.lit(spelling), F.lit(letter))
    return F.regexp_replace(plain, "[^a-z0-9]", "")


def typo_tolerance(needle: Column) -> Column:
    """Edits that a needle of this length may be off: none under 4 letters, one up to 7, else two."""
    return F.when(F.length(needle) < 4, 0).when(F.length(needle) <= 7, 1).otherwise(2)


def near_match(needle: Column, hay: Column) -> Column:
    """Does the hay hold the needle up to its tolerance?"""
    return substring_distance(needle, hay) <= typo_tolerance(needle)


def match_rank(needle: Column, text: Column) -> Column:
    """0 for the same text, 1 if it begins so, 2 if one of its words does, 3 if it holds it; null otherwise."""
    whole, wanted = folded(text), folded(needle)
    words = F.transform(F.split(F.lower(text), r"[\s\-/,.()]+"), folded)
    return F.when(whole == wanted, 0).when(whole.startswith(wanted), 1).when(F.exists(words, lambda w: w.startswith(wanted)), 2).when(F.contains(whole, wanted), 3)


def search_words(text: Column) -> Column:
    """Distinct folded words of at least two letters, in order of their place."""
    words = F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), folded)
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2))


def longest_word(text: Column) -> Column:
    """The longest search word, the first of equals."""
    words = search_words(text)
    most = F.array_max(F.transform(words, F.length))
    return F.get(F.filter(words, lambda w: F.length(w) == most), F.lit(0))


def shard_key(text: Column, letters: int = 2) -> Column:
    """The first letters of the longest word, under which a name is filed."""
    return F.left(longest_word(text), F.lit(letters))


def name_key(name: Column) -> Column:
    """A file name as a key: lower case, no .gpx, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"\.gpx$", ""), r"[^\p{L}\p{N}]", "")


def clean_name(name: Column, most: int = 80) -> Column:
    """A trimmed name of at most so many characters; blank ones are null."""
    return F.nullif(F.left(F.trim(name), F.lit(most)), F.lit(""))


def decoded_name(name: Column) -> Column:
    """A percent-encoded name decoded if that gives text; a plus stays a plus."""
    escaped = F.replace(name, F.lit("+"), F.lit("%2B"))
    return F.when(name.rlike("%[0-9A-Fa-f]{2}"), F.coalesce(F.try_url_decode(escaped), name)).otherwise(name)


def joined_names(names: Column, others: str = "and {} others") -> Column:
    """One name, up to three names, or two names and how many others there are."""
    n = F.size(names)
    more = F.concat(F.concat_ws(", ", F.slice(names, 1, 2)), F.lit(" " + others.split("{}")[0]), (n - 2).cast("string"), F.lit(others.split("{}")[1]))
    return F.when(n <= 3, F.concat_ws(", ", names)).otherwise(more)


def truncated(text: Column, most: int) -> Column:
    """Text of at most so many characters, the last one an ellipsis where it was longer."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def elevation_of(text: Column) -> Column:
    """Whole metres from texts like ``1780 m`` or ``1.780,5``; null if there is no number."""
    number = F.regexp_extract(F.replace(text, F.lit(","), F.lit(".")), r"^\s*(-?\d+(?:\.\d+)?)\s*(?:m|$)", 1)
    return F.round(F.nullif(number, F.lit("")).cast("double")).cast("int")


def worst_of(tags: Column, ranks: dict[str, int]) -> Column:
    """The highest rank among the parts of a ``;`` list; unknown parts do not count."""
    table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return F.array_max(F.transform(F.split(tags, ";"), lambda t: F.try_element_at(table, F.trim(t))))


def tags_match(tags: Column, wanted: dict[str, str]) -> Column:
    """Does a map of tags hold all of some values?"""
    out = F.lit(True)
    for key, value in wanted.items():
        out = out & F.coalesce(F.try_element_at(tags, F.lit(key)) == value, F.lit(False))
    return out


def first_matching_kind(tags: Column, kinds: list[tuple[str, dict[str, str]]], refused: dict[str, list[str]] | None = None) -> Column:
    """The first kind whose tags all match, unless a refused value is there; null if none."""
    out = F.lit(None).cast("string")
    for name, wanted in reversed(kinds):
        out = F.when(tags_match(tags, wanted), F.lit(name)).otherwise(out)
    for key, values in (refused or {}).items():
        out = F.when(F.coalesce(F.try_element_at(tags, F.lit(key)).isin(values), F.lit(False)), F.lit(None)).otherwise(out)
    return out


def version_numbers(version: Column) -> Column:
    """The three numbers of a version, or null if it has another form."""
    return F.when(version.rlike(r"^\d+\.\d+\.\d+$"), F.transform(F.split(version, r"\."), lambda x: x.cast("int")))


def is_older(version: Column, least: Column) -> Column:
    """Is a version below the least one? Null if one of them is malformed."""
    return version_numbers(version) < version_numbers(least)


def safe_link(link: Column) -> Column:
    """A trimmed https link without spaces or quotes of at most 500 characters, else null."""
    trimmed = F.trim(link)
    return F.when(trimmed.rlike(r"""^https://[^\s"'<>]+\.[^\s"'<>]+$""") & (F.length(trimmed) <= 500), trimmed)


def pair_topic(a: Column, b: Column, prefix: str = "live") -> Column:
    """The topic that two accounts share, whichever of them comes first."""
    return F.concat_ws(":", F.lit(prefix), F.least(a, b), F.greatest(a, b))


def topic_members(topic: Column, prefix: str = "live") -> Column:
    """The two members of a topic as an array, or null if it has another form."""
    return F.when(topic.rlike(f"^{prefix}:[^:]+:[^:]+$"), F.slice(F.split(topic, ":"), 2, 2))


def top_frame(stack: Column, own: str) -> Column:
    """The first line of a stack that names one's own code, else the first line."""
    lines = F.filter(F.split(stack, "\n"), lambda x: F.trim(x) != "")
    return F.trim(F.coalesce(F.get(F.filter(lines, lambda x: F.contains(x, F.lit(own))), F.lit(0)), F.get(lines, F.lit(0))))


def defused(text: Column) -> Column:
    """Text whose mentions call nobody: a zero-width space after each at sign."""
    return F.regexp_replace(text, "@(?=\\w)", "@​")


def osm_id(code: Column) -> Column:
    """Struct (kind, id) of a coded id: n, w and r as they are, areas by parity from ways or relations."""
    kind, number = F.substring(code, 1, 1), F.substring(code, 2, 30).cast("long")
    return F.when(
        kind == "a",
        F.struct(F.when(number % 2 == 0, "w").otherwise("r").alias("kind"), F.floor(number / 2).cast("long").alias("id")),
    ).otherwise(F.struct(kind.alias("kind"), number.alias("id")))


def meters_label(m: Column) -> Column:
    """Metres below a kilometre, else kilometres with one decimal below ten; null without a number.

    The decimal is that of the exact binary value, ties to even: ``%.1f`` rounds the shortest text of a double half up, ``format_number`` its value.
    """
    whole = lambda v, unit: F.concat(F.round(v).cast("long").cast("string"), F.lit(unit))
    return F.when(m < 1000, whole(m, " m")).when(m < 10_000, F.concat(F.format_number(m / 1000, 1), F.lit(" km"))).otherwise(whole(m / 1000, " km"))


def duration_label(seconds: Column) -> Column:
    """Hours and minutes."""
    minutes = F.floor(seconds / 60)
    return F.when(minutes < 60, F.format_string("%d min", minutes)).otherwise(F.format_string("%d h %02d min", F.floor(minutes / 60), F.pmod(minutes, F.lit(60))))


def fnv1a(data: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, 32 bits. Offset basis 2166136261, prime 16777619."""
    hexes = F.hex(data.cast("binary"))
    byte = lambda k: F.conv(F.substring(hexes, k * 2 + 1, F.lit(2)), 16, 10).cast("long")
    steps = F.filter(F.sequence(F.lit(0), F.greatest(F.length(hexes) / 2 - 1, F.lit(0)).cast("int")), lambda k: k * 2 < F.length(hexes))
    return F.aggregate(steps, F.lit(2166136261).cast("long"), lambda h, k: F.pmod(h.bitwiseXOR(byte(k)) * 16777619, F.lit(4294967296)))
