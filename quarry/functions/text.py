"""Column expressions over texts, names, field keys and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.config import KEY_HINTS, STOPWORDS

#: RFC 4122 name space of URLs, as hex.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def strip(text: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Pieces between white space (Unicode)."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def normalize_key(name: Column) -> Column:
    """Identity of a name: lower case, single spaces, none at the ends."""
    return F.lower(strip(F.regexp_replace(name, r"(?U)\s+", " ")))


def keywords(query: Column, shortest: int = 3, most: int = 8) -> Column:
    """The first distinct ASCII words that are long enough and no stop words."""
    found = F.regexp_extract_all(F.lower(query), F.lit("[A-Za-z0-9_]+"), F.lit(0))
    stop = F.array(*(F.lit(w) for w in STOPWORDS))
    kept = F.filter(found, lambda w: (F.length(w) >= shortest) & ~F.array_contains(stop, w))
    return F.slice(F.array_distinct(kept), 1, most)


def tokens(text: Column) -> Column:
    """Distinct lower-case words of 2 to 20 characters: the units of the keyword index."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: F.length(w).between(2, 20)))


def fuzzy_terms(query: Column, most: int = 12) -> Column:
    """array<struct<word, within>>: words of three letters or more and their allowed edit distance."""
    plain = F.regexp_replace(query, r'[+\-&|!(){}\[\]^"~*?:\\/]', " ")
    long_ = F.slice(F.filter(words(plain), lambda w: F.length(w) >= 3), 1, most)
    return F.transform(long_, lambda w: F.struct(F.lower(w).alias("word"), F.when(F.length(w) <= 4, 1).otherwise(2).alias("within")))


def key_type(key: Column) -> Column:
    """The kind of value that a field's name promises, or null."""
    low = F.lower(key)
    out = None
    for kind, needles in KEY_HINTS:
        hit = None
        for needle in needles:
            one = F.contains(low, F.lit(needle))
            hit = one if hit is None else hit | one
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def year_of(value: Column) -> Column:
    """The first year of 1900 to 2099 that no other digit touches, or null."""
    found = F.regexp_extract(value, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1)
    return F.when(found != "", found)


def relation_label(key: Column) -> Column:
    return F.concat(F.lit("HAS_"), F.upper(F.regexp_replace(F.regexp_replace(key, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")))


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Name-based UUID (version 5)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    part = lambda at, n: F.substring(h, at, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def chunk_id(doc_id: Column, index: Column) -> Column:
    return uuid5(F.concat_ws(":", doc_id.cast("string"), index.cast("string")))


def content_hash(blocks: Column) -> Column:
    """SHA-256 of a document's block texts, joined by line ends."""
    return F.sha2(F.array_join(blocks, "\n"), 256)


#: Words up to this length meet by what deletions leave of them, longer ones by their thirds.
LONG_WORD = 24


def _deletions(word: Column, most: Column) -> Column:
    n = F.length(word)
    once = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.length(w))))
    one = F.when(n >= 1, once(word)).otherwise(F.array(word))
    two = F.flatten(F.transform(one, once))
    return F.array_distinct(F.concat(F.array(word), F.when(most >= 1, one).otherwise(F.array(word)), F.when(most >= 2, two).otherwise(F.array(word))))


def _third(size: Column, k: Column) -> Column:
    """Where third k (0 to 3) of a word of this size starts."""
    return F.floor(k * size / 3).cast("int")


def _key(size: Column, k: Column, part: Column) -> Column:
    return F.concat(F.lit("\x1f"), size.cast("string"), F.lit(":"), k.cast("string"), F.lit(":"), part)


def near_index(word: Column) -> Column:
    """Keys under which a word is found by those within two edits (see near_probe)."""
    n = F.length(word)
    thirds = F.transform(F.array(*map(F.lit, range(3))), lambda k: _key(n, k, F.substr(word, _third(n, k) + 1, _third(n, k + 1) - _third(n, k))))
    return F.when(n <= LONG_WORD, _deletions(word, F.lit(2))).otherwise(thirds)


def near_probe(word: Column, most: Column) -> Column:
    """Keys of which every indexed word within ``most`` (2 at most) edits has one.

    Of short words two that are near share something that deletions leave of both.  Of a longer
    indexed word one third is left whole by two edits, and it is found in the other word at most
    two places away; so the keys grow with a word's length, not with its square."""
    n = F.length(word)
    numbers = lambda a, b: F.array(*map(F.lit, range(a, b + 1)))
    one = lambda size, k, by: F.when(
        (_third(size, k) + by >= 0) & (_third(size, k + 1) + by <= n), _key(size, k, F.substr(word, _third(size, k) + by + 1, _third(size, k + 1) - _third(size, k)))
    )
    sizes = F.filter(F.transform(numbers(-2, 2), lambda d: n + d), lambda size: size > LONG_WORD)
    keys = F.flatten(F.transform(sizes, lambda size: F.flatten(F.transform(numbers(0, 2), lambda k: F.transform(numbers(-2, 2), lambda by: one(size, k, by))))))
    keys = F.filter(keys, lambda key: key.isNotNull())
    short = F.when(n <= LONG_WORD + 2, _deletions(word, most)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(short, F.when(n > LONG_WORD - 2, keys).otherwise(F.array().cast("array<string>"))))
