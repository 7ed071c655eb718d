"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A listed entry is a host and the start of a path, such as ``example.com/en/``; it fits its host,
all subdomains and every path that starts so.  Each distinct URL makes one candidate key for each
suffix of its host and each listed path length.  A key first meets the Bloom filter: its hash
names one block of 256 bits, in which eight bits must be set.  Only keys that pass are joined with
the listed entries themselves, which removes the false positives.  Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Filter bits for each listed key: with blocks about one false positive in a thousand.
BITS_PER_KEY = 16
BLOCK_BITS = 256
#: Blocks (32 bytes each) up to which the filter is broadcast; a larger one is joined by shuffle.
BROADCAST_BLOCKS = 1 << 20

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(host, path, verdict) of a few rules as a table made inside the JVM."""
    rows = [F.struct(*(F.lit(x).alias(n) for n, x in zip(("host", "path", "verdict"), rule, strict=True))) for rule in rules]
    if not rows:
        return spark.range(0).select(*(F.lit("").alias(n) for n in ("host", "path", "verdict")))
    return spark.range(1).select(F.inline(F.array(*rows)))


def _bits(key: Column, blocks: Column | int) -> tuple[Column, list[Column]]:
    """Block number and the four 64-bit masks (two bits each) of a key."""
    first, second = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    block = F.pmod(first, F.lit(blocks).cast("bigint") if isinstance(blocks, int) else blocks)
    one = F.lit(1).cast("bigint")

    def bit(i: int) -> Column:
        place = F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63).cast("bigint")).cast("int")
        return F.call_function("shiftleft", one, place)

    return block, [bit(2 * i).bitwiseOR(bit(2 * i + 1)) for i in range(4)]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w3) of the distinct keys (column key)."""
    block, masks = _bits(F.col("key"), blocks)
    rows = keys.select(block.alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(masks)))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)))


def possible_hits(candidates: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``candidates`` whose column key may be among ``keys``."""
    count = keys.count()
    blocks = max(1, -(-count * BITS_PER_KEY // BLOCK_BITS))
    held = bloom(keys, blocks)
    if blocks <= BROADCAST_BLOCKS:
        held = F.broadcast(held)
    block, masks = _bits(F.col("key"), blocks)
    asked = candidates.select("*", block.alias("block"), *(m.alias(f"m{i}") for i, m in enumerate(masks)))
    joined = asked.join(held, "block")
    for i in range(4):
        joined = joined.where(F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    return joined.select(*candidates.columns)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, url, host, path, rule, verdict) of every page.

    The longest listed entry that fits gives rule and verdict; where none fits the rule is null and
    the verdict ``default`` (an unlisted URL).  Entries that occur twice count once, with the
    smallest verdict.  A null URL, or one without ``://``, has an empty host and path.  Repeated
    pages give repeated rows; a table without rows gives none; other columns are ignored.  A host
    makes as many keys as listed hosts have labels at most, however many it has itself.
    """
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    listed = rules.select(F.concat("host", "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict")
    # how long listed paths are (no more numbers than the longest has characters) and how many labels hosts have
    facts = rules.agg(F.array_sort(F.collect_set(F.length("path"))).alias("cuts"), F.max(F.size(F.split("host", "[.]"))).alias("labels")).first()
    cuts = F.array(*map(F.lit, facts["cuts"])).cast("array<int>")
    urls = pages.where("url is not null").select("url").distinct().select("url", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"))
    tail = F.reverse(F.slice(F.reverse(F.split("h", "[.]")), 1, max(1, facts["labels"] or 0)))
    suffixes = F.transform(F.array(tail), lambda labels: F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")))[0]
    # one array of keys for each suffix, then flat; a path shorter than a cut makes none
    starts = F.transform(F.filter(cuts, lambda n: n <= F.length("p")), lambda n: F.substr("p", F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda host: F.transform(starts, lambda start: F.concat(host, start))))
    candidates = urls.where("h <> '' or p <> ''").select("url", F.explode(keys).alias("key"))
    hits = possible_hits(candidates, listed.select("key").distinct())
    found = hits.join(listed, "key").groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    best = found.select("url", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    return pages.select("page_id", "url").join(best, "url", "left").select(
        "page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
