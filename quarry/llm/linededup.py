"""Line de-duplication: fuzzy lines by MinHash.

A line is lower-cased and trimmed.  Its character shingles are hashed once; the hash deals each to
one of ``BANDS x ROWS`` bins, which keep their minimum (one-permutation MinHash, empty bins filled
from others by a fixed rule).  Lines that agree on one band of ``ROWS`` bins are candidates: at a
Jaccard similarity of 0.8 a pair is missed with odds of (1 - 0.8^4)^10 = 0.5 %, above 0.85 of
0.06 %.  Inside each band bucket the sets of 64-bit shingle hashes are compared exactly, each line at
once with all that are not joined yet, so a bucket of many likenesses costs about its size.  Buckets
beyond ``BUCKET_LINES`` or ``BUCKET_BYTES`` are split into parts and every pair of parts is compared on its own.
Distributed union-find joins the links, and of each component the first line (by doc_id, then
place) stays.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import components, discard, frugal, local_labels, release, slices, text_hash, written

SHINGLE = 8
SIMILARITY = 0.8
BANDS, ROWS = 10, 4
#: Every line that is not blank takes part.
MIN_CHARS = 1
#: Lines of one bucket, or of each of the two parts of a larger one, that a task compares at once.
BUCKET_LINES = 1024
#: Bytes of these lines (of four-byte characters), or of the shingle hashes of documents.
BUCKET_BYTES = 16 << 20
#: 64-bit words of the filter of wanted lines.
FILTER_WORDS = 1 << 20

_BINS = BANDS * ROWS
_EMPTY = np.uint32(0xFFFFFFFF)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
_LINES_AT_ONCE = 500
#: Lines that a task remembers, so as not to sign them twice; bytes of text that become Python objects at once.
RECENT, TEXT_AT_ONCE = 20_000, 1 << 20


def shingles(line: str) -> set[str]:
    """The distinct character shingles of a line; a shorter line is its own."""
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def similarity(a: set[str], b: set[str]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def _donors(tries: int = 64) -> np.ndarray:
    """For each try and bin the bin that an empty one copies."""
    seeds = np.arange(tries * _BINS, dtype=np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        mixed = (seeds * _MIX[0]) ^ ((seeds * _MIX[0]) >> np.uint64(31))
        mixed = mixed * _MIX[1]
    return ((mixed >> np.uint64(40)) % np.uint64(_BINS)).astype(np.int64).reshape(tries, _BINS)


_DONORS = _donors()


def _shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of all shingles of all lines (of one at least), repeats included, the line of each, and
    the number of lines."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        base, width, rolled = _MIX[0], 1, points
        while width < SHINGLE:  # hash of a run from those of its halves
            rolled = rolled[:-width] * base + rolled[width:] if len(rolled) > width else rolled[:0]
            base, width = base * base, 2 * width
        hashes = (rolled ^ (rolled >> np.uint64(31))) * _MIX[1]
        hashes ^= hashes >> np.uint64(29)
    inside = np.ones(len(hashes) + SHINGLE - 1, bool)
    inside[(starts + sizes)[:, None] - np.arange(1, SHINGLE)] = False  # runs over the end of a line
    return hashes[inside[: len(hashes)]], np.repeat(np.arange(len(lines)), sizes - (SHINGLE - 1)), len(lines)


def signatures(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) 64-bit band keys."""
    hashes, row, n = _shingle_hashes(lines)
    bins = np.full((n, _BINS), _EMPTY, np.uint32)
    place = ((hashes >> np.uint64(32)) * np.uint64(_BINS) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(bins.reshape(-1), row * _BINS + place, hashes.astype(np.uint32))
    held, full = bins.copy(), bins != _EMPTY
    for donors in _DONORS:
        open_ = held == _EMPTY
        if not open_.any():
            break
        held = np.where(open_ & full[:, donors], bins[:, donors] + np.uint32(0x9E3779B9), held)
    keys = np.zeros((n, BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            keys = (keys ^ held[:, k::ROWS]) * _MIX[0]
            keys ^= keys >> np.uint64(32)
        keys = (keys + np.arange(BANDS, dtype=np.uint64)) * _MIX[1]
    return (keys ^ (keys >> np.uint64(31))).view(np.int64)


def comparable(text: str | None, min_chars: int) -> list[tuple[int, str]]:
    """(place, line) of the lines that are long enough, lower-cased and trimmed."""
    trimmed = (line.strip(" \t\r") for line in (text or "").lower().split("\n"))
    return [(n, line) for n, line in enumerate(trimmed) if len(line) >= min_chars]


def names_of(lines: list[str]) -> np.ndarray:
    """(lines, 2) signed 64-bit halves of a 128-bit hash."""
    digests = b"".join([xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass")) for line in lines])
    return np.frombuffer(digests, "<i8").reshape(-1, 2)


def _sign(min_chars: int):
    """Documents (doc_id, text, t) -> doc_id, t, line_no, d1, d2 and size (bytes) of their lines, and the band keys; a line
    that this task has met lately gets none, nor does one shorter than a shingle, which only equals itself."""

    def run(batches):
        recent: OrderedDict = OrderedDict()
        for batch in batches:
            for part in slices(batch, 1, TEXT_AT_ONCE):
                rows, places, lines = [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    for place, line in comparable(text, min_chars):
                        rows.append(row), places.append(place), lines.append(line)
                names = names_of(lines)
                first = []
                for k, pair in enumerate(map(tuple, names.tolist())):
                    if len(lines[k]) >= SHINGLE and pair not in recent:
                        recent[pair] = None
                        first.append(k)
                        if len(recent) > RECENT:
                            recent.popitem(last=False)
                keys: list = [None] * len(lines)
                for at in range(0, len(first), _LINES_AT_ONCE):
                    some = first[at : at + _LINES_AT_ONCE]
                    for k, row in zip(some, signatures([lines[k] for k in some]), strict=True):
                        keys[k] = row
                of = pa.array(rows, pa.int64())
                columns = [part.column(0).take(of), part.column(2).take(of), pa.array(places, pa.int32()), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(keys, pa.list_(pa.int64())), pa.array([4 * len(x) for x in lines], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "line_no", "d1", "d2", "keys", "size"])

    return run


def _fetch(min_chars: int, held):
    """Documents -> (d1, d2, line) of the lines whose bit is set in a bitmap."""

    def run(batches):
        bits = held.value
        for batch in batches:
            for part in slices(batch, 1, TEXT_AT_ONCE):
                lines = [line for text in part.column(1).to_pylist() for _, line in comparable(text, min_chars)]
                names = names_of(lines)
                hit = np.flatnonzero(marked(names[:, 0], bits))
                yield pa.RecordBatch.from_arrays([pa.array(names[hit, 0]), pa.array(names[hit, 1]), pa.array([lines[k] for k in hit], pa.string())], ["d1", "d2", "line"])

    return run


def _exploded(held):
    """(keys, d1, size) -> (key, d1, size) of the keys whose bit is set in a bitmap."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            row = pc.list_parent_indices(batch.column(0)).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(marked(keys, held.value))
            of = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), batch.column(1).take(of), batch.column(2).take(of)], ["key", "d1", "size"])

    return run


def _bitmap(wanted: DataFrame, name: str) -> np.ndarray:
    """Bits of the wanted hashes, in a filter of fixed size: 8 MB, however many there are.  Once it
    fills up it lets more rows through to the join behind it, which is exact."""
    slot = F.shiftrightunsigned(name, 6) % FILTER_WORDS
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(name).bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
    rows = wanted.select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_WORDS, np.uint64)
    bits[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return bits


def marked(names: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes have their bit in a bitmap."""
    slot = names.view(np.uint64)
    return (bits[(slot >> np.uint64(6)) % np.uint64(len(bits))] >> (slot & np.uint64(63))) & np.uint64(1)


def line_sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the hashes of the shingles of lines of one shingle or more, and how many each has."""
    hashes, row, _ = _shingle_hashes(lines)
    return hashes, np.bincount(row, minlength=len(lines))


def _numbered(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, starts): distinct hashes numbered from 0, each set's distinct numbers one after another."""
    order = np.argsort(hashes)
    ranked = hashes[order]
    numbers = np.empty(len(hashes), np.int64)
    numbers[order] = np.cumsum(np.concatenate(([False], ranked[1:] != ranked[:-1])))
    both = np.sort(np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) << 32 | numbers)
    both = both[np.concatenate(([True], both[1:] != both[:-1]))]
    return both & 0xFFFFFFFF, np.searchsorted(both, np.arange(len(sizes) + 1, dtype=np.int64) << 32)


def _forest(numbers: np.ndarray, starts: np.ndarray, side: np.ndarray | None, flags: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Spanning links of the sets number starts[k] to starts[k + 1] whose Jaccard similarity reaches the
    threshold; with sides only between the two.  Breadth first: each set in turn is compared at
    once with all that are not yet joined to another, so sets that are alike cost about their size."""
    links, queue = [], []
    rest = np.arange(len(starts) - 1)
    sizes = np.diff(starts)
    flat, edges = numbers[starts[0] : starts[-1]], starts[:-1] - starts[0]
    while len(rest) > bool(not queue):  # one alone has nothing left to meet
        k = queue.pop() if queue else int(rest[0])
        mine = numbers[starts[k] : starts[k + 1]]
        flags[mine] = 1
        both = np.add.reduceat(flags[flat], edges)
        flags[mine] = 0
        near = both / (sizes[k] + sizes[rest] - both) >= threshold
        if side is not None:
            near &= side[rest] != side[k]
        first = rest[0] == k  # a set that starts a group is still among the rest
        if first:
            near[0] = True
        if near.any():
            met = rest[near][int(first) :].tolist()
            links += [(k, m) for m in met]
            queue += met
            flat, edges, rest = _only(flat, edges, rest, sizes, ~near)
    return links


def _only(flat, edges, rest, sizes, keep):
    """The sets that are left of ``rest``."""
    left = sizes[rest[keep]]
    return flat[np.repeat(keep, sizes[rest])], np.cumsum(left) - left, rest[keep]


def _compare(threshold: float, sets=line_sets, most: int = 1 << 18):
    """Rows (key, i, j, part, d1, d2, line), sorted by bucket -> spanning links between lines.  Whole
    buckets of about ``most`` characters or bytes are hashed at once."""

    def joined(held: list) -> list:
        """held: for each bucket its two parts and members (part, d1, d2, line)."""
        numbers, starts = _numbered(*sets([m[3] for _, _, members in held for m in members]))
        flags = np.zeros(int(numbers.max()) + 1, np.int32)
        links, at = [], 0
        for i, j, members in held:
            side = None if i == j else np.array([m[0] for m in members])
            found = _forest(numbers, starts[at : at + len(members) + 1], side, flags, threshold)
            links += [(members[a][1:3], members[b][1:3]) for a, b in found]
            at += len(members)
        return links

    def run(batches):
        held, size, now, members = [], 0, None, []
        out: list = []
        for batch in batches:
            for few in slices(batch, 6, TEXT_AT_ONCE):  # what becomes Python objects at once stays small
                for key, i, j, part, d1, d2, line in zip(*(c.to_pylist() for c in few.columns), strict=True):
                    if (key, i, j) != now:
                        if len(members) > 1:
                            held.append((now[1], now[2], members))
                        else:
                            size -= sum(len(m[3]) for m in members)
                        if size >= most and held:
                            out += joined(held)
                            held, size = [], 0
                        now, members = (key, i, j), []
                    members.append((part, d1, d2, line))
                    size += len(line)
            if len(out) > 50_000:
                yield _links(out)
                out = []
        if len(members) > 1:
            held.append((now[1], now[2], members))
        if held:
            out += joined(held)
        if out:
            yield _links(out)

    return run


def _links(pairs: list) -> pa.RecordBatch:
    """One spanning forest of the pairs found."""
    number = {node: k for k, node in enumerate(sorted({x for p in pairs for x in p}))}
    nodes = list(number)
    labels = local_labels(len(nodes), np.array([number[a] for a, _ in pairs]), np.array([number[b] for _, b in pairs]))
    rows = [(*nodes[k], *nodes[r]) for k, r in enumerate(labels.tolist()) if k != r]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["a1", "a2", "b1", "b2"])


def line_links(docs: DataFrame, signed: DataFrame, threshold: float = SIMILARITY, bucket_lines: int = BUCKET_LINES, min_chars: int = MIN_CHARS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(a, b) structs of 128-bit line hashes: verified links between different lines."""
    return set_links(docs, signed, lambda held: _fetch(min_chars, held), "string", _compare(threshold), bucket_lines, bucket_bytes)


def set_links(docs: DataFrame, signed: DataFrame, fetch, kind: str, compare, bucket_lines: int, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(a, b) structs of hashes, from rows with d1, d2, band keys and size in bytes.  A task compares two
    parts of a bucket, each of ``bucket_lines`` rows and ``bucket_bytes`` bytes about, or one larger row.  fetch: from a bitmap of wanted
    d1 to the function that makes (d1, d2, line) of docs; compare: that of the buckets.

    Keys that different lines share are found by partly aggregated sums; only their rows are dealt
    out, and the joins on a key can be split where one is hot."""
    spark = docs.sparkSession
    some = signed.where("keys is not null").select("keys", "d1", "size")
    # the first half of a line's hash stands for it until texts are joined
    ends = some.select(F.explode("keys").alias("key"), "d1").groupBy("key").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi"))
    shared = written(ends.where("lo < hi").select("key"), "line-keys")
    release(spark)
    held = spark.sparkContext.broadcast(_bitmap(shared, "key"))
    rows = some.mapInArrow(frugal(_exploded(held)), "key bigint, d1 bigint, size bigint").distinct()
    met = written(rows.join(shared, "key", "left_semi"), "line-buckets")
    discard(shared)
    release(spark)
    # bands that gather the same lines do so once
    parts = F.greatest(F.ceil(F.count("*") / bucket_lines), F.ceil(F.sum("size") / bucket_bytes)).cast("int").alias("parts")
    marks = met.groupBy("key").agg(F.count("*").alias("n"), parts, F.bit_xor("d1").alias("x1"), F.bit_xor(F.xxhash64("d1")).alias("x2"))
    once = written(marks.groupBy("n", "x1", "x2").agg(F.min("key").alias("key"), F.max("parts").alias("parts")).select("key", "parts"), "line-once")
    members = written(met.drop("size").join(once, "key"), "line-members")
    discard(met, once)
    wanted = members.select("d1").distinct()
    held = spark.sparkContext.broadcast(_bitmap(wanted, "d1"))
    texts = docs.select("doc_id", "text").mapInArrow(frugal(fetch(held)), f"d1 bigint, d2 bigint, line {kind}")
    texts = written(texts.dropDuplicates(["d1", "d2"]).join(wanted, "d1", "left_semi"), "line-texts")
    release(spark)
    part = F.pmod(F.col("d1"), F.col("parts")).cast("int")
    # every pair (i, j) of parts that holds this line's part
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, "part").alias("i"), F.greatest(k, "part").alias("j")))
    blocks = members.withColumn("part", part).select("key", "d1", "part", F.inline(pairs))
    full = blocks.join(texts, "d1").select("key", "i", "j", "part", "d1", "d2", "line")
    found = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(frugal(compare), "a1 bigint, a2 bigint, b1 bigint, b2 bigint")
    links = written(found, "line-links")
    discard(members, texts)
    release(spark)
    pair = lambda x: F.struct(F.col(f"{x}1").alias("d1"), F.col(f"{x}2").alias("d2")).alias(x)
    return links.select(pair("a"), pair("b"))


def dedup_lines(docs: DataFrame, threshold: float = SIMILARITY, bucket_lines: int = BUCKET_LINES, min_chars: int = MIN_CHARS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The documents with every repeated line taken out of their text, and a column
    dropped_lines (sorted places of the lines that went).

    Of equal or similar lines, within or across documents, the first one stays, by doc_id (null
    first), hash of the text and place.  Lines under ``min_chars`` characters (blank ones) stay.
    Documents never go; a text may become empty.  Null texts stay null.  A document is a doc_id with
    a text: rows that share an id, or have none, but differ in text are different documents; rows
    equal in both are one and keep the same lines.  An empty table gives an empty result.  Other
    columns of any name pass unchanged (one named dropped_lines is replaced).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", "text", text_hash().alias("t"))
    shape = f"doc_id {kind}, t bigint, line_no int, d1 bigint, d2 bigint, keys array<bigint>, size bigint"
    signed = written(slim.mapInArrow(frugal(_sign(min_chars)), shape), "lines")
    roots = components(line_links(slim, signed, threshold, bucket_lines, min_chars, bucket_bytes), "line-components")
    roots = roots.select(F.col("node.d1").alias("d1"), F.col("node.d2").alias("d2"), "root")
    occurrences = signed.drop("keys", "size").join(roots, ["d1", "d2"], "left").select("doc_id", "t", "line_no", F.coalesce("root", F.struct("d1", "d2")).alias("root"))
    place = F.struct("doc_id", "t", "line_no")
    ends = occurrences.groupBy("root").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # written, so that the join on a line that many documents share is one that can be split
    first = written(ends.where(~F.col("first").eqNullSafe(F.col("last"))).select("root", "first"), "line-first")
    gone = occurrences.join(first, "root").where(~place.eqNullSafe(F.col("first")))
    per_doc = gone.groupBy(F.col("doc_id").alias("gone_id"), F.col("t").alias("gone_t")).agg(F.sort_array(F.collect_set("line_no")).alias("gone_lines"))
    rows = docs.drop("dropped_lines").select(F.struct("*").alias("row"), "doc_id", "text", text_hash().alias("t"))
    joined = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("t") == F.col("gone_t")), "left")
    # the places that stay, once for each text; the outer lambda holds the split text
    cut = lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone_lines"), lambda k: F.get(lines, k)), "\n")
    text = F.when(F.col("gone_lines").isNull(), F.col("text")).otherwise(F.transform(F.array(F.split("text", "\n")), cut)[0])
    return joined.select(F.col("row").withField("text", text).alias("row"), F.coalesce("gone_lines", F.array().cast("array<int>")).alias("dropped_lines")).select("row.*", "dropped_lines")
