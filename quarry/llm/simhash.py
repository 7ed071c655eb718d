"""SimHash near-duplicates by a binary trie self-join.

Fingerprints of equal value are one class, so copies are never paired.  Each distinct
fingerprint goes to ``budget + 1`` bit blocks: two fingerprints within ``budget`` bits agree on
one block at least, so each block value is a group that can be joined on its own.  Groups beyond
``group_rows`` fingerprints (a hot block value) are dealt again by blocks of their remaining
bits, as often as needed; every round fixes more bits, so it ends and loses no pair.

Within a task all groups form one forest of path-compressed binary tries.  Node pairs are
traversed together, from (root, root): the differing bits of the two prefixes are accumulated
and a pair is dropped as soon as they exceed the budget.  Rising budgets (1, 2, ...) are run in
turn and a pair of nodes whose leaves already share one component is dropped too, so dense
clusters of near copies cost about their size instead of its square.  Only a spanning forest
leaves the task; the rest is distributed union-find.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import overlap
from quarry.llm.common import components, keep_documents, local_labels, written

SHINGLE_WORDS = 4
BUDGET = 4
SEED = 42
#: Rows of one block value that a task takes whole: 24 bytes each, and the pruned traversal of a
#: dense group costs about its size.
GROUP_ROWS = 1 << 18
#: Node pairs expanded at once: bounds a task's memory.
PAIRS_AT_ONCE = 1 << 18

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_HASHES_AT_ONCE = 1 << 16


def simhash(text: bytes | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of a UTF-8 text: majority of the XXH64 bits of its word shingles."""
    tokens = (text or b"").translate(_LOWER).split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = ([len(joined)] if len(tokens) < words else ends[words - 1 :] - 1)
    stops = list(map(int, stops)) if isinstance(stops, list) else stops.tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _HASHES_AT_ONCE):
        span = zip(starts[at : at + _HASHES_AT_ONCE], stops[at : at + _HASHES_AT_ONCE], strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in span], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp bigint) of every document; a null or blank text has fingerprint 0."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            values = np.fromiter((simhash(t.as_py(), words, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


# --- tries ---------------------------------------------------------------------------------


class Forest:
    """Path-compressed binary tries over sorted unique keys, one per group of rows."""

    def __init__(self, keys: np.ndarray, bounds: np.ndarray):
        lo, hi = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
        los, his, depths, lefts = [], [], [], []
        base, self.roots = 0, np.arange(len(lo))
        while len(lo):
            many = hi - lo > 1
            depth = np.full(len(lo), 64, np.int64)
            first, last = keys[lo[many]], keys[hi[many] - 1]
            depth[many] = _common_bits(first ^ last)
            left = np.full(len(lo), -1, np.int64)
            left[many] = base + len(lo) + 2 * np.arange(many.sum())
            los.append(lo), his.append(hi), depths.append(depth), lefts.append(left)
            base += len(lo)
            cut = _first_with_bit(keys, lo[many], hi[many], depth[many])
            lo, hi = np.stack((lo[many], cut), 1).ravel(), np.stack((cut, hi[many]), 1).ravel()
        empty = np.zeros(0, np.int64)
        self.lo, self.hi, self.depth, self.left = (np.concatenate(x) if x else empty for x in (los, his, depths, lefts))
        self.prefix = keys[self.lo] if len(keys) else np.zeros(0, np.uint64)

    def uniform(self, labels: np.ndarray) -> np.ndarray:
        """Of each node the one label of its leaves, or -1 - node where they differ."""
        least, most = labels[self.lo].copy(), labels[self.lo].copy()
        inner = np.flatnonzero(self.left >= 0)
        for at in self._levels(inner):
            a, b = self.left[at], self.left[at] + 1
            least[at], most[at] = np.minimum(least[a], least[b]), np.maximum(most[a], most[b])
        return np.where(least == most, least, -1 - np.arange(len(least)))

    def _levels(self, inner: np.ndarray):
        """Inner nodes from the deepest generation up: children are always numbered later, and a
        generation's nodes are contiguous, ending before the first child of its first inner node."""
        at = inner
        cuts, start = [], 0
        while start < len(at):
            stop = np.searchsorted(at, self.left[at[start]])
            cuts.append(at[start:stop])
            start = stop
        return reversed(cuts)


def _common_bits(x: np.ndarray) -> np.ndarray:
    """Leading zero bits of non-zero 64-bit words."""
    out, x = np.zeros(len(x), np.int64), x.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = x >> np.uint64(64 - step) == 0
        out[high] += step
        x[high] <<= np.uint64(step)
    return out


def _first_with_bit(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """In each sorted range the first key whose bit at ``depth`` is set (binary search)."""
    lo, hi, shift = lo.copy(), hi.copy(), (63 - depth).astype(np.uint64)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        set_ = (keys[np.minimum(mid, len(keys) - 1)] >> shift) & np.uint64(1) == 1
        hi, lo = np.where(open_ & set_, mid, hi), np.where(open_ & ~set_, mid + 1, lo)


def trie_links(keys: np.ndarray, bounds: np.ndarray, nodes: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """Component label (a row) of every row.  keys: sorted unique within each group; bounds:
    group borders; nodes: number of the fingerprint that a row holds (rows of different groups
    may hold the same one).  Rows of one group link at ``budget`` or fewer differing bits."""
    forest = Forest(keys, bounds)
    n = int(nodes.max()) + 1 if len(nodes) else 0
    labels = np.arange(n, dtype=np.int64)
    for allowed in range(1, budget + 1):
        own = forest.uniform(labels[nodes])
        stack = [(forest.roots, forest.roots)]
        found_u, found_v, found = [], [], 0
        while stack:
            a, b = stack.pop()
            if len(a) > PAIRS_AT_ONCE:
                stack.append((a[PAIRS_AT_ONCE:], b[PAIRS_AT_ONCE:]))
                a, b = a[:PAIRS_AT_ONCE], b[:PAIRS_AT_ONCE]
            da, db = forest.depth[a], forest.depth[b]
            shift = (64 - np.minimum(da, db)).astype(np.uint64)
            apart = forest.prefix[a] ^ forest.prefix[b]
            apart = np.where(shift > 63, np.uint64(0), apart >> np.minimum(shift, np.uint64(63)))
            go = (np.bitwise_count(apart) <= allowed) & (own[a] != own[b])
            same = a == b
            go |= same & (own[a] < 0)
            a, b, da, db, same = a[go], b[go], da[go], db[go], same[go]
            leaf = (da == 64) & (db == 64)
            if leaf.any():
                hit = leaf & ~same
                u, v = nodes[forest.lo[a[hit]]], nodes[forest.lo[b[hit]]]
                found_u.append(u), found_v.append(v)
                found += len(u)
                if found > 4 * PAIRS_AT_ONCE:  # fold early: links never pile up
                    labels = local_labels(n, np.concatenate(found_u), np.concatenate(found_v), labels)
                    own, found_u, found_v, found = forest.uniform(labels[nodes]), [], [], 0
                rest = ~leaf
                a, b, da, db, same = a[rest], b[rest], da[rest], db[rest], same[rest]
            if not len(a):
                continue
            la, lb = forest.left[a], forest.left[b]
            own_a = ~same & (da <= db)
            own_b = ~same & (da > db)
            next_a = np.concatenate((la[same], la[same] + 1, la[same], la[own_a], la[own_a] + 1, a[own_b], a[own_b]))
            next_b = np.concatenate((la[same], la[same] + 1, la[same] + 1, b[own_a], b[own_a], lb[own_b], lb[own_b] + 1))
            if len(next_a):
                stack.append((next_a, next_b))
        if found:
            labels = local_labels(n, np.concatenate(found_u), np.concatenate(found_v), labels)
    return labels


def _link_groups(budget: int, rows_at_once: int):
    """Rows (code, top, perm, fp), sorted by group -> spanning edges (a, b) between fingerprints.  Whole
    groups of about ``rows_at_once`` rows are joined at a time."""

    def edges(rows: pa.Table):
        code, top, perm, fp = (rows.column(c).to_numpy() for c in ("code", "top", "perm", "fp"))
        perm = perm.view(np.uint64)
        order = np.lexsort((perm, top, code))
        code, top, perm, fp = code[order], top[order], perm[order], fp[order]
        edge = np.flatnonzero((code[1:] != code[:-1]) | (top[1:] != top[:-1])) + 1
        bounds = np.concatenate(([0], edge, [len(fp)]))
        values, nodes = np.unique(fp, return_inverse=True)
        labels = trie_links(perm, bounds, nodes, budget)
        linked = np.flatnonzero(labels != np.arange(len(labels)))
        if len(linked):
            yield pa.RecordBatch.from_arrays([pa.array(values[linked]), pa.array(values[labels[linked]])], ["a", "b"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if size + batch.num_rows > rows_at_once and batch.num_rows:
                code, top = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                starts = np.flatnonzero((code[1:] != code[:-1]) | (top[1:] != top[:-1])) + 1
                if len(starts):  # the last group of the batch may go on
                    cut = int(starts[-1])
                    yield from edges(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held, size, batch = [], 0, batch.slice(cut)
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
        if held:
            yield from edges(pa.Table.from_batches(held))

    return run


def _blocks(rows: DataFrame, fixed: int, parts: int) -> tuple[DataFrame, int]:
    """Deal rows (code, perm, fp) whose top ``fixed`` bits agree by ``parts`` blocks of the other
    bits; every block in turn becomes the next bits of ``perm``.  The narrowest block's width is
    fixed for all, so that one number describes the whole level."""
    left = 64 - fixed
    width = left // parts
    keep = (-1 << left) if fixed else 0
    mask = (1 << left) - 1 if fixed else -1
    options = []
    for i in range(parts):
        turn = (left * i) // parts
        low = F.col("perm").bitwiseAND(F.lit(mask).cast("bigint"))
        turned = F.shiftleft(low, turn).bitwiseOR(F.shiftrightunsigned(low, left - turn)) if turn else low
        perm = turned.bitwiseAND(F.lit(mask).cast("bigint")).bitwiseOR(F.col("perm").bitwiseAND(F.lit(keep).cast("bigint")))
        options.append(F.struct((F.col("code") * parts + i).alias("code"), perm.alias("perm"), F.col("fp").alias("fp")))
    dealt = rows.select(F.inline(F.array(*options)))
    fixed += width
    return dealt.select("code", F.shiftrightunsigned("perm", 64 - fixed).alias("top"), "perm", "fp"), fixed


def links(prints: DataFrame, budget: int = BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Spanning edges (a, b) of the graph of distinct fingerprints (column fp) within ``budget``."""
    parts = budget + 1
    rows, fixed = _blocks(prints.select(F.lit(0).cast("bigint").alias("code"), F.col("fp").alias("perm"), "fp"), 0, parts)
    cold, shape = [], "a bigint, b bigint"
    while True:
        hot = rows.groupBy("code", "top").count().where(F.col("count") > group_rows).select("code", "top")
        if 64 - fixed < parts or hot.limit(1).count() == 0:
            cold.append(rows)
            break
        hot = written(hot, "simhash-hot")
        cold.append(rows.join(hot, ["code", "top"], "left_anti"))
        rows, fixed = _blocks(rows.join(hot, ["code", "top"], "left_semi").select("code", "perm", "fp"), fixed, parts)
    out = None
    for level in cold:
        part = level.select("code", "top", "perm", "fp").repartition("code", "top").sortWithinPartitions("code", "top").mapInArrow(_link_groups(budget, group_rows), shape)
        out = part if out is None else out.unionByName(part)
    return out


def near_duplicates(docs: DataFrame, budget: int = BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row (doc_id, fp, fingerprint, component_id) per document.

    component_id is the smallest doc_id reachable over fingerprints that differ in ``budget`` bits
    or fewer.  Null and blank texts have fingerprint zero and link like any other; repeated rows
    give repeated results; a component that has only null ids has a null component_id; an empty
    table gives an empty result; columns other than doc_id and text are ignored.
    """
    prints = written(fingerprints(docs), "simhash-prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(classes.select("fp"), budget, group_rows), "simhash-links")
    of_class = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    # written, so that the join on a root that many texts share is one that can be split
    least = written(of_class.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-least")
    named = of_class.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def majority(hashes: np.ndarray) -> int:
    """Signed SimHash of the 64-bit hashes of a text's shingles: a bit is set if it is in over half of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _HASHES_AT_ONCE):
        some = hashes[at : at + _HASHES_AT_ONCE]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def keep_one(docs: DataFrame, budget: int = BUDGET, threshold: float = overlap.SIMILARITY, bucket_docs: int = overlap.BUCKET_DOCS) -> DataFrame:
    """The documents less their near copies, those whose five-word shingles have a Jaccard similarity of
    ``threshold`` or more: of each component one row stays, the one with the smallest doc_id (null
    last), then hash of the text.

    The trie join of SimHash fingerprints gives groups of candidates, the MinHash bands of ``overlap``
    those that differ in more bits than the budget; in every group the shingle sets are compared exactly.
    A document is a doc_id with a text: rows that share an id, or have none, but differ in text are
    different documents, and each goes or stays on its own; of rows equal in both one stays.  Texts
    without words, null ones included, are copies of each other.  An empty table gives an empty
    result; columns of any name pass unchanged.
    """
    signed = written(overlap.signed(docs, majority), "copies-signed")
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "t")
    classes = written(signed.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.first("keys").alias("keys"), F.first("size").alias("size"), F.first("fp").alias("fp")), "copies-classes")
    groups = components(links(classes.where("keys is not null").select("fp").distinct(), budget), "copies-prints")
    groups = groups.select(F.col("node").alias("fp"), F.xxhash64(F.lit("simhash"), "root").alias("group"))
    keyed = classes.join(groups, "fp", "left")
    keyed = keyed.select("d1", "d2", "size", F.when(F.col("group").isNull(), F.col("keys")).otherwise(F.concat("keys", F.array("group"))).alias("keys"))
    roots = components(overlap.links(docs, written(keyed, "copies-keyed"), threshold, bucket_docs), "copies-links")
    roots = roots.select(F.col("node.d1").alias("d1"), F.col("node.d2").alias("d2"), "root")
    rooted = classes.join(roots, ["d1", "d2"], "left").select("d1", "d2", "first", F.coalesce("root", F.struct("d1", "d2")).alias("root"))
    least = written(rooted.groupBy("root").agg(F.min("first").alias("stay")), "copies-least")
    of_class = rooted.join(least, "root").select("d1", "d2", "stay")
    documents = signed.groupBy("doc_id", "t", "d1", "d2").agg(F.count("*").alias("n"))
    verdicts = documents.join(of_class, ["d1", "d2"]).select("doc_id", "t", place.eqNullSafe(F.col("stay")).alias("stays"), "n")
    return keep_documents(docs, verdicts)
