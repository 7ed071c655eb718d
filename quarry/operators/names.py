"""Names that match closely: every name of a type against every other, in blocks.

A block holds names of one type and one length, some thousands at most; a pair of blocks is a row and is
compared in one task with a matrix product, so that no task grows with a type.  Blocks whose lengths
differ too much for the threshold never meet."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.shared import written

#: Names of a block: an eighth of those of its type and length, within these bounds.
BLOCK = (256, 4096)
#: From this length on difflib leaves out frequent characters, so such names are left to itself.
LONG_NAME = 200
#: Pairs compared at once, and the fewest worth it.
BATCH, FEW = 16384, 24


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in a, start in b and size of the longest common block of each column of a and b (one string a
    column), the first in a, then in b, as difflib has it."""
    # a cell holds (size << 8) + 255 - j for the block that ends at j, so the greatest is the longest, then first
    none = (255 - np.arange(len(b))).astype(np.uint16)[:, None]
    cells = np.repeat(none, b.shape[1], axis=1)
    grown = np.empty_like(cells)
    best, end = np.zeros(b.shape[1], np.uint16), np.zeros(b.shape[1], np.int32)
    for i in range(len(a)):
        np.add(cells[:-1], 255, out=grown[1:])
        grown[0] = 511
        cells = np.where(a[i] == b, grown, none)
        top = cells.max(axis=0)
        better = (top >> 8) > (best >> 8)
        best, end = np.where(better, top, best), np.where(better, i, end)
    size = (best >> 8).astype(np.int32)
    return end - size + 1, 256 - (best & 255).astype(np.int32) - size, size


def matched(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matching characters of each column of a and b: the longest common block, then what matches before
    and behind it, and so on.  Columns that split alike go on together, a few of them by difflib."""
    total = np.zeros(a.shape[1], np.int32)
    work = [(a, b, np.arange(a.shape[1]))]
    while work:
        a, b, who = work.pop()
        if len(who) < FEW:
            for n, column in enumerate(who):
                blocks = difflib.SequenceMatcher(None, a[:, n].tolist(), b[:, n].tolist(), autojunk=False).get_matching_blocks()
                total[column] += sum(block.size for block in blocks)
            continue
        i, j, size = _longest(a, b)
        total[who] += size
        split = (i << 16) + (j << 8) + size
        order = np.argsort(split, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(split[order])) + 1):
            at, to, n = int(i[group[0]]), int(j[group[0]]), int(size[group[0]])
            if n and at and to:
                work.append((a[:at, group], b[:to, group], who[group]))
            if n and at + n < len(a) and to + n < len(b):
                work.append((a[at + n:, group], b[to + n:, group], who[group]))
    return total


def _stands_out(head: tuple[int, ...], rest: int) -> bool:
    """Whether two names that begin with ``head``, and have ``rest`` characters after it at most, have their longest
    common block at the start of both: a longer one elsewhere would repeat the head's end after 1 to ``rest`` places."""
    return rest <= len(head) and not any(head[start:-by] == head[start + by:] for by in range(1, rest + 1) for start in range(rest - by + 1) if start + by < len(head))


def _matched_from_start(a: np.ndarray, b: np.ndarray, sure: np.ndarray, half: int) -> np.ndarray:
    """As ``matched``; where the first ``half`` characters are equal and ``sure`` to be in the longest block,
    only what stands behind the common start is searched."""
    start = np.logical_and.accumulate(a[: len(b)] == b[: len(a)], axis=0).sum(axis=0)
    known = sure & (start >= half)
    total = np.zeros(a.shape[1], np.int32)
    if not known.all():
        total[~known] = matched(a[:, ~known], b[:, ~known])
    for n in np.unique(start[known]):
        at = np.flatnonzero(known & (start == n))
        total[at] = n + (matched(a[n:, at], b[n:, at]) if n < min(len(a), len(b)) else 0)
    return total


def _codes(names: list[str]) -> np.ndarray:
    """One row of code points for each name, all of one length."""
    return np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(names), -1)


def _shared(a: np.ndarray, b: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 0 and 1 whose products count the characters that two names share, repeats included."""
    counts = [np.stack([(x == c).sum(axis=1) for c in range(kinds)], axis=1) for x in (a, b)]
    most = np.minimum(counts[0].max(axis=0), counts[1].max(axis=0))
    return tuple(np.concatenate([(n[:, most >= r] >= r) for r in range(1, int(most.max(initial=0)) + 1)] or [np.zeros((len(n), 1))], axis=1).astype(np.float32) for n in counts)


def _links(a_keys: list[str], a_names: list[str], b_keys: list[str], b_names: list[str], same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, ratio) of the pairs of two blocks that match, batch by batch; of one block with
    itself each pair once.  The name of the lesser key goes first; equal keys don't meet."""
    la, lb = len(a_names[0]), len(b_names[0])
    least = next((m for m in range(min(la, lb) + 1) if 2.0 * m / (la + lb) >= threshold), None)
    if least is None:
        return
    kinds, codes = np.unique(np.concatenate([_codes(a_names).ravel(), _codes(b_names).ravel()]), return_inverse=True)
    codes = codes.astype(np.uint8 if len(kinds) <= 256 else np.uint32)
    a, b = codes[: la * len(a_names)].reshape(-1, la), codes[la * len(a_names):].reshape(-1, lb)
    flags_a, flags_b = _shared(a, b, len(kinds))
    half = (max(la, lb) + 1) // 2
    heads = np.unique(a[:, :half], axis=0, return_inverse=True)
    sure = np.array([_stands_out(tuple(head), max(la, lb) - half) for head in heads[0].tolist()])[heads[1].ravel()]
    place = {key: n for n, key in enumerate(sorted({*a_keys, *b_keys}))}
    rank_a, rank_b = np.array([place[k] for k in a_keys]), np.array([place[k] for k in b_keys])
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for start in range(0, len(a_names), 256):
        near = flags_a[start : start + 256] @ flags_b.T >= least - 0.5
        near &= (rank_a[start : start + 256, None] < rank_b) if same else (rank_a[start : start + 256, None] != rank_b)
        rows, columns = np.nonzero(near)
        rows += start
        ahead = rank_a[rows] < rank_b[columns]
        for first in (True, False):
            x, y = rows[ahead == first], columns[ahead == first]
            for at in range(0, len(x), BATCH):
                r, c = x[at : at + BATCH], y[at : at + BATCH]
                if max(la, lb) >= LONG_NAME:
                    pairs = ((a_names[i], b_names[j]) if first else (b_names[j], a_names[i]) for i, j in zip(r, c, strict=True))
                    ratio = np.array([difflib.SequenceMatcher(None, *pair).ratio() for pair in pairs])
                else:
                    ratio = 2.0 * _matched_from_start(*((a[:, r], b[:, c]) if first else (b[:, c], a[:, r])), sure[r], half) / (la + lb)
                found = ratio >= threshold
                if found.any():
                    yield r[found], c[found], ratio[found]


def _block_pairs(entities: DataFrame, threshold: float) -> DataFrame:
    """(type, same, a_keys, a_names, b_keys, b_names): one row for each two blocks that may hold a match."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    names = entities.select("entity_key", F.lower("name").alias("low"), "type").where("type is not null and low <> ''").distinct()
    names = written(names.withColumn("size", F.length("low")), "names")
    least, most = BLOCK
    parts = names.groupBy("type", "size").agg(F.count("*").alias("n"))
    parts = parts.select("type", "size", F.ceil(F.col("n") / F.least(F.greatest(F.col("n") / 8, F.lit(least)), F.lit(most))).alias("parts"))
    placed = names.join(F.broadcast(parts), ["type", "size"]).withColumn("part", F.pmod(F.xxhash64("entity_key", "low"), F.col("parts")))
    blocks = placed.groupBy("type", "size", "part").agg(F.collect_list(F.struct("entity_key", "low")).alias("rows"))  # of bounded size
    blocks = written(blocks.select("type", F.struct("size", "part").alias("block"), F.col("rows.entity_key").alias("keys"), F.col("rows.low").alias("names")), "name-blocks")
    ids = blocks.select("type", "block")
    a, b = F.col("a_block.size"), F.col("b_block.size")
    pairs = ids.withColumnRenamed("block", "a_block").join(ids.withColumnRenamed("block", "b_block"), "type")
    pairs = written(pairs.where((F.col("a_block") <= F.col("b_block")) & (2 * F.least(a, b) >= F.lit(threshold) * (a + b) - 1e-9)), "block-pairs")
    side = lambda s: blocks.select("type", F.col("block").alias(f"{s}_block"), F.col("keys").alias(f"{s}_keys"), F.col("names").alias(f"{s}_names"))
    whole = pairs.join(side("a"), ["type", "a_block"]).join(side("b"), ["type", "b_block"])
    # a row is much work, so each is a task's; a count of tasks that is asked for stays
    return whole.select("type", (F.col("a_block") == F.col("b_block")).alias("same"), "a_keys", "a_names", "b_keys", "b_names").repartition(max(1, min(pairs.count(), 20_000)))


def _over(pairs: DataFrame, make: Callable, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield from make(row.type, *(list(x) for x in (row.a_keys, row.a_names, row.b_keys, row.b_names)), row.same)

    return pairs.mapInPandas(run, schema)


def similar_names(entities: DataFrame, threshold: float) -> DataFrame:
    """(a_key, b_key, type, ratio): pairs of one type whose lower-cased names match by at least
    ``threshold`` (twice the matching characters over all, longest common blocks first)."""

    def pairs(kind, a_keys, a_names, b_keys, b_names, same):
        a, b = np.array(a_keys, object), np.array(b_keys, object)
        for rows, columns, ratio in _links(a_keys, a_names, b_keys, b_names, same, threshold):
            x, y = a[rows], b[columns]
            first = x < y
            yield pd.DataFrame({"a_key": np.where(first, x, y), "b_key": np.where(first, y, x), "type": kind, "ratio": ratio})

    found = _over(_block_pairs(entities, threshold), pairs, "a_key string, b_key string, type string, ratio double")
    return found.withColumn("ratio", F.round("ratio", 6))


def _roots(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The component's number of each row and each column of a matrix of links."""
    rows, columns = np.full(linked.shape[0], -1), np.full(linked.shape[1], -1)
    for n in np.flatnonzero(linked.any(axis=1)):
        if rows[n] >= 0:
            continue
        rows[n], fresh = n, np.array([n])
        while len(fresh):
            reached = np.flatnonzero(linked[fresh].any(axis=0) & (columns < 0))
            columns[reached] = n
            fresh = np.flatnonzero(linked[:, reached].any(axis=1) & (rows < 0))
            rows[fresh] = n
    return rows, columns


def similar_classes(entities: DataFrame, threshold: float) -> DataFrame:
    """(entity_key, type, class_id, n_links), one row for each entity with a type: how many names its own matches as
    in ``similar_names``, and the least key of those that it is linked with over any number of links.  Links are
    counted where they are found and never leave their task, so what is written grows with names and blocks."""

    def counts(kind, a_keys, a_names, b_keys, b_names, same):
        linked = np.zeros((len(a_keys), len(b_keys)), bool)
        for rows, columns, _ in _links(a_keys, a_names, b_keys, b_names, same, threshold):
            linked[rows, columns] = True
            if same:
                linked[columns, rows] = True
        roots = _roots(linked)
        sides = [(a_keys, roots[0], linked.sum(axis=1))] + ([] if same else [(b_keys, roots[1], linked.sum(axis=0))])
        for keys, root, n in sides:
            at = np.flatnonzero(n)
            if len(at):
                yield pd.DataFrame({"entity_key": [keys[x] for x in at], "type": kind, "root": [a_keys[root[x]] for x in at], "n": n[at]})

    found = written(_over(_block_pairs(entities, threshold), counts, "entity_key string, type string, root string, n bigint"), "name-links")
    classes = _components(found.select("type", F.col("entity_key").alias("a"), F.col("root").alias("b")).where("a <> b"))
    links = found.groupBy("type", "entity_key").agg(F.sum("n").alias("n_links"))
    keys = entities.where("type is not null and name <> ''").select("entity_key", "type").distinct()
    rows = keys.join(links, ["type", "entity_key"], "left").join(classes, ["type", "entity_key"], "left")
    return rows.select("entity_key", "type", F.coalesce("class_id", "entity_key").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def _components(edges: DataFrame) -> DataFrame:
    """(type, entity_key, class_id) of the ends of edges(type, a, b): the least key of each one's component.  Every node
    hangs on its least neighbour, these trees are flattened to their roots, and the roots' edges go on."""
    labels = None
    while True:
        ends = edges.select("type", F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select("type", F.col("b").alias("node"), F.col("a").alias("to")))
        tree = written(ends.groupBy("type", "node").agg(F.least(F.min("to"), F.col("node")).alias("root")), "trees")
        while True:
            up = tree.select("type", F.col("node").alias("root"), F.col("root").alias("above"))
            higher = written(tree.join(up, ["type", "root"]).select("type", "node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "trees")
            tree = higher.select("type", "node", "root")
            if not higher.where("moved").limit(1).count():
                break
        if labels is None:
            labels = tree
        else:
            over = tree.select("type", F.col("node").alias("root"), F.col("root").alias("above"))
            labels = written(labels.join(over, ["type", "root"], "left").select("type", "node", F.coalesce("above", "root").alias("root")), "classes")
        end = lambda side: tree.select("type", F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        edges = edges.join(end("a"), ["type", "a"]).join(end("b"), ["type", "b"]).where("a_root <> b_root").select("type", F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct()
        edges = written(edges, "root-edges")
        if not edges.limit(1).count():
            return labels.select("type", F.col("node").alias("entity_key"), F.col("root").alias("class_id"))
