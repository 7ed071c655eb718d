import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quarry.llm import simhash as S


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\r\x0b\x0c":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, budget=4):
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if bin(items[i] ^ items[j]).count("1") <= budget:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(items))]


def planted(rng, clusters, size, flips):
    out = []
    for _ in range(clusters):
        base = rng.getrandbits(64)
        for _ in range(size):
            x = base
            for _ in range(rng.randint(0, flips)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return out


def test_simhash_matches_definition():
    texts = ["", " \t\n", "One", "a b c d", "A B c D e\x0bf g  h", "ÀB é " * 30, None]
    for t in texts:
        assert S.simhash(None if t is None else t.encode()) == brute_print(t)


def test_trie_join_finds_all_links():
    rng = random.Random(5)
    values = np.array(sorted(set(planted(rng, 40, 12, 5) + [rng.getrandbits(64) for _ in range(300)])), np.uint64)
    got = S.trie_links(values, np.array([0, len(values)]), np.arange(len(values)))
    assert got.tolist() == brute_components([int(v) for v in values])


def test_components_over_blocks_and_hot_groups(spark):
    rng = random.Random(9)
    values = planted(rng, 25, 10, 4) + [rng.getrandbits(40) << 24 for _ in range(300)]
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in set(signed)], "fp bigint")
    from quarry.llm.common import components

    for rows in (1 << 14, 40):  # the second deals hot groups anew
        found = {r["node"]: r["root"] for r in components(S.links(prints, group_rows=rows)).collect()}
        roots = brute_components(values)
        groups = {}
        for v, r in zip(signed, roots):
            groups.setdefault(r, set()).add(found.get(v, v))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(3, "a b c d e", 1), (1, "A B C D E", 2), (1, "A B C D E", 2), (None, "a b c d e", 3), (7, None, 4), (5, "", 5), (9, "x " * 50_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    got = {(r["doc_id"], r["component_id"]) for r in S.near_duplicates(docs).collect()}
    assert got == {(3, 1), (1, 1), (None, 1), (7, 5), (5, 5), (9, 9)}
    kept = sorted((r["doc_id"] or 0, r["fp"]) for r in S.keep_one(docs).collect())
    assert kept == [(1, 2), (5, 5), (9, 6)]  # one row of each component; named ones come first
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_loses_no_unlike_text(spark):
    """Rows that share an id or have none are documents of their own."""
    one, two, three = ("".join(f"{c}{k} " for k in range(30)) for c in "abc")
    rows = [(5, one, 1), (5, two, 2), (6, two, 3), (None, three, 4), (None, one, 5), (None, three + "more", 6), (None, three, 7), (8, "short", 8), (8, "short", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `row` int")
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    third = [x for x in got if x[0] is None]
    assert len(third) == 1 and third[0][1] in (three, three + "more")
    assert sorted(x for x in got if x[0] is not None) == [(5, one), (5, two), (8, "short")]
    assert S.keep_one(docs.limit(0)).count() == 0


def test_trie_groups_are_joined_in_parts(spark):
    """A task joins a few groups at a time; the links are those of all at once."""
    import pyarrow as pa

    rng = random.Random(3)
    rows = [(g, 0, v, v) for g in range(30) for v in set(np.array(planted(rng, 4, 4, 3), np.uint64).view(np.int64).tolist())]
    names = ["code", "top", "perm", "fp"]
    table = pa.table([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names)
    found = [{tuple(x.values()) for b in S._link_groups(4, size)(table.to_batches(max_chunksize=7)) for x in b.to_pylist()} for size in (1 << 18, 20)]
    assert found[0] == found[1] and found[0]


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    prints = [brute_print(r["text"]) for r in rows]
    roots = brute_components(prints)
    want = {(r["doc_id"], f"{p:016x}", rows[k]["doc_id"]) for r, p, k in zip(rows, prints, roots)}
    got = {tuple(r) for r in S.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()}
    assert got == want
