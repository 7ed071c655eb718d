"""Mixing and resampling against plain Python, with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing, resampling
from quarry.llm.common import numbered

# --- mixing --------------------------------------------------------------------------------


def plain_targets(sizes, weights, cap=3.0, budget=1.0):
    """Share by weight; what is above a cap is shared again by weight among the others."""
    total, fixed = budget * sum(sizes.values()), {s: 0.0 for s in sizes if not weights.get(s)}
    open_ = {s for s in sizes if s not in fixed}
    while open_:
        level = (total - sum(fixed.values())) / sum(weights[s] for s in open_)
        above = {s for s in open_ if level * weights[s] > cap * sizes[s]}
        if not above:
            return fixed | {s: level * weights[s] for s in open_}
        fixed |= {s: cap * sizes[s] for s in above}
        open_ -= above
    return fixed


def plain_copies(doc_id, text, rate, seed="mix"):
    key = f"{seed}:{'null' if doc_id is None else doc_id}:{text or ''}"
    u = int(hashlib.sha256(key.encode()).hexdigest()[:13], 16) / 2**52
    return math.floor(rate) + (u < rate - math.floor(rate))


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def by_rank(sources, cycle=(1, 2, 3)):
    ordered = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    return {s: float(cycle[i % len(cycle)]) for i, s in enumerate(ordered)}


def odd_documents():
    rng = random.Random(11)
    rows = [(1, None, "a"), (2, "", "a"), (2, " \t\n", None), (None, "x y z", None), (None, "x y z", None), (3, "é ü ß one", "é"), (4, "w " * 30_000, "long"), (4, "w " * 30_000, "long")]
    for n in range(400):  # one source holds a third
        rows.append((10 + n, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(1, 60))), "hot" if n % 3 == 0 else f"s{n % 17}"))
    return rows


def test_targets_and_copies(spark):
    rows = odd_documents()
    docs = spark.createDataFrame([(*r, "own size", 1.5, 7) for r in rows], "doc_id bigint, text string, source string, size string, target double, copies int")
    got = mixing.mix(docs)
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += size_of(text)
    weights = by_rank(sizes)
    targets = plain_targets(sizes, weights)
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    assert any(targets[s] == 3.0 * sizes[s] for s in sizes) and any(0 < targets[s] < 3.0 * sizes[s] for s in sizes)
    want = collections.Counter()
    for doc_id, text, source in rows:
        rate = min(3.0, targets[source] / sizes[source]) if sizes[source] else 0.0
        want[doc_id, source, size_of(text), plain_copies(doc_id, text, rate)] += 1
    found = got.select("row.doc_id", "row.source", got["size"], got["copies"], got["target"]).collect()
    assert collections.Counter(tuple(r)[:4] for r in found) == want
    for r in found:
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["copies"] <= 3
    again = mixing.mix(docs.repartition(7)).select("row.doc_id", "copies").collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter((r["doc_id"], r["copies"]) for r in found)
    mixed = mixing.emit(got)
    assert mixed.columns == docs.columns
    emitted = collections.Counter((r["doc_id"], r["source"]) for r in mixed.collect())
    planned = collections.Counter()
    for r in found:
        planned[r["doc_id"], r["source"]] += r["copies"]
    assert emitted == +planned


def test_taken_words_come_near_targets(spark, sf_dir):
    planned = mixing.mix(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    sums = planned.groupBy("row.source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert len(sums) == 20
    for r in sums:
        assert r["taken"] == pytest.approx(r["target"], rel=0.15)


def test_given_weights_budget_and_cap(spark):
    docs = spark.createDataFrame([(i, "a b c d", s) for i, s in enumerate(["x"] * 50 + ["y"] * 40 + ["z"] * 10 + ["u"] * 5 + ["v"] * 5)], "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([("x", 1.0), ("y", 4.0), ("z", 4.0), ("u", float("nan")), ("v", -1.0), ("unknown", 9.0)], "source string, weight double")
    sizes = {"x": 200, "y": 160, "z": 40, "u": 20, "v": 20}
    sources = mixing.source_sizes(docs)
    for cap, budget in ((3.0, 1.0), (1.0, 0.5), (2.0, 10.0)):
        got = {r["source"]: r["target"] for r in mixing.source_targets(sources, weights, cap, budget).collect()}
        want = plain_targets(sizes, {"x": 1.0, "y": 4.0, "z": 4.0}, cap, budget)
        assert got == pytest.approx(want)


def test_many_sources_are_joined_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame(odd_documents(), "doc_id bigint, text string, source string")
    wide = sorted(map(str, mixing.mix(docs).select("row.doc_id", "size", "target", "copies").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 10)
    monkeypatch.setattr(mixing, "HEAVY", 5)
    planned = mixing.mix(docs).select("row.doc_id", "size", "target", "copies")
    assert "SortMergeJoin" in planned._jdf.queryExecution().toString()
    assert sorted(map(str, planned.collect())) == wide


def test_empty_mix(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mix(docs).collect() == [] and mixing.emit(mixing.mix(docs)).collect() == []
    blank = spark.createDataFrame([(1, None, None), (None, " ", "s")], "doc_id bigint, text string, source string")
    assert [(r["size"], r["target"], r["copies"]) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(None if i % 3 == 0 else i % 5,) for i in range(200)], "k int")
    got = numbered(rows, [F.asc_nulls_last("k")], "test").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 201))
    assert [r["k"] for r in got] == sorted((r["k"] for r in rows.collect()), key=lambda k: (k is None, k or 0))


# --- resampling ----------------------------------------------------------------------------


def plain_features(text, longest, buckets):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    grams = [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g) % buckets for g in grams]


def plain_resample(docs, target, longest=1, buckets=10_000, least=20, percent=10, seed="2024"):
    made = [(d, *plain_features(t, longest, buckets)) for d, t in docs]
    s = collections.Counter(b for _, _, f in made for b in f)
    t = collections.Counter(b for x in target for b in plain_features(x, longest, buckets)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for d, words, f in made:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    part = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[2]))
    drawn = len(part) * percent // 100
    ranks = [(r[0], r[2], r[3], r[4], i + 1 if i < drawn else None) for i, r in enumerate(part)]
    return collections.Counter([*ranks, *((r[0], r[2], r[3], r[4], None) for r in rows if r[1] < least)])


def odd_texts():
    rng = random.Random(12)
    vocabulary = ["Alpha", "BETA", "gamma-ray", "délta", "ΣΊΓΜΑ", "x1", "naïve", "日本語", "é", "_", "o'clock"] + [f"w{i}" for i in range(300)]
    rows = [(None, None), (1, ""), (2, "-- ..\x00\x7f"), (3, "   "), (4, "Long " * 250_000), (5, "a b " * 20), (5, "a b " * 20), (5, "a b c " * 20), (None, "a b " * 20), (None, "a b " * 20)]
    return rows + [(10 + n, " ".join(rng.choices(vocabulary, k=rng.randint(0, 80)))) for n in range(500)]


@pytest.mark.parametrize("longest,buckets,percent", [(1, 10_000, 10), (3, 65_536, 35)])
def test_resample_against_plain_python(spark, longest, buckets, percent):
    rows = odd_texts()
    target = ["alpha beta w1 w2 w3", None, "", "日本語 naïve w4", "alpha x1"]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, rank string, weight int").repartition(5)
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = resampling.resample(docs, bench, longest, buckets, percent=percent)
    found = collections.Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert found == plain_resample(rows, target, longest, buckets, percent=percent)


def test_drawn_documents_look_like_the_target(spark):
    rng = random.Random(5)
    near, far = [f"n{i}" for i in range(50)], [f"f{i}" for i in range(500)]
    texts = [(n, " ".join(rng.choices(near if n % 10 == 0 else far, k=40))) for n in range(1000)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    target = spark.createDataFrame([(" ".join(rng.choices(near, k=40)),) for _ in range(50)], "text string")
    ranked = resampling.resample(docs, target)
    chosen = resampling.drawn(docs, ranked)
    assert chosen.columns == docs.columns
    ids = [r["doc_id"] for r in chosen.collect()]
    # one in ten is near; a near one weighs about exp(3.6) times as much, which makes 3,600 of 4,500 in the first draw
    assert len(ids) == 100 and 60 <= sum(i % 10 == 0 for i in ids) <= 90
    assert ranked.where("rank is not null").agg(F.max("rank")).first()[0] == 100


def test_empty_tables(spark):
    docs, target = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "text string")
    assert resampling.resample(docs, target).collect() == []
    some = spark.createDataFrame([(1, "a " * 30), (2, "b c")], "doc_id bigint, text string")
    got = resampling.resample(some, target, percent=100).collect()
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got) == plain_resample([(1, "a " * 30), (2, "b c")], [], percent=100)


def test_ids_of_any_kind(spark):
    docs = spark.createDataFrame([("a", "w " * 25), ("b", None)], "doc_id string, text string")
    got = {r["doc_id"]: r["n_features"] for r in resampling.resample(docs, docs.select("text")).collect()}
    assert got == {"a": 25, "b": 0}


def test_buckets_fit_sixteen_bits(spark):
    with pytest.raises(ValueError):
        resampling.streams(spark.createDataFrame([], "text string"), [], 1, 70_000)


def test_runs_of_words_are_joined_by_one_space():
    words = [b"a", b"bc", b"d"]
    want = [zlib.crc32(x) % 997 for x in (b"a", b"bc", b"d", b"a bc", b"bc d", b"a bc d")]
    assert resampling.buckets_of(words, 5, 997).tolist() == want
    assert resampling.buckets_of([], 2, 997).dtype == np.dtype("<u2")
