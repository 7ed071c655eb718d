import hashlib

import xxhash
from pyspark.sql import functions as F

from quarry.llm import ordermin as O


def chained(*values):
    """Spark's xxhash64 over strings and integers (int: 4 bytes, long: 8 bytes), nulls skipped."""
    seed = 42
    for v in values:
        if v is None:
            continue
        data = v.encode() if isinstance(v, str) else (v[0] & (1 << 8 * v[1]) - 1).to_bytes(v[1], "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def brute(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = text.split(" ")
    kmers, seen = [], {}
    for i in range(max(1, len(words) - 2)):
        kmer = chained(*(words[i + k] if i + k < len(words) else None for k in range(3))) >> 28
        nth = seen[kmer] = seen.get(kmer, -1) + 1
        mixed = chained((kmer, 8), (nth, 4))
        kmers.append((mixed % 32, mixed >> 33, i))
    out = []
    for c in range(32):
        two = sorted(kmers, key=lambda k: ((k[0] - c) % 32, *k[1:]))[:2]
        held = sorted(two, key=lambda k: k[2])
        out.append(f"{chained(*((cell << 31 | h, 8) for cell, h, _ in held)) & 0xFFFFFFFF:08x}")
    return out


def like(a, b):
    return sum(x == y for x, y in zip(a, b)) / 32


def check(docs, got):
    rows = sorted(docs, key=lambda r: (r[0] is not None, r[0]))
    texts = [t or "" for _, t in rows]
    for k, (doc_id, _) in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(rows)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = brute(text), brute(edited), brute(after)
        want = (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), like(a, b), like(a, c))
        assert tuple(got[doc_id]) == want


def test_edge_cases(spark):
    rows = [(5, "a b c d e f g"), (None, "x  y\tz \n"), (9, ""), (2, None), (7, "é😀" * 3 + " the same words the same words the same words"), (8, "word " * 300), (10, "a b c d e f g")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, fingerprint double")
    got = {r["doc_id"]: r for r in O.fingerprint_documents(docs).collect()}
    check(rows, got)
    assert got[5]["fingerprint"] == got[10]["fingerprint"]
    assert O.fingerprint_documents(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "d e f g")], "doc_id bigint, text string")
    assert O.fingerprint_documents(twice).count() == 3
    alone = O.fingerprint_documents(spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string")).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in O.fingerprint_documents(docs.repartition(3)).collect()}
    check([tuple(r) for r in docs.collect()], got)
    means = [sum(r[c] for r in got.values()) / len(got) for c in ("near_edited", "near_next")]
    assert means[0] > means[1] + 0.1


def test_order_matters(spark):
    words = [f"w{i}" for i in range(400)]
    shuffled = [x for k in range(0, 400, 20) for x in words[380 - k : 400 - k]]
    rows = spark.createDataFrame([(" ".join(words), " ".join(shuffled))], "a string, b string")
    out = O.with_prints(rows, {"a": "x", "b": "y"}).select(O.likeness(F.col("x"), F.col("y")).alias("l")).first()
    assert out["l"] < 0.2  # nine in ten k-mers are shared, but nearly all pairs have swapped places


def test_short_texts_are_sensitive_to_order(spark):
    """With 18 k-mers too every component is a pair, so that moved words change most of them."""
    words = [f"w{i}" for i in range(20)]
    rows = spark.createDataFrame([(" ".join(words), " ".join(words[10:] + words[:10]), " ".join([*words[:19], "end"]))], "a string, b string, c string")
    out = O.with_prints(rows, {"a": "x", "b": "y", "c": "z"}).select(O.likeness(F.col("x"), F.col("y")).alias("moved"), O.likeness(F.col("x"), F.col("z")).alias("one")).first()
    assert out["moved"] < 0.5 < out["one"]
