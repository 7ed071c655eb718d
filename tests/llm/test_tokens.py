import base64
import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import bpe, packing

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = st.text(st.sampled_from("abcdething the.,'\n\t  sré中文字한ß😀0129!?-_=()<|>ÀİΣ́\x1c ") | st.characters(exclude_categories=["Cs"]), max_size=120)


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_bpe_equals_library(text):
    global _TIK
    ours = bpe.load(RANKS, public_tokenizers.PATTERN)
    try:
        tik = _TIK
    except NameError:
        with open(RANKS, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        tik = _TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = ours.encode(text)
    assert ids == tik.encode_ordinary(text)
    assert ours.decode(ids) == text.encode()


def test_bpe_long_pieces(tik):
    ours = bpe.load(RANKS, public_tokenizers.PATTERN)
    for text in ("a" * 20_000, "ab" * 5_000, " " * 9_999, "\n" * 500 + "x", "theing" * 3_000):
        assert ours.encode(text) == tik.encode_ordinary(text)


def test_bpe_documents(spark, sf_dir, tik):
    rows = spark.createDataFrame([(1, "Hello the world", 5), (1, "Hello the world", 5), (None, None, 1), (3, "", 0)], "doc_id bigint, text string, ids int")
    got = sorted((r["doc_id"] or 0, r["ids"], bytes(r["decoded"])) for r in bpe.encode_documents(rows, RANKS, public_tokenizers.PATTERN).collect())
    want = tik.encode_ordinary("Hello the world")
    assert got == [(0, [], b""), (1, want, b"Hello the world"), (1, want, b"Hello the world"), (3, [], b"")]
    assert bpe.encode_documents(rows.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_word_ids_equal_library(texts):
    ours = packing.load(WORDS).ids([t.encode() for t in texts])
    reference = Tokenizer.from_file(WORDS)
    assert [np.frombuffer(x, "<u4").tolist() for x in ours] == [reference.encode(t, add_special_tokens=False).ids for t in texts]


def check_packing(rows, lengths_of):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return bins


def test_pack_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack_documents(docs, WORDS).collect()
    bins = check_packing(rows, None)
    reference = Tokenizer.from_file(WORDS)
    ids = {r["doc_id"]: reference.encode(r["text"], add_special_tokens=False).ids + [0] for r in docs.collect()}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + packing.CAPACITY]
        assert (r["start"], r["length"]) == (r["piece"] * packing.CAPACITY, len(part))
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    assert len(bins) <= -(-sum(map(len, ids.values())) // packing.CAPACITY) + 1


def test_pack_edge_cases(spark):
    docs = spark.createDataFrame([(None, None, 1), (2, "", 2), (2, "", 2), (3, "word " * 5_000, 3)], "doc_id bigint, text string, piece int")
    rows = packing.pack_documents(docs, WORDS, group_pieces=2).collect()
    check_packing(rows, None)
    assert sorted(r["length"] for r in rows) == [1, 1, 1, 905, 2048, 2048]
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=40))
def test_pack_is_sound(lengths):
    bins = packing.pack(lengths, 60)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 60 for b in bins)
    assert len(bins) >= -(-sum(lengths) // 60)


def fewest(lengths, capacity):
    """The optimum by branch and bound."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[k] <= capacity and bins[b] not in bins[:b]:
                place(k + 1, [*bins[:b], bins[b] + lengths[k], *bins[b + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best


def test_pack_against_the_optimum():
    """On small random cases the search finds the fewest bins nearly always, and never misses by two."""
    rng = random.Random(1)
    over = []
    for _ in range(150):
        lengths = [rng.randint(5, 60) for _ in range(12)]
        over.append(len(packing.pack(lengths, 60)) - fewest(lengths, 60))
    assert min(over) >= 0 and max(over) <= 1 and sum(over) <= 15


def test_search_empties_bins_of_real_lengths(spark):
    """On the lengths of real documents the search makes moves and exchanges of each kind and reaches the bound."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pieces(docs, WORDS).select("length", "ids_crc32").collect()
    lengths = [r["length"] for r in sorted(rows, key=lambda r: r["ids_crc32"])]
    done = collections.Counter()
    bins = packing.pack(lengths, done=done)
    assert done["emptied"] > 0 and done["move"] > 0 and done["one for one"] + done["two for one"] > 0, done
    assert len(bins) <= -(-sum(lengths) // packing.CAPACITY) + 1


def test_local_search_empties_bins():
    bins = packing.Bins([6, 6, 4, 4, 5, 5, 4, 6], 10)
    for members in ([0], [1], [2, 3], [4], [5], [6], [7]):
        at = bins.open()
        for i in members:
            bins.add(at, i)
    packing._search(bins, 4, collections.Counter())
    assert sum(map(bool, bins.members)) == 4


def test_packing_of_all_given_documents_reaches_the_bound(spark):
    """All pieces of sf0.1 in one group: the least number of sequences, which sorting by length reaches too."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8)
    rows = packing.pieces(docs, WORDS).select("ids_crc32", "doc_id", "piece", "length").collect()
    lengths = [r["length"] for r in sorted(rows)]
    done = collections.Counter()
    packed = packing.pack(lengths, done=done)
    assert sorted(x for m in packed for x in m) == list(range(len(lengths)))
    assert len(packed) == -(-sum(lengths) // packing.CAPACITY)
    assert min(done["move"], done["one for one"], done["two for one"], done["emptied"]) > 0


def test_second_start_is_no_worse_than_sorting():
    """Lengths on which a search from the given order ends above what best fit of the longest first gives."""
    rng = random.Random(9)
    for _ in range(60):
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(1, 60))]
        bins: list[int] = []
        for length in sorted(lengths, reverse=True):
            fits = [k for k, room in enumerate(bins) if room >= length]
            if fits:
                bins[min(fits, key=lambda k: bins[k])] -= length
            else:
                bins.append(64 - length)
        assert len(packing.pack(lengths, 64)) <= len(bins)
