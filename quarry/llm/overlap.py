"""Documents whose word shingles overlap: MinHash candidates, exact Jaccard similarity.

Texts are lower-cased (A-Z) and split at ASCII white space; texts of the same words are one class.
The shingles of a class are hashed once and multiplied by ``BANDS x ROWS`` odd numbers; the least
products are its MinHash.  Classes that agree on one band are candidates: at a Jaccard similarity
of 0.8 a pair is missed with odds of (1 - 0.8^4)^16 = 0.02 %.  Inside each bucket the shingle sets are
compared exactly, in the way of the line dedup.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import linededup
from quarry.llm.common import frugal, slices, text_hash

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: Documents of one bucket that one task compares.
BUCKET_DOCS = 1024

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_HASHES_AT_ONCE = 1 << 13
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LOWER).split()


def shingle_hashes(words: list[bytes], width: int = WORDS) -> np.ndarray:
    """64-bit hashes of the word shingles, repeats included; a shorter text is its own."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    each = np.fromiter(map(digest, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out ^ each[k : len(each) - width + 1 + k]) * _MIX
            out ^= out >> np.uint64(29)
    return out


def shingles(words: list[bytes], width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(shingle_hashes(words, width))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def signature(sets: np.ndarray) -> np.ndarray:
    """The band keys of a set of shingles."""
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for at in range(0, len(sets), _HASHES_AT_ONCE):
            least = np.minimum(least, (sets[at : at + _HASHES_AT_ONCE, None] * _FACTORS).min(0))
        keys = np.arange(BANDS, dtype=np.uint64)
        for k in range(ROWS):
            keys = (keys ^ least[k::ROWS]) * _MIX
            keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def signed(docs: DataFrame, fingerprint) -> DataFrame:
    """doc_id, t (hash of the text), d1, d2 (of its words), keys, size (bytes of its shingles) and fp: ``fingerprint`` of the hashes of its
    shingles.  A text without words has no keys."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, linededup.TEXT_AT_ONCE):
                words = [words_of(t) for t in part.column(1).to_pylist()]
                names, keys, sizes, prints = _names(words), [], [], []
                for w in words:
                    hashes = shingle_hashes(w)
                    distinct = np.unique(hashes)
                    keys.append(signature(distinct) if w else None)
                    sizes.append(8 * len(distinct))
                    prints.append(fingerprint(hashes))
                columns = [part.column(0), part.column(2), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "d1", "d2", "keys", "size", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"), text_hash().alias("t"))
    return texts.mapInArrow(frugal(run), f"doc_id {kind}, t bigint, d1 bigint, d2 bigint, keys array<bigint>, size bigint, fp bigint")


def _names(words: list[list[bytes]]) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(w)) for w in words), "<i8").reshape(-1, 2)


def _fetch(held):
    """Documents -> (d1, d2, line) of those whose bit is set in a bitmap; line: their shingles."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, linededup.TEXT_AT_ONCE):
                words = [words_of(t) for t in part.column(1).to_pylist()]
                names = _names(words)
                hit = np.flatnonzero(linededup.marked(names[:, 0], held.value))
                yield pa.RecordBatch.from_arrays([pa.array(names[hit, 0]), pa.array(names[hit, 1]), pa.array([shingles(words[k]).tobytes() for k in hit], pa.binary())], ["d1", "d2", "line"])

    return run


def stored_sets(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(lines), np.uint64), np.fromiter((len(x) // 8 for x in lines), np.int64, len(lines))


def links(docs: DataFrame, classes: DataFrame, threshold: float = SIMILARITY, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """(a, b) structs of 128-bit text hashes: verified links between different texts that share one of
    their keys."""
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return linededup.set_links(texts, classes, _fetch, "binary", linededup._compare(threshold, stored_sets, 1 << 21), bucket_docs)
