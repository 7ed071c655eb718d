"""Document fingerprints by Order MinHash, in built-in functions only.

A text's k-mers are its runs of ``KMER`` words (split at single white-space characters, so extra
spaces count; fewer words: one k-mer).  A k-mer that occurs again is numbered, so repeats differ.
The hash of a numbered k-mer deals it to one of ``COMPONENTS`` cells and ranks it there.  Component
i has an order of its own over all k-mers: first those of cell i by rank, then those of cell i + 1,
and so on around.  Its two minimal k-mers, put back in text order, are hashed together (Marçais et
al., 2019).  So each k-mer is hashed once (one-permutation hashing, with empty cells filled from the
next), a long text fills a component from its own cell, and a text of two k-mers has full tuples
too.  Texts with the same words in another order, far apart in edit distance, share k-mers but not
tuples.  The likeness of two fingerprints is the share of equal components.

All this happens inside one row: k-mers and cells are packed into 64-bit words, whose arrays are
sorted as primitive longs, so the cost is linear but for the sort and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import release, written

KMER = 3
COMPONENTS = 32
#: A packed word: number of the cell, hash, place in the text (5 + 31 + 27 bits); k-mers are known by 36
#: bits, and words beyond the 2^27th share the last place.
CELL_BITS, PLACE_BITS = 5, 27
_CELL_SHIFT = 63 - CELL_BITS


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _kmer(x: Column) -> Column:
    return F.shiftrightunsigned(x, PLACE_BITS)


def _place(x: Column) -> Column:
    return x.bitwiseAND(_long((1 << PLACE_BITS) - 1))


def _cell(x: Column) -> Column:
    return F.shiftright(x, _CELL_SHIFT)


def _numbered(x: Column, nth: Column) -> Column:
    """Packed cell, hash and place of a packed k-mer's nth occurrence."""
    mixed = F.xxhash64(_kmer(x), nth)
    cell = F.shiftleft(mixed.bitwiseAND(_long(COMPONENTS - 1)), _CELL_SHIFT)
    order = F.shiftleft(F.shiftrightunsigned(mixed, 64 - (_CELL_SHIFT - PLACE_BITS)), PLACE_BITS)
    return cell.bitwiseOR(order).bitwiseOR(_place(x))


def with_prints(rows: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Add for each text column (null counts as empty) the column named beside it: array<bigint> of
    the components, number in the high and hash in the low 32 bits."""
    step = rows
    for text, name in texts.items():
        step = step.withColumn(f"{name}_w", F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "), " "))
    for name in texts.values():
        step = step.withColumn(f"{name}_s", F.sort_array(_kmers(F.col(f"{name}_w"))))
    step = step.drop(*(f"{name}_w" for name in texts.values()))
    for name in texts.values():
        step = step.withColumn(f"{name}_r", _repeated(F.col(f"{name}_s")))
    for name in texts.values():
        s, r = F.col(f"{name}_s"), F.col(f"{name}_r")
        once = F.transform(s, lambda x: _numbered(x, F.lit(0)))
        step = step.withColumn(f"{name}_v", F.sort_array(F.when(F.size(r) == 0, once).otherwise(_with_numbers(s, r))))
    step = step.drop(*(f"{name}_{c}" for name in texts.values() for c in "sr"))
    for name in texts.values():
        step = step.withColumn(f"{name}_m", _minimal(F.col(f"{name}_v")))
    step = step.drop(*(f"{name}_v" for name in texts.values()))
    for name in texts.values():
        step = step.withColumn(name, _components(F.col(f"{name}_m")))
    return step.drop(*(f"{name}_m" for name in texts.values()))


def _kmers(w: Column) -> Column:
    """Packed hash and place of each run of KMER words."""

    def pack(i: Column) -> Column:
        hashed = F.xxhash64(*(F.get(w, i + k) for k in range(KMER)))
        return F.shiftleft(F.shiftrightunsigned(hashed, PLACE_BITS + 1), PLACE_BITS).bitwiseOR(F.least(i.cast("bigint"), _long((1 << PLACE_BITS) - 1)))

    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - KMER, F.lit(0))), pack)


def _minimal(v: Column) -> Column:
    """The first two of each cell among sorted packed words."""
    return F.filter(v, lambda x, i: F.coalesce(_cell(x) != _cell(F.get(v, i - 2)), F.lit(True)))


def _repeated(s: Column) -> Column:
    """Indices, in the sorted k-mers, of those that equal the one before."""
    return F.filter(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(2)) - 1), lambda i: F.coalesce(_kmer(F.get(s, i)) == _kmer(F.get(s, i - 1)), F.lit(False)))


def _with_numbers(s: Column, r: Column) -> Column:
    """All k-mers packed anew, repeated ones with their number.  The runs of equal k-mers are found
    at both ends of the runs in ``r``; single ones are those beside no equal neighbour."""
    apart = lambda a, b: F.coalesce(_kmer(a) != _kmer(b), F.lit(True))
    single = F.filter(s, lambda x, i: apart(x, F.get(s, i - 1)) & apart(x, F.get(s, i + 1)))
    starts = F.filter(r, lambda i, k: (k == 0) | (F.get(r, k - 1) != i - 1) | apart(F.get(s, i - 1), F.get(s, i - 2)))
    ends = F.filter(r, lambda i, k: F.coalesce(F.get(r, k + 1) != i + 1, F.lit(True)) | apart(F.get(s, i), F.get(s, i + 1)))
    numbers = F.transform(F.zip_with(starts, ends, lambda a, b: F.sequence(a - 1, b)), lambda run: F.transform(run, lambda i, nth: _numbered(F.get(s, i), nth)))
    return F.concat(F.transform(single, lambda x: _numbered(x, F.lit(0))), F.flatten(numbers))


def _components(m: Column) -> Column:
    """Hash the two minimal k-mers of each component in text order.  m: the first two of each cell, sorted
    by cell and rank, which is the order of component 0; that of component i starts at the first cell
    from i on, and goes around."""
    # index in m where each component starts: a cell's first stands for the empty cells before it too
    runs = F.transform(m, lambda x, j: F.array_repeat(j, (_cell(x) - F.coalesce(_cell(F.get(m, j - 1)), _long(-1))).cast("int")))
    starts = F.concat(F.flatten(runs), F.array_repeat(F.lit(0), (COMPONENTS - 1 - _cell(F.element_at(m, -1))).cast("int")))

    def joined(j: Column, i: Column) -> Column:
        x, y = F.get(m, j), F.get(m, (j + 1) % F.size(m))
        both = F.when(_place(x) < _place(y), F.xxhash64(_kmer(x), _kmer(y))).otherwise(F.xxhash64(_kmer(y), _kmer(x)))
        code = F.when(F.size(m) > 1, both).otherwise(F.xxhash64(_kmer(x)))
        return F.shiftleft(i.cast("bigint"), 32).bitwiseOR(code.bitwiseAND(_long(0xFFFFFFFF)))

    return F.transform(starts, joined)


def print_text(print_: Column) -> Column:
    """A fingerprint as text: eight hex digits for each component."""
    return F.array_join(F.transform(print_, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(_long(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components."""
    return F.size(F.array_intersect(a, b)) / COMPONENTS


def _key(doc_id: Column) -> Column:
    """A never-null name of a doc_id, so that joins and windows share one hash partitioning."""
    return F.concat(F.when(doc_id.isNull(), "n").otherwise("i"), F.coalesce(doc_id.cast("string"), F.lit("")))


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id, prev_id, prev_half) of each distinct doc_id in ascending order, null first,
    as a ring: after the last comes the first.  prev_half is half the code points (rounded down) of
    the longest text of the id before.

    Ids are ordered in ranges; each range needs only the borders of the ranges beside it, one row
    per range, so no task sees all ids."""
    half = F.floor(F.coalesce(F.length("text"), F.lit(0)) / 2).cast("bigint")
    ids = docs.select("doc_id", half.alias("half")).groupBy("doc_id").agg(F.max("half").alias("half"))
    ranged = written(ids.repartitionByRange("doc_id").withColumn("range", F.spark_partition_id()), "neighbours")
    per = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first())
    inner = ranged.select("*", F.lead("doc_id").over(per).alias("n"), F.lag("doc_id").over(per).alias("p"), F.lag("half").over(per).alias("ph"), F.row_number().over(per).alias("at"), F.count("*").over(Window.partitionBy("range")).alias("size"))
    first = ranged.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "half")).alias("first"), F.max(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "half")).alias("last"))
    ring = Window.orderBy("range")  # one row per range
    ring = first.select("range", F.lead("first").over(ring).alias("after"), F.lag("last").over(ring).alias("before"), F.first("first").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("top"), F.last("last").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("end"))
    ring = ring.select("range", F.coalesce("after", "top").alias("after"), F.coalesce("before", "end").alias("before"))
    joined = inner.join(ring, "range")
    return joined.select(
        "doc_id",
        F.when(F.col("at") == F.col("size"), F.col("after.doc_id")).otherwise(F.col("n")).alias("next_id"),
        F.when(F.col("at") == 1, F.col("before.doc_id")).otherwise(F.col("p")).alias("prev_id"),
        F.when(F.col("at") == 1, F.col("before.half")).otherwise(F.col("ph")).alias("prev_half"),
    )


def with_edited(docs: DataFrame, ring: DataFrame) -> DataFrame:
    """(doc_id, own, next, text, edited): each text and its edited text, whose last half (rounded
    down, in code points) is replaced by the first as many of the next document.  own and next are
    the keys of the row's and the next id; the result is partitioned by own."""
    keyed = ring.select("doc_id", _key(F.col("doc_id")).alias("ring_own"), _key(F.col("next_id")).alias("next"), _key(F.col("prev_id")).alias("prev"), "prev_half")
    # (own, text) alone: both uses below then read one exchange of the texts
    texts = docs.select(_key(F.col("doc_id")).alias("own"), F.coalesce("text", F.lit("")).alias("text"))
    placed = texts.join(keyed, F.col("own") == F.col("ring_own")).drop("ring_own")
    heads = placed.select(F.col("prev").alias("to"), F.expr("substring(text, 1, cast(prev_half as int))").alias("head"))
    heads = heads.groupBy("to").agg(F.min("head").alias("head"))
    kept = F.expr("substring(text, 1, cast(length(text) - length(text) div 2 as int))")
    return placed.join(heads, F.col("own") == F.col("to")).select(
        "doc_id", "own", "next", "text", F.concat(kept, F.expr("substring(head, 1, cast(length(text) div 2 as int))")).alias("edited")
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next (likeness to the edited text and to the next document).

    The next document is the next greater doc_id (null first; after the last the first); of several
    rows with one id it is the one with the smallest text.  Null texts count as empty, repeated
    rows give repeated results, one document alone is its own next, an empty table gives an empty
    result, and other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    ring = written(neighbours(docs), "neighbours")
    both = with_edited(docs, ring)
    facts = both.select("doc_id", "own", "next", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "text", "edited")
    made = written(with_prints(facts, {"text": "print", "edited": "edited_print"}).drop("text", "edited"), "fingerprints")
    release(docs.sparkSession)
    after = made.groupBy(F.col("own").alias("that")).agg(F.min("print").alias("next_print"))
    return made.join(after, F.col("next") == F.col("that")).select(
        "doc_id", "n_chars", "edited_sha256",
        print_text(F.col("print")).alias("fingerprint"), print_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
