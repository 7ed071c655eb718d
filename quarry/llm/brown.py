"""Language-model scores by Brown classes.

Words are put into classes by exchange clustering, and a text is scored by a class n-gram:
P(word | history) = P(class | last two classes) * P(word | class).

1. *Tokens.*  Each task turns its documents into batches with a dictionary of their own (at most
   ``BATCH_WORDS`` words where one document has no more), and writes them with word counts.  Counts
   of all words over the whole training corpus are a grouped sum over the dictionaries; nothing of
   the size of the vocabulary is ever held in one place.
2. *Items.*  Words with at least one in ``1 / SHARE`` of the training tokens are items of the
   exchange on the driver; so there are at most ``1 / SHARE`` of them however large the corpus is.
   All other words fall by their last three bytes into ``SHAPES`` further items for the time being.
3. *Exchange.*  Starting from classes in order of frequency, an item moves to the class that raises
   the likelihood of the class bigrams most (Kneser and Ney), with the neighbours' classes held
   fixed during a round (Uszkoreit and Brants, 2008).  The item bigrams are counted once over all
   training tokens; a round needs their sums by item and class, which Spark computes.
   Then every other word is exchanged too, against the classes of the frequent words, which are fixed
   now: it moves to the class under which its frequent neighbours in all its training occurrences
   are most likely (the exchange criterion to first order, as one rare word hardly changes a class).
   A word's occurrences meet by a shuffle on the word, so nothing is collected.  Only words that
   never stood beside a frequent one, unseen ones included, keep the class of their last bytes.
4. *Model.*  Class trigrams are smoothed by interpolated absolute discounting down to class
   unigrams.  In a class a word keeps its count less a discount, and the discounts of the class
   are the probability of a word not met in training.
5. *Scores.*  The same shuffle sends every batch the total counts and classes of its dictionary, and
   each batch is scored on its own.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, release, slices, written

CLASSES = 64
#: Least share of the training tokens that makes a word an item of its own.
SHARE = 5e-5
SHAPES = 256
ROUNDS = 4
BATCH_WORDS = 300_000
BATCH_BYTES = 10 << 20
END = b"\n"  # no word holds white space
#: Stands for the class of a neighbour that is no frequent word.
UNKNOWN = 255
#: Dictionary entries that a task holds before it sends them back to their batches.
ENTRIES_AT_ONCE = 1_000_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 1; a null id is in the training part."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space, one end."""
    return [*(text or b"").translate(_LOWER).split(), END]


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def tokenised(docs: DataFrame) -> DataFrame:
    """Batches: batch, words array<binary>, counts array<bigint> (in training documents), doc_ids,
    held array<boolean>, sizes array<int>, ids binary (little-endian 32-bit dictionary numbers,
    compressed).  A batch's number holds its partition's: it is settled once the table is written."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"batch bigint, words array<binary>, counts array<bigint>, doc_ids array<{kind}>, held array<boolean>, sizes array<int>, ids binary"
    names = [x.split()[0] for x in shape.split(", ")]

    def run(batches):
        numbers, held, sizes, ids, id_columns, total = _Numbers(), [], [], [], [], 0
        made = itertools.count(TaskContext.get().partitionId() << 32)

        def flush():
            counts = np.zeros(len(numbers), np.int64)
            for x, h in zip(ids, held, strict=True):
                if not h:
                    counts += np.bincount(x, minlength=len(numbers))
            ends = pa.chunked_array(id_columns).combine_chunks()
            one = lambda values, t: pa.array([values], pa.list_(t))
            return pa.RecordBatch.from_arrays(
                [pa.array([next(made)]), one(list(numbers), pa.binary()), one(counts, pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), ends), one(held, pa.bool_()), one(sizes, pa.int32()), pa.array([zstandard.compress(np.concatenate(ids).tobytes(), 1)], pa.binary())],
                names,
            )

        for batch in batches:
            for part in slices(batch, 1, BATCH_BYTES // 4):
                first = 0
                for row, (text, h) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    words = tokens_of(text)
                    ids.append(np.fromiter(map(numbers.__getitem__, words), "<i4", len(words)))
                    held.append(h), sizes.append(len(words))
                    total += len(text or b"")
                    if len(numbers) >= BATCH_WORDS or total >= BATCH_BYTES:
                        id_columns.append(part.column(0).slice(first, row + 1 - first))
                        yield flush()
                        numbers, held, sizes, ids, id_columns, total, first = _Numbers(), [], [], [], [], 0, row + 1
                if first < part.num_rows:
                    id_columns.append(part.column(0).slice(first))
        if ids:
            yield flush()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), is_held_out(F.col("doc_id")).alias("held")).mapInArrow(run, shape)


class Items:
    """Item numbers of words: frequent words first, then the shapes of others."""

    def __init__(self, frequent: list[bytes]):
        self.number = {w: k for k, w in enumerate(frequent)}
        self.size = len(frequent) + SHAPES

    def frequent(self, words: list[bytes]) -> np.ndarray:
        """Item numbers of frequent words, -1 for others."""
        get = self.number.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def of(self, words: list[bytes]) -> np.ndarray:
        shapes = len(self.number)
        get = self.number.get
        return np.fromiter((shapes + zlib.crc32(w[-3:]) % SHAPES if (k := get(w)) is None else k for w in words), np.int64, len(words))


def _unpacked(row) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(row.column("ids")[0].as_py()), "<i4")


def _looked_up(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(counts, classes) of a batch's dictionary, from the parts that other tasks sent."""
    parts = [np.frombuffer(zstandard.decompress(b), _ENTRY) for b in blobs]
    found = np.concatenate(parts) if parts else np.zeros(0, _ENTRY)
    counts, classes = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
    counts[found["local"]], classes[found["local"]] = found["c"], found["class"]
    return counts, classes


_ENTRY = np.dtype([("local", "<i4"), ("c", "<i8"), ("class", "u1")])


def _streams(batches):
    """(row, ids, documents' sizes, held) of each batch."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            yield row, _unpacked(row), row.column("sizes")[0].values.to_numpy(), row.column("held")[0].values.to_numpy(zero_copy_only=False)


def _train_tokens(ids: np.ndarray, sizes: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the training documents and the mask of each document's first token."""
    mine = np.repeat(~held, sizes)
    first = np.zeros(len(ids), bool)
    first[np.cumsum(sizes) - sizes] = True
    return ids[mine], first[mine]


def item_bigrams(batches: DataFrame, items: Items) -> DataFrame:
    """(left, right, n) over the training documents; the left item of a first word is -1."""

    def run(parts):
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for row, ids, sizes, held in _streams(parts):
            ids, first = _train_tokens(ids, sizes, held)
            if not len(ids):
                continue
            right = items.of(row.column("words")[0].values.to_pylist())[ids]
            left = np.concatenate(([-1], right[:-1]))
            left[first] = -1
            found, n = np.unique((left + 1) * (items.size + 1) + right, return_counts=True)
            merged = np.concatenate((keys, found))
            keys, where = np.unique(merged, return_inverse=True)
            counts = np.bincount(where, np.concatenate((counts, n)), len(keys)).astype(np.int64)
            if len(keys) > 2_000_000:
                yield _bigram_batch(keys, counts, items.size)
                keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(keys):
            yield _bigram_batch(keys, counts, items.size)

    partial = batches.select("words", "sizes", "held", "ids").mapInArrow(run, "left int, right int, n bigint")
    return partial.groupBy("left", "right").agg(F.sum("n").alias("n"))


def _bigram_batch(keys, counts, size):
    return pa.RecordBatch.from_arrays([pa.array((keys // (size + 1) - 1).astype(np.int32)), pa.array((keys % (size + 1)).astype(np.int32)), pa.array(counts)], ["left", "right", "n"])


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: DataFrame, size: int, order: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of every item.  order: items, most frequent first.

    A round collects the sums by item and class, at most 2 * items * classes numbers, and items
    are bounded (see above).  Then items move one after another, the class counts being kept up
    to date; the round is undone and the search ends if the likelihood did not rise."""
    label = np.zeros(size, np.int64)
    label[order] = np.arange(size) % classes
    best, held = -np.inf, label.copy()
    spark = bigrams.sparkSession
    for _ in range(rounds + 1):
        known = spark.createDataFrame(pa.table({"item": pa.array(np.arange(size, dtype=np.int32)), "class": pa.array(label.astype(np.int32))}))
        of = F.broadcast(known)  # one row per item
        after = bigrams.join(of.withColumnRenamed("item", "right"), "right").groupBy(F.col("left").alias("item"), "class").agg(F.sum("n").alias("n"))
        before = bigrams.where("left >= 0").join(of.withColumnRenamed("item", "left"), "left").groupBy(F.col("right").alias("item"), "class").agg(F.sum("n").alias("n"))
        right, left = np.zeros((size + 1, classes)), np.zeros((size, classes))
        for target, frame in ((right, after), (left, before)):
            got = frame.toArrow()
            target[got.column("item").to_numpy(), got.column("class").to_numpy()] = got.column("n").to_numpy()
        right = right[:size]  # the last row is that of text starts
        table = np.zeros((classes, classes))
        np.add.at(table, label, right)
        value = _xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum()
        if value <= best:
            return held
        best, held = value, label.copy()
        label = _one_round(label.copy(), order, left, right, table)
    return held


def _one_round(label, order, left, right, table):
    """Move each item to the class where the class bigrams become most likely."""
    classes = len(table)
    for item in order:
        out, into = right[item], left[item]
        if not out.any() and not into.any():
            continue
        old = label[item]
        table[old] -= out
        table[:, old] -= into
        np.maximum(table, 0, out=table)
        rows, columns = table.sum(1), table.sum(0)
        gain = (_xlogx(table + out) - _xlogx(table)).sum(1) + (_xlogx(table + into[:, None]) - _xlogx(table)).sum(0)
        gain -= _xlogx(rows + out.sum()) - _xlogx(rows) + _xlogx(columns + into.sum()) - _xlogx(columns)
        new = int(np.argmax(gain))
        if gain[new] <= gain[old] + 1e-9:
            new = old
        label[item] = new
        table[new] += out
        table[:, new] += into
    return label


def word_entries(batches: DataFrame, items: Items, label: np.ndarray, classes: int = CLASSES) -> DataFrame:
    """(batch, local, word, c, around) of each word of each batch's dictionary: its count in the training
    documents and, unless it is an item, the classes left and right of each occurrence there, a byte
    each (``classes``: text start; UNKNOWN: no frequent word).  Occurrences between unknown ones are left out."""

    def run(parts):
        for row, ids, sizes, held in _streams(parts):
            words = row.column("words")[0].values
            ids, first = _train_tokens(ids, sizes, held)
            item = items.frequent(words.to_pylist())
            known = np.where(item < 0, UNKNOWN, label[item]).astype(np.uint8)
            now = known[ids]
            left, right = np.empty_like(now), np.empty_like(now)
            left[1:], right[:-1] = now[:-1], now[1:]
            left[first] = classes
            right[:-1][first[1:]] = UNKNOWN
            right[-1:] = UNKNOWN
            at = np.flatnonzero((item[ids] < 0) & ((left != UNKNOWN) | (right != UNKNOWN)))
            at = at[np.argsort(ids[at], kind="stable")]
            ends = np.concatenate(([0], np.cumsum(2 * np.bincount(ids[at], minlength=len(words))))).astype(np.int32)
            around = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(np.stack((left[at], right[at]), 1).tobytes())])
            batch = pa.array(np.full(len(words), row.column("batch")[0].as_py(), np.int64))
            yield pa.RecordBatch.from_arrays([batch, pa.array(np.arange(len(words), dtype=np.int32)), words, row.column("counts")[0].values, around], ["batch", "local", "word", "c", "around"])

    return batches.select("batch", "words", "counts", "sizes", "held", "ids").mapInArrow(run, "batch bigint, local int, word binary, c bigint, around binary")


def neighbour_scores(bigrams: DataFrame, n_items: int, label: np.ndarray, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """(before, after): how much a neighbour of a class to the left or to the right speaks for each class of
    a word, in whole millionths, so that sums don't depend on their order.  By the bigrams of the
    ``n_items`` frequent words; row ``classes`` is a text start, row UNKNOWN is zero."""
    of = pa.table({"item": pa.array(np.arange(-1, n_items, dtype=np.int32)), "class": pa.array(np.append([classes], label[:n_items]).astype(np.int32))})
    of = F.broadcast(bigrams.sparkSession.createDataFrame(of))  # one row per item
    both = bigrams.join(of.toDF("left", "x"), "left").join(of.toDF("right", "y"), "right").groupBy("x", "y").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((classes + 1, classes), 0.5)
    table[both.column("x").to_numpy(), both.column("y").to_numpy()] += both.column("n").to_numpy()
    before, after = np.zeros((UNKNOWN + 1, classes), np.int64), np.zeros((UNKNOWN + 1, classes), np.int64)
    before[: classes + 1] = np.rint(1e6 * np.log(table / table.sum(0)))
    inner = table[:classes]
    after[:classes] = np.rint(1e6 * np.log(inner / inner.sum(1, keepdims=True))).T
    return before, after


def classified(entries: DataFrame, items: Items, label: np.ndarray, before: np.ndarray, after: np.ndarray, classes: int = CLASSES) -> DataFrame:
    """(batch, blob, n, v): for each batch the counts and classes of words of its dictionary, packed; and
    for each class k a row with batch -1 - k, its training tokens and its distinct training words."""

    def judge(rows: pa.Table):
        """Counts and classes of whole words, which follow one another."""
        words = rows.column("word").combine_chunks()
        new = np.ones(len(words), bool)
        if len(words) > 1:
            new[1:] = pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        c = np.add.reduceat(rows.column("c").to_numpy(), starts)
        sums, seen = np.zeros((len(starts), classes), np.int64), np.zeros(len(starts), bool)
        around = rows.column("around").combine_chunks()
        offsets = np.frombuffer(around.buffers()[1], np.int32, len(around) + 1, 4 * around.offset)
        pairs = np.frombuffer(around.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].reshape(-1, 2)
        of = np.repeat(group, np.diff(offsets) // 2)
        for at in range(0, len(of), 1 << 15):
            some = of[at : at + (1 << 15)]
            cuts = np.flatnonzero(np.concatenate(([True], some[1:] != some[:-1])))
            part = pairs[at : at + (1 << 15)]
            sums[some[cuts]] += np.add.reduceat(before[part[:, 0]] + after[part[:, 1]], cuts)
            seen[some[cuts]] = True
        group_class = sums.argmax(1)
        rest = np.flatnonzero(~seen)
        group_class[rest] = label[items.of(words.take(pa.array(starts[rest])).to_pylist())]
        return c, group_class, c[group], group_class[group]

    def packed(held: list):
        batch, local, c, group = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(batch, kind="stable")
        batch = batch[order]
        entries = np.zeros(len(batch), _ENTRY)
        entries["local"], entries["c"], entries["class"] = local[order], c[order], group[order]
        starts = np.flatnonzero(np.concatenate(([True], batch[1:] != batch[:-1])))
        blobs = [zstandard.compress(x.tobytes(), 1) for x in np.split(entries, starts[1:])]
        none = pa.nulls(len(blobs), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(batch[starts]), pa.array(blobs, pa.binary()), none, none], ["batch", "blob", "n", "v"])

    def run(parts):
        n, v = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
        waiting, held, size = [], [], 0

        def settle():
            rows = pa.Table.from_batches(waiting)
            c, group_class, c_rows, class_rows = judge(rows)
            np.add.at(n, group_class, c)
            np.add.at(v, group_class, c > 0)
            held.append((rows.column("batch").to_numpy(), rows.column("local").to_numpy(), c_rows, class_rows))

        for part in parts:
            if not part.num_rows:
                continue
            words = part.column("word")
            if waiting and words[-1] != waiting[-1].column("word")[-1]:  # a word ends in this part
                new = np.flatnonzero(pc.not_equal(words, words[-1]).to_numpy(zero_copy_only=False))
                cut = int(new[-1]) + 1 if len(new) else 0
                if cut:
                    waiting.append(part.slice(0, cut))
                settle()
                size += len(held[-1][0])
                waiting = []
                part = part.slice(cut)
                if size >= ENTRIES_AT_ONCE:
                    yield from packed(held)
                    held, size = [], 0
            waiting.append(part)
        if waiting:
            settle()
        if held:
            yield from packed(held)
        yield pa.RecordBatch.from_arrays([pa.array(-1 - np.arange(classes)), pa.nulls(classes, pa.binary()), pa.array(n), pa.array(v)], ["batch", "blob", "n", "v"])

    rows = entries.repartition("word").sortWithinPartitions("word")
    return rows.mapInArrow(run, "batch bigint, blob binary, n bigint, v bigint")


def class_trigrams(batches: DataFrame, classes: int = CLASSES) -> np.ndarray:
    """Counts [class before last, last class, class]; index ``classes`` stands before a text.
    batches: sizes, held, ids, and the blobs with the classes of the dictionary's words."""
    wide = classes + 1

    def run(parts):
        total = np.zeros(wide**2 * classes, np.int64)
        for row, ids, sizes, held in _streams(parts):
            ids, first = _train_tokens(ids, sizes, held)
            if len(ids):
                now = _looked_up(row.column("blobs")[0].as_py())[1][ids]
                last = np.concatenate(([classes], now[:-1]))
                last[first] = classes
                older = np.concatenate(([classes], last[:-1]))
                older[first] = classes
                total += np.bincount((older * wide + last) * classes + now, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    sums = batches.select("blobs", "sizes", "held", "ids").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(wide**2 * classes)
    counts[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    return counts.reshape(wide, wide, classes)


def smoothed(counts: np.ndarray) -> np.ndarray:
    """log10 P(class | two before), by interpolated absolute discounting over three orders."""
    classes = counts.shape[-1]
    lower = (counts.sum((0, 1)) + 0.5) / (counts.sum() + 0.5 * classes)
    for level in (counts.sum(0), counts):
        once, twice = (level == 1).sum(), (level == 2).sum()
        discount = once / (once + 2 * twice) if once else 0.5
        total = level.sum(-1, keepdims=True)
        kept = np.maximum(level - discount, 0)
        spare = total - kept.sum(-1, keepdims=True)
        lower = np.where(total > 0, (kept + spare * lower) / np.maximum(total, 1), np.broadcast_to(lower, level.shape))
    return np.log10(np.maximum(lower, 1e-30))


def score_documents(docs: DataFrame, classes: int = CLASSES, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    perplexity (10 to the negative score per token).

    Null texts count as empty (one end); documents with a null id are in the training part;
    repeated rows are documents of their own; without training documents all words are unknown and
    the model is even; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    batches = written(tokenised(docs), "lm-batches")
    release(spark)
    counted = batches.select(F.explode(F.arrays_zip("words", "counts")).alias("e")).select(F.col("e.words").alias("word"), F.col("e.counts").alias("c"))
    vocabulary = written(counted.groupBy("word").agg(F.sum("c").alias("c")), "lm-vocabulary")
    release(spark)
    facts = vocabulary.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    total, distinct = facts["n"] or 0, facts["v"] or 0
    discount = facts["n1"] / (facts["n1"] + 2 * facts["n2"]) if facts["n1"] else 0.5
    least = max(1, int(np.ceil(total * share)))
    # at most 1 / share words
    top = vocabulary.where(F.col("c") >= least).orderBy(F.desc("c"), "word").toArrow()
    discard(vocabulary)
    items = Items([bytes(w) for w in top.column("word").to_pylist()])
    bigrams = written(item_bigrams(batches, items), "lm-bigrams")
    uses = bigrams.groupBy("right").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(items.size)
    frequency[uses.column("right").to_numpy()] = uses.column("n").to_numpy()
    label = exchange(bigrams, items.size, np.argsort(-frequency, kind="stable"), classes, rounds)
    before, after = neighbour_scores(bigrams, len(items.number), label, classes)
    discard(bigrams)
    release(spark)
    sent = written(classified(word_entries(batches, items, label, classes), items, label, before, after, classes), "lm-entries")
    release(spark)
    held = sent.where("batch < 0").groupBy("batch").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow()  # one row per class
    n_class, v_class = np.zeros(classes), np.zeros(classes)
    of = -1 - held.column("batch").to_numpy()
    n_class[of], v_class[of] = held.column("n").to_numpy(), held.column("v").to_numpy()
    log_n = np.log10(np.maximum(n_class, 1))
    # a class without training tokens, or whose words are all met more than once, still has half a token to spare
    unknown = np.log10(np.maximum(discount * v_class, 0.5) / np.maximum(n_class, 1))
    base_below = np.log10(total + 0.5 * (distinct + 1))
    blobs = sent.where("batch >= 0").groupBy("batch").agg(F.collect_list("blob").alias("blobs"))
    coded = batches.select("batch", "doc_ids", "held", "sizes", "ids").join(blobs, "batch")
    log_p = smoothed(class_trigrams(coded, classes)).astype(np.float32)
    release(spark)

    def run(parts):
        for row, ids, sizes, marks in _streams(parts):
            c, group = _looked_up(row.column("blobs")[0].as_py())
            with np.errstate(divide="ignore"):
                emit = np.where(c > 0, np.log10(np.maximum(c - discount, 1e-9)) - log_n[group], unknown[group])
            starts = np.cumsum(sizes) - sizes
            now = group[ids]
            last = np.concatenate(([classes], now[:-1]))
            last[starts] = classes
            older = np.concatenate(([classes], last[:-1]))
            older[starts] = classes
            sums = lambda x: np.add.reduceat(x, starts)
            score = sums(emit[ids] + log_p[older, last, now].astype(np.float64))
            base = sums(np.log10(c + 0.5)[ids] - base_below)
            yield pa.RecordBatch.from_arrays(
                [row.column("doc_ids")[0].values, pa.array(marks), pa.array(sizes.astype(np.int64)), pa.array(sums((c > 0)[ids].astype(np.int64))), pa.array(np.full(len(sizes), total, np.int64)), pa.array(base), pa.array(score), pa.array(10 ** np.minimum(-score / sizes, 300.0))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    return coded.select("doc_ids", "held", "sizes", "ids", "blobs").mapInArrow(run, out)
