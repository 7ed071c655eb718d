"""Best-fit packing of tokenised documents into sequences, improved by local search.

Documents are dealt by a hash into groups of bounded size, which are packed side by side, so that
nothing is gathered in one place; a group's last sequences are the only ones that stay underfull.
In a group, pieces are first placed by best fit, one by one in the order of their hashes.  Then a
local search empties underfull sequences, the emptiest first: it moves a piece to the fullest
sequence that still takes it or exchanges one for one, or two for one either way, with a fuller
sequence, always raising the sum of squared fills, until no exchange is left or as few sequences
are left as their lengths allow.
"""

from __future__ import annotations

import gc
import heapq
import os
import re
import zlib
from collections import Counter
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import frugal, slices, written

CAPACITY = 2048
#: Pieces of one group: about this many are packed by one task at a time.
GROUP_PIECES = 20_000
#: Parts of words that a worker remembers before it starts afresh, and the longest that it remembers.
REMEMBERED, LONGEST = 400_000, 64


#: Whole runs of ASCII letters before a space, line end, full stop or comma; else all up to ASCII white space.
_PARTS = re.compile(rb"[a-z]++(?=[\x20\x0a.,])|[^\x20\x09-\x0d]+")


#: Parts that no normalisation changes but for lower case: printable ASCII and the letters of Latin-1.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: Fixed value: the tokenizer's split of such parts, in lower case.
_RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Byte-level spelling: bytes without a visible Latin-1 character of their own are moved beyond 255 in order.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_SPELT = {b: 256 + n for n, b in enumerate(_HIDDEN)}


class WordIds(dict):
    """Ids of whole texts from those of their parts.

    The tokenizer lower-cases, drops white space and never joins across it, nor from letters to
    punctuation, so a text's ids are those of its parts, one after another.  Parts are cut at ASCII
    white space and where ASCII letters meet a full stop or comma; nothing is cut beside other
    characters, which may combine.  A worker makes the ids of a part, little-endian 32-bit words,
    when it first meets it, and remembers them.  A part of plain characters is split into runs by
    the tokenizer's rule here, and its model is asked for each run once; others go through all of it."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.tokenize = tokenizer.encode, tokenizer.model.tokenize
        self.packed = [n.to_bytes(4, "little") for n in range(tokenizer.get_vocab_size())]
        self.runs: dict[str, bytes] = {}

    def __missing__(self, part: bytes) -> bytes:
        if part.isalpha():  # ASCII letters; an upper-case one only where a text isn't lower-cased as a whole
            ids = b"".join([self.packed[t.id] for t in self.tokenize(part.lower().decode())])
        else:
            text = part.decode("utf-8", "replace")
            if _PLAIN.fullmatch(text) and "<|" not in text:
                ids = b"".join(map(self.run, _RUNS.findall(text.lower())))
            else:
                ids = b"".join([self.packed[n] for n in self.encode(text, add_special_tokens=False).ids])
        if len(part) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = ids
        return ids

    def run(self, letters: str) -> bytes:
        """Ids of one run of the tokenizer's own split."""
        found = self.runs.get(letters)
        if found is None:
            spelt = letters if letters.isascii() else letters.encode().decode("latin-1").translate(_SPELT)
            found = b"".join([self.packed[t.id] for t in self.tokenize(spelt)])
            if len(letters) <= LONGEST:
                if len(self.runs) >= REMEMBERED:
                    self.runs.clear()
                self.runs[letters] = found
        return found

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        # lower-casing first saves work; not where it could spell a special token
        get = self.__getitem__
        return [b"".join(map(get, _PARTS.findall(t if b"<|" in t else t.lower()))) for t in (t or b"" for t in texts)]


@lru_cache(maxsize=2)
def load(path: str) -> WordIds:
    gc.set_threshold(1_000_000)  # a worker holds many small objects, none in cycles
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids binary, ids_crc32): the ids of each document and a closing
    id 0, whole where they fit, else cut every ``capacity`` ids.  A null text counts as empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, ids_crc32 bigint"

    def run(batches):
        words = load(tokenizer)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                rows, number, start, length, ids = [], [], [], [], []
                for row, data in enumerate(words.ids(part.column(1).to_pylist())):
                    data += b"\0\0\0\0"
                    total = len(data) // 4
                    for n, at in enumerate(range(0, total, capacity)):
                        rows.append(row), number.append(n), start.append(at)
                        length.append(min(capacity, total - at))
                        ids.append(data[4 * at : 4 * (at + capacity)])
                crc = [zlib.crc32(x) for x in ids]
                columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids", "ids_crc32"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(frugal(run), shape)


class Bins:
    """Sequences of one group: members (piece numbers) and free room, indexed by room; for each piece
    its length, its sequence and the room there."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.members: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.mask = 0  # bit r: some bin has room r
        self.size = np.array(lengths, np.int32)
        self.home, self.space = np.full(len(lengths), -1, np.int32), np.zeros(len(lengths), np.int32)
        self._couples = None

    def _shift(self, which: int, room: int | None) -> None:
        old = self.room[which]
        if old >= 0:
            self.by_room[old].discard(which)
            if not self.by_room[old]:
                self.mask &= ~(1 << old)
        self.room[which] = -1 if room is None else room
        if room is not None:
            self.by_room[room].add(which)
            self.mask |= 1 << room

    def tightest(self, need: int, but: int = -1) -> int:
        """The fullest bin with room for ``need``, or -1."""
        left = self.mask >> need << need
        while left:
            room = (left & -left).bit_length() - 1
            for which in self.by_room[room]:
                if which != but:
                    return which
            left &= left - 1
        return -1

    def open(self) -> int:
        self.members.append([])
        self.room.append(-1)
        self._shift(len(self.room) - 1, self.capacity)
        return len(self.room) - 1

    def add(self, which: int, item: int) -> None:
        self.members[which].append(item)
        self._shift(which, self.room[which] - self.lengths[item])

    def take(self, which: int, item: int) -> None:
        self.members[which].remove(item)
        self._shift(which, self.room[which] + self.lengths[item])

    def close(self, which: int) -> None:
        self._shift(which, None)

    def place(self, *changed: int) -> None:
        """Note where the pieces of these bins are, and the room there."""
        self._couples = None
        for which in changed:
            self.home[self.members[which]] = which
            self.space[self.members[which]] = self.room[which]


    def couples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pieces of a couple in one underfull bin, their length, the bin's room)."""
        if self._couples is None:
            pairs = [p for which, room in enumerate(self.room) if room > 0 for p in combinations(self.members[which], 2)]
            pairs = np.array(pairs, np.int64).reshape(-1, 2)
            self._couples = pairs, self.size[pairs].sum(1), self.space[pairs[:, 0]]
        return self._couples


def pack(lengths: list[int], capacity: int = CAPACITY, done: Counter | None = None) -> list[list[int]]:
    """Piece numbers of each sequence.  done: counts the steps of the search.

    The search starts from best fit in the given order; where it ends above the least number that the
    lengths allow, it starts again from best fit of the longest pieces first, and the better end counts."""
    least, best = -(-sum(lengths) // capacity), None
    for order in (range(len(lengths)), sorted(range(len(lengths)), key=lambda i: -lengths[i])):
        bins = Bins(lengths, capacity)
        for item in order:
            at = bins.tightest(lengths[item])
            bins.add(bins.open() if at < 0 else at, item)
        _search(bins, least, Counter() if done is None else done)
        found = [m for m in bins.members if m]
        if best is None or len(found) < len(best):
            best = found
        if len(best) <= least:
            break
    return best


def _search(bins: Bins, least: int, done: Counter) -> None:
    """Empty underfull sequences, the emptiest first, until ``least`` are left (no packing has fewer) or
    no move or exchange out of any of them raises the sum of squared fills."""
    left = sum(map(bool, bins.members))
    bins.place(*range(len(bins.room)))
    changed = True
    while changed and left > least:
        changed = False
        waiting = [(-room, which) for which, room in enumerate(bins.room) if room > 0]
        heapq.heapify(waiting)
        while waiting and left > least:
            room, source = heapq.heappop(waiting)
            if bins.room[source] != -room:
                continue  # it has changed since
            step = _improve(bins, source)
            if not step:
                continue
            name, target = step
            changed = True
            done[name] += 1
            if not bins.members[source]:
                bins.close(source)
                done["emptied"] += 1
                left -= 1
            bins.place(source, target)
            for which in (source, target):
                if bins.room[which] > 0:
                    heapq.heappush(waiting, (-bins.room[which], which))


def _improve(bins: Bins, source: int) -> tuple[str, int] | None:
    """One move, one-for-one or two-for-one exchange out of ``source`` into a fuller sequence, of the
    exchanges the one that shifts most: what was done, and with which sequence."""
    lengths, members = bins.lengths, bins.members[source]
    for item in sorted(members, key=lambda i: (-lengths[i], i)):
        target = bins.tightest(lengths[item], source)
        if target >= 0 and bins.room[target] <= bins.room[source]:
            bins.take(source, item), bins.add(target, item)
            return "move", target
    # pieces elsewhere that could come back: those in fuller sequences with some room
    back = np.flatnonzero((bins.space > 0) & (bins.space <= bins.room[source]) & (bins.home != source))
    least, room = bins.size[back], bins.space[back]
    ones, twos = [(x,) for x in members], list(combinations(members, 2))
    found = _widest(lengths, ones, least, room)
    name = "one for one"
    if not found:
        name, found = "two for one", _widest(lengths, twos, least, room)
    if found:
        give, back = found[0], [int(back[found[1]])]
    else:  # two come back for one
        pairs, least, room = bins.couples()
        mine = bins.home[pairs[:, 0]] == source
        found = _widest(lengths, ones, np.where(mine | (room > bins.room[source]), bins.capacity + 1, least), room)
        if not found:
            return None
        give, back = found[0], pairs[found[1]].tolist()
    target = int(bins.home[back[0]])
    for x in give:
        bins.take(source, x)
    for x in back:
        bins.take(target, x)
        bins.add(source, x)
    for x in give:
        bins.add(target, x)
    return name, target


def _widest(lengths: list[int], gives: list[tuple], least: np.ndarray, room: np.ndarray) -> tuple[tuple, int] | None:
    """Of the exchanges that fill a room (least: length that comes back) the one that fills most."""
    best, chosen, most = 0, None, least + room
    for give in gives:
        total = sum(lengths[x] for x in give)
        fits = np.flatnonzero((least < total) & (total <= most))
        if len(fits):
            at = int(fits[np.argmin(least[fits])])
            if total - least[at] > best:
                best, chosen = total - least[at], (give, at)
    return chosen


def sequences(parts: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset to a table of pieces (with a column length)."""
    groups = max(1, -(-parts.count() // group_pieces))
    names = parts.columns
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id bigint, offset bigint"

    def run(key, group):
        group = group.select([*names, "pack_group"]).sort_by([("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = group.column("length").to_pylist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for number, members in enumerate(pack(lengths, capacity)):
            at = 0
            for item in members:
                sequence[item], offset[item] = (key[0].as_py() << 32) + number, at
                at += lengths[item]
        return group.select(names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups).cast("bigint")).alias("pack_group")
    return parts.select(*names, group).groupBy("pack_group").applyInArrow(run, shape)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece that holds the closing id alone; null ids and repeated rows
    are packed like others; an empty table gives an empty result; other columns are ignored.
    """
    cut = written(pieces(docs, tokenizer, capacity).drop("ids"), "pieces")
    return sequences(cut, capacity, group_pieces)
