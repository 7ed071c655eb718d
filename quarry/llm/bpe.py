"""Byte-level BPE in linear time.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton over the vocabulary finds, in one
pass, the longest token that starts at every byte.  Encoding goes left to right with the longest
token and backtracks to shorter ones where a token can't stand next to its left neighbour or
where the rest is known to be a dead end; whether two tokens can be neighbours is decided from
their merge histories and memoised.  The only sequence whose neighbours all agree is the one that
rank-ordered merging makes, so the ids are exact.
"""

from __future__ import annotations

import base64
import gc
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices

#: Pieces (and neighbour pairs) that a worker remembers before it starts afresh.
REMEMBERED = 800_000


class Known(dict):
    """Ids of the pieces met so far; a new one is encoded when it is first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.encode(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Bpe:
    """Encoder and decoder for one file of ranks (base64 token, rank)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.split = {rank: self._last_merge(token) for token, rank in ranks.items()}
        self.joined = {pair: rank for rank, pair in self.split.items() if pair}
        self._shorter: dict[int, int | None] = {}
        self._agree: dict[tuple[int, int], bool] = {}
        self._known = Known(self.encode_piece)

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one: merge its bytes by rank down to two parts."""
        if len(token) == 1:
            return None
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best[0] == 1 << 60:
                raise ValueError(f"token {token!r} can't be reached by merges")
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix."""
        found = self._shorter.get(token, -1)
        if found == -1:
            data = self.bytes_of[token]
            found = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), None)
            self._shorter[token] = found
        return found

    def agree(self, left: int, right: int) -> bool:
        """Do the two stay apart when their joint bytes are merged by rank?  Undo the later merge
        of the two facing tokens, again and again; a merge across the border that is due before
        the one just undone would have happened first."""
        key = (left, right)
        known = self._agree.get(key)
        if known is not None:
            return known
        if len(self._agree) >= REMEMBERED:
            self._agree.clear()
        before, good = 1 << 60, True
        while True:
            if self.joined.get((left, right), 1 << 60) < before:
                good = False
                break
            halves_l, halves_r = self.split[left], self.split[right]
            if halves_l is None and halves_r is None:
                break
            if halves_r is None or (halves_l is not None and left > right):
                before, left = left, halves_l[1]
            else:
                before, right = right + 1, halves_r[0]
        self._agree[key] = good
        return good

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one match of the pattern."""
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        size = len(data)
        longest = [0] * size
        for end, (rank, length) in self.automaton.iter(data.decode("latin-1")):
            longest[end - length + 1] = rank  # ends rise, so the last one to start here is the longest
        open_ = bytearray(b"\1") * (size + 1)
        bytes_of, agree, shorter = self.bytes_of, self.agree, self.shorter
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + len(bytes_of[token])
            if open_[end] and (not out or agree(out[-1], token)):
                out.append(token)
                at = end
                if at == size:
                    return tuple(out)
                token = longest[at]
                continue
            less = shorter(token)
            while less is None:
                open_[at] = 0
                last = out.pop()
                at -= len(bytes_of[last])
                less = shorter(last)
            token = less

    def encode(self, text: str) -> list[int]:
        """Ids of a text, each match of the pattern encoded on its own."""
        return list(chain.from_iterable(map(self._known.__getitem__, self.pieces(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Bpe:
    """One encoder per worker."""
    gc.set_threshold(1_000_000)  # a worker holds many small tuples, none in cycles
    return Bpe(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) of every document, the latter decoded from the ids.
    A null text counts as empty: no ids and no bytes.  Other columns are ignored."""

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                back = [bpe.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.binary())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def ids_text(ids) -> F.Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")
