"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end the
prefix's encoding.  The table of these last tokens is filled from left to
right: a token that ends at a position is the right one if it is compatible
with the last token of the prefix that it leaves.  Reading the table from the
end gives the encoding.  Appending bytes only extends the table; replacing
bytes recomputes it from the edit until it agrees with the old one again.

Two tokens are compatible if byte-pair merging never joins across their
border; this is found by undoing the later-formed token at the border, step by
step, and looking for a merge that would have come first.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.shared import list_array, tune

#: Distinct words that a Python worker remembers; beyond it the memory is emptied.
MEMORY_WORDS = 250_000

_NEVER = 1 << 62


class PrefixTable:
    """The last token of each prefix of one piece of bytes, kept up to date under edits."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, bytearray(), [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: the table of a prefix doesn't depend on what follows."""
        start = len(self.data)
        self.data += more
        self.last += [-1] * len(more)
        self._fill(start)

    def splice(self, start: int, stop: int, new: bytes) -> int:
        """Replace data[start:stop]; returns how many entries were computed anew."""
        reach = self.ranks.longest
        tail, old = bytes(self.data[stop:]), self.last[stop + 1 :]
        del self.data[start:]
        del self.last[start + 1 :]
        self.append(new)
        done, same = len(new), 0
        # an entry depends on the entries and bytes of the last `reach` positions only
        for at, entry in enumerate(old):
            if same >= reach:
                self.data += tail[at:]
                self.last += old[at:]
                break
            self.append(tail[at : at + 1])
            done += 1
            same = same + 1 if self.last[-1] == entry else 0
        return done

    def tokens(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            token = self.last[at]
            out.append(token)
            at -= self.ranks.length[token]
        return out[::-1]

    def _fill(self, start: int) -> None:
        r, last = self.ranks, self.last
        back = max(0, start - r.longest + 1)
        window = self.data[back:].decode("latin-1")
        for end, token in r.automaton.iter(window):
            stop = back + end + 1
            if stop <= start or last[stop] >= 0:
                continue
            before = stop - r.length[token]
            if before < 0:
                continue
            if before == 0 or r.compatible(last[before], token):
                last[stop] = token


class Ranks:
    """A vocabulary in tiktoken's rank format, prepared for the prefix table."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.rank.values()) + 1
        self.bytes_of = [b""] * size
        for token, rank in self.rank.items():
            self.bytes_of[rank] = token
        self.length = [len(x) for x in self.bytes_of]
        self.longest = max(self.length)
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.lengths = np.array(self.length, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self._parts: dict[int, tuple[int, int]] = {}
        self._merge: dict[tuple[int, int], int] = {}
        self._known: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(self.rank.items(), key=lambda x: x[1]):
            if len(token) > 1:
                split = self._split(token, rank)
                if split is None:  # no merge makes it: only a whole piece can be this token
                    continue
                self._parts[rank] = split
                self._merge[split] = rank
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self._known.clear()
        self.pattern = regex.compile(pattern)
        self.mids = _Mids(self)
        self.pieces: dict[str, bytes] = {}
        self.newline = self._ids("\n")

    def _split(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The pair whose merge is the token: the one compatible pair of smaller ranks."""
        for at in range(1, len(token)):
            a, b = self.rank.get(token[:at], _NEVER), self.rank.get(token[at:], _NEVER)
            if a < rank and b < rank and self._stable(a, b):
                return a, b
        return None

    def compatible(self, a: int, b: int) -> bool:
        known = self._known.get((a, b))
        if known is None:
            if len(self._known) > MEMORY_WORDS:
                self._known.clear()
            known = self._known[a, b] = self._stable(a, b)
        return known

    def _stable(self, a: int, b: int) -> bool:
        """No merge across the border of a and b comes before both are complete."""
        before = _NEVER
        while True:
            if self._merge.get((a, b), _NEVER) < before:
                return False
            left, right = self._parts.get(a), self._parts.get(b)
            if left is None and right is None:
                return True
            # The later merge is undone; of equal ones the right, as merging goes from the left.
            if right is None or (left is not None and a > b):
                before, a = a, left[1]
            else:
                before, b = b + 1, right[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        length, known = self.length, self._known.get
        last = [-1] * (len(piece) + 1)
        for stop, token in self.automaton.iter(piece.decode("latin-1")):
            stop += 1
            if last[stop] < 0:
                before = stop - length[token]
                if before:
                    fits = known((last[before], token))
                    if fits or (fits is None and self.compatible(last[before], token)):
                        last[stop] = token
                else:
                    last[stop] = token
        out, at = [], len(piece)
        while at:
            out.append(last[at])
            at -= length[last[at]]
        return out[::-1]

    def _ids(self, text: str) -> bytes:
        """The ids of a text, as packed 32-bit integers."""
        return b"".join(map(self._piece, self.pattern.findall(text)))

    def _piece(self, piece: str) -> bytes:
        """The packed ids of one match of the pattern."""
        ids = self.pieces.get(piece)
        if ids is None:
            ids = array("i", self.encode_piece(piece.encode("utf-8", "surrogatepass"))).tobytes()
            if len(piece) < 64:
                if len(self.pieces) >= MEMORY_WORDS:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, each match of the pattern encoded separately.

        Between two visible characters a single space belongs to what follows
        and a single newline is a piece of its own, so words separated so are
        encoded (and remembered) one by one.  Other white space goes through
        the pattern together with its line.
        """
        if not text:
            return np.zeros(0, np.int32)
        if _PLAIN.fullmatch(text) is None:
            return np.frombuffer(self._ids(text), np.int32)
        mids = self.mids.__getitem__
        out = []
        for line in text.split("\n"):
            words = line.split(" ")
            if out:
                out.append(self.newline)
            out.append(self._ids(words[0]))
            out += map(mids, words[1:])
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        lengths = self.lengths[ids]
        stops = np.cumsum(lengths)
        total = int(stops[-1]) if len(stops) else 0
        return self.blob[np.repeat(self.starts[ids] - (stops - lengths), lengths) + np.arange(total)]


class _Mids(dict):
    """The packed ids of words with the space before them; a word that isn't remembered is encoded when it is looked up."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        bare, mark = word[:-1], word[-1:]
        # Letters, perhaps with a mark behind: the pattern's matches are plain to see.
        if word.isalpha() and word.isascii():
            ids = array("i", self.ranks.encode_piece(b" " + word.encode())).tobytes()
        elif mark in ".,;:!?" and bare.isalpha() and bare.isascii():
            ids = self[bare] + self.ranks._piece(mark)
        else:
            ids = self.ranks._ids(" " + word)
        if len(word) < 64:
            if len(self) >= MEMORY_WORDS:
                self.clear()
            self[word] = ids
        return ids


#: Visible runs with single spaces or newlines between them.
_PLAIN = re.compile(r"\S+(?:[ \n]\S+)*")


@lru_cache(maxsize=2)
def ranks(path: str, pattern: str) -> Ranks:
    """Loaded once in each Python process."""
    return Ranks(path, pattern)


def _encoded(table: Ranks, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, ids by text) of a column of texts."""
    found = [table.encode(t) if t else np.zeros(0, np.int32) for t in texts.to_pylist()]
    return np.concatenate(found) if found else np.zeros(0, np.int32), np.array([len(x) for x in found], np.int64)


def _decoded(table: Ranks, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    data = table.decode(ids)
    ends = np.concatenate([[0], np.cumsum(table.lengths[ids])])
    offsets = ends[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, token_ids array<int>) of every row; other columns are left out.

    No shuffle.  Null or empty text: an empty array.  Null or repeated ids,
    repeated rows: each row gives one row.  An empty frame gives an empty
    frame.  Columns with other names don't matter, whatever they are called.
    """
    tune(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path, pattern)
        for batch in batches:
            flat, lengths = _encoded(table, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(flat, lengths, pa.int32())], [id_col, "token_ids"])

    return df.select(id_col, F.col(text_col).cast("string").alias("text_")).mapInArrow(run, f"`{id_col}` {kind}, token_ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, token_ids, decoded binary) of a frame with token_ids; null ids give empty bytes."""
    tune(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path, pattern)
        for batch in batches:
            column = batch.column(1)
            lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
            decoded = _decoded(table, np.asarray(column.flatten()).astype(np.int64), lengths)
            yield pa.RecordBatch.from_arrays([batch.column(0), column, decoded], [id_col, "token_ids", "decoded"])

    return df.select(id_col, "token_ids").mapInArrow(run, f"`{id_col}` {kind}, token_ids array<int>, decoded binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What decode(encode(df)) gives, in one pass through one Python worker a task; the bytes are decoded from the ids alone."""
    tune(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path, pattern)
        for batch in batches:
            flat, lengths = _encoded(table, batch.column(1))
            decoded = _decoded(table, flat, lengths)
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(flat, lengths, pa.int32()), decoded], [id_col, "token_ids", "decoded"])

    return df.select(id_col, F.col(text_col).cast("string").alias("text_")).mapInArrow(run, f"`{id_col}` {kind}, token_ids array<int>, decoded binary")
