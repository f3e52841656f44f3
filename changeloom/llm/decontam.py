"""Benchmark decontamination by edit distance.

A document leaks an item if some part of it is within ``RATE`` edits a byte of
the item (both with A-Z lower-cased and white space collapsed).

1. Windows.  An item with a limit of k edits is cut into k + 1 pieces of bytes;
   k edits leave at least one of them as it is.  Every place of every text is
   looked up among the pieces, whatever the script and wherever words end.  A
   hit says where the item would begin, and a window as long as the item begins
   there.  Where SURE of the ways in which k edits fall on the pieces leave
   several untouched, as many different ones near each other are asked for;
   short items need one.
2. Embedding.  CGK walks read window and item: at each step the current byte
   is put out and a random bit, drawn for this step and byte, says whether to
   move on.  Equal stretches after an edit fall into step again, so a small
   edit distance becomes a small Hamming distance.
3. Bit sampling.  Each of WALKS walks samples BITS steps of the embedding in
   which the item's own walk still reads its bytes (behind them it puts out
   zeros, in which everything agrees).  A window that agrees with its item in
   all places of one walk goes on; exact passages always do.  Steps are drawn
   from a walk's first HEAD, where it has fallen out of step least.
4. Verification.  The exact smallest edit distance between the item and any
   part of the window's surroundings, by bit-parallel dynamic programming:
   items of up to TOGETHER bytes in step over all their windows, longer ones alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.shared import arrow_type, byte_column, gathered, tune

RATE, WALKS, BITS, HEAD = 0.15, 192, 3, 256
#: Chance with which as many edits as the limit allows, all over an item, leave as many pieces as are asked for.
SURE = 0.95
#: Steps after which a walk's random bits begin again.
PERIOD = 256
#: Bytes of items that one pass over the documents holds; more items take more passes.
ITEM_BYTES = 4 << 20
#: Places that are looked up at once, hits that are put into bins at once, and bytes of windows that are embedded at once.
PLACES, HITS, WINDOW_BYTES = 1 << 18, 1 << 17, 8 << 20
#: Bytes of an item up to which it is verified in step with others.
TOGETHER = 512
_MAP_BITS = 22
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with single spaces, their offsets by text, and their places in data."""
    low = _LOWER[data]
    blank = low == 32
    drop = np.zeros(len(low), bool)
    drop[1:] = blank[1:] & blank[:-1]
    drop[offsets[:-1][offsets[:-1] < len(low)]] = False
    keep = np.flatnonzero(~drop)
    return low[keep], np.searchsorted(keep, offsets), keep


def _eight(low: np.ndarray) -> np.ndarray:
    """At every place the next eight bytes as one number, without a copy for each place."""
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    return np.ndarray(len(low) + 1, "<u8", padded, strides=(1,))


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _MAP_BITS)).astype(np.int64)


@lru_cache(maxsize=4096)
def needed(limit: int) -> int:
    """The most pieces, of limit + 1, that limit edits at random leave untouched with a chance of SURE; at least 1."""
    pieces = limit + 1
    left = np.zeros(pieces + 1)  # left[u]: chance of u untouched pieces after the edits so far
    left[pieces] = 1
    u = np.arange(pieces + 1)
    for _ in range(limit):
        hit = left * u / pieces
        left = left - hit
        left[:-1] += hit[1:]
    at_least = np.cumsum(left[::-1])[::-1]
    return max(1, int(np.flatnonzero(at_least >= SURE).max(initial=0)))


class Items:
    """The items of one pass: their normalised bytes, pieces and sampled embeddings."""

    def __init__(self, ids: list, texts: list[str]):
        data, offsets = byte_column(pa.array(texts, pa.string()))
        low, offsets, _ = normalise(data, offsets)
        self.ids = ids
        self.bytes = [low[a:b].tobytes().strip(b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.low = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.limits = np.floor(self.sizes * RATE).astype(np.int64)
        self.need = np.array([needed(int(k)) for k in self.limits], np.int64)
        self.longest = int(self.sizes.max(initial=1))
        self.pieces = int(self.limits.max(initial=0)) + 1
        self.tables = self._pieces()
        rng = np.random.default_rng(11)
        fractions = rng.random((WALKS, BITS))
        self.moves = rng.integers(0, 2, (PERIOD, WALKS * 256), dtype=np.int8)
        self.steps = (np.minimum(self._reading(), HEAD)[:, :, None] * fractions).astype(np.int32)
        self.samples = self.embed(self.low, self.starts, np.arange(len(ids)))

    def _pieces(self) -> dict[int, tuple[np.ndarray, ...]]:
        """By width: the pieces' bytes, sorted, their items and places in them, and a bitmap of their bytes."""
        some = np.flatnonzero(self.sizes)
        pieces = self.limits[some] + 1
        item = np.repeat(some, pieces)
        n = np.arange(len(item)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = n * self.sizes[item] // (self.limits[item] + 1)
        width = np.minimum(self.sizes[item] // (self.limits[item] + 1), 8)
        key = _eight(self.low)[self.starts[item] + at] & _FIRST[width]
        out = {}
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            own = own[np.argsort(key[own], kind="stable")]
            seen = np.zeros(1 << _MAP_BITS, bool)
            seen[_slot(key[own])] = True
            out[w] = (key[own], item[own], at[own], n[own], seen)
        return out

    def _reading(self) -> np.ndarray:
        """(items, WALKS) steps in which a walk over the item reads its bytes, about two a byte."""
        got = np.zeros((len(self.sizes), WALKS), np.int32)
        place = np.repeat(self.starts[:, None], WALKS, 1)
        stop = (self.starts + self.sizes)[:, None]
        row = np.arange(WALKS) * 256
        live, t = np.flatnonzero(self.sizes), 0
        while len(live):
            here = place[live]
            inside = here < stop[live]
            got[live] += inside
            c = self.low[np.minimum(here, len(self.low) - 1)].astype(np.int64)
            place[live] = here + (self.moves[t % PERIOD].take(row + c) * inside)
            live, t = live[inside.any(1)], t + 1
        return got

    def embed(self, low: np.ndarray, starts: np.ndarray, item: np.ndarray) -> np.ndarray:
        """(windows, WALKS, BITS) sampled bytes of the CGK walks over windows of the items' sizes."""
        got = np.zeros((len(starts), WALKS, BITS), np.uint8)
        order = np.argsort(-self.sizes[item], kind="stable")
        at = 0
        while at < len(order):  # the longest first, as many at once as fit
            n = max(1, WINDOW_BYTES // (int(self.sizes[item[order[at]]]) + 16 * WALKS))
            some = order[at : at + n]
            got[some] = self._embed(low, starts[some], item[some])
            at += n
        return got

    def _embed(self, low: np.ndarray, starts: np.ndarray, item: np.ndarray) -> np.ndarray:
        n = len(starts)
        got = np.zeros((n, WALKS, BITS), np.uint8)
        need = self.steps[item].max((1, 2))
        order = np.argsort(-need, kind="stable")
        need, size = need[order], self.sizes[item][order]
        width = int(size.max()) + 1
        # each window's bytes, then zeros; a walk that is through stays on a zero
        at = starts[order][:, None] + np.arange(width)
        inside = (np.arange(width) < size[:, None]) & (at < len(low))
        buffer = np.where(inside, low[np.minimum(at, max(len(low) - 1, 0))], 0).astype(np.uint8).ravel() if len(low) else np.zeros(n * width, np.uint8)
        steps = self.steps[item][order]
        due = np.argsort(steps, axis=None, kind="stable")
        last = int(steps.max())
        until = np.searchsorted(steps.ravel()[due], np.arange(last + 2))
        live = np.searchsorted(-need, -np.arange(last + 1), "right")
        place = np.repeat((np.arange(n, dtype=np.int32) * width)[:, None], WALKS, 1)
        stop = place + size[:, None].astype(np.int32)
        row = np.arange(WALKS, dtype=np.int32) * 256
        out = got.ravel()
        for t in range(last + 1):
            here = place[: live[t]]
            c = buffer.take(here)
            if until[t] < until[t + 1]:
                some = due[until[t] : until[t + 1]]
                out[some] = c[some // (WALKS * BITS), some // BITS % WALKS]
            here += self.moves[t % PERIOD].take(row + c)
            np.minimum(here, stop[: live[t]], out=here)
        back = np.empty_like(order)
        back[order] = np.arange(n)
        return got[back]

    def _hits(self, low: np.ndarray) -> np.ndarray:
        """Every piece that stands in the bytes, sorted, as one number of its item, the place where that would begin, and the piece."""
        eight, found = _eight(low), []
        for w, (key, item, at, piece, seen) in self.tables.items():
            own = (item * self._span(low) - at) * self.pieces + piece
            for from_ in range(0, len(low) - w + 1, PLACES):
                gram = eight[from_ : min(from_ + PLACES, len(low) - w + 1)] & _FIRST[w]
                maybe = np.flatnonzero(seen[_slot(gram)])
                gram = gram[maybe]
                lo, hi = np.searchsorted(key, gram, "left"), np.searchsorted(key, gram, "right")
                count = hi - lo
                row = np.repeat(np.arange(len(gram)), count)
                which = np.arange(len(row)) + np.repeat(lo - (np.cumsum(count) - count), count)
                found.append(own[which] + (maybe[row] + (from_ + self.longest)) * self.pieces)
        if not found:
            return np.zeros(0, np.int64)
        hits = np.concatenate(found)
        del found
        hits.sort()  # in place: a batch can have millions
        return hits

    def _span(self, low: np.ndarray) -> int:
        """More than all places where an item could begin, so that items stay apart."""
        return len(low) + 4 * self.longest + 64

    def windows(self, low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, start) of the windows that pieces propose.

        Hits fall into bins as wide as the item's limit; two bins side by side
        hold all that belong to one place.  They propose it if they hold enough
        different pieces, and the window begins where their middle hit says.
        Bins never hold hits of two items, so items are taken a few at a time,
        whole, of about HITS hits together.
        """
        hits, found, from_ = self._hits(low), [], 0
        own = self._span(low) * self.pieces  # so many numbers are an item's
        while from_ < len(hits):
            to = len(hits)
            if from_ + HITS < to:
                item = int(hits[from_ + HITS]) // own
                to = int(np.searchsorted(hits, item * own))
                if to <= from_:
                    to = int(np.searchsorted(hits, (item + 1) * own))
            found.append(self._proposed(hits[from_:to], low, offsets))
            from_ = to
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        text, item, start = map(np.concatenate, zip(*found, strict=True))
        return text, item, start

    def _proposed(self, hits: np.ndarray, low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, start) of the windows that all hits of some items propose."""
        line = hits // self.pieces
        item = line // self._span(low)
        start = line - item * self._span(low)
        width = self.limits[item] + 1
        bin_ = item * self._span(low) + start // width  # ascending with the hits
        for distinct in (False, True):  # all hits first, which is quick, then different pieces
            piece = hits % self.pieces
            both = np.stack([bin_ - 1, bin_], 1).ravel()  # a pair of bins is named by its first
            if distinct:
                name = np.unique(both * self.pieces + np.repeat(piece, 2)) // self.pieces
                pair, count = np.unique(name, return_counts=True)
            else:
                own, n = np.unique(bin_, return_counts=True)
                follows = np.append(own[1:] == own[:-1] + 1, False)
                pair = np.concatenate([own, own - 1])
                count = np.concatenate([n + np.append(n[1:], 0) * follows, n])
                pair, at = np.unique(pair, return_index=True)
                count = count[at]
            pair = pair[count >= self.need[np.minimum((pair + 1) // self._span(low), len(self.need) - 1)]]
            keep = np.isin(bin_, pair) | np.isin(bin_ - 1, pair)
            hits, item, start, bin_ = hits[keep], item[keep], start[keep], bin_[keep]
        lo, hi = np.searchsorted(bin_, pair, "left"), np.searchsorted(bin_, pair + 1, "right")
        middle = (lo + hi) // 2
        item, start = item[middle], start[middle] - self.longest
        place = start + (hits[middle] % self.pieces) * self.sizes[item] // (self.limits[item] + 1)  # where the piece stands
        text = np.searchsorted(offsets, place, "right") - 1
        return text, item, np.clip(start, offsets[text], np.maximum(offsets[text + 1] - 1, offsets[text]))

    def closest(self, item: int, region: bytes) -> tuple[int, int]:
        """The smallest edit distance of the item to a part of the region, and where that part stops."""
        pattern = self.bytes[item]
        size = len(pattern)
        if size == 0:
            return 1 << 30, 0
        at = region.find(pattern)
        if at >= 0:
            return 0, at + size
        masks: dict[int, int] = {}
        for i, c in enumerate(pattern):
            masks[c] = masks.get(c, 0) | 1 << i
        full, top = (1 << size) - 1, 1 << (size - 1)
        up, down, score, best, stop = full, 0, size, size, 0
        for i, c in enumerate(region):
            eq = masks.get(c, 0)
            x = eq | down
            zero = (((x & up) + up) ^ up) | x
            plus, minus = (down | ~(zero | up)) & full, up & zero
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            if score < best:
                best, stop = score, i + 1
            plus, minus = plus << 1, minus << 1
            up, down = (minus | ~(zero | plus)) & full, plus & zero
        return best, stop

    def _closest_many(self, item: np.ndarray, low: np.ndarray, from_: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for many regions at once, all in step, on words of 64 bits: (distance, length of the region up to there)."""
        order = np.argsort(from_ - to, kind="stable")
        own, row = np.unique(item[order], return_inverse=True)
        words = -(-int(self.sizes[own].max()) // 64)
        masks = np.zeros((len(own), 256, words), np.uint64)
        for i in range(int(self.sizes[own].max())):
            some = np.flatnonzero(self.sizes[own] > i)
            masks[some, self.low[self.starts[own[some]] + i], i // 64] |= np.uint64(1 << (i % 64))
        length, begin, size = (to - from_)[order], from_[order], self.sizes[item][order]
        last, top, one = (size - 1) // 64, ((size - 1) % 64).astype(np.uint64), np.uint64(1)
        up = [np.full(len(item), 2**64 - 1, np.uint64) for _ in range(words)]
        down = [np.zeros(len(item), np.uint64) for _ in range(words)]
        score = size.copy()
        best, stop = score.copy(), np.zeros(len(item), np.int64)
        live = np.searchsorted(-length, -np.arange(int(length[0])), "left") if len(length) else []
        for t, n in enumerate(live):
            eqs = masks[row[:n], low[begin[:n] + t]]
            more = less = np.zeros(n, np.uint64)  # carried from the word before
            for w in range(words):
                u, d, eq = up[w][:n], down[w][:n], eqs[:, w]
                x = eq | d
                eq = eq | less
                zero = (((eq & u) + u) ^ u) | eq
                plus, minus = d | ~(zero | u), u & zero
                ends = last[:n] == w
                if ends.any():
                    score[:n] += np.where(ends, ((plus >> top[:n]) & one).astype(np.int64) - ((minus >> top[:n]) & one).astype(np.int64), 0)
                carry = plus >> np.uint64(63), minus >> np.uint64(63)
                plus, minus = (plus << one) | more, (minus << one) | less
                up[w][:n], down[w][:n] = minus | ~(x | plus), plus & x
                more, less = carry
            better = score[:n] < best[:n]
            best[:n][better], stop[:n][better] = score[:n][better], t + 1
        out, where = np.empty_like(best), np.empty_like(stop)
        out[order], where[order] = best, stop
        return out, where

    def leaks(self, low: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, stop) of each leaked item of each text, at its best place."""
        text, item, start = self.windows(low, offsets)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for at in range(0, len(text), 8192):
            d, i, a = text[at : at + 8192], item[at : at + 8192], start[at : at + 8192]
            agree = (self.embed(low, a, i) == self.samples[i]).all(2).any(1)
            d, i, a = d[agree], i[agree], a[agree]
            margin = 3 * self.limits[i] + 8
            from_, to = np.maximum(offsets[d], a - margin), np.minimum(offsets[d + 1], a + self.sizes[i] + margin)
            distance, stop = np.full(len(d), 1 << 30, np.int64), np.zeros(len(d), np.int64)
            many = np.flatnonzero(self.sizes[i] <= TOGETHER)
            for from_many in range(0, len(many), 2048):
                some = many[from_many : from_many + 2048]
                distance[some], stop[some] = self._closest_many(i[some], low, from_[some], to[some])
            for n in np.flatnonzero(self.sizes[i] > TOGETHER).tolist():
                if best.get((int(d[n]), int(i[n])), (1,))[0]:
                    distance[n], stop[n] = self.closest(int(i[n]), low[from_[n] : to[n]].tobytes())
            for n in np.flatnonzero(distance <= self.limits[i]).tolist():
                key, end = (int(d[n]), int(i[n])), int(from_[n] + stop[n])
                if (int(distance[n]), end) < best.get(key, (1 << 30,)):
                    best[key] = (int(distance[n]), end, max(int(offsets[d[n]]), end - int(self.sizes[i[n]])))
        return [(d, i, distance, begin, stop) for (d, i), (distance, stop, begin) in sorted(best.items())]


def _passes(items: DataFrame, item_col: str, item_text_col: str) -> list[tuple[list, list[str]]]:
    """Ids and texts of the items, at most about ITEM_BYTES of text together; at least one pass."""
    source = items.select(F.col(item_col).alias("i"), F.col(item_text_col).cast("string").alias("t")).where("t is not null and trim(t) != ''")
    passes, ids, texts, held = [], [], [], 0
    for row in source.toLocalIterator():
        ids.append(row.i)
        texts.append(row.t)
        held += 4 * len(row.t)
        if held > ITEM_BYTES:
            passes.append((ids, texts))
            ids, texts, held = [], [], 0
    if ids or not passes:
        passes.append((ids, texts))
    return passes


def clean(df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that leak no item.  No shuffle; null texts stay."""
    tune(df.sparkSession)
    at = df.columns.index(text_col)

    def one(frame: DataFrame, pass_: tuple[list, list[str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Items(*pass_)
            for batch in gathered(batches):
                data, offsets = byte_column(batch.column(at))
                low, places = normalise(data, offsets)[:2]
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in known.leaks(low, places)] if pass_[0] else []] = False
                yield batch.filter(pa.array(keep))

        return frame.mapInArrow(run, frame.schema)

    for pass_ in _passes(items, item_col, item_text_col):
        df = one(df, pass_)
    return df


def decontaminate(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, item_col, distance, start, stop) of every leak; start and stop are byte places in the text.

    No shuffle.  Items reach the tasks in passes of ITEM_BYTES of their text at
    most, so what a pass sends is bounded; each pass reads the documents once.
    Null or empty texts and items without words never leak.  Null ids are kept
    as null, repeated rows give repeated leaks, equal items each their own.
    Empty frames give an empty frame; further columns are left out.
    """
    spark = df.sparkSession
    tune(spark)
    kind, item_kind = df.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    item_arrow = arrow_type(items, item_col)
    passes = _passes(items, item_col, item_text_col)
    base = df.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t"))
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, distance int, start bigint, stop bigint"

    def one(pass_: tuple[list, list[str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Items(*pass_)
            for batch in gathered(batches):
                data, offsets = byte_column(batch.column(1))
                low, places, keep = normalise(data, offsets)
                found = known.leaks(low, places) if pass_[0] else []
                begin = np.array([keep[x[3]] - offsets[x[0]] for x in found], np.int64)
                stop = np.array([keep[x[4] - 1] + 1 - offsets[x[0]] for x in found], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([x[0] for x in found], pa.int64())), pa.array([known.ids[x[1]] for x in found], item_arrow), pa.array([x[2] for x in found], pa.int32()), pa.array(begin), pa.array(stop)],
                    [id_col, item_col, "distance", "start", "stop"],
                )

        return base.mapInArrow(run, schema)

    out = one(passes[0])
    for more in passes[1:]:
        out = out.unionByName(one(more))
    return out
