"""A hidden Markov language model over words, trained by Baum-Welch on all training documents.

The vocabulary isn't bounded, so no task and no message holds all of it.
Documents are packed into batches of tokens once.  In each round every batch
sends, for its own distinct words, what it counted, to the words' buckets; a
bucket adds up each word over all batches and answers every batch with the
totals of the words that it asked about.  So a batch always works with the
counts of the whole corpus, and what moves is a record for each batch and
distinct word, however often a word occurs.

State k emits a known word w with (n_k(w) - DISCOUNT * min(n_k(w), 1)) / n_k, and
what is taken off goes to all known words by the smoothed unigram
distribution.  Unknown words are one more type with the unigram's probability
of it, 1 / (N + V + 1), in every state; known words share the rest.
A word is known by a 64-bit hash, so two different words of the corpus are taken
for one with a chance of V * V / 2^65 for V different words.
Rounds: the first takes each document to be in one state (that of the nearest
centre of byte histograms, k-means over all training documents); each later one
is a Baum-Welch round with expected counts, at least LEAST, until the
likelihood settles, at most ROUNDS.  Long documents are walked in runs of RUN words at once: products
of scaled transfer matrices say with which state probabilities each run begins
and ends, so the passes over the runs are those over the whole text, in
training and in scoring.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.shared import Scratch, byte_column, gathered, parts, tune, word_hashes

STATES, DISCOUNT, RUN, SAMPLE = 4, 0.75, 512, 600
#: Bytes of text in a batch; distinct words (of all batches together) that a bucket adds up.
BATCH, BUCKET_WORDS = 12 << 20, 1_000_000
#: Most steps of k-means, fewest and most Baum-Welch rounds; both stop before, once settled.
STEPS, LEAST, ROUNDS = 30, 5, 20
#: Baum-Welch stops when a round adds less than this share to the log likelihood.
SETTLED = 0.0001
#: The word that ends each document.
END = np.uint64(0x656E64)
FOLDS, HELD = 7, 2
_TOKENS = "batch bigint, docs array<{kind}>, n_words bigint, lengths binary, train binary, state binary, words binary, often binary, codes binary, at binary"


def _pack_planes(x: np.ndarray) -> bytes:
    """Packed with all first bytes of the numbers first, then all second ones and so on, which compresses better."""
    return _pack(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T)


def _unpack_planes(x: bytes, kind) -> np.ndarray:
    planes = _unpack(x, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_places(at: np.ndarray, words: int) -> tuple[bytes, bytes, bytes]:
    """Numbers below ``words`` in three parts: the 255 most frequent ones, a byte for each number that is one of them or 0, and all others in full."""
    often = np.argsort(-np.bincount(at, minlength=words), kind="stable")[:255].astype(np.int32)
    code = np.zeros(words, np.uint8)
    code[often] = np.arange(1, len(often) + 1)
    codes = code[at]
    return _pack(often), _pack(codes), _pack_planes(at[codes == 0].astype(np.int32))


def _unpack_places(row: dict) -> np.ndarray:
    often, codes = _unpack(row["often"], np.int32), _unpack(row["codes"], np.uint8)
    at = np.concatenate([np.zeros(1, np.int32), often])[codes]
    at[codes == 0] = _unpack_planes(row["at"], np.int32)
    return at


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack_planes(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(_unpack_planes(x, np.uint64), dtype=np.uint64)


def _pack_shares(x: np.ndarray) -> bytes:
    """Shares of states in single precision; the last state's is what is left."""
    return _pack_planes(x[:, :-1].astype(np.float32))


def _unpack_shares(x: bytes) -> np.ndarray:
    share = _unpack_planes(x, np.float32).reshape(-1, STATES - 1).astype(np.float64)
    return np.concatenate([share, np.maximum(1 - share.sum(1, keepdims=True), 0)], 1)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def held_out(value) -> bool:
    """crc32 of the id as text, mod 7, is 2; a null id is learned from."""
    return value is not None and zlib.crc32(str(value).encode()) % FOLDS == HELD


def _histograms(column: pa.Array) -> np.ndarray:
    """Square roots of each text's byte shares."""
    data, offsets = byte_column(column)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    h = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float64)
    return np.sqrt(h / np.maximum(h.sum(1, keepdims=True), 1))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1) - 2 * (x @ c.T)).argmin(1)


def centres(df: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> np.ndarray:
    """Starting states: k-means over the byte histograms of all training documents.

    Only the first guess is from a sample, the SAMPLE documents with the smallest
    hashes; every step after it sums histograms of all documents by centre.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _histograms(batch.column(1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in h], pa.binary())], ["id", "h"])

    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("length(text) > 0")
    texts = texts.where(F.col("id").isNull() | (F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS != HELD))
    all_ = scratch.keep(texts.mapInArrow(run, f"id {kind}, h binary"), "histograms")
    key = F.xxhash64("id", "h")
    rows = all_.where(F.pmod(key, F.lit(max(1, all_.count() // (20 * SAMPLE)))) == 0).orderBy(key, "id").limit(SAMPLE).collect()
    if not rows:
        scratch.drop(all_)
        return np.eye(STATES, 256)
    x = np.stack([np.frombuffer(r.h, np.float32) for r in rows]).astype(np.float64)
    c = [x[0]]
    for _ in range(STATES - 1):  # the farthest from all so far
        c.append(x[np.min([((x - y) ** 2).sum(1) for y in c], axis=0).argmax()])
    c = np.stack(c)
    for _ in range(30):
        own = _nearest(x, c)
        c = np.stack([x[own == k].mean(0) if (own == k).any() else c[k] for k in range(STATES)])
    for _ in range(STEPS):
        new = _step(all_, c)
        moved = np.abs(new - c).max()
        c = new
        if moved < 1e-3:
            break
    scratch.drop(all_)
    return c


def _step(histograms: DataFrame, c: np.ndarray) -> np.ndarray:
    """Means of the histograms by nearest centre, summed in each partition and then in 32 groups of partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((STATES, 257))
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float32).reshape(-1, 256).astype(np.float64)
            own = np.eye(STATES)[_nearest(x, c)]
            total[:, :256] += own.T @ x
            total[:, 256] += own.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 32], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"total": pa.array([sum(np.frombuffer(x) for x in table["total"].to_pylist()).tobytes()], pa.binary())})

    sums = histograms.select("h").mapInArrow(run, "part int, total binary").groupBy("part").applyInArrow(add, "total binary")
    total = sum((np.frombuffer(r.total).reshape(STATES, 257) for r in sums.collect()), np.zeros((STATES, 257)))
    return np.where(total[:, 256:] > 0, total[:, :256] / np.maximum(total[:, 256:], 1), c)


def pack_tokens(df: DataFrame, start: np.ndarray, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """Batches of documents: words as numbers into the batch's sorted distinct hashes, each document with its end."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for n, batch in enumerate(gathered(batches, BATCH)):
            data, offsets = byte_column(batch.column(1))
            h, doc, _, _ = word_hashes(data, offsets)
            docs = batch.num_rows
            lengths = np.bincount(doc, minlength=docs) + 1
            stops = np.cumsum(lengths)
            stream = np.full(int(stops[-1]), END, np.uint64)
            inner = np.ones(len(stream), bool)
            inner[stops - 1] = False
            stream[inner] = h
            words, at = np.unique(stream, return_inverse=True)
            train = np.array([not held_out(x) for x in batch.column(0).to_pylist()], np.uint8)
            state = ((_histograms(batch.column(1))[:, None] - start[None]) ** 2).sum(2).argmin(1).astype(np.uint8)
            ids = pa.ListArray.from_arrays(pa.array([0, docs], pa.int32()), batch.column(0))
            blobs = [pa.array([x], pa.binary()) for x in (_pack(lengths.astype(np.int32)), _pack(train), _pack(state), _pack_sorted(words), *_pack_places(at, len(words)))]
            yield pa.RecordBatch.from_arrays([pa.array([first + n]), ids, pa.array([len(words)]), *blobs], ["batch", "docs", "n_words", "lengths", "train", "state", "words", "often", "codes", "at"])

    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return scratch.keep(texts.mapInArrow(run, _TOKENS.format(kind=kind)), "tokens")


@dataclass
class Model:
    move: np.ndarray  # STATES x STATES
    first: np.ndarray
    total: np.ndarray  # tokens by state
    types: np.ndarray  # words by state, each at most 1
    tokens: int  # all training tokens
    words: int  # distinct training words


def _runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, document, place in the document) of runs of at most RUN tokens, longest first."""
    count = -(-lengths // RUN)
    doc = np.repeat(np.arange(len(lengths)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = (np.cumsum(lengths) - lengths)[doc] + place * RUN
    size = np.minimum(lengths[doc] - place * RUN, RUN)
    order = np.argsort(-size, kind="stable")
    return start[order], size[order], doc[order], place[order]


def emissions(model: Model, count: np.ndarray, share: np.ndarray) -> np.ndarray:
    """(words, STATES) probabilities from the corpus's counts of a batch's words."""
    unknown = 1.0 / (model.tokens + model.words + 1.0)
    unigram = (count + 1.0) / max(model.tokens + model.words, 1)
    own = count[:, None] * share
    total = np.maximum(model.total, 1e-9)
    back = np.where(model.total > 0, np.maximum(DISCOUNT * model.types, 1e-9) / total, 1.0)
    known = (own - DISCOUNT * np.minimum(own, 1)) / total + back * unigram[:, None]
    return np.where(count[:, None] > 0, (1 - unknown) * known, unknown)


class _Walk:
    """The runs of a batch's documents, walked in step, longest first; token t of all runs that reach it is one slice."""

    def __init__(self, lengths: np.ndarray):
        self.start, self.size, self.doc, self.place = _runs(lengths)
        runs = len(self.start)
        longest = int(self.size[0]) if runs else 0
        self.live = np.searchsorted(-self.size, -np.arange(longest + 1), "left")
        self.cuts = np.concatenate([[0], np.cumsum(self.live[:longest])]).astype(np.int64)
        run = np.repeat(np.arange(runs), self.size)
        step = np.arange(len(run)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        #: Where each token of the walk is in the documents.
        self.order = np.empty(len(run), np.int64)
        self.order[self.cuts[step] + run] = self.start[run] + step

    def at(self, t: int) -> slice:
        return slice(self.cuts[t], self.cuts[t + 1])

    def carry(self, e: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """(STATES, runs): the forward vector before each run and the backward vector behind it."""
        enter, leave = np.tile(model.first[:, None], len(self.start)), np.ones((STATES, len(self.start)))
        several = np.flatnonzero(np.bincount(self.doc, minlength=1)[self.doc] > 1)
        if not len(several):
            return enter, leave
        place = self.place[several]
        m = np.broadcast_to(np.eye(STATES), (len(several), STATES, STATES)).copy()
        for t in range(int(self.size[several[0]])):
            n = np.searchsorted(several, self.live[t])
            now = m[:n] if t == 0 else m[:n] @ model.move
            if t == 0:
                now = np.where((place > 0)[:n, None, None], now @ model.move, now)  # the first state comes from its own distribution
            now = now * e[:, self.cuts[t] + several[:n]].T[:, None, :]
            m[:n] = now / now.max((1, 2), keepdims=True)
        by = np.lexsort((place, self.doc[several]))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        last = int(place.max())
        for p in range(last):
            some = np.flatnonzero(place == p)
            some = some[rank[some] + 1 < len(by)]
            behind = by[rank[some] + 1]
            ok = place[behind] == p + 1
            v = np.einsum("kn,nkj->jn", enter[:, several[some[ok]]], m[some[ok]])
            enter[:, several[behind[ok]]] = v / v.sum(0)
        for p in range(last, 0, -1):
            some = np.flatnonzero(place == p)
            before = by[rank[some] - 1]
            v = np.einsum("nkj,jn->kn", m[some], leave[:, several[some]])
            leave[:, several[before]] = v / v.sum(0)
        return enter, leave

    def forward(self, e: np.ndarray, enter: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """(STATES, tokens) scaled forward vectors and each token's scale, in the walk's order."""
        out, scale = np.empty_like(e), np.empty(e.shape[1], e.dtype)
        move = np.ascontiguousarray(model.move.T.astype(e.dtype))
        a = enter.astype(e.dtype)
        if len(self.live) > 1:
            a = np.where(self.place == 0, a, move @ a)
        for t in range(len(self.live) - 1):
            at = self.at(t)
            a = (a if t == 0 else move @ a[:, : self.live[t]]) * e[:, at]
            scale[at] = s = a.sum(0)
            a /= s
            out[:, at] = a
        return out, scale


def expect(e: np.ndarray, lengths: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(STATES, tokens) posteriors, expected moves, expected first states and the log likelihood of whole documents.

    e: (STATES, tokens) emission probabilities.
    """
    walk = _Walk(lengths)
    posterior, moves, firsts, log = _expect(walk, e[:, walk.order], model)
    out = np.empty_like(posterior)
    out[:, walk.order] = posterior
    return out, moves, firsts, log


def _expect(walk: _Walk, e: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The same in the walk's order."""
    enter, leave = walk.carry(e, model)
    forward, scale = walk.forward(e, enter, model)
    move, moves = np.ascontiguousarray(model.move.astype(e.dtype)), np.zeros((STATES, STATES))
    posterior, b = np.empty_like(e), leave.astype(e.dtype)
    for t in range(len(walk.live) - 2, -1, -1):
        at, n = walk.at(t), walk.live[t + 1]
        if n:
            ahead = walk.at(t + 1)
            weight = e[:, ahead] * b[:, :n] / scale[ahead]
            own = forward[:, at.start : at.start + n]
            # scaled so that a run's moves at one step add up to one, whatever the scale of b
            both = move @ weight
            weight /= (own * both).sum(0)
            moves += (own @ weight.T) * move
            b[:, :n] = both
        p = forward[:, at] * b[:, : walk.live[t]]
        posterior[:, at] = p / p.sum(0)
    first = walk.at(0) if len(walk.start) else slice(0, 0)
    heads = posterior[:, first]
    later = np.flatnonzero(walk.place > 0)
    if len(later):  # moves from a run's last token to the next run's first
        weight = e[:, first][:, later] * b[:, later]
        own = enter[:, later]
        moves += (own @ (weight / (own * (move @ weight)).sum(0)).T) * move
    return posterior, moves, heads[:, walk.place == 0].sum(1), float(np.log(scale, dtype=np.float64).sum())


def likelihood(e: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """log10 of each document's probability, by the scaled forward recursion over the whole document; e: (STATES, tokens)."""
    walk = _Walk(lengths)
    e = e[:, walk.order]
    _, scale = walk.forward(e, walk.carry(e, model)[0], model)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(doc[walk.order], np.log10(scale), len(lengths))


_SENT = "bucket int, batch bigint, words binary, count binary, share binary, stats array<double>"
_BACK = "batch bigint, bucket int, count binary, share binary, stats array<double>"


def _send(batch: int, words: np.ndarray, count: np.ndarray, expected: np.ndarray, stats: list[float], buckets: int) -> Iterator[pa.RecordBatch]:
    """A record for each bucket of the words; words are sorted, so a bucket is a slice."""
    share = expected / np.maximum(expected.sum(1, keepdims=True), 1e-300)
    cuts = np.searchsorted(words, np.array([b * 2**64 // buckets for b in range(buckets)], np.uint64))
    cuts = np.append(cuts, len(words))
    some = np.flatnonzero(np.diff(cuts) > 0)
    rows = [(int(b), batch, _pack_sorted(words[cuts[b] : cuts[b + 1]]), _pack(count[cuts[b] : cuts[b + 1]].astype(np.uint32)), _pack_shares(share[cuts[b] : cuts[b + 1]]), None) for b in some]
    rows.append((-1, batch, b"", b"", b"", stats))
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64())]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "batch", "words", "count", "share", "stats"])


def _merge(table: pa.Table) -> pa.Table:
    """One bucket: each word's totals, back to each batch in the order in which it asked."""
    bucket = table["bucket"][0].as_py()
    asked = [_unpack_sorted(x) for x in table["words"].to_pylist()]
    sizes = [len(x) for x in asked]
    words, at = np.unique(np.concatenate(asked), return_inverse=True)
    count = np.concatenate([_unpack(x, np.uint32) for x in table["count"].to_pylist()])
    share = np.concatenate([_unpack_shares(x) for x in table["share"].to_pylist()])
    total = np.bincount(at, count, len(words))  # doubles hold whole numbers up to 2^53
    by_state = np.stack([np.bincount(at, count * share[:, k], len(words)) for k in range(STATES)], 1)
    fraction = by_state / np.maximum(by_state.sum(1, keepdims=True), 1e-300)
    exact = total[:, None] * fraction
    stats = [float(total.sum()), float((total > 0).sum()), *exact.sum(0).tolist(), *np.minimum(exact, 1).sum(0).tolist()]
    ends = np.cumsum(sizes)
    total = total.astype(np.uint64)
    rows = [(b, bucket, _pack_planes(total[at[e - n : e]]), _pack_shares(fraction[at[e - n : e]]), None) for b, e, n in zip(table["batch"].to_pylist(), ends, sizes, strict=True)]
    rows.append((-1, bucket, b"", b"", stats))
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.float64())]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["batch", "bucket", "count", "share", "stats"])


def _sums(df: DataFrame, n: int) -> np.ndarray:
    row = df.where("stats is not null").agg(*[F.sum(F.col("stats")[i]) for i in range(n)]).first()
    return np.array([x or 0.0 for x in row])


def _answers(back: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    back = back.sort_by("bucket")
    count = np.concatenate([_unpack_planes(x, np.uint64) for x in back["count"].to_pylist()]).astype(np.float64)
    return count, np.concatenate([_unpack_shares(x) for x in back["share"].to_pylist()])


def score(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    Learns from the documents that aren't held out; scores all.  Null or empty
    text: the end alone.  Null ids are learned from; repeated rows count and
    score each.  Without training documents every word is unknown.  An empty
    frame gives an empty frame; further columns are left out.
    """
    spark = df.sparkSession
    tune(spark)
    kind = df.schema[id_col].dataType.simpleString()
    tokens = pack_tokens(df, centres(df, scratch, id_col, text_col), scratch, id_col, text_col)
    buckets = max(parts(spark), -(-(tokens.agg(F.sum("n_words")).first()[0] or 0) // BUCKET_WORDS))

    def first_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, train, state = _unpack(row["lengths"], np.int32), _unpack(row["train"], np.uint8), _unpack(row["state"], np.uint8)
                words, at = _unpack_sorted(row["words"]), _unpack_places(row)
                use, own = np.repeat(train, lengths).astype(np.float64), np.repeat(state, lengths)
                expected = np.stack([np.bincount(at, use * (own == k), len(words)) for k in range(STATES)], 1)
                moves = np.diag([float(((lengths - 1) * train * (state == k)).sum()) for k in range(STATES)])
                firsts = np.bincount(state, train, STATES)
                yield from _send(row["batch"], words, expected.sum(1), expected, [*moves.ravel().tolist(), *firsts.tolist(), 0.0], buckets)

    def model_of(sent: DataFrame, back: DataFrame) -> tuple[Model, float]:
        a, b = _sums(sent, STATES * STATES + STATES + 1), _sums(back, 2 + 2 * STATES)
        move = a[: STATES * STATES].reshape(STATES, STATES) + 0.5 + 50 * np.eye(STATES)
        first = a[STATES * STATES : -1] + 1
        return Model(move / move.sum(1, keepdims=True), first / first.sum(), b[2 : 2 + STATES], b[2 + STATES :], int(b[0]), int(b[1])), float(a[-1])

    def exchange(sent: DataFrame, name: str, *old: DataFrame) -> tuple[DataFrame, Model, float]:
        sent = scratch.keep(sent, f"sent-{name}")
        scratch.drop(*old)  # with the shuffles that read it, before the next ones are written
        back = scratch.keep(sent.where("bucket >= 0").groupBy("bucket").applyInArrow(_merge, _BACK), f"back-{name}")
        model, log = model_of(sent, back)
        scratch.drop(sent)
        return back, model, log

    def with_answers(function, back: DataFrame, schema: str) -> DataFrame:
        answers = back.where("batch >= 0").select(F.col("batch").alias("to"), "bucket", "count", "share")
        return tokens.groupBy("batch").cogroup(answers.groupBy("to")).applyInArrow(function, schema)

    def expected_counts(model: Model):
        def run(own: pa.Table, back: pa.Table) -> pa.Table:
            out = []
            for row in own.to_pylist():
                lengths, train = _unpack(row["lengths"], np.int32).astype(np.int64), _unpack(row["train"], np.uint8).astype(bool)
                words, at = _unpack_sorted(row["words"]), _unpack_places(row)
                count, share = _answers(back)
                walk = _Walk(lengths[train])
                at = at[np.repeat(train, lengths)][walk.order]
                e = np.ascontiguousarray(emissions(model, count, share).T.astype(np.float32))[:, at]
                posterior, moves, firsts, log = _expect(walk, e, model)
                expected = np.stack([np.bincount(at, posterior[k], len(words)) for k in range(STATES)], 1)
                out += _send(row["batch"], words, np.bincount(at, minlength=len(words)), expected, [*moves.ravel().tolist(), *np.asarray(firsts, float).tolist(), log], buckets)
            return pa.Table.from_batches(out)

        return run

    back, model, _ = exchange(tokens.mapInArrow(first_counts, _SENT), "first")
    last = -np.inf
    for n in range(ROUNDS):
        back, model, log = exchange(with_answers(expected_counts(model), back, _SENT), f"round{n}", back)
        if n + 1 >= LEAST and log - last <= SETTLED * abs(log):
            break
        last = log
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    final = model

    def scored(own: pa.Table, back_: pa.Table) -> pa.Table:
        found = []
        for row in own.to_pylist():
            lengths, train = _unpack(row["lengths"], np.int32).astype(np.int64), _unpack(row["train"], np.uint8)
            at, (count, share) = _unpack_places(row), _answers(back_)
            doc, n = np.repeat(np.arange(len(lengths)), lengths), len(lengths)
            base = np.bincount(doc, np.log10((count + 1) / (final.tokens + final.words + 1))[at], n)
            known = np.bincount(doc, count[at] > 0, n).astype(np.int64)
            value = likelihood(np.ascontiguousarray(emissions(final, count, share).T)[:, at], lengths, final)
            found.append((row["docs"], (train == 0), lengths, known, np.full(n, final.tokens, np.int64), base, value))
        docs = [d for f in found for d in f[0]]
        rest = [np.concatenate([f[i] for f in found]) for i in range(1, 7)] if found else [np.zeros(0, k) for k in (bool, np.int64, np.int64, np.int64, float, float)]
        return pa.table([pa.array(docs, own.schema.field("docs").type.value_type), *map(pa.array, rest)], names)

    return with_answers(scored, back, f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
