"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad.  Its potentials come from binned features of the
line and of its two neighbours (shares of capitals, symbols, digits, marks,
repeated words and so on, computed over bytes), and from the label of the line before.  Training
takes each line of a labelled document to have the document's label.  A
document's quality is the mean of its lines' forward-backward marginals,
weighted by their lengths, passed through a logistic curve that is fitted on
the same training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.llm.shared import BATCH_ROWS, byte_column, tune, word_hashes

#: The bound on what is fitted: so many labelled documents, those with the smallest hashes of their id, each whole,
#: and fewer where they have more than so many lines together (the first of them always counts).
SAMPLE_DOCS, SAMPLE_LINES = 6_000, 500_000
STEPS, RATE, DECAY = 80, 0.15, 1e-4

_EDGES = np.array([1e-9, 0.01, 0.03, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8, 0.999])
_SIZE_EDGES = np.array([1, 8, 20, 40, 80, 160, 320, 640, 1280, 5000])
_WORD_EDGES = np.array([1, 2, 3, 4, 4.5, 5, 6, 7, 9, 14])
BINS, STATS = len(_EDGES) + 1, 12

_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _BANG, _PIPE, _SYMBOL, _WIDE, _REST = range(10)


def _classes() -> np.ndarray:
    table = np.full(256, _REST, np.uint8)
    table[ord("a") : ord("z") + 1] = _LOWER
    table[ord("A") : ord("Z") + 1] = _UPPER
    table[ord("0") : ord("9") + 1] = _DIGIT
    table[[9, 11, 12, 13, 32]] = _SPACE
    table[[ord(x) for x in ".,;:'\"-()?"]] = _STOP
    table[ord("!")] = _BANG
    table[ord("|")] = _PIPE
    table[[ord(x) for x in "#$%&*+/<=>@[\\]^_`{}~"]] = _SYMBOL
    table[192:] = _WIDE
    return table


_CLASS = _classes()


def lines_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, weights, number of lines by document) of a column of texts; an empty text is one empty line."""
    data, offsets = byte_column(column)
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    # a line ends at each newline and at each text's end
    ends = np.concatenate([breaks, offsets[1:]])
    doc = np.concatenate([np.searchsorted(offsets, breaks, "right") - 1, np.arange(n)])
    order = np.lexsort((np.concatenate([np.zeros(len(breaks)), np.ones(n)]), ends, doc))
    ends, doc = ends[order], doc[order]
    first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    starts[first] = offsets[:-1][doc[first]]
    size = (ends - starts).astype(np.float64)
    kinds = _CLASS[data]
    count = np.empty((10, len(ends)))
    for k in range(10):
        total = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int64)])
        count[k] = total[ends] - total[starts]
    width = np.maximum(size, 1)
    letters = np.maximum(count[_LOWER] + count[_UPPER] + count[_WIDE], 1)
    words = count[_SPACE] + 1
    shares = [count[_UPPER] / letters, count[_SYMBOL] / width, count[_DIGIT] / width, count[_BANG] / width, count[_PIPE] / width, count[_STOP] / width, count[_WIDE] / width, count[_SPACE] / width, count[_REST] / width]
    bins = np.empty((len(ends), STATS), np.int16)
    for k, x in enumerate(shares):
        bins[:, k] = np.searchsorted(_EDGES, x, "right")
    word, _, at, _ = word_hashes(data, offsets)
    line = np.searchsorted(ends, at)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (line[1:] == line[:-1])
    bins[:, 11] = np.searchsorted(_EDGES, np.bincount(line[again], minlength=len(ends)) / words, "right")
    bins[:, 9] = np.searchsorted(_SIZE_EDGES, size, "right")
    bins[:, 10] = np.searchsorted(_WORD_EDGES, size / words, "right")
    return bins, size + 1, np.bincount(doc, minlength=n)


@dataclass
class Model:
    own: np.ndarray  # STATS x BINS, for good against bad
    before: np.ndarray
    after: np.ndarray
    move: np.ndarray  # 2 x 2
    curve: tuple[float, float] = (8.0, -4.0)


def _shifted(bins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the line before and after; -1 where there is none."""
    index = np.arange(len(bins))
    stops = np.cumsum(lengths)
    before, after = index - 1, index + 1
    before[stops - lengths] = -1
    after[stops - 1] = -1
    return before, after


def _emissions(model: Model, bins: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    columns = np.arange(STATS)
    own = model.own[columns, bins].sum(1)
    left = np.where(before >= 0, model.before[columns, bins[before]].sum(1), 0)
    right = np.where(after >= 0, model.after[columns, bins[after]].sum(1), 0)
    return own + left + right


def marginals(score: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(line is good), and the expected moves summed; all chains are walked in step."""
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    starts = (np.cumsum(np.bincount(order, lengths, len(order)).astype(np.int64)) - np.bincount(order, lengths, len(order)).astype(np.int64))[order] if len(order) else order
    e = np.stack([np.exp(-np.clip(score, -30, 30) / 2), np.exp(np.clip(score, -30, 30) / 2)], 1)
    m = np.exp(move)
    forward, backward, scale = np.empty_like(e), np.ones_like(e), np.empty(len(e))
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), "left")  # chains longer than t
    for t in range(longest):
        at = starts[: active[t]] + t
        a = e[at] if t == 0 else (forward[at - 1] @ m) * e[at]
        scale[at] = z = a.sum(1)
        forward[at] = a / z[:, None]
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        backward[at] = ((e[at + 1] * backward[at + 1]) @ m.T) / scale[at + 1][:, None]
    good = forward * backward
    good /= good.sum(1, keepdims=True)
    moves = np.zeros((2, 2))
    inner = np.ones(len(e), bool)
    if len(e):
        inner[starts + lengths - 1] = False
    at = np.flatnonzero(inner)
    for i in range(2):
        for j in range(2):
            moves[i, j] = (forward[at, i] * m[i, j] * e[at + 1, j] * backward[at + 1, j] / scale[at + 1]).sum()
    return good[:, 1], moves


def _quality(p: np.ndarray, weight: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    starts = np.cumsum(lengths) - lengths
    return np.add.reduceat(p * weight, starts) / np.add.reduceat(weight, starts) if len(lengths) else np.zeros(0)


def fit(bins: np.ndarray, weight: np.ndarray, lengths: np.ndarray, label: np.ndarray) -> Model:
    """Conditional likelihood by gradient steps with per-weight rates; labels are balanced."""
    model = Model(*(np.zeros((STATS, BINS)) for _ in range(3)), np.zeros((2, 2)))
    if not len(label) or label.min() == label.max():
        sure = float(label[0]) if len(label) else 1.0
        model.curve = (0.0, 4.0 if sure else -4.0)
        return model
    line_label = np.repeat(label, lengths)
    share = np.clip(label.mean(), 0.02, 0.98)
    importance = np.where(line_label == 1, 0.5 / share, 0.5 / (1 - share))
    before, after = _shifted(bins, lengths)
    truth = np.zeros((2, 2))
    pairs = lengths - 1
    truth[0, 0], truth[1, 1] = pairs[label == 0].sum(), pairs[label == 1].sum()
    flat = bins + np.arange(STATS) * BINS
    views = [(model.own, np.arange(len(bins)), np.arange(len(bins))), (model.before, np.flatnonzero(before >= 0), before[before >= 0]), (model.after, np.flatnonzero(after >= 0), after[after >= 0])]
    speed = [np.full((STATS, BINS), 1e-8) for _ in views]
    move_speed, total = np.full((2, 2), 1e-8), max(len(bins), 1)
    for _ in range(STEPS):
        p, moves = marginals(_emissions(model, bins, before, after), lengths, model.move)
        off = (line_label - p) * importance
        for (table, rows, seen), s in zip(views, speed, strict=True):
            g = np.bincount(flat[seen].ravel(), np.repeat(off[rows], STATS), STATS * BINS).reshape(STATS, BINS) / total - DECAY * table
            s += g * g
            table += RATE * g / np.sqrt(s)
        g = (truth - moves) / total - DECAY * model.move
        move_speed += g * g
        model.move += 0.3 * RATE * g / np.sqrt(move_speed)
    p, _ = marginals(_emissions(model, bins, before, after), lengths, model.move)
    x = _quality(p, weight, lengths)
    a, b = 4.0, -2.0
    for _ in range(300):  # Newton steps for the curve
        q = 1 / (1 + np.exp(-(a * x + b)))
        r, v = label - q, q * (1 - q) + 1e-6
        h = np.array([[(v * x * x).sum() + 1e-2, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-2]])
        da, db = np.linalg.solve(h, [(r * x).sum() - 1e-2 * a, r.sum() - 1e-2 * b])
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
        if abs(da) + abs(db) < 1e-6:
            break
    model.curve = (float(a), float(b))
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", hold_out: bool = True) -> Model:
    """Fit on a bounded sample of labelled documents (SAMPLE_DOCS, SAMPLE_LINES), all lines of each.

    Above 20 * SAMPLE_DOCS usable labels they are thinned by hash before the
    smallest hashes are taken; that changes which documents are the sample.
    Rows whose crc32(id as text) mod 3 is 1 are never learned from.  Null labels
    and labels other than 0 and 1 don't count; of repeated labels the smallest does.
    Without usable labels every document scores as the labels seen (or good).
    """
    spark = docs.sparkSession
    tune(spark)
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("label"))
    if hold_out:
        usable = usable.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1)
    step = max(1, usable.count() // (20 * SAMPLE_DOCS))  # else every task would send its own smallest to the driver
    usable = usable.where(F.pmod(F.xxhash64(id_col), F.lit(step)) == 0)
    sample = usable.orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_DOCS).select(F.col(id_col).alias("id"), "label")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id").select(F.struct(F.xxhash64("id"), "id").alias("key"), "label", "text")
    key_kind = texts.schema["key"].dataType

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, weight, lengths = lines_of(batch.column(2))
            bins, stops = bins.astype(np.uint8), np.cumsum(lengths)
            rows = [(bins[e - n : e].tobytes(), weight[e - n : e].astype(np.float32).tobytes()) for e, n in zip(stops, lengths, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["key", "label", "n", "bins", "weight"])

    schema = T.StructType([T.StructField("key", key_kind), *T.StructType.fromDDL("label int, n bigint, bins binary, weight binary").fields])
    before = Window.orderBy("key", "bins").rowsBetween(Window.unboundedPreceding, -1)  # over the sample's rows alone
    found = texts.mapInArrow(features, schema).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    table = found.where((F.col("before") == 0) | (F.col("before") + F.col("n") <= SAMPLE_LINES)).select("label", "bins", "weight").toArrow()
    raw = sorted(zip(table["label"].to_pylist(), table["bins"].to_pylist(), table["weight"].to_pylist(), strict=True))
    bins = np.frombuffer(b"".join(r[1] for r in raw), np.uint8).reshape(-1, STATS).astype(np.int16)
    weight = np.frombuffer(b"".join(r[2] for r in raw), np.float32).astype(np.float64)
    lengths = np.array([len(r[2]) // 4 for r in raw], np.int64)
    return fit(bins, weight, lengths, np.array([r[0] for r in raw], np.float64))


def score(df: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns and the quality, 0 to 1.  No shuffle; null text scores as an empty one.

    A column that has the name already is replaced.  Repeated rows score alike
    and all stay; an empty frame gives an empty frame.
    """
    tune(df.sparkSession)
    df = df.drop(name) if name != text_col else df
    names = df.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for from_ in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(from_, BATCH_ROWS)
                bins, weight, lengths = lines_of(batch.column(at))
                before, after = _shifted(bins, lengths)
                p, _ = marginals(_emissions(model, bins, before, after), lengths, model.move)
                a, b = model.curve
                q = 1 / (1 + np.exp(-(a * _quality(p, weight, lengths) + b)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(q)], [*names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))
