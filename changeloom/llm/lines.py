"""Substring dedup by hashing lines and their sentences.

A text is cut into units: after newlines, and inside a line after a full stop,
question or exclamation mark with a space behind it.
A unit's key is a 128-bit digest of its words, lower-cased and joined by one
space.  Keys are grouped over all documents, the earliest occurrence (smallest
id, then first in the text) is kept and every other is removed.  A unit of
fewer than ``min_words`` words is too common to stand alone, so its key also
holds the units before it, as many as it takes; at the start of a text, where
there are too few, a short unit is always kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.llm.shared import Scratch, tune, unused

MIN_WORDS = 8


_END = re.compile(r"[.?!] |\n")


def cut(text: str) -> list[str]:
    """The units of a text; together they are the text."""
    out, at = [], 0
    for end in _END.finditer(text):
        out.append(text[at : end.end()])
        at = end.end()
    if at < len(text):
        out.append(text[at:])
    return out


def added(df: DataFrame) -> tuple[str, str, str]:
    """The names of dedup's own columns: n_units, n_removed and removed_spans, with underscores where df has them already."""
    return unused("n_units", df), unused("n_removed", df), unused("removed_spans", df)


def keys(text: str, min_words: int) -> tuple[list[int], bytes]:
    """Places of the units that have a key, and their digests of 16 bytes each."""
    places, digests, recent = [], [], []
    for at, unit in enumerate(cut(text)):
        words = unit.lower().split()
        if not words:
            continue
        recent.append(words)
        n, back = len(words), 1
        while n < min_words and back < len(recent):
            back += 1
            n += len(recent[-back])
        if n >= min_words:
            if back > 1:
                words = [w for some in recent[-back:] for w in some]
            places.append(at)
            digests.append(blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest())
            if len(recent) > 64:
                del recent[:-min_words]
    return places, b"".join(digests)


def dedup(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns with the text as it is left, and n_units, n_removed, removed_spans (see added).

    removed_spans: ranges [start, stop) of code points of the original text, in
    order, adjacent ones joined.  Null text stays null with no units.  Null ids
    rank last.  Rows of one id and one text are one document and stay as many as they
    were; rows of one id with different texts are different documents, ranked by the
    text's hash.  An empty frame gives an empty frame.

    The keys of all units are written once and read twice: for the first rank of
    each repeated key (pre-aggregated before the shuffle), and to be joined with it.
    That join is an equi-join on the key, so a key that very many documents
    share is split by adaptive execution; the other side has a row for each key.
    """
    spark = df.sparkSession
    tune(spark)
    kind = df.schema[id_col].dataType.simpleString()
    base = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [keys(t, min_words) for t in batch.column(2).to_pylist()]
            take = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
            digest = np.frombuffer(b"".join(x[1] for x in found), np.int64).reshape(-1, 2)
            places = np.array([p for x in found for p in x[0]], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(places), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy())], ["id", "h", "place", "d1", "d2"])

    units = scratch.keep(base.mapInArrow(unit_rows, f"id {kind}, h bigint, place int, d1 bigint, d2 bigint"), "units")
    rank = F.struct(F.col("id").isNull().alias("null"), "id", "h", "place")
    firsts = units.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count("*").alias("n"), F.max(rank).alias("last")).where("n > 1 and first != last").drop("n", "last")
    firsts = scratch.keep(firsts, "firsts")  # else the join would run inside the grouping's tasks, and its hot keys couldn't be split
    own_id, own_hash, own_places, hash_ = (unused(x, df) for x in ("of_id", "of_hash", "places", "text_hash"))
    marks = units.join(firsts, ["d1", "d2"]).where(rank != F.col("first")).groupBy("id", "h").agg(F.collect_set("place").alias(own_places)).withColumnsRenamed({"id": own_id, "h": own_hash})
    marks = scratch.keep(marks, "marks")
    scratch.drop(units, firsts)
    joined = df.withColumn(hash_, F.xxhash64(F.col(text_col))).join(marks, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(hash_) == F.col(own_hash)), "left").drop(own_id, own_hash, hash_)
    names, more_names = df.columns, added(df)
    at = names.index(text_col)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed, spans = [], [], [], []
            for text, places in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                found, gone, kept, here = cut(text) if text else [], set(places or ()), [], 0
                own: list[dict] = []
                for n, unit in enumerate(found):
                    if n in gone:
                        if own and own[-1]["stop"] == here:
                            own[-1]["stop"] = here + len(unit)
                        else:
                            own.append({"start": here, "stop": here + len(unit)})
                    else:
                        kept.append(unit)
                    here += len(unit)
                texts.append("".join(kept) if own else text)
                counts.append(len(found))
                removed.append(len(gone))
                spans.append(own)
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            more = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, spans_type)]
            yield pa.RecordBatch.from_arrays(columns + more, [*names, *more_names])

    fields = [T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType, True) for f in df.schema.fields]
    kinds = (T.LongType(), T.LongType(), T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])))
    return joined.mapInArrow(rebuild, T.StructType(fields + [T.StructField(n, k) for n, k in zip(more_names, kinds, strict=True)]))
