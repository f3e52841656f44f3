"""Token ids in sorted-string-table shards, keyed by document.

A shard file:

    block*   zstd of entries: varint shared, varint unshared, varint size, key rest, ids
    index    zstd of: for each block its first key, offset, size and entry count
    bloom    bit array over the keys
    footer   fixed size: places of index and bloom, counts, id width, magic

Keys are order-preserving bytes (a null sorts first, integers as big-endian
with the sign bit turned, else UTF-8), so a lookup asks the filter, searches
the sparse index by halving and reads one block.  Shards hold disjoint,
ascending ranges; a manifest row per finished shard names it.  A task that
dies leaves a file that no manifest names, so retries and speculative copies
do no harm.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from changeloom.llm.shared import Scratch, parts, tune

BLOCK_BYTES, SHARD_BYTES, BLOOM_BITS, BLOOM_HASHES = 64 << 10, 256 << 20, 10, 7
_INTEGERS = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}
MAGIC = b"CLSST1\0\0"
_FOOTER = struct.Struct("<QQQQQQBI8s")
#: Distinct words that a Python worker remembers; beyond it the memory is emptied.
MEMORY_WORDS = 1_000_000
_MARKS = frozenset(".,;:!?")
#: Letters that the tokenizer's normaliser leaves as they are.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch


def key_of(value: Any) -> bytes:
    if value is None:
        return b"\0"
    if isinstance(value, int):
        return b"\1" + ((value + (1 << 63)) & (2**64 - 1)).to_bytes(8, "big")
    return b"\2" + str(value).encode("utf-8", "surrogatepass")


def value_of(key: bytes) -> Any:
    if key[0] == 0:
        return None
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] == 1 else key[1:].decode("utf-8", "surrogatepass")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = data[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Takes keys in ascending order; equal keys are kept, each an entry."""

    def __init__(self, stream, width: int):
        self.stream, self.width, self.at = stream, width, 0
        self.block, self.entries, self.last = bytearray(), 0, b""
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.first = self.block_first = None
        self.tokens = 0
        self.zstd = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: bytes) -> None:
        shared = 0
        if self.entries:
            for x, y in zip(key, self.last, strict=False):
                if x != y:
                    break
                shared += 1
        else:
            self.block_first = key
        if self.first is None:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.entries += 1
        self.last = key
        self.keys.append(key)
        self.tokens += len(ids) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.stream.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if self.entries:
            at, size = self._put(self.zstd.compress(bytes(self.block)))
            self.index.append((self.block_first, at, size, self.entries))
            self.block, self.entries = bytearray(), 0

    def finish(self) -> None:
        self._flush()
        rows = b"".join(_varint(len(k)) + k + struct.pack("<QII", at, size, n) for k, at, size, n in self.index)
        index_at, index_size = self._put(self.zstd.compress(rows))
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, np.uint8)
        bloom[[p for k in self.keys for p in _bloom_places(k, bits)]] = 1
        bloom_at, bloom_size = self._put(np.packbits(bloom).tobytes())
        self._put(_FOOTER.pack(index_at, index_size, bloom_at, bits, len(self.keys), self.tokens, self.width, bloom_size, MAGIC))


class Reader:
    def __init__(self, file):
        self.file = file
        file.seek(file.size() - _FOOTER.size)
        index_at, index_size, bloom_at, self.bits, self.docs, self.tokens, self.width, bloom_size, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token table")
        self.zstd = zstandard.ZstdDecompressor()
        rows, at, self.index = self.zstd.decompress(self._at(index_at, index_size)), 0, []
        while at < len(rows):
            n, at = _read_varint(rows, at)
            self.index.append((rows[at : at + n], *struct.unpack_from("<QII", rows, at + n)))
            at += n + 16
        self.bloom = self._at(bloom_at, bloom_size)

    def _at(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def block(self, n: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size, entries = self.index[n]
        data, key, place = self.zstd.decompress(self._at(at, size)), b"", 0
        for _ in range(entries):
            shared, place = _read_varint(data, place)
            rest, place = _read_varint(data, place)
            length, place = _read_varint(data, place)
            key = key[:shared] + data[place : place + rest]
            place += rest
            yield key, data[place : place + length]
            place += length

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for n in range(len(self.index)):
            yield from self.block(n)

    def ids(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, np.uint16 if self.width == 2 else np.uint32).astype(np.uint32)

    def get(self, value: Any) -> list[np.ndarray]:
        """The ids of every entry of this key, none if it isn't here."""
        key = key_of(value)
        if not all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _bloom_places(key, self.bits)):
            return []
        firsts = [x[0] for x in self.index]
        n = max(0, bisect_right(firsts, key) - 1)
        while n > 0 and firsts[n] == key:  # equal keys may begin in the block before
            n -= 1
        found = []
        for at in range(n, len(self.index)):
            if firsts[at] > key:
                break
            found += [self.ids(raw) for k, raw in self.block(at) if k == key]
        return found


def open_table(uri: str) -> Reader:
    fs, path = pa.fs.FileSystem.from_uri(uri)
    return Reader(fs.open_input_file(path))


class Words(dict):
    """Each word's packed ids by a tokenizers file; a word that isn't remembered is encoded when it is looked up.

    The tokenizer's normaliser and splitter never look across white space, so
    a text's ids are those of its words, one after the other.  A word of small
    Latin letters passes both unchanged and goes to the tokenizer's model
    itself; capitals are their small letters; a mark behind letters is a word
    of its own.  Everything else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = "H" if self.kind is np.uint16 else "I"
        alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_letters = {c: alphabet.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.model = self.tokenizer.model

    def encode(self, texts: list[str | None]) -> list[bytes]:
        at = self.__getitem__
        return [b"".join(map(at, t.replace("\n", " ").split(" "))) if t else b"" for t in texts]

    def __missing__(self, word: str) -> bytes:
        base = word.lower()
        if _LETTERS(base):
            ids = self[base] if base != word else self._packed(x.id for x in self.model.tokenize(base.translate(self.byte_letters)))
        elif base[-1] in _MARKS and _LETTERS(base[:-1]):
            ids = self[word[:-1]] + self[word[-1]]
        else:
            ids = self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(self) >= MEMORY_WORDS:
            self.clear()
            self[""] = b""
        if len(word) < 64:
            self[word] = ids
        return ids

    def _packed(self, ids) -> bytes:
        return array(self.code, ids).tobytes()


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Words(path)


def write_tables(df: DataFrame, tokenizer: str, end_id: int | None, out: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, write the shards, return their manifest.

    The texts are dealt by ranges of the id (repeated ids further by a hash of
    the text, so one id with many rows spreads), sorted within each task, and
    encoded there: what is shuffled is the text, once.  Null text: only the end
    id.  Null ids come first.  Repeated rows are all kept, equal ids in the
    order of the text's hash.  An empty frame gives an empty manifest.
    Ids other than integers are taken as text.
    Manifest: shard, seq, file, id_type, first_key, last_key, n_docs, n_tokens.
    """
    spark = df.sparkSession
    tune(spark)
    folder = out.path("shards")
    data = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if dict(data.dtypes)["id"] not in _INTEGERS:
        data = data.withColumn("id", F.col("id").cast("string"))
    id_type = dict(data.dtypes)["id"]
    tie = F.xxhash64("text")
    data = data.repartitionByRange(parts(spark), F.col("id"), tie).sortWithinPartitions(F.col("id"), tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, writer, stream, name = words(tokenizer), TaskContext.get().partitionId(), 0, None, None, ""
        fs, root = pa.fs.FileSystem.from_uri(folder)
        width = np.dtype(encoder.kind).itemsize
        end = b"" if end_id is None else np.array([end_id], encoder.kind).tobytes()
        fs.create_dir(root, recursive=True)

        def close() -> pa.RecordBatch:
            writer.finish()
            stream.close()
            row = [part, seq, name, id_type, writer.first, writer.last, len(writer.keys), writer.tokens]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["shard", "seq", "file", "id_type", "first_key", "last_key", "n_docs", "n_tokens"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                for value, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist()), strict=True):
                    if writer is None:
                        name = f"{folder}/{part:06d}-{seq:04d}-{uuid.uuid4().hex}.sst"
                        stream = fs.open_output_stream(f"{root}/{name.rpartition('/')[2]}")
                        writer = Writer(stream, width)
                    writer.add(key_of(value), ids + end)
                    if writer.at > SHARD_BYTES:
                        yield close()
                        seq, writer = seq + 1, None
        if writer is not None:
            yield close()

    schema = "shard bigint, seq bigint, file string, id_type string, first_key binary, last_key binary, n_docs bigint, n_tokens bigint"
    return out.keep(data.mapInArrow(run, schema), "manifest")


def read_tables(manifest: DataFrame, id_type: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32, token_ids) of every entry, from the files.

    id_type: that of the ids as they were written, read from the manifest if not given (bigint where it is empty).

    start counts the ids of all entries before, over all shards: the shards'
    totals are summed in groups of 1,000 shards, then over the groups.
    """
    spark = manifest.sparkSession
    if id_type is None:
        one = manifest.select("id_type").first()
        id_type = one.id_type if one else "bigint"
    id_arrow = _INTEGERS.get(id_type, pa.string())
    groups = manifest.withColumn("grp", F.floor(F.col("shard") / 1000))
    inner = Window.partitionBy("grp").orderBy("shard", "seq").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    totals = groups.groupBy("grp").agg(F.sum("n_tokens").alias("t")).select("grp", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    files = groups.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(totals, "grp").select("file", (F.col("inside") + F.col("base")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table = open_table(file)
                for n in range(len(table.index)):
                    keys, raws = zip(*table.block(n), strict=True)
                    lengths = np.array([len(r) // table.width for r in raws], np.int64)
                    flat = table.ids(b"".join(raws)).astype("<u4")
                    ends = np.cumsum(lengths)
                    starts = start + ends - lengths
                    crcs = [zlib.crc32(flat[e - k : e].tobytes()) for e, k in zip(ends, lengths, strict=True)]
                    start += int(ends[-1])
                    ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array([value_of(k) for k in keys], id_arrow), pa.array(starts), pa.array(lengths), pa.array(crcs, pa.int64()), ids], [id_col, "start", "n_tokens", "ids_crc32", "token_ids"])

    return files.repartition(parts(spark)).mapInArrow(run, f"`{id_col}` {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint, token_ids array<int>")
