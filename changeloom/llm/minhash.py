"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

A document's set is its distinct shingles of five words.  SuperMinHash gives
each element one permutation of the signature's slots and ascending ranks
along it, and stops as soon as no further rank can lower a slot.  Signatures
are cut into bands; documents that agree in a band are candidates.

Links between different texts are all found, without emitting a group's pairs:

1. Documents with one and the same set are one class, led by the smallest id.
2. Every document is tested against one other: the smallest id that it meets in
   any bucket.  Copies of one original meet it there, however many they are.
3. Verified links are grouped.  Where a bucket still holds several groups, its
   members are compared by signature, block against block in memory; pairs of
   different groups that are likely enough links only say which documents
   belong to one cluster.  Each document's text goes to its cluster once a
   block, where all pairs of different groups are counted exactly.  What comes
   out of a block is a spanning forest, never its pairs.

Tests compare full sets by 128-bit digests of their shingles (two independent
64-bit hashes, of which only the first makes the signature) and take
100 * common >= 75 * union exactly.  A pair at the bound shares no band with a chance of 3e-7 (40 bands of 4).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.shared import Scratch, arrow_type, byte_column, lowered, mix, parts, release, span_hashes, tune, word_places

WORDS, BANDS, ROWS = 5, 40, 4
SLOTS = BANDS * ROWS
#: Signature agreement below which two documents of one bucket are not tested: 6 standard deviations under the bound.
LIKELY = 0.55
#: Documents compared with one leader in one sorted run; signatures of one block; shingles of one block.
RUN, BLOCK, SHINGLES = 256, 2048, 500_000

_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, (2, WORDS + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingles(h: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A hash of every five words in a row; each word's hash is mixed by its place before they are added."""
    rolled = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        rolled += mix(h[k : len(h) - WORDS + 1 + k] * factors[k] + np.uint64(k))
    return mix(rolled)


def _whole(h: np.ndarray, factors: np.ndarray) -> np.ndarray:
    x = np.array([len(h)], np.uint64)
    for k in range(len(h)):
        x = mix(x * factors[WORDS] + h[k : k + 1])
    return x


def _distinct(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """(2, n): the different pairs, sorted."""
    by = np.argsort(one, kind="stable")
    pair = np.stack([one[by], two[by]])
    same = pair[0, 1:] == pair[0, :-1]
    if (same & (pair[1, 1:] != pair[1, :-1])).any():  # different shingles of one first half
        by = np.lexsort((two, one))
        pair = np.stack([one[by], two[by]])
        same = (pair[:, 1:] == pair[:, :-1]).all(0)
    return pair[:, np.append(np.ones(min(1, len(by)), bool), ~same)]


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Every text's set as a (2, n) array of 128-bit digests, sorted; fewer words than five are one shingle, no words none."""
    data, offsets = byte_column(column)
    n = len(offsets) - 1
    doc, starts, stops = word_places(data, offsets) if len(data) else (np.zeros(0, np.int64),) * 3
    low = lowered(data)
    words = [span_hashes(low, starts, stops, seed) for seed in (0, 1)]
    counts = np.bincount(doc, minlength=n)
    rolled = [_shingles(h, f) for h, f in zip(words, _FACTORS, strict=True)]
    out = []
    for stop, count in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True):
        if count >= WORDS:
            out.append(_distinct(*(r[stop - count : stop - WORDS + 1] for r in rolled)))
        elif count:
            out.append(np.stack([_whole(h[stop - count : stop], f) for h, f in zip(words, _FACTORS, strict=True)]))
        else:
            out.append(np.zeros((2, 0), np.uint64))
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many digests two sets share."""
    if not a.shape[1] or not b.shape[1]:
        return 0
    place = np.minimum(np.searchsorted(a[0], b[0]), a.shape[1] - 1)
    first = a[0][place] == b[0]
    both = first & (a[1][place] == b[1])
    if (first & ~both).any():  # different shingles of one first half
        return len(set(zip(*a.tolist(), strict=True)) & set(zip(*b.tolist(), strict=True)))
    return int(both.sum())


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each set, as level << 56 | fraction; empty sets stay at the maximum."""
    none = np.uint64(2**64 - 1)
    sig = np.full(len(sets) * slots, none, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    chosen: list[np.ndarray] = []
    for level in range(slots):
        if not len(element):
            break
        r = mix(element + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64))
        k = (level + (r & np.uint64(0xFFFFFFFF)) % np.uint64(slots - level)).astype(np.int16)
        place = k.copy()
        for back in range(level - 1, -1, -1):  # what earlier swaps brought there
            place[chosen[back] == place] = back
        value = (np.uint64(level) << np.uint64(56)) | (mix(r) >> np.uint64(8))
        np.minimum.at(sig, owner * slots + place, value)
        chosen.append(k)
        going = (sig.reshape(-1, slots).max(1) >> np.uint64(56)) > level
        keep = going[owner]
        element, owner = element[keep], owner[keep]
        chosen = [c[keep] for c in chosen] if not keep.all() else chosen
    return sig.reshape(-1, slots)


def sketch(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, s1, s2, sig, bands): set size, 128-bit set digest, one byte a slot, a hash a band."""
    tune(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1))
            sig = signatures([s[0] for s in sets])
            n = np.array([s.shape[1] for s in sets], np.int64)
            digest = np.array([s.sum(1, dtype=np.uint64) for s in sets], np.uint64).reshape(-1, 2)
            bands = np.zeros((len(sets), BANDS), np.uint64)
            for r in range(ROWS):
                bands = mix(bands * np.uint64(31) + sig[:, r::ROWS] + np.arange(BANDS, dtype=np.uint64))
            ends = pa.array((np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))])).astype(np.int32))
            small = (mix(sig) & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)), pa.array([x.tobytes() for x in small], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(bands[n > 0].ravel().view(np.int64)))],
                ["id", "n", "s1", "s2", "sig", "bands"],
            )

    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"id {kind}, n bigint, s1 bigint, s2 bigint, sig binary, bands array<bigint>")


def _pairs(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], kind), pa.array([x[1] for x in found], kind)], ["a", "b"])


def verify(pairs: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that are links, by the full sets of their texts.

    texts: (id, text), joined by sorting at every size.  The texts of candidates are dealt by a and a salt of at
    most about RUN documents, with a's own text first in each run, so a leader
    of very many candidates is spread and a task holds one leader's set only.
    """
    kind, arrow = pairs.schema["a"].dataType.simpleString(), arrow_type(pairs, "a")
    pairs = scratch.keep(pairs, "pairs")
    runs = pairs.groupBy("a").agg(F.ceil(F.count("*") / RUN).cast("int").alias("runs"))
    members = pairs.join(runs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("runs")).cast("int").alias("run"), F.col("b").alias("id"), F.lit(1).alias("role"))
    leaders = runs.select("a", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.col("a").alias("id"), F.lit(0).alias("role"))
    rows = members.unionByName(leaders).groupBy("id").agg(F.collect_list(F.struct("a", "run", "role")).alias("uses"))
    rows = texts.join(rows.hint("merge"), "id").select("id", "text", F.explode("uses").alias("use")).select("use.a", "use.run", "use.role", "id", "text")
    rows = rows.repartition(parts(pairs.sparkSession), "a", "run").sortWithinPartitions("a", "run", "role", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leader = None, []
        for batch in batches:
            sets, found = shingle_sets(batch.column(4)), []
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for key, role, name, own in zip(keys, batch.column(2).to_pylist(), batch.column(3).to_pylist(), sets, strict=True):
                if key != at:
                    at, leader = key, []
                if role == 0:
                    leader.append(own)
                    continue
                for one in leader:
                    n = common(one, own)
                    if n and 100 * n >= 75 * (one.shape[1] + own.shape[1] - n):
                        found.append((key[0], name))
                        break
            yield _pairs(found, arrow)

    return scratch.keep(rows.mapInArrow(run, f"a {kind}, b {kind}"), "links")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root): every linked id other than its group's smallest, which is its root.

    Union-find inside each partition shrinks the links to a forest; large-star
    and small-star steps join the forests until nothing changes.
    """
    kind, arrow = links.schema["a"].dataType.simpleString(), arrow_type(links, "a")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def find(x):
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        ids = list(up)
        for at in range(0, len(ids), 50_000):
            some = ids[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, arrow), pa.array([find(x) for x in some], arrow)], ["u", "v"])

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    edges = scratch.keep(links.select("a", "b").mapInArrow(local, f"u {kind}, v {kind}"), "forest")
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join deals both sides anew and adaptive execution can split the smallest document of a very large group
        lowest = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        new = scratch.keep(small, "stars")
        scratch.drop(edges, lowest)
        edges, after = new, state(new)
        if after == before:
            break
        before = after
    return edges.withColumnsRenamed({"u": "id", "v": "root"})


class _Forest:
    """Union-find over the members of a block, keeping the links that joined two trees."""

    def __init__(self, ids: list, groups: np.ndarray | None = None):
        self.ids, self.edges = ids, []
        self.tree = np.arange(len(ids)) if groups is None else groups.copy()

    def join(self, x: int, others: np.ndarray) -> None:
        for y in others:
            if self.tree[x] != self.tree[y]:
                self.tree[self.tree == self.tree[y]] = self.tree[x]
                a, b = self.ids[x], self.ids[y]
                self.edges.append((min(a, b), max(a, b)))


def _between(buckets: DataFrame, sigs: DataFrame, kind: str) -> DataFrame:
    """Likely links between different groups of one bucket, as a forest a block: (key, id, root) and (id, sig) to (a, b)."""
    sizes = buckets.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo != hi").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    arrow = arrow_type(buckets, "id")
    rows = buckets.join(sizes, "key").join(sigs, "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "root", "sig")
    rows = rows.repartition(parts(buckets.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "own")

    def compare(group: list[tuple]) -> Iterator[tuple]:
        _, i, j, own, ids, roots, sigs = zip(*group, strict=True)
        sig = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(ids), SLOTS)
        root = np.unique(np.array(roots), return_inverse=True)[1]
        own = np.array(own)
        first = own == i[0]
        left, right = np.flatnonzero(first), np.flatnonzero(~first) if i[0] != j[0] else np.flatnonzero(first)
        least = SLOTS * (LIKELY + (1 - LIKELY) / 256)
        forest = _Forest(ids)
        for at in range(0, len(left), 64):
            rows_ = left[at : at + 64]
            agree = (sig[rows_, None, :] == sig[None, right, :]).sum(2)
            likely = (agree >= least) & (root[rows_, None] != root[None, right])
            for x in np.flatnonzero(likely.any(1)):
                forest.join(rows_[x], right[likely[x]])
        yield from forest.edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def flush() -> pa.RecordBatch:
            return _pairs(list(set(compare(group))) if len({g[5] for g in group}) > 1 else [], arrow)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[-1][:3] != row[:3]:
                    if len(group) > 1:
                        yield flush()
                    group = []
                group.append(row)
        if len(group) > 1:
            yield flush()

    return rows.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _inside(clusters: DataFrame, roots: DataFrame, texts: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """All links between different groups of one cluster, as a forest a block: (id, root of the cluster) to (a, b).

    sizes: (id, n).  A block holds about SHINGLES shingles, or one document.
    """
    kind, arrow = clusters.schema["id"].dataType.simpleString(), arrow_type(clusters, "id")
    heads = clusters.select(F.col("root").alias("id"), "root").distinct()
    members = clusters.unionByName(heads).withColumnRenamed("root", "cluster")
    blocks = members.join(sizes, "id").groupBy("cluster").agg(F.ceil(F.sum("n") / SHINGLES).cast("int").alias("blocks"))
    members = members.join(blocks, "cluster").join(roots.withColumnRenamed("root", "grp"), "id", "left").withColumn("grp", F.coalesce("grp", "id"))
    rows = texts.join(members.hint("merge"), "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "grp", "text")
    rows = rows.repartition(parts(texts.sparkSession), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "own", "id")

    def count(key: tuple, own: list, ids: list, groups: list, sets: list[np.ndarray]) -> list[tuple]:
        sizes = np.array([x.shape[1] for x in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        element = np.concatenate(sets, 1)
        by = np.lexsort((element[1], element[0]))
        owner, element = owner[by], element[:, by]
        first = np.flatnonzero(np.append(True, (element[:, 1:] != element[:, :-1]).any(0)))
        length = np.diff(np.append(first, len(by)))
        names = np.repeat(np.arange(len(first)), length)
        place = np.empty(len(by), np.int64)
        place[by] = names  # each element's posting list
        starts = np.cumsum(sizes) - sizes
        group = np.unique(np.array(groups), return_inverse=True)[1]
        forest, side = _Forest(ids, group), np.array(own)
        for x in np.flatnonzero(side == key[1]) if key[1] != key[2] else range(len(sets)):
            mine = place[starts[x] : starts[x] + sizes[x]]
            n = length[mine]
            hits = owner[np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            common = np.bincount(hits, minlength=len(sets))
            linked = 100 * common >= 75 * (sizes + sizes[x] - common)
            linked &= (common > 0) & (forest.tree != forest.tree[x])
            forest.join(x, np.flatnonzero(linked))
        return forest.edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [], [], [])

        def flush() -> pa.RecordBatch:
            return _pairs(count(at, *held) if len(set(held[2])) > 1 else [], arrow)

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
            for key, own, name, group, elements in zip(keys, *(batch.column(c).to_pylist() for c in (3, 4, 5)), shingle_sets(batch.column(6)), strict=True):
                if key != at:
                    if at is not None:
                        yield flush()
                    at, held = key, ([], [], [], [])
                for column, value in zip(held, (own, name, group, elements), strict=True):
                    column.append(value)
        if at is not None:
            yield flush()

    return scratch.keep(rows.mapInArrow(run, f"a {kind}, b {kind}"), "inside")


def near_duplicates(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept), a row for each row.

    component_id: smallest id reachable over links; kept: it is the own id.
    Null or empty text, or text without words: an empty set, linked with
    nothing.  A null id is linked with nothing either: null component, kept.
    Rows of one id are one node, linked by any of their texts.  An empty frame
    gives an empty frame; further columns are left out.
    """
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    all_ = scratch.keep(sketch(df, id_col, text_col), "sketches")
    usable = all_.where("n > 0 and id is not null")
    # 1. one class for each set
    classes = usable.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.min_by("sig", "id").alias("sig"), F.min_by("bands", "id").alias("bands"))
    classes = scratch.keep(classes, "classes")
    copies = usable.select("id", "n", "s1", "s2").join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    # 2. each bucket's members against its smallest
    members = classes.select(F.col("rep").alias("id"), F.explode("bands").alias("key"))
    leads = members.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a != z").select("key", "a")
    shared = scratch.keep(members.join(leads, "key").select("key", "id", "a"), "buckets")  # buckets of several members
    release(df.sparkSession)
    links = verify(shared.groupBy("id").agg(F.min("a").alias("a")).where("id != a").select("a", F.col("id").alias("b")), texts, scratch)
    release(df.sparkSession)
    roots = components(links, scratch)
    # 3. what is left between groups of one bucket
    buckets = shared.select("key", "id").join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    likely = scratch.keep(_between(buckets, classes.select(F.col("rep").alias("id"), "sig"), kind), "likely")
    release(df.sparkSession)
    if not likely.isEmpty():
        links = links.unionByName(_inside(components(likely, scratch), roots, texts, usable.select("id", "n"), scratch))
        release(df.sparkSession)
    roots = components(links.unionByName(copies), scratch)
    out = all_.select("id", "n").join(roots, "id", "left")
    component = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
