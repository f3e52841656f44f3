"""Ops 4, 5, 6 and 10 against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_corpus import corpus, prose

from changeloom.llm import decontam, lines, minhash, suffix

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(rows):
    """Component by brute force; null ids are alone."""
    sets, root = [(i, shingles(t)) for i, t in rows], {}
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, s) in enumerate(sets):
        for b, t in sets[n + 1 :]:
            if a is not None and b is not None and a != b and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    root = {i: find(i) for i in ids}
    return sorted(((i, len(s), root.get(i), i is None or root[i] == i) for i, s in sets), key=repr)


def test_minhash_corpus(docs, empty, scratch):
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs, scratch).collect()), key=repr)
    assert got == groups(corpus())
    assert minhash.near_duplicates(empty, scratch).count() == 0


def test_minhash_chains(spark, scratch):
    """Chains of near copies and a large group around one original, where few pairs are links."""
    r, rows = random.Random(3), []
    words = [f"w{i}" for i in range(100)]
    for n in range(12):  # each step changes one more word
        rows.append((n, " ".join(words)))
        words[8 * n] = f"v{n}"
    base = [f"b{i}" for i in range(120)]
    for n in range(60):
        copy = list(base)
        for _ in range(2):
            copy[r.randrange(120)] = f"c{r.random()}"
        rows.append((100 + n, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((tuple(x) for x in minhash.near_duplicates(df, scratch).collect()), key=repr) == groups(rows)


def test_shared_digests_of_one_first_half():
    """Sets are compared by both halves of a digest."""
    a = np.array([[3, 3, 9], [1, 2, 5]], np.uint64)
    for b, n in (([[3, 9], [2, 5]], 2), ([[3, 9], [4, 5]], 1), ([[3, 3], [1, 2]], 2), ([[1], [1]], 0)):
        b = np.array(b, np.uint64)
        assert minhash.common(a, b) == minhash.common(b, a) == n
    one, two = np.array([7, 7, 7, 2], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    assert minhash._distinct(one, two).T.tolist() == [[2, 1], [7, 1], [7, 2]]


@pytest.mark.parametrize("shingles", [500_000, 300])
def test_minhash_groups_in_blocks(spark, scratch, monkeypatch, shingles):
    """Many groups in common buckets, also where a cluster takes many blocks."""
    monkeypatch.setattr(minhash, "SHINGLES", shingles)
    r, rows = random.Random(5), []
    base = [f"b{i}" for i in range(150)]
    for n in range(80):
        copy = list(base)
        for _ in range(r.randrange(1, 8)):
            copy[r.randrange(150)] = f"c{r.random()}"
        rows.append((str(n), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted((tuple(x) for x in minhash.near_duplicates(df, scratch).collect()), key=repr) == groups(rows)


def test_signature_estimates_and_is_a_permutation():
    r = np.random.default_rng(2)
    a = r.integers(0, 2**63, 500).astype(np.uint64)
    b = np.concatenate([a[:400], r.integers(0, 2**63, 100).astype(np.uint64)])
    sig = minhash.signatures([a, b, a[:1], np.zeros(0, np.uint64)])
    assert abs((sig[0] == sig[1]).mean() - 400 / 600) < 0.15
    assert sorted((sig[2] >> np.uint64(56)).tolist()) == list(range(minhash.SLOTS))  # one element takes every slot once
    assert (sig[3] == np.uint64(2**64 - 1)).all()


def brute_repeats(rows):
    first, out = {}, []
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0))
    for n in order:
        i, text = rows[n]
        for p in range(len(b := (text or "").encode()) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            f = first[b[p : p + 50]]
            if f is not None and (i is None or f < i):
                gone[p : p + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_corpus(docs, empty, scratch, hot):
    """Also with every anchor treated as hot, window by window."""
    got = suffix.remove_repeats(docs, scratch, hot=hot).drop("spans", "kept").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_repeats(corpus())
    assert suffix.remove_repeats(empty, scratch).count() == 0


def test_suffix_records(spark, scratch, monkeypatch):
    """Records between batches, buckets and shards don't grow with batches times buckets."""
    sizes, keep, at_once = {}, scratch.keep, suffix.gathered

    def kept(df, name):
        out = keep(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(scratch, "keep", kept)
    monkeypatch.setattr(suffix, "gathered", lambda batches: (x.slice(i, 8) for x in at_once(batches) for i in range(0, x.num_rows, 8)))
    rows = [(n, prose(n, 60) + " " + prose(n % 40, 60)) for n in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    try:
        got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), scratch).drop("spans", "kept").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((tuple(x) for x in got), key=repr) == brute_repeats(rows)
    assert sizes["batches"] == 50
    assert sizes["codes"] <= 50 / 4 * 48 + 48  # one record a batch and bucket would be nearly 2,400


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_suffix_array(letters):
    r = random.Random(letters)
    for n in [*range(30), 200]:
        s = np.array([r.randint(1, letters) for _ in range(n)], np.int64)
        assert suffix.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_suffix_random(spark, scratch):
    """Short alphabets give many chance repeats of all lengths about the bound."""
    r = random.Random(9)
    pool = ["".join(r.choice("ab") for _ in range(r.randint(40, 70))) for _ in range(12)]
    rows = [(n, "".join(r.choice(pool)[r.randint(0, 6) :] for _ in range(r.randint(0, 6)))) for n in range(60)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), scratch).drop("spans", "kept").collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute_repeats(rows)


def edits(text, n, seed):
    r, c = random.Random(seed), list(text)
    for _ in range(n):
        p = r.randrange(len(c))
        c[p : p + 1] = r.choice([[], ["z"], [c[p], "q"]])
    return "".join(c)


def test_decontamination(spark, docs, empty):
    items = [(n, prose(100 + n, 30)) for n in range(8)] + [(90, None), (91, ""), (92, " \n "), (93, prose(100, 30))]
    rows = [(1, prose(50, 40) + " " + items[0][1] + " " + prose(51, 10)), (2, prose(52, 300)), (3, items[1][1].upper().replace(" ", "\n  ")), (4, None), (None, items[2][1]), (5, prose(53, 9) + " " + edits(items[3][1], 5, 1) + " x"), (6, edits(items[4][1], 80, 2)), (1, items[5][1])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.decontaminate(df, bench).collect()}
    assert set(got) == {(1, 0), (1, 93), (3, 1), (None, 2), (5, 3), (1, 5)}
    assert got[1, 0].distance == 0 and rows[0][1].encode()[got[1, 0].start : got[1, 0].stop].decode() == items[0][1]
    assert 0 < got[5, 3].distance <= 5
    assert decontam.decontaminate(df, bench.where("false")).count() == 0
    assert decontam.decontaminate(empty, bench).count() == 0
    assert decontam.decontaminate(docs, bench).count() == 0
    twice = decontam.decontaminate(df.unionByName(df).withColumn("doc_id", df.doc_id.cast("int")), bench.withColumn("item_id", bench.item_id.cast("int"))).collect()
    assert sorted(str((r.doc_id, r.item_id)) for r in twice) == sorted(2 * [str(k) for k in got])
    named = decontam.decontaminate(df.withColumn("doc_id", df.doc_id.cast("string")), bench.withColumn("item_id", bench.item_id.cast("string"))).collect()
    assert {(r.doc_id, r.item_id) for r in named} == {(None if d is None else str(d), str(i)) for d, i in got}


def levenshtein(a: bytes, region: bytes) -> int:
    row = [0] * (len(region) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(region):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_edit_distance():
    r = random.Random(4)
    for n in range(40):
        item = "".join(r.choice("abc ") for _ in range(r.randint(1, 30))).strip() or "a"
        region = "".join(r.choice("abc ") for _ in range(r.randint(0, 60))).encode()
        known = decontam.Items([0], [item])
        assert known.closest(0, region)[0] == min(levenshtein(known.bytes[0], region), len(known.bytes[0]))


def unspaced(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(n))


KINDS = {
    "4 words": [prose(300 + n, 4) for n in range(60)],
    "8 words": [prose(400 + n, 8) for n in range(60)],
    "40 words": [prose(500 + n, 40) for n in range(60)],
    "40 characters without spaces": [unspaced(n, 40) for n in range(60)],
    "one long word": ["".join(random.Random(n).choice("abcdefghij") for _ in range(90)) for n in range(60)],
}


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.15])
@pytest.mark.parametrize("kind", KINDS)
def test_decontamination_recall(kind, rate):
    """Planted items with edits all over, up to the bound: what the exact distance finds over all pairs is found."""
    items = KINDS[kind]
    known = decontam.Items(list(range(60)), items)
    texts = [prose(900 + n, 20) + " " + edits(t, int(len(t) * rate), n) + " " + prose(1900 + n, 20) for n, t in enumerate(items)]
    from changeloom.llm.shared import byte_column

    low, places, _ = decontam.normalise(*byte_column(pa.array(texts)))
    truth = {(d, i) for d in range(60) for i in range(60) if known.closest(i, low[places[d] : places[d + 1]].tobytes())[0] <= known.limits[i]}
    got = {(d, i) for d, i, *_ in known.leaks(low, places)}
    assert got <= truth and len(truth) > 40 and len(got) >= 0.95 * len(truth)


def test_decontamination_of_a_corpus(spark):
    """All pairs of documents and items of the test tables by the exact distance."""
    base = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/benchmark.parquet")
    rows = docs.select("doc_id", "text").limit(120).collect()
    items = bench.select("item_id", "text").collect()
    known = decontam.Items([r.item_id for r in items], [r.text for r in items])
    from changeloom.llm.shared import byte_column

    truth = {}
    for r in rows:
        low, _, _ = decontam.normalise(*byte_column(pa.array([r.text], pa.string())))
        for n, i in enumerate(items):
            if (d := known.closest(n, low.tobytes())[0]) <= known.limits[n]:
                truth[r.doc_id, i.item_id] = d
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.decontaminate(docs.where(docs.doc_id.isin([r.doc_id for r in rows])), bench).collect()}
    assert got == truth


def test_regions_in_step():
    """Distances in step, on several words of 64 bits, are those found alone."""
    r = random.Random(6)
    items = ["".join(r.choice("abc ") for _ in range(n)).strip() + "x" for n in (1, 5, 62, 63, 64, 65, 127, 128, 129, 300)]
    known = decontam.Items(list(range(len(items))), items)
    low = np.frombuffer("".join(edits(x, len(x) // 9, n) + "cab" for n, x in enumerate(items * 3)).encode(), np.uint8)
    item = np.array([r.randrange(len(items)) for _ in range(80)])
    from_ = np.array([r.randrange(len(low)) for _ in range(80)])
    to = np.minimum(from_ + np.array([r.randrange(500) for _ in range(80)]), len(low))
    distance, stop = known._closest_many(item, low, from_, to)
    for n in range(80):
        have, want = (int(distance[n]), int(stop[n])), known.closest(int(item[n]), low[from_[n] : to[n]].tobytes())
        assert have[0] == want[0] and (want[0] == 0 or have == want)


def test_long_items_are_found_in_little_memory():
    item = prose(1, 4000)
    known = decontam.Items([1], [item])
    from changeloom.llm.shared import byte_column

    low, places, _ = decontam.normalise(*byte_column(pa.array(["x", prose(2, 30) + edits(item, 1000, 3) + prose(3, 30), None])))
    assert known.sizes[0] > 20_000 and [x[:2] for x in known.leaks(low, places)] == [(1, 0)]
    assert known.moves.nbytes < 20 << 20


def test_decontamination_samples_decide():
    """Windows of other texts are rejected, whatever the longest item is, and samples don't depend on it."""
    from changeloom.llm.shared import byte_column

    items = [prose(500 + n, 40) for n in range(40)]
    known = decontam.Items(list(range(40)), items)
    low, places, _ = decontam.normalise(*byte_column(pa.array([prose(3000 + n, 80) for n in range(400)])))
    for some in (np.arange(400) % 40, np.full(400, known.sizes.argmax())):
        passed = (known.embed(low, places[:-1], some) == known.samples[some]).all(2).any(1)
        assert passed.mean() < 0.6
    itself = known.embed(known.low, known.starts, np.arange(40))
    assert (itself == known.samples).all()
    more = decontam.Items(list(range(41)), [*items, prose(7, 90)])
    assert (more.samples[:40] == known.samples).all()


def brute_lines(rows, min_words):
    """The rule by itself: units, keys of the words of a unit and of those before it, first in rank order stays."""
    seen, gone, parts = set(), {}, {}
    for null, i, t in sorted({(i is None, i or 0, t) for i, t in rows if t is not None}, key=lambda x: (x[0], x[1])):
        parts[t] = units = [u for u in re.split(r"(?<=[.?!] )|(?<=\n)", t) if u]
        words, marks = [], gone.setdefault((null, i, t), [])
        for n, u in enumerate(units):
            if not u.split():
                continue
            words.append(u.lower().split())
            own, back = words[-1], len(words) - 1
            while len(own) < min_words and back:
                back -= 1
                own = words[back] + own
            if len(own) >= min_words:
                if " ".join(own) in seen:
                    marks.append(n)
                seen.add(" ".join(own))
    out = []
    for i, t in rows:
        marks = gone.get((i is None, i or 0, t), [])
        out.append((i, None if t is None else "".join(u for n, u in enumerate(parts[t]) if n not in marks), len(marks)))
    return sorted(out, key=repr)


def test_short_copies_go_where_every_unit_counts(spark, scratch):
    """min_words=1 has no unit that is too short."""
    rows = [(1, "two words"), (2, "two  WORDS"), (3, "one. two words"), (4, "other? two words! x"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in lines.dedup(df, scratch, min_words=1).collect()), key=repr)
    assert got == brute_lines(rows, 1) and [r[1] for r in got] == ["two words", "", "one. ", "other? two words! x", ""]
    assert [r.n_removed for r in lines.dedup(df, scratch).collect()] == [0] * 5


@pytest.mark.parametrize("min_words", [lines.MIN_WORDS, 3])
def test_lines_corpus(docs, empty, scratch, min_words):
    got = lines.dedup(docs, scratch, min_words=min_words).collect()
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got), key=repr) == brute_lines(corpus(), min_words)
    assert {r.score for r in got} == {"x"}
    texts = {(i, t) for i, t in corpus() if t}
    for r in got:
        whole = [t for i, t in texts if i == r.doc_id and t]
        if r.removed_spans:
            keep, at = "", 0
            for s in r.removed_spans:
                keep, at = keep + whole[0][at : s.start], s.stop
            assert keep + whole[0][at:] == r.text
    assert lines.dedup(empty, scratch).count() == 0


def test_lines_cut():
    assert lines.cut("a. b? c! d\ne.f") == ["a. ", "b? ", "c! ", "d\n", "e.f"]
    for t in ("", "a", "a\n", "\n\na. b. \nc", "x. . y", "! ? . "):
        assert "".join(lines.cut(t)) == t


def test_decontamination_memory(monkeypatch):
    """Binning holds the hits of a few items at once, not of all, and proposes the same windows."""
    import tracemalloc

    from changeloom.llm.shared import byte_column

    items = [t for kind in ("8 words", "40 words") for t in KINDS[kind]]
    known = decontam.Items(list(range(len(items))), items)
    body = prose(21, 20_000)
    texts = [f"{body[9 * n :]} {edits(items[n], 3, n)} {body[: 5 * n]}" for n in range(20)]
    low, places, _ = decontam.normalise(*byte_column(pa.array(texts)))
    hits = len(known._hits(low))
    assert hits > 8 * decontam.HITS
    tracemalloc.start()
    got = known.windows(low, places)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * hits + 256 * decontam.HITS
    for bound in (1, 1000, hits):
        monkeypatch.setattr(decontam, "HITS", bound)
        assert all(np.array_equal(a, b) for a, b in zip(got, known.windows(low, places), strict=True))
    assert set(range(20)) <= {int(t) for t, i in zip(*got[:2], strict=True) if t == i}
