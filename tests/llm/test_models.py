"""Ops 3, 8, 9 and the pipeline."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from llm_corpus import corpus
from pyspark.sql import functions as F

from changeloom.llm import ann, crf, hmm, minhash
SF_SMALL = "/root/testdata/sf0.001"

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact(rows, queries, k):
    """The k nearest by brute force: {query: [(score, id), …]}."""
    out = {}
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    for i, v in usable:
        if i in queries:
            best = {}
            for j, w in usable:
                if j != i and len(w) == len(v):
                    best[j] = max(best.get(j, -2), float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)))
            out[i] = sorted(((-round(s, 9), j) for j, s in best.items()))[:k]
    return out


def test_neighbours_edges(spark, scratch):
    r = np.random.default_rng(0)
    rows = [(n, r.normal(size=6).tolist()) for n in range(60)]
    rows += [(100 + n, rows[7][1]) for n in range(40)]  # a vector with many rows: ties by id
    rows += [(200, None), (201, []), (202, [0.0] * 6), (203, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (204, [float("nan")] * 6), (205, [float("inf")] * 6), (206, [1.0, 2.0]), (207, [2.0, 1.0]), (None, [1.0] * 6), (3, rows[3][1])]
    df = spark.createDataFrame([(*x, "c") for x in rows], "vec_id bigint, embedding array<double>, shard string")
    asked = {7, 0, 20, 100, 200, 202, 206}
    got = {}
    for x in ann.nearest(df, F.col("vec_id").isin(*asked), 5, scratch).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((-round(x.score, 9), x.vec_id))
    assert got == exact(rows, asked, 5)
    assert ann.nearest(df.where("false"), F.lit(True), 5, scratch).count() == 0


def test_neighbours_recall(spark, scratch):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = [(x.vec_id, list(x.embedding) if x.embedding is not None else None) for x in df.collect()]
    want = exact(rows, {i for i, _ in rows if i % 10 == 0}, 5)
    got = {}
    for x in ann.nearest(df, F.col("vec_id") % 10 == 0, 5, scratch).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    hits = sum(len(got[q] & {j for _, j in w}) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_hashes_of_a_vector_are_independent(spark):
    rows = ann.usable(spark.range(2000).selectExpr("id as vec_id", "array(cast(id as double), 1D) as embedding"), "vec_id", "embedding")
    from pyspark.sql.functions import expr

    assert rows.where(expr("xxhash64(1, v1)") == F.col("v2")).count() == 0 and rows.where(expr("xxhash64(v1, 1)") == F.col("v2")).count() == 0
    assert rows.select(F.xxhash64(F.lit(1), "vector").alias("x"), "v2").where("x = v2").count() == 2000


def test_shards_grow_with_the_data():
    assert [ann.shards_for(n, 8) for n in (0, 1, 4096, 4097, 8 * 65536, 80 * 65536)] == [1, 1, 1, 2, 8, 80]


def test_graph_is_pruned_and_connected():
    x = np.random.default_rng(1).normal(size=(700, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, start = ann.build(x, degree=12, width=32)
    seen, todo = {start}, [start]
    while todo:
        for n in graph[todo.pop()]:
            if n >= 0 and n not in seen:
                seen.add(int(n))
                todo.append(int(n))
    assert len(seen) >= 0.99 * len(x) and all((row[row >= 0] != n).all() for n, row in enumerate(graph))


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD)) + [None]


def test_language_model_counts(docs, empty, scratch):
    rows = corpus()
    count = Counter(w for i, t in rows if not hmm.held_out(i) for w in tokens(t))
    total, words = sum(count.values()), len(count)
    want = Counter((i, hmm.held_out(i), len(w := tokens(t)), sum(count[x] > 0 for x in w), total, round(sum(math.log10((count[x] + 1) / (total + words + 1)) for x in w), 6)) for i, t in rows)
    out = hmm.score(docs, scratch).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    assert hmm.score(empty, scratch).count() == 0


def test_likelihood_is_the_sum_over_paths():
    r = np.random.default_rng(5)
    move = r.random((hmm.STATES, hmm.STATES))
    first = r.random(hmm.STATES)
    m = hmm.Model(move / move.sum(1, keepdims=True), first / first.sum(), np.ones(hmm.STATES), np.ones(hmm.STATES), 1, 1)
    lengths = np.array([1, 3, 2 * hmm.RUN + 5, 1])
    e = r.random((lengths.sum(), hmm.STATES))
    got, at = hmm.likelihood(e.T, lengths, m), 0
    for n, have in zip(lengths, got, strict=True):
        a, log = m.first * e[at], 0.0
        for t in range(at + 1, at + n):
            log += math.log10(a.sum())
            a = (a / a.sum() @ m.move) * e[t]
        assert abs(log + math.log10(a.sum()) - have) < 1e-8 * max(1, abs(have))
        at += n


def test_emissions_are_a_distribution():
    r = np.random.default_rng(3)
    count = r.integers(1, 50, 200).astype(float)
    share = r.dirichlet(np.ones(hmm.STATES) * 0.3, 200)
    own = count[:, None] * share
    m = hmm.Model(np.eye(hmm.STATES), np.ones(hmm.STATES), own.sum(0), np.minimum(own, 1).sum(0), int(count.sum()), 200)
    known = hmm.emissions(m, count, share).sum(0)
    assert np.allclose(known + hmm.emissions(m, np.zeros(1), share[:1])[0], 1, atol=0.01)


def plain_expectation(e, lengths, m):
    """Posteriors, moves, first states and log likelihood by one pass forward and one backward over each whole document."""
    posterior, moves, firsts, log, at = [], np.zeros((hmm.STATES, hmm.STATES)), np.zeros(hmm.STATES), 0.0, 0
    for n in lengths:
        own, a, c = e[at : at + n], [m.first * e[at]], []
        for t in range(n):
            if t:
                a.append((a[-1] @ m.move) * own[t])
            c.append(a[-1].sum())
            a[-1] = a[-1] / c[-1]
        b = [np.ones(hmm.STATES)]
        for t in range(n - 1, 0, -1):
            moves += a[t - 1][:, None] * m.move * (own[t] * b[-1])[None] / c[t]
            b.append(m.move @ (own[t] * b[-1]) / c[t])
        p = np.array(a) * np.array(b[::-1])
        posterior.append(p / p.sum(1, keepdims=True))
        firsts += posterior[-1][0]
        log += np.log(c).sum()
        at += n
    return np.concatenate(posterior), moves, firsts, log


def test_expectation_is_that_of_whole_documents(monkeypatch):
    """Runs that documents are cut into change nothing."""
    monkeypatch.setattr(hmm, "RUN", 7)
    r = np.random.default_rng(8)
    move = r.random((4, 4)) + np.eye(4)
    m = hmm.Model(move / move.sum(1, keepdims=True), np.array([0.1, 0.2, 0.3, 0.4]), np.ones(4), np.ones(4), 1, 1)
    for lengths in (np.array([40, 1, 7, 8, 14, 3, 100, 6]), np.array([5, 2]), np.zeros(0, np.int64)):
        e = r.random((lengths.sum(), 4)) ** 4
        p, moves, firsts, log = hmm.expect(e.T, lengths, m)
        if len(lengths):
            want = plain_expectation(e, lengths, m)
            assert np.allclose(p.T, want[0]) and np.allclose(moves, want[1]) and np.allclose(firsts, want[2]) and abs(log - want[3]) < 1e-9
            better = hmm.Model(moves / moves.sum(1, keepdims=True), firsts / firsts.sum(), m.total, m.types, 1, 1)
            assert hmm.likelihood(e.T, lengths, better).sum() > hmm.likelihood(e.T, lengths, m).sum()


def test_training_is_baum_welch_in_one_process(spark, scratch):
    """The exchanged counts, rounds and scores against loops over all documents with all words in memory."""
    rows = [(n, t) for n, t in enumerate(x.text for x in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").limit(60).collect())] + [(900, None), (901, "odd words here " * 300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    centres = hmm.centres(df, scratch, "doc_id", "text")
    words = [tokens(t) for _, t in rows]
    names = {w: k for k, w in enumerate({w for own in words for w in own})}
    at = [np.array([names[w] for w in own]) for own in words]
    train = [not hmm.held_out(i) for i, _ in rows]
    state = hmm._nearest(hmm._histograms(pa.array([t for _, t in rows], pa.string())), centres)

    def model(own, moves, firsts):
        move, first = moves + 0.5 + 50 * np.eye(4), firsts + 1
        count = own.sum(1)
        return count, own / np.maximum(count, 1e-300)[:, None], hmm.Model(move / move.sum(1, keepdims=True), first / first.sum(), own.sum(0), np.minimum(own, 1).sum(0), int(round(count.sum())), int((count > 0).sum()))

    own, moves, firsts = np.zeros((len(names), 4)), np.zeros((4, 4)), np.zeros(4)
    for a, s, use in zip(at, state, train, strict=True):
        if use:
            np.add.at(own[:, s], a, 1)
            moves[s, s] += len(a) - 1
            firsts[s] += 1
    count, share, m = model(own, moves, firsts)
    last, rounds = -np.inf, 0
    while rounds < hmm.ROUNDS:
        rounds += 1
        e = hmm.emissions(m, count, share)
        some = np.concatenate([a for a, use in zip(at, train, strict=True) if use])
        p, moves, firsts, log = plain_expectation(e[some], [len(a) for a, use in zip(at, train, strict=True) if use], m)
        own = np.stack([np.bincount(some, p[:, k], len(names)) for k in range(4)], 1)
        count, share, m = model(own, moves, firsts)
        if rounds >= hmm.LEAST and log - last <= hmm.SETTLED * abs(log):
            break
        last = log
    e = hmm.emissions(m, np.rint(count), share)
    got = {r.doc_id: r.score for r in hmm.score(df, scratch).collect()}
    for (i, _), a in zip(rows, at, strict=True):
        want = plain_expectation(e[a], [len(a)], m)[3] / math.log(10)
        assert abs(got[i] - want) <= 1e-3 * abs(want), i


def test_counts_beyond_32_bits():
    words, expected = np.array([5], np.uint64), np.array([[1.0, 1, 1, 0]])
    sent = pa.Table.from_batches([b for n in range(3) for b in hmm._send(n, words, np.array([4_000_000_000]), expected, [0.0], 1)]).filter(pa.compute.field("bucket") >= 0)
    back = hmm._merge(sent).filter(pa.compute.field("batch") >= 0)
    count, share = hmm._answers(back.slice(0, 1))
    assert count.tolist() == [12_000_000_000] and np.allclose(share, [[1 / 3, 1 / 3, 1 / 3, 0]], atol=1e-6)


def test_letters_that_a_polynomial_takes_for_equal(spark, scratch):
    """The two Thue-Morse words of 1,024 letters are different words."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    learned, held = (next(i for i in range(99) if hmm.held_out(i) == x) for x in (False, True))
    df = spark.createDataFrame([(learned, word), (held, other)], "doc_id bigint, text string")
    assert {r.doc_id: r.n_known for r in hmm.score(df, scratch).collect()} == {learned: 2, held: 1}
    df = spark.createDataFrame([(1, word), (4, other)], "doc_id int, text string")
    assert {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(df, scratch).collect()} == {1: (1, True), 4: (4, True)}


def test_starting_states_are_means_of_all_documents(spark, scratch, monkeypatch):
    monkeypatch.setattr(hmm, "SAMPLE", 8)
    r = np.random.default_rng(2)
    texts = ["".join(r.choice(list(letters), 60)) for letters in ("abcd ", "efgh ", "ijkl ", "mnop ") for _ in range(40)]
    rows = [(n, t) for n, t in enumerate(texts)] + [(None, "mmmm nnnn")]
    c = hmm.centres(spark.createDataFrame(rows, "doc_id bigint, text string"), scratch, "doc_id", "text")
    x = hmm._histograms(pa.array([t for i, t in rows if not hmm.held_out(i)]))
    own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    for k in range(hmm.STATES):
        assert (own == k).any() and np.allclose(c[k], x[own == k].mean(0), atol=2e-3)


def test_small_expected_counts_survive_the_exchange():
    words = np.array([5, 9], np.uint64)
    expected = np.array([[999.0, 1.0, 0, 0], [10.0, 0, 30, 0]])
    sent = pa.Table.from_batches(list(hmm._send(0, words, expected.sum(1), expected, [0.0], 1))).filter(pa.compute.field("bucket") >= 0)
    stats = hmm._merge(sent)["stats"].to_pylist()[-1]
    assert np.allclose(stats[2 : 2 + hmm.STATES], expected.sum(0), atol=0.05)


def test_rounds_follow_until_the_likelihood_settles(docs, scratch, monkeypatch):
    names, keep = [], scratch.keep
    monkeypatch.setattr(scratch, "keep", lambda df, name: names.append(name) or keep(df, name))
    hmm.score(docs, scratch).count()
    assert hmm.LEAST <= sum(n.startswith("sent-round") for n in names) <= hmm.ROUNDS


def test_language_model_beats_unigrams(spark, scratch):
    out = hmm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), scratch).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = crf.score(docs.select("doc_id", "text"), crf.train(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in held]) > 0.93
    assert all(0 <= r.score <= 1 for r in out)


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (0, None), (2, 0), (3, 1), (11, 5), (None, 1)], "doc_id bigint, quality int")
    model = crf.train(docs, labels)
    out = crf.score(docs, model).collect()
    assert len(out) == len(corpus()) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if not r.text}) == 1  # null and empty texts alike
    assert crf.score(empty, model).count() == 0
    assert crf.score(docs, crf.train(docs, labels.where("false"))).where("score < 0.5").count() == 0


def test_marginals_by_enumeration():
    from itertools import product

    r = np.random.default_rng(4)
    lengths = np.array([1, 4, 2])
    s, move = r.normal(size=7), r.normal(size=(2, 2))
    p, _ = crf.marginals(s, lengths, move)
    at = 0
    for n in lengths:
        weight = {y: math.exp(sum((1 if v else -1) * s[at + t] / 2 for t, v in enumerate(y)) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False))) for y in product((0, 1), repeat=int(n))}
        z = sum(weight.values())
        for t in range(n):
            assert abs(sum(w for y, w in weight.items() if y[t]) / z - p[at + t]) < 1e-9
        at += n


def test_lines_of_bytes():
    bins, weight, lengths = crf.lines_of(pa.array(["ab\ncd", None, "", "x\n\n", "é!"]))
    assert lengths.tolist() == [2, 1, 1, 3, 1] and weight.tolist() == [3, 3, 1, 1, 2, 1, 1, 4] and len(bins) == 8
