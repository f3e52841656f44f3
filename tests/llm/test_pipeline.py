"""The pipeline's stages against plain code that shares nothing with the operators but their constants, and queries against their SQL."""

import base64
import hashlib
import os
import sys

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from compare import rows_of, rows_of_sql  # noqa: E402
from test_dedup import groups  # noqa: E402

from changeloom.llm import crf, decontam, queries  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF_SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF_SMALL}/{f}'")
    assert rows_of(queries.queries()[name](spark, SF_SMALL)) == rows_of_sql(con, queries.oracle_sql()[name])


def plain_lines(text: str) -> list[tuple[list[float], int]]:
    """Each line's statistics, counted byte by byte, and its bytes."""
    out = []
    for line in (text or "").encode().split(b"\n"):
        count = dict.fromkeys(("lower", "upper", "digit", "space", "stop", "bang", "pipe", "symbol", "wide", "rest"), 0)
        for c in line:
            ch = chr(c)
            kind = "wide" if c >= 192 else "rest" if c >= 128 else "lower" if "a" <= ch <= "z" else "upper" if "A" <= ch <= "Z" else "digit" if ch.isdigit() else "space" if ch in "\t\x0b\x0c\r " else "stop" if ch in ".,;:'\"-()?" else "bang" if ch == "!" else "pipe" if ch == "|" else "symbol" if ch in "#$%&*+/<=>@[\\]^_`{}~" else "rest"
            count[kind] += 1
        words, size = line.lower().replace(b"\t", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" "), len(line)
        words = [w for w in words if w]
        again = sum(a == b for a, b in zip(words, words[1:], strict=False))
        width, letters, n = max(size, 1), max(count["lower"] + count["upper"] + count["wide"], 1), count["space"] + 1
        shares = [count["upper"] / letters] + [count[k] / width for k in ("symbol", "digit", "bang", "pipe", "stop", "wide", "space", "rest")]
        out.append(([*shares, size, size / n, again / n], size))
    return out


def plain_quality(text: str, model: crf.Model) -> float:
    """The document's score by loops over its lines and a forward and a backward pass."""
    edges = [crf._EDGES] * 9 + [crf._SIZE_EDGES, crf._WORD_EDGES, crf._EDGES]
    lines = plain_lines(text)
    bins = [[int(sum(v >= e for e in own)) for v, own in zip(stats, edges, strict=True)] for stats, _ in lines]

    def potential(table, b):
        return sum(table[k, x] for k, x in enumerate(b))

    score = []
    for t, b in enumerate(bins):
        s = potential(model.own, b)
        s += potential(model.before, bins[t - 1]) if t else 0
        s += potential(model.after, bins[t + 1]) if t + 1 < len(bins) else 0
        score.append(s)
    e = [np.exp(np.array([-1, 1]) * np.clip(s, -30, 30) / 2) for s in score]
    m = np.exp(model.move)
    forward, backward = [e[0] / e[0].sum()], [np.ones(2)]
    for t in range(1, len(e)):
        a = (forward[-1] @ m) * e[t]
        forward.append(a / a.sum())
        b = m @ (e[len(e) - t] * backward[-1])
        backward.append(b / b.sum())
    good = [(f * b)[1] / (f * b).sum() for f, b in zip(forward, backward[::-1], strict=True)]
    weight = [size + 1 for _, size in lines]
    x = sum(g * w for g, w in zip(good, weight, strict=True)) / sum(weight)
    a, b = model.curve
    return 1 / (1 + np.exp(-(a * x + b)))


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    stages = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontaminate", "encode"] and cp.ORACLE_SQL is None

    def texts(df):
        return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}

    # 1. lines, marginals and the curve by hand
    model = crf.train(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    before, good = texts(docs), stages["quality"](spark, docs, SF_SMALL).cache()
    after, score = texts(good), {i: plain_quality(t, model) for i, t in before.items()}
    assert good.columns == docs.columns
    assert {i for i, x in score.items() if x >= 0.5 + 1e-9} <= set(after) <= {i for i, x in score.items() if x >= 0.5 - 1e-9}
    # 2. all pairs of sets
    before, one = after, stages["near_dedup"](spark, good, SF_SMALL).cache()
    after = texts(one)
    assert set(after) == {i for i, _, _, kept in groups(sorted(before.items())) if kept} and one.columns == docs.columns
    # 3. the SQL of the operator, over the stage's own input
    con, before, cut = duckdb.connect(), after, stages["substring_dedup"](spark, one, SF_SMALL).cache()
    con.register("documents", pa.table({"doc_id": list(before), "text": list(before.values())}))
    want = con.execute(f"SELECT doc_id, text FROM ({queries.oracle_sql()['op10_lines']})").fetchall()
    after = texts(cut)
    assert after == dict(want) and cut.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    # 4. every item against every text by the exact distance
    before, clean = after, stages["decontaminate"](spark, cut, SF_SMALL).cache()
    items = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    known = decontam.Items(list(range(len(items))), items)
    leaky = set()
    for i, t in before.items():
        low = decontam.normalise(*decontam.byte_column(pa.array([t], pa.string())))[0].tobytes()
        if any(known.closest(n, low)[0] <= known.limits[n] for n in range(len(items))):
            leaky.add(i)
    after = texts(clean)
    assert set(after) == set(before) - leaky and clean.columns == docs.columns
    # 5. the library
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = stages["encode"](spark, clean, SF_SMALL).collect()
    assert {r.doc_id: (r.token_ids, r.n_tokens, r.decoded_sha256) for r in out} == {i: (x := lib.encode_ordinary(t), len(x), hashlib.sha256(t.encode()).hexdigest()) for i, t in after.items()}


def test_pipeline_on_odd_rows(spark, docs, tmp_path):
    """Stages take nulls, repeats, empty texts and further columns, also such that are called as their own."""
    import corpus_pipeline as cp

    labels = spark.createDataFrame([(0, 1), (11, 1)], "doc_id bigint, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("quality_score", "n_removed", "of_id", "text_hash", "removed_spans", "N_UNITS", "__id"):
        docs = docs.withColumn(name, docs.doc_id.cast("string"))
    for frame in (docs, docs.where("false")):
        out = frame
        for name, stage in cp.STAGES:
            new = stage(spark, out, str(tmp_path)).cache()
            if name != "encode":
                assert new.columns == docs.columns and all(r.quality_score == r.of_id == r["__id"] for r in new.collect())
            out = new
        assert (out.count() > 0) == (frame.count() > 0)
