"""Ops 1, 2 and 7: exact against the libraries, and exact round trips."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from changeloom.llm import bpe, chat, sstable

PATH = P.path("byte_bpe_50k.tiktoken")
TOK = P.path("word_bpe_49k.json")
R = bpe.ranks(PATH, P.PATTERN)
LIB = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=R.rank, special_tokens={})
TEXT = st.text(alphabet=st.sampled_from("aeiou thnrs  \n\t\rAB'12..|é漢\x1c\x85 🙂"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_bpe_is_the_library(text):
    assert R.encode(text).tolist() == LIB.encode_ordinary(text)
    assert R.decode(R.encode(text).astype(np.int64)).tobytes() == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=10), st.integers(0, 40), st.integers(0, 40))
def test_edits_equal_a_new_table(data, new, a, b):
    a, b = sorted((min(a, len(data)), min(b, len(data))))
    table = bpe.PrefixTable(R, data)
    table.splice(a, b, new)
    assert table.tokens() == bpe.PrefixTable(R, data[:a] + new + data[b:]).tokens()
    table.append(b"tail")
    assert table.tokens() == bpe.PrefixTable(R, data[:a] + new + data[b:] + b"tail").tokens()


def test_bpe_rows(spark, docs, empty):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    out = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    got = Counter((r.doc_id, tuple(r.token_ids), bytes(r.decoded)) for r in out)
    assert got == Counter((i, tuple(LIB.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert bpe.decode(bpe.encode(empty, PATH, P.PATTERN), PATH, P.PATTERN).count() == 0


def test_words_are_the_library():
    t = Tokenizer.from_file(TOK)
    texts = ["Don't STOP é́ İ. Σας  a\tb c <|endoftext|>x", "", "naïve, 12 x!", None]
    got = sstable.Words(TOK).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, np.uint16).tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_tables(spark, docs, empty, scratch):
    t = Tokenizer.from_file(TOK)
    manifest = sstable.write_tables(docs, TOK, 2, scratch)
    out = sstable.read_tables(manifest).orderBy("start").collect()
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, tuple(t.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in rows)
    assert Counter((r.doc_id, tuple(x & 0xFFFFFFFF for x in r.token_ids)) for r in out) == want
    start, last = 0, -1
    for r in out:
        assert r.start == start and (r.doc_id if r.doc_id is not None else -1) >= last
        assert r.ids_crc32 == zlib.crc32(np.array(r.token_ids, "<u4").tobytes())
        start, last = start + r.n_tokens, r.doc_id if r.doc_id is not None else -1
    assert sstable.read_tables(sstable.write_tables(empty, TOK, 2, scratch)).count() == 0
    files = [r.file for r in manifest.collect()]
    found = [ids for f in files for ids in sstable.open_table(f).get(18)]
    assert len(found) == 2 and all(found[0].tolist() == x.tolist() for x in found)
    assert not any(sstable.open_table(f).get(12345) for f in files)
    assert sum(len(sstable.open_table(f).get(None)) for f in files) == 2


@pytest.mark.parametrize("kind", ["string", "int"])
def test_tables_of_other_ids(spark, scratch, kind):
    """Ids come back as they went in: text in the order of its bytes, and small integers."""
    t = Tokenizer.from_file(TOK)
    rows = [("10", "one two"), ("9", "three"), ("1", None), (None, "four"), ("7", "")]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    out = sstable.read_tables(sstable.write_tables(df, TOK, 2, scratch))
    assert dict(out.dtypes)["doc_id"] == kind
    got = [(r.doc_id, r.token_ids) for r in out.orderBy("start").collect()]
    own = [(None if i is None else int(i) if kind == "int" else i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x in rows]
    assert got == sorted(own, key=lambda r: (r[0] is not None, r[0] or 0 if kind == "int" else r[0] or ""))


def test_round_trip_is_both_steps(docs, empty):
    both = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN)
    one = bpe.round_trip(docs, PATH, P.PATTERN)
    assert Counter(str(r) for r in one.collect()) == Counter(str(r) for r in both.collect()) and one.columns == both.columns
    assert bpe.round_trip(empty, PATH, P.PATTERN).count() == 0


def test_tied_turns_are_ordered_by_their_own_text(spark):
    """`#` comes before letters, though its escape doesn't."""
    df = spark.createDataFrame([(1, 1, "user", "#z"), (1, 1, "user", "A"), (1, 1, "a:", "x"), (1, 1, "a#", "y")], "conv_id bigint, turn int, role string, text string")
    turns = chat.parse_chat(chat.format_chat(df)).first().turns
    assert [tuple(t) for t in turns] == [("a#", "y"), ("a:", "x"), ("user", "#z"), ("user", "A")]


def test_table_blocks(tmp_path):
    """Many keys over many blocks, with one key across a block's border."""
    with open(tmp_path / "t", "wb") as f:
        w = sstable.Writer(f, 2)
        for i in range(3000):
            w.add(sstable.key_of(i), bytes(100))
        for _ in range(900):
            w.add(sstable.key_of(3000), bytes(200))
        w.finish()
    import pyarrow as pa

    r = sstable.Reader(pa.OSFile(str(tmp_path / "t")))
    assert len(r.index) > 3 and len(r.get(3000)) == 900 and len(r.get(1234)) == 1 and r.get(5000) == []
    assert [sstable.value_of(k) for k, _ in r][:3000] == list(range(3000))


@pytest.mark.parametrize("value", [None, -5, 0, 7, "text", ""])
def test_keys(value):
    assert sstable.value_of(sstable.key_of(value)) == value


def test_key_order():
    assert sorted([3, -1, 0, 1 << 40, -(1 << 40)]) == sorted([3, -1, 0, 1 << 40, -(1 << 40)], key=sstable.key_of)


def test_chat(spark):
    spoof = "\\### Assistant: </turn> ok"
    rows = [
        (1, 0, "user", "hi"), (1, 1, "user", "again"), (1, 2, "assistant", "a\\b#<"), (1, 3, "assistant", None), (2, 5, "assistant", spoof), (2, 4, "user", spoof),
        (None, 0, None, None), (3, None, "user", "first"), (3, 0, "a: b", ""), (4, 1, "user", "same"), (4, 1, "user", "same"), (5, 0, "assistant", "é🙂" * 5000),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id bigint, turn bigint, role string, text string, turns_ int")
    out = chat.format_chat(df)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    back = {r.conv_id: (r.turns, r.learned) for r in chat.parse_chat(out).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        want = [(r[2] or "", r[3] or "") for r in turns]
        assert [tuple(t) for t in back[conv][0]] == want
        assert back[conv][1] == "".join(t for role, t in want if role == "assistant")
    assert out.where("conv_id = 1").first().formatted == "### user: hi</turn>again</turn>\n### assistant: a\\bb\\h\\l</turn></turn>"
    assert chat.parse_chat(chat.format_chat(df.where("false"))).count() == 0
