"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.llm import ann, bpe, chat, crf, decontam, hmm, lines, minhash, sstable, suffix
from changeloom.llm.shared import Scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's byte-level BPE ids and the bytes that they decode to, as digests."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.round_trip(_read(spark, sf_dir, "documents"), path, pattern).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's word-BPE ids, written to sorted token tables and read back from them."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    manifest = sstable.write_tables(_read(spark, sf_dir, "documents"), tokenizer, 2, Scratch(spark, "op2"))
    return sstable.read_tables(manifest).drop("token_ids")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector."""
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5, Scratch(spark, "op3"))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes without 50-byte strings of smaller documents, as digests."""
    return suffix.remove_repeats(_read(spark, sf_dir, "documents"), Scratch(spark, "op4")).drop("kept", "spans")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate group."""
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), Scratch(spark, "op5"))


def op6_cgk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaked benchmark items: doc_id, item_id, edit distance, byte range."""
    return decontam.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the control conversation -7, formatted and read back."""
    spoof = r"\### Assistant: </turn> ok"
    control = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(spoof).alias("text"),
    )
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    out = chat.format_chat(rows)
    back = chat.parse_chat(out.withColumn("conv_id", F.struct("conv_id", F.length("formatted").cast("long").alias("formatted_chars"))))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        F.col("conv_id.conv_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "conv_id.formatted_chars",
    )


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the hidden Markov model, beside the unigram's."""
    return hmm.score(_read(spark, sf_dir, "documents"), Scratch(spark, "op8"))


def op9_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by a chain of its lines."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = crf.train(docs, _read(spark, sf_dir, "labels"))
    return crf.score(docs, model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the units that came before, and where they were: start-stop in code points, joined by commas."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.dedup(docs, Scratch(spark, "op10"))
    spans = F.array_join(F.transform("removed_spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"))), ",")
    return out.select("doc_id", "n_units", "n_removed", spans.alias("removed_spans"), F.sha2("text", 256).alias("kept_sha256"), "text")


_ORACLE_OP7 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), esc AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l') AS body,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n
  FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(body) + 7 + CASE WHEN before = role THEN 0
      ELSE 6 + length(role) + (CASE WHEN n > 1 THEN 1 ELSE 0 END) END)::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id
"""

_ORACLE_OP5 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM words
), items AS (
  SELECT doc_id, unnest(s) AS x FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
  WHERE 100 * n >= 75 * (len(p.s) + len(q.s) - n)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS c FROM sets
  UNION
  SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.c = edges.a
)
SELECT doc_id, any_value(len(s))::BIGINT AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept
FROM reach JOIN sets USING (doc_id) GROUP BY doc_id
"""

_ORACLE_OP4 = r"""
WITH b AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (
  SELECT doc_id, o, substr(h, 2 * o + 1, 610) AS h FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0), 256)) AS o FROM b)
), w AS (
  SELECT doc_id, o + i AS p, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, o, h, unnest(range(0, least(len(h) // 2 - 49, 256))) AS i FROM blocks)
), f AS (
  SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1
), hit AS (
  SELECT w.doc_id, p, lag(p) OVER (PARTITION BY w.doc_id ORDER BY p) AS before FROM w JOIN f ON w.s = f.s WHERE m < w.doc_id
), runs AS (
  SELECT *, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hit
), spans AS (
  SELECT doc_id, run, min(p) AS start, max(p) + 50 AS stop FROM runs GROUP BY ALL
), kept AS (
  SELECT doc_id, start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS from_ FROM spans
), pieces AS (
  SELECT doc_id, string_agg(substr(h, CAST(2 * from_ + 1 AS BIGINT), CAST(2 * (start - from_) AS BIGINT)), '' ORDER BY start) AS head, max(stop) AS tail, sum(stop - start) AS gone, count(*) AS n
  FROM kept JOIN b USING (doc_id) GROUP BY doc_id
)
SELECT b.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(tail, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM b LEFT JOIN pieces ON b.doc_id = pieces.doc_id
"""

_ORACLE_OP10 = r"""
WITH cut AS (
  SELECT doc_id, text, list_filter(string_split(replace(replace(replace(replace(text, '. ', '. ' || chr(1)), '? ', '? ' || chr(1)), '! ', '! ' || chr(1)), chr(10), chr(10) || chr(1)), chr(1)), lambda x: x <> '') AS units FROM documents
), unit AS (
  SELECT doc_id, place, u, sum(length(u)) OVER w AS stop, list_filter(string_split_regex(lower(u), '\s+'), lambda x: x <> '') AS words
  FROM (SELECT doc_id, unnest(units) AS u, generate_subscripts(units, 1) - 1 AS place FROM cut) WINDOW w AS (PARTITION BY doc_id ORDER BY place)
), worded AS (
  SELECT doc_id, place, len(words) AS n, array_to_string(words, ' ') AS t, row_number() OVER w AS k, sum(len(words)) OVER w AS c
  FROM unit WHERE len(words) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY place)
), back AS (
  SELECT a.doc_id, a.place, a.k, max(b.k) AS j FROM worded a JOIN worded b ON a.doc_id = b.doc_id AND b.k <= a.k AND b.k > a.k - 8 AND a.c - b.c + b.n >= 8 GROUP BY ALL
), keyed AS (
  SELECT back.doc_id, back.place, string_agg(w.t, ' ' ORDER BY w.k) AS key FROM back JOIN worded w ON w.doc_id = back.doc_id AND w.k BETWEEN back.j AND back.k GROUP BY ALL
), gone AS (
  SELECT doc_id, place FROM keyed QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, place) > 1
), marked AS (
  SELECT unit.doc_id, unit.place, u, stop, stop - length(u) AS start, gone.place IS NOT NULL AS off FROM unit LEFT JOIN gone ON unit.doc_id = gone.doc_id AND unit.place = gone.place
), runs AS (
  SELECT *, place - row_number() OVER (PARTITION BY doc_id, off ORDER BY place) AS run FROM marked
), spans AS (
  SELECT doc_id, string_agg(start || '-' || stop, ',' ORDER BY start) AS spans FROM (SELECT doc_id, min(start) AS start, max(stop) AS stop FROM runs WHERE off GROUP BY doc_id, run) GROUP BY doc_id
), texts AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (off) AS n_removed, coalesce(string_agg(u, '' ORDER BY place) FILTER (NOT off), '') AS text FROM marked GROUP BY doc_id
)
SELECT cut.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(spans, '') AS removed_spans,
  sha256(CASE WHEN n_units IS NULL THEN cut.text ELSE texts.text END) AS kept_sha256, CASE WHEN n_units IS NULL THEN cut.text ELSE texts.text END AS text
FROM cut LEFT JOIN texts ON cut.doc_id = texts.doc_id LEFT JOIN spans ON cut.doc_id = spans.doc_id
"""

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_bpe": op1_bpe, "op2_sstable": op2_sstable, "op3_ann": op3_ann, "op4_suffix": op4_suffix, "op5_minhash": op5_minhash, "op6_cgk": op6_cgk, "op7_chat": op7_chat, "op8_hmm": op8_hmm, "op9_crf": op9_crf, "op10_lines": op10_lines}
_ORACLES: dict[str, str] = {"op4_suffix": _ORACLE_OP4, "op5_minhash": _ORACLE_OP5, "op7_chat": _ORACLE_OP7, "op10_lines": _ORACLE_OP10}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
