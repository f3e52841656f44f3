"""Chat formatting with DataFrame functions only.

A conversation becomes one string.  Adjacent turns of one role share a block:

    ### role: text</turn>text</turn>
    ### role: text</turn>

In texts and roles the three control characters are escaped by letters
(``\\`` as ``\\b``, ``#`` as ``\\h``, ``<`` as ``\\l``), and in roles also ``:`` as
``\\c``.  So no ``#`` and no ``<`` is ever left inside a text, every mark of the
template is one, and the original turns can be read back exactly, merged or
not.  ``loss_spans`` are the code-point ranges [start, stop) of the assistant's
texts (escaped, without their marks) in the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's marks.
HEAD, COLON, CLOSE, NEXT = "### ", ": ", "</turn>", "\n"


def _escape(text: Column, role: bool = False) -> Column:
    for plain, letter in (("\\", "b"), ("#", "h"), ("<", "l"), *([(":", "c")] if role else [])):
        text = F.replace(text, F.lit(plain), F.lit("\\" + letter))
    return text


def _unescape(text: Column, role: bool = False) -> Column:
    for plain, letter in (*([(":", "c")] if role else []), ("<", "l"), ("#", "h"), ("\\", "b")):
        text = F.replace(text, F.lit("\\" + letter), F.lit(plain))
    return text


def format_chat(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """(id_col, formatted string, loss_spans array<struct<start,stop>>), a row for each conversation.

    Turns are ordered by turn, nulls first; of equal turns, by role, then text.
    Null text or role: empty.  A null conversation id is a conversation of its
    own.  Repeated rows stay turns of their own.  An empty frame gives an empty
    frame; further columns are left out.  One shuffle, by conversation; a
    conversation is one output string and so must fit in one task.
    """
    text, role = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("n"), role.alias("role"), text.alias("body"))
    turns = df.groupBy(F.col(id_col)).agg(F.sort_array(F.collect_list(turn)).alias("turns_"))

    def piece(x: Column, i: Column) -> Column:
        before = F.get(F.col("turns_"), i - 1)
        fresh = F.concat(F.when(i > 0, F.lit(NEXT)).otherwise(""), F.lit(HEAD), x["role"], F.lit(COLON))
        same = (i > 0) & (before["role"] == x["role"])
        return F.struct(F.when(same, F.lit("")).otherwise(fresh).alias("lead"), x["body"].alias("body"), x["learn"].alias("learn"))

    # sorted by the texts as they are; escaped only then
    escaped = F.transform("turns_", lambda x: F.struct(_escape(x["role"], True).alias("role"), _escape(x["body"]).alias("body"), (x["role"] == learn).alias("learn")))
    blocks = turns.select(id_col, escaped.alias("turns_")).select(id_col, F.transform("turns_", piece).alias("pieces_"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["lead"])
        stop = start + F.length(x["body"])
        span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct((stop + len(CLOSE)).alias("at"), F.when(x["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).cast("int").alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("spans"))
    return blocks.select(
        id_col,
        F.array_join(F.transform("pieces_", lambda x: F.concat(x["lead"], x["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("pieces_", zero, add)["spans"].alias("loss_spans"),
    )


def parse_chat(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id_col, turns array<struct<role,text>>, learned string) from formatted and loss_spans."""
    blocks = F.filter(F.split(F.col("formatted"), HEAD), lambda b: b != "")

    def turns(block: Column) -> Column:
        head = F.substring_index(block, COLON, 1)
        body = F.substring(block, F.length(head) + 1 + len(COLON), F.length(block))
        texts = F.split(body, CLOSE)
        return F.transform(F.slice(texts, 1, F.size(texts) - 1), lambda t: F.struct(_unescape(head, True).alias("role"), _unescape(t).alias("text")))

    learned = F.transform("loss_spans", lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"]))
    return df.select(id_col, F.flatten(F.transform(blocks, turns)).alias("turns"), _unescape(F.array_join(learned, "")).alias("learned"))
