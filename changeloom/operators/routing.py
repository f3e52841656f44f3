"""Table routes, topics and partitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.functions.globs import TableRules


@dataclass(frozen=True)
class Route:
    matcher: tuple[str, ...]
    schema: str = ""
    table: str = ""


def _fill(expression: str, source: Column) -> Column:
    if not expression:
        return source
    return F.replace(F.replace(F.lit(expression), F.lit("{schema}"), F.col("schema_name")), F.lit("{table}"), F.col("table_name"))


def route(df: DataFrame, routes: list[Route]) -> DataFrame:
    """target_schema and target_table by the first route that matches; without one the source's names."""
    schema, table = F.col("schema_name"), F.col("table_name")
    for r in reversed(routes):
        hit = TableRules(r.matcher).column(F.col("schema_name"), F.col("table_name"))
        schema = F.when(hit, _fill(r.schema, F.col("schema_name"))).otherwise(schema)
        table = F.when(hit, _fill(r.table, F.col("table_name"))).otherwise(table)
    return df.withColumns({"target_schema": schema, "target_table": table})


def ambiguous_schemas(routed: DataFrame) -> DataFrame:
    """R2: source schemas whose tables go to more than one target schema."""
    return routed.groupBy("schema_name").agg(F.count_distinct("target_schema").alias("targets")).where("targets > 1")


def conflicts(routed: DataFrame) -> DataFrame:
    """Targets that more than one source goes to."""
    return routed.groupBy("target_schema", "target_table").agg(F.count_distinct("schema_name", "table_name").alias("sources")).where("sources > 1")


def admit(owners: DataFrame, change: DataFrame) -> DataFrame:
    """Whether a DDL's new routes may be applied: a target is free, or its owner goes in the same change.

    owners: (target, source); change: (target, source, removed boolean).
    """
    freed = change.where("removed").select(F.col("target").alias("t"), F.col("source").alias("s"))
    held = owners.join(freed, (owners["target"] == F.col("t")) & (owners["source"] == F.col("s")), "left_anti").withColumnRenamed("source", "owner")
    return change.where("not removed").join(held, "target", "left").withColumn("admitted", F.col("owner").isNull() | (F.col("owner") == F.col("source")))


def rewrite_query(query: Column, schema: str, table: str, target_schema: str, target_table: str) -> Column:
    """A statement with one table's qualified or bare name replaced, quoted or not; strings stay.

    Names are replaced where they stand alone; a full parser isn't used.
    """
    full = F.lit(f"`{target_schema}`.`{target_table}`")
    text, edge = r"('(?:[^']|'')*')", r"(?![\w`])"
    schema, table = (rf"\Q{x}\E" for x in (schema, table))
    qualified = rf"{text}|(?<![\w`.])(?:`{schema}`|{schema})\s*\.\s*(?:`{table}`|{table}){edge}"
    words = "TABLE|EXISTS|ON|LIKE|TO|FROM|JOIN|INTO|UPDATE|REFERENCES|VIEW|TRUNCATE"
    # a string keeps its text ($1), a name becomes the mark alone
    out = F.regexp_replace(F.regexp_replace(query, F.lit(qualified), F.lit("$1\u0001")), "('(?:[^']|'')*')\u0001", "$1")
    found = rf"{text}|(?i:\b({words})(\s+))(?:`{table}`|{table}){edge}(?!\s*\.)"
    out = F.regexp_replace(F.regexp_replace(out, F.lit(found), F.lit("$1$2$3\u0001")), "('(?:[^']|'')*')\u0001", "$1")
    return F.replace(out, F.lit("\u0001"), full)


#: Fixed value: the length that a topic's name can have.
TOPIC_LIMIT = 249


def topic(expression: str) -> Column:
    """A topic's name: names filled in, other characters than letters, digits, ``.``, ``_`` and ``-`` as ``_``, cut; ``.`` and ``..`` spelled out."""
    name = F.replace(F.replace(F.lit(expression), F.lit("{schema}"), F.col("schema_name")), F.lit("{table}"), F.col("table_name"))
    name = F.substring(F.regexp_replace(name, r"[^a-zA-Z0-9\._\-]", "_"), 1, TOPIC_LIMIT)
    return F.when(name == ".", "_").when(name == "..", "__").otherwise(name)


@dataclass(frozen=True)
class TopicRule:
    matcher: tuple[str, ...]
    expression: str


def assign_topic(df: DataFrame, rules: list[TopicRule], default: str) -> DataFrame:
    """The first rule's topic, else the default."""
    out = F.lit(default)
    for r in reversed(rules):
        out = F.when(TableRules(r.matcher).column(F.col("schema_name"), F.col("table_name")), topic(r.expression)).otherwise(out)
    return df.withColumn("topic", out)


def ddl_messages(ddl: DataFrame, rules: list[TopicRule], default: str, partitions: int, first_only: bool) -> DataFrame:
    """A DDL's messages: by its old name for renames, the default topic for schemas; to partition 0 or to all."""
    named = ddl.withColumns({"schema_name": F.coalesce("old_schema", "schema_name"), "table_name": F.coalesce("old_table", "table_name")})
    routed = assign_topic(named, rules, default).withColumn("topic", F.when(F.col("table_name") == "", default).otherwise(F.col("topic")))
    last = F.lit(0 if first_only else partitions - 1)
    return routed.withColumn("partition", F.explode(F.sequence(F.lit(0), last)))


def active_topics(df: DataFrame, default: str) -> DataFrame:
    """All topics in use and the default one."""
    return df.select("topic").union(df.sparkSession.range(1).select(F.lit(default))).distinct()


def _crc(*parts: Column) -> Column:
    return F.crc32(F.concat(*parts).cast("binary"))


def partition_by_table(n: int) -> Column:
    """R9."""
    return _crc(F.col("schema_name"), F.col("table_name")) % n


def partition_by_ts(n: int) -> Column:
    """R10."""
    return F.col("commit_ts") % n


def partition_by_columns(columns: list[str], n: int) -> Column:
    """The XOR of the checksums of the table and of each non-null column's name and value; deletes use the before image."""
    out = _crc(F.col("schema_name"), F.col("table_name"))
    for c in columns:
        value = F.coalesce(F.col(f"post.{c}"), F.when(F.col("post").isNull(), F.col(f"pre.{c}"))).cast("string")
        out = out.bitwiseXOR(F.coalesce(_crc(F.lit(c), value), F.lit(0)))
    return out % n


def partition_key(rule: str) -> Column:
    """The rule's own text is the key."""
    return F.lit(rule)


def split_spans(regions: DataFrame, spans: int) -> DataFrame:
    """A table's regions in key order, dealt to spans as evenly as can be, the first with one more."""
    w = Window.partitionBy("table_id").orderBy("start_key")
    return regions.withColumn("span", F.ntile(spans).over(w))


def split_spans_by_bytes(regions: DataFrame, spans: int, base: int) -> DataFrame:
    """Cut where the running weight (bytes written and a base for each region) passes another part of the total."""
    weight = F.col("bytes") + F.lit(base)
    w = Window.partitionBy("table_id").orderBy("start_key")
    before = F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(weight).over(Window.partitionBy("table_id"))
    return regions.withColumn("span", F.floor(before * spans / total).cast("bigint") + 1)


def splittable(has_pk: Column, unique_indexes: Column) -> Column:
    """A primary key and no other unique index."""
    return has_pk & (unique_indexes == 0)


def gaps(ranges: DataFrame) -> DataFrame:
    """For each table whether its ranges cover [lo, hi) without a gap, by the running largest end."""
    w = Window.partitionBy("table_id").orderBy("start_key", "end_key").rowsBetween(Window.unboundedPreceding, -1)
    open_ = ranges.withColumn("reached", F.coalesce(F.max("end_key").over(w), F.col("lo")))
    return open_.groupBy("table_id").agg((F.max(F.when(F.col("start_key") > F.col("reached"), 1).otherwise(0)) == 0).alias("inner"), F.max("end_key").alias("last"), F.max("hi").alias("hi"), F.min("start_key").alias("first"), F.max("lo").alias("lo")).select("table_id", (F.col("inner") & (F.col("first") <= F.col("lo")) & (F.col("last") >= F.col("hi"))).alias("covered"))


def hot_spans(spans: DataFrame, bytes_limit: int, regions_limit: int) -> DataFrame:
    """Spans that carry too much, and those small enough to be merged."""
    hot = (F.col("bytes") >= bytes_limit) | (F.col("regions") >= regions_limit)
    return spans.withColumn("action", F.when(hot, "split").when((F.col("bytes") * 4 < bytes_limit) & (F.col("regions") * 4 < regions_limit), "merge").otherwise("keep"))


def balance(spans: DataFrame, nodes: int) -> DataFrame:
    """Spans dealt to nodes by size, largest first, back and forth, so that each gets as many and about as much."""
    rank = F.row_number().over(Window.partitionBy("table_id").orderBy(F.col("bytes").desc(), "span_id")) - 1
    turn, place = F.floor(rank / nodes), rank % nodes
    return spans.withColumn("node", F.when(turn % 2 == 0, place).otherwise(nodes - 1 - place).cast("int"))
