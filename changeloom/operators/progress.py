"""Resolved timestamps, checkpoints and what is derived from them, exactly and as data.

A resolved timestamp is a promise that no earlier change will come.  It isn't
an event-time watermark with a delay; rows carry it, and nothing is dropped
silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def region_progress(marks: DataFrame) -> DataFrame:
    """Each region's resolved timestamp after each mark; marks before initialisation and regressions don't count."""
    w = Window.partitionBy("region_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("resolved", F.max(F.when(F.col("initialized"), F.col("resolved_ts"))).over(w))


def span_resolved(marks: DataFrame, regions: DataFrame) -> DataFrame:
    """The smallest over all regions of a span; one without any mark holds it at its own start."""
    last = marks.where("initialized").groupBy("region_id").agg(F.max("resolved_ts").alias("resolved_ts"))
    return regions.join(last, "region_id", "left").groupBy("span_id").agg(F.min(F.coalesce("resolved_ts", "start_ts")).alias("resolved_ts"))


def broken_promises(commits: DataFrame, resolved: DataFrame) -> DataFrame:
    """Commits at or before what their region had promised; start timestamps up to it are merely stale."""
    return commits.join(resolved, "region_id").select("*", (F.col("commit_ts") <= F.col("resolved_ts")).alias("fatal"), (F.col("start_ts") <= F.col("resolved_ts")).alias("stale"))


def table_checkpoint(progress: DataFrame, resolved: DataFrame) -> DataFrame:
    """The earliest commit in flight less one; else the later of the last commit less one and the resolved timestamp; else that."""
    g = progress.groupBy("table_id").agg(F.min(F.when(~F.col("flushed"), F.col("commit_ts"))).alias("waiting"), F.max("commit_ts").alias("seen"))
    both = resolved.join(g, "table_id", "left")
    return both.select("table_id", F.coalesce(F.col("waiting") - 1, F.greatest(F.col("seen") - 1, "resolved_ts"), F.col("resolved_ts")).alias("checkpoint_ts"))


def global_checkpoint(nodes: DataFrame, expected: int, barrier: int, scheduler: int) -> DataFrame:
    """T4: the smallest of all nodes', the barrier's and the scheduler's; none while a node is missing."""
    g = nodes.agg(F.count_distinct("node_id").alias("n"), F.min("checkpoint_ts").alias("m"))
    return g.select(F.when(F.col("n") >= expected, F.least("m", F.lit(barrier), F.lit(scheduler))).alias("checkpoint_ts"))


def redo_meta(metas: DataFrame) -> DataFrame:
    """The latest checkpoint and resolved timestamp over all meta files."""
    return metas.agg(F.max("checkpoint_ts").alias("checkpoint_ts"), F.max("resolved_ts").alias("resolved_ts"))


def last_synced(progress: DataFrame) -> DataFrame:
    """The latest flushed commit of each table."""
    return progress.where("flushed").groupBy("table_id").agg(F.max("commit_ts").alias("last_synced_ts"))


def synced(now: Column, last_ms: Column, checkpoint_ms: Column, quiet_s: int = 300, lag_s: int = 15) -> Column:
    """Nothing flushed for so long, and the checkpoint close to now."""
    return (now - last_ms > quiet_s * 1000) & (now - checkpoint_ms < lag_s * 1000)


def gc_safepoint(checkpoints: DataFrame) -> DataFrame:
    """What every changefeed is past."""
    return checkpoints.agg((F.min("checkpoint_ts") - 1).alias("safepoint"))


def watermark_messages(topics: DataFrame, partitions: int, ts: DataFrame) -> DataFrame:
    """The watermark to each partition of each active topic; ts is one row."""
    return topics.select("topic", F.explode(F.sequence(F.lit(0), F.lit(partitions - 1))).alias("partition")).join(F.broadcast(ts.limit(1)))


def storage_order(files: DataFrame, marks: DataFrame) -> DataFrame:
    """Storage files in reading order, schema before data, without those that are stale.

    A data file goes if its table version is before the table's DDL watermark,
    a schema file if it isn't after it.
    """
    j = files.join(marks, "table_id", "left")
    stale = F.when(F.col("is_schema"), F.col("version") <= F.col("ddl_ts")).otherwise(F.col("version") < F.col("ddl_ts"))
    kept = j.where(~F.coalesce(stale, F.lit(False)))
    w = Window.partitionBy("table_id").orderBy("version", F.col("is_schema").desc(), "idx")
    return kept.select("table_id", "version", "is_schema", "idx", F.row_number().over(w).alias("seq"))


def ddl_gate(ddl: DataFrame, watermark: int) -> DataFrame:
    """The DDLs that may run: at or before the watermark, or such that wait for nothing; regressions of a table go."""
    w = Window.partitionBy("table_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    free = F.lower("ddl_type").isin("create schema", "create table")
    ordered = ddl.withColumn("before", F.max("version").over(w)).where("before is null or version >= before")
    return ordered.where((F.col("version") <= watermark) | free).drop("before")


def dedup_replay(df: DataFrame) -> DataFrame:
    """A replayed row counts once."""
    return df.dropDuplicates(["table_id", "commit_ts", "start_ts", "row_key", "dml_order"])


def match_commits(kv: DataFrame) -> DataFrame:
    """Prewrites joined with commits of the same key and start.

    Of several prewrites the latest generation counts, and an empty one never
    replaces a value.  A rollback takes its prewrite away; a row that came
    committed passes by.  All in one grouping by (key, start_ts), so there is
    one shuffle and no join.
    """
    rank = F.struct((F.col("value") != "").alias("full"), F.col("generation").alias("g"))
    pre, com, back = F.col("type") == "PREWRITE", F.col("type") == "COMMIT", F.col("type") == "ROLLBACK"
    g = kv.where("type in ('PREWRITE', 'COMMIT', 'ROLLBACK')").groupBy("key", "start_ts").agg(F.max_by(F.when(pre, F.col("value")), F.when(pre, rank)).alias("value"), F.max(F.when(com, F.col("commit_ts"))).alias("commit_ts"), F.max(pre).alias("has_pre"), F.max(back).alias("rolled"))
    matched = g.where("has_pre and not rolled and commit_ts is not null").select("key", "start_ts", "commit_ts", "value")
    return matched.unionByName(kv.where("type = 'COMMITTED'").select("key", "start_ts", "commit_ts", "value"))


def unmatched_commits(kv: DataFrame) -> DataFrame:
    """Commits without a prewrite: they wait before initialisation and are an error after."""
    g = kv.where("type in ('PREWRITE', 'COMMIT')").groupBy("key", "start_ts").agg(F.max(F.col("type") == "PREWRITE").alias("p"), F.max(F.when(F.col("type") == "COMMIT", F.col("commit_ts"))).alias("commit_ts"))
    return g.where("not p and commit_ts is not null").select("key", "start_ts", "commit_ts")
