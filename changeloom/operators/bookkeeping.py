"""Control tables of a sink, as data: DDL timestamps, progress, syncpoints, scan boundaries and applied DDL.

Each function takes the control table and what happened, and returns the table
afterwards, so a micro-batch replaces it in one write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.operators.ordering import carried, numbered

#: The row of the DDL timestamps that stands for all tables' last syncpoint.
SYNCPOINT_TABLE = -1


def stable_resort(df: DataFrame, group: str = "partition", arrival: str = "arrival") -> DataFrame:
    """Rows in commit order, rows of one commit as they arrived, and whether a row came after a later commit."""
    late = carried(df, group, arrival, [], F.col("commit_ts"), "max", "latest", including=False)
    late = late.withColumn("late", F.coalesce(F.col("commit_ts") < F.col("latest"), F.lit(False))).drop("latest")
    return numbered(late, group, "commit_ts", [arrival], "place")


def scan_batches(events: DataFrame, limit: int, by: str = "table_id") -> DataFrame:
    """The batch of each event, cut after about ``limit`` bytes, at borders of transactions only.

    events: (table_id, commit_ts, start_ts, is_ddl, bytes).  A border between
    two transactions of one commit timestamp isn't one where a DDL has that
    timestamp too.  What can't be parted counts as one piece, in the batch in
    which its first byte falls.
    """
    ddl = events.groupBy(by, "commit_ts").agg(F.max(F.col("is_ddl").cast("int")).alias("with_ddl"))
    marked = events.join(ddl, [by, "commit_ts"])
    marked = marked.withColumn("piece", F.when(F.col("with_ddl") == 1, F.lit(None)).otherwise(F.col("start_ts")))
    pieces = marked.groupBy(by, "commit_ts", "piece").agg(F.sum("bytes").alias("size"))
    before = carried(pieces, by, "commit_ts", ["piece"], F.col("size"), "sum", "before", including=False)
    before = before.select(F.col(by).alias("of"), F.col("commit_ts").alias("of_ts"), F.col("piece").alias("of_piece"), F.floor(F.coalesce("before", F.lit(0)) / limit).alias("batch"))
    same = (F.col(by) == F.col("of")) & (F.col("commit_ts") == F.col("of_ts")) & F.col("piece").eqNullSafe(F.col("of_piece"))
    return marked.join(before, same).drop("of", "of_ts", "of_piece", "piece", "with_ddl")


def active_upserts(df: DataFrame, key: str, origin: str, columns: list[str], size: int, by: str = "table_id") -> DataFrame:
    """Q7: the batches of last-write-wins upserts of active-active tables.

    Deletes and rows that a peer wrote (``origin`` is set) go.  Of several rows
    of a key the last counts.  A key that is inserted twice in a batch came
    from a delete that was left out; its table's rows then go one event a batch.
    """
    rows = df.where((F.col("row_type") != "D") & F.col(f"post.{origin}").isNull()) if origin else df.where("row_type != 'D'")
    last = rows.groupBy(by, F.col(f"post.{key}").alias("key")).agg(
        F.max_by(F.struct("commit_ts", *[F.col(f"post.{c}").alias(c) for c in columns]), F.struct("commit_ts", "start_ts", "row_key")).alias("r"), F.count(F.when(F.col("row_type") == "I", 1)).alias("inserts")
    )
    single = last.groupBy(F.col(by).alias("of")).agg((F.max("inserts") > 1).alias("single"))
    placed = numbered(last.select(by, "key", "r.*"), by, "commit_ts", ["key"], "place").join(single, F.col(by) == F.col("of")).drop("of")
    return placed.withColumn("batch", F.when(F.col("single"), F.col("place") - 1).otherwise(F.floor((F.col("place") - 1) / size)).cast("bigint")).drop("place")


def upsert_sql(table: Column, columns: list[str], values: Column, origin: str, commit: str) -> Column:
    """Q7: one statement for a batch of value lists: a column is replaced unless the row there is newer.

    The row's age there is its origin's timestamp, else its own commit.
    """
    newer = f"IFNULL(`{origin}`, `{commit}`) <= VALUES(`{origin}`)"
    names = ",".join(f"`{c}`" for c in [*columns, origin])
    sets = ",".join(f"`{c}` = IF({newer}, VALUES(`{c}`), `{c}`)" for c in [*columns, origin])
    return F.concat(F.lit("INSERT INTO "), table, F.lit(f" ({names}) VALUES "), F.array_join(values, ","), F.lit(f" ON DUPLICATE KEY UPDATE {sets}"))


def ddl_ts_after(control: DataFrame, events: DataFrame) -> DataFrame:
    """Q9: the DDL timestamps after events, the last event of a table in order counts.

    control: (table_id, ddl_ts, finished, is_syncpoint).  events: (seq, ddl_ts,
    stage pre or post, is_syncpoint, touched array of tables, dropped array).  A
    syncpoint touches only its own row.  A table that is dropped when an event
    is done loses its row, unless the same or a later event writes it again.
    """
    touched = F.when(F.col("is_syncpoint"), F.array(F.lit(SYNCPOINT_TABLE).cast("bigint"))).otherwise(F.col("touched"))
    writes = events.select(F.explode(touched).alias("table_id"), "seq", F.lit(0).alias("drops"), F.struct("ddl_ts", (F.col("stage") == "post").alias("finished"), "is_syncpoint").alias("r"))
    drops = events.where("stage = 'post' and not is_syncpoint").select(F.explode("dropped").alias("table_id"), "seq", F.lit(1).alias("drops"), F.lit(None).cast(writes.schema["r"].dataType).alias("r"))
    old = control.select("table_id", F.lit(-1).cast("bigint").alias("seq"), F.lit(0).alias("drops"), F.struct("ddl_ts", "finished", "is_syncpoint").alias("r"))
    last = old.unionByName(writes).unionByName(drops).groupBy("table_id").agg(F.max_by(F.struct("drops", "r"), F.struct("seq", "drops")).alias("x"))
    return last.where("x.drops = 0").select("table_id", "x.r.*")


def recovery(control: DataFrame, tables: DataFrame) -> DataFrame:
    """Q9: where each table starts again: (table_id, start_ts, skip_syncpoint, skip_dml).

    The syncpoint's row counts where it isn't older than the table's.  A done
    event starts at its timestamp, skipping the syncpoint that it was; an
    open syncpoint starts there too; an open DDL one before, skipping rows
    already written.  A table without a row starts at 0.
    """
    point = control.where(F.col("table_id") == SYNCPOINT_TABLE).select(F.struct("ddl_ts", "finished", "is_syncpoint").alias("p")).limit(1)
    own = control.where(F.col("table_id") != SYNCPOINT_TABLE).select("table_id", F.struct("ddl_ts", "finished", "is_syncpoint").alias("r"))
    both = tables.select("table_id").join(own, "table_id", "left").join(F.broadcast(point), how="left")  # point is one row
    use = F.when(F.col("r").isNotNull() & F.col("p").isNotNull() & (F.col("p.ddl_ts") >= F.col("r.ddl_ts")), F.col("p")).otherwise(F.col("r"))
    both = both.withColumn("u", use)
    open_ddl = ~F.col("u.finished") & ~F.col("u.is_syncpoint")
    return both.select(
        "table_id",
        F.coalesce(F.when(open_ddl, F.col("u.ddl_ts") - 1).otherwise(F.col("u.ddl_ts")), F.lit(0)).cast("bigint").alias("start_ts"),
        F.coalesce(F.col("u.finished") & F.col("u.is_syncpoint"), F.lit(False)).alias("skip_syncpoint"),
        F.coalesce(open_ddl, F.lit(False)).alias("skip_dml"),
    )


def progress_after(control: DataFrame, names: DataFrame, checkpoint: int, last_ddl: int) -> DataFrame:
    """Q10: each table's checkpoint after a flush: (schema_name, table_name, checkpoint_ts).

    A checkpoint that isn't past the last DDL writes nothing, as names may be
    those of before.
    """
    if not checkpoint or checkpoint <= last_ddl:
        return control
    new = names.select("schema_name", "table_name", F.lit(checkpoint).cast("bigint").alias("checkpoint_ts"), F.lit(1).alias("n")).distinct()
    both = control.select("schema_name", "table_name", "checkpoint_ts", F.lit(0).alias("n")).unionByName(new)
    return both.groupBy("schema_name", "table_name").agg(F.max_by("checkpoint_ts", "n").alias("checkpoint_ts"))


def progress_without(control: DataFrame, dropped: DataFrame) -> DataFrame:
    """Q10: without the rows of dropped tables, and of all tables of dropped schemas (table_name null)."""
    whole = dropped.where("table_name is null").select("schema_name").distinct()
    return control.join(whole, "schema_name", "left_anti").join(dropped.where("table_name is not null").select("schema_name", "table_name").distinct(), ["schema_name", "table_name"], "left_anti")


def syncpoints_after(control: DataFrame, points: DataFrame, now: Column, retention_s: float) -> DataFrame:
    """Q11: (changefeed, primary_ts, secondary_ts, created_at) after new points: one that is there already stays, old ones go."""
    both = control.withColumn("n", F.lit(0)).unionByName(points.withColumn("n", F.lit(1)))
    columns = [c for c in control.columns if c not in ("changefeed", "primary_ts")]
    kept = both.groupBy("changefeed", "primary_ts").agg(F.min_by(F.struct(*columns), "n").alias("r")).select("changefeed", "primary_ts", "r.*")
    return kept.where(F.col("created_at").cast("double") >= now.cast("double") - retention_s)


def assign_workers(keyed: DataFrame, txn: str, workers: int) -> DataFrame:
    """K2: (txn, worker): any worker without open conflicts, the same one where all conflicts are there, none (null) where it must wait.

    keyed: (txn, conflict_key, holder): the worker that holds the key's earlier
    transaction, or null.
    """
    held = keyed.groupBy(txn).agg(F.collect_set("holder").alias("held"))
    free = F.pmod(F.xxhash64(txn), F.lit(workers)).cast("int")
    return held.select(txn, F.when(F.size("held") == 0, free).when(F.size("held") == 1, F.element_at("held", 1)).alias("worker"))


def barrier(events: DataFrame, reports: DataFrame, alive: DataFrame) -> DataFrame:
    """What each blocking event's spans are told: (event, span, action write, pass or wait).

    events: (event, span) that it blocks; reports: (event, span) that have
    reached it; alive: (span).  An event goes on once all its living spans have
    reached it; the smallest of them writes, the others pass.
    """
    blocked = events.join(alive, "span", "left_semi")
    seen = blocked.join(reports.select("event", "span", F.lit(True).alias("here")).distinct(), ["event", "span"], "left")
    state = seen.groupBy(F.col("event").alias("of")).agg(F.bool_and(F.coalesce("here", F.lit(False))).alias("all_here"), F.min("span").alias("writer"))
    told = F.when(~F.col("all_here"), "wait").when(F.col("span") == F.col("writer"), "write").otherwise("pass")
    return seen.join(state, F.col("event") == F.col("of")).select("event", "span", told.alias("action"))


def released_jobs(jobs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Finished DDL jobs that may be taken, in commit order: those at or before the resolved timestamp (one row)."""
    level = resolved.agg(F.max("resolved_ts").alias("level"))
    done = jobs.where("state = 'done'").join(F.broadcast(level)).where("version <= level").drop("level")
    return done.withColumn("seq", F.row_number().over(Window.partitionBy("table_id").orderBy("version")))
