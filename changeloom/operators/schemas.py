"""Versioned schemas: lookups as of a timestamp, snapshots, DDL scopes and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeloom.operators.filters import DDL_SCOPE, _small
from changeloom.operators.ordering import carried, numbered


def versions(ddl: DataFrame) -> DataFrame:
    """(…, next_version): a version holds from its own timestamp to the next one's."""
    w = Window.partitionBy("table_id").orderBy("version")
    return ddl.withColumn("next_version", F.coalesce(F.lead("version").over(w), F.lit(2**63 - 1)))


def as_of(changes: DataFrame, ddl: DataFrame) -> DataFrame:
    """Each change with its table's schema just before its commit (at commit - 1).

    Changes of a table deleted by then, or not yet made, go.  A small schema
    history is broadcast and matched by range.  A large one is merged with the
    changes instead: both are dealt by table and the last version is carried
    forward, so no change meets more than one version.
    """
    v = versions(ddl)
    if _small(ddl):
        hit = (F.col("table_id") == F.col("v_table")) & (F.col("version") < F.col("commit_ts")) & (F.col("commit_ts") <= F.col("next_version"))
        return changes.join(F.broadcast(v.withColumnRenamed("table_id", "v_table")), hit).where("not deleted").drop("v_table", "next_version")
    return as_of_merge(changes, ddl)


def as_of_merge(changes: DataFrame, ddl: DataFrame) -> DataFrame:
    """The same by one sort of changes and versions together."""
    names, facts = changes.columns, [c for c in ddl.columns if c != "table_id"]
    left = changes.select("table_id", F.struct(*names).alias("c"), F.col("commit_ts").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(ddl.select(F.struct(*facts)).schema[0].dataType).alias("v"))
    right = ddl.select("table_id", F.lit(None).cast(left.schema["c"].dataType).alias("c"), F.col("version").alias("at"), F.lit(1).alias("side"), F.struct(*facts).alias("v"))
    both = carried(left.unionByName(right), "table_id", "at", ["side"], F.col("v"), "last", "held", including=True)
    return both.where("side = 0 and held is not null and not held.deleted").select("c.*", *[f"held.{x}" for x in facts])


def ddl_fetch(ddl: DataFrame, table_id: int, start: int, end: int) -> DataFrame:
    """One table's schema changes in (start, end]."""
    return ddl.where((F.col("table_id") == table_id) & (F.col("version") > start) & (F.col("version") <= end)).orderBy("version")


def snapshot(ddl: DataFrame, ts: int, gc_ts: int = 0) -> DataFrame:
    """The tables that exist at ts, each with its version; ts before gc_ts is an error."""
    if ts < gc_ts:
        raise ValueError(f"snapshot {ts} is older than what is kept ({gc_ts})")
    return versions(ddl).where((F.col("version") <= ts) & (ts < F.col("next_version")) & ~F.col("deleted"))


def tables_at(points: DataFrame, ddl: DataFrame) -> DataFrame:
    """The tables that exist at each of several timestamps (column ts), with their versions."""
    v = versions(ddl)
    hit = (F.col("version") <= F.col("ts")) & (F.col("ts") < F.col("next_version"))
    return points.join(F.broadcast(v) if _small(ddl) else v, hit).where("not deleted")


def finished_jobs(jobs: DataFrame) -> DataFrame:
    """Done DDL jobs with their place in commit order."""
    return jobs.where("state = 'done'").withColumn("seq", F.row_number().over(Window.partitionBy("table_id").orderBy("version")))


def gc_versions(ddl: DataFrame, gc_ts: int) -> DataFrame:
    """A table keeps its newest version up to gc_ts and all later ones."""
    return versions(ddl).where(F.col("next_version") > gc_ts).drop("next_version")


def handle_key(indexes: DataFrame) -> DataFrame:
    """The key that identifies a table's rows: the primary, else of the not-null unique ones that with fewest columns, then smallest id."""
    fit = indexes.where("is_primary or (is_unique and not nullable)")
    rank = F.struct((~F.col("is_primary")).alias("p"), F.size("columns").alias("n"), F.col("index_id").alias("i"))
    return fit.groupBy("table_id").agg(F.min_by("columns", rank).alias("handle_columns"), F.min_by("index_id", rank).alias("index_id"))


def ddl_scope(ddl: DataFrame) -> DataFrame:
    """whether a DDL blocks one table, several, its schema or all."""
    scope = F.create_map(*[F.lit(x) for pair in DDL_SCOPE.items() for x in pair])
    return ddl.withColumn("scope", scope[F.lower("ddl_type")])


def physical_effects(ddl: DataFrame) -> DataFrame:
    """What a DDL blocks, drops and adds, from its old and new physical table ids.

    Table 0 is the span of DDL events itself.
    """
    old, new = F.col("old_ids"), F.col("new_ids")
    none = F.expr("cast(array() as array<bigint>)")
    kind = F.lower("ddl_type")
    blocked = F.when(kind.isin("create schema", "create table"), F.array(F.lit(0).cast("long"))).when(kind.isin("drop schema", "modify schema charset and collate"), F.concat(F.array(F.lit(0).cast("long")), old)).otherwise(F.concat(old, F.array(F.lit(0).cast("long"))))
    dropped = F.when(kind.isin("drop schema", "drop table"), old).when(kind == "truncate table", old).when(kind.isin("drop partition", "truncate partition", "reorganize partition"), F.array_except(old, new)).otherwise(none)
    added = F.when(kind.isin("create table", "recover table", "truncate table"), new).when(kind.isin("add partition", "truncate partition", "reorganize partition"), F.array_except(new, old)).otherwise(none)
    return ddl.withColumns({"blocked": F.array_sort(F.array_distinct(blocked)), "dropped": F.array_sort(dropped), "added": F.array_sort(added)})


def rename_effect(old_kept, new_kept):
    """L4: what a rename is after filtering; a table that comes in from outside is an error."""
    return F.when(old_kept & new_kept, "rename").when(old_kept, "drop").when(new_kept, "error").otherwise("skip")


def split_multi(ddl: DataFrame) -> DataFrame:
    """A DDL on several tables as one event for each, in order."""
    return ddl.select("*", F.posexplode("tables")).withColumnsRenamed({"pos": "part", "col": "one_table"}).drop("tables")


def merge_order(dml: DataFrame, ddl: DataFrame) -> DataFrame:
    """One stream of both; at one timestamp rows come before the DDL."""
    a = dml.select("table_id", "commit_ts", F.lit(0).alias("is_ddl"), "row_key")
    b = ddl.select("table_id", F.col("version").alias("commit_ts"), F.lit(1).alias("is_ddl"), F.col("ddl_type").alias("row_key"))
    return numbered(a.unionByName(b), "table_id", "commit_ts", ["is_ddl", "row_key"])


def segments(merged: DataFrame) -> DataFrame:
    """The barrier segment of each event: how many DDLs of its table came before it."""
    before = carried(merged, "table_id", "seq", [], F.col("is_ddl"), "sum", "segment", including=False)
    return before.withColumn("segment", F.coalesce("segment", F.lit(0)))
