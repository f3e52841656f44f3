"""Queries on control tables, DDL kinds and effects, scan boundaries and workers, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.functions import avro, codecs
from changeloom.functions.globs import TableRules
from changeloom.operators import bookkeeping, ddl, filters, merging, rewrite
from changeloom.plans.catalog import register
from changeloom.plans.changefeed import Changefeed
from changeloom.sources import derived
from changeloom.sources.derived import ORDERS_SQL

C = f"WITH c AS ({ORDERS_SQL}) "

#: Statements and their kinds.
KINDS = [
    ("CREATE TABLE `t` (a INT, b INT)", "create table"), ("create table t2 like t", "create table"), ("DROP TABLE IF EXISTS a, b", "drop table"),
    ("drop view v", "drop view"), ("ALTER DATABASE d CHARACTER SET utf8", "modify schema charset and collate"), ("create database d", "create schema"), ("DROP SCHEMA d", "drop schema"),
    ("ALTER TABLE t ADD COLUMN (a INT, b INT)", "add column"), ("ALTER TABLE s.t ADD COLUMN a INT, DROP COLUMN b", "multi schema change"),
    ("ALTER TABLE t ADD INDEX i(a,b)", "add index"), ("ALTER TABLE t ADD UNIQUE KEY k (a)", "add index"), ("CREATE UNIQUE INDEX i ON t (a)", "add index"), ("DROP INDEX i ON t", "drop index"),
    ("ALTER TABLE t ADD CONSTRAINT c PRIMARY KEY (a)", "add primary key"), ("ALTER TABLE `a,b` DROP PRIMARY KEY", "drop primary key"),
    ("ALTER TABLE t ADD CONSTRAINT FOREIGN KEY (a) REFERENCES x(b)", "add foreign key"), ("ALTER TABLE t DROP FOREIGN KEY f", "drop foreign key"),
    ("alter table t modify a varchar(10) comment 'x, y'", "modify column"), ("alter table t change a b int", "modify column"), ("alter table t drop column a", "drop column"),
    ("alter table t alter column a set default 3", "set default value"), ("alter table t rename to u", "rename table"), ("alter table t rename index a to b", "rename index"),
    ("alter table t alter index i invisible", "alter index visibility"), ("alter table t truncate partition p0, p1", "truncate partition"),
    ("alter table t add partition (partition p3 values less than (10), partition p4 values less than (20))", "add partition"), ("alter table t drop partition p1", "drop partition"),
    ("alter table t partition by hash(a) partitions 3", "alter partitioning"), ("alter table t remove partitioning", "remove partitioning"),
    ("alter table t reorganize partition p0, p1 into (partition x values less than (3))", "reorganize partition"), ("alter table t exchange partition p0 with table u", "exchange partition"),
    ("alter table t auto_increment = 5", "rebase auto increment"), ("alter table t comment='a, b'", "modify table comment"), ("alter table t convert to character set utf8", "modify table charset and collate"),
    ("/* c */ CREATE OR REPLACE VIEW `v` AS SELECT 1", "create view"), ("FLASHBACK TABLE t", "recover table"), ("RENAME TABLE a TO b, c TO d", "rename tables"),
    ("rename table a.b to c.d", "rename table"), ("TRUNCATE TABLE t", "truncate table"), ("alter table t remove ttl", "alter ttl remove"), ("alter table t", "alter ttl info"),
]


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_KINDS_SQL = "(VALUES " + ", ".join(f"({n}, {_text(q)}, {_text(k)})" for n, (q, k) in enumerate(KINDS)) + ") AS k(n, query, kind)"


@register("c14_ddl_action", f"SELECT n_nationkey AS nation, query, kind FROM nation, {_KINDS_SQL}")
def c14(spark, d):
    statements = spark.createDataFrame([(q,) for q, _ in KINDS], "query string")
    nations = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("nation"))
    return nations.join(F.broadcast(statements)).select("nation", "query", ddl.action(F.col("query")).alias("kind"))


_ARRIVED = "SELECT event_id % 4 AS partition, event_id AS arrival, event_id - event_id % 7 * 3 AS commit_ts FROM events"


@register("w3_stable_resort", f"SELECT partition, arrival, commit_ts, coalesce(commit_ts < max(commit_ts) OVER (PARTITION BY partition ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late, CAST(row_number() OVER (PARTITION BY partition ORDER BY commit_ts, arrival) AS INTEGER) AS place FROM ({_ARRIVED})")
def w3(spark, d):
    k = F.col("event_id")
    rows = spark.read.parquet(f"{d}/events.parquet").select((k % 4).alias("partition"), k.alias("arrival"), (k - k % 7 * 3).alias("commit_ts"))
    return bookkeeping.stable_resort(rows)


@register("w8_scan_batches", """
WITH e AS (SELECT event_id % 3 AS table_id, event_id // 20 AS commit_ts, event_id // 5 AS start_ts, event_id, event_id % 90 = 7 AS is_ddl, event_id % 50 + 1 AS bytes FROM events),
p AS (SELECT *, bool_or(is_ddl) OVER (PARTITION BY table_id, commit_ts) AS w FROM e),
q AS (SELECT table_id, commit_ts, CASE WHEN w THEN -1 ELSE start_ts END AS piece, sum(bytes) AS size FROM p GROUP BY ALL),
b AS (SELECT table_id, commit_ts, piece, coalesce(sum(size) OVER (PARTITION BY table_id ORDER BY commit_ts, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 300 AS batch FROM q)
SELECT event_id, p.table_id, CAST(batch AS BIGINT) AS batch FROM p JOIN b ON p.table_id = b.table_id AND p.commit_ts = b.commit_ts AND CASE WHEN w THEN -1 ELSE start_ts END = piece""")  # fmt: skip
def w8(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id % 3 as table_id", "event_id div 20 as commit_ts", "event_id div 5 as start_ts", "event_id", "event_id % 90 = 7 as is_ddl", "event_id % 50 + 1 as bytes")
    return bookkeeping.scan_batches(e, 300).select("event_id", "table_id", "batch")


def _active(spark, d) -> DataFrame:
    """Rows of a few hundred keys a table; every ninth came from a peer."""
    c = derived.orders_changes(spark, d)
    post = F.struct((F.col("post.key") % 300).alias("key"), "post.price", F.when(F.col("post.key") % 9 == 0, F.col("commit_ts")).alias("origin"))
    return c.withColumn("post", F.when(F.col("post").isNotNull(), post))


_ACTIVE = C + """, r AS (SELECT table_id, post_key % 300 AS key, post_price AS price, commit_ts, start_ts, row_key, row_type FROM c WHERE row_type <> 'D' AND post_key % 9 <> 0),
l AS (SELECT table_id, key, arg_max(price, (commit_ts, start_ts, row_key)) AS price, max(commit_ts) AS commit_ts, count(*) FILTER (row_type = 'I') AS i FROM r GROUP BY ALL),
p AS (SELECT *, max(i) OVER (PARTITION BY table_id) > 1 AS single, row_number() OVER (PARTITION BY table_id ORDER BY commit_ts, key) - 1 AS n FROM l)
"""


@register("q7_active_upserts", _ACTIVE + "SELECT table_id, key, commit_ts, price, single, CAST(CASE WHEN single THEN n ELSE n // 40 END AS BIGINT) AS batch FROM p")
def q7(spark, d):
    return bookkeeping.active_upserts(_active(spark, d), "key", "origin", ["price"], 40).select("table_id", "key", "commit_ts", "price", "single", "batch")


@register("q7_upsert_sql", _ACTIVE + """SELECT table_id, CASE WHEN single THEN n ELSE n // 40 END AS batch, 'INSERT INTO t (`price`,`origin`) VALUES ' || string_agg('(' || price || ',' || commit_ts || ')', ',' ORDER BY key) || ' ON DUPLICATE KEY UPDATE `price` = IF(IFNULL(`origin`, `commit`) <= VALUES(`origin`), VALUES(`price`), `price`),`origin` = IF(IFNULL(`origin`, `commit`) <= VALUES(`origin`), VALUES(`origin`), `origin`)' AS statement FROM p GROUP BY ALL""")
def q7b(spark, d):
    rows = bookkeeping.active_upserts(_active(spark, d), "key", "origin", ["price"], 40)
    value = F.concat(F.lit("("), F.col("price").cast("string"), F.lit(","), F.col("commit_ts").cast("string"), F.lit(")"))
    g = rows.groupBy("table_id", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("key", value.alias("v")))), lambda x: x["v"]).alias("values"))
    return g.select("table_id", "batch", bookkeeping.upsert_sql(F.lit("t"), ["price"], F.col("values"), "origin", "commit").alias("statement"))


_DDL_EVENTS = """e AS (SELECT o_orderkey AS seq, o_orderkey * 10 AS ddl_ts, CASE WHEN o_orderkey % 2 = 0 THEN 'post' ELSE 'pre' END AS stage, o_orderkey % 11 = 0 AS is_syncpoint,
  [o_custkey % 40, o_custkey % 41] AS touched, CASE WHEN o_orderkey % 3 = 0 THEN [o_custkey % 37] ELSE [] END AS dropped FROM orders),
w AS (SELECT unnest(CASE WHEN is_syncpoint THEN [-1] ELSE touched END) AS table_id, seq, 0 AS drops, ddl_ts, stage = 'post' AS finished, is_syncpoint FROM e
  UNION ALL SELECT unnest(dropped), seq, 1, NULL, NULL, NULL FROM e WHERE stage = 'post' AND NOT is_syncpoint
  UNION ALL SELECT n_nationkey + 30, -1, 0, 5, true, false FROM nation),
l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY seq DESC, drops DESC) = 1),
t AS (SELECT table_id, ddl_ts, finished, is_syncpoint FROM l WHERE drops = 0)"""


def _control(spark, d) -> DataFrame:
    control = spark.read.parquet(f"{d}/nation.parquet").selectExpr("cast(n_nationkey + 30 as bigint) as table_id", "5L as ddl_ts", "true as finished", "false as is_syncpoint")
    events = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey as seq", "o_orderkey * 10 as ddl_ts", "if(o_orderkey % 2 = 0, 'post', 'pre') as stage", "o_orderkey % 11 = 0 as is_syncpoint", "array(o_custkey % 40, o_custkey % 41) as touched", "if(o_orderkey % 3 = 0, array(o_custkey % 37), cast(array() as array<bigint>)) as dropped")
    return bookkeeping.ddl_ts_after(control, events)


@register("q9_ddl_ts", f"WITH {_DDL_EVENTS} SELECT * FROM t")
def q9(spark, d):
    return _control(spark, d)


@register("q9_recovery", f"WITH {_DDL_EVENTS}, s AS (SELECT * FROM t WHERE table_id = -1), a AS (SELECT x AS table_id FROM range(60) AS r(x)), u AS (SELECT a.table_id, CASE WHEN t.ddl_ts IS NULL THEN NULL WHEN s.ddl_ts >= t.ddl_ts THEN s ELSE t END AS r FROM a LEFT JOIN t ON a.table_id = t.table_id LEFT JOIN s ON true) SELECT table_id, coalesce(CASE WHEN NOT r.finished AND NOT r.is_syncpoint THEN r.ddl_ts - 1 ELSE r.ddl_ts END, 0) AS start_ts, coalesce(r.finished AND r.is_syncpoint, false) AS skip_syncpoint, coalesce(NOT r.finished AND NOT r.is_syncpoint, false) AS skip_dml FROM u")
def q9b(spark, d):
    return bookkeeping.recovery(_control(spark, d), spark.range(60).withColumnRenamed("id", "table_id"))


@register("q10_progress", "WITH o AS (SELECT CASE n_regionkey WHEN 0 THEN 'gone' ELSE 'r' || n_regionkey END AS schema_name, n_name AS table_name, n_nationkey AS ts FROM nation), a AS (SELECT schema_name, table_name, CASE WHEN ts % 2 = 0 THEN 900 ELSE ts END AS checkpoint_ts FROM o UNION ALL SELECT 'new', r_name, 900 FROM region) SELECT schema_name, table_name, CAST(checkpoint_ts AS BIGINT) AS checkpoint_ts FROM a WHERE schema_name <> 'gone' AND table_name <> 'CHINA'")
def q10(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").selectExpr("if(n_regionkey = 0, 'gone', concat('r', n_regionkey)) as schema_name", "n_name as table_name", "cast(n_nationkey as bigint) as checkpoint_ts")
    names = n.where("checkpoint_ts % 2 = 0").select("schema_name", "table_name").unionByName(spark.read.parquet(f"{d}/region.parquet").selectExpr("'new' as schema_name", "r_name as table_name"))
    after = bookkeeping.progress_after(bookkeeping.progress_after(n, names, 900, 899), names, 901, 901)
    dropped = n.where("table_name = 'CHINA'").select("schema_name", "table_name").unionByName(spark.createDataFrame([("gone", None)], "schema_name string, table_name string"))
    return bookkeeping.progress_without(after, dropped)


@register("q11_syncpoints", "SELECT 'feed' || o_orderkey % 5 AS changefeed, o_orderkey // 5 AS primary_ts, o_orderkey AS secondary_ts, o_orderkey % 1000 AS age FROM orders WHERE o_orderkey % 1000 <= 600 UNION ALL SELECT 'feed' || o_orderkey % 5, o_orderkey // 5 + 1000000000, -o_orderkey, 0 FROM orders WHERE o_orderkey % 2 = 0")
def q11(spark, d):
    o, k, now = spark.read.parquet(f"{d}/orders.parquet"), F.col("o_orderkey"), F.timestamp_seconds(F.lit(2000000))
    feed = F.concat(F.lit("feed"), (k % 5).cast("string")).alias("changefeed")
    old = o.select(feed, F.floor(k / 5).alias("primary_ts"), k.alias("secondary_ts"), F.timestamp_seconds(F.lit(2000000) - k % 1000).alias("created_at"))
    again = o.select(feed, F.floor(k / 5).alias("primary_ts"), F.lit(0).cast("bigint").alias("secondary_ts"), now.alias("created_at"))
    new = o.where(k % 2 == 0).select(feed, (F.floor(k / 5) + 1000000000).alias("primary_ts"), (-k).alias("secondary_ts"), now.alias("created_at"))
    out = bookkeeping.syncpoints_after(old, again.unionByName(new), now, 600)
    return out.select("changefeed", "primary_ts", "secondary_ts", (F.lit(2000000) - F.col("created_at").cast("long")).alias("age"))


@register("k2_workers", C + ", k AS (SELECT CAST(row_key AS BIGINT) AS txn, unnest([coalesce(post_cust, pre_cust), table_id + 100000]) AS key FROM c), h AS (SELECT txn, CASE WHEN key % 3 = 0 THEN CAST(key % 4 AS INTEGER) END AS holder FROM k) SELECT txn, count(DISTINCT holder) = 0 AS free, count(DISTINCT holder) > 1 AS waits, CASE WHEN count(DISTINCT holder) = 1 THEN max(holder) END AS bound FROM h GROUP BY txn")
def k2(spark, d):
    c = derived.orders_changes(spark, d)
    key = F.explode(F.array(F.coalesce("post.cust", "pre.cust"), F.col("table_id") + 100000))
    keyed = c.select(F.col("row_key").cast("long").alias("txn"), key.alias("conflict_key")).withColumn("holder", F.when(F.col("conflict_key") % 3 == 0, (F.col("conflict_key") % 4).cast("int")))
    given = bookkeeping.assign_workers(keyed, "txn", 8)
    held = keyed.groupBy("txn").agg(F.count_distinct("holder").alias("n"))
    j = given.join(held, "txn")
    return j.select("txn", ((F.col("n") == 0) & F.col("worker").between(0, 7)).alias("free"), F.col("worker").isNull().alias("waits"), F.when(F.col("n") == 1, F.col("worker")).alias("bound"))


_OLD, _NEW = "[100 + n_nationkey, 200 + n_nationkey]", "[200 + n_nationkey, 300 + n_nationkey]"


def _effect(spark, d, kinds: list[str]) -> DataFrame:
    """Each nation is a table of two physical ones, of which one stays; kinds take turns."""
    k = F.col("n_nationkey").cast("bigint")
    pick = F.element_at(F.array(*[F.lit(x) for x in kinds]), (k % len(kinds) + 1).cast("int"))
    rows = spark.read.parquet(f"{d}/nation.parquet").select(
        F.col("n_nationkey").alias("nation"), pick.alias("ddl_type"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("schema_name"), F.col("n_name").alias("table_name"),
        F.array(k + 100, k + 200).alias("old_ids"), F.array(k + 200, k + 300).alias("new_ids"), F.when(k % 5 == 4, F.array(k + 900)).alias("like_ids"),
    )
    out = ddl.effects(rows)
    ids = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("blocked", "dropped", "added")]
    return out.select("nation", "ddl_type", "scope", *ids, "drop_schema", "drop_name", "add_name")


def _effect_sql(cases: list[tuple[str, str, str, str, str]], drop_schema: str = "NULL", drop_name: str = "NULL", add_name: str = "NULL") -> str:
    """cases: kind, scope, and the lists of ids as DuckDB lists."""
    n = len(cases)
    kind = f"CASE n_nationkey % {n} "
    pick = {c: kind + " ".join(f"WHEN {i} THEN {case[j]}" for i, case in enumerate(cases)) + " END" for j, c in enumerate(("k", "s", "b", "d", "a"))}
    return (
        f"SELECT n_nationkey AS nation, {pick['k']} AS ddl_type, {pick['s']} AS scope, array_to_string({pick['b']}, ',') AS blocked, coalesce(array_to_string({pick['d']}, ','), '') AS dropped, coalesce(array_to_string({pick['a']}, ','), '') AS added, "
        f"CAST({drop_schema} AS VARCHAR) AS drop_schema, CAST({drop_name} AS VARCHAR) AS drop_name, CAST({add_name} AS VARCHAR) AS add_name FROM nation"
    )


_FULL = "[0, 100 + n_nationkey, 200 + n_nationkey]"
_EMPTY = "CAST([] AS BIGINT[])"
_NAME = "'r' || n_regionkey || '.' || n_name"


@register("l1_schema_ddl", _effect_sql([("'create schema'", "'ddl'", "[0]", _EMPTY, _EMPTY), ("'drop schema'", "'schema'", _FULL, _OLD, _EMPTY), ("'modify schema charset and collate'", "'schema'", _FULL, _EMPTY, _EMPTY)], "CASE WHEN n_nationkey % 3 = 1 THEN 'r' || n_regionkey END"))
def l1(spark, d):
    return _effect(spark, d, ["create schema", "drop schema", "modify schema charset and collate"])


_LIKE = "CASE WHEN n_nationkey % 5 = 4 THEN [0, 900 + n_nationkey] ELSE [0] END"


@register("l2_table_ddl", _effect_sql([("'create table'", "'ddl'", _LIKE, _EMPTY, _NEW), ("'drop table'", "'table'", _FULL, _OLD, _EMPTY), ("'recover table'", "'ddl'", _LIKE, _EMPTY, _NEW), ("'create tables'", "'ddl'", _LIKE, _EMPTY, _NEW)], drop_name=f"CASE WHEN n_nationkey % 4 = 1 THEN {_NAME} END", add_name=f"CASE WHEN n_nationkey % 4 <> 1 THEN {_NAME} END"))
def l2(spark, d):
    return _effect(spark, d, ["create table", "drop table", "recover table", "create tables"])


@register("l3_truncate", _effect_sql([("'truncate table'", "'table'", _FULL, _OLD, _NEW)]))
def l3(spark, d):
    return _effect(spark, d, ["truncate table"])


@register("l5_column_ddl", _effect_sql([(f"'{k}'", "'single'", _OLD, _EMPTY, _EMPTY) for k in ("add column", "drop column", "modify column", "add index", "drop index", "rename index", "set default value")]))
def l5(spark, d):
    return _effect(spark, d, ["add column", "drop column", "modify column", "add index", "drop index", "rename index", "set default value"])


@register("l6_partition_ddl", _effect_sql([("'drop partition'", "'table'", _FULL, "[100 + n_nationkey]", "[300 + n_nationkey]"), ("'exchange partition'", "'tables'", _FULL, _EMPTY, _EMPTY), ("'alter partitioning'", "'table'", _FULL, _OLD, _NEW), ("'remove partitioning'", "'table'", _FULL, _OLD, _NEW)]))
def l6(spark, d):
    return _effect(spark, d, ["drop partition", "exchange partition", "alter partitioning", "remove partitioning"])


@register("l7_views", _effect_sql([("'create view'", "'all'", _EMPTY, _EMPTY, _EMPTY), ("'drop view'", "'all'", "[0]", _EMPTY, _EMPTY)]))
def l7(spark, d):
    return _effect(spark, d, ["create view", "drop view"])


@register("l7_view_names", "SELECT n_nationkey, 'CREATE VIEW v AS SELECT ''FROM x'' FROM `s' || n_regionkey || '`.`t' || n_nationkey || '` JOIN `a`.`b` JOIN `s' || n_regionkey || '`.u' AS query FROM nation")
def l7b(spark, d):
    query = F.concat(F.lit("CREATE VIEW v AS SELECT 'FROM x' FROM `t"), F.col("n_nationkey").cast("string"), F.lit("` JOIN `a`.`b` JOIN u"))
    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", ddl.view_with_schema(query, F.concat(F.lit("s"), F.col("n_regionkey").cast("string"))).alias("query"))


@register("l8_multi_change", "SELECT n_nationkey, part, change, change_type FROM nation, (VALUES (0, 'ADD COLUMN c INT DEFAULT 1', 'add column'), (1, 'DROP COLUMN b', 'drop column'), (2, 'ADD INDEX i(a,b)', 'add index'), (3, 'MODIFY e DECIMAL(10,2) COMMENT ''x, y''', 'modify column')) AS v(part, change, change_type)")
def l8(spark, d):
    query = "ALTER TABLE s.t ADD COLUMN c INT DEFAULT 1, DROP COLUMN b, ADD INDEX i(a,b), MODIFY e DECIMAL(10,2) COMMENT 'x, y';"
    return ddl.split_changes(spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.lit(query).alias("query"))).drop("query")


@register("a13_interval_wide", "SELECT o_orderkey AS probe, min(p.ts) AS ts FROM orders JOIN (SELECT p_partkey * 100000000000000 AS lo, (p_partkey + p_size) * 100000000000000 AS hi, p_partkey * 7 % 1000 AS ts FROM part) p ON p.lo < (o_orderkey % 300) * 100000000000000 + 50 AND (o_orderkey % 300) * 100000000000000 < p.hi GROUP BY 1")
def a13(spark, d):
    wide = 100000000000000
    key = F.col("p_partkey").cast("decimal(20,0)")  # of many parts the ends don't fit in 64 bits
    ranges = spark.read.parquet(f"{d}/part.parquet").select((key * wide).alias("lo"), ((key + F.col("p_size")) * wide).alias("hi"), (F.col("p_partkey") * 7 % 1000).alias("ts"))
    at = F.col("o_orderkey") % 300 * wide
    probes = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("probe"), at.alias("p_lo"), (at + 50).alias("p_hi"))
    return merging.interval_min(ranges, probes)


_TYPE_NAMES = [("TINYINT(4)", -6), ("smallint unsigned", 5), ("int(11)", 4), ("MEDIUMINT", 4), ("bigint", -5), ("float", 7), ("double", 8), ("decimal(10,2)", 3), ("timestamp", 93), ("datetime(6)", 93), ("date", 91), ("time", 92), ("year", 12), ("enum('a','b')", 4), ("set('a')", -7), ("bit(8)", -7), ("json", 12), ("char(3)", 1), ("varchar(20)", 12), ("text", 2005), ("longtext", 2005), ("blob", 2004), ("varbinary(9)", 2004), ("geometry", None)]


@register("c11_type_names", "SELECT n_nationkey AS nation, name, coalesce(number, 0) AS number FROM nation, (VALUES " + ", ".join(f"({_text(n)}, {'NULL' if k is None else k})" for n, k in _TYPE_NAMES) + ") AS t(name, number)")
def c11(spark, d):
    names = spark.createDataFrame([(n,) for n, _ in _TYPE_NAMES], "name string")
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("nation")).join(F.broadcast(names)).select("nation", "name", F.coalesce(codecs.java_type(F.col("name")), F.lit(0)).alias("number"))


def _varint(x: str) -> str:
    """SQL for the hex text of a zig-zag number that isn't negative."""
    n = f"greatest(1, CAST(ceil(length(bin(2 * {x})) / 7) AS INTEGER))"
    return f"array_to_string(list_transform(range(0, {n}), lambda i: printf('%02X', ((2 * {x}) >> (7 * i)) & 127 | CASE WHEN i + 1 < {n} THEN 128 ELSE 0 END)), '')"


def _avro_text(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '00' ELSE '02' || printf('%02X', 2 * length({x})) || hex(encode({x})) END"


def _avro_number(x: str) -> str:
    return f"'02' || {_varint(x)}"


_RECORD = " || ".join((_avro_number("{i}_key"), _avro_number("{i}_cust"), _avro_text("{i}_status"), _avro_number("{i}_price"), _avro_text("{i}_priority")))


@register("c7_avro", C + "SELECT row_key, '000000002A' || " + _RECORD.replace("{i}", "post") + " AS message FROM c WHERE row_type <> 'D'")
def c7(spark, d):
    c = derived.orders_changes(spark, d).where("row_type != 'D'")  # a delete has no value, only a key
    return c.select("row_key", F.hex(avro.envelope(avro.record(c), 42)).alias("message"))


@register("c8_debezium_avro", C + "SELECT row_key, '0000000007' || CASE WHEN row_type = 'I' THEN '00' ELSE '02' || " + _RECORD.replace("{i}", "pre") + " END || CASE WHEN row_type = 'D' THEN '00' ELSE '02' || " + _RECORD.replace("{i}", "post") + " END || CASE row_type WHEN 'I' THEN '0263' WHEN 'U' THEN '0275' ELSE '0264' END || " + _varint("(commit_ts // 262144)") + " AS message FROM c")
def c8(spark, d):
    return avro.debezium_avro(derived.orders_changes(spark, d), 7).select("row_key", F.hex("message").alias("message"))


@register("c10_consumer_checksum", C + "SELECT row_key, CAST(row_key AS BIGINT) % 50 = 7 AS corrupted FROM c WHERE row_type <> 'D'")
def c10(spark, d):
    """Rows whose checksum was taken before they were sent, checked after they were read back."""
    c = derived.orders_changes(spark, d).where("row_type != 'D'")
    names = list(derived.COLUMNS)
    sent = c.withColumn("sent", rewrite.row_checksum(names, "post"))
    spoilt = F.when(F.col("row_key").cast("long") % 50 == 7, F.col("post").withField("cust", F.col("post.cust") + 1)).otherwise(F.col("post"))
    message = codecs.canal_encode(sent.withColumn("post", spoilt), ["key"]).select("row_key", "sent", "message")
    kinds = {"key": "bigint", "cust": "bigint", "status": "string", "price": "bigint", "priority": "string"}
    texts = message.withColumn("m", F.from_json(F.get_json_object("message", "$.data[0]"), "map<string,string>"))
    read = texts.withColumn("post", F.struct(*[F.col("m")[n].cast(k).alias(n) for n, k in kinds.items()]))
    return rewrite.verify_checksum(read, names, "post", "sent").select("row_key", "corrupted")


@register("q5_where_handle", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'a' WHEN o_orderkey % 5 <> 0 THEN 'b,c' ELSE 'a,b,c' END AS handle, 'k' AS fixed FROM orders")
def q5(spark, d):
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.struct(F.when(k % 3 != 0, k).alias("a"), k.alias("b"), F.when(k % 5 != 0, k).alias("c")).alias("pre"))
    unique = [{"unique": True, "columns": ["a"]}, {"unique": True, "columns": ["b", "c"]}]
    by_data = codecs.where_handle("pre", unique, ["a", "b", "c"])
    fixed = codecs.where_handle("pre", [*unique, {"not_null_unique": True, "columns": ["u"]}, {"primary": True, "columns": ["k"]}], ["a", "b", "c"])
    return o.select("o_orderkey", F.array_join(by_data, ",").alias("handle"), F.array_join(fixed, ",").alias("fixed"))


@register("q8_index_names", "SELECT n_nationkey, 'ALTER TABLE t ADD UNIQUE KEY `i' || n_nationkey || '` (a, b)' AS named, 'ALTER TABLE t ADD INDEX j (a)' AS kept, true AS waits, false AS column_waits FROM nation")
def q8(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey")
    name = F.concat(F.lit("i"), F.col("n_nationkey").cast("string"))
    plain, given = F.lit("ALTER TABLE t ADD UNIQUE KEY (a, b)"), F.lit("ALTER TABLE t ADD INDEX j (a)")
    return n.select("n_nationkey", ddl.named_index(plain, name).alias("named"), ddl.named_index(given, name).alias("kept"), ddl.waits_for_index(plain).alias("waits"), ddl.waits_for_index(F.lit("ALTER TABLE t ADD COLUMN a INT")).alias("column_waits"))


@register("t6_barrier", "WITH e AS (SELECT o_orderkey % 97 AS event, o_custkey % 60 AS span FROM orders GROUP BY ALL), a AS (SELECT * FROM e WHERE span % 7 <> 3), s AS (SELECT event, span, NOT (event % 5 = 0 AND span % 4 = 0) AS here FROM a), g AS (SELECT event, bool_and(here) AS ok, min(span) AS w FROM s GROUP BY 1) SELECT event, span, CASE WHEN NOT ok THEN 'wait' WHEN span = w THEN 'write' ELSE 'pass' END AS action FROM s JOIN g USING (event)")
def t6(spark, d):
    events = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey % 97 as event", "o_custkey % 60 as span").distinct()
    alive = spark.range(60).where("id % 7 != 3").withColumnRenamed("id", "span")
    return bookkeeping.barrier(events, events.where("not (event % 5 = 0 and span % 4 = 0)"), alive)


@register("s6_released_jobs", "SELECT table_id, version, CAST(row_number() OVER (PARTITION BY table_id ORDER BY version) AS INTEGER) AS seq FROM (SELECT o_orderkey % 20 AS table_id, o_orderkey AS version FROM orders WHERE o_orderkey % 3 <> 0) WHERE version <= 1000")
def s6(spark, d):
    jobs = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey % 20 as table_id", "o_orderkey as version", "if(o_orderkey % 3 = 0, 'running', 'done') as state")
    return bookkeeping.released_jobs(jobs, spark.range(1000, 1001).withColumnRenamed("id", "resolved_ts")).select("table_id", "version", "seq")


@register("f17_filter_helper", "SELECT * FROM (VALUES ('shop', 'a', 'add column', true, true, true), ('shop', 'a', 'truncate table', true, true, false), ('audit', 'a', 'add column', false, true, false), ('mysql', 'user', 'create table', false, true, false), ('Shop', 'tmp', 'odd kind', false, false, false)) AS t(schema_name, table_name, ddl_type, table_matches, ddl_allowed, ddl_ignored)")
def f17(spark, d):
    tables = TableRules(("shop.*", "mysql.*", "!*.tmp"))
    rules = [filters.EventRule(("shop.*",), ("alter table",))]
    asked = [("shop", "a", "add column"), ("shop", "a", "truncate table"), ("audit", "a", "add column"), ("mysql", "user", "create table"), ("Shop", "tmp", "odd kind")]
    rows = [(s, t, k, *filters.explain_filter(tables, rules, s, t, k).values()) for s, t, k in asked]
    return spark.createDataFrame(rows, "schema_name string, table_name string, ddl_type string, table_matches boolean, ddl_allowed boolean, ddl_ignored boolean")


_NAMED_DDL = f"SELECT *, regexp_extract(query, 'TABLE (\\w+)\\.(\\w+)', 1) AS schema_name, regexp_extract(query, 'TABLE (\\w+)\\.(\\w+)', 2) AS table_name FROM ({derived.DDL_SQL})"


def _ddl(spark) -> DataFrame:
    name = [F.regexp_extract("query", r"TABLE (\w+)\.(\w+)", n) for n in (1, 2)]
    return derived.ddl_history(spark).withColumns({"schema_name": name[0], "table_name": name[1]})


@register("c3_canal_ddl", f"SELECT 'ddl' AS kind, version AS ts, schema_name, table_name, query FROM ({_NAMED_DDL}) UNION ALL SELECT 'watermark', n_nationkey, '', '', '' FROM nation UNION ALL SELECT 'row', commit_ts, schema_name, table_name, '' FROM ({ORDERS_SQL})")
def c3(spark, d):
    marks = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("ts"))
    rows = codecs.canal_encode(derived.orders_changes(spark, d), ["key"])
    messages = codecs.canal_ddl(_ddl(spark)).select("message").unionByName(codecs.canal_watermark(marks).select("message")).unionByName(rows.select("message"))
    return codecs.canal_decode_events(messages).na.fill("", ["schema_name", "table_name", "query"])


@register("c5_simple_ddl", f"SELECT version, table_id, CASE ddl_type WHEN 'create table' THEN 'CREATE' WHEN 'drop table' THEN 'ERASE' WHEN 'truncate table' THEN 'TRUNCATE' WHEN 'rename table' THEN 'RENAME' ELSE 'ALTER' END AS type, query AS sql, schema_name AS database FROM ({_NAMED_DDL})")
def c5(spark, d):
    m = codecs.simple_ddl(_ddl(spark))
    return m.select("version", "table_id", *[F.get_json_object("message", f"$.{n}").alias(n) for n in ("type", "sql", "database")])


@register("changefeed_ddl", f"SELECT table_id, version, CASE WHEN schema_name = 'audit' THEN 'audit' ELSE 'to_' || schema_name END AS target_schema, 'ddl_' || schema_name AS topic, 0 AS partition FROM ({_NAMED_DDL}) WHERE schema_name IN ('shop', 'audit') AND ddl_type <> 'drop table'")
def feed_ddl(spark, d):
    feed = Changefeed.from_dict({"filter": {"rules": ["shop.*", "audit.*"], "event-filters": [{"matcher": ["*.*"], "ignore-event": ["drop table"]}]}, "sink": {"routes": [{"matcher": ["shop.*"], "schema": "to_{schema}"}], "topics": [{"matcher": ["*.*"], "topic": "ddl_{schema}"}], "protocol": "canal-json"}})
    return feed.run_ddl(_ddl(spark)).select("table_id", "version", "target_schema", "topic", "partition")


@register("changefeed_policies", C + "SELECT row_key, row_type, partition FROM (SELECT row_key, row_type, commit_ts % 8 AS partition FROM c WHERE row_type <> 'D' AND NOT (row_type = 'I' AND post_price * 2 > 30000000) AND post_cust % 4 <> 0)")
def feed_policies(spark, d):
    c = derived.orders_changes(spark, d)
    peer = F.when(F.col("post.cust") % 4 == 0, F.col("commit_ts"))
    c = c.withColumn("post", F.when(F.col("post").isNotNull(), F.col("post").withField("origin", peer))).withColumn("pre", F.when(F.col("pre").isNotNull(), F.col("pre").withField("origin", F.lit(None).cast("bigint"))))
    feed = Changefeed.from_dict({"filter": {"event-filters": [{"matcher": ["*.*"], "ignore-insert-value-expr": "twice > 30000000"}]}, "virtual-columns": {"twice": "price * 2"}, "row-policy": "active-active", "origin-column": "origin", "sink": {"partition": "ts"}})
    return feed.run(c).select("row_key", "row_type", "partition")


@register("a4_broken_alternation", "WITH r AS (SELECT event_id AS seq, event_id % 50 AS key, CASE event_id * 7 % 11 % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'U' ELSE 'D' END AS row_type FROM events), l AS (SELECT *, lag(row_type) OVER (PARTITION BY key ORDER BY seq) AS before FROM r) SELECT key, seq, before, row_type FROM l WHERE (row_type = 'I' AND before IN ('I', 'U')) OR (row_type <> 'I' AND before = 'D')")
def a4(spark, d):
    k = F.col("event_id")
    kind = F.when(k * 7 % 11 % 3 == 0, "I").when(k * 7 % 11 % 3 == 1, "U").otherwise("D")
    rows = spark.read.parquet(f"{d}/events.parquet").select(k.alias("seq"), (k % 50).alias("key"), kind.alias("row_type"))
    return merging.broken_alternation(rows, ["key"], "seq")


def _json(pairs: list[tuple[str, str]]) -> str:
    """SQL for the text of a JSON object; values are SQL for texts."""
    return "'{' || " + " || ',' || ".join(f"'\"{n}\":' || {v}" for n, v in pairs) + " || '}'"


def _quoted(x: str) -> str:
    return f"'\"' || {x} || '\"'"


def _plain(image: str, text: bool) -> str:
    """SQL for an image's JSON: numbers as they are, or all as text."""
    return _json([(n, f"CAST({image}_{n} AS VARCHAR)" if n in ("key", "cust", "price") and not text else _quoted(f"{image}_{n}")) for n in derived.COLUMNS])


_CANAL = _json([
    ("id", "'0'"), ("database", _quoted("schema_name")), ("table", _quoted("table_name")), ("pkNames", "'[\"key\"]'"), ("isDdl", "'false'"),
    ("type", "CASE row_type WHEN 'I' THEN '\"INSERT\"' WHEN 'U' THEN '\"UPDATE\"' ELSE '\"DELETE\"' END"), ("es", "commit_ts // 262144"), ("sql", "'\"\"'"),
    ("sqlType", "'{\"key\":-5,\"cust\":-5,\"status\":12,\"price\":-5,\"priority\":12}'"), ("mysqlType", "'{\"key\":\"bigint\",\"cust\":\"bigint\",\"status\":\"varchar\",\"price\":\"bigint\",\"priority\":\"varchar\"}'"),
    ("old", f"CASE WHEN row_type = 'U' THEN '[' || {_plain('pre', True)} || ']' ELSE 'null' END"), ("data", f"'[' || CASE WHEN row_type = 'D' THEN {_plain('pre', True)} ELSE {_plain('post', True)} END || ']'"), ("_ext", "'{\"commitTs\":' || commit_ts || '}'"),
])


@register("c2_canal_text", C + f"SELECT row_key, {_CANAL} AS message FROM c")
def c2_text(spark, d):
    return codecs.canal_encode(derived.orders_changes(spark, d), ["key"]).select("row_key", "message")


def _cells(image: str) -> str:
    cell = {"key": ("8,\"h\":true,\"f\":10", False), "cust": ("8,\"f\":64", False), "status": ("15,\"f\":64", True), "price": ("8,\"f\":64", False), "priority": ("15,\"f\":64", True)}
    return _json([(n, f"'{{\"t\":{head},\"v\":' || " + (_quoted(f"{image}_{n}") if text else f"{image}_{n}") + " || '}'") for n, (head, text) in cell.items()])


_OPEN = C + ", o AS (SELECT *, " + _json([("ts", "commit_ts"), ("scm", _quoted("schema_name")), ("tbl", _quoted("table_name")), ("t", "'1'")]) + f" AS k, CASE row_type WHEN 'D' THEN '{{\"d\":' || {_cells('pre')} WHEN 'I' THEN '{{\"u\":' || {_cells('post')} ELSE '{{\"u\":' || {_cells('post')} || ',\"p\":' || {_cells('pre')} END || '}}' AS v FROM c)"


@register("c4_open_text", _OPEN + " SELECT row_key, k AS msg_key, v AS msg_value FROM o")
def c4_text(spark, d):
    return codecs.open_encode(derived.orders_changes(spark, d), ["key"]).select("row_key", "msg_key", "msg_value")


@register("c4_open_bytes", _OPEN + """, n AS (SELECT *, row_number() OVER (PARTITION BY schema_name ORDER BY commit_ts, k, v) AS n FROM o)
SELECT schema_name AS topic, CAST((n - 1) // 16 AS BIGINT) AS batch, sha256('0000000000000001' || string_agg(printf('%016X', length(k)) || hex(encode(k)), '' ORDER BY n)) AS key_frame, sha256(string_agg(printf('%016X', length(v)) || hex(encode(v)), '' ORDER BY n)) AS value_frame FROM n GROUP BY schema_name, (n - 1) // 16""")
def c4_bytes(spark, d):
    m = codecs.open_encode(derived.orders_changes(spark, d), ["key"]).withColumns({"topic": F.col("schema_name"), "partition": F.lit(0)})
    return codecs.open_frames(m).select("topic", F.col("batch").cast("bigint").alias("batch"), *[F.sha2(F.hex(c), 256).alias(c) for c in ("key_frame", "value_frame")])


_SOURCE = _json([("connector", "'\"mysql\"'"), ("cluster_id", "'\"one\"'"), ("ts_ms", "commit_ts // 262144"), ("db", _quoted("schema_name")), ("table", _quoted("table_name")), ("commit_ts", "commit_ts")])


@register("c6_debezium_text", C + f"SELECT row_key, '{{\"payload\":{{\"source\":' || {_SOURCE} || ',\"ts_ms\":' || commit_ts // 262144 || ',\"op\":\"' || CASE row_type WHEN 'I' THEN 'c' WHEN 'U' THEN 'u' ELSE 'd' END || '\"' || CASE WHEN row_type <> 'I' THEN ',\"before\":' || {_plain('pre', False)} ELSE '' END || CASE WHEN row_type <> 'D' THEN ',\"after\":' || {_plain('post', False)} ELSE '' END || '}}}}' AS message FROM c")
def c6_text(spark, d):
    return codecs.debezium_encode(derived.orders_changes(spark, d), "one").select("row_key", "message")
