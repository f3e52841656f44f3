"""Queries on filters, rewriting, routing, schemas and codecs, with their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions import codecs
from changeloom.functions.globs import TableRules
from changeloom.operators import filters, rewrite, routing, schemas
from changeloom.operators.filters import EventRule
from changeloom.plans.catalog import crc_sql, register
from changeloom.plans.changefeed import Changefeed
from changeloom.sources import derived
from changeloom.sources.derived import COLUMNS, DDL_SQL, ORDERS_SQL
from changeloom.sources.work import work_dir

KINDS = {"key": "bigint", "cust": "bigint", "status": "string", "price": "bigint", "priority": "string"}
FLAT = [f"{i}_{c}" for i in ("pre", "post") for c in COLUMNS]
C = f"WITH c AS ({ORDERS_SQL}) "
HEAD = "schema_name, table_name, commit_ts, row_type, row_key"
ROWS = f"{HEAD}, " + ", ".join(FLAT)


NUMBERS = ("key", "cust", "price")


def flat(df: DataFrame, *more: str) -> DataFrame:
    """Images as columns; a missing number is -1, so that results have no nullable integers."""
    images = [F.coalesce(f"{i}.{c}", F.lit(-1)).alias(f"{i}_{c}") if c in NUMBERS else F.col(f"{i}.{c}").alias(f"{i}_{c}") for i in ("pre", "post") for c in COLUMNS]
    return df.select("schema_name", "table_name", "commit_ts", "row_type", "row_key", *images, *more)


def flat_sql(sql: str) -> str:
    return "SELECT * REPLACE (" + ", ".join(f"coalesce({i}_{c}, -1) AS {i}_{c}" for i in ("pre", "post") for c in NUMBERS) + f") FROM ({sql})"


def brief(df: DataFrame, *more: str | Column) -> DataFrame:
    return df.select("row_key", "row_type", *more)


RULES = TableRules(("shop*.*", "audit.orders_[1]", "audit.orders_2", "!*.orders_5"))
_RULES_SQL = "((lower(schema_name) LIKE 'shop%' OR (lower(schema_name) = 'audit' AND table_name = 'orders_2')) AND table_name <> 'orders_5')"


@register("f1_table_filter", flat_sql(C + f"SELECT {ROWS} FROM c WHERE {_RULES_SQL}"))
def f1(spark, d):
    return flat(filters.table_filter(derived.orders_changes(spark, d), RULES))


@register("f2_system_schemas", C + "SELECT row_key, row_type, schema_name FROM (SELECT * REPLACE (CASE WHEN schema_name = 'audit' THEN 'MySQL' ELSE schema_name END AS schema_name) FROM c) WHERE schema_name <> 'MySQL'")
def f2(spark, d):
    df = derived.orders_changes(spark, d).withColumn("schema_name", F.when(F.col("schema_name") == "audit", "MySQL").otherwise(F.col("schema_name")))
    return brief(filters.table_filter(df, TableRules()), "schema_name")


@register("f3_schema_filter", C + "SELECT schema_name, lower(schema_name) LIKE 'shop%' AS wanted FROM c GROUP BY schema_name")
def f3(spark, d):
    df = derived.orders_changes(spark, d).select("schema_name").distinct()
    return df.withColumn("wanted", TableRules(("shop*.*", "audit.x", "!audit.*")).schema_column(F.col("schema_name")))


@register("f4_start_ts", C + "SELECT row_key, row_type, start_ts FROM c WHERE start_ts NOT IN (SELECT start_ts FROM c WHERE row_key IN ('1', '2', '33'))")
def f4(spark, d):
    df = derived.orders_changes(spark, d)
    some = df.where(F.col("row_key").isin("1", "2", "33")).select("start_ts")
    return brief(df.join(some, "start_ts", "left_anti"), "start_ts")


_EVENTS = [EventRule(("shop.*",), ("delete", "drop table")), EventRule(("audit.orders_?",), ("all dml",)), EventRule(("*.*",), ("none",))]


@register("f5_event_type", flat_sql(C + f"SELECT {ROWS} FROM c WHERE NOT ((schema_name = 'shop' AND row_type = 'D') OR schema_name = 'audit')"))
def f5(spark, d):
    return flat(filters.event_filter(derived.orders_changes(spark, d), _EVENTS))


def ddl_named(spark) -> DataFrame:
    """The schema history with names split from its statements."""
    name = F.regexp_extract("query", r"TABLE (\w+)\.(\w+)", 1), F.regexp_extract("query", r"TABLE (\w+)\.(\w+)", 2)
    return derived.ddl_history(spark).withColumns({"schema_name": name[0], "table_name": name[1]})


_DDL = f"WITH d AS (SELECT *, regexp_extract(query, 'TABLE (\\w+)\\.(\\w+)', 1) AS schema_name, regexp_extract(query, 'TABLE (\\w+)\\.(\\w+)', 2) AS table_name FROM ({DDL_SQL})) "


@register("f6_ddl_event_type", _DDL + "SELECT table_id, version, ddl_type, (schema_name = 'shop' AND ddl_type IN ('add column', 'drop column')) OR (schema_name = 'audit' AND ddl_type = 'rename table') AS ignored FROM d")
def f6(spark, d):
    rules = [EventRule(("shop.*",), ("alter table",)), EventRule(("audit.*",), ("rename table",))]
    return filters.ddl_event_filter(ddl_named(spark), rules).select("table_id", "version", "ddl_type", "ignored")


@register("f7_ddl_regex", _DDL + "SELECT table_id, version, query, regexp_matches(query, '^DROP') OR regexp_matches(query, '(?i)add column') AS ignored FROM d")
def f7(spark, d):
    return filters.ddl_event_filter(ddl_named(spark), [EventRule(("*.*",), (), ("^DROP", "(?i)add column"))]).select("table_id", "version", "query", "ignored")


_VALUES = [EventRule(("*.*",), (), (), "price > 20000000 or status = 'F'", "cust % 2 = 0", "status = 'P'", "price - price + 2")]


@register("f8_value_expr", flat_sql(C + f"SELECT {ROWS} FROM c WHERE NOT coalesce(CASE row_type WHEN 'I' THEN post_price > 20000000 OR post_status = 'F' WHEN 'D' THEN pre_cust % 2 = 0 ELSE pre_status = 'P' END, false)"))
def f8(spark, d):
    return flat(filters.value_filter(derived.orders_changes(spark, d), _VALUES))


@register("f9_virtual_columns", C + "SELECT row_key, row_type FROM c WHERE NOT (row_type = 'I' AND post_price * 2 > 30000000)")
def f9(spark, d):
    df = filters.fill_virtual(derived.orders_changes(spark, d), {"twice": "price * 2"})
    return brief(filters.value_filter(df, [EventRule(("*.*",), ignore_insert_expr="twice > 30000000")]))


@register("f10_update_only_columns", flat_sql(C + f"SELECT {ROWS} FROM c WHERE NOT (row_type = 'U' AND pre_key = post_key AND pre_cust = post_cust AND pre_status IS NOT DISTINCT FROM post_status AND pre_priority = post_priority)"))
def f10(spark, d):
    return flat(filters.update_only_filter(derived.orders_changes(spark, d), ["price"], ["key"], list(COLUMNS)))


@register("f11_ddl_verdict", _DDL + "SELECT table_id, version, schema_name = 'audit' AS discarded, ddl_type LIKE 'drop%' AS ignored, CASE WHEN ddl_type = 'create table' THEN 'ddl' WHEN ddl_type IN ('add column', 'drop column') THEN 'single' WHEN ddl_type = 'rename table' THEN 'tables' ELSE 'table' END AS scope FROM d")
def f11(spark, d):
    v = filters.ddl_verdict(ddl_named(spark), TableRules(("shop*.*",)), [EventRule(("*.*",), ("drop table", "drop column"))])
    return v.select("table_id", "version", "discarded", "ignored", "scope")


@register("f13_eligible", "SELECT n_nationkey AS id, n_nationkey % 7 <> 0 AND (n_nationkey % 5 = 0 OR n_nationkey % 2 = 0) AS ok FROM nation")
def f13(spark, d):
    n = F.col("n_nationkey")
    t = spark.read.parquet(f"{d}/nation.parquet").select(n.alias("id"), (n % 7 == 0).alias("is_sequence"), (n % 5 == 0).alias("is_view"), (n % 2 == 0).alias("has_key"))
    return t.select("id", filters.eligible(t).alias("ok"))


@register("f15_stale", C + ", r AS (SELECT table_id, min(commit_ts) + (max(commit_ts) - min(commit_ts)) // 2 AS resolved_ts FROM c WHERE table_id < 20 GROUP BY 1) SELECT row_key, row_type FROM c LEFT JOIN r USING (table_id) WHERE resolved_ts IS NULL OR commit_ts >= resolved_ts")
def f15(spark, d):
    df = derived.orders_changes(spark, d)
    marks = df.where("table_id < 20").groupBy("table_id").agg(F.expr("min(commit_ts) + (max(commit_ts) - min(commit_ts)) div 2").alias("resolved_ts"))
    return brief(filters.drop_stale(df, marks))


@register("f16_skip_at_start", "SELECT key, seq FROM (" + derived.ITEMS_SQL + ") WHERE commit_ts <> 2003")
def f16(spark, d):
    return filters.skip_dml_at_start(derived.item_changes(spark, d), 2002).select("key", "seq")


_SELECTORS = [rewrite.ColumnSelector(("shop.*",), ("*", "!price")), rewrite.ColumnSelector(("audit.*",), ("key", "s*"))]


def _selected(i: str, c: str) -> str:
    shop, audit = c != "price", c in ("key", "status")
    return f"CASE schema_name WHEN 'shop' THEN {f'{i}_{c}' if shop else 'NULL'} WHEN 'audit' THEN {f'{i}_{c}' if audit else 'NULL'} ELSE {i}_{c} END AS {i}_{c}"


@register("p1_column_selector", flat_sql(C + f"SELECT {HEAD}, " + ", ".join(_selected(i, c) for i in ("pre", "post") for c in COLUMNS) + " FROM c"))
def p1(spark, d):
    return flat(rewrite.select_columns(derived.orders_changes(spark, d), _SELECTORS, list(COLUMNS)))


_SPLIT = (
    "SELECT schema_name, table_name, commit_ts, 'D' AS row_type, row_key, 1 AS dml_order, "
    + ", ".join(f"pre_{c}" for c in COLUMNS) + ", " + ", ".join(f"NULL AS post_{c}" for c in COLUMNS) + " FROM c WHERE row_type = 'U' AND pre_key <> post_key"
    + " UNION ALL SELECT schema_name, table_name, commit_ts, 'I', row_key, 3, " + ", ".join("NULL" for _ in COLUMNS) + ", " + ", ".join(f"post_{c}" for c in COLUMNS) + " FROM c WHERE row_type = 'U' AND pre_key <> post_key"
    + f" UNION ALL SELECT {HEAD}, dml_order, " + ", ".join(FLAT) + " FROM c WHERE NOT (row_type = 'U' AND pre_key <> post_key)"
)


@register("p3_update_split", flat_sql(C + _SPLIT))
def p3(spark, d):
    return flat(rewrite.split_updates(derived.orders_changes(spark, d), ["key"]), "dml_order")


def soft(spark, d) -> DataFrame:
    """Orders with a soft-delete time: set in the after image of every third update, in the before image of few."""
    df, k = derived.orders_changes(spark, d), F.col("row_key").cast("long")
    return df.withColumn("pre", F.col("pre").withField("gone_at", F.when(k % 9 == 0, F.lit(1)))).withColumn("post", F.col("post").withField("gone_at", F.when(k % 3 == 0, F.lit(2))))


@register("p5_soft_delete", C + "SELECT row_key, CASE WHEN gone THEN 'D' ELSE row_type END AS row_type, CASE WHEN gone THEN -1 ELSE post_key END AS post_key FROM (SELECT *, row_type = 'U' AND CAST(row_key AS BIGINT) % 3 = 0 AND CAST(row_key AS BIGINT) % 9 <> 0 AS gone FROM c WHERE row_type <> 'D')")
def p5(spark, d):
    return brief(rewrite.row_policy(soft(spark, d), False, "gone_at"), F.coalesce("post.key", F.lit(-1)).alias("post_key"))


@register("p5_active_active", C + "SELECT row_key, row_type FROM c WHERE row_type <> 'D'")
def p5b(spark, d):
    return brief(rewrite.row_policy(soft(spark, d), True, "gone_at"))


@register("p6_origin_loops", C + "SELECT row_key, row_type FROM c WHERE row_type = 'D' OR CAST(row_key AS BIGINT) % 3 <> 0")
def p6(spark, d):
    return brief(rewrite.break_loops(soft(spark, d), "gone_at"))


@register("p7_source_id", C + "SELECT row_key, row_type FROM c WHERE CAST(row_key AS BIGINT) % 4 <> 2")
def p7(spark, d):
    return brief(rewrite.from_source(derived.orders_changes(spark, d).withColumn("source_id", F.col("row_key").cast("long") % 4), 2))


@register("p8_handle_key_only", C + "SELECT row_key, row_type, coalesce(pre_key, -1) AS pre_key, coalesce(CASE WHEN row_type <> 'D' THEN pre_price END, -1) AS pre_price, coalesce(post_price, -1) AS post_price FROM c")
def p8(spark, d):
    df = rewrite.handle_key_only(derived.orders_changes(spark, d), ["key"], F.col("row_type") == "D")
    return brief(df, *[F.coalesce(c, F.lit(-1)).alias(c.replace(".", "_")) for c in ("pre.key", "pre.price", "post.price")])


@register("p9_updated_columns", C + "SELECT row_key, CASE WHEN pre_price <> post_price THEN CAST(pre_price AS VARCHAR) END AS old_price, CASE WHEN pre_status <> post_status THEN pre_status END AS old_status, CASE WHEN pre_key <> post_key THEN CAST(pre_key AS VARCHAR) END AS old_key FROM c WHERE row_type = 'U'")
def p9(spark, d):
    df = rewrite.updated_columns_only(derived.orders_changes(spark, d), list(COLUMNS)).where("row_type = 'U'")
    return df.select("row_key", F.col("old")["price"].alias("old_price"), F.col("old")["status"].alias("old_status"), F.col("old")["key"].alias("old_key"))


@register("p10_op_name", C + "SELECT row_key, CASE row_type WHEN 'I' THEN 'insert' WHEN 'U' THEN 'update' ELSE 'delete' END AS op FROM c")
def p10(spark, d):
    return rewrite.op_name(derived.orders_changes(spark, d)).select("row_key", "op")


def raw_kv(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("value"), F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("old_value"))


_KV = "WITH kv AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS value, CASE WHEN event_id % 2 = 0 THEN props END AS old_value FROM events) "


@register("d1_decode_slots", _KV + "SELECT event_id, CASE WHEN value IS NULL THEN 'D' WHEN old_value IS NULL THEN 'I' ELSE 'U' END AS row_type, 0 AS slot, old_value AS row FROM kv WHERE old_value IS NOT NULL UNION ALL SELECT event_id, CASE WHEN old_value IS NULL THEN 'I' ELSE 'U' END, 1, value FROM kv WHERE value IS NOT NULL")
def d1(spark, d):
    return rewrite.decode(raw_kv(spark, d), slots=True).select("event_id", "row_type", "slot", "row")


@register("d2_empty_changes", _KV + "SELECT event_id, CASE WHEN value IS NULL THEN 'D' WHEN old_value IS NULL THEN 'I' ELSE 'U' END AS row_type FROM kv WHERE value IS NOT NULL OR old_value IS NOT NULL")
def d2(spark, d):
    return rewrite.decode(raw_kv(spark, d)).select("event_id", "row_type")


_IMAGE_TEXT = "concat_ws('', " + ", ".join(f"coalesce(length(CAST(post_{c} AS VARCHAR)) || ':' || post_{c}, '-1:')" for c in COLUMNS) + ")"


@register("d3_row_checksum", crc_sql(f"SELECT *, {_IMAGE_TEXT} AS text FROM ({ORDERS_SQL}) WHERE row_type <> 'D'", "SELECT row_key, CASE WHEN CAST(row_key AS BIGINT) % 50 = 7 THEN crc + 1 ELSE crc END AS sent, CAST(row_key AS BIGINT) % 50 = 7 AS corrupted FROM x"))
def d3(spark, d):
    df = derived.orders_changes(spark, d).where("row_type != 'D'")
    good = rewrite.row_checksum(list(COLUMNS), "post")
    df = df.withColumn("sent", F.when(F.col("row_key").cast("long") % 50 == 7, good + 1).otherwise(good))
    return rewrite.verify_checksum(df, list(COLUMNS), "post", "sent").select("row_key", "sent", "corrupted")


@register("d4_keyspace", "SELECT event_id, CASE WHEN k LIKE 'x%' THEN substr(k, 5) ELSE k END AS stripped FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'x001' ELSE '' END || event_type AS k FROM events)")
def d4(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.concat(F.when(F.col("event_id") % 2 == 0, "x001").otherwise(""), F.col("event_type")).alias("k"))
    return e.select("event_id", rewrite.strip_keyspace(F.col("k")).alias("stripped"))


_AS_OF = C + f", v AS (SELECT *, coalesce(lead(version) OVER (PARTITION BY table_id ORDER BY version), 9223372036854775807) AS next_version FROM ({DDL_SQL})) SELECT row_key, row_type, version, n_columns FROM c JOIN v ON c.table_id = v.table_id AND version < commit_ts AND commit_ts <= next_version WHERE NOT deleted"


@register("d5_schema_as_of", _AS_OF)
def d5(spark, d):
    return brief(schemas.as_of(derived.orders_changes(spark, d), derived.ddl_history(spark)), "version", "n_columns")


@register("j2_schema_merge", _AS_OF)
def j2(spark, d):
    return brief(schemas.as_of_merge(derived.orders_changes(spark, d), derived.ddl_history(spark)), "version", "n_columns")


@register("d6_defaults", "SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_size END, CASE WHEN p_size % 2 = 0 THEN -1 END, -2) AS value FROM part")
def d6(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", rewrite.default_value(F.when(F.col("p_size") % 3 == 0, F.col("p_size")), F.coalesce(F.when(F.col("p_size") % 2 == 0, F.lit(-1)), F.lit(-2))).alias("value"))


_ROUTES = [routing.Route(("shop.orders_1",), "hot", ""), routing.Route(("shop*.*",), "target_{schema}", "{table}_routed")]
_ROUTED = C + ", r AS (SELECT *, CASE WHEN schema_name = 'shop' AND table_name = 'orders_1' THEN 'hot' WHEN schema_name IN ('shop', 'Shop_Archive') THEN 'target_' || schema_name ELSE schema_name END AS target_schema, CASE WHEN schema_name IN ('shop', 'Shop_Archive') AND NOT (schema_name = 'shop' AND table_name = 'orders_1') THEN table_name || '_routed' ELSE table_name END AS target_table FROM c) "


@register("r1_route", _ROUTED + "SELECT row_key, row_type, target_schema, target_table FROM r")
def r1(spark, d):
    return brief(routing.route(derived.orders_changes(spark, d), _ROUTES), "target_schema", "target_table")


@register("r2_schema_ambiguity", _ROUTED + "SELECT schema_name, count(DISTINCT target_schema) AS targets FROM r GROUP BY 1 HAVING targets > 1")
def r2(spark, d):
    return routing.ambiguous_schemas(routing.route(derived.orders_changes(spark, d), _ROUTES))


@register("r3_route_conflicts", C + "SELECT 'one' AS target_schema, table_name AS target_table, count(DISTINCT schema_name) AS sources FROM c GROUP BY 2 HAVING sources > 1")
def r3(spark, d):
    return routing.conflicts(routing.route(derived.orders_changes(spark, d), [routing.Route(("*.*",), "one", "{table}")]))


@register("r4_route_admission", "SELECT 't' || n_nationkey AS target, 'n' || n_nationkey AS source, NOT (n_nationkey % 2 = 0 AND n_nationkey % 4 <> 0) AS admitted FROM nation")
def r4(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey")
    k = F.col("n_nationkey")
    owners = n.where(k % 2 == 0).select(F.concat(F.lit("t"), k).alias("target"), F.concat(F.lit("o"), k).alias("source"))
    gone = n.where(k % 4 == 0).select(F.concat(F.lit("t"), k).alias("target"), F.concat(F.lit("o"), k).alias("source"), F.lit(True).alias("removed"))
    new = n.select(F.concat(F.lit("t"), k).alias("target"), F.concat(F.lit("n"), k).alias("source"), F.lit(False).alias("removed"))
    return routing.admit(owners, gone.unionByName(new)).select("target", "source", "admitted")


_TOPICS = [routing.TopicRule(("shop.*",), "pre.{schema}+{table}"), routing.TopicRule(("audit.*",), "{schema}")]
_TOPIC = "CASE schema_name WHEN 'shop' THEN 'pre.shop_' || table_name WHEN 'audit' THEN 'audit' ELSE 'all' END"


@register("r6_topics", C + f"SELECT row_key, row_type, {_TOPIC} AS topic FROM c")
def r6(spark, d):
    return brief(routing.assign_topic(derived.orders_changes(spark, d), _TOPICS, "all"), "topic")


@register("r7_ddl_topics", _DDL + "SELECT table_id, version, CASE schema_name WHEN 'shop' THEN 'pre.shop_' || table_name WHEN 'audit' THEN 'audit' ELSE 'all' END AS topic, p AS partition FROM d CROSS JOIN (VALUES (0), (1), (2)) AS t(p)")
def r7(spark, d):
    ddl = ddl_named(spark).withColumns({"old_schema": F.lit(None).cast("string"), "old_table": F.lit(None).cast("string")})
    return routing.ddl_messages(ddl, _TOPICS, "all", 3, False).select("table_id", "version", "topic", "partition")


@register("r8_active_topics", C + f"SELECT DISTINCT {_TOPIC} AS topic FROM c UNION SELECT 'all'")
def r8(spark, d):
    return routing.active_topics(routing.assign_topic(derived.orders_changes(spark, d), _TOPICS, "all"), "all")


#: The CRC-32 of a text, where the polynomial's table is t.
_CRC_OF = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length({s}) + 1), lambda i: CAST(ascii(substr({s}, i, 1)) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"
_NAMED = f"SELECT *, schema_name || table_name AS text FROM ({ORDERS_SQL})"
_PARTITIONED = crc_sql(_NAMED, "SELECT row_key, row_type, {xors} % 8 AS partition FROM x, crc_table")


def _xors(*columns: str) -> str:
    out = "crc"
    for c in columns:
        out = f"xor({out}, " + _CRC_OF.format(s=f"'{c}' || coalesce(post_{c}, pre_{c})") + ")"
    return _PARTITIONED.replace("{xors}", out)


@register("r9_partition_table", crc_sql(_NAMED, "SELECT row_key, row_type, crc % 8 AS partition FROM x"))
def r9(spark, d):
    return brief(derived.orders_changes(spark, d), routing.partition_by_table(8).alias("partition"))


@register("r10_partition_ts", C + "SELECT row_key, row_type, commit_ts % 8 AS partition FROM c")
def r10(spark, d):
    return brief(derived.orders_changes(spark, d), routing.partition_by_ts(8).alias("partition"))


@register("r11_partition_index", _xors("key"))
def r11(spark, d):
    return brief(derived.orders_changes(spark, d), routing.partition_by_columns(["key"], 8).alias("partition"))


@register("r12_partition_columns", _xors("cust", "status"))
def r12(spark, d):
    return brief(derived.orders_changes(spark, d), routing.partition_by_columns(["cust", "status"], 8).alias("partition"))


@register("r13_partition_key", C + "SELECT row_key, row_type, 'by-rule' AS partition FROM c")
def r13(spark, d):
    return brief(derived.orders_changes(spark, d), routing.partition_key("by-rule").alias("partition"))


def regions(spark, d) -> DataFrame:
    n = spark.read.parquet(f"{d}/customer.parquet")
    return n.select((F.col("c_custkey") % 3).alias("table_id"), F.col("c_custkey").alias("start_key"), (F.col("c_custkey") % 97 * 10).alias("bytes"))


_REGIONS = "WITH r AS (SELECT c_custkey % 3 AS table_id, c_custkey AS start_key, c_custkey % 97 * 10 AS bytes FROM customer) "


@register("r14_split_spans", _REGIONS + "SELECT *, CAST(ntile(7) OVER (PARTITION BY table_id ORDER BY start_key) AS INTEGER) AS span FROM r")
def r14(spark, d):
    return routing.split_spans(regions(spark, d), 7)


@register("r14_split_by_bytes", _REGIONS + "SELECT table_id, start_key, bytes, CAST(before * 5 // total AS BIGINT) + 1 AS span FROM (SELECT *, coalesce(sum(bytes + 3) OVER (PARTITION BY table_id ORDER BY start_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(bytes + 3) OVER (PARTITION BY table_id) AS total FROM r)")
def r14b(spark, d):
    return routing.split_spans_by_bytes(regions(spark, d), 5, 3)


@register("r15_splittable", "SELECT p_partkey, p_size % 2 = 0 AND p_size % 3 = 0 AS ok FROM part")
def r15(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", routing.splittable(F.col("p_size") % 2 == 0, F.col("p_size") % 3).alias("ok"))


_RANGES = "WITH s AS (SELECT s_nationkey AS table_id, s_suppkey AS a, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS b, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS lo, max(s_suppkey) OVER (PARTITION BY s_nationkey) AS hi FROM supplier) "


@register("r16_span_coverage", _RANGES + "SELECT table_id, bool_and(a % 11 <> 0) AS covered FROM s WHERE b IS NOT NULL GROUP BY table_id")
def r16(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey")
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("table_id"), F.col("s_suppkey").alias("start_key"), F.lead("s_suppkey").over(w.orderBy("s_suppkey")).alias("b"), F.min("s_suppkey").over(w).alias("lo"), F.max("s_suppkey").over(w).alias("hi")).where("b is not null")
    return routing.gaps(s.withColumn("end_key", F.when(F.col("start_key") % 11 == 0, F.col("b") - 1).otherwise(F.col("b"))))


@register("r17_hot_spans", "SELECT p_partkey AS span_id, CASE WHEN p_size >= 40 OR p_partkey % 100 >= 90 THEN 'split' WHEN p_size * 4 < 40 AND p_partkey % 100 * 4 < 90 THEN 'merge' ELSE 'keep' END AS action FROM part")
def r17(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("span_id"), F.col("p_size").alias("bytes"), (F.col("p_partkey") % 100).alias("regions"))
    return routing.hot_spans(p, 40, 90).select("span_id", "action")


@register("r18_balance", "SELECT span_id, CASE WHEN r // 4 % 2 = 0 THEN r % 4 ELSE 3 - r % 4 END AS node FROM (SELECT p_partkey AS span_id, row_number() OVER (PARTITION BY p_partkey % 2 ORDER BY p_size DESC, p_partkey) - 1 AS r FROM part)")
def r18(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("span_id"), (F.col("p_partkey") % 2).alias("table_id"), F.col("p_size").alias("bytes"))
    return routing.balance(p, 4).select("span_id", "node")


# codecs: what a round trip gives back is what went in


@register("c1_csv", C + "SELECT coalesce(schema_name, '') AS schema_name, table_name, CASE row_type WHEN 'D' THEN 'D' ELSE 'I' END AS row_type, commit_ts, commit_ts AS start_ts, coalesce(post_key, pre_key) AS key, coalesce(post_cust, pre_cust) AS cust, coalesce(post_status, pre_status) AS status, coalesce(post_price, pre_price) AS price, coalesce(post_priority, pre_priority) AS priority FROM c")
def c1(spark, d):
    lines = codecs.csv_encode(derived.orders_changes(spark, d))
    return codecs.csv_decode(lines.select("line"), ", ".join(f"{n} {k}" for n, k in KINDS.items()))


@register("c1_csv_lines", C + "SELECT row_key, '\"' || row_type || '\",\"' || table_name || '\",\"' || schema_name || '\",' || commit_ts || ',' || coalesce(post_key, pre_key) || ',' || coalesce(post_cust, pre_cust) || ',\"' || coalesce(post_status, pre_status) || '\",' || coalesce(post_price, pre_price) || ',\"' || coalesce(post_priority, pre_priority) || '\"' AS line FROM c")
def c1b(spark, d):
    return codecs.csv_encode(derived.orders_changes(spark, d)).select("row_key", "line")


_TRIP = flat_sql(C + "SELECT schema_name, table_name, commit_ts, row_type, " + ", ".join(FLAT) + " FROM c")


def _trip(df: DataFrame) -> DataFrame:
    return flat(df.withColumn("row_key", F.lit(""))).drop("row_key")


@register("c2_canal_json", _TRIP)
def c2(spark, d):
    return _trip(codecs.canal_decode(codecs.canal_encode(derived.orders_changes(spark, d), ["key"]).select("message"), KINDS))


@register("c2_canal_fields", C + "SELECT row_key, CASE row_type WHEN 'I' THEN 'INSERT' WHEN 'U' THEN 'UPDATE' ELSE 'DELETE' END AS type, commit_ts // 262144 AS es, CAST(coalesce(post_price, pre_price) AS VARCHAR) AS price FROM c")
def c2b(spark, d):
    m = codecs.canal_encode(derived.orders_changes(spark, d), ["key"], changed_only=True)
    return m.select("row_key", F.get_json_object("message", "$.type").alias("type"), F.get_json_object("message", "$.es").cast("long").alias("es"), F.get_json_object("message", "$.data[0].price").alias("price"))


@register("c3_canal_watermark", C + "SELECT table_id, max(commit_ts) AS ts, max(commit_ts) // 262144 AS es FROM c GROUP BY table_id")
def c3(spark, d):
    marks = derived.orders_changes(spark, d).groupBy("table_id").agg(F.max("commit_ts").alias("ts"))
    m = codecs.canal_watermark(marks)
    return m.select("table_id", F.get_json_object("message", "$._ext.watermarkTs").cast("long").alias("ts"), F.get_json_object("message", "$.es").cast("long").alias("es"))


@register("c4_open", _TRIP)
def c4(spark, d):
    return _trip(codecs.open_decode(codecs.open_encode(derived.orders_changes(spark, d), ["key"]).select("msg_key", "msg_value"), KINDS))


@register("c4_open_frames", C + "SELECT schema_name AS topic, commit_ts % 4 AS partition, (n - 1) // 16 AS batch, count(*) AS n_rows FROM (SELECT *, row_number() OVER (PARTITION BY schema_name, commit_ts % 4 ORDER BY commit_ts) AS n FROM c) GROUP BY ALL")
def c4b(spark, d):
    m = codecs.open_encode(derived.orders_changes(spark, d), ["key"]).withColumns({"topic": F.col("schema_name"), "partition": F.col("commit_ts") % 4})
    return codecs.open_frames(m).where(F.length("key_frame") > F.length("value_frame") * 0).select("topic", "partition", "batch", "n_rows")


@register("c5_simple", C + ", k AS (SELECT row_key, table_id, row_type, commit_ts, coalesce(post_price, pre_price) AS price, table_id NOT IN (1, 2, 11, 22) AS parked FROM c) SELECT table_id, row_type, commit_ts, CAST(price AS VARCHAR) AS price, parked FROM k")
def c5(spark, d):
    m = codecs.simple_encode(derived.orders_changes(spark, d), F.lit(0))
    known = derived.ddl_history(spark).select("table_id").distinct().withColumn("version", F.lit(0).cast("long"))
    out = codecs.simple_decode(m.select("message"), known)
    return out.select("table_id", "row_type", "commit_ts", F.coalesce(F.col("data")["price"], F.col("old")["price"]).alias("price"), "parked")


@register("c6_debezium", _TRIP)
def c6(spark, d):
    return _trip(codecs.debezium_decode(codecs.debezium_encode(derived.orders_changes(spark, d), "one").select("message"), KINDS))


@register("c9_claim_check", C + "SELECT row_key, length(line) > 60 AS moved, line FROM (SELECT row_key, '\"' || row_type || '\",\"' || table_name || '\",\"' || schema_name || '\",' || commit_ts || ',' || coalesce(post_key, pre_key) || ',' || coalesce(post_cust, pre_cust) || ',\"' || coalesce(post_status, pre_status) || '\",' || coalesce(post_price, pre_price) || ',\"' || coalesce(post_priority, pre_priority) || '\"' AS line FROM c)")
def c9(spark, d):
    place = work_dir(spark, "claims")
    m = codecs.limit_message(codecs.csv_encode(derived.orders_changes(spark, d)).select("row_key", "line"), 60, "claim-check", "line", place, raw=True)
    codecs.store_claims(m, place)
    return codecs.fetch_claims(m, place, "line").select("row_key", F.col("claim_check").isNotNull().alias("moved"), "line")


@register("q1_statements", C + "SELECT row_key, CASE row_type WHEN 'U' THEN 'UPDATE `' || schema_name || '`.`' || table_name || '` SET `key` = ' || post_key || ',`cust` = ' || post_cust || ',`status` = ''' || post_status || ''',`price` = ' || post_price || ',`priority` = ''' || post_priority || ''' WHERE `key` = ' || pre_key || ' LIMIT 1' WHEN 'D' THEN 'DELETE FROM `' || schema_name || '`.`' || table_name || '` WHERE `key` = ' || pre_key || ' LIMIT 1' ELSE 'INSERT INTO `' || schema_name || '`.`' || table_name || '` (`key`,`cust`,`status`,`price`,`priority`) VALUES (' || post_key || ',' || post_cust || ',''' || post_status || ''',' || post_price || ',''' || post_priority || ''')' END AS statement FROM c")
def q1(spark, d):
    return codecs.statements(derived.orders_changes(spark, d), ["key"]).select("row_key", "statement")


@register("q2_safe_mode", C + "SELECT row_type, count(*) * CASE row_type WHEN 'U' THEN 2 ELSE 1 END AS n FROM c GROUP BY row_type")
def q2(spark, d):
    return codecs.statements(derived.orders_changes(spark, d), ["key"], safe=True).groupBy("row_type").agg(F.count("*").alias("n"))


@register("q3_batch_eligible", C + "SELECT table_id, count(*) > 1 AND table_id % 2 = 0 AS ok FROM c GROUP BY table_id")
def q3(spark, d):
    g = derived.orders_changes(spark, d).groupBy("table_id").agg(F.count("*").alias("n"))
    return g.select("table_id", codecs.batch_eligible(F.col("n"), F.lit(True), F.col("table_id") % 2 == 1, F.lit(False)).alias("ok"))


_SETS = ", ".join(f"`{n}`=CASE ' || string_agg('WHEN `key` = ' || pre_key || ' THEN ' || {v}, ' ' ORDER BY n) || ' END" for n, v in (("key", "post_key"), ("cust", "post_cust"), ("status", "'''' || post_status || ''''"), ("price", "post_price"), ("priority", "'''' || post_priority || ''''")))
_MULTI = f"""SELECT schema_name, table_name, row_type, (n - 1) // 50 AS batch, count(*) AS n_rows, CASE row_type
  WHEN 'D' THEN 'DELETE FROM `' || schema_name || '`.`' || table_name || '` WHERE (' || string_agg('`key` = ' || pre_key, ') OR (' ORDER BY n) || ')'
  WHEN 'U' THEN 'UPDATE `' || schema_name || '`.`' || table_name || '` SET {_SETS} WHERE (' || string_agg('`key` = ' || pre_key, ') OR (' ORDER BY n) || ')'
  ELSE 'INSERT INTO `' || schema_name || '`.`' || table_name || '` (`key`,`cust`,`status`,`price`,`priority`) VALUES ' || string_agg('(' || post_key || ',' || post_cust || ',''' || post_status || ''',' || post_price || ',''' || post_priority || ''')', ',' ORDER BY n) END AS statement
FROM (SELECT *, row_number() OVER (PARTITION BY schema_name, table_name, row_type ORDER BY commit_ts, row_key) AS n FROM c) GROUP BY schema_name, table_name, row_type, (n - 1) // 50"""


@register("q4_multi_row", C + _MULTI)
def q4(spark, d):
    return codecs.multi_row(derived.orders_changes(spark, d), ["key"], 50)


FEED = {
    "filter": {"rules": ["shop*.*", "audit.orders_2", "!*.orders_5"], "event-filters": [{"matcher": ["shop.*"], "ignore-event": ["delete"]}, {"matcher": ["*.*"], "ignore-insert-value-expr": "price > 20000000"}]},
    "keys": ["key"],
    "columns": list(COLUMNS),
    "sink": {"routes": [{"matcher": ["shop*.*"], "schema": "target_{schema}", "table": "{table}_routed"}], "partition": "ts", "partitions": 8},
}


def run_feed(spark, d) -> DataFrame:
    out = Changefeed.from_dict(FEED).run(derived.orders_changes(spark, d))
    return flat(out, "target_schema", "target_table", "partition")


_FEED = f"""WITH c AS (SELECT * FROM ({ORDERS_SQL}) WHERE {_RULES_SQL} AND NOT (schema_name = 'shop' AND row_type = 'D') AND NOT (row_type = 'I' AND post_price > 20000000)),
s AS ({_SPLIT}) SELECT {ROWS}, CASE WHEN schema_name = 'audit' THEN 'audit' ELSE 'target_' || schema_name END AS target_schema,
CASE WHEN schema_name = 'audit' THEN table_name ELSE table_name || '_routed' END AS target_table, commit_ts % 8 AS partition FROM s"""

register("changefeed", flat_sql(_FEED))(run_feed)

def _typed(spark, d) -> DataFrame:
    """Orders with a date, a time, money and bytes."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    at = F.col("o_orderdate").cast("timestamp_ntz")
    post = F.struct(F.col("o_orderkey").alias("key"), at.cast("date").alias("day"), at.alias("at"), F.col("o_totalprice").cast("decimal(15,2)").alias("price"), F.col("o_orderstatus").cast("binary").alias("raw"), (F.col("o_orderkey") % 2 == 0).alias("even"))
    return o.select(F.lit("s").alias("schema_name"), F.lit("t").alias("table_name"), F.lit("I").alias("row_type"), F.col("o_orderkey").cast("bigint").alias("commit_ts"), F.lit(None).cast(o.select(post.alias("p")).schema["p"].dataType).alias("pre"), post.alias("post"))


@register("c6_debezium_values", "SELECT o_orderkey AS key, CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS VARCHAR) AS day, CAST(epoch_ms(o_orderdate) AS VARCHAR) AS at, CAST(epoch_us(o_orderdate) AS VARCHAR) AS at_micros, CAST(round(o_totalprice, 2) AS DOUBLE) AS price, to_base64(encode(o_orderstatus)) AS raw, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS even FROM orders")
def c6b(spark, d):
    df = _typed(spark, d)
    m = codecs.debezium_encode(codecs.debezium_encode(df, "one", fraction=6).withColumnRenamed("message", "fine"), "one")

    def field(n: str, message: str = "message") -> Column:
        return F.get_json_object(message, f"$.payload.after.{n}")

    return m.select(field("key").cast("bigint").alias("key"), field("day").alias("day"), field("at").alias("at"), field("at", "fine").alias("at_micros"), field("price").cast("double").alias("price"), field("raw").alias("raw"), field("even").alias("even"))


@register("c2_canal_unsigned", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 300 > 127 THEN '5' ELSE '-6' END AS tiny, CASE WHEN o_orderkey * 7 % 100000 > 32767 THEN '4' ELSE '5' END AS small, '4' AS plain, 'tinyint unsigned' AS name FROM orders")
def c2c(spark, d):
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{d}/orders.parquet")
    # the values don't fit Spark's signed types of their names, so wider columns carry them
    wide = F.struct((k % 300).cast("int").alias("tiny"), (k * 7 % 100000).cast("int").alias("small"), k.cast("int").alias("plain"))
    df = o.select(k.alias("key"), F.lit("s").alias("schema_name"), F.lit("t").alias("table_name"), F.lit("I").alias("row_type"), k.cast("bigint").alias("commit_ts"), wide.alias("pre"), wide.alias("post"))
    m = codecs.canal_encode(df, ["plain"], unsigned={"tiny": "tinyint", "small": "smallint"})
    return m.select("key", *[F.get_json_object("message", f"$.sqlType.{n}").alias(n) for n in ("tiny", "small", "plain")], F.get_json_object("message", "$.mysqlType.tiny").alias("name"))
