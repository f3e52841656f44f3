"""Deterministic change streams derived from the star-schema tables.

The supplied tables are no change logs, so every order becomes one row change:
integer arithmetic on its key decides whether it is an insert, an update or a
delete, what its before image was and which table it belongs to.
``ORDERS_SQL`` says the same, flattened, in DuckDB's dialect for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Logical bits below the physical milliseconds of a timestamp.
LOGICAL_BITS = 18

#: Milliseconds of a timestamp without time zone, whatever the session's zone is.
_MILLIS = "datediff(o_orderdate, DATE'1970-01-01') * 86400000L + hour(o_orderdate) * 3600000L + minute(o_orderdate) * 60000L + cast(extract(SECOND FROM o_orderdate) * 1000 AS bigint)"

COLUMNS = ("key", "cust", "status", "price", "priority")


def _cents(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


def orders_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change stream of orders: names, ids, timestamps, row_type I/U/D, dml_order D<U<I, pre and post structs."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    kind = F.when(key % 10 < 2, "D").when(key % 10 < 5, "U").otherwise("I")
    commit = F.expr(_MILLIS) * F.lit(1 << LOGICAL_BITS) + key % (1 << LOGICAL_BITS)
    schema = F.when(key % 3 == 0, "shop").when(key % 3 == 1, "Shop_Archive").otherwise("audit")
    number = F.substring("o_orderpriority", 1, 1)
    rows = o.select(
        schema.alias("schema_name"),
        F.concat(F.lit("orders_"), number).alias("table_name"),
        ((key % 3) * 10 + number.cast("bigint")).alias("table_id"),
        (commit - 5).alias("start_ts"),
        commit.alias("commit_ts"),
        kind.alias("row_type"),
        F.when(kind == "D", 1).when(kind == "U", 2).otherwise(3).alias("dml_order"),
        key.cast("string").alias("row_key"),
        key.alias("key"),
        F.col("o_custkey").alias("cust"),
        F.col("o_orderstatus").alias("status"),
        _cents("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("priority"),
    )
    same = F.col("key") % 30 == 23
    post = F.struct(*COLUMNS)
    pre = F.struct(
        F.when(F.col("key") % 20 == 4, F.col("key") + 1000000).otherwise(F.col("key")).alias("key"),
        F.col("cust"),
        F.when((F.col("key") % 7 == 3) & ~same, F.lit("P")).otherwise(F.col("status")).alias("status"),
        F.when(same, F.col("price")).otherwise(F.expr("price * 9 div 10")).alias("price"),
        F.col("priority"),
    )
    return rows.select(
        "schema_name", "table_name", "table_id", "start_ts", "commit_ts", "row_type", "dml_order", "row_key",
        F.when(F.col("row_type") != "I", pre).alias("pre"),
        F.when(F.col("row_type") != "D", post).alias("post"),
    )


ORDERS_SQL = """
SELECT schema_name, table_name, table_id, start_ts, commit_ts, row_type,
  CASE row_type WHEN 'D' THEN 1 WHEN 'U' THEN 2 ELSE 3 END AS dml_order, CAST(k AS VARCHAR) AS row_key,
  CASE WHEN row_type <> 'I' THEN CASE WHEN k % 20 = 4 THEN k + 1000000 ELSE k END END AS pre_key,
  CASE WHEN row_type <> 'I' THEN cust END AS pre_cust,
  CASE WHEN row_type <> 'I' THEN CASE WHEN k % 7 = 3 AND k % 30 <> 23 THEN 'P' ELSE status END END AS pre_status,
  CASE WHEN row_type <> 'I' THEN CASE WHEN k % 30 = 23 THEN price ELSE price * 9 // 10 END END AS pre_price,
  CASE WHEN row_type <> 'I' THEN priority END AS pre_priority,
  CASE WHEN row_type <> 'D' THEN k END AS post_key, CASE WHEN row_type <> 'D' THEN cust END AS post_cust,
  CASE WHEN row_type <> 'D' THEN status END AS post_status, CASE WHEN row_type <> 'D' THEN price END AS post_price,
  CASE WHEN row_type <> 'D' THEN priority END AS post_priority
FROM (
  SELECT o_orderkey AS k, o_custkey AS cust, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS price, o_orderpriority AS priority,
    CASE o_orderkey % 3 WHEN 0 THEN 'shop' WHEN 1 THEN 'Shop_Archive' ELSE 'audit' END AS schema_name,
    'orders_' || substr(o_orderpriority, 1, 1) AS table_name,
    (o_orderkey % 3) * 10 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS table_id,
    epoch_ms(o_orderdate) * 262144 + o_orderkey % 262144 - 5 AS start_ts,
    epoch_ms(o_orderdate) * 262144 + o_orderkey % 262144 AS commit_ts,
    CASE WHEN o_orderkey % 10 < 2 THEN 'D' WHEN o_orderkey % 10 < 5 THEN 'U' ELSE 'I' END AS row_type
  FROM orders
)
"""


def item_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several changes for each key: an order's lines in one total order are its insert, updates and perhaps its delete.

    (table_id, key, seq, commit_ts, start_ts, row_type, quantity, before).  The
    last of several becomes a delete where its return flag is R.
    """
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(
        F.max(F.col("l_quantity").cast("bigint")).alias("quantity"), F.max("l_returnflag").alias("flag")
    )
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    rows = rows.select(
        (F.col("l_orderkey") % 4).alias("table_id"), F.col("l_orderkey").alias("key"), F.row_number().over(w).cast("bigint").alias("seq"),
        F.count("*").over(Window.partitionBy("l_orderkey")).alias("n"), "quantity", "flag", F.lag("quantity").over(w).alias("before"),
    )
    kind = F.when(F.col("seq") == 1, "I").when((F.col("seq") == F.col("n")) & (F.col("flag") == "R"), "D").otherwise("U")
    commit = F.col("seq") * 1000 + F.col("key") % 7
    return rows.select("table_id", "key", "seq", commit.alias("commit_ts"), (commit - 3).alias("start_ts"), kind.alias("row_type"), F.when(kind != "D", F.col("quantity")).alias("quantity"), "before")


ITEMS_SQL = """
SELECT l_orderkey % 4 AS table_id, l_orderkey AS key, seq, seq * 1000 + l_orderkey % 7 AS commit_ts, seq * 1000 + l_orderkey % 7 - 3 AS start_ts, row_type,
  CASE WHEN row_type <> 'D' THEN quantity END AS quantity, before
FROM (SELECT *, CASE WHEN seq = 1 THEN 'I' WHEN seq = n AND flag = 'R' THEN 'D' ELSE 'U' END AS row_type FROM (
  SELECT l_orderkey, quantity, flag, row_number() OVER w AS seq, count(*) OVER (PARTITION BY l_orderkey) AS n, lag(quantity) OVER w AS before
  FROM (SELECT l_orderkey, l_linenumber, max(CAST(l_quantity AS BIGINT)) AS quantity, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL)
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)))
"""

#: A schema history: (table_id, version, ddl_type, query, columns, deleted).
DDL_ROWS = [
    (1, 0, "create table", "CREATE TABLE shop.orders_1 (id INT)", 3, False),
    (1, 220000000000000000, "add column", "ALTER TABLE shop.orders_1 ADD COLUMN c INT", 4, False),
    (1, 240000000000000000, "drop column", "ALTER TABLE shop.orders_1 DROP COLUMN c", 3, False),
    (2, 0, "create table", "CREATE TABLE shop.orders_2 (id INT)", 5, False),
    (2, 230000000000000000, "drop table", "DROP TABLE shop.orders_2", 5, True),
    (11, 0, "create table", "CREATE TABLE Shop_Archive.orders_1 (id INT)", 2, False),
    (11, 225000000000000000, "truncate table", "TRUNCATE TABLE Shop_Archive.orders_1", 2, False),
    (22, 210000000000000000, "create table", "CREATE TABLE audit.orders_2 (id INT)", 6, False),
    (22, 235000000000000000, "rename table", "RENAME TABLE audit.orders_2 TO audit.kept", 6, False),
]
DDL_SCHEMA = "table_id bigint, version bigint, ddl_type string, query string, n_columns bigint, deleted boolean"


def ddl_history(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DDL_ROWS, DDL_SCHEMA)


def _literal(value) -> str:
    return f"'{value}'" if isinstance(value, str) else str(value)


DDL_SQL = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in DDL_ROWS) + ") AS t(table_id, version, ddl_type, query, n_columns, deleted)"
