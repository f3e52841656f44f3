"""Row, event and DDL filters, in the order in which a changefeed applies them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions.globs import TableRules

#: Schemas that no changefeed replicates; a deployment adds its own bookkeeping schemas.
SYSTEM_SCHEMAS = ("information_schema", "performance_schema", "metrics_schema", "mysql", "sys", "lightning_task_info", "workload_schema")

#: DDL kinds that pass, with the scope that they block.
DDL_SCOPE = {
    "create schema": "ddl", "drop schema": "schema", "modify schema charset and collate": "schema",
    "create table": "ddl", "create tables": "ddl", "recover table": "ddl",
    "drop table": "table", "truncate table": "table", "rename table": "tables", "rename tables": "tables",
    "add column": "single", "drop column": "single", "modify column": "single", "set default value": "single",
    "add index": "single", "drop index": "single", "rename index": "single", "add primary key": "single", "drop primary key": "single",
    "alter index visibility": "single", "modify table comment": "single", "modify table charset and collate": "single",
    "rebase auto increment": "single", "multi schema change": "single",
    "add partition": "table", "drop partition": "table", "truncate partition": "table", "reorganize partition": "table",
    "exchange partition": "tables", "alter partitioning": "table", "remove partitioning": "table",
    "create view": "all", "drop view": "all",
    "alter ttl info": "single", "alter ttl remove": "single",
    "add foreign key": "single", "drop foreign key": "single", "add fulltext index": "single",
    "add columns": "single", "drop columns": "single", "create hybrid index": "single",
}

#: Kinds that a rule on "alter table" also covers.
ALTER_KINDS = ("add column", "drop column", "modify column", "set default value", "add index", "drop index", "rename index", "add primary key", "drop primary key", "alter index visibility", "modify table comment", "modify table charset and collate", "rebase auto increment", "multi schema change", "add partition", "drop partition", "truncate partition", "reorganize partition", "exchange partition", "alter partitioning", "remove partitioning")


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def table_filter(df: DataFrame, rules: TableRules, system: tuple[str, ...] = SYSTEM_SCHEMAS) -> DataFrame:
    """rows of tables that the rules match, none of system schemas."""
    return df.where(~F.lower("schema_name").isin(*system) & rules.column(F.col("schema_name"), F.col("table_name")))


def start_ts_filter(df: DataFrame, ignored: list[int]) -> DataFrame:
    """rows of the ignored transactions go."""
    return df.where(~F.col("start_ts").isin(*ignored)) if ignored else df


_KIND = {"insert": "I", "update": "U", "delete": "D"}


@dataclass(frozen=True)
class EventRule:
    """One rule on events of matching tables.

    ignore_events: insert, update, delete, all dml, all ddl, none, or DDL kinds.
    The four expressions are over the columns of an image; a row goes if the
    one that applies is 1.
    """

    matcher: tuple[str, ...]
    ignore_events: tuple[str, ...] = ()
    ignore_sql: tuple[str, ...] = ()
    ignore_insert_expr: str = ""
    ignore_delete_expr: str = ""
    ignore_update_old_expr: str = ""
    ignore_update_new_expr: str = ""

    def tables(self) -> Column:
        return TableRules(self.matcher).column(F.col("schema_name"), F.col("table_name"))

    def dml_events(self) -> Column:
        events = {e.lower() for e in self.ignore_events}
        if "none" in events or "none dml" in events:
            return F.lit(False)
        if events & {"all", "all dml"}:
            return F.lit(True)
        kinds = [_KIND[e] for e in events if e in _KIND]
        return F.col("row_type").isin(*kinds) if kinds else F.lit(False)

    def ddl_events(self) -> Column:
        events = {e.lower() for e in self.ignore_events}
        if "none" in events or "none ddl" in events:
            return F.lit(False)
        if events & {"all", "all ddl"}:
            return F.lit(True)
        kinds = {e for e in events if e in DDL_SCOPE} | (set(ALTER_KINDS) if "alter table" in events else set())
        by_kind = F.lower("ddl_type").isin(*sorted(kinds)) if kinds else F.lit(False)
        return by_kind | any_of([F.col("query").rlike(p) for p in self.ignore_sql])

    def value(self) -> Column:
        def hits(expression: str, image: str) -> Column:
            if not expression:
                return F.lit(False)
            return F.coalesce(image_expr(expression, image).cast("long") == 1, F.lit(False))

        kind = F.col("row_type")
        return F.when(kind == "I", hits(self.ignore_insert_expr, "post")).when(kind == "D", hits(self.ignore_delete_expr, "pre")).otherwise(hits(self.ignore_update_old_expr, "pre") | hits(self.ignore_update_new_expr, "post"))


def image_expr(expression: str, image: str) -> Column:
    """A user's expression with its bare names read from one image; an unknown name fails when the plan is analysed."""
    import re

    def name(m: re.Match) -> str:
        word = m[0]
        return word if word[0] == "'" or word.lower() in _WORDS or m.string[m.end() :].lstrip().startswith("(") else f"{image}.{word}"

    return F.expr(re.sub(r"'(?:[^']|'')*'|`?[A-Za-z_][A-Za-z0-9_]*`?", name, expression))


_WORDS = frozenset("and or not in is null like between case when then else end true false div mod interval cast as int bigint double string".split())


def event_filter(df: DataFrame, rules: list[EventRule]) -> DataFrame:
    """a DML event goes if a rule of its table ignores its kind."""
    return df.where(~any_of([r.tables() & r.dml_events() for r in rules]))


def ddl_event_filter(ddl: DataFrame, rules: list[EventRule]) -> DataFrame:
    """adds ``ignored``: a rule ignores the kind, or a pattern occurs in the statement."""
    return ddl.withColumn("ignored", any_of([r.tables() & r.ddl_events() for r in rules]))


def value_filter(df: DataFrame, rules: list[EventRule]) -> DataFrame:
    """F8: a row goes if the expression for its kind is exactly 1; null, 0 and 2 keep it."""
    return df.where(~any_of([r.tables() & r.value() for r in rules]))


def fill_virtual(df: DataFrame, generated: dict[str, str]) -> DataFrame:
    """computed columns are added to both images before expressions see them."""
    for image in ("pre", "post"):
        for name, expression in generated.items():
            df = df.withColumn(image, F.when(F.col(image).isNotNull(), F.col(image).withField(name, image_expr(expression, image))))
    return df


def update_only_filter(df: DataFrame, ignored: list[str], keys: list[str], columns: list[str]) -> DataFrame:
    """an update goes if all that changed is ignored and no key changed; one that changed nothing goes too."""
    watched = [c for c in columns if c not in ignored or c in keys]
    quiet = reduce(lambda a, b: a & b, [F.col(f"pre.{c}").eqNullSafe(F.col(f"post.{c}")) for c in watched], F.lit(True))
    return df.where(~((F.col("row_type") == "U") & quiet))


def ddl_verdict(ddl: DataFrame, tables: TableRules, rules: list[EventRule]) -> DataFrame:
    """discarded (not allowed, or schema or table filtered), ignored (by event rules, schema still tracked), scope blocked."""
    allowed = F.lower("ddl_type").isin(*DDL_SCOPE)
    table_less = F.col("table_name") == ""
    wanted = F.when(table_less, tables.schema_column(F.col("schema_name"))).otherwise(tables.column(F.col("schema_name"), F.col("table_name")))
    scope = F.create_map(*[F.lit(x) for pair in DDL_SCOPE.items() for x in pair])[F.lower("ddl_type")]
    return ddl_event_filter(ddl, rules).withColumn("discarded", ~allowed | ~wanted | F.lower("schema_name").isin(*SYSTEM_SCHEMAS)).withColumn("scope", scope)


def eligible(df: DataFrame, force: bool = False) -> Column:
    """views, and tables with a primary or not-null unique key; never sequences; all others only if forced."""
    return ~F.col("is_sequence") & (F.lit(force) | F.col("is_view") | F.col("has_key"))


def drop_stale(df: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """rows before their table's resolved timestamp were seen; tables without one keep all."""
    return df.join(F.broadcast(checkpoints) if _small(checkpoints) else checkpoints, "table_id", "left").where(F.col("resolved_ts").isNull() | (F.col("commit_ts") >= F.col("resolved_ts"))).drop("resolved_ts")


def skip_dml_at_start(df: DataFrame, start_ts: int) -> DataFrame:
    """F16: after a replayed DDL, rows exactly at start_ts + 1 were applied."""
    return df.where(F.col("commit_ts") != start_ts + 1)


def explain_filter(tables: TableRules, rules: list[EventRule], schema: str, table: str, ddl_type: str = "") -> dict:
    """what a configuration does with one table, and with one DDL kind on it."""
    known = ddl_type.lower() in DDL_SCOPE
    ignored = []
    for r in rules:
        if TableRules(r.matcher).matches(schema, table):
            events = {e.lower() for e in r.ignore_events}
            if ddl_type and (events & {"all", "all ddl", ddl_type.lower()} or ("alter table" in events and ddl_type.lower() in ALTER_KINDS)):
                ignored.append(r)
    system = schema.lower() in SYSTEM_SCHEMAS
    return {"table_matches": tables.matches(schema, table) and not system, "ddl_allowed": known if ddl_type else None, "ddl_ignored": bool(ignored)}


#: Bytes up to which a lookup side is broadcast; the optimiser's own estimate decides beyond.
BROADCAST_BYTES = 8 << 20


def _small(df: DataFrame) -> bool:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES


@dataclass
class FilterChain:
    """The DML chain: transaction, table, event kind, update-only columns, value expressions."""

    tables: TableRules = field(default_factory=TableRules)
    rules: list[EventRule] = field(default_factory=list)
    ignored_start_ts: list[int] = field(default_factory=list)
    ignore_update_only: list[str] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        df = event_filter(table_filter(start_ts_filter(df, self.ignored_start_ts), self.tables), self.rules)
        if self.ignore_update_only:
            df = update_only_filter(df, self.ignore_update_only, self.keys, self.columns)
        return value_filter(df, self.rules)
