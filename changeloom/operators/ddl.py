"""DDL statements: what kind they are, and what each kind blocks, drops, adds and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.operators.filters import DDL_SCOPE

#: The span of DDL events itself.
DDL_TABLE = 0
_NONE = "cast(array() as array<bigint>)"


def bare(query: Column) -> Column:
    """A statement in upper case without comments, strings, quoted names and what stands in parentheses."""
    out = F.regexp_replace(query, r"(?s)/\*(?!T?!).*?\*/|--[^\n]*|#[^\n]*", " ")
    out = F.regexp_replace(out, r"(?s)'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"", "''")
    out = F.regexp_replace(out, r"`[^`]*`", "X")
    for _ in range(6):  # from the inside out
        out = F.regexp_replace(out, r"\([^()]*\)", " ")
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(out, r"/\*T?!|\*/", " "), r"[\s;]+", " ")))


#: How a statement begins, and its kind.
STATEMENTS = (
    (r"^CREATE (OR REPLACE )?((ALGORITHM|DEFINER|SQL SECURITY) ?\S* ?(= ?)?\S* )*VIEW ", "create view"),
    (r"^CREATE ((GLOBAL )?TEMPORARY )?TABLE ", "create table"),
    (r"^CREATE (UNIQUE |FULLTEXT |SPATIAL )?INDEX ", "add index"),
    (r"^CREATE (DATABASE|SCHEMA) ", "create schema"),
    (r"^DROP (DATABASE|SCHEMA) ", "drop schema"),
    (r"^DROP VIEW ", "drop view"),
    (r"^DROP ((GLOBAL )?TEMPORARY )?TABLE ", "drop table"),
    (r"^DROP INDEX ", "drop index"),
    (r"^ALTER (DATABASE|SCHEMA) ", "modify schema charset and collate"),
    (r"^(RECOVER|FLASHBACK) TABLE ", "recover table"),
    (r"^RENAME TABLE [^,]*,", "rename tables"),
    (r"^RENAME TABLE ", "rename table"),
    (r"^TRUNCATE (TABLE )?", "truncate table"),
)
#: How the one change of an ALTER TABLE begins, and its kind.
CHANGES = (
    (r"^ADD (CONSTRAINT (\S+ )?)?PRIMARY KEY", "add primary key"),
    (r"^ADD (CONSTRAINT (\S+ )?)?FOREIGN KEY", "add foreign key"),
    (r"^ADD (CONSTRAINT (\S+ )?)?(UNIQUE|INDEX|KEY|FULLTEXT|SPATIAL)", "add index"),
    (r"^ADD (CONSTRAINT (\S+ )?)?CHECK", "add check constraint"),
    (r"^ADD PARTITION", "add partition"),
    (r"^ADD ", "add column"),
    (r"^DROP PRIMARY KEY", "drop primary key"),
    (r"^DROP FOREIGN KEY", "drop foreign key"),
    (r"^DROP (INDEX|KEY) ", "drop index"),
    (r"^(DROP|FIRST) PARTITION", "drop partition"),
    (r"^DROP ", "drop column"),
    (r"^(MODIFY|CHANGE) ", "modify column"),
    (r"^ALTER INDEX ", "alter index visibility"),
    (r"^ALTER ", "set default value"),
    (r"^RENAME (INDEX|KEY) ", "rename index"),
    (r"^RENAME ", "rename table"),
    (r"^TRUNCATE PARTITION", "truncate partition"),
    (r"^REORGANIZE PARTITION", "reorganize partition"),
    (r"^EXCHANGE PARTITION", "exchange partition"),
    (r"^PARTITION BY", "alter partitioning"),
    (r"^REMOVE PARTITIONING", "remove partitioning"),
    (r"^REMOVE TTL", "alter ttl remove"),
    (r"^TTL", "alter ttl info"),
    (r"^(AUTO_INCREMENT|AUTO_RANDOM_BASE)", "rebase auto increment"),
    (r"^COMMENT", "modify table comment"),
    (r"^((DEFAULT )?(CHARSET|CHARACTER SET|COLLATE)|CONVERT TO)", "modify table charset and collate"),
)


def _first(text: Column, cases: tuple[tuple[str, str], ...]) -> Column:
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(cases):
        out = F.when(text.rlike(pattern), kind).otherwise(out)
    return out


def _bound(value: Column, function) -> Column:
    """function(value) with the value computed once, however often the function names it."""
    return F.element_at(F.transform(F.array(value), function), 1)


def action(query: Column) -> Column:
    """C14: a statement's kind; null for what is no DDL.

    Several changes of one table are a multi schema change; an ALTER TABLE that
    changes nothing is what is left of a time-to-live switch.
    """
    def kind(text: Column) -> Column:
        one = F.when(_changes(text) == "", "alter ttl info").otherwise(_bound(_changes(text), change))
        part = text.rlike(r"^ALTER (IGNORE )?TABLE ")
        return F.when(part, one).when(text.rlike(r"^TRUNCATE (TABLE )?\S+ PARTITION"), "truncate partition").otherwise(_first(text, STATEMENTS))

    def change(changes: Column) -> Column:
        return F.when(changes.contains(","), "multi schema change").otherwise(_first(changes, CHANGES))

    return _bound(bare(query), kind)


def _changes(text: Column) -> Column:
    changes = F.trim(F.regexp_replace(text, r"^ALTER (IGNORE )?TABLE \S+ ?", ""))
    return F.regexp_replace(changes, r"(?<=PARTITION) (\S+ ?, ?)+(?=\S+( |$))", " ")  # a list of partitions is one change


def effects(ddl: DataFrame) -> DataFrame:
    """What a DDL blocks, drops and adds, and how names change.

    ddl: (ddl_type, schema_name, table_name, old_ids, new_ids: physical tables
    before and after, like_ids: those of the table that a new one is made like).
    Adds scope (ddl, single, table, tables, schema, all), blocked, dropped,
    added, drop_schema, drop_name and add_name (schema.table).  The tables of a
    schema are given in old_ids; those that ``all`` blocks aren't listed.
    """
    kind, old, new = F.lower("ddl_type"), F.coalesce("old_ids", F.expr(_NONE)), F.coalesce("new_ids", F.expr(_NONE))
    like = F.coalesce("like_ids", F.expr(_NONE)) if "like_ids" in ddl.columns else F.expr(_NONE)
    own, none = F.array(F.lit(DDL_TABLE).cast("bigint")), F.expr(_NONE)
    scope = F.create_map(*[F.lit(x) for pair in DDL_SCOPE.items() for x in pair])[kind]
    made = kind.isin("create table", "create tables", "recover table")
    schema = kind.isin("drop schema", "modify schema charset and collate")
    parts = kind.isin("add partition", "drop partition", "truncate partition", "reorganize partition", "exchange partition", "alter partitioning", "remove partitioning")
    moved = kind.isin("truncate table", "alter partitioning", "remove partitioning")
    blocked = (
        F.when(made, F.concat(own, like))
        .when(kind.isin("create schema", "drop view"), own)
        .when(kind == "create view", none)
        .when(schema | parts | kind.isin("drop table", "truncate table", "rename table", "rename tables"), F.concat(old, own))
        .otherwise(old)
    )
    dropped = F.when(kind.isin("drop schema", "drop table") | moved, old).when(parts & (kind != "exchange partition"), F.array_except(old, new)).otherwise(none)
    added = F.when(made | moved, new).when(parts & (kind != "exchange partition"), F.array_except(new, old)).otherwise(none)
    name = F.concat_ws(".", "schema_name", "table_name")
    return ddl.withColumns(
        {
            "scope": scope, "blocked": F.array_sort(F.array_distinct(blocked)), "dropped": F.array_sort(dropped), "added": F.array_sort(added),
            "drop_schema": F.when(kind == "drop schema", F.col("schema_name")), "drop_name": F.when(kind == "drop table", name), "add_name": F.when(made, name),
        }
    )


def named_index(query: Column, name: Column) -> Column:
    """Q8: a statement that adds an index without a name, with the name that the source gave it; others stay."""
    found = r"(?i)\bADD\s+((?:UNIQUE|FULLTEXT|SPATIAL)?\s*(?:INDEX|KEY))\s*\("
    return F.when(query.rlike(found), F.replace(F.regexp_replace(query, found, "ADD $1 \u0001 ("), F.lit("\u0001"), F.concat(F.lit("`"), name, F.lit("`")))).otherwise(query)


def waits_for_index(query: Column) -> Column:
    """Q8: whether a DDL runs on in the background after it returns, so that the next one on its table must wait."""
    return F.coalesce(action(query).isin("add index", "add primary key", "create hybrid index", "add fulltext index"), F.lit(False))


def view_with_schema(query: Column, schema: Column) -> Column:
    """A view's statement with tables after FROM and JOIN that have no schema named with the given one; strings stay."""
    marked = F.regexp_replace(query, r"(?i)('(?:[^'\\]|\\.)*')|\b(FROM|JOIN)(\s+)(?!`?\w+`?\s*\.)(`?\w+`?)", "$1$2$3\u0001$4")
    marked = F.replace(marked, F.lit("'\u0001"), F.lit("'"))  # behind a string
    return F.replace(marked, F.lit("\u0001"), F.concat(F.lit("`"), schema, F.lit("`.")))


def split_changes(ddl: DataFrame) -> DataFrame:
    """A multi schema change as its single changes in order: (…, part, change, change_type)."""
    body = F.regexp_replace("query", r"(?is)^\s*ALTER\s+(IGNORE\s+)?TABLE\s+\S+\s+", "")
    pieces = F.split(body, r",(?=(?:[^'()]|'[^']*'|\((?:[^()]|\([^()]*\))*\))*$)")
    out = ddl.select("*", F.posexplode(pieces).alias("part", "change"))
    out = out.withColumn("change", F.trim(F.regexp_replace("change", r";\s*$", "")))
    return out.withColumn("change_type", _bound(bare(F.col("change")), lambda t: _first(t, CHANGES)))
