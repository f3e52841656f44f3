"""Row rewriting: column selection, update splitting, row policies, decode steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions.globs import TableRules, match_columns


@dataclass(frozen=True)
class ColumnSelector:
    matcher: tuple[str, ...]
    columns: tuple[str, ...]


def selected(selectors: list[ColumnSelector], schema: str, table: str, names: list[str]) -> list[str]:
    """The columns that the first selector of the table leaves; all without one."""
    for s in selectors:
        if TableRules(s.matcher).matches(schema, table):
            return match_columns(list(s.columns), names)
    return list(names)


def check_selector(selectors: list[ColumnSelector], schema: str, table: str, names: list[str], keys: list[list[str]], dispatch: tuple[str, ...] = ()) -> None:
    """One whole unique key must survive, and every column that dispatching reads."""
    kept = set(selected(selectors, schema, table, names))
    if keys and not any(set(k) <= kept for k in keys):
        raise ValueError(f"the selector of {schema}.{table} leaves no whole unique key")
    if lost := set(dispatch) - kept:
        raise ValueError(f"the selector of {schema}.{table} drops {sorted(lost)}, which dispatching reads")


def select_columns(df: DataFrame, selectors: list[ColumnSelector], names: list[str]) -> DataFrame:
    """P1 on a stream of many tables: columns that a row's table doesn't select become null in both images."""
    for image in ("pre", "post"):
        fields = []
        for name in names:
            keep = F.lit(True)
            for s in reversed(selectors):
                hit = TableRules(s.matcher).column(F.col("schema_name"), F.col("table_name"))
                keep = F.when(hit, F.lit(bool(match_columns(list(s.columns), [name])))).otherwise(keep)
            fields.append(F.when(keep, F.col(f"{image}.{name}")).alias(name))
        df = df.withColumn(image, F.when(F.col(image).isNotNull(), F.struct(*fields)))
    return df


def key_changed(keys: list[str]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | ~F.col(f"pre.{k}").eqNullSafe(F.col(f"post.{k}"))
    return (F.col("row_type") == "U") & out


def split_updates(df: DataFrame, keys: list[str], raw: bool = False) -> DataFrame:
    """An update that changes a key becomes a delete and an insert.

    One pass, no shuffle.  dml_order sorts the halves within their
    transaction: deletes, then updates, then inserts.  raw leaves all as is.
    """
    if raw:
        return df
    none_pre, none_post = F.lit(None).cast(df.schema["pre"].dataType), F.lit(None).cast(df.schema["post"].dataType)

    def half(kind: Column, order: Column, pre: Column, post: Column) -> Column:
        return F.struct(kind.alias("row_type"), order.cast("int").alias("dml_order"), pre.alias("pre"), post.alias("post"))

    whole = F.array(half(F.col("row_type"), F.col("dml_order"), F.col("pre"), F.col("post")))
    halves = F.array(half(F.lit("D"), F.lit(1), F.col("pre"), none_post), half(F.lit("I"), F.lit(3), none_pre, F.col("post")))
    rest = [c for c in df.columns if c not in ("row_type", "dml_order", "pre", "post")]
    return df.select(*rest, F.explode(F.when(key_changed(keys), halves).otherwise(whole)).alias("h")).select(*rest, "h.*")


def row_policy(df: DataFrame, active: bool, deleted_at: str) -> DataFrame:
    """P5: for active-active and soft-delete tables.

    Deletes go.  Active-active keeps the rest; soft-delete turns an update that
    sets deleted_at into the delete of its before image.
    """
    df = df.where("row_type != 'D'")
    if active:
        return df
    gone = (F.col("row_type") == "U") & F.col(f"pre.{deleted_at}").isNull() & F.col(f"post.{deleted_at}").isNotNull()
    return df.withColumns({"row_type": F.when(gone, "D").otherwise(F.col("row_type")), "dml_order": F.when(gone, 1).otherwise(F.col("dml_order")), "post": F.when(~gone, F.col("post"))})


def break_loops(df: DataFrame, origin: str) -> DataFrame:
    """Inserts and updates that came from a peer go."""
    return df.where((F.col("row_type") == "D") | F.col(f"post.{origin}").isNull())


def from_source(df: DataFrame, source_id: int) -> DataFrame:
    """Rows that a peer's sink wrote, marked by its id, go."""
    return df.where(~F.col("source_id").eqNullSafe(F.lit(source_id)))


def handle_key_only(df: DataFrame, keys: list[str], when: Column) -> DataFrame:
    """Images keep only their key columns where the condition holds."""
    for image in ("pre", "post"):
        names = [f.name for f in df.schema[image].dataType.fields]
        slim = F.struct(*[F.col(f"{image}.{n}").alias(n) if n in keys else F.lit(None).cast(df.schema[image].dataType[n].dataType).alias(n) for n in names])
        df = df.withColumn(image, F.when(F.col(image).isNull(), None).when(when, slim).otherwise(F.col(image)))
    return df


def updated_columns_only(df: DataFrame, columns: list[str]) -> DataFrame:
    """An update's before image as a map of the columns that changed, in text."""
    pairs = [F.when(~F.col(f"pre.{c}").eqNullSafe(F.col(f"post.{c}")), F.struct(F.lit(c).alias("k"), F.col(f"pre.{c}").cast("string").alias("v"))) for c in columns]
    changed = F.map_from_entries(F.array_compact(F.array(*pairs)))
    return df.withColumn("old", F.when(F.col("row_type") == "U", changed))


def op_name(df: DataFrame) -> DataFrame:
    """P10: the operation's name."""
    return df.withColumn("op", F.when(F.col("row_type") == "I", "insert").when(F.col("row_type") == "U", "update").when(F.col("row_type") == "D", "delete").otherwise("resolved"))


def decode(raw: DataFrame, slots: bool = False) -> DataFrame:
    """Key-value changes (value, old_value) to rows.

    Both empty: an insert and a delete in one transaction, which goes.  slots
    gives an update as two rows, the old first.
    """
    df = raw.where("value is not null or old_value is not null")
    kind = F.when(F.col("value").isNull(), "D").when(F.col("old_value").isNull(), "I").otherwise("U")
    df = df.withColumn("row_type", kind)
    if not slots:
        return df
    images = F.array_compact(F.array(F.when(F.col("old_value").isNotNull(), F.struct(F.lit(0).alias("slot"), F.col("old_value").alias("row"))), F.when(F.col("value").isNotNull(), F.struct(F.lit(1).alias("slot"), F.col("value").alias("row")))))
    return df.withColumn("image", F.explode(images)).select("*", "image.slot", "image.row").drop("image", "value", "old_value")


def row_checksum(columns: list[str], image: str) -> Column:
    """The CRC-32 of an image's columns in text, each after its length; null is -1 long."""
    parts = [F.coalesce(F.concat(F.length(F.col(f"{image}.{c}").cast("string")).cast("string"), F.lit(":"), F.col(f"{image}.{c}").cast("string")), F.lit("-1:")) for c in columns]
    return F.crc32(F.concat(*parts).cast("binary"))


def verify_checksum(df: DataFrame, columns: list[str], image: str, checksum: str, extra: str | None = None, strict: bool = False) -> DataFrame:
    """Adds ``corrupted``; a second checksum may also match; strict fails instead."""
    found = row_checksum(columns, image)
    ok = found == F.col(checksum)
    if extra:
        ok = ok | (found == F.col(extra))
    bad = F.col(checksum).isNotNull() & ~ok
    if strict:
        return df.withColumn("corrupted", F.when(bad, F.raise_error("row checksum differs").cast("boolean")).otherwise(False))
    return df.withColumn("corrupted", F.coalesce(bad, F.lit(False)))


def strip_keyspace(key: Column) -> Column:
    """A key of a keyspace starts with x and three more bytes."""
    return F.when(F.substring(key, 1, 1) == "x", F.expr("substring({}, 5)".format(key._jc.toString()))).otherwise(key)


def default_value(default: Column, origin: Column) -> Column:
    """The default, else that which the column had when it was added."""
    return F.coalesce(default, origin)
