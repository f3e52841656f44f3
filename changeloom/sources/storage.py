"""Object storage: paths, data files, metadata, redo logs and the change log itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_log(df: DataFrame, path: str) -> None:
    """S3: the change log, a folder for each table, sorted by commit, start, kind and key within its files; a large table is many ranges."""
    df.repartitionByRange("table_id", "commit_ts").sortWithinPartitions("table_id", "commit_ts", "start_ts", "dml_order", "row_key").write.mode("overwrite").option("compression", "zstd").partitionBy("table_id").parquet(path)


def scan_log(spark: SparkSession, path: str, start: int, end: int, tables: list[int] | None = None) -> DataFrame:
    """Changes in (start, end]; tables prune folders, timestamps reach the scan, which skips by the sorted files' statistics."""
    df = spark.read.parquet(path)
    if tables is not None:
        df = df.where(F.col("table_id").isin(*tables))
    return df.where((F.col("commit_ts") > start) & (F.col("commit_ts") <= end))


def data_path(date: bool = False, partitioned: bool = False, extension: str = "json") -> Column:
    """schema/table/version[/partition][/date]/CDC000001.ext; an index of more than six digits stays whole."""
    parts = [F.col("schema_name"), F.col("table_name"), F.col("version").cast("string")]
    if partitioned:
        parts.append(F.col("table_id").cast("string"))
    if date:
        parts.append(F.col("date"))
    index = F.col("idx").cast("string")
    return F.concat_ws("/", *parts, F.concat(F.lit("CDC"), F.lpad(index, F.greatest(F.length(index), F.lit(6)), F.lit("0")), F.lit("." + extension)))


def schema_path() -> Column:
    """The schema file of a version, named by the version and the schema's checksum."""
    crc = F.lpad(F.crc32(F.col("schema_json").cast("binary")).cast("string"), 10, "0")
    return F.concat_ws("/", F.col("schema_name"), F.col("table_name"), F.lit("meta"), F.concat(F.lit("schema_"), F.col("version").cast("string"), F.lit("_"), crc, F.lit(".json")))


def parse_path(path: Column) -> Column:
    """Schema, table, version and index from a data file's path."""
    p = r"^([^/]+)/([^/]+)/(\d+)/(?:[^/]+/)*CDC(\d+)\.\w+$"
    return F.when(path.rlike(p), F.struct(F.regexp_extract(path, p, 1).alias("schema_name"), F.regexp_extract(path, p, 2).alias("table_name"), F.regexp_extract(path, p, 3).cast("bigint").alias("version"), F.regexp_extract(path, p, 4).cast("bigint").alias("idx")))


def new_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files that weren't there in the round before."""
    return now.join(before, "path", "left_anti")


def write_storage(df: DataFrame, path: str, lines: str, checkpoint_ts: int, fmt: str = "text") -> None:
    """Lines under schema/table/version folders, then the metadata file, last, as a promise that they are there."""
    spark = df.sparkSession
    df.select("schema_name", "table_name", "version", F.col(lines).alias("value")).write.mode("append").partitionBy("schema_name", "table_name", "version").format(fmt).save(f"{path}/data")
    spark.createDataFrame([(f'{{"checkpoint-ts":{checkpoint_ts}}}',)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(f"{path}/metadata").select(F.get_json_object("value", "$.checkpoint-ts").cast("bigint").alias("checkpoint_ts"))


def write_redo(df: DataFrame, path: str, checkpoint_ts: int, resolved_ts: int) -> None:
    """The redo log as Parquet, then its meta file."""
    df.write.mode("append").option("compression", "zstd").parquet(f"{path}/log")
    df.sparkSession.createDataFrame([(checkpoint_ts, resolved_ts, 1)], "checkpoint_ts bigint, resolved_ts bigint, version int").coalesce(1).write.mode("append").parquet(f"{path}/meta")


def read_redo(spark: SparkSession, path: str) -> DataFrame:
    """The log in (checkpoint, resolved] of the newest meta; the two numbers are one row that is broadcast."""
    meta = spark.read.parquet(f"{path}/meta").agg(F.max("checkpoint_ts").alias("c"), F.max("resolved_ts").alias("r"))
    return spark.read.parquet(f"{path}/log").join(F.broadcast(meta), (F.col("commit_ts") > F.col("c")) & (F.col("commit_ts") <= F.col("r"))).drop("c", "r")


def redo_skip(df: DataFrame, ddl_ts: DataFrame, checkpoint_ts: int) -> DataFrame:
    """Replay leaves out rows at or before their table's recorded DDL; without a record, at or before the checkpoint."""
    return df.join(ddl_ts, "table_id", "left").where(F.coalesce("ddl_ts", F.lit(checkpoint_ts)) < F.col("commit_ts")).drop("ddl_ts")
