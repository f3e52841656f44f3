"""Change streams with Structured Streaming: exact watermarks, matching, applying.

Streams read files that a log writer leaves in a folder (other sources with
the same columns do as well).  State that must be exact is kept as data: a
batch's outcome is written under its batch id before a pointer names it, so a
batch that runs again gives the same files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.operators import merging, progress


#: As many files of a batch as there are.
ALL = (1 << 31) - 1


def file_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A folder of change files as a stream; the checkpoint remembers which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def kafka_stream(spark: SparkSession, servers: str, topics: str) -> DataFrame:
    """Keys and values of topics; needs Spark's Kafka package."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).load().select("topic", "partition", "offset", F.col("key").cast("string").alias("msg_key"), F.col("value").cast("string").alias("msg_value"))


def kafka_sink(df: DataFrame, servers: str, checkpoint: str):
    """O2: topic, partition, key and value; needs Spark's Kafka package."""
    rows = df.selectExpr("topic", "cast(partition as int) as partition", "msg_key as key", "msg_value as value")
    return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("checkpointLocation", checkpoint)


def blackhole(df: DataFrame, checkpoint: str):
    """O6."""
    return df.writeStream.format("noop").option("checkpointLocation", checkpoint)


def match_stream(prewrites: DataFrame, commits: DataFrame, delay: str = "1 hour") -> DataFrame:
    """J1 as a stream-stream join on key and start; both need an event time ``at`` that bounds the state.

    Bounded state has its price: pairs further apart than ``delay`` are lost,
    and neither rollbacks nor empty prewrites are known.  match_kept has neither limit.
    """
    p = prewrites.withWatermark("at", delay).alias("p")
    c = commits.withWatermark("at", delay).alias("c")
    on = (F.col("p.key") == F.col("c.key")) & (F.col("p.start_ts") == F.col("c.start_ts")) & (F.col("c.at") >= F.col("p.at")) & (F.col("c.at") <= F.col("p.at") + F.expr(f"interval {delay}"))
    return p.join(c, on).select("p.key", "p.start_ts", "c.commit_ts", "p.value")


def dedup_stream(df: DataFrame, at: str = "at", delay: str = "1 hour") -> DataFrame:
    """Replayed rows go, as long as the state remembers them."""
    return df.withWatermark(at, delay).dropDuplicatesWithinWatermark(["table_id", "commit_ts", "start_ts", "row_key"])


def run_available(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """All that is there now, batch by batch."""
    query = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def match_kept(stream: DataFrame, root: str) -> str:
    """J1 with all that waits kept as a table: (key, start_ts, type, commit_ts, value, generation) to matched rows.

    A batch writes what it matched and what still waits under its id: prewrites
    without a commit, commits without a prewrite, rollbacks without either.
    Nothing is lost however long it takes.  Returns the folder of the matched rows.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        kv = batch.unionByName(session.read.schema(batch.schema).parquet(f"{root}/waiting/{n - 1}")) if n else batch
        progress.match_commits(kv).write.mode("overwrite").parquet(f"{root}/matched/batch={n}")
        seen = kv.where("type != 'COMMITTED'").groupBy("key", "start_ts").agg(F.max(F.col("type") == "PREWRITE").alias("pre"), F.max(F.col("type") == "COMMIT").alias("com"), F.max(F.col("type") == "ROLLBACK").alias("back"))
        done = seen.where("pre and (com or back)").select("key", "start_ts")
        kv.where("type != 'COMMITTED'").join(done, ["key", "start_ts"], "left_anti").select(*batch.columns).write.mode("overwrite").parquet(f"{root}/waiting/{n}")

    run_available(stream, f"{root}/checkpoint", each)
    spark.catalog.refreshByPath(root)
    return f"{root}/matched"


def resolve_stream(stream: DataFrame, root: str, regions: DataFrame) -> str:
    """Rows go out once every region has promised their timestamp.

    stream: rows (kind 'row') and marks (kind 'resolved') with region_id and
    commit_ts.  regions: all region_ids; one that hasn't been heard of yet holds
    the watermark back.  The watermark is the smallest over the regions of their
    latest mark.  A batch writes what it emits, what waits and each region's
    progress under its id.  Returns the folder of what was emitted.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        if n:
            rows = batch.unionByName(session.read.parquet(f"{root}/waiting/{n - 1}"))
            before = session.read.parquet(f"{root}/progress/{n - 1}")
        else:
            rows, before = batch, regions.select("region_id", F.lit(-1).cast("bigint").alias("resolved_ts"))
        marks = batch.where("kind = 'resolved'").groupBy("region_id").agg(F.max("commit_ts").alias("resolved_ts"))
        seen = batch.select("region_id").distinct().join(marks, "region_id", "left").select("region_id", F.coalesce("resolved_ts", F.lit(-1)).alias("resolved_ts"))
        before.unionByName(seen).groupBy("region_id").agg(F.max("resolved_ts").alias("resolved_ts")).write.mode("overwrite").parquet(f"{root}/progress/{n}")
        level = session.read.parquet(f"{root}/progress/{n}").agg(F.min("resolved_ts").alias("level"))
        rows = rows.where("kind = 'row'").join(F.broadcast(level))  # one row
        rows.where("commit_ts > level").drop("level").write.mode("overwrite").parquet(f"{root}/waiting/{n}")
        rows.where("commit_ts <= level").drop("level").withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{root}/emitted/batch={n}")

    run_available(stream, f"{root}/checkpoint", each)
    spark.catalog.refreshByPath(root)
    return f"{root}/emitted"


#: Pieces of an applied table; a batch rewrites those that it touches.
PIECES = 64


def apply_stream(stream: DataFrame, root: str, key: str, columns: list[str], seq: str, pieces: int = PIECES) -> str:
    """O1: each batch's changes applied to a table in pieces by the key's hash.

    A batch reads and writes only the pieces that its keys are in, under its id,
    then a manifest (a row a piece) that names each piece's latest files.  A
    batch that fails or runs again leaves the manifest before as it is.
    """

    def piece(c: str):
        return F.pmod(F.xxhash64(c), F.lit(pieces)).cast("int")

    def each(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        kinds = {f.name: f.dataType.simpleString() for f in batch.schema.fields}
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in [key, *columns])
        places = _manifest(session, root, n - 1)
        touched = {r.p for r in batch.select(piece(key).alias("p")).distinct().collect()}  # at most ``pieces`` numbers
        old = [places[p] for p in touched if p in places]
        table = session.read.schema(schema).parquet(*old) if old else session.createDataFrame([], schema)
        new = merging.apply_changes(table, batch, key, columns, seq)
        new.withColumn("piece", piece(key)).write.mode("overwrite").partitionBy("piece").parquet(f"{root}/table/{n}")
        written = {r.piece for r in session.read.schema(f"{schema}, piece int").parquet(f"{root}/table/{n}").select("piece").distinct().collect()}
        places = {p: x for p, x in places.items() if p not in touched} | {p: f"{root}/table/{n}/piece={p}" for p in written}
        session.createDataFrame(sorted(places.items()), "piece int, path string").coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/{n}")

    run_available(stream, f"{root}/checkpoint", each)
    return root


def _manifest(spark: SparkSession, root: str, n: int) -> dict[int, str]:
    return {r.piece: r.path for r in spark.read.parquet(f"{root}/manifest/{n}").collect()} if n >= 0 else {}


def applied(spark: SparkSession, root: str, n: int, schema: str) -> DataFrame:
    """The table as it is after batch n."""
    places = _manifest(spark, root, n)
    return spark.read.schema(schema).parquet(*places.values()) if places else spark.createDataFrame([], schema)
