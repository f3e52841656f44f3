"""Operators on small fixtures, where SQL can't say what is right or a case needs its own rows."""

import json
import os
import zlib

import pytest
from pyspark.sql import functions as F

from changeloom.functions import codecs
from changeloom.functions.globs import TableRules, match_columns
from changeloom.operators import filters, merging, progress, rewrite, routing, schemas
from changeloom.plans.changefeed import Changefeed
from changeloom.sources import derived, storage
from changeloom.streaming import feeds

SMALL = "/root/testdata/sf0.001"


def test_last_rule_wins_and_case():
    r = TableRules(("a*.*", "!a*.secret", "ab.secret"))
    assert r.matches("AX", "t") and not r.matches("ax", "secret") and r.matches("ab", "SECRET")
    assert not TableRules(("A.*",), case_sensitive=True).matches("a", "t")
    assert TableRules(()).matches("any", "thing")
    with pytest.raises(ValueError):
        TableRules(("nodot",)).matches("a", "b")


def test_column_patterns():
    assert match_columns(["*", "!b"], ["a", "b", "c"]) == ["a", "c"]
    assert match_columns(["column*", "!column1"], ["column0", "column1", "x"]) == ["column0"]


def test_selector_checks():
    s = [rewrite.ColumnSelector(("t.*",), ("a", "b"))]
    rewrite.check_selector(s, "t", "x", ["a", "b", "c"], [["a"]])
    with pytest.raises(ValueError):
        rewrite.check_selector(s, "t", "x", ["a", "b", "c"], [["c"]])
    with pytest.raises(ValueError):
        rewrite.check_selector(s, "t", "x", ["a", "b", "c"], [["a"]], ("c",))


def test_filter_helper():
    rules = [filters.EventRule(("s.*",), ("alter table",))]
    got = filters.explain_filter(TableRules(("s.*",)), rules, "s", "t", "add column")
    assert got == {"table_matches": True, "ddl_allowed": True, "ddl_ignored": True}
    assert not filters.explain_filter(TableRules(), [], "mysql", "user")["table_matches"]


def test_unknown_column_fails_early(spark):
    df = derived.orders_changes(spark, SMALL)
    with pytest.raises(Exception, match="nowhere"):
        filters.value_filter(df, [filters.EventRule(("*.*",), ignore_insert_expr="nowhere = 1")])


def test_value_expression_keeps_null_and_two(spark):
    rows = spark.createDataFrame([("s", "t", "I", None, (1,)), ("s", "t", "I", None, (2,)), ("s", "t", "I", None, (None,))], "schema_name string, table_name string, row_type string, pre struct<a int>, post struct<a int>")
    kept = filters.value_filter(rows, [filters.EventRule(("*.*",), ignore_insert_expr="a")]).select("post.a").collect()
    assert sorted(str(r.a) for r in kept) == ["2", "None"]


def test_partition_checksums(spark):
    df = derived.orders_changes(spark, SMALL).select("schema_name", "table_name", "row_type", "pre", "post", routing.partition_by_table(8).alias("t"), routing.partition_by_columns(["key", "status"], 8).alias("c"))
    for r in df.limit(300).collect():
        table = zlib.crc32((r.schema_name + r.table_name).encode())
        image = r.post or r.pre
        want = table ^ zlib.crc32(f"key{image.key}".encode()) ^ zlib.crc32(f"status{image.status}".encode())
        assert (r.t, r.c) == (table % 8, want % 8)


def test_checksum_strict(spark):
    df = derived.orders_changes(spark, SMALL).where("row_type = 'I'").withColumn("sent", F.lit(1).cast("long"))
    assert rewrite.verify_checksum(df, ["key"], "post", "sent").where("not corrupted").count() == 0
    with pytest.raises(Exception, match="checksum"):
        rewrite.verify_checksum(df, ["key"], "post", "sent", strict=True).collect()


def test_topic_names(spark):
    df = spark.createDataFrame([("a b", "t/x"), (".", "y")], "schema_name string, table_name string")
    got = {r.schema_name: r.topic for r in df.withColumn("topic", routing.topic("{schema}")).collect()}
    assert got == {"a b": "a_b", ".": "_"}
    long = spark.createDataFrame([("x" * 300, "t")], "schema_name string, table_name string")
    assert len(long.select(routing.topic("{schema}").alias("t")).first().t) == routing.TOPIC_LIMIT


def test_rewrite_query(spark):
    q = spark.createDataFrame([("ALTER TABLE `s`.`t` ADD c INT COMMENT 's.t'",), ("RENAME TABLE s.t TO s.u",)], "q string")
    got = [r.x for r in q.select(routing.rewrite_query(F.col("q"), "s", "t", "n", "m").alias("x")).collect()]
    assert got == ["ALTER TABLE `n`.`m` ADD c INT COMMENT 's.t'", "RENAME TABLE `n`.`m` TO s.u"]


def test_as_of_ties(spark):
    """A change at a version's own timestamp still has the schema before."""
    ddl = spark.createDataFrame([(1, 0, "create table", "", 1, False), (1, 10, "add column", "", 2, False), (1, 20, "drop table", "", 2, True)], derived.DDL_SCHEMA)
    rows = spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (1, 20, "c"), (1, 21, "d")], "table_id bigint, commit_ts bigint, row_key string")
    for fn in (schemas.as_of, schemas.as_of_merge):
        assert {r.row_key: r.n_columns for r in fn(rows, ddl).collect()} == {"a": 1, "b": 2, "c": 2}
    with pytest.raises(ValueError):
        schemas.snapshot(ddl, 5, 9)


def test_handle_key(spark):
    ix = spark.createDataFrame([(1, 1, False, True, False, ["a", "b"]), (1, 2, False, True, False, ["c"]), (2, 1, True, True, False, ["x"]), (3, 1, False, True, True, ["n"])], "table_id int, index_id int, is_primary boolean, is_unique boolean, nullable boolean, columns array<string>")
    assert {r.table_id: r.handle_columns for r in schemas.handle_key(ix).collect()} == {1: ["c"], 2: ["x"]}


def test_ddl_effects(spark):
    rows = [("truncate table", [1], [2]), ("drop partition", [1, 2, 3], [1, 3]), ("create table", [], [7]), ("drop table", [5], [])]
    df = spark.createDataFrame(rows, "ddl_type string, old_ids array<bigint>, new_ids array<bigint>")
    got = {r.ddl_type: (r.blocked, r.dropped, r.added) for r in schemas.physical_effects(df).collect()}
    assert got["truncate table"] == ([0, 1], [1], [2])
    assert got["drop partition"] == ([0, 1, 2, 3], [2], [])
    assert got["create table"] == ([0], [], [7])
    assert got["drop table"] == ([0, 5], [5], [])


def test_compaction_equals_replay(spark):
    """Applying net changes gives what applying all gives; a delete and a new insert both stay."""
    rows = [(1, 1, "I", 10, None), (1, 2, "U", 11, 10), (1, 3, "D", None, 11), (2, 1, "D", None, 5), (2, 2, "I", 6, None), (3, 1, "U", 8, 7), (3, 2, "U", 9, 8), (4, 1, "I", 1, None), (4, 2, "D", None, 1), (4, 3, "I", 2, None)]
    df = spark.createDataFrame(rows, "key int, seq int, row_type string, value int, before int")
    net = merging.compact(df, ["key"], "seq", "value", "before")
    got = sorted((r.key, r.seq, r.row_type, r.value, r.before) for r in net.collect())
    assert got == [(1, 3, "D", None, None), (2, 1, "D", None, 5), (2, 2, "I", 6, None), (3, 2, "U", 9, 8), (4, 2, "D", None, None), (4, 3, "I", 2, None)]
    base = spark.createDataFrame([(2, 5), (3, 7)], "key int, value int")
    a = merging.apply_changes(base, df, "key", ["value"], "seq").collect()
    b = merging.apply_changes(base, net, "key", ["value"], "seq").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) == [(2, 6), (3, 9), (4, 2)]


def test_bank_invariant(spark):
    """Transfers keep the sum at every snapshot."""
    rows = [(t, a, 100 + d) for t in range(1, 9) for a, d in ((t % 3, -t), ((t + 1) % 3, t))]
    state, changes = {0: 100, 1: 100, 2: 100}, []
    for t, a, v in rows:
        state[a] += v - 100
        changes.append((a, t, "U", state[a]))
    df = spark.createDataFrame(changes, "key int, seq int, row_type string, balance int")
    base = spark.createDataFrame([(k, 100) for k in range(3)], "key int, balance int")
    for t in range(1, 9):
        got = merging.apply_changes(base, df.where(F.col("seq") <= t), "key", ["balance"], "seq")
        assert tuple(got.agg(F.sum("balance"), F.count("*")).first()) == (300, 3)


def test_matcher_cases(spark):
    rows = [("a", 1, "PREWRITE", 1, "x", None), ("a", 1, "PREWRITE", 2, "", None), ("a", 1, "COMMIT", 0, None, 5), ("b", 1, "COMMIT", 0, None, 6), ("c", 1, "PREWRITE", 1, "y", None), ("c", 1, "ROLLBACK", 0, None, None), ("c", 1, "COMMIT", 0, None, 7)]
    kv = spark.createDataFrame(rows, "key string, start_ts bigint, type string, generation int, value string, commit_ts bigint")
    assert [tuple(r) for r in progress.match_commits(kv).collect()] == [("a", 1, 5, "x")]
    assert [tuple(r) for r in progress.unmatched_commits(kv).collect()] == [("b", 1, 6)]


def test_canal_message(spark):
    m = json.loads(codecs.canal_encode(derived.orders_changes(spark, SMALL).where("row_type = 'U'"), ["key"]).select("message").first()[0])
    assert m["type"] == "UPDATE" and m["pkNames"] == ["key"] and set(m["data"][0]) == set(derived.COLUMNS) == set(m["old"][0])


def test_csv_quotes_and_nulls(spark):
    df = spark.createDataFrame([("s", "t", 5, "I", None, ('a"b,c', None))], "schema_name string, table_name string, commit_ts bigint, row_type string, pre struct<a string, b int>, post struct<a string, b int>")
    line = codecs.csv_encode(df)
    assert line.select("line").first()[0] == '"I","t","s",5,"a""b,c",\\N'
    back = codecs.csv_decode(line.select("line"), "a string, b int").first()
    assert (back.a, back.b, back.row_type) == ('a"b,c', None, "I")


def test_open_frames(spark):
    df = spark.createDataFrame([("t", 0, i, f"k{i}", f"v{i}") for i in range(3)], "topic string, partition int, commit_ts bigint, msg_key string, msg_value string")
    r = codecs.open_frames(df, 2).orderBy("batch").first()
    one = (2).to_bytes(8, "big")
    assert bytes(r.key_frame) == (1).to_bytes(8, "big") + one + b"k0" + one + b"k1" and bytes(r.value_frame) == one + b"v0" + one + b"v1"


def test_large_messages(spark):
    df = spark.createDataFrame([("short",), ("x" * 50,)], "message string")
    got = codecs.limit_message(df, 10, "claim-check", location="/c").collect()
    assert got[0].claim_check is None and got[1].message is None and got[1].claim_check.startswith("/c/")
    small = codecs.limit_message(df, 10, "handle-key-only", small=F.lit("key")).collect()
    assert [r.message for r in small] == ["short", "key"]
    with pytest.raises(Exception, match="too large"):
        codecs.limit_message(df, 10, "none").collect()


def test_types():
    assert codecs.flags("handle", "primary") == 10
    assert codecs.where_columns([{"not_null_unique": True, "columns": ["u"]}, {"primary": True, "columns": ["p"]}], ["x"]) == ["p"]
    assert codecs.where_columns([], ["x", "y"]) == ["x", "y"]


def test_statements(spark):
    df = derived.orders_changes(spark, SMALL).where("row_type = 'U'").limit(1)
    plain, safe = codecs.statements(df, ["key"]).collect(), codecs.statements(df, ["key"], safe=True).collect()
    assert plain[0].statement.startswith("UPDATE `") and plain[0].statement.endswith("LIMIT 1")
    assert [r.statement[:7] for r in safe] == ["DELETE ", "REPLACE"]


def test_redo_round_trip(spark, tmp_path):
    df = derived.orders_changes(spark, SMALL)
    storage.write_redo(df, f"{tmp_path}/r", 0, 1 << 62)
    back = storage.read_redo(spark, f"{tmp_path}/r")
    assert back.exceptAll(df).isEmpty() and back.count() == df.count()
    ts = df.groupBy("table_id").agg(F.max("commit_ts").alias("ddl_ts")).where("table_id < 10")
    assert storage.redo_skip(df, ts, 0).where("table_id < 10").isEmpty()


def test_log_scan_prunes(spark, tmp_path):
    df = derived.orders_changes(spark, SMALL)
    storage.write_log(df, f"{tmp_path}/log")
    plan = storage.scan_log(spark, f"{tmp_path}/log", 5, 10, [1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(table_id" in plan or "PartitionFilters: [table_id" in plan or "table_id" in plan.split("PartitionFilters")[1][:80]
    assert "GreaterThan(commit_ts,5)" in plan


def test_changefeed_has_no_shuffle(spark):
    from changeloom.plans.queries_rows import FEED

    plan = Changefeed.from_dict(FEED).run(derived.orders_changes(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_changefeed_settings(spark):
    with pytest.raises(ValueError):
        Changefeed.from_dict({"nonsense": 1})
    for protocol in ("csv", "canal-json", "open", "debezium", "simple"):
        feed = Changefeed.from_dict({"keys": ["key"], "sink": {"protocol": protocol, "partition": "index-value"}})
        assert feed.run(derived.orders_changes(spark, SMALL)).limit(1).count() == 1


def test_streams(spark, tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("table_id bigint, commit_ts bigint, start_ts bigint, row_key string, at timestamp")
    rows = spark.createDataFrame([(1, 5, 4, "a"), (1, 5, 4, "a"), (1, 6, 5, "b")], "table_id bigint, commit_ts bigint, start_ts bigint, row_key string").withColumn("at", F.timestamp_seconds("commit_ts"))
    rows.write.parquet(f"{tmp_path}/in")
    got = []
    feeds.run_available(feeds.dedup_stream(feeds.file_stream(spark, f"{tmp_path}/in", schema)), f"{tmp_path}/ck", lambda b, n: got.extend(b.collect()))
    assert sorted(r.row_key for r in got) == ["a", "b"]


def test_matching_stream(spark, tmp_path):
    p = spark.createDataFrame([("a", 1, "x", 10), ("b", 1, "y", 10)], "key string, start_ts bigint, value string, t bigint").withColumn("at", F.timestamp_seconds("t")).drop("t")
    c = spark.createDataFrame([("a", 1, 7, 12)], "key string, start_ts bigint, commit_ts bigint, t bigint").withColumn("at", F.timestamp_seconds("t")).drop("t")
    p.write.parquet(f"{tmp_path}/p")
    c.write.parquet(f"{tmp_path}/c")
    out = feeds.match_stream(feeds.file_stream(spark, f"{tmp_path}/p", p.schema), feeds.file_stream(spark, f"{tmp_path}/c", c.schema))
    got = []
    feeds.run_available(out, f"{tmp_path}/ck", lambda b, n: got.extend(b.collect()))
    assert [tuple(r) for r in got] == [("a", 1, 7, "x")]


def test_change_log_source(spark, tmp_path):
    from changeloom.sources.changelog import ChangeLogSource

    (tmp_path / "log").mkdir()
    for n in range(2):
        (tmp_path / "log" / f"{n}.jsonl").write_text("".join(json.dumps({"kind": "row", "region_id": n, "key": f"k{n}{i}", "commit_ts": i}) + "\n" for i in range(3)))
    spark.dataSource.register(ChangeLogSource)
    df = spark.read.format("changelog").option("path", f"{tmp_path}/log").load()
    assert df.count() == 6 and df.where("region_id = 1").count() == 3
    got = []
    stream = spark.readStream.format("changelog").option("path", f"{tmp_path}/log").load()
    query = stream.writeStream.foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/ck").start()
    query.processAllAvailable()
    query.stop()
    assert len(got) == 6


def test_places_without_a_window_by_table(spark):
    """Slices give what one window over the table gives, and no window is by table alone."""
    from pyspark.sql import Window

    from changeloom.operators import ordering

    df = derived.orders_changes(spark, SMALL).select("table_id", (F.col("commit_ts") % 997).alias("commit_ts"), "row_key").unionByName(spark.range(4).selectExpr("null as table_id", "id as commit_ts", "cast(id as string) as row_key"))
    got = ordering.numbered(df, "table_id", "commit_ts", ["row_key"], slices=8, whole=0)
    w = Window.partitionBy("table_id").orderBy("commit_ts", "row_key")
    want = df.withColumn("seq", F.row_number().over(w))
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "row_number() windowspecdefinition(table_id#" in plan and ", slice#" in plan.split("row_number() windowspecdefinition")[1][:60]
    value = F.when(F.col("row_key").cast("long") % 5 == 0, F.col("row_key").cast("long"))
    for how, fold in (("sum", F.sum), ("max", F.max), ("last", lambda c: F.last(c, ignorenulls=True))):
        for including in (True, False):
            got = ordering.carried(df, "table_id", "commit_ts", ["row_key"], value, how, "v", including, slices=8, whole=0)
            want = df.withColumn("v", fold(value).over(w.rowsBetween(Window.unboundedPreceding, 0 if including else -1)))
            assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty(), (how, including)


def test_frames_are_cut_by_bytes(spark):
    df = spark.createDataFrame([("t", 0, i, "k", "v" * n) for i, n in enumerate((10, 10, 100, 1, 1))], "topic string, partition int, commit_ts bigint, msg_key string, msg_value string")
    got = [r.n_rows for r in codecs.open_frames(df, 16, 60).orderBy("batch", "part").collect()]
    assert got == [2, 1, 2]  # a message counts 16 bytes more; the long one is alone


def test_claims_are_written(spark, tmp_path):
    df = spark.createDataFrame([("short", "a"), ("x" * 50, "b")], "message string, k string")
    out = codecs.limit_message(df, 10, "claim-check", location=f"file://{tmp_path}/c", key=F.col("k"))
    written = codecs.write_claims(out).collect()
    assert len(written) == 1 and json.loads((tmp_path / "c" / written[0].path.rpartition("/")[2]).read_text()) == {"key": "Yg==", "value": __import__("base64").b64encode(b"x" * 50).decode()}
    assert out.where("message is null").count() == 1


def test_claims_by_the_task(spark, tmp_path, monkeypatch):
    """c9's claims are files by the task, not by the message; equal messages, and messages without claims, come back once each."""
    from changeloom.plans import queries_rows

    monkeypatch.setattr(queries_rows, "work_dir", lambda spark, name: f"{tmp_path}/{name}")
    assert queries_rows.c9(spark, SMALL).where("moved and line is not null").count() > 1000
    assert len([f for _, _, names in os.walk(tmp_path / "claims") for f in names]) < 100
    df = spark.createDataFrame([(1, "short"), (2, "x" * 50), (3, "x" * 50), (4, None), (5, "y" * 11)], "n int, message string")
    out = codecs.limit_message(df, 10, "claim-check", location=f"{tmp_path}/c", raw=True)
    assert out.where("message is null").count() == 4
    codecs.store_claims(out, f"{tmp_path}/c")
    assert sorted((r.n, r.message) for r in codecs.fetch_claims(out, f"{tmp_path}/c").collect()) == sorted((r.n, r.message) for r in df.collect())
    codecs.store_claims(out.where("n = 1"), f"{tmp_path}/none")
    assert codecs.fetch_claims(out.where("n = 1"), f"{tmp_path}/none").count() == 1


def test_debezium_schema(spark):
    df = spark.createDataFrame([], "pre struct<d date, t timestamp_ntz, z timestamp, b binary>, post struct<d date, t timestamp_ntz, z timestamp, b binary>")
    s = json.loads(codecs.debezium_schema(df, "c", "s", "t"))
    assert [f["field"] for f in s["fields"]] == ["before", "after", "op", "ts_ms"]
    assert [(f["type"], f.get("name")) for f in s["fields"][0]["fields"]] == [("int32", "io.debezium.time.Date"), ("int64", "io.debezium.time.Timestamp"), ("string", "io.debezium.time.ZonedTimestamp"), ("bytes", None)]
    row = spark.sql("select 's' as schema_name, 't' as table_name, 'I' as row_type, 0L as commit_ts, timestamp'2020-01-02 03:04:05.5' as z").select("*", F.struct("z").alias("post")).withColumn("pre", F.lit(None).cast("struct<z timestamp>"))
    m = json.loads(codecs.debezium_encode(row, "c", schema=codecs.debezium_schema(row, "c", "s", "t")).first().message)
    assert m["payload"]["after"]["z"] == "2020-01-02T03:04:05.5Z" and m["schema"]["name"] == "c.s.t.Envelope"


def test_kept_matching(spark, tmp_path):
    schema = "key string, start_ts bigint, type string, commit_ts bigint, value string, generation bigint"
    rows = [("a", 1, "PREWRITE", None, "x", 1), ("b", 1, "PREWRITE", None, "y", 1), ("c", 1, "COMMIT", 9, None, None)], [("a", 1, "COMMIT", 7, None, None), ("b", 1, "ROLLBACK", None, None, None), ("c", 1, "PREWRITE", None, "z", 1), ("c", 1, "PREWRITE", None, "", 2), ("d", 2, "COMMITTED", 5, "w", None)]
    for n, some in enumerate(rows):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = feeds.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
    out = spark.read.parquet(feeds.match_kept(stream, f"{tmp_path}/m"))
    assert sorted((r.key, r.start_ts, r.commit_ts, r.value) for r in out.collect()) == [("a", 1, 7, "x"), ("c", 1, 9, "z"), ("d", 2, 5, "w")]
    assert spark.read.schema(schema).parquet(f"{tmp_path}/m/waiting/1").count() == 0


def test_regions_not_heard_of_hold_back(spark, tmp_path):
    schema = "kind string, region_id bigint, commit_ts bigint"
    spark.createDataFrame([("row", 0, 5), ("resolved", 0, 10)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = feeds.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
    for regions, n in ((1, 1), (2, 0)):
        out = feeds.resolve_stream(stream, f"{tmp_path}/r{regions}", spark.range(regions).withColumnRenamed("id", "region_id"))
        assert spark.read.schema(schema).parquet(out).count() == n


def test_rewritten_names(spark):
    q = spark.createDataFrame([("ALTER TABLE t.x ADD c INT",), ("ALTER TABLE `t` ADD t INT",), ("CREATE TABLE n LIKE t",), ("INSERT INTO t VALUES ('t from t')",), ("ALTER TABLE `s` . `t` DROP t",)], "q string")
    got = [r.x for r in q.select(routing.rewrite_query(F.col("q"), "s", "t", "n", "m").alias("x")).collect()]
    assert got == ["ALTER TABLE t.x ADD c INT", "ALTER TABLE `n`.`m` ADD t INT", "CREATE TABLE n LIKE `n`.`m`", "INSERT INTO `n`.`m` VALUES ('t from t')", "ALTER TABLE `n`.`m` DROP t"]
    odd = spark.createDataFrame([("DROP TABLE `a.b`.`c(d`",)], "q string")
    assert odd.select(routing.rewrite_query(F.col("q"), "a.b", "c(d", "n", "m")).first()[0] == "DROP TABLE `n`.`m`"


def test_avro_bytes(spark):
    """Read back by a reader of the format."""
    from changeloom.functions import avro

    rows = [(None, "é", True, 1.5, b"\x00\xff"), (-(1 << 63), "", False, -0.25, b""), (300, "x" * 200, None, None, None), (-1, None, True, 0.0, b"a")]
    df = spark.createDataFrame([(r,) for r in rows], "post struct<n bigint, s string, b boolean, d double, r binary>")
    kinds = ["long", "string", "boolean", "double", "bytes"]
    assert [f["type"][1] for f in json.loads(avro.schema(df, "t", "s"))["fields"]] == kinds

    def number(data, at):
        n = shift = 0
        while True:
            n |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return (n >> 1) ^ -(n & 1), at

    for row, got in zip(rows, df.select(avro.envelope(avro.record(df), 9).alias("m")).collect(), strict=True):
        data, at, back = bytes(got.m), 5, []
        assert data[:5] == b"\0\0\0\0\x09"
        for kind in kinds:
            branch, at = number(data, at)
            value = None
            if branch:
                if kind == "boolean":
                    value, at = bool(data[at]), at + 1
                elif kind == "double":
                    value, at = __import__("struct").unpack_from("<d", data, at)[0], at + 8
                else:
                    value, at = number(data, at)
                    if kind != "long":
                        value, at = data[at : at + value], at + value
                        value = value.decode() if kind == "string" else value
            back.append(value)
        assert tuple(back) == row and at == len(data)


def test_intervals_beyond_64_bits(spark):
    """Ends of ranges that don't fit, ranges over nearly all of the line, and several probes of one interval."""
    top = (1 << 63) - 1
    spans = [(top + 5, 10**20, 1), (top - 9, 10**20, 2), (-(10**20), 5 - top, 3), (-(10**20), 10**20, 9), (-top, top, 8), (7, 7, 0), (40, 50, 4)]
    at = [(1, 45, 46), (2, 45, 46), (3, top - 1, top), (4, -top, 1 - top), (5, -top - 1, -top), (6, -top, top), (7, 50, 60), (8, 9, 9)]
    want = {p: min((t for lo, hi, t in spans if lo < hi and lo < b and a < hi), default=None) for p, a, b in at if a < b}
    ranges = spark.createDataFrame([(str(a), str(b), t) for a, b, t in spans], "lo string, hi string, ts bigint").selectExpr("cast(lo as decimal(38,0)) lo", "cast(hi as decimal(38,0)) hi", "ts")
    got = merging.interval_min(ranges, spark.createDataFrame(at, "probe bigint, p_lo bigint, p_hi bigint")).collect()
    assert {r.probe: r.ts for r in got} == want and len(got) == len(want)


def test_file_numbers_over_six_digits(spark, tmp_path):
    """Files of long numbers have names of their own, and s8 finds the same as its SQL."""
    import duckdb
    from compare import rows_of, rows_of_sql

    from changeloom.plans import catalog

    rows = spark.range(999_990, 1_000_030).select(F.col("id").alias("p_partkey"), (F.col("id") % 3 + 1).cast("int").alias("p_size"))
    rows.write.parquet(f"{tmp_path}/part.parquet")
    files = rows.select(F.lit("a").alias("schema_name"), F.lit("b").alias("table_name"), F.lit(1).alias("version"), F.col("p_partkey").alias("idx")).withColumn("path", storage.data_path())
    assert files.select("path").distinct().count() == 40
    assert files.where(storage.parse_path(F.col("path"))["idx"] == F.col("idx")).count() == 40
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert rows_of(catalog.queries()["s8_new_files"](spark, str(tmp_path))) == rows_of_sql(con, catalog.oracle_sql()["s8_new_files"])


def test_no_join_by_the_group(spark, monkeypatch):
    """Bounds and what is carried over slices go to the rows: a join by a few groups puts each into one task."""
    from pyspark.sql import Window

    from changeloom.operators import ordering

    monkeypatch.setattr(ordering, "WHOLE", 700)
    df = spark.range(9000).select((F.when(F.col("id") % 9 < 5, 1).when(F.col("id") < 8991, 2)).alias("table_id"), (F.col("id") * 7919 % 4099).alias("commit_ts"), F.col("id").cast("string").alias("row_key"))
    w = Window.partitionBy("table_id").orderBy("commit_ts", "row_key")
    got = ordering.numbered(df, "table_id", "commit_ts", ["row_key"], whole=700)
    assert got.exceptAll(df.withColumn("seq", F.row_number().over(w))).isEmpty() and got.count() == 9000
    assert got.rdd.getNumPartitions() == 13 and max(got.rdd.glom().map(len).collect()) < 3000
    run = ordering.carried(df, "table_id", "commit_ts", ["row_key"], F.col("row_key").cast("long"), "sum", "v", True, whole=700)
    assert run.exceptAll(df.withColumn("v", F.sum(F.col("row_key").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))).isEmpty()
    cut = ordering.sliced(df, "table_id", "commit_ts", "slice", whole=700).groupBy("table_id", "slice").count().collect()
    assert len(cut) == 17 and max(r["count"] for r in cut) < 1500
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_applying_in_many_tasks(spark, monkeypatch):
    """o1's input isn't drawn into one task: its two batches have several files each."""
    from pyspark.sql.readwriter import DataFrameWriter

    from changeloom.plans import queries_sets

    tasks, write = [], DataFrameWriter.parquet

    def seen(self, path, *a, **b):
        if path.endswith("/in"):
            tasks.append(self._df.rdd.getNumPartitions())
        return write(self, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert queries_sets.o1(spark, SMALL).count() > 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(tasks) == 2 and min(tasks) > 1
