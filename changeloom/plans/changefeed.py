"""A changefeed: a declarative configuration compiled to one DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions import avro, codecs
from changeloom.functions.globs import TableRules
from changeloom.operators import filters, rewrite, routing
from changeloom.operators.filters import EventRule, FilterChain


@dataclass
class Changefeed:
    """filter, split, select, route, dispatch, encode, in this order.

    Every step is a projection or a selection, so the whole feed is one stage
    over the scan without a shuffle; the optimiser pushes what it can into it.
    """

    chain: FilterChain = field(default_factory=FilterChain)
    keys: list[str] = field(default_factory=list)
    raw_changes: bool = False
    selectors: list[rewrite.ColumnSelector] = field(default_factory=list)
    routes: list[routing.Route] = field(default_factory=list)
    topics: list[routing.TopicRule] = field(default_factory=list)
    default_topic: str = "changes"
    partition: str = "table"
    partition_columns: list[str] = field(default_factory=list)
    partitions: int = 8
    protocol: str = ""
    virtual: dict[str, str] = field(default_factory=dict)
    policy: str = ""
    deleted_at: str = ""
    origin: str = ""
    source_id: int | None = None
    codec: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, config: dict[str, Any]) -> Changefeed:
        """A feed from its settings.

        filter {rules, event-filters, ignore-txn-start-ts, ignore-update-only-columns}, keys, columns, sink {…},
        virtual-columns {name: expression}, row-policy (active-active or soft-delete) with deleted-at, origin-column
        (rows that a peer wrote go), source-id (rows that a peer's sink marked go), tables {schema.table: unique keys},
        which the column selectors are checked against.
        """
        known = {"filter", "keys", "columns", "sink", "case-sensitive", "output-raw-change-event", "virtual-columns", "row-policy", "deleted-at", "origin-column", "source-id", "tables"}
        if unknown := set(config) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        if config.get("row-policy", "") not in ("", "active-active", "soft-delete"):
            raise ValueError(f"unknown row policy: {config['row-policy']}")
        if config.get("row-policy") == "soft-delete" and not config.get("deleted-at"):
            raise ValueError("soft-delete needs the column deleted-at")
        f, sink = config.get("filter", {}), config.get("sink", {})
        rules = [
            EventRule(
                tuple(r["matcher"]), tuple(r.get("ignore-event", ())), tuple(r.get("ignore-sql", ())), r.get("ignore-insert-value-expr", ""),
                r.get("ignore-delete-value-expr", ""), r.get("ignore-update-old-value-expr", ""), r.get("ignore-update-new-value-expr", ""),
            )
            for r in f.get("event-filters", ())
        ]
        keys = list(config.get("keys", ()))
        chain = FilterChain(TableRules(tuple(f.get("rules", ())), config.get("case-sensitive", False)), rules, list(f.get("ignore-txn-start-ts", ())), list(f.get("ignore-update-only-columns", ())), keys, list(config.get("columns", ())))
        feed = cls(
            chain, keys, config.get("output-raw-change-event", False),
            [rewrite.ColumnSelector(tuple(s["matcher"]), tuple(s["columns"])) for s in sink.get("column-selectors", ())],
            [routing.Route(tuple(r["matcher"]), r.get("schema", ""), r.get("table", "")) for r in sink.get("routes", ())],
            [routing.TopicRule(tuple(t["matcher"]), t["topic"]) for t in sink.get("topics", ())],
            sink.get("default-topic", "changes"), sink.get("partition", "table"), list(sink.get("partition-columns", ())), sink.get("partitions", 8), sink.get("protocol", ""),
            dict(config.get("virtual-columns", {})), config.get("row-policy", ""), config.get("deleted-at", ""), config.get("origin-column", ""), config.get("source-id"), dict(sink.get("codec", {})),
        )
        names = list(config.get("columns", ()))
        for table, unique in config.get("tables", {}).items():
            schema, _, name = table.partition(".")
            read = {"columns": tuple(feed.partition_columns), "index-value": tuple(keys)}.get(feed.partition, ())
            rewrite.check_selector(feed.selectors, schema, name, names, [list(k) for k in unique], read)
        return feed

    def partition_column(self) -> Column:
        if self.partition == "ts":
            return routing.partition_by_ts(self.partitions)
        if self.partition in ("index-value", "rowid"):
            return routing.partition_by_columns(self.keys, self.partitions)
        if self.partition == "columns":
            return routing.partition_by_columns(self.partition_columns, self.partitions)
        if self.partition in ("table", "default", ""):
            return routing.partition_by_table(self.partitions)
        return routing.partition_key(self.partition)

    def run(self, changes: DataFrame) -> DataFrame:
        """The changes as they go out."""
        df = changes if self.source_id is None else rewrite.from_source(changes, self.source_id)
        if self.virtual:
            df = filters.fill_virtual(df, self.virtual)
        df = self.chain.apply(df)
        if self.policy:
            df = rewrite.row_policy(df, self.policy == "active-active", self.deleted_at)
        if self.origin:
            df = rewrite.break_loops(df, self.origin)
        if self.keys:
            df = rewrite.split_updates(df, self.keys, self.raw_changes)
        df = routing.assign_topic(df, self.topics, self.default_topic).withColumn("partition", self.partition_column())
        if self.selectors:
            names = [f.name for f in df.schema["post"].dataType.fields]
            df = rewrite.select_columns(df, self.selectors, names)
        df = routing.route(df, self.routes)
        return self.encode(df) if self.protocol else df

    def run_ddl(self, ddl: DataFrame) -> DataFrame:
        """The DDL as it goes out: (…, target_schema, target_table, topic, partition), a row for each message.

        What the filter discards or ignores goes; schema changes reach partition
        0 of their topic, or all its partitions for protocols that ask for it.
        """
        kept = filters.ddl_verdict(ddl, self.chain.tables, self.chain.rules).where("not discarded and not ignored")
        routed = routing.route(kept, self.routes)
        named = routed.withColumns({"old_schema": F.col("schema_name"), "old_table": F.col("table_name")})
        out = routing.ddl_messages(named, self.topics, self.default_topic, self.partitions, self.protocol != "open").drop("old_schema", "old_table")
        if self.protocol == "canal-json":
            return codecs.canal_ddl(out)
        return codecs.simple_ddl(out) if self.protocol == "simple" else out

    def encode(self, df: DataFrame) -> DataFrame:
        """With the protocol's own settings (sink.codec): delimiter, quote, include_commit_ts, old_value; extension, changed_only; cluster, fraction."""
        own = self.codec
        if self.protocol == "csv":
            return codecs.csv_encode(df, **own)
        if self.protocol == "canal-json":
            return codecs.canal_encode(df, self.keys, **own)
        if self.protocol in ("open", "default"):
            return codecs.open_encode(df, self.keys, **own)
        if self.protocol == "debezium":
            return codecs.debezium_encode(df, **({"cluster": "default"} | own))
        if self.protocol == "simple":
            return codecs.simple_encode(df, F.lit(1))
        if self.protocol == "avro":
            return df.withColumn("message", avro.envelope(avro.record(df), own.get("schema_id", 1)))
        raise ValueError(f"no encoder for {self.protocol!r}")
