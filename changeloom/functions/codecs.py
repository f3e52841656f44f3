"""Message codecs as column expressions, and their decoders.

A codec turns a change row (names, timestamps, row_type, pre and post) into
text; decoders parse it back.  Each codec renders values its own way.  Wire
names that are a vendor's own are parameters: ``extension`` names the JSON
object that carries the timestamps, ``watermark_type`` the watermark's type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.operators.ordering import dealt, extent, numbered

EXTENSION, WATERMARK_TYPE = "_ext", "WATERMARK"

#: SQL type, JDBC type number, Java-facing name, by Spark type.
TYPES = {
    "tinyint": ("tinyint", -6), "smallint": ("smallint", 5), "int": ("int", 4), "bigint": ("bigint", -5),
    "float": ("float", 7), "double": ("double", 8), "string": ("varchar", 12), "binary": ("blob", 2004),
    "date": ("date", 91), "timestamp": ("timestamp", 93), "timestamp_ntz": ("datetime", 93), "boolean": ("tinyint", -6),
}
#: Bits of a column's flags.
FLAG_BITS = {"binary": 1, "handle": 2, "generated": 4, "primary": 8, "unique": 16, "multiple": 32, "nullable": 64, "unsigned": 128}
#: Messages of one open-protocol batch, its version head.
OPEN_BATCH, OPEN_VERSION = 16, 1


def flags(*names: str) -> int:
    return sum(FLAG_BITS[n] for n in names)


def _fields(df: DataFrame, image: str = "post") -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema[image].dataType.fields]


def finite(c: Column) -> Column:
    """Not-a-number and infinities have no SQL value: 0."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def text(c: Column, kind: str) -> Column:
    """A value as text; binary as ISO-8859-1."""
    if kind == "binary":
        return F.decode(c, "ISO-8859-1")
    if kind in ("float", "double"):
        return finite(c).cast("string")
    if kind.startswith("array"):
        return F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ","), F.lit("]"))
    return c.cast("string")


def vector_text(c: Column) -> Column:
    return text(c, "array<float>")


def widened_type(kind: str, value: Column) -> Column:
    """The Java type number of an unsigned integer of a SQL type (carried by a wider one), which depends on its value."""
    limits = {"tinyint": (127, -6, 5), "smallint": (32767, 5, 4), "int": (2**31 - 1, 4, -5), "bigint": (2**63 - 1, -5, 3)}
    top, narrow, wide = limits[kind]
    return F.when(value > top, wide).otherwise(narrow)


# CSV


def csv_field(c: Column, kind: str, delimiter: str = ",", quote: str = '"', null: str = "\\N", binary: str = "base64") -> Column:
    if kind == "binary":
        plain = F.base64(c) if binary == "base64" else F.lower(F.hex(c))
        return F.coalesce(plain, F.lit(null))
    if kind == "string" or kind.startswith("array"):
        value = text(c, kind)
        if quote:
            value = F.concat(F.lit(quote), F.replace(value, F.lit(quote), F.lit(quote * 2)), F.lit(quote))
        else:
            for plain, escaped in (("\\", "\\\\"), (delimiter, "\\" + delimiter), ("\r", "\\r"), ("\n", "\\n")):
                value = F.replace(value, F.lit(plain), F.lit(escaped))
        return F.coalesce(value, F.lit(null))
    return F.coalesce(text(c, kind), F.lit(null))


def csv_encode(df: DataFrame, delimiter: str = ",", quote: str = '"', include_commit_ts: bool = True, old_value: bool = False) -> DataFrame:
    """A line for each row; with old values an update is a D and an I line, both marked as update."""
    images = F.when((F.col("row_type") == "U") & F.lit(old_value), F.array(F.struct(F.lit("D").alias("op"), F.col("pre").alias("image")), F.struct(F.lit("I").alias("op"), F.col("post").alias("image")))).otherwise(F.array(F.struct(F.col("row_type").alias("op"), F.coalesce("post", "pre").alias("image"))))
    rows = df.withColumn("e", F.explode(images))
    head = [csv_field(F.col("e.op"), "string", delimiter, quote), csv_field(F.col("table_name"), "string", delimiter, quote), csv_field(F.col("schema_name"), "string", delimiter, quote)]
    if include_commit_ts:
        head.append(F.col("commit_ts").cast("string"))
        if old_value:
            head.append((F.col("row_type") == "U").cast("string"))
    cells = [csv_field(F.col(f"e.image.{n}"), k, delimiter, quote) for n, k in _fields(df)]
    return rows.withColumn("line", F.concat_ws(delimiter, *head, *cells)).drop("e")


def csv_decode(lines: DataFrame, schema: str, include_commit_ts: bool = True, column: str = "line") -> DataFrame:
    """Lines to rows; lossy as the format is: all but D is an insert, start_ts is commit_ts (0 without one)."""
    head = "op string, table_name string, schema_name string" + (", commit_ts bigint" if include_commit_ts else "")
    m = F.from_csv(F.col(column), f"{head}, {schema}", {"quote": '"', "escape": '"', "nullValue": "\\N"})
    out = lines.withColumn("m", m)
    ts = F.col("m.commit_ts") if include_commit_ts else F.lit(0).cast("bigint")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    return out.select("m.schema_name", "m.table_name", F.when(F.col("m.op") == "D", "D").otherwise("I").alias("row_type"), ts.alias("commit_ts"), ts.alias("start_ts"), *[F.col(f"m.{n}").alias(n) for n in names])


# Canal-json


def _text_map(df: DataFrame, image: str) -> Column:
    return F.struct(*[text(F.col(f"{image}.{n}"), k).alias(n) for n, k in _fields(df, image)])


_KEEP_NULLS = {"ignoreNullFields": "false"}


def canal_encode(df: DataFrame, keys: list[str], extension: bool = True, changed_only: bool = False, name: str = EXTENSION, unsigned: dict[str, str] | None = None) -> DataFrame:
    """A JSON message for each row; es is the commit's physical milliseconds; values are text or null.

    ``unsigned``: columns that are unsigned integers, with their SQL type; their type number depends on the value.
    """
    fields, unsigned = _fields(df), unsigned or {}

    def number(n: str, k: str) -> Column:
        if n not in unsigned:
            return F.lit(TYPES.get(k, ("varchar", 12))[1])
        value = F.when(F.col("row_type") == "D", F.col(f"pre.{n}")).otherwise(F.col(f"post.{n}"))
        return F.coalesce(widened_type(unsigned[n], value), F.lit(TYPES[unsigned[n]][1]))

    image = F.when(F.col("row_type") == "D", _text_map(df, "pre")).otherwise(_text_map(df, "post"))
    if changed_only:
        old = F.struct(*[F.when(~F.col(f"pre.{n}").eqNullSafe(F.col(f"post.{n}")), text(F.col(f"pre.{n}"), k)).alias(n) for n, k in fields])
        old_json = F.array(F.from_json(F.to_json(old), "map<string,string>"))
    else:
        old_json = F.array(F.from_json(F.to_json(_text_map(df, "pre"), _KEEP_NULLS), "map<string,string>"))
    kind = F.when(F.col("row_type") == "I", "INSERT").when(F.col("row_type") == "U", "UPDATE").otherwise("DELETE")
    parts = [
        F.lit(0).alias("id"), F.col("schema_name").alias("database"), F.col("table_name").alias("table"), F.array(*[F.lit(k) for k in keys]).alias("pkNames"),
        F.lit(False).alias("isDdl"), kind.alias("type"), F.shiftright("commit_ts", 18).alias("es"), F.lit("").alias("sql"),
        F.struct(*[number(n, k).alias(n) for n, k in fields]).alias("sqlType"),
        F.struct(*[F.lit(f"{unsigned[n]} unsigned" if n in unsigned else TYPES.get(k, ("varchar", 12))[0]).alias(n) for n, k in fields]).alias("mysqlType"),
        F.when(F.col("row_type") == "U", old_json).alias("old"), F.array(image).alias("data"),
    ]
    if extension:
        parts.append(F.struct(F.col("commit_ts").alias("commitTs")).alias(name))
    return df.withColumn("message", F.to_json(F.struct(*parts), _KEEP_NULLS))


def canal_decode(messages: DataFrame, columns: dict[str, str], name: str = EXTENSION, column: str = "message") -> DataFrame:
    """Messages back to typed images."""
    schema = f"database string, table string, type string, es bigint, isDdl boolean, old array<map<string,string>>, data array<map<string,string>>, `{name}` struct<commitTs:bigint>"
    m = messages.withColumn("m", F.from_json(column, schema))

    def image(c: Column) -> Column:
        return F.struct(*[c[n].cast(k).alias(n) for n, k in columns.items()])

    data, old = F.get(F.col("m.data"), F.lit(0)), F.get(F.col("m.old"), F.lit(0))
    # what an update's old image leaves out didn't change
    before = F.struct(*[F.when(F.map_contains_key(old, n), old[n]).otherwise(data[n]).cast(k).alias(n) for n, k in columns.items()])
    return m.select(
        F.col("m.database").alias("schema_name"), F.col("m.table").alias("table_name"), F.substring("m.type", 1, 1).alias("row_type"), F.col(f"m.{name}.commitTs").alias("commit_ts"),
        F.when(F.col("m.type") == "UPDATE", before).when(F.col("m.type") == "DELETE", image(data)).alias("pre"), F.when(F.col("m.type") != "DELETE", image(data)).alias("post"),
    )


def canal_ddl(ddl: DataFrame, name: str = EXTENSION) -> DataFrame:
    """A DDL's message."""
    return ddl.withColumn("message", F.to_json(F.struct(F.lit(0).alias("id"), F.col("schema_name").alias("database"), F.col("table_name").alias("table"), F.lit(True).alias("isDdl"), F.upper(F.split("ddl_type", " ")[0]).alias("type"), F.shiftright("version", 18).alias("es"), F.col("query").alias("sql"), F.struct(F.col("version").alias("commitTs")).alias(name))))


def canal_watermark(marks: DataFrame, name: str = EXTENSION, kind: str = WATERMARK_TYPE) -> DataFrame:
    """A watermark's message."""
    return marks.withColumn("message", F.to_json(F.struct(F.lit(0).alias("id"), F.lit(kind).alias("type"), F.shiftright("ts", 18).alias("es"), F.struct(F.col("ts").alias("watermarkTs")).alias(name))))


def canal_decode_events(messages: DataFrame, name: str = EXTENSION, watermark: str = WATERMARK_TYPE, column: str = "message") -> DataFrame:
    """(kind row, ddl or watermark, ts, schema_name, table_name, query) of messages of all kinds."""
    m = F.from_json(column, f"isDdl boolean, type string, database string, table string, sql string, `{name}` struct<commitTs: bigint, watermarkTs: bigint>")
    out = messages.withColumn("m", m)
    kind = F.when(F.col("m.type") == watermark, "watermark").when(F.col("m.isDdl"), "ddl").otherwise("row")
    return out.select(kind.alias("kind"), F.coalesce(f"m.{name}.watermarkTs", f"m.{name}.commitTs").alias("ts"), F.col("m.database").alias("schema_name"), F.col("m.table").alias("table_name"), F.col("m.sql").alias("query"))


# C4: open protocol


def open_encode(df: DataFrame, keys: list[str], changed_only: bool = False) -> DataFrame:
    """C4: key and value; a column is {t, h, f, v}; u and p for inserts and updates, d for deletes."""
    fields = _fields(df)

    def columns(image: str, only_changed: bool = False) -> Column:
        out = []
        for n, k in fields:
            handle = n in keys
            flag = flags("handle", "primary") if handle else flags("nullable")
            number = {"bigint": 8, "int": 3, "smallint": 2, "tinyint": 1, "double": 5, "float": 4, "string": 15, "binary": 252}.get(k, 15)
            value = F.base64(F.col(f"{image}.{n}")) if k == "binary" else F.col(f"{image}.{n}")
            cell = F.struct(F.lit(number).alias("t"), F.lit(True if handle else None).cast("boolean").alias("h"), F.lit(flag).alias("f"), value.alias("v"))
            if only_changed:
                cell = F.when(~F.col(f"pre.{n}").eqNullSafe(F.col(f"post.{n}")), cell)
            out.append(cell.alias(n))
        return F.struct(*out)

    key = F.to_json(F.struct(F.col("commit_ts").alias("ts"), F.col("schema_name").alias("scm"), F.col("table_name").alias("tbl"), F.lit(1).alias("t")))
    value = F.when(F.col("row_type") == "D", F.to_json(F.struct(columns("pre").alias("d")))).when(F.col("row_type") == "I", F.to_json(F.struct(columns("post").alias("u")))).otherwise(F.to_json(F.struct(columns("post").alias("u"), columns("pre", changed_only).alias("p"))))
    return df.withColumns({"msg_key": key, "msg_value": value})


def open_decode(messages: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Keys and values back to images."""
    cell = ", ".join(f"`{n}`: struct<v: {k}>" for n, k in columns.items())
    m = messages.withColumns({"k": F.from_json("msg_key", "ts bigint, scm string, tbl string"), "m": F.from_json("msg_value", f"u struct<{cell}>, p struct<{cell}>, d struct<{cell}>")})

    def image(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(*[F.col(f"{c}.{n}.v").alias(n) for n in columns]))

    kind = F.when(F.col("m.d").isNotNull(), "D").when(F.col("m.p").isNotNull(), "U").otherwise("I")
    return m.select(F.col("k.scm").alias("schema_name"), F.col("k.tbl").alias("table_name"), F.col("k.ts").alias("commit_ts"), kind.alias("row_type"), F.coalesce(image("m.p"), image("m.d")).alias("pre"), image("m.u").alias("post"))


def open_frames(df: DataFrame, size: int = OPEN_BATCH, max_bytes: int = 1 << 20) -> DataFrame:
    """C4: messages in batches: an 8-byte version, then 8-byte lengths before each key; values likewise.

    Batches are cut within a (topic, partition) in commit order, every ``size``
    rows and before a message that would take one past ``max_bytes`` (a message
    counts with its two lengths; one that is larger alone is a batch alone).
    """
    rows = df.withColumn("stream_", F.concat_ws("/", "topic", F.col("partition").cast("string")))
    extent_ = extent(rows, "stream_")
    rows = numbered(rows, "stream_", "commit_ts", ["msg_key", "msg_value"], "n", size=extent_).withColumn("n", F.col("n") - 1)

    def framed(c: str) -> Column:
        raw = F.col(c).cast("binary")
        return F.concat(F.unhex(F.lpad(F.hex(F.length(raw)), 16, "0")), raw)

    items = F.array_sort(F.collect_list(F.struct("n", framed("msg_key").alias("k"), framed("msg_value").alias("v"))))
    rows = dealt(rows.withColumn("batch", F.floor(F.col("n") / size)), extent_[0], "topic", "partition", "batch")
    g = rows.groupBy("topic", "partition", "batch").agg(items.alias("items"))

    def add(acc: Column, x: Column) -> Column:
        bytes_ = (F.octet_length(x["k"]) + F.octet_length(x["v"])).cast("bigint")
        over = acc["held"] + bytes_ > max_bytes
        part = F.when(over & (acc["held"] > 0), acc["part"] + 1).otherwise(acc["part"])
        held = F.when(over, bytes_).otherwise(acc["held"] + bytes_)
        return F.struct(part.alias("part"), held.alias("held"), F.concat(acc["parts"], F.array(part)).alias("parts"))

    zero = F.struct(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("held"), F.expr("cast(array() as array<int>)").alias("parts"))
    g = g.withColumn("parts", F.aggregate("items", zero, add)["parts"])
    g = g.withColumn("part", F.explode(F.array_distinct("parts")))
    g = g.withColumn("items", F.filter("items", lambda x, i: F.get(F.col("parts"), i) == F.col("part")))

    def joined(f: str) -> Column:
        return F.aggregate("items", F.lit(b""), lambda acc, x: F.concat(acc, x[f]))

    return g.select("topic", "partition", "batch", "part", F.size("items").cast("bigint").alias("n_rows"), F.concat(F.unhex(F.lit(f"{OPEN_VERSION:016x}")), joined("k")).alias("key_frame"), joined("v").alias("value_frame"))


# simple


def simple_encode(df: DataFrame, schema_version: Column) -> DataFrame:
    """Row messages with their schema's version; values are text."""
    kind = F.when(F.col("row_type") == "I", "INSERT").when(F.col("row_type") == "U", "UPDATE").otherwise("DELETE")
    return df.withColumn("message", F.to_json(F.struct(F.lit(1).alias("version"), F.col("schema_name").alias("database"), F.col("table_name").alias("table"), F.col("table_id").alias("tableID"), kind.alias("type"), F.col("commit_ts").alias("commitTs"), schema_version.alias("schemaVersion"), F.when(F.col("row_type") != "D", _text_map(df, "post")).alias("data"), F.when(F.col("row_type") != "I", _text_map(df, "pre")).alias("old"))))


def simple_bootstrap(tables: DataFrame) -> DataFrame:
    """A table's schema as a message that precedes its rows."""
    return tables.withColumn("message", F.to_json(F.struct(F.lit(1).alias("version"), F.lit("BOOTSTRAP").alias("type"), F.col("table_id").alias("tableID"), F.col("version").alias("schemaVersion"), F.col("n_columns").alias("columns"))))


#: The message type of a DDL's kind; all others are ALTER.
SIMPLE_DDL = {
    "create table": "CREATE", "recover table": "CREATE", "create schema": "QUERY", "drop schema": "QUERY", "drop table": "ERASE", "truncate table": "TRUNCATE",
    "rename table": "RENAME", "rename tables": "RENAME", "add index": "CINDEX", "drop index": "DINDEX", "create view": "QUERY", "drop view": "QUERY",
}


def simple_ddl(ddl: DataFrame) -> DataFrame:
    """A DDL's message, by kind."""
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in SIMPLE_DDL.items() for x in pair])[F.lower("ddl_type")], F.lit("ALTER"))
    return ddl.withColumn("message", F.to_json(F.struct(F.lit(1).alias("version"), kind.alias("type"), F.col("query").alias("sql"), F.col("version").alias("commitTs"), F.col("schema_name").alias("database"), F.col("table_name").alias("table"))))


def simple_decode(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """Rows whose schema version is known; ``parked`` marks those that wait for theirs."""
    m = messages.withColumn("m", F.from_json("message", "database string, table string, tableID bigint, type string, commitTs bigint, schemaVersion bigint, data map<string,string>, old map<string,string>"))
    known = schemas.select(F.col("table_id").alias("k_table"), F.col("version").alias("k_version"))
    j = m.join(known, (F.col("m.tableID") == F.col("k_table")) & (F.col("m.schemaVersion") == F.col("k_version")), "left")
    return j.select(F.col("m.tableID").alias("table_id"), F.substring("m.type", 1, 1).alias("row_type"), F.col("m.commitTs").alias("commit_ts"), F.col("m.data").alias("data"), F.col("m.old").alias("old"), F.col("k_version").isNull().alias("parked"))


# debezium


#: The envelope's types by Spark type: primitive, name of the logical type.
DEBEZIUM_TYPES = {
    "tinyint": ("int16", None), "smallint": ("int16", None), "int": ("int32", None), "bigint": ("int64", None), "float": ("float", None), "double": ("double", None),
    "boolean": ("boolean", None), "string": ("string", None), "binary": ("bytes", None), "date": ("int32", "io.debezium.time.Date"),
    "timestamp_ntz": ("int64", "io.debezium.time.Timestamp"), "timestamp": ("string", "io.debezium.time.ZonedTimestamp"),
}


def debezium_value(c: Column, kind: str, fraction: int = 3) -> Column:
    """A value as the envelope has it: days of a date, milliseconds of a time without zone (microseconds beyond three digits), UTC text of one with, base64 of bytes, doubles of decimals."""
    if kind == "date":
        return F.unix_date(c)
    if kind == "timestamp_ntz":
        return _since_epoch(c, fraction)
    if kind == "timestamp":
        seconds = F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
        digits = F.rtrim(F.lpad((F.unix_micros(c) % 1000000).cast("string"), 6, "0"), F.lit("0"))
        return F.concat(seconds, F.when(digits != "", F.concat(F.lit("."), digits)).otherwise(""), F.lit("Z"))
    if kind == "binary":
        return F.base64(c)
    if kind.startswith("decimal"):
        return c.cast("double")
    return c


def _since_epoch(c: Column, fraction: int) -> Column:
    micros = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400000000 + F.hour(c) * F.lit(3600000000).cast("bigint") + F.minute(c) * F.lit(60000000).cast("bigint") + (F.date_format(c, "ss").cast("bigint") * 1000000 + F.date_format(c, "SSSSSS").cast("bigint"))
    return micros if fraction > 3 else F.floor(micros / 1000).cast("bigint")


def debezium_schema(df: DataFrame, cluster: str, schema: str, table: str, fraction: int = 3) -> str:
    """The schema section of a table's messages, as JSON."""
    import json

    fields = []
    for name, kind in _fields(df):
        primitive, logical = DEBEZIUM_TYPES.get(kind, ("double", None) if kind.startswith("decimal") else ("string", None))
        if kind == "timestamp_ntz" and fraction > 3:
            logical = "io.debezium.time.MicroTimestamp"
        fields.append({"type": primitive, "optional": True, **({"name": logical, "version": 1} if logical else {}), "field": name})
    prefix = f"{cluster}.{schema}.{table}"
    images = [{"type": "struct", "optional": True, "name": f"{prefix}.Value", "field": x, "fields": fields} for x in ("before", "after")]
    rest = [{"type": "string", "optional": False, "field": "op"}, {"type": "int64", "optional": True, "field": "ts_ms"}]
    return json.dumps({"type": "struct", "optional": False, "name": f"{prefix}.Envelope", "version": 1, "fields": images + rest}, separators=(",", ":"))


def debezium_encode(df: DataFrame, cluster: str, connector: str = "mysql", fraction: int = 3, schema: str = "") -> DataFrame:
    """The envelope: before, after, op c/u/d, the source's place and times; schema: a schema section to put before the payload."""
    op = F.when(F.col("row_type") == "I", "c").when(F.col("row_type") == "U", "u").otherwise("d")
    source = F.struct(F.lit(connector).alias("connector"), F.lit(cluster).alias("cluster_id"), F.shiftright("commit_ts", 18).alias("ts_ms"), F.col("schema_name").alias("db"), F.col("table_name").alias("table"), F.col("commit_ts").alias("commit_ts"))
    payload = F.struct(source.alias("source"), F.shiftright("commit_ts", 18).alias("ts_ms"), op.alias("op"), _debezium_image(df, "pre", fraction).alias("before"), _debezium_image(df, "post", fraction).alias("after"))
    message = F.to_json(F.struct(payload.alias("payload")))
    if schema:
        message = F.concat(F.lit('{"schema":' + schema + ","), F.expr("substring(message_, 2)"))
        return df.withColumn("message_", F.to_json(F.struct(payload.alias("payload")))).withColumn("message", message).drop("message_")
    return df.withColumn("message", message)


def _debezium_image(df: DataFrame, image: str, fraction: int) -> Column:
    return F.when(F.col(image).isNotNull(), F.struct(*[debezium_value(F.col(f"{image}.{n}"), k, fraction).alias(n) for n, k in _fields(df, image)]))


def debezium_decode(messages: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Envelopes back to images."""
    image = "struct<" + ", ".join(f"`{n}`: {k}" for n, k in columns.items()) + ">"
    m = messages.withColumn("m", F.from_json("message", f"payload struct<source: struct<db: string, table: string, commit_ts: bigint>, op: string, before: {image}, after: {image}>"))
    p = "m.payload"
    kind = F.when(F.col(f"{p}.op") == "c", "I").when(F.col(f"{p}.op") == "u", "U").otherwise("D")
    return m.select(F.col(f"{p}.source.db").alias("schema_name"), F.col(f"{p}.source.table").alias("table_name"), F.col(f"{p}.source.commit_ts").alias("commit_ts"), kind.alias("row_type"), F.col(f"{p}.before").alias("pre"), F.col(f"{p}.after").alias("post"))


# C11: type names


#: Java type numbers by SQL type; blobs and character types that hold bytes are 2004.
JAVA_TYPES = {
    "tinyint": -6, "smallint": 5, "mediumint": 4, "int": 4, "bigint": -5, "float": 7, "double": 8, "decimal": 3, "timestamp": 93, "datetime": 93, "date": 91,
    "time": 92, "year": 12, "enum": 4, "set": -7, "bit": -7, "json": 12, "char": 1, "varchar": 12, "tinytext": 2005, "text": 2005, "mediumtext": 2005, "longtext": 2005,
    "binary": 2004, "varbinary": 2004, "tinyblob": 2004, "blob": 2004, "mediumblob": 2004, "longblob": 2004,
}


def java_type(sql_type: Column) -> Column:
    """C11: the Java type number of a SQL type's name, with or without length and ``unsigned``; null if unknown."""
    bare = F.regexp_extract(F.lower(sql_type), r"^\s*([a-z]+)", 1)
    return F.create_map(*[F.lit(x) for pair in JAVA_TYPES.items() for x in pair])[bare]


# Large messages


def limit_message(df: DataFrame, limit: int, mode: str, message: str = "message", location: str = "", small: Column | None = None, key: Column | None = None, raw: bool = False) -> DataFrame:
    """What happens to messages over the limit: none (an error), claim-check (a place instead), handle-key-only.

    ``small``: the handle-key-only message, an error too if it is still too long.
    claim-check leaves the whole message in ``claim_payload`` beside its place;
    write_claims or store_claims must have written them before the messages are sent.
    """
    size = F.octet_length(message)
    if mode == "claim-check":
        place = F.concat(F.lit(location.rstrip("/") + "/"), F.sha2(message, 256), F.lit(".json"))
        key_json = F.base64(F.encode(key, "UTF-8")) if key is not None else F.lit("")
        payload = F.col(message) if raw else F.to_json(F.struct(key_json.alias("key"), F.base64(F.encode(message, "UTF-8")).alias("value")))
        out = df.withColumns({"claim_check": F.when(size > limit, place), "claim_payload": F.when(size > limit, payload)})
        return out.withColumn(message, F.when(size > limit, F.lit(None)).otherwise(F.col(message)))
    fail = F.raise_error("message too large")
    if mode == "handle-key-only" and small is not None:
        return df.withColumn(message, F.when(size <= limit, F.col(message)).when(F.octet_length(small) <= limit, small).otherwise(fail.cast("string")))
    return df.withColumn(message, F.when(size <= limit, F.col(message)).otherwise(fail.cast("string")))


def write_claims(df: DataFrame) -> DataFrame:
    """Writes claim_payload to claim_check for each row that has them; (path, bytes) of what was written.

    A lazy frame: it writes when it is run.  A file is named by its message's
    digest and appears whole, so a task that runs again leaves the same files.
    """

    def run(batches):
        import uuid

        import pyarrow as pa
        import pyarrow.fs

        for batch in batches:
            paths, sizes = [], []
            for path, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, place = pa.fs.FileSystem.from_uri(path)
                fs.create_dir(place.rpartition("/")[0], recursive=True)
                data, part = payload.encode(), f"{place}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(data)
                fs.move(part, place)
                paths.append(path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return df.where("claim_check is not null").select("claim_check", "claim_payload").mapInArrow(run, "path string, bytes bigint")


#: Rows of stored claims for each task that fetches them.
CLAIMS_EACH = 250_000


def store_claims(df: DataFrame, location: str) -> None:
    """claim_payload of all rows that have them as one table of (claim_check, claim_payload) at a new location.

    For messages by the million, of which write_claims makes as many files:
    here a task writes one, and places are keys of the table.
    """
    df.where("claim_check is not null").select("claim_check", "claim_payload").write.option("compression", "zstd").parquet(location)


def fetch_claims(df: DataFrame, location: str, message: str = "message") -> DataFrame:
    """Messages with what store_claims put aside for them (``raw`` payloads) in their place again; the other columns as they are."""
    spark = df.sparkSession
    stored = spark.read.schema("claim_check string, claim_payload string").parquet(location)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored.count() // CLAIMS_EACH))
    # equal messages have one place
    stored = stored.select(F.col("claim_check").alias("place_"), F.col("claim_payload").alias("stored_")).repartition(n, "place_").dropDuplicates(["place_"])
    rows = df.drop("claim_payload")
    away = rows.where("claim_check is not null").repartition(n, "claim_check").join(stored, F.col("claim_check") == F.col("place_"), "left")
    return rows.where("claim_check is null").unionByName(away.withColumn(message, F.col("stored_")).drop("place_", "stored_"))


# Q1-Q5: statements


def _literal(c: Column, kind: str) -> Column:
    if kind == "string":
        return F.coalesce(F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))
    return F.coalesce(text(c, kind), F.lit("NULL"))


def where_handle(image: str, indexes: list[dict], names: list[str]) -> Column:
    """Q5 by data: the primary key, else a not-null unique key, else the first unique key without a null in this row, else all columns."""
    fixed = where_columns(indexes, [])
    if fixed:
        return F.array(*[F.lit(n) for n in fixed])
    out = F.array(*[F.lit(n) for n in names])
    for i in reversed([i for i in indexes if i.get("unique")]):
        whole = F.lit(True)
        for n in i["columns"]:
            whole = whole & F.col(f"{image}.{n}").isNotNull()
        out = F.when(whole, F.array(*[F.lit(n) for n in i["columns"]])).otherwise(out)
    return out


def where_columns(indexes: list[dict], names: list[str]) -> list[str]:
    """Q5: the primary key, else a not-null unique key, else all columns."""
    for wanted in ("primary", "not_null_unique"):
        for i in indexes:
            if i.get(wanted):
                return list(i["columns"])
    return list(names)


def statements(df: DataFrame, keys: list[str], safe: bool = False) -> DataFrame:
    """Q1, Q2: each row's statement; in safe mode inserts replace and updates delete and replace."""
    fields = _fields(df)
    q = "`"
    table = F.concat(F.lit(q), F.col("schema_name"), F.lit("`.`"), F.col("table_name"), F.lit(q))
    names = ",".join(f"`{n}`" for n, _ in fields)

    def where(image: str) -> Column:
        tests = [F.when(F.col(f"{image}.{n}").isNull(), F.lit(f"`{n}` IS NULL")).otherwise(F.concat(F.lit(f"`{n}` = "), _literal(F.col(f"{image}.{n}"), k))) for n, k in fields if n in (keys or [x for x, _ in fields])]
        return F.concat_ws(" AND ", *tests)

    values = F.concat_ws(",", *[_literal(F.col(f"post.{n}"), k) for n, k in fields])
    put = F.concat(F.lit("REPLACE INTO " if safe else "INSERT INTO "), table, F.lit(f" ({names}) VALUES ("), values, F.lit(")"))
    remove = F.concat(F.lit("DELETE FROM "), table, F.lit(" WHERE "), where("pre"), F.lit(" LIMIT 1"))
    change = F.concat(F.lit("UPDATE "), table, F.lit(" SET "), F.concat_ws(",", *[F.concat(F.lit(f"`{n}` = "), _literal(F.col(f"post.{n}"), k)) for n, k in fields]), F.lit(" WHERE "), where("pre"), F.lit(" LIMIT 1"))
    update = F.array(remove, put) if safe else F.array(change)
    return df.withColumn("statement", F.explode(F.when(F.col("row_type") == "I", F.array(put)).when(F.col("row_type") == "D", F.array(remove)).otherwise(update)))


def multi_row(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Q4, Q6: deletes, updates and inserts of a table in statements of at most size rows; deletes come first.

    An update sets each column by CASE over the rows' conditions.
    """
    fields = _fields(df)
    tests = [F.when(F.col(f"pre.{n}").isNull(), F.lit(f"`{n}` IS NULL")).otherwise(F.concat(F.lit(f"`{n}` = "), _literal(F.col(f"pre.{n}"), k))) for n, k in fields if n in (keys or [x for x, _ in fields])]
    where = F.concat_ws(" AND ", *tests)
    values = [_literal(F.col(f"post.{n}"), k) for n, k in fields]
    rows = df.withColumns({"where_": where, "values_": F.array(*values), "group_": F.concat_ws("/", "schema_name", "table_name", "row_type")})
    rows = numbered(rows, "group_", "commit_ts", ["row_key"], "n")
    g = rows.groupBy("schema_name", "table_name", "row_type", F.floor((F.col("n") - 1) / size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("n", "where_", "values_"))).alias("items"), F.count("*").alias("n_rows"))
    conditions = F.concat(F.lit("("), F.array_join(F.transform("items", lambda x: x["where_"]), ") OR ("), F.lit(")"))
    pieces = F.transform("items", lambda x: F.concat(F.lit("("), F.array_join(x["values_"], ","), F.lit(")")))

    def case(n: str, i: int) -> Column:
        rows_ = F.transform("items", lambda x: F.concat(F.lit("WHEN "), x["where_"], F.lit(" THEN "), F.get(x["values_"], F.lit(i))))
        return F.concat(F.lit(f"`{n}`=CASE "), F.array_join(rows_, " "), F.lit(" END"))

    cases = F.concat_ws(", ", *[case(n, i) for i, (n, _) in enumerate(fields)])
    table = F.concat(F.lit("`"), F.col("schema_name"), F.lit("`.`"), F.col("table_name"), F.lit("`"))
    names = ",".join(f"`{n}`" for n, _ in fields)
    remove = F.concat(F.lit("DELETE FROM "), table, F.lit(" WHERE "), conditions)
    change = F.concat(F.lit("UPDATE "), table, F.lit(" SET "), cases, F.lit(" WHERE "), conditions)
    return g.withColumn("statement", F.when(F.col("row_type") == "D", remove).when(F.col("row_type") == "U", change).otherwise(F.concat(F.lit("INSERT INTO "), table, F.lit(f" ({names}) VALUES "), F.array_join(pieces, ",")))).drop("items")


def batch_eligible(n_rows: Column, has_key: Column, virtual_key: Column, mixed: Column) -> Column:
    """Q3: rows may share statements: a key without virtual columns, more than one row, one safe mode."""
    return has_key & ~virtual_key & (n_rows > 1) & ~mixed
