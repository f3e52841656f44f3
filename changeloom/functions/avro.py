"""Avro's binary encoding as column expressions, and the registry's envelope around it.

No package beside Spark is needed.  A record is its fields one after the other;
a nullable field is a union of null and its type: the branch, then the value.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Avro's primitive type by Spark type.
PRIMITIVES = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "long", "boolean": "boolean", "string": "string", "binary": "bytes", "float": "float", "double": "double"}
#: A Debezium connector's names for values that JSON has no type for.
CONNECT = {"date": ("int", "date"), "timestamp_ntz": ("long", "timestamp-millis")}


def long_bytes(value: Column) -> Column:
    """An integer in zig-zag order, seven bits a byte, the lowest first."""
    v = value.cast("bigint")
    zigzag = F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))

    def whole(z: Column) -> Column:
        size = F.greatest(F.ceil(F.length(F.bin(z)) / 7), F.lit(1)).cast("int")

        def byte(i: Column) -> Column:
            low = F.call_function("shiftrightunsigned", z, i * 7).bitwiseAND(F.lit(127).cast("bigint"))
            return F.lpad(F.hex(low + F.when(i + 1 < size, 128).otherwise(0)), 2, "0")

        return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), size - 1), byte), ""))

    return F.element_at(F.transform(F.array(zigzag), whole), 1)


def _double_bytes(value: Column, kind: str) -> Column:
    width = "<f4" if kind == "float" else "<f8"

    @F.pandas_udf("binary")
    def packed(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else np.array(v, width).tobytes())

    return packed(value)


def value_bytes(value: Column, kind: str) -> Column:
    """A value that isn't null, by its Spark type; what Avro has no type for goes as text."""
    if kind == "boolean":
        return F.when(value, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return long_bytes(value)
    if kind == "date":
        return long_bytes(F.unix_date(value))
    if kind == "timestamp_ntz":
        from changeloom.functions.codecs import debezium_value

        return long_bytes(debezium_value(value, kind))
    if kind in ("float", "double"):
        return _double_bytes(value, kind)
    raw = value if kind == "binary" else F.encode(value.cast("string"), "UTF-8")
    return F.concat(long_bytes(F.octet_length(raw)), raw)


def record(df: DataFrame, image: str = "post") -> Column:
    """The record of an image, each field a union of null and its type."""
    fields = [(f.name, f.dataType.simpleString()) for f in df.schema[image].dataType.fields]
    some, none = F.unhex(F.lit("02")), F.unhex(F.lit("00"))
    return F.concat(*[F.when(F.col(f"{image}.{n}").isNull(), none).otherwise(F.concat(some, value_bytes(F.col(f"{image}.{n}"), k))) for n, k in fields])


def schema(df: DataFrame, name: str, namespace: str, image: str = "post") -> str:
    """The schema of record's output."""
    fields = []
    for f in df.schema[image].dataType.fields:
        kind = f.dataType.simpleString()
        own = {"type": CONNECT[kind][0], "logicalType": CONNECT[kind][1]} if kind in CONNECT else PRIMITIVES.get(kind, "string")
        fields.append({"name": f.name, "type": ["null", own], "default": None})
    return json.dumps({"type": "record", "name": name, "namespace": namespace, "fields": fields}, separators=(",", ":"))


def envelope(payload: Column, schema_id: int) -> Column:
    """A zero byte, the schema's number in the registry as four bytes, the record."""
    return F.concat(F.unhex(F.lit(f"00{schema_id:08x}")), payload)


def debezium_avro(df: DataFrame, schema_id: int) -> DataFrame:
    """Before, after and op of a change as one record in the registry's envelope; an image that isn't there is null."""
    some, none = F.unhex(F.lit("02")), F.unhex(F.lit("00"))
    images = [F.when(F.col(i).isNull(), none).otherwise(F.concat(some, record(df, i))) for i in ("pre", "post")]
    op = F.when(F.col("row_type") == "I", "c").when(F.col("row_type") == "U", "u").otherwise("d")
    return df.withColumn("message", envelope(F.concat(*images, value_bytes(op, "string"), value_bytes(F.shiftright("commit_ts", 18), "bigint")), schema_id))
