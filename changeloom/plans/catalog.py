"""The registered change-stream queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Add a query (spark, sf_dir) -> DataFrame, and its DuckDB text if SQL can say it."""

    def add(fn):
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return add


def crc_sql(rows: str, query: str) -> str:
    """SQL over x: the rows of a query, whose column text (plain letters) has its CRC-32 beside it as crc, by the polynomial's table t."""
    table = "SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"
    one = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(text) + 1), lambda i: CAST(ascii(substr(text, i, 1)) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"
    return f"WITH crc_table AS ({table}), x AS (SELECT r.*, {one} AS crc FROM ({rows}) r, crc_table) {query}"


def _load() -> None:
    from changeloom.plans import queries_more, queries_rows, queries_sets  # noqa: F401  they register themselves


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changefeed query."""
    return queries()["changefeed"](spark, sf_dir)
