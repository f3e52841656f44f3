"""A change log of JSON lines as a Python data source, for batches and streams.

``spark.dataSource.register(ChangeLogSource)``, then
``spark.readStream.format("changelog").option("path", folder)``.  Every file is
a partition; a stream's offset is the number of files in name order, so files
must be added with ascending names.  The folder is opened with pyarrow, so it
may be any store that it knows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

COLUMNS = "kind string, region_id bigint, op string, key string, start_ts bigint, commit_ts bigint, value string, old_value string"


def _files(path: str) -> list[str]:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.is_file and f.base_name[0] not in "._")


def _rows(path: str, file: str) -> Iterator[tuple]:
    from pyarrow import fs

    store, _ = fs.FileSystem.from_uri(path)
    names = [c.split(" ")[0] for c in COLUMNS.split(", ")]
    with store.open_input_stream(file) as stream:
        for line in stream.read().decode().splitlines():
            if line.strip():
                row = json.loads(line)
                yield tuple(row.get(n) for n in names)


class _File(InputPartition):
    def __init__(self, file: str):
        super().__init__(file)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in _files(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(self.path, partition.value)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(_files(self.path))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(f) for f in _files(self.path)[start["files"] : end["files"]]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(self.path, partition.value)

    def commit(self, end: dict) -> None:
        pass


class ChangeLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "changelog"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])
