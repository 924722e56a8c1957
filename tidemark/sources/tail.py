"""Growing log files as a stream: what was appended since the last batch, in whole lines.

A streaming data source whose offsets are bytes a file. ``register(spark)`` makes it known; then

    spark.readStream.format("tail").option("path", "/mnt/logs").load()

gives (file, start_byte, raw). The folder is one that driver and executors share. A line without its end is held back until it is
whole. A file that is another one under the old name (its first line or its inode differs), or that has become shorter, is read
from its start. Offsets stand in the query's checkpoint: a restart reads each byte range once, as it was planned.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, start_byte long, raw string"
#: Bytes that one task reads at most, lines at its ends aside.
SPLIT = 64 << 20
_BLOCK = 1 << 16


@dataclass
class Split(InputPartition):
    file: str
    low: int
    high: int
    first: bool  # starts at the start of a line; any other begins behind the first line end from low - 1 on


def _identity(path: str) -> str:
    """The file's inode and a check sum of its first line."""
    with open(path, "rb") as f:
        return f"{os.fstat(f.fileno()).st_ino}-{zlib.crc32(f.readline(_BLOCK)):08x}"


def whole_bytes(path: str) -> int:
    """Bytes up to the last line end."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > 0:
            low = max(0, at - _BLOCK)
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return 0


def splits(file: str, low: int, high: int, most: int = SPLIT) -> list[Split]:
    return [Split(file, a, min(a + most, high), a == low) for a in range(low, high, most)]


def lines_of(split: Split) -> Iterator[tuple[int, bytes]]:
    """(start byte, line without its end) of each line that starts in a split."""
    with open(split.file, "rb") as f:
        at = split.low if split.first else split.low - 1
        f.seek(at)
        if not split.first:
            at += len(f.readline())
        while at < split.high:
            line = f.readline()
            if not line.endswith(b"\n"):
                return
            yield at, line[:-1].removesuffix(b"\r")
            at += len(line)


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """file -> [identity, whole bytes] of every file of the folder that holds a whole line."""
        found = {}
        for folder, _, names in os.walk(self.path):
            for name in sorted(names):
                file = os.path.join(folder, name)
                try:
                    size = whole_bytes(file)
                    if size:
                        found[file] = [_identity(file), size]
                except FileNotFoundError:  # rotated away while the folder was listed
                    continue
        return found

    def partitions(self, start: dict, end: dict) -> list[Split]:
        out = []
        for file, (identity, size) in sorted(end.items()):
            was, done = start.get(file, ["", 0])
            low = done if was == identity and done <= size else 0
            out += splits(file, low, size, self.most)
        return out

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, bytes]] = []
        for row in lines_of(split):
            rows.append(row)
            if len(rows) == 4096:
                yield _batch(split.file, rows)
                rows = []
        if rows:
            yield _batch(split.file, rows)


def _batch(file: str, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    texts = [line.decode("utf-8", "replace") for _, line in rows]
    return pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array([at for at, _ in rows], pa.int64()), pa.array(texts, pa.string())], names=["file", "start_byte", "raw"])


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:  # noqa: N802
        return TailReader(self.options["path"], int(self.options.get("splitBytes", SPLIT)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)
