"""The extension point for sources: Python data sources over paged JSON records and over runs of posts (a stream), and lane-tagged unions of connectors."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from almanack.sources import tables


class PagedJson(DataSource):
    """``spark.read.format("paged_json").schema(...).options(pages=..., path=...)``: page i is the JSON lines file ``path`` with {page} replaced by i; each page is a partition."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options["path"], int(self.options.get("pages", "1")), [f.name for f in schema])


class _Pages(DataSourceReader):
    def __init__(self, path: str, pages: int, names: list[str]):
        self.path, self.pages, self.names = path, pages, names

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        path = self.path.replace("{page}", str(partition.value))
        system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        if system.get_file_info(at).type == fs.FileType.NotFound:  # a page past the last
            return
        with system.open_input_stream(at) as f:
            for line in f.read().decode().splitlines():
                if line.strip():
                    row = json.loads(line)
                    yield tuple(row.get(n) for n in self.names)


class PostLog(DataSource):
    """``spark.readStream.format("post_log").schema(...).option("path", ...)``: posts in runs, as ``append_run`` writes them; a stream's offset is the cursor, the last run that was read.

    A run counts once its marker stands, so a run in the making isn't read; the
    files of a run are partitions, and lines that aren't objects are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "post_log"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Posts(self.options["path"], [f.name for f in schema])


class _Posts(DataSourceStreamReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def initialOffset(self) -> dict:
        return {"run": 0}

    def latestOffset(self) -> dict:
        """The last run before the first one that lacks a marker."""
        have = {_run_of(f.path) for f in _listed(self.path) if f.base_name.endswith(".done")}
        last = 0
        while last + 1 in have:
            last += 1
        return {"run": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(f.path) for i in range(start["run"] + 1, end["run"] + 1) for f in _listed(f"{self.path.rstrip('/')}/{_run_name(i)}") if not f.base_name.startswith(("_", "."))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = _opened(self.path)
        with system.open_input_stream(partition.value) as f:
            for line in io.TextIOWrapper(f, "utf-8", errors="replace"):
                row = _parsed(line)
                if row is not None:
                    yield tuple(row.get(n) for n in self.names)

    def commit(self, end: dict) -> None:
        """Runs stay where they are; the cursor is in the stream's checkpoint."""


def _opened(path: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list:
    from pyarrow import fs

    system, at = _opened(path)
    return sorted(system.get_file_info(fs.FileSelector(at, allow_not_found=True)), key=lambda f: f.path)


def _run_name(i: int) -> str:
    return f"run-{i:09d}"


def _run_of(path: str) -> int:
    return int(path.rsplit("/run-", 1)[-1].split(".")[0])


def _parsed(line: str) -> dict | None:
    try:
        row = json.loads(line)
    except ValueError:
        return None
    return row if isinstance(row, dict) else None


def append_run(posts: DataFrame, path: str, run: int) -> None:
    """Write a run of posts as JSON lines, and then its marker."""
    base = f"{path.rstrip('/')}/{_run_name(run)}"
    posts.write.mode("overwrite").json(base, ignoreNullFields=False)
    system, at = _opened(base)
    with system.open_output_stream(f"{at}.done") as f:
        f.write(b"")


def register(spark: SparkSession) -> None:
    """Make the sources known to the session, and their package to the executors."""
    tables.ship(spark)
    spark.dataSource.register(PagedJson)
    spark.dataSource.register(PostLog)


def gather(connectors: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """All connectors' rows by column name, each with its lane; a column that one lacks is null there."""
    out = None
    for lane, read in connectors.items():
        rows = read().withColumn("lane", F.lit(lane))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
