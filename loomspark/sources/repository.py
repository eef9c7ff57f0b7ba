"""Repositories as a data source: folders are listed in tasks, ignored ones are never entered, and of each file only what is kept is read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Folder(InputPartition):
    """A folder to be listed in one task, with all below it or alone."""

    def __init__(self, path: str, below: bool):
        self.path, self.below = path, below


def opened(root: str) -> tuple[pf.FileSystem, str]:
    """The file system of a folder's name, and the folder on it."""
    files, path = pf.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pf.LocalFileSystem(), root)
    return files, path.rstrip("/")


class Walk:
    """Lists a tree, folder by folder; ``ignored``: names, and endings of names that begin with a point, of folders not to enter."""

    def __init__(self, files: pf.FileSystem, ignored: tuple[str, ...], extensions: tuple[str, ...]):
        self.files, self.ignored, self.extensions = files, ignored, extensions

    def enters(self, name: str) -> bool:
        return not any(name == i or (i.startswith(".*") and name.startswith(".") and name.endswith(i[2:])) for i in self.ignored)

    def list(self, folder: str) -> tuple[list[str], list[tuple[str, int, int]]]:
        """Folders to enter, and taken files with size and time of change."""
        folders, found = [], []
        for f in self.files.get_file_info(pf.FileSelector(folder)):
            if f.type == pf.FileType.Directory:
                folders += [f.path] if self.enters(f.base_name) else []
            elif f.type == pf.FileType.File and (not self.extensions or f.path.lower().endswith(self.extensions)):
                found.append((f.path, f.size, f.mtime_ns // 1000))
        return sorted(folders), found

    def below(self, folder: str) -> Iterator[tuple[str, int, int]]:
        waiting = [folder]
        while waiting:
            folders, found = self.list(waiting.pop())
            waiting += folders
            yield from found


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.tasks = options["path"], int(options.get("tasks", "64"))
        self.named = {k: tuple(x for x in options.get(k, "").split(",") if x) for k in ("ignored", "extensions")}

    def walk(self) -> tuple[Walk, str]:
        files, top = opened(self.root)
        return Walk(files, self.named["ignored"], self.named["extensions"]), top

    def partitions(self) -> list[Folder]:
        """Upper folders, a level at a time, until there are enough to share out; each of those left is one task's."""
        walk, top = self.walk()
        level, listed = [top], []
        while level and len(level) + len(listed) < self.tasks:
            listed += level
            level = [d for folder in level for d in walk.list(folder)[0]]
        return [Folder(d, False) for d in listed] + [Folder(d, True) for d in level]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        walk, top = self.walk()
        found = list(walk.below(partition.path) if partition.below else walk.list(partition.path)[1])
        paths = [p[len(top) :].lstrip("/") for p, _, _ in found]
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([s for _, s, _ in found], pa.int64()), pa.array([t for _, _, t in found], pa.int64())], ["path", "n_bytes", "changed"])


class RepositorySource(DataSource):
    """path (below the root), n_bytes and changed (microseconds) of a repository's files.

    Options: path, ignored and extensions (comma-separated; none: all), tasks (folders to share out at least, where there are as many).
    """

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return "path string, n_bytes long, changed long"

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader(self.options)


def list_files(spark: SparkSession, root: str, ignored: tuple[str, ...] = (), extensions: tuple[str, ...] = (), tasks: int = 64) -> DataFrame:
    spark.dataSource.register(RepositorySource)
    return spark.read.format("repository").option("ignored", ",".join(ignored)).option("extensions", ",".join(extensions)).option("tasks", tasks).load(root)


def read_bodies(files: DataFrame, root: str, max_chars: int) -> DataFrame:
    """files (path below root, and other columns) with body: the first max_chars characters, what isn't UTF-8 left out. No more bytes are read than these can take."""

    def read(batches):
        system, top = opened(root)
        for batch in batches:
            bodies = []
            for path in batch.column(at).to_pylist():
                with system.open_input_file(f"{top}/{path}") as f:
                    bodies.append(f.read(4 * max_chars).decode("utf-8", "ignore")[:max_chars])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bodies, pa.string())], [*batch.schema.names, "body"])

    at = files.columns.index("path")
    return files.mapInArrow(read, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", body string")


def write_files(rows: DataFrame, path: str, body: str, root: str) -> None:
    """Each row's body as a file of its own below root, written where the row is; a file is replaced as a whole."""

    def write(batches):
        system, top = opened(root)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system.create_dir(f"{top}/{name}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{top}/{name}") as f:
                    f.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    rows.select(F.col(path), F.col(body)).mapInArrow(write, "n long").agg(F.sum("n")).collect()
