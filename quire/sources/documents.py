"""Data sources of documents: pages of files by page range, and files that a job writes together or not at all.

Both go through Arrow's file systems, so a path may lie in any store that these
know; a plain path is a local or mounted folder.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage


def _store(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


# --- pages ------------------------------------------------------------------------


@dataclass
class PageRange(InputPartition):
    file: str
    first: int
    last: int | None  # not in it; None: to the end


class _PageReader(DataSourceReader):
    def __init__(self, path: str, ending: str, each: int, decoder: Callable, count: Callable | None, names: list[str]):
        self.path, self.ending, self.each = path, ending.lower(), each
        self.decoder, self.count, self.names = decoder, count, names
        self.first, self.last = 0, None

    def pushFilters(self, filters):
        """Bounds of the page number narrow what is opened; Spark applies every filter again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("page",):
                values = list(f.value) if isinstance(f, In) else [getattr(f, "value", None)]
                if values and all(isinstance(v, int) for v in values):
                    low, high = min(values), max(values)
                    if isinstance(f, (EqualTo, In, GreaterThanOrEqual, GreaterThan)):
                        self.first = max(self.first, low + isinstance(f, GreaterThan))
                    if isinstance(f, (EqualTo, In, LessThan, LessThanOrEqual)):
                        end = high + (not isinstance(f, LessThan))
                        self.last = end if self.last is None else min(self.last, end)
            yield f

    def partitions(self):
        from pyarrow import fs

        store, path = _store(self.path)
        found = store.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=False))
        names = sorted(f.path for f in files if f.type == fs.FileType.File and f.path.lower().endswith(self.ending))
        out = []
        for name in names:
            end = self.last
            if self.each and self.count:
                with store.open_input_file(name) as f:
                    n = self.count(f)
                end = n if end is None else min(end, n)
                out += [PageRange(name, at, min(at + self.each, end)) for at in range(self.first, end, self.each)]
            elif end is None or self.first < end:
                out.append(PageRange(name, self.first, end))
        return out or [PageRange("", 0, 0)]

    def read(self, partition: PageRange):
        if not partition.file:
            return
        store, _ = _store(self.path)
        with store.open_input_file(partition.file) as f:
            for page in self.decoder(f.read(), partition.first, partition.last):
                yield tuple(partition.file if n == "file" else page.get(n) for n in self.names)


def read_pages(spark: SparkSession, path: str, decoder: Callable[[bytes, int, int | None], Iterator[dict]], schema: str, ending: str = ".pdf", pages_per_task: int = 0, count: Callable | None = None) -> DataFrame:
    """Pages of a file, or of a folder's files (not of its subfolders), by name: ``file``, ``page`` and the columns of ``schema``.

    ``decoder(content, first, last)`` yields pages as dictionaries with their
    ``page``.  A task has a file, or ``pages_per_task`` of it if ``count(file)``
    tells how many pages one has.  Comparisons of ``page`` with numbers narrow
    the range, so pages outside it are never decoded.  A folder without such
    files gives no rows.
    """
    full = f"file string, page int, {schema}"
    names = [c.split()[0] for c in full.split(", ")] if "<" not in full else spark.createDataFrame([], full).columns

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return "quire-pages"

        def schema(self):
            return full

        def reader(self, schema):
            return _PageReader(path, ending, pages_per_task, decoder, count, names)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Pages)
    return spark.read.format("quire-pages").load()


# --- files ------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    folder: str


class _FileWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.own = folder.rstrip("/"), f".writing-{uuid.uuid4().hex}"

    def write(self, rows):
        from pyarrow import fs

        store, root = _store(self.folder)
        own = f"{root}/{self.own}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        for name, content in rows:
            name = _safe(name)
            if store.get_file_info(f"{own}/{name}").type != fs.FileType.NotFound:
                raise ValueError(f"two documents would be written as {name}")
            store.create_dir(posixpath.dirname(f"{own}/{name}"), recursive=True)
            with store.open_output_stream(f"{own}/{name}") as f:
                f.write(bytes(content or b""))
        return Written(own)

    def commit(self, messages):
        """Moves what the tasks wrote into the folder; a name that two rows have fails before anything is moved."""
        from pyarrow import fs

        store, root = _store(self.folder)
        tasks = [m.folder for m in messages if m]
        inside = lambda own: [f.path[len(own) + 1 :] for f in store.get_file_info(fs.FileSelector(own, recursive=True)) if f.type == fs.FileType.File]
        seen: set[str] = set()
        for own in tasks:
            for name in inside(own):
                if name in seen:
                    self.abort(messages)
                    raise ValueError(f"two documents would be written as {name}")
                seen.add(name)
        for own in tasks:
            for name in inside(own):
                store.create_dir(posixpath.dirname(f"{root}/{name}"), recursive=True)
                store.move(f"{own}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages):
        from pyarrow import fs

        store, root = _store(self.folder)
        if store.get_file_info(f"{root}/{self.own}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.own}")


def _safe(name: str) -> str:
    clean = posixpath.normpath(name or "")
    if clean in (".", "") or clean.startswith(("/", "..")):
        raise ValueError(f"not a file's name within the folder: {name!r}")
    return clean


class Files(DataSource):
    """Rows (file, content) as files of a folder, all of a job's or none of them."""

    @classmethod
    def name(cls):
        return "quire-files"

    def writer(self, schema, overwrite):
        return _FileWriter(self.options["path"])


def write_files(files: DataFrame, folder: str) -> None:
    """Write rows (``file``: a name below the folder, ``content``) as files; those of the same name are replaced, others stay.

    Each task writes into a hidden folder of its own below; files are moved when
    all tasks have ended, and a job that fails leaves none of them.  Only a task
    that outlives its failed job may leave its hidden folder (``.writing-...``).
    """
    files.sparkSession.dataSource.register(Files)
    files.select("file", files["content"].cast("binary")).write.format("quire-files").mode("append").save(folder)
