"""Git logs as a streaming source: new commits of many logs, each once, also over restarts.

A folder holds a log for each repository, as a file or a folder of files in the order of their names, newest commit
first, as ``git log --format=%H%x00%s%x00%an%x00%at --name-status`` prints them. An offset is the head of every log.
A batch reads, a log a task, what lies between two heads, so a batch that runs again reads the same even if the
log has grown meanwhile. A log that is seen for the first time starts at its head, without history; so does one
whose last head is not in it any more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.session import ship

COMMITS = "source string, hash string, message string, author string, timestamp long, files array<struct<path:string,status:string>>"
#: Letters of a file's status, and how many fields a header has.
STATUSES, FIELDS = "AMDRCT", 4


def _entries(folder: str) -> dict[str, list[str]]:
    """The files of each log of a folder."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    out: dict[str, list[str]] = {}
    for info in system.get_file_info(fs.FileSelector(path)):
        if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")):
            out[info.base_name.removesuffix(".log")] = [info.path]
        elif info.type == fs.FileType.Directory:
            files = system.get_file_info(fs.FileSelector(info.path))
            out[info.base_name] = sorted(f.path for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
    return out


def _lines(folder: str, files: list[str]) -> Iterator[str]:
    import io

    from pyarrow import fs

    system = fs.FileSystem.from_uri(folder)[0] if "://" in folder else fs.LocalFileSystem()
    for file in files:
        with system.open_input_stream(file) as raw:
            yield from (line.rstrip("\n") for line in io.TextIOWrapper(raw, "utf-8", "replace", newline="\n"))


def parse(lines: Iterator[str]) -> Iterator[tuple]:
    """(hash, message, author, timestamp, files) of the commits of a log; lines before the first header are passed over."""
    head: list[str] | None = None
    files: list[tuple[str, str]] = []
    for line in lines:
        if "\x00" in line:
            if head:
                yield _commit(head, files)
            head, files = line.split("\x00"), []
        elif head and "\t" in line and line[0] in STATUSES:
            files.append((line.split("\t")[-1], line[0]))
    if head:
        yield _commit(head, files)


def _commit(head: list[str], files: list[tuple[str, str]]) -> tuple:
    at = head + [""] * FIELDS
    return at[0], at[1], at[2], int(at[3]) if at[3].isdigit() else None, files


@dataclass
class Range(InputPartition):
    """The commits of a log from its head down to, without it, the last one seen."""

    source: str
    files: tuple[str, ...]
    last: str
    head: str


class GitLogReader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        """Nothing seen: the first batch takes the heads down, and no commits."""
        return {}

    def latestOffset(self) -> dict:
        heads = {}
        for source, files in _entries(self.folder).items():
            first = next((line for line in _lines(self.folder, files) if "\x00" in line), None)
            if first:
                heads[source] = first.split("\x00")[0]
        return heads

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = _entries(self.folder)
        changed = [s for s, head in end.items() if s in start and start[s] != head and s in files]
        return [Range(s, tuple(files[s]), start[s], end[s]) for s in changed] or [Range("", (), "", "")]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.files:
            return
        hashes = (line.split("\x00")[0] for line in _lines(self.folder, list(partition.files)) if "\x00" in line)
        if not any(h == partition.last for h in hashes):
            return
        begun = False
        for hash_, *rest in parse(_lines(self.folder, list(partition.files))):
            begun = begun or hash_ == partition.head
            if hash_ == partition.last:
                return
            if begun:
                yield (partition.source, hash_, *rest)


class GitLogs(DataSource):
    """``spark.readStream.format("git_logs").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "git_logs"

    def schema(self) -> str:
        return COMMITS

    def streamReader(self, schema) -> GitLogReader:  # noqa: ANN001
        return GitLogReader(self.options["path"])


def git_stream(spark: SparkSession, folder: str):
    """New commits of the logs in a folder, as a stream (see COMMITS)."""
    ship(spark)
    spark.dataSource.register(GitLogs)
    return spark.readStream.format("git_logs").load(folder)
