"""A connector to systems outside, as a data source: references that can be searched and resolved.

Format ``outside_references`` reads (id, source, title, url, metadata) from Parquet files with a text and an id in them. What a query asks of the id
(``resolve``) and of the title (``search``) is pushed to the source: an id is looked for only in row groups whose range holds it, and only
the rows that fit leave a task. A task reads one row group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringStartsWith

from .session import ship

REFERENCES = "id string, source string, title string, url string, metadata string"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class RowGroup(InputPartition):
    path: str
    number: int


class ReferenceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.source = options["path"], options.get("source", "")
        self.key, self.text, self.url = options.get("key", "id"), options.get("text", "text"), options.get("url", "")
        self.ids: set[str] | None = None
        self.titles: list[tuple[str, str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  (the name that Spark calls)
        """Take what is asked of ids and titles; give back the rest, which Spark sees to."""
        for f in filters:
            match f:
                case EqualTo(("id",), value):
                    self._only({value})
                case In(("id",), values):
                    self._only(set(values))
                case StringContains(("title",), value):
                    self.titles.append(("contains", value))
                case StringStartsWith(("title",), value):
                    self.titles.append(("starts", value))
                case _:
                    yield f

    def _only(self, ids: set) -> None:
        self.ids = ids if self.ids is None else self.ids & ids

    def _keys(self, integer: bool) -> list:
        """The ids asked for, as the files hold them; where they hold whole numbers, only what is written as one can be there."""
        asked = {i for i in self.ids or () if i is not None}
        return sorted(int(i) for i in asked if i.lstrip("-").isdecimal() and str(int(i)) == i) if integer else sorted(asked)

    def partitions(self) -> list[InputPartition]:
        """A task for each row group that can hold what is asked for; only footers are read here, a few of them at a time."""
        from concurrent.futures import ThreadPoolExecutor

        from pyarrow import fs

        system, path = _open(self.path)
        info = system.get_file_info(path)
        files = [path] if info.type == fs.FileType.File else sorted(f.path for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.base_name.endswith(".parquet"))
        with ThreadPoolExecutor(16) as pool:
            return [g for groups in pool.map(self._groups, files) for g in groups]

    def _groups(self, file: str) -> list[InputPartition]:
        import pyarrow as pa
        import pyarrow.parquet as pq

        with pq.ParquetFile(_open(self.path)[0].open_input_file(file)) as found:
            integer = pa.types.is_integer(found.schema_arrow.field(self.key).type)
            column = next(i for i in range(found.metadata.num_columns) if found.metadata.schema.column(i).path == self.key)
            groups = range(found.metadata.num_row_groups)
            if self.ids is not None:
                keys = self._keys(integer)
                stats = {g: found.metadata.row_group(g).column(column).statistics for g in groups}
                groups = [g for g in groups if keys and (stats[g] is None or not stats[g].has_min_max or any(stats[g].min <= k <= stats[g].max for k in keys))]
            return [RowGroup(file, g) for g in groups]

    def read(self, partition: RowGroup | None) -> Iterator:
        if partition is None:  # no row group can hold what is asked for
            return
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        with pq.ParquetFile(_open(self.path)[0].open_input_file(partition.path)) as found:
            integer = pa.types.is_integer(found.schema_arrow.field(self.key).type)
            for batch in found.iter_batches(1024, row_groups=[partition.number], columns=[self.key, self.text]):
                rows = pa.table({"key": batch.column(self.key), "title": batch.column(self.text).cast(pa.large_string())})
                if self.ids is not None:
                    rows = rows.filter(pc.is_in(rows["key"], pa.array(self._keys(integer), rows["key"].type)))
                for how, value in self.titles:
                    rows = rows.filter((pc.match_substring if how == "contains" else pc.starts_with)(rows["title"], value))
                ids = rows["key"].cast(pa.string())
                title = rows["title"].cast(pa.string())
                same = lambda value: pa.array([value] * len(rows), pa.string())  # noqa: B023, E731
                metadata = pc.binary_join_element_wise('{"length":', pc.utf8_length(title).cast(pa.string()), "}", "")
                url = pc.binary_join_element_wise(self.url, ids, "")
                for out in pa.table({"id": ids, "source": same(self.source), "title": title, "url": url, "metadata": metadata}).to_batches():
                    yield out


class ReferenceSource(DataSource):
    """Options: path, key and text (columns of the files), source (the connector's name), url (what ids are put behind)."""

    @classmethod
    def name(cls) -> str:
        return "outside_references"

    def schema(self) -> str:
        return REFERENCES

    def reader(self, schema) -> ReferenceReader:
        return ReferenceReader(dict(self.options))


class Connector:
    """A named system outside: what it holds, what a search finds there, and what ids stand for."""

    def __init__(self, spark: SparkSession, name: str, path: str, key: str = "id", text: str = "text", url: str = ""):
        ship(spark)
        spark.dataSource.register(ReferenceSource)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        self.name = name
        self.rows = spark.read.format("outside_references").options(source=name, key=key, text=text, url=url).load(path)

    def search(self, query: str) -> DataFrame:
        """References whose title contains the query; null titles are in none."""
        return self.rows.where(F.contains("title", F.lit(query)))

    def resolve(self, *ids: str) -> DataFrame:
        """The references of these ids; an id that is not there has no row."""
        return self.rows.where(F.col("id").isin(*ids) if len(ids) != 1 else F.col("id") == ids[0])
