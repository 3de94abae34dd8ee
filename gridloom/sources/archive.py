"""An archive folder as a Spark data source: files whose names tell their years, read by years.

``spark.dataSource.register(Archive)``, then ``spark.read.format("archive").load(folder)``.  Each Parquet file is a
partition.  Comparisons of the column ``year`` with numbers are taken over while Spark plans the query, which needs
``spark.sql.python.filterPushdown.enabled`` (see ``pushed_down``); so files of other years are neither opened nor get
a task.  The folder has to be one that Python can open; for others there is ``catalog.files_in_range``."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: The end of a name, as in ``tas_day_19960101-19971231.nc`` or ``tas_day_1996_avg-year.nc``.
SPAN = re.compile(r"_(\d{4})\d*(?:-(\d{4})\d*)?(?:_[a-z0-9]+-[a-z0-9]+)?(?:\.[A-Za-z]+)*$")


def years_of(path: str) -> tuple[int, int] | None:
    """First and last year that a file's name tells, or else that of the nearest folder around it; None where none does."""
    for part in reversed(path.split("/")):
        if found := SPAN.search(part):
            return int(found[1]), int(found[2] or found[1])
    return None


class File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class Archive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def files(self) -> list[str]:
        import pyarrow.fs

        where = urlparse(self.options["path"])
        store, folder = pyarrow.fs.FileSystem.from_uri(self.options["path"]) if where.scheme else (pyarrow.fs.LocalFileSystem(), where.path)
        found = store.get_file_info(pyarrow.fs.FileSelector(folder, recursive=True))
        return sorted(f.path for f in found if f.path.endswith(".parquet"))

    def schema(self) -> str:
        import pyarrow.parquet as pq

        from pyspark.sql.pandas.types import from_arrow_schema

        files = self.files()
        if not files:
            raise ValueError(f"no files in {self.options['path']}")
        return from_arrow_schema(pq.read_schema(files[0]))

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.files(), schema)


class ArchiveReader(DataSourceReader):
    def __init__(self, files: list[str], schema):
        self.all, self.schema, self.low, self.high, self.some = files, schema, -(10**9), 10**9, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Notes which years are asked for.  All filters go back to Spark, since a file may hold more than its years."""
        for f in filters:
            if getattr(f, "attribute", None) == ("year",) and isinstance(getattr(f, "value", None), (int, list, tuple)):
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, f.value), min(self.high, f.value)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
                elif isinstance(f, In):
                    own = {v for v in f.value if v is not None}
                    self.some = own if self.some is None else self.some & own
            yield f

    def partitions(self) -> list[InputPartition]:
        def wanted(path: str) -> bool:
            span = years_of(path)
            if span is None:
                return True
            a, b = span
            return a <= self.high and b >= self.low and (self.some is None or any(a <= y <= b for y in self.some))

        return [File(f) for f in self.all if wanted(f)]

    def read(self, partition: File | None):
        import pyarrow.parquet as pq

        if partition is not None:  # None: there is no file to read
            yield from pq.ParquetFile(partition.path).iter_batches(columns=self.schema.names)


@contextmanager
def pushed_down(spark):
    """Within, Spark offers filters to data sources in Python; its own setting comes back."""
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
