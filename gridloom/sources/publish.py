"""Results that appear all at once: rows are staged in a folder of their own, and a numbered manifest makes them
the table's next version.

Below a table's path lie ``data/<run>-<random>`` (the rows of one write) and ``versions/<number>.json``.  A version's
number is claimed by a file that only one writer can create; then its manifest is renamed into place, so readers see
a whole manifest or none.  A writer that dies leaves rows that no manifest names, or a claim without a manifest;
neither is ever read, ``sweep`` deletes the former, and a claim that is older than ``patience`` no longer counts.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has made the version that was to follow the base."""


class _Store:
    """The few calls on Hadoop's file system that a table needs."""

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table = spark, table.rstrip("/")
        self.files = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.table}/{name}" if name else self.table)

    def names(self, folder: str) -> list[tuple[str, float]]:
        """(name, seconds since it was changed) of what lies in a folder."""
        if not self.files.exists(self.path(folder)):
            return []
        return [(s.getPath().getName(), time.time() - s.getModificationTime() / 1000) for s in self.files.listStatus(self.path(folder))]

    def delete(self, name: str) -> None:
        self.files.delete(self.path(name), True)

    def write(self, name: str, text: str) -> None:
        out = self.files.create(self.path(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> dict:
        stream = self.files.open(self.path(name))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def claim(self, name: str) -> bool:
        """Create a file, unless it is there; one of several writers succeeds."""
        self.files.mkdirs(self.path("versions"))
        try:
            if self.files.getUri().getScheme() == "file":  # Hadoop's local create looks first and then writes
                self.spark._jvm.java.nio.file.Files.createFile(self.spark._jvm.java.io.File(self.path(name).toUri().getPath()).toPath(), self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.nio.file.attribute.FileAttribute, 0))
            else:
                self.files.create(self.path(name), False).close()
        except Exception as why:  # py4j wraps whatever the file system says
            if "AlreadyExists" in str(why) or "already exists" in str(why):
                return False
            raise
        return True


def versions(spark: SparkSession, table: str) -> list[int]:
    return sorted(int(n[:-5]) for n, _ in _Store(spark, table).names("versions") if n.endswith(".json") and not n.startswith("."))


def manifest_of(spark: SparkSession, table: str, version: int) -> dict:
    return _Store(spark, table).read(f"versions/{version:09d}.json")


def publish(df: DataFrame, table: str, run: str, base: int | None = None, partition_by: Sequence[str] = (), patience: float = 3600) -> int:
    """Write ``df`` as the next version of a table and return its number.  A ``run`` that was published before is not
    written again: its version is returned.  With a ``base`` (0: no version yet) the new one must be the first to
    follow it; else ``Conflict``, and nothing of this write stays."""
    spark = df.sparkSession
    store = _Store(spark, table)
    for v in reversed(versions(spark, table)):
        if manifest_of(spark, table, v)["run"] == run:
            return v
    data = f"data/{run}-{uuid.uuid4().hex}"
    try:
        df.write.partitionBy(*partition_by).mode("errorifexists").parquet(f"{store.table}/{data}")
        told = spark.read.parquet(f"{store.table}/{data}").agg(F.count("*").alias("rows")).first()
        number = base + 1 if base is not None else None
        while True:
            known = versions(spark, table)
            claims = {int(n[:-6]): age for n, age in store.names("versions") if n.endswith(".claim")}
            at = number or max([0, *known, *claims]) + 1
            if number and (known[-1:] or [0]) != [base]:
                raise Conflict(f"{table} is at version {known[-1] if known else 0}, not {base}")
            if at in claims and at not in known and claims[at] > patience:
                store.delete(f"versions/{at:09d}.claim")
            if store.claim(f"versions/{at:09d}.claim"):
                break
            if number:
                raise Conflict(f"version {at} of {table} is being made by another writer")
        waiting = f"versions/.{uuid.uuid4().hex}.json"
        store.write(waiting, json.dumps({"version": at, "run": run, "folder": data, "rows": told["rows"]}))
        if not store.files.rename(store.path(waiting), store.path(f"versions/{at:09d}.json")):
            raise OSError(f"version {at} of {table} could not be put in place")
        return at
    except BaseException:
        store.delete(data)
        raise


def read(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the latest by default."""
    known = versions(spark, table)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"{table}: no version {version or ''}")
    return spark.read.parquet(f"{table.rstrip('/')}/{manifest_of(spark, table, version or known[-1])['folder']}")


def sweep(spark: SparkSession, table: str, patience: float = 86_400) -> list[str]:
    """Delete, and return, folders of rows that no version names and that have not changed for ``patience`` seconds."""
    store = _Store(spark, table)
    named = {manifest_of(spark, table, v)["folder"] for v in versions(spark, table)}
    gone = [f"data/{n}" for n, age in store.names("data") if f"data/{n}" not in named and age >= patience]
    for folder in gone:
        store.delete(folder)
    return gone
