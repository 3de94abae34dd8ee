"""Results on disk: writing by period, compaction, manifests and lineage."""

from __future__ import annotations

import uuid
import warnings

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.functions.names import output_name
from gridloom.functions.scratch import cut, discard, partitions, shared_folder, small
from gridloom.operators.ranks import hot_keys, parted


#: Bytes of one value, by type; texts are measured.
WIDTH = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "date": 4, "float": 4}
PERIODS = ("year", "month", "day")
#: Bytes of values that a task sorts and writes; rows in memory have several times as many.
TASK_BYTES = 128 << 20


def row_bytes(df: DataFrame) -> tuple[int, float]:
    """(rows, bytes of a row): fixed widths, and the mean length of texts."""
    texts = [c for c, t in df.dtypes if t == "string"]
    told = df.agg(F.count("*").alias("n"), *[F.avg(F.octet_length(c)).alias(f"l{k}") for k, c in enumerate(texts)]).first()
    return told["n"], sum(WIDTH.get(t, 8) for _, t in df.dtypes if t != "string") + sum(told[f"l{k}"] or 0 for k in range(len(texts)))


def _dealt(rows: DataFrame, n: int, width: float, most_bytes: int, *by: str) -> DataFrameWriter:
    """A writer of rows in order, dealt to tasks by ranges of ``TASK_BYTES`` of values; no file holds more than ``most_bytes``."""
    tasks = int(max(1, min(n, -(-n * width // TASK_BYTES))))
    return rows.repartitionByRange(tasks, *by).sortWithinPartitions(*by).write.option("maxRecordsPerFile", max(1, int(most_bytes // max(1, width))))


def write_by_period(cells: DataFrame, path: str, period: str = "year", most_bytes: int = 2 << 30, time: str = "time") -> None:
    """A folder a year (and month, and day), rows in it sorted by time; no file holds more than ``most_bytes`` of
    values.  Tasks take ranges of time of a size of their own, so a period with very many rows is dealt to several."""
    if period not in PERIODS:
        raise ValueError(f"unknown period {period}; known: {', '.join(PERIODS)}")
    parts = list(PERIODS[: PERIODS.index(period) + 1])
    held = cut(cells, "to-write")  # counted, sampled for the ranges and written: made once
    rows = held.withColumns({p: f(time) for p, f in zip(parts, (F.year, F.month, F.dayofmonth), strict=False)})
    _dealt(rows, *row_bytes(held), most_bytes, *parts, time).partitionBy(*parts).mode("overwrite").parquet(path)
    discard(held)


def write_by_year(cells: DataFrame, path: str, most_bytes: int = 2 << 30) -> None:
    write_by_period(cells, path, "year", most_bytes)


def write_named(cells: DataFrame, path: str, done: str | None = None, period: str | None = "year", most_bytes: int = 2 << 30) -> None:
    """A folder ``output=<name>`` for each dataset and period (None: the whole time), named by facets, first and last day
    and what was ``done``; no file holds more than ``most_bytes`` of values.  One period may be dealt to several tasks."""
    part = F.lit("") if period is None else F.date_trunc(period, "time").cast("string")
    held = cut(cells, "to-write")
    rows = held.withColumn("_part", part)
    spans = rows.groupBy("dataset_id", "_part").agg(F.min("time").alias("_a"), F.max("time").alias("_b"))
    named = spans.select("dataset_id", "_part", output_name(F.col("dataset_id"), F.col("_a"), F.col("_b"), done).alias("output"))
    rows = rows.join(small(named), ["dataset_id", "_part"]).drop("_part")
    _dealt(rows, *row_bytes(held), most_bytes, "output", "time").partitionBy("output").mode("errorifexists").parquet(path)
    discard(held)


def files_of(df: DataFrame, *keep: str) -> DataFrame:
    """(path, size, rows) of the files behind a table that was read, with ``keep`` columns that are the same all
    over a file."""
    return df.groupBy(F.col("_metadata.file_path").alias("path"), *keep).agg(F.first(F.col("_metadata.file_size")).alias("size"), F.count("*").alias("rows"))


def manifest(outputs: DataFrame) -> DataFrame:
    """dataset_id, path, size of the outputs that count: local files that exist (have a size) and https
    addresses, whose size is 0."""
    url = F.col("path").rlike("^https?://")
    return outputs.filter(F.col("path").startswith("https://") | (~url & F.col("size").isNotNull())).select("dataset_id", "path", F.when(url, F.lit(0)).otherwise(F.col("size")).cast("long").alias("size"))


def manifest_urls(xml: DataFrame, column: str = "xml") -> DataFrame:
    """Texts of every ``metaurl`` element, without a ``file://`` prefix."""
    return xml.select(F.explode(F.expr(f"xpath({column}, \"//*[local-name()='metaurl']/text()\")")).alias("url")).select(F.regexp_replace("url", "^file://", "").alias("url"))


def compaction(files: DataFrame, target: int, key: str = "ds_id", order: str = "path", size: str = "size") -> DataFrame:
    """Group number of each file: in order, a file joins the group before it while the group's size
    stays within ``target``.  Sizes below one byte count as one.

    The files of a dataset pass through one task in order, which holds the last group's number and size only; those
    of a dataset with more files than a task's share are dealt to several tasks, by ranges of the order."""
    sized = files.select(key, order, F.greatest(F.lit(1), F.coalesce(F.col(size), F.lit(1))).cast("long").alias(size))
    hot = hot_keys(sized, [key])
    if hot is None:
        return grouped_in_order(sized, target, key, order, size)
    large, others = parted(sized, [key], hot)
    return grouped_by_ranges(large, target, key, order, size).unionByName(grouped_in_order(others, target, key, order, size))


def grouped_in_order(sized: DataFrame, target: int, key: str, order: str, size: str) -> DataFrame:
    rows = sized.repartition(key).sortWithinPartitions(key, order, size)
    return _walked(rows.withColumns({"_group": F.lit(-1).cast("long"), "_total": F.lit(None).cast("long")}), target, key, order, size)


def _walked(rows: DataFrame, target: int, key: str, order: str, size: str, *part: str) -> DataFrame:
    """Group numbers of rows in order, task by task.  ``_group`` and ``_total``: the number and size of the group before
    the first row of a (key, *part) (-1 and null before a key's first row)."""

    def run(batches):
        last, group, total = (), -1, None
        for batch in batches:
            numbers = []
            for k, s, g, t, *p in zip(*(batch.column(c).to_pylist() for c in (0, *range(2, batch.num_columns))), strict=True):
                if last != (k, *p):
                    last, group, total = (k, *p), g, t
                if total is not None and total + s <= target:
                    total += s
                else:
                    group, total = group + 1, s
                numbers.append(group)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(numbers, pa.int32())], names=[key, order, size, "group_no"])

    types = dict(rows.dtypes)
    return rows.select(key, order, size, "_group", "_total", *part).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in (key, order, size)) + ", group_no int")


#: Files of a dataset whose way through the groups is worked out at a time.
STRETCH = 1 << 16


def grouped_by_ranges(sized: DataFrame, target: int, key: str, order: str, size: str) -> DataFrame:
    """The same without any task that holds a dataset.  Rows are dealt by ranges of (key, order).  What a range makes
    of the group that was open before it depends on that group's size alone, and only by the file at which it closes:
    from there on groups are fixed.  So each stretch of a range tells, for each file that can be the first to start a
    group (a group's worth of files at most), how many groups follow and the size of the last one.  These
    rows, few beside the files, are walked in order once a dataset, and then each range knows where it starts.
    Files move twice, however many groups there are."""
    by = [key, order, size]
    dealt = cut(sized.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    # A range holds more than one key at its ends only; all of a (range, key) are in one task, in order.
    placed = lambda df: df.repartition("_range", key).sortWithinPartitions("_range", *by)
    ways = cut(_ways(placed(dealt), target, key, size), "ways")
    entries = cut(_entries(ways.repartition(key).sortWithinPartitions(key, "_range", "_stretch", "_least"), key), "entries")
    met = dealt.alias("d").join(F.broadcast(entries).alias("e"), [F.col(f"d.{key}").eqNullSafe(F.col(f"e.{key}")), F.col("d._range") == F.col("e._range")])
    return _walked(placed(met.select("d.*", "_group", "_total")), target, key, order, size, "_range")


def _ways(rows: DataFrame, target: int, key: str, size: str) -> DataFrame:
    """(key, _range, _stretch, _least, _count, _last): a stretch that is met with an open group of ``_least`` bytes, or more
    up to the next row's, starts ``_count`` groups, the last of which has ``_last`` bytes; without any, these are added."""

    def told(name, sizes):
        before = np.concatenate([[0], np.cumsum(np.asarray(sizes, "int64"))])
        n = len(sizes)
        # The file at which the next group starts if one starts here.
        following = np.maximum(np.searchsorted(before, before[:-1] + target, "right") - 1, np.arange(1, n + 1)).tolist()
        count, end = [0] * (n + 1), [n] * (n + 1)
        for j in range(n - 1, -1, -1):
            count[j] = count[following[j]] + 1
            end[j] = j if following[j] == n else end[following[j]]
        # Which file starts the first group: the first one always may, a later one if a group of one byte can reach it.
        m = int(np.searchsorted(before, target - 1, "right")) - 1
        first = list(range(max(0, min(m, n - 1)) + 1))
        least = [max(0, target - int(before[j + 1]) + 1) for j in first]
        rows = [(lo, count[j], int(before[n] - before[end[j]])) for j, lo in zip(first, least, strict=True)]
        if before[n] < target:
            rows.append((0, 0, int(before[n])))
        # Neighbours that come to the same are one.
        rows = rows[::-1]
        kept = [r for k, r in enumerate(rows) if not k or r[1:] != rows[k - 1][1:]]
        return [(*name, *r) for r in kept]

    def run(batches):
        last, stretch, sizes, out = None, 0, [], []
        for batch in batches:
            for name in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if sizes and (name[:2] != last or len(sizes) == STRETCH):
                    out += told((*last, stretch), sizes)
                    stretch, sizes = (stretch + 1 if name[:2] == last else 0), []
                last = name[:2]
                sizes.append(name[2])
                if len(out) >= 10_000:
                    yield made(out)
                    out = []
        if sizes:
            out += told((*last, stretch), sizes)
        if out:
            yield made(out)

    names = [key, "_range", "_stretch", "_least", "_count", "_last"]
    kinds = to_arrow_schema(rows.select(key).schema).field(0).type, pa.int32(), *[pa.int64()] * 4
    made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    types = dict(rows.dtypes)
    return rows.select(key, "_range", size).mapInArrow(run, f"`{key}` {types[key]}, _range int, _stretch long, _least long, _count long, _last long")


def _entries(ways: DataFrame, key: str) -> DataFrame:
    """(key, _range, _group, _total): the group that is open before each range of a key."""

    def run(batches):
        at, stretch, group, total, way = None, None, -1, None, None
        for batch in batches:
            out = []
            for k, r, c, least, count, size in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if at is None or (k, r, c) != (*at, stretch):
                    if way is not None:
                        group, total = group + way[0], way[1] if way[0] else total + way[1]
                    if at is None or k != at[0]:
                        group, total = -1, None
                    if (k, r) != at:
                        out.append((k, r, group, total))
                    at, stretch, way = (k, r), c, (count, size)
                elif total is None or least <= total:
                    way = count, size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64()), strict=True)], names=[key, "_range", "_group", "_total"])

    types = dict(ways.dtypes)
    return ways.mapInArrow(run, f"`{key}` {types[key]}, _range int, _group long, _total long")


def compact(spark: SparkSession, source: str, plan: DataFrame, out: str, key: str, order: str = "time", target: int = 2 << 30) -> DataFrame:
    """Merge the files below ``source`` by the groups of ``plan`` (from ``compaction``), each in time order and whole
    in one task, to new files below ``out``, of about ``target`` bytes a task.  ``out`` must not exist yet; it
    appears with all its files at once.  The inputs stay; if Spark can't write, they are the result, with a warning, and
    what was written so far goes."""
    rows = spark.read.parquet(source)
    at = lambda path: spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(at(out)):
        raise FileExistsError(out)
    staged = f"{out.rstrip('/')}.staged-{uuid.uuid4().hex}"
    try:
        groups = plan.select(F.col("path").alias("_path"), "group_no")
        total = plan.agg(F.sum("size")).first()[0] or 0
        tasks = max(1, -(-total // target))
        merged = rows.withColumn("_from", F.col("_metadata.file_path")).join(groups, F.col("_from") == F.col("_path")).drop("_from", "_path")
        merged.repartitionByRange(tasks, key, "group_no").sortWithinPartitions(key, "group_no", order).write.partitionBy(key, "group_no").mode("errorifexists").parquet(staged)
    except PySparkException as why:
        files.delete(at(staged), True)
        warnings.warn(f"{source} was not merged, the inputs are the result: {str(why)[:200]}", stacklevel=2)
        return rows
    if files.exists(at(out)) or not files.rename(at(staged), at(out)):
        files.delete(at(staged), True)
        raise FileExistsError(out)
    return spark.read.parquet(out)


def upstream(derived: DataFrame) -> DataFrame:
    """(entity, ancestor, distance) of everything that each entity was made from, over any number of steps, from rows
    (entity, source); distance is the least number of steps.

    Pointers are doubled: after a round all pairs up to twice the distance are known.  A pair beyond has a middle at
    exactly the last round's distance, so only those pairs are met with the known ones.  There are as many rounds as the
    greatest distance has binary digits.  An entity on a cycle is no ancestor of itself, and a cycle ends the search
    as any other path does: it brings nothing new.

    The known pairs are a table in buckets of entities, to which a round appends what is new: they are never moved
    again, only the pairs at the last round's distance and what they meet are."""
    spark = derived.sparkSession
    pairs = derived.select(F.col("entity").cast("string").alias("entity"), F.col("source").cast("string").alias("ancestor"))
    name, path, buckets = f"lineage_{uuid.uuid4().hex}", f"{shared_folder(spark)}/gridloom/lineage-{uuid.uuid4().hex}", partitions(spark)
    # All is dealt by entity, as the table is, so a task writes one bucket.
    first = pairs.filter("entity is not null and ancestor is not null and entity <> ancestor").repartition(buckets, "entity").distinct().withColumn("distance", F.lit(1).cast("long"))
    append = lambda rows: rows.write.format("parquet").mode("append").bucketBy(buckets, "entity").option("path", path).saveAsTable(name)
    try:
        append(first)
        reach = 1
        while (half := (known := spark.table(name)).filter(F.col("distance") == reach)).limit(1).count():
            rest = known.select(F.col("entity").alias("middle"), F.col("ancestor").alias("far"), F.col("distance").alias("more"))
            met = half.join(rest.hint("merge"), F.col("ancestor") == F.col("middle")).filter("entity <> far").select("entity", F.col("far").alias("ancestor"), (F.col("more") + reach).alias("distance"))
            # In one place by entity, so a grouping of both moves the known no more; what is known has a lesser distance.
            both = known.unionByName(met.repartition(buckets, "entity")).groupBy("entity", "ancestor").agg(F.min("distance").alias("distance"))
            append(both.filter(F.col("distance") > reach))
            reach *= 2
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # the name alone; the files are the result
    return spark.read.schema(first.schema).parquet(path)


def derivations(steps: DataFrame) -> DataFrame:
    """(entity, source): each step's first output from its first input, of rows as ``lineage`` takes them."""
    return steps.select(F.get("outputs", F.lit(0)).alias("entity"), F.get("inputs", F.lit(0)).alias("source"))


def _edge(kind: str, subject: Column, to: Column) -> Column:
    return F.struct(F.lit(kind).alias("edge"), subject.cast("string").alias("subject"), to.cast("string").alias("object"))


def _edges(rows: DataFrame, told: list[Column], *of: str) -> DataFrame:
    """The edges that each row tells of, from one pass over the rows.  Without ``_outer`` the optimizer would have them
    made once more below, to see that there are any."""
    return rows.select(*of, F.array(*told).alias("told")).select(*of, F.explode_outer("told").alias("e")).select(*of, "e.*").filter("subject is not null and object is not null")


def lineage_runs(runs: DataFrame, service: str, version: str) -> DataFrame:
    """Edges of whole runs from rows (run, workflow, agent, start, end): the run is an activity of the service, asked
    for by an agent; it used the workflow, which is an entity; and it started and ended."""
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    told = [
        _edge("associated", F.col("run"), F.lit(f"{service} {version}")),
        _edge("on_behalf_of", F.lit(f"{service} {version}"), F.col("agent")),
        _edge("used", F.col("run"), F.col("workflow")),
        _edge("started", F.col("run"), at("start")),
        _edge("ended", F.col("run"), at("end")),
    ]
    return _edges(runs, told, "run")


def lineage(steps: DataFrame) -> DataFrame:
    """Edges of one run from rows (run, step, operator, inputs, outputs, parameters): each step used its
    first input and made its first output; the run is an activity of the service."""
    parameters = F.concat_ws(";", F.array_sort(F.transform(F.map_entries("parameters"), lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], ",")))))
    told = [
        _edge("used", F.col("operator"), F.get("inputs", F.lit(0))),
        _edge("generated", F.get("outputs", F.lit(0)), F.col("operator")),
        _edge("parameters", F.col("operator"), parameters),
    ]
    return _edges(steps, told, "run", "step")
