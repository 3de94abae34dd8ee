"""Tables written half-way to the shared folder, checks of size, and joins that a hot key cannot stall."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that are ever broadcast by choice; beyond it joins shuffle.
BROADCAST_ROWS = 500_000

#: Rows that a task sorts for a join of two large tables (about 220 MB).  Fewer would make more tasks, and over 200 of them the
#: rows are sorted, and held, by the tasks that deal them out, too.
TASK_ROWS = 3 << 19

#: Of so many rows one is looked at for hot keys, and so many of these make a key hot.
ONE_OF, OFTEN = 1024, 128

#: Folders of applications in local mode that name none.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, or, where that is unset,
    a temporary folder in local mode and the warehouse on a cluster.  The session stays as it is."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found and not (context.master == "local" or context.master.startswith("local[")):
        found = spark.conf.get("spark.sql.warehouse.dir")
    if not found:
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        found = _LOCAL[context.applicationId]
    return found.rstrip("/")


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here, so a
    lost executor costs only the tasks it ran, and later readers prune columns."""
    path = f"{shared_folder(df.sparkSession)}/gridloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    for made in _SCRATCH:
        made.append(out)
    return out


_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def scratch(result: list[DataFrame]):
    """Deletes, at its end, what ``cut`` wrote inside, but for the tables in ``result``."""
    made: list[DataFrame] = []
    _SCRATCH.append(made)
    try:
        yield
    finally:
        _SCRATCH.pop()
        discard(*(x for x in made if not any(x is y for y in result)))


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_cut_path", None):
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
            df._cut_path = None


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``limit`` rows, else as it is
    (then the join shuffles both sides)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def join_split(df: DataFrame, counted: DataFrame, on: Column, key: Column, n: str, how: str = "inner") -> DataFrame:
    """``df`` joined with ``counted``, a table of keys and (column ``n``) how many rows of ``df`` have each.  Keys
    that have more than a quarter of what a task reads on average are broadcast: that many rows are had by fewer
    than four keys a task, whose bytes are at most those of as many mean rows.  The others are shuffled.  Both
    conditions are equalities; ``how`` is inner or left_semi."""
    total = counted.agg(F.sum(n)).first()[0] or 0
    most = total // (4 * partitions(df.sparkSession))
    hot, rest = F.broadcast(counted.filter(F.col(n) > most)), counted.filter(F.col(n) <= most)
    met = on == key
    return df.join(hot, met, how).unionByName(df.join(hot, met, "left_anti").join(rest, met, how))


def join_dealt(df: DataFrame, other: DataFrame, on: str, key: str) -> DataFrame:
    """``df`` joined with ``other`` where ``on`` equals ``key``; neither has a bound.  Both are dealt to so many tasks that
    each sorts ``TASK_ROWS`` rows on average, however large they are.  (Left to Spark, a table of few bytes on disk is
    broadcast, whatever its rows, and shares grow with the tables.)  Keys that a sample shows to have more than about
    ``ONE_OF * OFTEN`` rows of ``df`` are met where these rows are; all others move by their key."""
    df, other = df.filter(F.col(on).isNotNull()), other.filter(F.col(key).isNotNull())
    n = df.count() + other.count()
    tasks = max(partitions(df.sparkSession), -(-n // TASK_ROWS))
    dealt = lambda rows: rows.repartition(tasks, on).join(other.repartition(tasks, key).hint("merge"), F.col(on) == F.col(key))
    if n <= TASK_ROWS:
        return dealt(df)
    often = df.select(F.col(on).alias("_hot")).sample(1 / ONE_OF, seed=1).groupBy("_hot").agg(F.count("*").alias("_n")).filter(F.col("_n") >= OFTEN)
    hot = cut(often.select("_hot"), "hot-keys")
    if not hot.limit(1).count():
        return dealt(df)
    large, rest = (df.join(F.broadcast(hot), F.col(on) == F.col("_hot"), how) for how in ("left_semi", "left_anti"))
    theirs = small(other.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left_semi"))
    return large.join(theirs, F.col(on) == F.col(key)).unionByName(dealt(rest))
