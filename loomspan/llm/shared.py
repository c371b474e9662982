"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm import text_batches

#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20
_own: dict[str, str] = {}
_kept: dict[str, DataFrame] = {}


def folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, one of this process's own (for tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="loomspan-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
            spark.sparkContext.setCheckpointDir(_own[app])
        found = _own[app]
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once to the shared folder and read from there: its lineage ends at the files."""
    path = f"{folder(df.sparkSession)}/loomspan/{name}-{uuid.uuid4().hex}"
    if not _kept:
        atexit.register(_tidy)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path
    _kept[path] = back
    return back


def _tidy() -> None:
    """At the end of the process its tables go, as far as Spark still runs."""
    with contextlib.suppress(Exception):
        dropped(*list(_kept.values()))


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing needs any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _kept.pop(df.written_to, None)


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _rows_of_files(docs: DataFrame) -> bool:
    """Whether ``docs`` has each row of its Parquet files once at most, picked by nothing but the row itself."""
    plan = docs._jdf.queryExecution().analyzed()
    if "_metadata" in docs.columns or not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    if plan.nodeName() != "LogicalRelation":
        return False
    with contextlib.suppress(AnalysisException):
        docs.select("_metadata.file_path", "_metadata.row_index")
        return True
    return False


def row_ids(docs: DataFrame, name: str = "_rid") -> DataFrame:
    """``docs`` with a number for each row, which stays the row's however often and on whatever cores it is read.

    Rows of Parquet files have their file's number and their position in it; other rows are numbered once and written.
    A number taken anew in each scan would follow how the scan is split, and so the cores registered at the time.
    """
    if not _rows_of_files(docs):
        return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    paths = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())
    long = "_" * (1 + max(map(len, docs.columns)))  # no column has such a name
    path, file, row = f"{long}path", f"{long}file", f"{long}row"
    # Paths are URL-encoded, so none has a line break.
    files = docs.sparkSession.range(1).select(F.posexplode(F.split(F.lit("\n".join(paths)), "\n")).alias(file, path))
    placed = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != name), F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row))
    number = F.shiftleft(F.col(file).cast("long"), 40) + F.col(row)
    return placed.join(F.broadcast(files), path).select(*(number.alias(c) if c == name else F.col(f"`{c}`") for c in dict.fromkeys([*docs.columns, name])))


def free(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame) -> DataFrame:
    """``doc`` (a struct of all columns, so that none can clash with an operator's own) and ``_rid``, the row's number."""
    rid = free(docs, "_rid")
    return row_ids(docs, rid).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(rid).alias("_rid"))


def fields(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``docs`` out of ``doc``; ``changed`` ones from elsewhere."""
    return [(changed[c] if c in changed else F.col("doc").getField(c)).alias(c) for c in docs.columns]


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of the Arrow batches that Python workers get, where the session doesn't: rows may be long."""
    for name in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxBytesPerOutputBatch"):
        if spark.sparkContext.getConf().get(name) is None:
            spark.conf.set(name, str(BATCH_BYTES))


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded size, by workers that return the memory they don't need."""
    small_batches(df.sparkSession)
    return df.mapInArrow(text_batches.tidy(run), schema)


def running(df: DataFrame, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """``df`` with the sum of each total over all rows that come before in ``order``, 0 for the first.

    Rows are range-partitioned and written; each range is summed by itself, and what the ranges before it hold
    (one row for each range, broadcast) is added.
    """
    ranges = written(df.withColumns(totals).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = ranges.groupBy("_part").agg(*(F.sum(k).alias(k) for k in totals))
    offsets = held.select("_part", *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_0{k}") for k in totals))
    above = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = {k: F.col(f"_0{k}") + F.coalesce(F.sum(k).over(above), F.lit(0)) for k in totals}
    return ranges.join(F.broadcast(offsets), "_part").withColumns(summed).drop("_part", *(f"_0{k}" for k in totals))


def hash128(*parts: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes."""
    return F.xxhash64(F.lit(11), *parts), F.xxhash64(F.lit(29), *parts)
