"""Session helpers: settings, checkpoints and shipping this package to executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="loomspan-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "loomspan.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)


_cuts: dict[str, DataFrame] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which the cluster shares; a folder of this process's own where none is set, in local mode."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomspan-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        context.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read from there: its lineage ends, and scans of it prune columns and push filters."""
    path = f"{folder(df.sparkSession)}/loomspan/cut-{uuid.uuid4().hex}"
    if not _cuts:
        atexit.register(_tidy)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _cuts[path] = back
    back.cut_to = path
    return back


def dropped(*tables: DataFrame | None) -> None:
    """Delete what ``cut`` wrote, where nothing needs it any more; other tables are left alone."""
    for df in tables:
        if path := getattr(df, "cut_to", None):
            place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            _cuts.pop(path, None)


def _tidy() -> None:
    with contextlib.suppress(Exception):
        dropped(*list(_cuts.values()))


#: Rows and bytes up to which a lookup table may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def lookup(df: DataFrame) -> DataFrame:
    """A lookup table marked for broadcast if its measured rows and bytes allow that; otherwise left to a shuffled join."""
    size = F.lit(0)
    for f in df.schema.fields:
        size = size + (F.coalesce(F.length(F.col(f"`{f.name}`")), F.lit(0)) + 16 if f.dataType.simpleString() in ("string", "binary") else F.lit(16))
    found = df.limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= BROADCAST_ROWS and (found["bytes"] or 0) <= BROADCAST_BYTES else df
