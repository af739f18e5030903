"""Session settings and tables written to the folder that all executors share."""

from __future__ import annotations

import io
import tempfile
import uuid
import weakref
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "lodestone", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and small runs; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of every executor, once an application, so that it need not be installed there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, f"{root.name}/{file.relative_to(root)}")
    # only the driver reads this file; executors fetch it from the driver
    path = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    path.write_bytes(packed.getvalue())
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)


def shipped(query):
    """A query (spark, folder) that first sends the package to the workers."""

    @wraps(query)
    def run(spark: SparkSession, folder: str):
        ship(spark)
        return query(spark, folder)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset (as in tests), an own one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back.

    This cuts the lineage and survives the loss of an executor; the rows are stored once, compressed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(table)] = weakref.ref(table), path
    return table


_WRITTEN: dict[int, tuple] = {}


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, once all that is computed from them is written itself; others are left alone."""
    for table in tables:
        found, path = _WRITTEN.pop(id(table), (lambda: None, None))
        if found() is table:
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def prefer_hash_joins(spark: SparkSession) -> None:
    """Let adaptive execution hash instead of sort wherever every partition of the built side proves to be small."""
    if spark.conf.get("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold") in ("0", "0b"):
        spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "32m")


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; counts no further than one row beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows
