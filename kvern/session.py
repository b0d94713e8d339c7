"""Sessions, intermediate tables that survive the loss of executors, and joins on hot keys."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", scratch: str | None = None) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("kvern")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    return (builder.config("spark.checkpoint.dir", scratch) if scratch else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only a local master, where driver and executors are one machine, gets a
    temporary folder when the setting is absent; a cluster without it is an error.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='kvern-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def ship_package(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once: as an archive in the shared folder, which Spark hands on."""
    sc = spark.sparkContext
    if getattr(sc, "_kvern_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("kvern", os.path.relpath(full, root)))
    path = f"{shared_dir(spark)}/kvern-{os.getpid()}-{uuid.uuid4().hex}.zip"
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(sc._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(held.getvalue()))
    out.close()
    sc.addPyFile(path)
    sc._kvern_shipped = True


_open: list[list[tuple[SparkSession, str]]] = []


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes with its scratch scope, or when the driver's Python ends."""
    path = f"{shared_dir(spark)}/kvern-{os.getpid()}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append((spark, path))
    else:
        atexit.register(_remove, spark, path)
    return path


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back.

    Cuts the lineage, makes nondeterministic columns stable, and gives the
    planner real sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kvern_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that materialize() wrote and nothing reads any more."""
    path = getattr(df, "_kvern_path", None)
    if path:
        _remove(df.sparkSession, path)


@contextmanager
def scratch() -> Iterator[None]:
    """All tables written inside are removed at the end; results must have been consumed by then."""
    _open.append([])
    try:
        yield
    finally:
        for spark, path in _open.pop():
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended first
        pass


#: A key with at least this part of all rows is joined without a shuffle of its rows, so there are at most 1 / HOT of them.
HOT = 1 / 500


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, weight: str) -> DataFrame:
    """rows inner-joined with keyed, which has one row per key and in `weight` the number of its rows.

    The rows of hot keys (at most 1 / HOT keys by definition, whatever the data) meet a broadcast table and stay where they
    are; all others are shuffled by key.
    """
    total = keyed.agg(F.sum(weight).alias("_total"))
    hot = keyed.crossJoin(F.broadcast(total)).where(F.col(weight) >= F.col("_total") * HOT).drop("_total", weight)
    marked = rows.join(F.broadcast(hot.select(key, F.struct(*[c for c in hot.columns if c != key]).alias("_hot"))), key, "left")
    others = [c for c in hot.columns if c != key]
    at_once = marked.where("_hot is not null").select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in others])
    rest = marked.where("_hot is null").drop("_hot").join(keyed.drop(weight), key).select(*rows.columns, *others)
    return at_once.union(rest)
