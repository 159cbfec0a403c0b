"""Tables in the folder that the driver and all executors share, their removal, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_scopes = threading.local()
_shipped: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, whose Python workers import it; once for a context."""
    sc = spark.sparkContext
    if sc in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(), f"{top.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    sc.addPyFile(path)
    _shipped.add(sc)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only in local mode."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"kausal-checkpoints-{os.getuid()}")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def _open() -> list[list[str]]:
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    return _scopes.open


def new_path(spark: SparkSession, kind: str, keep: bool = False) -> str:
    """A path that is not in use; it goes at the end of the innermost temporary() block, or with keep of the one around it."""
    path = f"{shared_dir(spark)}/kausal-{kind}-{uuid.uuid4().hex}"
    _written.append(path)
    depth = len(_open()) - (2 if keep else 1)
    if depth >= 0:
        _open()[depth].append(path)
    return path


def cut(df: DataFrame, kind: str = "cut", keep: bool = False) -> DataFrame:
    """Ends the lineage of df: a Parquet table in the shared folder, which outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, kind, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _written:
        _written.remove(path)


def move_single(spark: SparkSession, folder: str, path: str) -> None:
    """Makes the only part file of a written folder the file path, in place of another of that name."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    to, conf = hadoop.Path(path), spark.sparkContext._jsc.hadoopConfiguration()
    part = next(s.getPath() for s in hadoop.Path(folder).getFileSystem(conf).listStatus(hadoop.Path(folder)) if s.getPath().getName().startswith("part-"))
    to.getFileSystem(conf).delete(to, True)
    hadoop.FileUtil.copy(part.getFileSystem(conf), part, to.getFileSystem(conf), to, False, conf)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go at the end, but for those written with keep=True."""
    _open().append([])
    try:
        yield
    finally:
        for path in _open().pop():
            _delete(spark, path)


def release(spark: SparkSession) -> int:
    """Deletes all tables that this process has written here and that are still there; results that read them, and have
    not been stored elsewhere, can't be read any more. Returns how many went."""
    paths = list(_written)
    for path in paths:
        _delete(spark, path)
    return len(paths)
