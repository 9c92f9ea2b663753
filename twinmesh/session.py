"""Where intermediate tables go.

Iterative operators cut their lineage by writing Parquet tables into the folder that
``spark.checkpoint.dir`` names: all executors share it, so a lost executor costs a task, not data.
"""

from __future__ import annotations

import atexit
import hashlib
import io
import itertools
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local master gets a temporary
    folder (tests); a cluster without the setting is an error, since executors couldn't share one."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="twinmesh-"))
    return sc.getCheckpointDir().rstrip("/")


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once per application, so that they needn't have
    it on their path: as an archive in the shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_twinmesh_shipped", False):
        return
    package, buffer = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    data = buffer.getvalue()
    target = f"{shared_folder(spark)}/twinmesh-{hashlib.sha256(data).hexdigest()[:16]}-{uuid.uuid4().hex[:8]}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(target)
    stream = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    sc.addPyFile(target)
    sc._twinmesh_shipped = True


def _remove(spark: SparkSession, root: str) -> None:
    """Deletes a folder, unless its application has ended already."""
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001
        pass


class Scratch:
    """Written tables of one operator run; ``store`` cuts lineage, ``drop`` removes a table early. What is left is
    deleted when the application ends, since a query's result may read it until then."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.numbers = itertools.count()  # of one thread or several
        atexit.register(_remove, spark, self.root)

    def store(self, df: DataFrame, name: str = "t", partition_by: list[str] | None = None, options: dict | None = None) -> DataFrame:
        """Writes df, in folders by the columns of partition_by, and returns it as read back, with the
        same schema."""
        path = f"{self.root}/{next(self.numbers):03d}-{name}"
        df.write.mode("overwrite").options(**(options or {})).parquet(path, partitionBy=partition_by)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._twinmesh_path = path
        return out

    def files(self, df: DataFrame) -> list[str]:
        """The files of a stored table, by name: one for each task that wrote rows."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._twinmesh_path)
        listed = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
        return sorted(f.getPath().toString() for f in listed if f.getPath().getName().startswith("part-"))

    def drop(self, *dfs: DataFrame) -> None:
        """Deletes stored tables that no later plan reads."""
        for df in dfs:
            path = getattr(df, "_twinmesh_path", None)
            if path:
                jvm = self.spark.sparkContext._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
