"""Written tables in the folder that all executors share; they end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process wrote and nobody has deleted yet.
_LEFT: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder; a temporary one only for a local master that names none."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillstone-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that cleared() knows of."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _LEFT.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_path = path
    return back


def dropped(df: DataFrame) -> None:
    """Delete what written() left, once nothing reads it."""
    _delete(df.sparkSession, df.written_path)


def cleared(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the tables written since mark() gave ``since``, but for ``keep``; for when their readers are done."""
    for path in [p for p in _LEFT[since:] if keep is None or p != keep.written_path]:
        _delete(spark, path)


def mark() -> int:
    return len(_LEFT)


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
    if path in _LEFT:
        _LEFT.remove(path)
