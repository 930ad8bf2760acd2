"""Writers. Each writes from the executors and returns what it wrote, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

from sessionlake.sources.readers import read_headed


def _move(spark: SparkSession, source: str, target: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.rename(path(source), path(target)):
        raise OSError(f"cannot move {source} to {target}")


def _exists(spark: SparkSession, name: str, delete: bool = False) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.delete(path, True) if delete else files.exists(path)


def replace(spark: SparkSession, writer: DataFrameWriter, fmt: str, path: str) -> None:
    """Writes beside ``path``, and only when all is written puts it in the place of what was there.

    A write that fails leaves the earlier result as it was. Between two renames there is none
    under ``path`` for a moment; should the second fail, the earlier one is put back.
    """
    mark = uuid.uuid4().hex
    place = path.rstrip("/")
    new, old = f"{place}.new-{mark}", f"{place}.old-{mark}"
    try:
        writer.format(fmt).save(new)
        held = _exists(spark, place)
        if held:
            _move(spark, place, old)
        try:
            _move(spark, new, place)
        except Exception:
            if held:
                _move(spark, old, place)
            raise
        if held:
            _exists(spark, old, delete=True)
    finally:
        _exists(spark, new, delete=True)


def write_summary(summary: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """The one-row result as Parquet, or as CSV with a header; replaces earlier output
    once it is written."""
    if fmt not in ("parquet", "csv"):
        raise ValueError("fmt must be parquet or csv")
    options = {"header": "true"} if fmt == "csv" else {}
    replace(summary.sparkSession, summary.write.options(**options), fmt, path)
    return summary.sparkSession.read.schema(summary.schema).options(**options).format(fmt).load(path)


def write_sample(plays: DataFrame, path: str) -> DataFrame:
    """Plays as a folder of TSV files with headers; replaces earlier output once it is written.

    Comes back as text, as the play log itself does.
    """
    replace(plays.sparkSession, plays.write.options(sep="\t", header=True), "csv", path)
    return read_headed(plays.sparkSession, path)
