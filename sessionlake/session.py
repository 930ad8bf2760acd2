"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_SCRATCH = "sessionlake.scratch.dir"


def spark_session(app_name: str = "sessionlake", conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the library is written for.

    Times are shown in UTC. The results do not depend on the zone (parsing and
    arithmetic are zone-free), only how a timestamp prints does.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in ``spark.checkpoint.dir``.

    Only a local master may go without that setting; it then gets a folder of
    its own, once per session, which is removed when the program ends.
    """
    for key in ("spark.checkpoint.dir", _OWN_SCRATCH):
        named = spark.conf.get(key, None)
        if named:
            return named
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="sessionlake-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set(_OWN_SCRATCH, own)
    return own


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage and pins values that a recomputation could change, such as
    partition numbers. The files outlive lost executors, and, being Parquet,
    later steps still read only the columns they use.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "frozen")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
