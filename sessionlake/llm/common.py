"""What several operators share: words of a text, the given tables, null-safe keys."""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab,
#: form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; all other letters stay."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def beside(df: DataFrame, **needed: Column) -> DataFrame:
    """The rows of ``df`` as one column, ``row``, and what an operator needs next to it.

    No name in ``df`` can then clash with one that the operator uses.
    """
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(c.alias(n) for n, c in needed.items()))


def restored(df: DataFrame, *made: str) -> DataFrame:
    """The columns within ``row``, and the ``made`` ones, which replace columns of the same name."""
    names = {m.lower() for m in made}
    kept = [c for c in df.schema["row"].dataType.names if c.lower() not in names]
    return df.select(*(F.col(f"row.`{c}`") for c in kept), *made)


def best_rows(df: DataFrame, n: int, keys: list[str], order: list[Column], spread: Column) -> DataFrame:
    """The first ``n`` rows of each group, with ``rank`` from 1.

    Groups are taken apart by ``spread``, a hash, and put together again in rounds of 64 parts to one, so
    that no task gets more than 64 * ``n`` rows of a group after the first round.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 1:
        df = df.withColumn("_part", F.pmod(spread, F.lit(parts)))
        first = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = df.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n).drop("_part", "rank")
        parts = -(-parts // 64)
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n)


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    """The type in which Arrow hands the column to Python. Reads no data, and starts no worker."""
    return df.select(F.col(f"`{column}`").alias("c")).limit(0).toArrow().schema[0].type
