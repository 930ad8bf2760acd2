"""Readers of the two input files. Both are text; every column is read as a string."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.functions.times import parse_play_time

# The play log's columns in file order, and the profile file's id column.
PLAY_COLUMNS = ["userid", "timestamp", "artistid", "artistname", "traid", "traname"]
PROFILE_ID = "#id"

# The column for the text of lines that do not have one field for each column.
MALFORMED = "_malformed"

PLAY_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in PLAY_COLUMNS])


def schema_from_json(spark: SparkSession, path: str) -> T.StructType:
    """A schema kept as a Spark JSON schema file."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    return T.StructType.fromJson(json.loads(text))


def read_play_log(
    spark: SparkSession,
    path: str,
    schema: T.StructType = PLAY_SCHEMA,
    quote: str = '"',
    malformed: str | None = None,
) -> DataFrame:
    """A TSV without header under a declared schema.

    A field that opens with ``quote`` runs to the next one, tabs included;
    ``quote=''`` takes quotes as text.

    A line with too few or too many fields gives a row all the same, with nulls or without the
    surplus. ``malformed`` names one more column, with the text of such lines and null for all
    others; a query that uses it parses all fields of a line.
    """
    if malformed is None:
        return spark.read.schema(schema).csv(path, sep="\t", header=False, quote=quote)
    wider = T.StructType([*schema.fields, T.StructField(malformed, T.StringType())])
    # A parser that skips fields does not notice how many there are.
    reader = spark.read.schema(wider).option("columnPruning", "false")
    return reader.csv(
        path, sep="\t", header=False, quote=quote, mode="PERMISSIVE", columnNameOfCorruptRecord=malformed
    )


def read_positional(
    spark: SparkSession, path: str, names: list[str] = PLAY_COLUMNS, quote: str = '"'
) -> DataFrame:
    """A TSV without header or schema; the columns are named by position.

    Spark takes the number of columns from the first line, so that line has to
    have as many fields as there are names.
    """
    return spark.read.csv(path, sep="\t", header=False, quote=quote).toDF(*names)


def read_headed(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """A TSV whose first line names the columns."""
    return spark.read.csv(path, sep="\t", header=True, quote=quote)


# Readers of the named datasets.
DATASETS = {"track_sessions": read_play_log, "userid_profiles": read_headed}


def load(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    """A dataset by its name; ``options`` go to its reader."""
    if name not in DATASETS:
        raise KeyError(f"no dataset {name!r}; known: {', '.join(DATASETS)}")
    return DATASETS[name](spark, path, **options)


def parse_plays(raw: DataFrame, ts: str = "timestamp") -> DataFrame:
    """The log with ``ts`` turned from text into a timestamp; null if malformed."""
    return raw.withColumn(ts, parse_play_time(F.col(ts)))
