"""A corpus from raw documents to tokens: five stages, each written and read again.

Every stage takes (session, documents, folder of the tables), works on all documents that the
one before has kept, and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm import byte_bpe, decontaminate, ngram_jaccard, quality_rules, secret_scan
from sessionlake.llm.common import beside, restored, table
from sessionlake.session import freeze


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    named = beside(docs, text=F.col("text"))
    judged = quality_rules.judge_quality(named, drop=("text",))
    return judged.where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words, at 0.8 or more, that with the smallest id stays."""
    return ngram_jaccard.keep_one(docs, n=5, num=4, den=5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item in them go."""
    return decontaminate.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them become ``[SECRET]``, and ``n_chars`` is counted anew there."""
    rows = beside(docs, doc_id=F.col("doc_id"), text=F.col("text"))
    found = secret_scan.findings(rows, secret_scan.scan_secrets(rows))
    clean = secret_scan.redacted(F.col("text"), F.col("spans"))
    hit = F.size("spans") > 0
    columns = {"text": clean, "n_chars": F.when(hit, F.length(clean).cast("long")).otherwise(F.col("row.n_chars"))}
    changed = found.select("row", *(c.alias(n) for n, c in columns.items()))
    return restored(changed, *columns).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("packed") / 4).cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("byte_bpe", encoded),
]

#: Merging byte pairs by rank is beyond SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
