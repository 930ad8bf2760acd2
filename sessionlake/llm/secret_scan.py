"""Secret scans over a ledger of blobs.

Every version of every text is content-addressed by its SHA-256. The ledger holds, for
each blob and rule version scanned so far, the spans found. A scan takes only pairs of
blob and rule version that the ledger does not hold, one copy of each blob, and adds
them; findings are joined back to all rows by content address. Scanning new versions
later, or with changed rules, repeats no earlier work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.blocks import lean
from sessionlake.llm.common import beside, restored, text_of
from sessionlake.session import freeze

#: Of a private key: the label, then all up to the END line before the next label. Without one,
#: the encryption headers and lines of base64 that follow; line breaks may be escaped ones.
_BREAK = r"(?:\s|\\[rn])"
_PEM = (
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
    r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
    rf"|(?:{_BREAK}+(?:Proc-Type|DEK-Info):[^\n\\]*)*"
    rf"(?:(?:{_BREAK}+[A-Za-z0-9+/]{{20,}}={{0,2}})+(?:{_BREAK}+[A-Za-z0-9+/]{{1,19}}={{0,2}}(?=[\x20\t]*(?:[\r\n\\]|\Z)))?)?)"
)

#: kind: pattern, group that is measured, characters it needs. Matches are leftmost and do
#: not overlap within a kind; a match whose group is too short is dropped after matching.
#: Letters of the first pattern's words stand for either case. Fixed values.
RULES = {
    "assign": (
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "pem": (_PEM, 0, 1),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
}
RULE_VERSION = "1.1"

SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
LEDGER = f"blob string, rule_version string, spans {SPANS}"
FOUND = pa.list_(pa.struct({"start": pa.int32(), "rank": pa.int32(), "kind": pa.string(), "end": pa.int32()}))


def spans_in(text: str, rules: dict) -> list[dict]:
    """Spans of all kinds, by start, then kind as listed; code points, end exclusive."""
    found = []
    for rank, (kind, (pattern, group, least)) in enumerate(rules.items()):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append({"start": m.start(), "rank": rank, "kind": kind, "end": m.end()})
    return sorted(found, key=lambda s: (s["start"], s["rank"]))


def blob_id(text: str) -> Column:
    """A null text has the address of the empty one."""
    return F.sha2(text_of(text).cast("binary"), 256)


def scan_unseen(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    rules: dict | None = None,
    rule_version: str = RULE_VERSION,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Ledger rows for the blobs of ``versions`` not yet scanned under ``rule_version``.

    One row of each blob is chosen by the smallest ``key``; rows with that key and blob,
    repeated ones too, are read, and the ledger gets the blob once. An empty table gives
    an empty ledger.
    """
    rules = RULES if rules is None else rules
    addressed = versions.select(F.col(key).alias("key"), F.col(text).alias("text"), blob_id(text).alias("blob"))
    blobs = addressed.groupBy("blob").agg(F.min("key").alias("first"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    chosen = blobs.select(F.col("blob").alias("wanted"), "first").hint("shuffle_hash")
    todo = addressed.join(chosen, F.col("key").eqNullSafe(F.col("first")) & (F.col("blob") == F.col("wanted")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {k: (re.compile(p, re.ASCII), g, n) for k, (p, g, n) in rules.items()}
        for batch in batches:
            spans = [spans_in(t.as_py() or "", compiled) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), pa.array([rule_version] * len(spans), pa.string()), pa.array(spans, FOUND)],
                ["blob", "rule_version", "spans"],
            )

    # Not by pandas, which would stay in workers that later steps use again.
    return todo.select("blob", "text").mapInArrow(lean(scan), LEDGER).dropDuplicates(["blob"])


def findings(versions: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION, text: str = "text") -> DataFrame:
    """All rows of ``versions`` with the ``spans`` of their blob, in place of a column of that name."""
    known = ledger.where(F.col("rule_version") == rule_version).select("blob", "spans")
    return restored(beside(versions, blob=blob_id(text)).join(known, "blob", "left"), "spans")


def scan_secrets(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    rules: dict | None = None,
    rule_version: str = RULE_VERSION,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The ledger, extended by what ``versions`` has new; written to the shared folder."""
    grown = freeze(scan_unseen(versions, ledger, rules, rule_version, key, text))
    return grown if ledger is None else ledger.unionByName(grown)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``[SECRET]``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    one = F.lit(1)

    def step(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        gap = F.substring(text, state["at"] + one, F.greatest(span["start"] - state["at"], F.lit(0)))
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], gap, F.lit("[SECRET]"))).otherwise(state["out"]).alias("out"),
        )

    folded = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + one, F.length(text))))
    return F.when(F.size(spans) > 0, folded).otherwise(text)
