"""Registered queries against their SQL in DuckDB, and the pipeline against plain Python."""

import glob
import hashlib
import os

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from plain import best_stretch, jaccard_classes, quality_stats, secrets, shingles, tokens

import __spark_entry__ as driver
import corpus_pipeline
from sessionlake.llm import byte_bpe, decontaminate, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(found: pa.Table) -> list[tuple]:
    names = sorted(found.column_names)
    return sorted((tuple(row[n] for n in names) for row in found.to_pylist()), key=repr)


def test_all_are_registered():
    assert {int(q[2:].split("_")[0]) for q in driver.queries() if q.startswith("op")} == set(range(1, 14))
    assert "pipeline" in driver.queries()
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    ours, theirs = queries.queries()[name](spark, DATA).toArrow(), duck.execute(queries.oracle_sql()[name]).to_arrow_table()
    assert {f.name: str(f.type) for f in ours.schema} == {f.name: str(f.type) for f in theirs.schema}
    assert rows(ours) == rows(theirs)


def test_contracts_without_sql(spark, duck):
    docs = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    got = queries.op1_ngram_jaccard(spark, DATA).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == jaccard_classes(docs, 4, 85, 100)
    for r in queries.op3_quality_rules(spark, DATA).collect():
        assert quality_stats(docs[r.doc_id]) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
    for r in queries.op5_secret_scan(spark, DATA).collect():
        spans = [s for s in secrets(docs[r.doc_id]) if s[0] in queries.BASE_KINDS]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in spans) for k in queries.BASE_KINDS)


def test_pipeline(spark, duck):
    """From what the quality stage keeps on, every stage in plain Python."""
    docs = corpus_pipeline.quality(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    classes = jaccard_classes(texts, 5, 4, 5)
    texts = {i: t for i, t in texts.items() if classes[i][1] == i}
    items = [tokens(t) for (t,) in duck.execute("SELECT text FROM benchmark").fetchall()]

    def leaks(text):
        words = tokens(text)
        grams = shingles(" ".join(words), 5)
        return any(
            best_stretch(words, item) >= max(-(-6 * len(item) // 10), decontaminate.LEAST)
            for item in items
            if grams & shingles(" ".join(item), 5)
        )

    texts = {i: t for i, t in texts.items() if not leaks(t)}
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, text in texts.items():
        clean, at = "", 0
        for _, start, end in secrets(text):
            if start >= at:
                clean += text[at:start] + "[SECRET]"
            at = max(at, end)
        clean += text[at:]
        ids = library.encode_ordinary(clean)
        want[i] = (
            len(ids),
            hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(clean.encode()).hexdigest(),
        )
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want


def test_stages_take_odd_tables(spark):
    """Nulls, empty and repeated rows, extra columns with the operators' own names, no rows at all."""
    odd = spark.createDataFrame(
        [(None, None, None, None, None, "x", 1), (1, "", "en", "s", 0, None, 2), (2, "a b", None, None, None, "y", 3)]
        + [(3, " ".join(f"Word{i}" for i in range(60)) + " token=abcdefghij.", "en", "s", None, "z", 4)] * 2,
        "doc_id long, text string, lang string, source string, n_chars long, row string, kept int",
    )
    for table in (odd, odd.limit(0)):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DATA)
            assert docs.columns == odd.columns
        kept = docs.collect()
        assert [(r.doc_id, r.row, r.kept) for r in kept] == ([(3, "z", 4)] * 2 if table is odd else [])
        assert all(r.text.endswith("Word59 [SECRET]") for r in kept)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == len(kept)
