"""The operators as queries on the test tables, with SQL for DuckDB where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm import (
    byte_bpe,
    chat_format,
    collocations,
    decontaminate,
    gru_lm,
    lexical_search,
    license_scan,
    ngram_jaccard,
    packing,
    quality_rules,
    secret_scan,
    url_filter,
    warc,
)
from sessionlake.llm.common import table

URL_RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_jaccard.jaccard_join(docs, n=4, num=85, den=100)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: by source, thousand and hundred; every tenth is a licence file."""
    name = "CASE WHEN doc_id % 10 = 0 THEN concat('LICENSE-', doc_id) ELSE concat(doc_id, '.txt') END"
    files = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "text", f"concat_ws('/', source, doc_id div 1000, doc_id div 100, {name}) AS path"
    )
    found = license_scan.scan_licences(files)
    # A number that may be missing as a double: the same in every client library.
    return found.withColumns({"score": F.round("score", 6), "line": F.col("line").cast("double")})


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judge_quality(docs, drop=("text",))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.archive_and_index(pages, captured=F.col("page_id")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured", "stored_ok"
    )


BASE_KINDS = ("assign", "access", "hex")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.findings(docs, secret_scan.scan_secrets(docs))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}")
        for kind in BASE_KINDS
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secret_scan.listed(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("packed") / 4).cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "rule string, action string")
    return url_filter.judge_urls(pages, rules).drop("url")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return gru_lm.score_corpus(docs, "crc32(CAST(doc_id AS string)) % 7 = 2")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(table(spark, sf_dir, "documents"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"), best=50)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return collocations.collocations(docs, least=10, most=3, inside=50, best=2000)


def op13_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BASE32 = " || ".join(
    f"substr('{warc.BASE_32}', 1 + ((('0x' || substr(h, {5 * g + 1}, 5))::INTEGER >> {5 * (3 - d)}) & 31), 1)"
    for g in range(8)
    for d in range(4)
)

_TERM = r"[\p{L}\p{N}]+"

_LICENSES = ", ".join(f"('{name}', '{text}')" for name, text in license_scan.TEMPLATES.items())

ORACLE_SQL = {
    "op2_license_scan": f"""
        WITH files AS (
            SELECT doc_id, text, doc_id % 10 = 0 AS grants,
                concat_ws('/', source, doc_id // 1000, doc_id // 100) AS directory,
                concat_ws('/', source, doc_id // 1000, doc_id // 100,
                    CASE WHEN doc_id % 10 = 0 THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END) AS path
            FROM documents
        ), lines AS (
            SELECT * FROM (
                SELECT doc_id, unnest(string_split(text, chr(10))) AS content,
                    generate_subscripts(string_split(text, chr(10)), 1) AS line
                FROM files)
            WHERE regexp_matches(content, '{_TERM}')
        ), terms AS (
            SELECT doc_id, line, t, count(*) AS n
            FROM (SELECT doc_id, line, unnest(regexp_extract_all(lower(content), '{_TERM}')) AS t FROM lines)
            GROUP BY ALL
        ), template AS (
            SELECT license, t, count(*) AS n
            FROM (SELECT license, unnest(regexp_extract_all(lower(body), '{_TERM}')) AS t
                FROM (VALUES {_LICENSES}) AS v(license, body))
            GROUP BY ALL
        ), whole AS (SELECT count(*) AS total FROM lines),
        weights AS (
            SELECT t, ln((1 + any_value(total)) / (1 + count(terms.t))) + 1 AS w
            FROM (SELECT DISTINCT t FROM template) LEFT JOIN terms USING (t), whole GROUP BY t
        ), vectors AS (
            SELECT license, t, n * w * w / sqrt(sum(n * w * n * w) OVER (PARTITION BY license)) AS part
            FROM template JOIN weights USING (t)
        ), norms AS (
            SELECT doc_id, line, sqrt(sum(pow(n * coalesce(w, ln(1 + total) + 1), 2))) AS norm
            FROM terms LEFT JOIN weights USING (t), whole GROUP BY ALL
        ), scores AS (
            SELECT doc_id, line, license, sum(n * part) / any_value(norm) AS score
            FROM terms JOIN vectors USING (t) JOIN norms USING (doc_id, line) GROUP BY ALL
        ), own AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, line, license) AS place
            FROM scores WHERE score >= {license_scan.THRESHOLD}
        ), found AS (
            SELECT files.* EXCLUDE (text), line, license, score FROM files
            LEFT JOIN (SELECT * FROM own WHERE place = 1) o ON files.doc_id = o.doc_id
        ), granted AS (
            SELECT directory AS above, license,
                row_number() OVER (PARTITION BY directory ORDER BY round(score, 9) DESC, license) AS place
            FROM found WHERE grants AND license IS NOT NULL
        ), nearest AS (
            SELECT d.directory, g.above, g.license AS inherited,
                row_number() OVER (PARTITION BY d.directory ORDER BY length(g.above) DESC) AS place
            FROM (SELECT DISTINCT directory FROM files) d
            JOIN granted g ON g.place = 1 AND (d.directory = g.above OR starts_with(d.directory, g.above || '/'))
        )
        SELECT doc_id, path, coalesce(license, inherited) AS license, round(score, 6) AS score,
            line::DOUBLE AS line,
            CASE WHEN license IS NOT NULL THEN 'header' WHEN inherited IS NOT NULL THEN 'directory' END AS origin,
            CASE WHEN license IS NULL THEN above END AS from_directory
        FROM found LEFT JOIN (SELECT * FROM nearest WHERE place = 1) USING (directory)
    """,
    "op4_warc": f"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url, sha1(coalesce(html, '')) AS h FROM pages
        ), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
        k AS (
            SELECT *, regexp_extract(url, '^(?s:(?:.*?://)?([^/?#]*)(.*))$', 1) AS host,
                regexp_extract(url, '^(?s:(?:.*?://)?([^/?#]*)(.*))$', 2) AS rest
            FROM p JOIN f USING (h)
        )
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to,
            array_to_string(list_reverse(string_split(translate(host, '{_UPPER}', '{_LOWER}'), '.')), ',') || ')' || rest
                AS urlkey,
            page_id AS captured, true AS stored_ok
        FROM k
    """,
    "op7_chat_format": """
        WITH t AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
        p AS (
            SELECT conv_id, count(*) OVER (PARTITION BY conv_id) AS n_turns,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS pos,
                CASE WHEN role IS NULL THEN '-' ELSE role || ':' END || length(text) || ':' || text AS exact,
                '<|im_start|>' || coalesce(role, '') || chr(10) || text || '<|im_end|>' || chr(10) AS piece
            FROM t
        ), h AS (
            SELECT *, md5(string_agg(md5(exact), '') OVER (
                PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS prefix
            FROM p
        ), ends AS (
            SELECT prefix, n_turns, min(conv_id) AS conv_id, count(*) AS copies FROM h WHERE pos = n_turns GROUP BY ALL
        ), kept AS (
            SELECT * FROM ends e
            WHERE NOT EXISTS (FROM h WHERE h.prefix = e.prefix AND h.pos = e.n_turns AND h.pos < h.n_turns)
        )
        SELECT kept.conv_id, kept.n_turns, copies, string_agg(piece, '' ORDER BY pos) AS chat
        FROM kept JOIN h USING (conv_id) GROUP BY ALL
    """,
    "op8_url_filter": f"""
        WITH p AS (
            SELECT page_id,
                translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
                coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
            FROM pages
        ), r(rule, action, rule_host, rule_path) AS (
            VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
                ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')
        ), b AS (
            SELECT p.*, rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS n
            FROM p LEFT JOIN r
                ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        )
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM b WHERE n = 1
    """,
}

_SEARCH_TERMS = f"""
    regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')
"""

ORACLE_SQL["op11_lexical_search"] = f"""
    WITH held AS (
        SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_SEARCH_TERMS}) AS term FROM documents)
        GROUP BY ALL
    ), docs AS (SELECT doc_id, sum(tf)::BIGINT AS terms FROM held GROUP BY doc_id),
    whole AS (SELECT count(*) AS documents, sum(terms)::BIGINT AS occurrences FROM docs),
    impacts AS (
        SELECT doc_id, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * terms * documents) // occurrences)) AS impact, term
        FROM held JOIN docs USING (doc_id), whole
    ), weights AS (
        SELECT term, floor(1000 * ln((2 * any_value(documents) + 2) / (2 * count(*) + 1)))::BIGINT AS w
        FROM held, whole GROUP BY term
    ), asked AS (SELECT DISTINCT item_id, unnest({_SEARCH_TERMS}) AS term FROM benchmark),
    scores AS (
        SELECT item_id, doc_id, sum(w * impact)::BIGINT AS score
        FROM asked JOIN impacts USING (term) JOIN weights USING (term) GROUP BY ALL
    )
    SELECT item_id, rank::INTEGER AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
    WHERE rank <= 50
"""

ORACLE_SQL["op12_collocations"] = f"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
            unnest(regexp_split_to_array(translate(text, '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents
    ), worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
    occurrences AS (
        SELECT lang, length, w[i:i + length - 1] AS words
        FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded), (VALUES (1), (2), (3)) AS v(length)
        WHERE i + length - 1 <= len(w)
    ), counts AS (
        SELECT lang, words, length, array_to_string(words, ' ') AS phrase, count(*) AS f FROM occurrences GROUP BY ALL
        HAVING count(*) >= 10
    ), halves AS (
        SELECT lang, phrase, length, f AS a, k, array_to_string(words[1:k], ' ') AS first_part,
            array_to_string(words[k + 1:length], ' ') AS rest
        FROM counts, (VALUES (1), (2)) AS v(k) WHERE k < length
    ), cuts AS (
        SELECT h.*, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
        FROM halves h JOIN counts l ON l.lang = h.lang AND l.phrase = first_part
        JOIN counts r ON r.lang = h.lang AND r.phrase = rest
    ), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    longer AS (
        SELECT lang, phrase, max(f) AS f
        FROM (SELECT lang, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS phrase, f
            FROM counts WHERE length = 3)
        GROUP BY ALL
    ), ranked AS (
        SELECT lowest.*, row_number() OVER (
            PARTITION BY lang ORDER BY score DESC, a DESC, encode(lowest.phrase)) AS rank
        FROM lowest LEFT JOIN longer USING (lang, phrase)
        WHERE length = 3 OR longer.f IS NULL OR 100 * longer.f < 50 * a
    )
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
