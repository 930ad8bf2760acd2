"""WARC archives: write captures, read them back, merge their indexes into histories.

Writing. Payloads are content-addressed by SHA-1. Of records with equal payloads the one
with the smallest id is the response; the others are revisits that name it and carry no
payload. Records go through Spark's text writer, whose line separator is the two blank
lines that end a record, so that archives can lie in any store Spark writes to. Files are
gzipped whole; offsets count bytes of the records.

Reading. Every archive file is one capture run. Its records are parsed by their
Content-Length, payload digests are checked, and the index lines of a run are sorted by url
key and capture time. Runs meet in an external merge: their lines are dealt out by ranges of
(url key, time, id), and within a range a loser tree merges the k runs, so that the parts in
order form one globally ordered capture history. A hot url is split by time and id.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.common import lower_ascii, text_of
from sessionlake.session import freeze, fresh_path

END = "\r\n\r\n"
BASE_32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records in an archive file at most; a file is read back whole.
FILE_RECORDS = 20_000
#: Payloads of at least so many bytes are stored once.
LEAST_SHARED = 0

INDEX = (
    "run string, urlkey string, captured long, page_id long, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long, stored_ok boolean, offset long"
)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits make four base32 digits."""
    digest = F.sha1(payload)
    groups = [
        F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE_32)


def url_key(url: Column) -> Column:
    """Host labels in reverse order, then the rest: com,example)/path. Empty for a null url."""
    pattern = r"(?s)^(?:.*?://)?([^/?#]*)(.*)$"
    host = F.split(lower_ascii(F.regexp_extract(text_of(url), pattern, 1)), r"\.")
    return F.concat(F.array_join(F.reverse(host), ","), F.lit(")"), F.regexp_extract(text_of(url), pattern, 2))


def with_records(pages: DataFrame, key: str, url: str, html: str, captured: Column, least: int = LEAST_SHARED) -> DataFrame:
    """One WARC record per row, as text without the final separator."""
    payload = text_of(html)
    rows = pages.select(
        F.col(key).alias("page_id"),
        F.col(url).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("size"),
        base32_sha1(payload.cast("binary")).alias("digest"),
        captured.cast("long").alias("captured"),
    )
    # The smallest id of each payload, combined before the shuffle.
    first = rows.groupBy("digest", "size").agg(F.min("page_id").alias("first"))
    rows = rows.join(first, ["digest", "size"])
    revisit = (F.col("size") >= least) & (F.col("page_id") != F.col("first"))
    stamp = F.date_format(F.timestamp_seconds("captured"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    target = F.regexp_replace("url", r"[\r\n]", "%0A")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"),
        F.lit(END),
    )
    kept = F.when(revisit, F.lit("")).otherwise(F.col("payload"))

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", F.concat(F.lit("<urn:capture:"), F.col("page_id").cast("string"), F.lit(">"))),
        header("WARC-Date", stamp),
        header("WARC-Target-URI", target),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        header("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:capture:"), F.col("first").cast("string"), F.lit(">")))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        header("Content-Length", (F.octet_length(http) + F.octet_length(kept)).cast("string")),
        F.lit("\r\n"),
        http,
        kept,
    )
    return rows.select(record.alias("record"))


def write_archives(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    captured: Column | None = None,
) -> str:
    """Archives with one record per row of ``pages``, below ``path``.

    A null payload is written as an empty one, a null url without a target. Line breaks in
    a url are escaped. Rows without an id are not captures and are left out; two rows with
    one id and payload are two responses.
    """
    captured = F.lit(0) if captured is None else captured
    records = with_records(pages.where(F.col(key).isNotNull()), key, url, html, captured)
    records.write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path, compression="gzip")
    return path


_FIELD = re.compile(rb"([A-Za-z-]+): ([^\r]*)\r\n")


def parse_records(archive: bytes) -> Iterator[dict]:
    """The records of one archive, with the payload; lengths, not separators, delimit them."""
    at = 0
    while at < len(archive):
        if archive[at : at + 10] != b"WARC/1.1\r\n":
            raise ValueError(f"no record at byte {at}")
        end = archive.index(b"\r\n\r\n", at) + 4
        fields = {k.decode(): v.decode() for k, v in _FIELD.findall(archive[at + 10 : end])}
        block = archive[end : end + int(fields["Content-Length"])]
        head = block.index(b"\r\n\r\n") + 4
        inner = dict(_FIELD.findall(block[:head]))
        yield {"offset": at, "fields": fields, "size": int(inner[b"Content-Length"]), "payload": block[head:]}
        at = end + len(block) + len(END)


def _number(field: str | None) -> int | None:
    return int(field.removeprefix("<urn:capture:").removesuffix(">")) if field else None


def _index_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            run = path.rsplit("/", 1)[-1]
            lines = []
            for record in parse_records(gzip.decompress(content.as_py())):
                fields = record["fields"]
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                response = fields["WARC-Type"] == "response"
                own = base64.b32encode(hashlib.sha1(record["payload"]).digest()).decode()
                lines.append(
                    {
                        "run": run,
                        "urlkey": key_of(fields.get("WARC-Target-URI", "")),
                        "captured": seconds_of(fields["WARC-Date"]),
                        "page_id": _number(fields["WARC-Record-ID"]),
                        "record_type": fields["WARC-Type"],
                        "payload_bytes": record["size"],
                        "payload_digest": digest,
                        "refers_to": _number(fields.get("WARC-Refers-To")),
                        "stored_ok": not response or (own == digest and len(record["payload"]) == record["size"]),
                        "offset": record["offset"],
                    }
                )
            lines.sort(key=order_of)
            yield from pa.Table.from_pylist(lines, schema=INDEX_ARROW).to_batches(max_chunksize=10_000)


def key_of(url: str) -> str:
    host, rest = re.match(r"(?s)(?:.*?://)?([^/?#]*)(.*)", url).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    return ",".join(reversed(host.split("."))) + ")" + rest


def seconds_of(stamp: str) -> int:
    import calendar
    import time

    return calendar.timegm(time.strptime(stamp, "%Y-%m-%dT%H:%M:%SZ"))


def order_of(line: dict) -> tuple:
    # Bytes of UTF-8, as Spark orders strings.
    return line["urlkey"].encode(), line["captured"], line["page_id"]


INDEX_ARROW = pa.schema(
    [
        ("run", pa.string()),
        ("urlkey", pa.string()),
        ("captured", pa.int64()),
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("stored_ok", pa.bool_()),
        ("offset", pa.int64()),
    ]
)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index lines of all archives below ``path``, one sorted run per file."""
    # One file to a task at least: a file is read whole, its size is bounded by the writer's.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path)
    return files.select("path", "content").mapInArrow(_index_run, INDEX)


class LoserTree:
    """Merges sorted runs; each step costs one comparison per level.

    Inner nodes hold the loser of their match, the root's place the winner. An exhausted
    run loses against all others; ties go to the run that comes first.
    """

    def __init__(self, runs: list[Iterator]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.size = len(runs)
        self.losers = [-1] * max(1, self.size)
        for leaf in range(self.size):
            self._enter(leaf)

    def _enter(self, leaf: int) -> None:
        """Plays a run up the tree for the first time; it waits where no opponent is yet."""
        node = (leaf + self.size) // 2
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = leaf
                return
            leaf = self._match(node, leaf)
            node //= 2
        self.losers[0] = leaf

    def _match(self, node: int, run: int) -> int:
        other = self.losers[node]
        if self._beats(other, run):
            self.losers[node] = run
            return other
        return run

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def __iter__(self) -> Iterator:
        while self.size and self.heads[winner := self.losers[0]] is not None:
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            node = (winner + self.size) // 2
            while node > 0:
                winner = self._match(node, winner)
                node //= 2
            self.losers[0] = winner


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of all runs: the rows come by run and in order, and leave in one order."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    keys = list(
        zip(
            (k.encode() for k in table.column("urlkey").to_pylist()),
            table.column("captured").to_pylist(),
            table.column("page_id").to_pylist(),
        )
    )
    names = table.column("run").to_pylist()
    starts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]] + [len(names)]
    runs = [zip(keys[a:b], range(a, b)) for a, b in zip(starts, starts[1:])]
    merged = pa.array([at for _, at in LoserTree(runs)], pa.int64())
    yield from table.take(merged).combine_chunks().to_batches(max_chunksize=10_000)


def merge_index(runs: DataFrame) -> DataFrame:
    """Globally ordered capture histories: partitions in order, rows in order within each."""
    order = ["urlkey", "captured", "page_id"]
    return (
        runs.repartitionByRange(*order)
        .sortWithinPartitions("run", *order)
        .mapInArrow(_merge_runs, INDEX)
    )


def archive_and_index(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    captured: Column | None = None,
) -> DataFrame:
    """Write archives to the shared folder, read them back and merge their indexes."""
    spark = pages.sparkSession
    path = write_archives(pages, fresh_path(spark, "warc"), key, url, html, captured)
    # The runs are written once: dealing them out by ranges reads them twice.
    return merge_index(freeze(read_runs(spark, path)))
