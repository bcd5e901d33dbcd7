"""WARC archives and their index, merged from sorted runs (operator 7).

``write`` turns captures into WARC/1.1 records, one file for each task and MAX_RECORDS; of captures with
the same payload the one with the smallest id is the response, the others are revisits of it.  ``read``
parses the archives by their Content-Length fields and checks every payload's digest.  Each archive
makes one capture run, sorted by URL key, timestamp and id; ``merge`` deals the runs out by ranges of
that order and merges the runs of each range with a loser tree, so the result is ordered within and
across partitions: the capture history of every URL.

Payloads are shuffled once, by capture and not by digest, so a payload that a third of all captures
share lands in no single task.  Archives are plain files of Spark's own text writer and so go to any
file system that Spark knows, with its commit protocol.

Edge cases: a null html is an empty payload, and empty payloads deduplicate like others; a null id sorts
after all others (its record has no id field) and reads back as null; of wholly equal rows one is the
response; a null url is the empty key; white space and control characters in URLs are
percent-encoded; an empty table writes no record and reads back as no rows; payloads may hold anything,
record separators included.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

MAX_RECORDS, MIN_BYTES = 4096, 0
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_INDEX = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, urlkey string, captured_at timestamp, file string, offset bigint, length bigint"


def base32(hexed: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: 20 bits at a time."""
    out = []
    for k in range(8):
        v = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_ALPHABET), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _record_id(page: Column, url: Column, digest: Column, copy: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", F.coalesce(page.cast("string"), F.lit("")), url, digest, copy.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, b, c in ((1, 8, "-"), (9, 4, "-"), (13, 4, "-"), (17, 4, "-"), (21, 12, ">")) for x in (F.substring(h, a, b), F.lit(c))))


def write(captures: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """captures: page_id bigint, url, html, captured_at timestamp.  Payloads below min_bytes are never revisits."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    rows = captures.select(F.col("page_id").cast("bigint").alias("page"), url.alias("url"), F.col("captured_at").alias("at"), html.alias("html"), base32(F.sha1(html.cast("binary"))).alias("digest"), F.octet_length(html).alias("n"))
    # one key that is never null, so that grouping and join agree on where a capture goes
    key = F.sha1(F.concat_ws("\x1f", F.coalesce(F.col("page").cast("string"), F.lit("-")), F.coalesce(F.col("at").cast("string"), F.lit("-")), "digest", "url").cast("binary"))
    rows = rows.withColumn("key", key)
    # which capture is the response: on narrow rows, hot digests combined before the shuffle
    narrow = rows.select("key", "page", "url", "at", "digest", "n")
    order = F.struct(F.col("page").isNull().alias("no"), "page", "url", "at")
    first = narrow.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min(order).alias("best"))
    role = narrow.select("key", "digest").distinct().join(first, "digest", "left").select("key", "best")
    whole = rows.groupBy("key").agg(*(F.first(c).alias(c) for c in ("page", "url", "at", "digest", "html", "n")), F.count(F.lit(1)).alias("copies"))
    joined = whole.join(role.hint("merge"), "key", "left")
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    leads = F.col("best").isNull() | ((F.col("copy") == 1) & order.eqNullSafe(F.col("best")))
    nl, target = "\r\n", F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{nl}Content-Type: text/html; charset=utf-8{nl}Content-Length: "), F.col("n").cast("string"), F.lit(nl * 2))
    block = F.when(leads, F.concat(http, "html")).otherwise(http)
    date = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")

    def field(name: str, value: Column) -> Column:
        return F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), value, F.lit(nl)))

    best = F.col("best")
    record = F.concat(
        F.lit(f"WARC/1.1{nl}WARC-Type: "), F.when(leads, "response").otherwise("revisit"), F.lit(nl),
        field("WARC-Record-ID", _record_id(F.col("page"), F.col("url"), F.col("digest"), F.col("copy"))),
        field("WARC-Date", date), field("WARC-Target-URI", target),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), field("X-Page-ID", F.col("page").cast("string")),
        F.when(leads, "").otherwise(F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{nl}"), field("WARC-Refers-To", _record_id(best["page"], best["url"], F.col("digest"), F.lit(1))), field("X-Refers-To-Page", best["page"].cast("string")))),
        F.lit(f"Content-Type: application/http; msgtype=response{nl}Content-Length: "), F.octet_length(block).cast("string"), F.lit(nl * 2), block,
    )
    # the line separator ends the record's block, so that the file is a WARC file and nothing else
    each.select(record.alias("value")).write.option("lineSep", nl * 2).option("compression", "gzip").option("maxRecordsPerFile", MAX_RECORDS).text(path)


def url_key(url: str) -> str:
    """Host reversed and without www, lower-case path with sorted query: the order of a capture index."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url.lower()
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path.lower() or '/'}{'?' + query.lower() if query else ''}"


class Records:
    """Parses a gzipped archive as it is fed; (fields, block, offset, length) of each record."""

    def __init__(self, content: bytes):
        self.inflate, self.content, self.at, self.buffer, self.base = zlib.decompressobj(31), content, 0, bytearray(), 0

    def _more(self) -> bool:
        if self.at >= len(self.content):
            return False
        piece = self.content[self.at : self.at + (1 << 20)]
        self.at += len(piece)
        self.buffer += self.inflate.decompress(piece)
        return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
        while True:
            while (end := self.buffer.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    if self.buffer.strip():
                        raise ValueError("an archive ends within a record's header")
                    return
            head = self.buffer[:end].decode("utf-8")
            lines = head.split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"not a record: {lines[0][:60]!r}")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            size = int(fields["Content-Length"])
            while len(self.buffer) < end + 8 + size:
                if not self._more():
                    raise ValueError("an archive ends within a record's block")
            block = bytes(self.buffer[end + 4 : end + 4 + size])
            yield fields, block, self.base, end + 8 + size
            del self.buffer[: end + 8 + size]
            self.base += end + 8 + size


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record, those of one archive together in the order of the index: a run."""
    from datetime import datetime

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                out = []
                for fields, block, offset, length in Records(content.as_py()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    n = int(head.rpartition(b"Content-Length: ")[2])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't have its digest")
                    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
                    url = fields.get("WARC-Target-URI", "")
                    at = datetime.fromisoformat(fields["WARC-Date"]) if "WARC-Date" in fields else None
                    out.append((page and int(page), n, digest, fields["WARC-Type"], refers and int(refers), url, url_key(url), at, file.as_py().rpartition("/")[2], offset, length))
                out.sort(key=_order)
                yield _batch(out)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content").mapInArrow(run, _INDEX)


_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("urlkey", pa.string()), ("captured_at", pa.timestamp("us", "UTC")), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _order(row: tuple) -> tuple:
    return (row[6], row[7] is None, row[7], row[0] is None, row[0] or 0, row[8], row[9])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so the next row costs one path of log2(k) comparisons."""

    def __init__(self, runs: list[Iterator[tuple]], key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(self.runs))
        self.heads: list[tuple | None] = [self._pull(i) for i in range(len(self.runs))] or [None]
        self.losers = [-1] * self.k
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.top = winners[1] if self.k > 1 else 0

    def _pull(self, i: int) -> tuple | None:
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), row)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x[0], a) < (y[0], b))

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.top]) is not None:
            yield head[1]
            i = self.top
            self.heads[i] = self._pull(i)
            node = (i + self.k) // 2
            while node:
                if self._before(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.top = i


def merge(runs: DataFrame, rows_per_range: int = 200_000) -> DataFrame:
    """The rows of all runs in the order of URL key, timestamp and id."""
    n = max(1, -(-runs.count() // rows_per_range))
    ranges = runs.repartitionByRange(n, "urlkey", F.col("captured_at").asc_nulls_last(), F.col("page_id").asc_nulls_last(), "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_file: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                by_file.setdefault(row[8], []).append(row)
        for rows in by_file.values():
            rows.sort(key=_order)  # in order already, unless the shuffle dealt the blocks of a run out of turn
        out: list[tuple] = []
        for row in LoserTree([iter(by_file[f]) for f in sorted(by_file)], _order):
            out.append(row)
            if len(out) == 8192:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return ranges.mapInArrow(run, _INDEX)


def captures(pages: DataFrame) -> DataFrame:
    """pages as captures: one a second, in the order of their ids, since the table has no times."""
    return pages.select("page_id", "url", "html", F.timestamp_seconds(F.lit(1_577_836_800) + F.coalesce(F.pmod(F.col("page_id").cast("bigint"), F.lit(1_000_000_000)), F.lit(0))).alias("captured_at"))


def history(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Archives pages and returns the merged index of what was read back."""
    spark = pages.sparkSession
    path = path or common.scratch(spark, "warc")
    write(captures(pages), path)
    return merge(common.keep(read(spark, path), "runs"))
