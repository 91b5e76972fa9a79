"""WARC: pages become archives of request, response and metadata records; transactions are put together again from them.

Writing: each page is a capture of three records, gzip members of their own in .warc.gz files: the request, the response
(or a revisit) and metadata. Request and metadata name the response in WARC-Concurrent-To. Of pages with equal payloads
of at least LEAST bytes, that of the largest id is the response; the others are revisits, which refer to it and keep
only the HTTP head. Which page that is comes from a maximum by payload digest, with partial aggregation; the digests of
several pages are kept as a table, and pages learn from it in a join that Spark broadcasts by the table's size or else
splits where a payload has very many pages. Pages with payloads of their own have a key of their own there.

Reading: files of bounded size are partitions of a Spark data source that streams records in Arrow batches of bounded
size and checks every digest. Assembly joins each response or revisit with the request and the metadata that name it, and
emits one nested row for each capture.

Record ids are urn:uuid: with the record's kind and bits of a hash of url and payload in the upper half and the page's id
in the lower: pages that repeat an id with another url or payload are told apart, and a revisit's response can be told
without another join.

Defined cases: null html is an empty payload; a null url has no WARC-Target-URI; null ids come first (a page with an id
is the response before them); rows that repeat id and payload are captures of their own, and if theirs is the largest id
each is a response (revisits refer to the one of the largest url); rows that repeat the url as well have the same record
ids; an empty table gives no file and no row. Ids are whole
numbers; others are an error (a null where ANSI mode is off). Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from .archive import Ranges, Shards, Written, abort, commit, listing, open_folder
from .archive import planned as tasks
from .common import cut, shared_path

LEAST = 1000
SHARD_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
KINDS = {"request": 1, "response": 2, "revisit": 2, "metadata": 3}
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(kind: str, page_id: int | None, url: str | None, payload: bytes) -> str:
    """In hex: the kind, 8 for pages without an id, two zeros, 12 digits of a hash of url and payload, the page's id in 16."""
    own = hashlib.sha1(b"-" if url is None else b"+" + url.encode("utf-8", "replace") + b"\0")
    own.update(payload)
    x = f"{KINDS[kind]:x}{8 if page_id is None else 0}00{own.hexdigest()[:12]}{(page_id or 0) & (1 << 64) - 1:016x}"
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def _sha1(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(kind: str, own_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", "2020-01-01T00:00:00Z"), *headers, ("WARC-Block-Digest", _sha1(hashlib.sha1(block).digest())), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def capture(page_id: int | None, url: str | None, payload: bytes, response_id: int | None, response_url: str | None, is_revisit: bool) -> list[bytes]:
    """The three records of a page."""
    target = [] if url is None else [("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~"))]
    name = lambda kind: record_id(kind, page_id, url, payload)
    digest = hashlib.sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    own = [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", _sha1(digest.digest()))]
    if is_revisit:
        main = record("revisit", name("revisit"), [*target, *own, ("WARC-Profile", _REVISIT), ("WARC-Refers-To", record_id("response", response_id, response_url, payload))], http)
    else:
        main = record("response", name("response"), [*target, *own], http + payload)
    with_it = ("WARC-Concurrent-To", name("response"))
    path = re.sub(r"^[a-z]+://[^/]*", "", target[0][1]) if target else ""
    request = record("request", name("request"), [*target, with_it, ("Content-Type", "application/http;msgtype=request")], f"GET /{path.removeprefix('/')} HTTP/1.1\r\n\r\n".encode())
    metadata = record("metadata", name("metadata"), [*target, with_it, ("Content-Type", "application/warc-fields")], f"payloadSha1Hex: {digest.hexdigest()}\r\n".encode())
    return [request, main, metadata]


class WarcWriter(DataSourceArrowWriter):
    """Rows (page_id, url, html, response_id, response_url, is_revisit) become captures."""

    def __init__(self, options: dict[str, str]):
        self.uri, self.most = options["path"], int(options.get("shardbytes", SHARD_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        shards = Shards(self.uri, ".warc.gz", self.most)
        for b in iterator:
            for k, url, html, *response in zip(*(b.column(i) for i in range(6)), strict=True):
                payload = (html.as_py() or "").encode("utf-8", "replace")
                out = shards.stream()
                for r in capture(k.as_py(), url.as_py(), payload, *(x.as_py() for x in response)):
                    out.write(gzip.compress(r, 1, mtime=0))
        shards.close()
        return Written(shards.files)

    def commit(self, messages) -> None:
        commit(self.uri, messages)

    def abort(self, messages) -> None:
        abort(self.uri, messages)


def records(stream) -> Iterator[bytes]:
    """The records of a .warc.gz stream, a gzip member each."""
    ahead = b""
    while True:
        ahead = ahead or stream.read(1 << 20)
        if not ahead:
            return
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            if not ahead:
                ahead = stream.read(1 << 20)
                if not ahead:
                    raise OSError("a record is cut off")
            out.append(d.decompress(ahead))
            ahead = d.unused_data if d.eof else b""
        yield b"".join(out)


def parse(raw: bytes) -> dict:
    """The columns of a record; OSError if its block fails its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if _sha1(hashlib.sha1(block).digest()) != headers["WARC-Block-Digest"]:
        raise OSError(f"{headers['WARC-Record-ID']} fails its digest")
    kind, payload, size, digest = headers["WARC-Type"], None, None, None
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        size = len(payload)
        if kind == "revisit":
            payload, size = None, int(re.search(rb"(?i)content-length: (\d+)", http)[1])
        elif hashlib.sha1(payload).hexdigest() != digest:
            raise OSError(f"{headers['WARC-Record-ID']} fails its payload's digest")
    elif kind == "metadata":
        payload = block
    return {
        "record_id": headers["WARC-Record-ID"], "type": kind, "uri": headers.get("WARC-Target-URI"), "concurrent_to": headers.get("WARC-Concurrent-To"), "refers_to": headers.get("WARC-Refers-To"),
        "payload_bytes": size, "payload_digest": digest, "http": block if kind == "request" else None, "payload": payload,
    }


_SCHEMA = pa.schema([(n, pa.string()) for n in ("record_id", "type", "uri", "concurrent_to", "refers_to")] + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("http", pa.binary()), ("payload", pa.binary())])


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri, self.payloads, self.most = options["path"], options.get("payloads", "true") == "true", int(options.get("rangebytes", 16 << 20))

    def partitions(self) -> list[InputPartition]:
        return tasks(listing(self.uri, ".warc.gz"), self.most, split=False)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path, _, _ in partition.parts:
            with open_folder(self.uri)[0].open_input_stream(path, compression=None) as stream:
                for raw in records(stream):
                    row = parse(raw)
                    if not self.payloads and row["type"] == "response":
                        row["payload"] = None
                    rows.append(row)
                    size += len(raw)
                    if size >= BATCH_BYTES or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


class Warc(DataSource):
    """format("warc_captures"); path: the folder; payloads=false leaves payloads out once they have been checked."""

    @classmethod
    def name(cls) -> str:
        return "warc_captures"

    def schema(self) -> str:
        return "record_id string, type string, uri string, concurrent_to string, refers_to string, payload_bytes long, payload_digest string, http binary, payload binary"

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, response_id, response_url, is_revisit: which page each repeats."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= LEAST, F.sha1(F.col("html").cast("binary"))))
    groups = rows.filter("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("response")).filter("n > 1")
    groups = cut(groups.select(F.col("digest").alias("key"), F.lit(True).alias("repeated"), "response"), "warc-repeated")
    out = rows.withColumn("key", F.coalesce("digest", F.concat_ws(":", F.lit("small"), "page_id", F.xxhash64("url").cast("string")))).join(groups, "key", "left")
    again = F.col("repeated").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response.page_id"))
    return out.select("page_id", "url", "html", F.col("response.page_id").alias("response_id"), F.col("response.url").alias("response_url"), again.alias("is_revisit"))


def write_warc(pages: DataFrame, path: str, **options: str) -> None:
    pages.sparkSession.dataSource.register(Warc)
    planned(pages).write.format("warc_captures").mode("append").options(path=path, **options).save()


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(Warc)
    return spark.read.format("warc_captures").options(path=path, **options).load()


def transactions(records_df: DataFrame) -> DataFrame:
    """One row for each capture: record_id, response, request and metadata (structs; null where there is none).

    Requests and metadata that name the same response twice (repeated pages) count once, the smallest of them.
    """
    main = records_df.filter("type in ('response', 'revisit')").select("record_id", F.struct("type", "uri", "refers_to", "payload_bytes", "payload_digest", "payload").alias("response"))
    side = lambda kind, *fields: records_df.filter(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min(F.struct("uri", *fields)).alias(kind))
    return main.join(side("request", "http"), "record_id", "left").join(side("metadata", F.col("payload").alias("fields")), "record_id", "left")


def page_number(record: F.Column) -> F.Column:
    """The page's id that a record id carries."""
    x = F.regexp_replace(record, "urn:uuid:|[^0-9a-f]", "")
    high, low = F.conv(F.substring(x, -16, 8), 16, 10).cast("long"), F.conv(F.substring(x, -8, 8), 16, 10).cast("long")
    return F.when(F.substring(x, 2, 1) == "0", F.shiftleft(high, 32).bitwiseOR(low))


def captures(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Writes pages as archives, reads them back and puts the transactions together; payloads=False leaves payloads out once they have been checked.

    Archives are read and checked once: the records are a table, of which each kind is a part.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(pages, path)
    return transactions(cut(read_warc(spark, path, payloads=str(payloads).lower()), "warc-records"))
