"""Media columns: payloads become grey images in archives, which a Spark data source plans, streams and reads again.

A payload is a text's UTF-8 with zero bytes up to a positive multiple of 64. Its bytes are the samples of an 8-bit grey
PNG image of width 64, without loss; equal texts give equal images. Images are members of archives in the shared folder,
named by the document's id; archive.py has how these are written, planned by byte ranges, and how members are retried.
Features of an image are the mean, deviation and entropy of its samples and a coarse histogram.

Defined cases: null and empty texts have a payload of 64 zero bytes; a null id stays null; rows that repeat an id are
members of their own; an empty table gives no archive and no row. Ids are whole
numbers; others are an error (a null where ANSI mode is off). Other columns are not read. Memory is bounded by an
Arrow batch and the longest text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archive import MemberArchives
from .common import shared_path

WIDTH = 64
_MAGIC = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> tuple[bytes, int]:
    """(padded payload, bytes before padding)."""
    data = (text or "").encode("utf-8", "replace")
    return data + b"\0" * ((-len(data)) % WIDTH if data else WIDTH), len(data)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes, n_bytes: int) -> bytes:
    """A grey image of the samples; n_bytes goes along as text."""
    rows = np.zeros((len(samples) // WIDTH, WIDTH + 1), dtype=np.uint8)  # each row begins with its filter, none
    rows[:, 1:] = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Payload bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(png: bytes) -> tuple[bytes, int]:
    """(samples, n_bytes) of an image that to_png made; ValueError for others and for damage."""
    if png[:8] != _MAGIC:
        raise ValueError("no PNG")
    at, data, n, height = 8, [], -1, -1
    while at < len(png):
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", body[:10])
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("other samples")
        elif kind == b"tEXt" and body.startswith(b"Payload bytes\0"):
            n = int(body[14:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("other filters")
    return rows[:, 1:].tobytes(), n


def feature(samples: bytes) -> str:
    counts = np.bincount(np.frombuffer(samples, dtype=np.uint8), minlength=256)
    p = counts / counts.sum()
    mean = float(p @ np.arange(256))
    deviation = float(p @ (np.arange(256) - mean) ** 2) ** 0.5
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    return f"mean={mean:.3f};dev={deviation:.3f};bits={entropy:.4f};hist=" + ",".join(f"{x:.4f}" for x in p.reshape(16, 16).sum(axis=1))


def _to_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names, images, size = [], [], 0
        for k, text in zip(b.column(0), b.column(1), strict=True):
            names.append("null.png" if k.as_py() is None else f"{k.as_py()}.png")
            images.append(to_png(*payload(text.as_py())))
            size += len(images[-1])
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(images, pa.binary())], names=["name", "bytes"])
                names, images, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(images, pa.binary())], names=["name", "bytes"])


def write_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **options: str) -> None:
    """Stores each row's payload as an image in archives under path."""
    docs.sparkSession.dataSource.register(MemberArchives)
    members = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_to_members, "name string, bytes binary")
    members.write.format("member_archives").mode("append").options(path=path, **options).save()


def read_media(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """archive, name, offset, bytes, error for each image under path."""
    spark.dataSource.register(MemberArchives)
    return spark.read.format("member_archives").options(path=path, **options).load()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for name, image in zip(b.column(0), b.column(1), strict=True):
            png = image.as_py()
            samples, n = from_png(png)
            k = name.as_py().removesuffix(".png")
            rows.append((None if k == "null" else int(k), n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(png), hashlib.sha256(png).hexdigest(), feature(samples)))
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def features(media: DataFrame) -> DataFrame:
    """doc_id, sizes, digests and feature of images that read_media returns."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("name", "bytes").mapInArrow(_digests, schema)


def media_columns(docs: DataFrame) -> DataFrame:
    path = shared_path(docs.sparkSession, "media")
    write_media(docs, path)
    return features(read_media(docs.sparkSession, path))
