"""op1 and op4: round trips, retries of single members, odd tables."""

import hashlib
import zipfile
import zlib
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from quillspark.llm import archive, media, warc
from quillspark.llm import queries as Q
from quillspark.llm.common import shared_path

from ..conftest import SF
from .conftest import data


def _payload(text):
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % 64 if raw else 64), len(raw)


def _check(got, pairs):
    want = sorted(((k, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for k, t in pairs for p, n in [_payload(t)]), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=str) == want


def test_odd_documents_come_back(odd):
    got = media.media_columns(odd).collect()
    _check(got, data())
    by_text = {}
    for r in got:
        by_text.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by_text.values())


def test_no_documents(empty):
    assert media.media_columns(empty).collect() == []


def test_query_over_documents(spark):
    _check(Q.op1_media_columns(spark, SF).collect(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def test_png_is_lossless_and_checked():
    samples = bytes(range(256)) * 2
    png = media.to_png(samples, 500)
    assert media.from_png(png) == (samples, 500)
    with pytest.raises(ValueError, match="damaged"):
        media.from_png(png[:60] + bytes([png[60] ^ 1]) + png[61:])


def test_ranges_cover_each_member_once(spark, odd):
    path = shared_path(spark, "ranges")
    media.write_media(odd, path, shardbytes="20000")
    whole = sorted((r.name, r.offset, r.archive) for r in media.read_media(spark, path).collect())
    small = media.read_media(spark, path, rangebytes="777", batchbytes="100")
    assert sorted((r.name, r.offset, r.archive) for r in small.collect()) == whole
    assert len(whole) == len(data())


def _reader(tmp_path, fails):
    (tmp_path / "a.zip").write_bytes(archive.in_memory([("one", b"1" * 100), ("two", b"2" * 100), ("three", b"3" * 100)]))
    opened = []

    class Flaky(archive.MemberReader):
        def open(self, path):
            opened.append(path)
            f = super().open(path)
            if len(opened) - 2 in fails:  # the first opening reads the directory
                class Broken:
                    closed = False
                    __enter__ = lambda self: self
                    __exit__ = lambda self, *_: None

                    def seek(self, *_):
                        raise OSError("gone")

                    seekable = tell = read = seek
                return Broken()
            return f

    return Flaky, opened


def test_a_member_is_read_again_on_its_own(tmp_path):
    flaky, opened = _reader(tmp_path, {0, 1})
    r = flaky({"path": str(tmp_path)})
    got = [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]
    assert [(x["name"], len(x["bytes"])) for x in got] == [("one", 100), ("two", 100), ("three", 100)]
    assert len(opened) == 4  # directory, two failures, one that stays open


def test_a_damaged_member_fails_alone(tmp_path):
    flaky, _ = _reader(tmp_path, set())
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    raw[raw.index(b"2" * 100) + 5] ^= 1
    (tmp_path / "a.zip").write_bytes(raw)
    r = flaky({"path": str(tmp_path), "onerror": "report", "tries": "2"})
    got = {x["name"]: (x["bytes"] is None, x["error"]) for p in r.partitions() for b in r.read(p) for x in b.to_pylist()}
    assert got == {"one": (False, None), "two": (True, "check failed"), "three": (False, None)}
    strict = flaky({"path": str(tmp_path), "tries": "2"})
    with pytest.raises(OSError, match="two"):
        [x for p in strict.partitions() for x in strict.read(p)]


def test_archives_are_plain_zip_files(spark, odd):
    path = shared_path(spark, "zip")
    media.write_media(odd, path)
    names = [n for p, _ in archive.listing(path, ".zip") for n in zipfile.ZipFile(p).namelist()]
    assert len(names) == len(data()) and urlparse(path).scheme == "file"


PAGES = "page_id long, url string, html string, record_id string, digest string, response string"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES)


def _expected(rows):
    out = []
    for k, _, html in rows:
        p = (html or "").encode()
        same = [i for i, _, h in rows if (h or "").encode() == p]
        ids = [i for i in same if i is not None]
        top = max(ids) if ids else None
        again = len(p) >= 1000 and top is not None and k != top
        out.append((k, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


ODD_PAGES = [
    (5, "http://a.example/x?y=é z", "<p>" + "lang" * 400), (9, None, "<p>" + "lang" * 400), (7, "http://b.example", "<p>" + "lang" * 400), (1, "u", None), (2, "u\r\nv", ""), (3, "", "short"), (4, "", "short"),
    (None, "n", "<p>" + "lang" * 400), (11, "http://c.example/", "ü" * 500), (10, "http://c.example/", "ü" * 500), (12, "big", "z\r\n\r\n" * 300_000), (-4, "neg", "ü" * 500), (6, "edge", "e" * 999), (8, "edge", "e" * 999),
]


def _rows(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def _query(spark, tmp_path, pages):
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    return Q.op4_warc(spark, str(tmp_path))


def test_odd_pages_come_back(spark, tmp_path):
    assert _rows(_query(spark, tmp_path, _pages(spark, ODD_PAGES))) == _expected(ODD_PAGES)


def test_no_pages(spark, tmp_path):
    assert _rows(_query(spark, tmp_path, _pages(spark, []))) == []


def test_repeated_pages_are_captures_of_their_own(spark, tmp_path):
    rows = [(1, "u", "a" * 2000), (1, "u", "a" * 2000), (0, "v", "a" * 2000)]
    got = _rows(_query(spark, tmp_path, _pages(spark, rows)))
    assert [(x[0], x[3], x[4]) for x in got] == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]


def test_transactions_are_nested(spark):
    path = shared_path(spark, "nested")
    warc.write_warc(_pages(spark, ODD_PAGES[:4]), path, shardbytes="500")
    rows = warc.transactions(warc.read_warc(spark, path)).collect()
    assert len(rows) == 4
    for r in rows:
        assert r.request.http.startswith(b"GET /") and b"payloadSha1Hex: " + r.response.payload_digest.encode() in r.metadata.fields
        assert r.response.type == "revisit" or hashlib.sha1(r.response.payload).hexdigest() == r.response.payload_digest


def test_ids_are_in_record_ids(spark):
    ids = [0, 5, -1, -(1 << 63), (1 << 63) - 1, None]
    rows = [(warc.record_id("response", k, "u", b"p"),) for k in ids]
    assert [r[0] for r in spark.createDataFrame(rows, "r string").select(warc.page_number(F.col("r"))).collect()] == ids
    assert len({warc.record_id("response", 1, u, p) for u in (None, "", "-", "u") for p in (b"", b"p")}) == 8


def test_pages_of_one_id_keep_their_own_records(spark, tmp_path):
    rows = [(1, "u", "a" * 2000), (1, "u", "b" * 2000), (1, "w", "b" * 2000), (1, None, ""), (0, "x", "b" * 2000), (None, "n", "c"), (None, "n", "d")]
    pages = _pages(spark, rows)
    assert _rows(_query(spark, tmp_path, pages)) == _expected(rows)
    got = warc.captures(pages).collect()
    assert len({r.record_id for r in got}) == len(rows)
    for r in got:
        assert f"payloadSha1Hex: {r.response.payload_digest}".encode() in r.metadata.fields and r.request.uri == r.metadata.uri == r.response.uri
        assert r.response.type == "revisit" or hashlib.sha1(r.response.payload).hexdigest() == r.response.payload_digest
    refers = {r.response.refers_to for r in got if r.response.type == "revisit"}
    assert refers == {warc.record_id("response", 1, "w", b"b" * 2000)} <= {r.record_id for r in got}


def test_only_files_of_a_list_are_read(spark, tmp_path):
    uri = f"file://{tmp_path}/m"
    parts = [archive.ZipShards(uri, ".zip", 100) for _ in range(3)]
    for k, p in enumerate(parts):
        for j in range(3):
            p.stream().zip.writestr(zipfile.ZipInfo(f"{k}-{j}"), b"x" * 90)
        p.close()
    archive.commit(uri, [archive.Written(parts[0].files), None, archive.Written(parts[1].files)])  # the third attempt was lost
    names = lambda: {r.name for r in media.read_media(spark, uri).collect()}
    assert names() == {f"{k}-{j}" for k in range(2) for j in range(3)}
    archive.commit(uri, [archive.Written(parts[2].files)])
    assert len(names()) == 9 and len(archive.listing(uri, ".zip")) == sum(len(p.files) for p in parts)


def test_tasks_have_ranges_of_large_archives_and_several_small_ones():
    got = archive.planned([("a", 10), ("b", 25), ("c", 3), ("d", 3)], 10)
    assert [p.parts for p in got] == [[("a", 0, 10)], [("b", 0, 10)], [("b", 10, 20)], [("b", 20, 25), ("c", 0, 3)], [("d", 0, 3)]]
    assert [p.parts for p in archive.planned([("a", 25), ("b", 3)], 10, split=False)] == [[("a", 0, 25)], [("b", 0, 3)]]
    assert [p.parts for p in archive.planned([], 10)] == [[]]


def test_a_directory_is_read_again(tmp_path):
    flaky, opened = _reader(tmp_path, {-1})
    r = flaky({"path": str(tmp_path)})
    assert len([x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]) == 3 and len(opened) == 3


def test_a_cut_archive_is_an_error():
    import gzip
    import io

    raw = gzip.compress(warc.record("metadata", "<urn:uuid:1>", [], b"x" * 1000))
    assert len(list(warc.records(io.BytesIO(raw * 3)))) == 3
    with pytest.raises(OSError):
        list(warc.records(io.BytesIO(raw * 2 + raw[:20])))


def test_the_query_puts_transactions_together(spark):
    df = Q.op4_warc(spark, "/root/testdata/sf0.001")
    assert all(r.n_records == 3 and r.metadata_digest == r.payload_digest for r in df.collect())
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2


def test_transactions_of_incomplete_records(spark):
    schema = "record_id string, type string, uri string, concurrent_to string, refers_to string, payload_bytes long, payload_digest string, http binary, payload binary"
    rows = [("a", "response", "u", None, None, 1, "d", None, b"x"), ("r", "request", "u", "a", None, None, None, b"GET 2", None), ("s", "request", "u", "a", None, None, None, b"GET 1", None), ("b", "revisit", "u", None, "a", 1, "d", None, None), ("m", "metadata", "u", "gone", None, None, None, None, b"f")]
    got = {r.record_id: r for r in warc.transactions(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"a", "b"} and got["a"].request.http == b"GET 1" and got["a"].metadata is None and got["b"].request is None and got["b"].response.refers_to == "a"
