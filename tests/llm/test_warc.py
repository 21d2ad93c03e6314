import base64
import hashlib
import uuid
from pathlib import Path

import pyarrow as pa
import pytest
import zstandard

from sparkloom.llm import warc
from tests.llm.conftest import LONG

SCHEMA = "page_id long, url string, html string, id int, digest string, payload string"


def pages(spark, rows, parts=2):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    return df.repartition(parts, "page_id") if parts > 1 else df


def round_trip(spark, df, tmp_path, **options):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    warc.write_archives(df, path, **options)
    return path, warc.read_archives(spark, path, strict=True).collect()


ROWS = [(1, "http://a.net/x", "<p>one</p>"), (2, "http://a.net/y", "<p>one</p>"), (3, None, None), (4, "http://b.net/", ""), (5, "u r\r\nl: ä", "ä" * 9),
        (6, "http://c.net/", LONG), (7, "http://c.net/2", "<p>one</p>"), (7, "http://c.net/2", "<p>one</p>"), (None, "http://d.net", "<p>one</p>"),
        (None, None, "alone"), (8, "http://e.net", "\r\n\r\nP*M\x18\0\0\0\0")]


def plain(rows):
    best = {}
    for i, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if i is None else i)
    out = []
    for i, _, html in rows:
        data, keeper = (html or "").encode(), best[html or ""]
        refers = None if keeper in (-1, i) else keeper
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers,
                    data if refers is None else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("held", [1000, 1])
def test_round_trip(spark, tmp_path, held, monkeypatch):
    monkeypatch.setattr(warc, "HEAVY", 3)  # the payload of five rows is heavy
    _, got = round_trip(spark, pages(spark, ROWS), tmp_path, held=held)
    ids = [warc.re.fullmatch("<urn:page:(.*)>", r["record_id"])[1] for r in got]
    refers = [r["refers_to"] and int(r["refers_to"][10:-1]) for r in got]
    found = [(int(i) if i else None, r["payload_bytes"], r["payload_digest"], r["record_type"], f, r["payload"] and bytes(r["payload"]))
             for i, r, f in zip(ids, got, refers, strict=True)]
    found = [(*f[:5], b"" if f[3] == "response" and f[5] is None else f[5]) for f in found]
    assert sorted(found, key=repr) == plain(ROWS)
    assert {r["target_uri"] for r in got} == {"http://a.net/x", "http://a.net/y", "", "http://b.net/", "u%20r%0D%0Al:%20ä", "http://c.net/",
                                              "http://c.net/2", "http://d.net", "http://e.net"}
    assert all(r["problem"] is None for r in got)


def test_many_equal_payloads_without_a_broadcast_of_all(spark, tmp_path):
    rows = [(i, "u", "hot" if i % 3 == 0 else f"body {i // 2}") for i in range(600)]
    _, got = round_trip(spark, pages(spark, rows, 4), tmp_path, held=5)
    found = sorted((int(r["record_id"][10:-1]), r["record_type"], r["refers_to"] and int(r["refers_to"][10:-1])) for r in got)
    assert found == sorted((i, kind, refers) for i, _, _, kind, refers, _ in plain(rows))


def test_archives_are_plain_zstandard_with_a_dictionary(spark, tmp_path):
    rows = [(i, f"http://a.net/{i}", f"<html><head><title>Page {i}</title></head><body>" + f"<p>Word {i * i} of page {i}.</p>" * 30) for i in range(600)]
    path, got = round_trip(spark, pages(spark, rows, 2), tmp_path)
    assert len(got) == 600
    files = [p.read_bytes() for p in Path(path).glob("part-*") if p.stat().st_size]
    assert files
    for data in files:
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
        trained = warc.archive_dictionary(data)
        own = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
        with own.stream_reader(data, read_across_frames=True) as stream:  # the library passes over the skippable frames
            assert stream.read().startswith(b"WARC/1.1\r\n")
        with pytest.raises(zstandard.ZstdError):
            zstandard.ZstdDecompressor().decompressobj().decompress(next(f for _, f in warc.archive_frames(data)))


def test_no_rows(spark, tmp_path):
    path, got = round_trip(spark, spark.createDataFrame([], SCHEMA), tmp_path)
    assert got == []


def archive(*records, dictionary=None, **options):
    trained = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    made = zstandard.ZstdCompressor(dict_data=trained, **options)
    lead = (warc.DICTIONARY_FRAME.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary) if dictionary else b""
    return lead + b"".join(made.compress(r) for r in records)


def resource(body=b"body", **changes):
    fields = {"WARC-Type": "resource", "WARC-Record-ID": "<urn:x:1>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Length": str(len(body))} | changes
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode() + b"\r\n" + body + b"\r\n\r\n"


def test_foreign_archives_and_problems(spark, tmp_path):
    response = b"HTTP/1.1 200 OK\r\ncontent-length: 4\r\n\r\nbody"
    http = {"WARC-Type": "response", "Content-Type": "application/http"}
    cases = [
        (resource(), None), (resource(body=b""), None), (resource(response, **http), None),
        (resource(response[:-1], **http), "wrong payload length"), (resource(b"junk", **http), "no HTTP header"),
        (resource(**{"WARC-Date": None}), "no warc-date"), (resource(**{"Content-Length": "3"}), "wrong content-length"),
        (resource(**{"Content-Length": "-4"}), "bad length"), (resource() + resource(), "wrong content-length"), (b"text", "no WARC header"),
        (resource(**{"WARC-Payload-Digest": "sha1:AAAA"}), "wrong payload digest"), (resource(**{"WARC-Type": "revisit"}), "revisit of nothing"),
        (resource(**{"X-Long": "a\r\n b"}), None),
    ]
    folder = tmp_path / "foreign"
    folder.mkdir()
    (folder / "plain.warc.zst").write_bytes(archive(*(c for c, _ in cases), write_checksum=True))
    (folder / "raw.warc.zst").write_bytes(archive(*(c for c, _ in cases), dictionary=resource(response, **http) * 3, write_content_size=False))
    (folder / "empty.warc.zst").write_bytes(b"")
    got = warc.read_archives(spark, str(folder)).orderBy("archive", "position").collect()
    assert [r["problem"] for r in got] == [p for _, p in cases] * 2
    assert [r["payload_bytes"] for r in got[:3]] == [4, 0, 4] and bytes(got[2]["payload"]) == b"body"
    assert "payload" not in warc.read_archives(spark, str(folder), with_payload=False).columns
    with pytest.raises(Exception, match="wrong payload length"):
        warc.read_archives(spark, str(folder), strict=True).collect()


def test_reading_goes_on_after_broken_bytes(spark, tmp_path):
    good = archive(resource(b"x" * 1000))
    broken = bytearray(archive(resource(b"y" * 1000), write_checksum=True))
    broken[-1] ^= 255
    folder = tmp_path / "broken"
    folder.mkdir()
    (folder / "a").write_bytes(good + b"some other bytes" + bytes(broken) + good + good[:-3])
    got = warc.read_archives(spark, str(folder)).orderBy("position").collect()
    assert [(r["problem"] or "")[:12] for r in got] == ["", "no frame", "broken frame", "", "no frame"]


def test_frame_ends(spark):
    for level in (1, 19):
        for size in (0, 1, 255, 256, 70_000, 3_000_000):
            for data in (b"a" * size, bytes(pa.array(range(size // 8 + 1), type=pa.int64()).buffers()[1])[:size]):
                for options in ({}, {"write_checksum": True}, {"write_content_size": False}):
                    frame = zstandard.ZstdCompressor(level=level, **options).compress(data)
                    assert warc.frame_end(frame + b"tail of eight", 0) == len(frame)
