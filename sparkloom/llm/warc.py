"""WARC archives compressed with Zstandard: one frame for each record, the dictionary in a leading skippable frame.

Spark's text writer puts the archives down, so task commits, retries and any store that Spark reaches work as for
other tables. Its line separator is an empty skippable frame, which every Zstandard reader passes over.
The reader needs no such separators: it walks frames by their headers.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sparkloom.llm.common import maybe_in, slices, store

# Fixed values of the Zstandard and WARC formats.
FRAME, DICTIONARY_FRAME = 0xFD2FB528, 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = "P*M\x18\0\0\0\0"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FLUSH_BYTES = 8 << 20
HEAVY = 1000  # a payload that makes up a thousandth of the rows is heavy, so there are at most a thousand of them
HELD_PAYLOADS = 200_000

FIELDS = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("position", T.LongType()), T.StructField("record_type", T.StringType()),
    T.StructField("record_id", T.StringType()), T.StructField("target_uri", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("problem", T.StringType()), T.StructField("payload", T.BinaryType()),
])


class ArchiveError(ValueError):
    """What is wrong with a frame or a record."""


def with_referred(rows: DataFrame, total: int, held: int = HELD_PAYLOADS) -> DataFrame:
    """Adds ``refers``: for ``total`` rows (id, digest, ...) the largest id of their digest where that is another one, else null.

    Digests of several rows are counted first. Heavy ones are broadcast, and so are the others up to ``held``; beyond, only rows
    whose digest may be among them are spread by digest, the heavy ones among them by their id too.
    """
    groups = rows.groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("members"))
    several = store(groups.where("members > 1"), "equal-payloads")
    refers = F.when(F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers")
    if several.limit(held + 1).count() <= held:
        return rows.join(F.broadcast(several.drop("members")), "digest", "left").select(*rows.columns, refers)
    heavy = several.where(F.col("members") * HEAVY > total).select("digest", F.col("keeper").alias("heavy_keeper"))
    light = several.where(F.col("members") * HEAVY <= total).select(F.col("digest").alias("light_digest"), "keeper")
    marked = rows.join(F.broadcast(heavy), "digest", "left")
    may = maybe_in(light.select("light_digest"))(F.col("digest")) & F.col("heavy_keeper").isNull()
    alone = marked.where(~may).withColumn("keeper", F.col("heavy_keeper"))
    met = marked.where(may).join(light, F.col("digest") == F.col("light_digest"), "left")
    return alone.select(*rows.columns, refers).unionAll(met.select(*rows.columns, refers))


def uri(value: str | None) -> str:
    """A value that fits one header line: control characters and blanks as percent codes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def record_bytes(record_id: str, url: str | None, payload: bytes, digest: bytes, refers_to: str | None, date: str) -> bytes:
    """One record; a revisit holds the HTTP head alone, which still states the payload's length."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri(url)}",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}"]
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_uri(c: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))


def page_of(c: Column) -> Column:
    """The id in a ``page_uri``; null where there is none."""
    return F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def train_dictionary(payloads: DataFrame, total: int, sample: int, size: int) -> bytes:
    """A dictionary of about ``size`` bytes from some ``sample`` payloads, chosen by the hashes of their ids, 16 KB of each.

    It changes the archives' size only. Empty where the payloads are too few or too short to train on.
    """
    import zstandard

    some = payloads.where(F.pmod(F.xxhash64("id"), F.lit(max(1, total // sample))) == 0)
    samples = [bytes(r[0]) for r in some.select(F.substring("payload", 1, 16 << 10)).limit(2 * sample).collect()]
    try:
        return zstandard.train_dictionary(size, [s for s in samples if s]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   date: str = "1970-01-01T00:00:00Z", level: int = 3, sample: int = 400, dictionary_bytes: int = 64 << 10,
                   held: int = HELD_PAYLOADS) -> None:
    """Write one record for each row to ``path``, one archive for each task; an empty table gives no record.

    A null payload is empty, and empty payloads are equal like any others. Of the rows with one payload (by SHA-1) those with the
    largest id are responses, the others revisits that refer to it; a null id counts as the smallest. Repeated rows with one id and payload are
    of the same type. Control characters and blanks of a url become percent codes. Long payloads stay whole; other columns are not read.
    """
    import zstandard

    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    total = pages.count()
    shared = spark.sparkContext.broadcast(train_dictionary(rows, total, sample, dictionary_bytes) if total else b"")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = shared.value
        compressor = zstandard.ZstdCompressor(
            level=level, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        frames, held_bytes = [], 0
        if trained:
            packed = zstandard.ZstdCompressor(level=19).compress(trained)
            frames = [DICTIONARY_FRAME.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed]
        any_row = False
        for batch in slices(batches, 64):
            for own, url, body, digest, refers in zip(*(batch.column(i) for i in range(5)), strict=True):
                any_row = True
                made = record_bytes(own.as_py(), url.as_py(), body.as_py(), digest.as_py(), refers.as_py(), date)
                frames.append(compressor.compress(made))
                held_bytes += len(frames[-1])
                if held_bytes >= FLUSH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(frames, type=pa.binary())], names=["frame"])
                    frames, held_bytes = [], 0
        if any_row and frames:
            yield pa.RecordBatch.from_arrays([pa.array(frames, type=pa.binary())], names=["frame"])

    found = with_referred(rows, total, held)
    refers_to = F.when(F.col("refers").isNotNull(), page_uri(F.col("refers")))
    frames = found.select(page_uri(F.col("id")), "url", "payload", "digest", refers_to).mapInArrow(compress, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).text(path)


def frame_end(data: bytes, at: int) -> int:
    """Where the frame that begins at ``at`` ends, by its header and the headers of its blocks."""
    if len(data) < at + 8:
        raise ArchiveError("cut frame")
    magic = int.from_bytes(data[at:at + 4], "little")
    if magic in SKIPPABLE:
        end = at + 8 + int.from_bytes(data[at + 4:at + 8], "little")
    elif magic == FRAME:
        kind = data[at + 4]
        single = kind >> 5 & 1
        end = at + 6 - single + (0, 1, 2, 4)[kind & 3] + (single, 2, 4, 8)[kind >> 6]
        last = False
        while not last:
            if end + 3 > len(data):
                raise ArchiveError("cut frame")
            block = int.from_bytes(data[end:end + 3], "little")
            last = bool(block & 1)
            end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        end += 4 * (kind >> 2 & 1)
    else:
        raise ArchiveError("no frame")
    if end > len(data):
        raise ArchiveError("cut frame")
    return end


def archive_dictionary(data: bytes) -> bytes | None:
    """The dictionary of an archive, which may be compressed itself; None if its first frame is a record."""
    import zstandard

    if int.from_bytes(data[:4], "little") != DICTIONARY_FRAME:
        return None
    held = data[8:frame_end(data, 0)]
    return zstandard.ZstdDecompressor().decompressobj().decompress(held) if int.from_bytes(held[:4], "little") == FRAME else held


def archive_frames(data: bytes) -> Iterator[tuple[int, bytes | None]]:
    """(offset, frame) of the records; after something that is no frame, (offset, None) and on from the next frame's mark."""
    at = 0
    while at < len(data):
        try:
            end = frame_end(data, at)
            if int.from_bytes(data[at:at + 4], "little") == FRAME:
                yield at, data[at:end]
        except ArchiveError:
            yield at, None
            end = data.find(FRAME.to_bytes(4, "little"), at + 1)
            end = len(data) if end < 0 else end
        at = end


def header_fields(lines: list[bytes]) -> dict[str, str]:
    fields, last = {}, None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:
            fields[last] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ArchiveError("bad header line")
        last = name.strip().lower().decode("utf-8", "replace")
        fields[last] = value.decode("utf-8", "replace").strip()
    return fields


def length_of(text: str) -> int:
    if not text.isascii() or not text.isdigit():
        raise ArchiveError("bad length")
    return int(text)


def read_record(data: bytes) -> dict:
    """The fields of one record whose headers, lengths and payload digest hold; else ``ArchiveError``."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise ArchiveError("no WARC header")
    fields = header_fields(lines[1:])
    missing = [name for name in REQUIRED if name not in fields]
    if missing:
        raise ArchiveError(f"no {missing[0]}")
    length = length_of(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError("wrong content-length")
    payload = block = rest[:length]
    size, kind = len(block), fields["warc-type"].lower()
    if fields.get("content-type", "").startswith("application/http"):
        http, found, payload = block.partition(b"\r\n\r\n")
        if not found or not http.startswith(b"HTTP/"):
            raise ArchiveError("no HTTP header")
        size = len(payload)
        stated = header_fields(http.split(b"\r\n")[1:]).get("content-length")
        if stated is not None and kind == "revisit":
            size = length_of(stated)
        elif stated is not None and length_of(stated) != size:
            raise ArchiveError("wrong payload length")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        if "warc-refers-to" not in fields or not digest:
            raise ArchiveError("revisit of nothing")
    else:
        made = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest and digest != made:
            raise ArchiveError("wrong payload digest")
        digest = made
    return {"record_type": kind, "record_id": fields["warc-record-id"], "target_uri": fields.get("warc-target-uri"), "date": fields["warc-date"],
            "payload_digest": digest, "refers_to": fields.get("warc-refers-to"), "payload_bytes": size,
            "payload": None if kind == "revisit" else payload}


def read_archives(spark: SparkSession, path: str, strict: bool = False, with_payload: bool = True) -> DataFrame:
    """One row for each record of the archives under ``path``, with its checked fields.

    A record that fails a check has its archive, offset and ``problem`` and nulls elsewhere; ``strict`` raises instead. What is
    no frame is one such row, and reading goes on at the next frame. An archive without a dictionary frame is read without one, an
    empty file has no rows. A task holds one archive (Spark refuses files over 2 GB) and one record beside it.
    """
    import zstandard

    wanted = [f for f in FIELDS if with_payload or f.name != "payload"]
    schema = T.StructType(wanted)
    arrow = {"payload": pa.binary(), "position": pa.int64(), "payload_bytes": pa.int64()}

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], type=arrow.get(f.name, pa.string())) for f in wanted],
                                          names=schema.names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            archive, data = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            trained = archive_dictionary(data)
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
            rows, held = [], 0
            for at, frame in archive_frames(data):
                row = {"archive": archive, "position": at}
                try:
                    if frame is None:
                        raise ArchiveError("no frame")
                    try:
                        plain = reader.decompressobj().decompress(frame)
                    except zstandard.ZstdError as error:
                        raise ArchiveError(f"broken frame: {error}") from error
                    row |= read_record(plain)
                    held += len(plain)
                except ArchiveError as error:
                    if strict:
                        raise ArchiveError(f"{archive}, offset {at}, partition {TaskContext.get().partitionId()}: {error}") from error
                    row["problem"] = str(error)
                rows.append(row)
                if held >= FLUSH_BYTES or len(rows) >= 4096:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, schema)


def archive_sql() -> str:
    """What a round trip of ``pages`` gives, as DuckDB SQL."""
    return """
        with hashed as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as hash from pages),
             ranked as (select *, max(page_id) over (partition by hash) as keeper from hashed)
        select page_id, cast(octet_length(encode(payload)) as bigint) as payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   cast(1 + ((cast('0x' || substr(hash, cast(1 + 5 * (i // 4) as int), 5) as bigint) >> cast(15 - 5 * (i % 4) as int)) & 31) as int), 1)),
                   '') as payload_digest,
               case when page_id = keeper then 'response' else 'revisit' end as record_type,
               case when page_id = keeper then null else keeper end as refers_to
        from ranked"""
