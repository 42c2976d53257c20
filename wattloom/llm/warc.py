"""WARC archives with a Zstandard dictionary.

An archive file starts with a skippable frame (magic number 0x184D2A5D) that holds its dictionary, itself compressed;
each record after it is a Zstandard frame of its own, compressed with that dictionary, so a record can be read alone
by its offset and length. The dictionary is built from all records of the archive.

Each task writes the archives of its rows straight into the folder, under names that no other attempt uses; the rows
of the index, written as a table afterwards, say which files count. A lost executor leaves at most a file that no
index row names.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: frame and dictionary magic numbers, the profile of revisits, the block's headers
SKIPPABLE, DICTIONARY = 0x184D2A5D, b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

INDEX = "archive string, offset long, length long, page_id {id}, record_type string"
RECORD = "archive string, page_id {id}, url string, record_type string, refers_to {id}, payload_bytes long, payload_digest string, payload binary"
_PLAIN = re.compile(rb"[\x00-\x20\x7f-\xff]")


def classify(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html", least: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, first, first_url): ``first`` is the page whose response a page revisits.

    Of rows with equal payloads of at least ``least`` bytes, the one with the smallest page_id is the response.
    Rows repeated with that id are responses too. Rows without an id are never referred to; where no row of the group
    has an id, all are responses. A null body is an empty payload.
    """
    payload = F.coalesce(F.col(body), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # counted per page first, so that a payload of many rows is one row a task and page
    ids = rows.where(F.octet_length("payload") >= least).groupBy("digest", "page_id").agg(F.min("url").alias("url"), F.count(F.lit(1)).alias("n"))
    firsts = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.sum("n").alias("n"))
    firsts = firsts.where("n > 1 AND first IS NOT NULL").drop("n")
    out = rows.join(firsts, "digest", "left")
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.withColumns({c: F.when(other, F.col(c)) for c in ("first_url", "first")}).select("page_id", "url", "payload", "digest", "first", "first_url")


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest}')}>"


def _uri(url: str) -> str:
    """A URL on one line: blanks, control and non-ASCII characters as percent codes."""
    return _PLAIN.sub(lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "surrogatepass")).decode("ascii")


def record(row: dict, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit that has only the headers of its block."""
    revisit = row["first"] is not None
    block = HTTP.format(len(row["payload"])).encode()
    if not revisit:
        block += row["payload"]
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(row["page_id"], row["digest"])),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", "sha256:" + row["digest"]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    if row["url"] is not None:
        head.append(("WARC-Target-URI", _uri(row["url"])))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(row["first"], row["digest"])), ("X-Refers-To-Page-ID", quote(str(row["first"])))]
        if row["first_url"] is not None:
            head.append(("WARC-Refers-To-Target-URI", _uri(row["first_url"])))
    if row["page_id"] is not None:
        head.append(("X-Page-ID", quote(str(row["page_id"]))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def _unquoted(value: str | None) -> str | None:
    return None if value is None else unquote(value)


def parse(data: bytes) -> dict:
    """Fields of a record: page_id and refers_to as text, and the payload of responses (null for revisits)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if not revisit and (length != len(payload) or digest != hashlib.sha256(payload).hexdigest()):
        raise ValueError(f"record {fields['WARC-Record-ID']} has another payload than its headers say")
    return {
        "page_id": _unquoted(fields.get("X-Page-ID")), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "refers_to": _unquoted(fields.get("X-Refers-To-Page-ID")), "payload_bytes": length, "payload_digest": digest, "payload": None if revisit else payload,
    }


def dictionary(records: list[bytes], size: int) -> bytes:
    """A dictionary built from the records; empty where they are too few or too small to build one."""
    try:
        return zstandard.train_dictionary(size, records, k=256, d=8).as_bytes() if len(records) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def write_archive(out: BinaryIO, records: list[bytes], size: int = 110_000, level: int = 3) -> list[tuple[int, int]]:
    """Write the records as an archive; offset and length of each record's frame."""
    words = dictionary(records, size)
    at = 0
    if words:
        frame = zstandard.ZstdCompressor(level=19).compress(words)
        at = out.write(struct.pack("<II", SKIPPABLE, len(frame)) + frame)
    z = zstandard.ZstdCompressor(level=level, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    places = []
    for r in records:
        frame = z.compress(r)
        out.write(frame)
        places.append((at, len(frame)))
        at += len(frame)
    return places


def _decompressor(source: BinaryIO) -> tuple[zstandard.ZstdDecompressor, int]:
    """With the archive's dictionary, and where the first record starts."""
    head = source.read(8)
    if len(head) == 8:
        magic, length = struct.unpack("<II", head)
        if magic == SKIPPABLE:
            words = source.read(length)
            if not words.startswith(DICTIONARY):
                words = zstandard.ZstdDecompressor().decompress(words)
            return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)), 8 + length
    return zstandard.ZstdDecompressor(), 0


def read_archive(source: BinaryIO, chunk: int = 8192) -> Iterator[bytes]:
    """All records of an archive in order; needs no index and holds one record at a time."""
    z, start = _decompressor(source)
    source.seek(start)
    rest = source.read(chunk)
    while rest:
        frame, parts = z.decompressobj(), []
        while not frame.eof:
            if not rest:
                raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else source.read(chunk)
        yield b"".join(parts)
        rest = rest or source.read(chunk)


def read_record(source: BinaryIO, offset: int, length: int) -> bytes:
    """One record by its place."""
    z, _ = _decompressor(source)
    source.seek(offset)
    return z.decompressobj().decompress(source.read(length))


def write_archives(rows: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = 32 << 20, level: int = 3) -> DataFrame:
    """Write classified pages as archives of about ``archive_bytes`` uncompressed bytes; the index of all records.

    The index is written below the folder too and is what ``open_index`` reads. An archive is held in memory while it
    is written: ``archive_bytes`` and the record that exceeds them. No row, no archive.
    """
    id_type = rows.schema["page_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        schema = None

        def archive(kept: list[tuple]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
                places = write_archive(out, [r for _, _, r in kept], level=level)
            columns = [[name] * len(kept), *zip(*places), [i for i, _, _ in kept], [t for _, t, _ in kept]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        kept, held = [], 0
        for batch in batches:
            if schema is None:
                schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", batch.schema.field("page_id").type), ("record_type", pa.string())])
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                data = record(row, date)
                kept.append((row["page_id"], "response" if row["first"] is None else "revisit", data))
                held += len(data)
                if held >= archive_bytes:
                    yield archive(kept)
                    kept, held = [], 0
        if kept:
            yield archive(kept)

    index = rows.mapInArrow(write, INDEX.format(id=id_type))
    index.write.option("compression", "zstd").parquet(f"{path}/index")
    return open_index(rows.sparkSession, path, id_type)


def open_index(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    return spark.read.schema(INDEX.format(id=id_type)).parquet(f"{path}/index")


def read_archives(index: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives that the index names, read from the files from end to end.

    The ids that the headers hold are cast back to the index's type. A payload that differs from its digest is an
    error. Without ``payloads`` the column is null.
    """
    id_type = index.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        schema = pa.schema([
            ("archive", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
        ])
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with fs.open_input_file(f"{folder}/{name}") as f:
                    kept, held = [], 0
                    for data in read_archive(io.BufferedReader(f)):
                        row = {"archive": name} | parse(data)
                        if not payloads:
                            row["payload"] = None
                        kept.append(row)
                        held += len(data)
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(kept, schema=schema)
                            kept, held = [], 0
                    if kept:
                        yield pa.RecordBatch.from_pylist(kept, schema=schema)

    # a task an archive: names are small, and tasks sized by bytes would read all archives in one
    names = index.select("archive").distinct()
    records = names.repartition(max(1, names.count())).mapInArrow(read, RECORD.format(id="string"))
    return records.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
