"""WARC archives under Zstandard: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm.common import attach, sliced, table
from nearfold.scratch import new_path, written

DICTIONARY_MAGIC, FRAME_MAGIC, DICT_MAGIC = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A frame, header or length that isn't as it must be."""


def _file(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))


def train_dictionary(samples: list[bytes], size: int) -> bytes | None:
    """A dictionary for such records; None where there is too little to learn one from."""
    if len(samples) < 16 or sum(map(len, samples)) < 8 * size:
        return None
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return None


def record(kind: str, page: str, payload: bytes, url: str | None, digest: str, refers_to: str | None, date: str) -> bytes:
    """The bytes of one record. A revisit has the HTTP header alone, which tells the length of the payload it leaves out."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    head.append(f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Header fields, block and payload of a record, after its form, lengths and digests were validated."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise WarcError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"header line {line[:60]!r}")
        fields[name] = value.strip()
    if missing := [x for x in NEEDED if x not in fields]:
        raise WarcError(f"no {', '.join(missing)}")
    if not fields["Content-Length"].isdigit():
        raise WarcError("Content-Length isn't a number")
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {n}, the block and its end have {len(rest)} bytes")
    block = rest[:n]
    if (want := fields.get("WARC-Block-Digest")) and want != "sha1:" + hashlib.sha1(block).hexdigest():
        raise WarcError("the block has another digest")
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        raise WarcError(f"WARC-Type {kind[:40]}")
    http, found, payload = block.partition(b"\r\n\r\n")
    lengths = [x[15:].strip() for x in http.split(b"\r\n") if x[:15].lower() == b"content-length:"]
    if not found or len(lengths) != 1 or not lengths[0].isdigit():
        raise WarcError("the HTTP header tells no length")
    if kind == "response" and len(payload) != int(lengths[0]):
        raise WarcError(f"the payload has {len(payload)} bytes, not {int(lengths[0])}")
    if kind == "revisit" and (payload or "WARC-Refers-To" not in fields):
        raise WarcError("a revisit with a payload or without WARC-Refers-To")
    digest = fields.get("WARC-Payload-Digest", "")
    if not digest.startswith("sha1:") or kind == "response" and digest[5:] != hashlib.sha1(payload).hexdigest():
        raise WarcError("the payload has another digest")
    return {"fields": fields, "kind": kind, "payload": payload if kind == "response" else None, "bytes": int(lengths[0]), "digest": digest[5:]}


def frames(stream: io.RawIOBase, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The contents of an archive's frames, one by one, in bounded memory."""
    have = stream.read(chunk)
    dictionary = None
    if len(have) >= 8 and struct.unpack("<I", have[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", have[4:8])[0]
        while len(have) < 8 + size and (more := stream.read(chunk)):
            have += more
        if len(have) < 8 + size:
            raise WarcError("the dictionary's frame is cut off")
        raw, have = have[8 : 8 + size], have[8 + size :]
        magic = struct.unpack("<I", raw[:4])[0] if size >= 4 else 0
        if magic == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        elif magic != DICT_MAGIC:
            raise WarcError("the leading frame holds no dictionary")
        dictionary = zstandard.ZstdCompressionDict(raw)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while have or (have := stream.read(chunk)):
        one, out = reader.decompressobj(), []
        while True:
            try:
                out.append(one.decompress(have))
            except zstandard.ZstdError as e:
                raise WarcError(f"frame: {e}") from e
            if one.eof:
                have = one.unused_data
                break
            if not (have := stream.read(chunk)):
                raise WarcError("a frame is cut off")
        yield b"".join(out)


class _Archive:
    """One growing archive; it appears under its name when it is complete."""

    def __init__(self, folder: str, samples: list[bytes], dict_bytes: int):
        self.fs, where = _file(folder)
        self.name = f"{uuid.uuid4().hex}.warc.zst"  # another name for each attempt of a task
        self.fs.create_dir(where, recursive=True)
        self.at, self.out, self.n, self.size = f"{where}/{self.name}", self.fs.open_output_stream(f"{where}/{self.name}.part", compression=None), 0, 0
        self.uri = f"{folder}/{self.name}"
        raw = train_dictionary(samples, dict_bytes)
        if raw:
            packed = zstandard.ZstdCompressor(level=9).compress(raw)
            self._put(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
            self.writer = zstandard.ZstdCompressor(level=3, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(raw))
        else:
            self.writer = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.writer.compress(data))
        self.n += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        self.fs.move(self.at + ".part", self.at)
        return self.uri, self.n, self.size


def write_archives(
    records: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", dict_bytes: int = 32_768, sample_bytes: int = 1 << 20, archive_bytes: int = 1 << 26
) -> DataFrame:
    """Writes records (page, url, payload, digest, record_type, refers_to) and returns (path, records, bytes) of each archive.

    Each task writes archives of at most about archive_bytes. Each trains its own dictionary on its first records, up
    to sample_bytes (a documented bound), and holds it in a compressed leading skippable frame. The list names the files of
    tasks that succeeded only; files of lost attempts are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive: _Archive | None = None
        held: list[bytes] = []
        done: list[tuple[str, int, int]] = []

        def begin() -> None:
            nonlocal archive
            archive = _Archive(folder, held, dict_bytes)
            for x in held:
                archive.add(x)
            held.clear()

        for part in sliced(batches, "payload"):
            for r in part.to_pylist():
                x = record(r["record_type"], str(r["page"]), r["payload"], r["url"], r["digest"], str(r["refers_to"]), date)
                if archive is None:
                    held.append(x)
                    if sum(map(len, held)) >= sample_bytes:
                        begin()
                else:
                    archive.add(x)
                    if archive.size >= archive_bytes:
                        done.append(archive.close())
                        archive = None
        if held:
            begin()
        if archive is not None:
            done.append(archive.close())
        if done:
            yield pa.record_batch([pa.array(x) for x in zip(*done)], ["path", "records", "bytes"])

    columns = ("page", "url", "payload", "digest", "record_type", "refers_to")
    return written(records.select(*columns).mapInArrow(run, "path string, records bigint, bytes bigint"), "archives")


def _number(name: str | None) -> int | None:
    x = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(x) if x.lstrip("-").isdigit() else None


def read_archives(archives: DataFrame, with_payload: bool = True, strict: bool = True) -> DataFrame:
    """Every record of the archives at `path`: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, error.

    A record that fails validation raises; with strict=False it gives a row that has only path and error, and a frame
    that can't be decoded ends its archive so. Payloads of revisits are null: the record it refers to has them.
    """
    schema = "path string, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, error string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def rows(path: str) -> Iterator[tuple]:
        system, where = _file(path)
        with system.open_input_stream(where, compression=None) as stream:
            try:
                for data in frames(stream):
                    try:
                        x = parse(data)
                    except (WarcError, UnicodeDecodeError) as e:
                        if strict:
                            raise WarcError(f"{path}: {e}") from e
                        yield (path, None, None, None, None, None, None, None, str(e))
                        continue
                    f = x["fields"]
                    yield (
                        path, _number(f["WARC-Record-ID"]), f.get("WARC-Target-URI"), x["kind"], _number(f.get("WARC-Refers-To")),
                        x["bytes"], x["digest"], x["payload"] if with_payload else None, None,
                    )
            except WarcError as e:
                if strict:
                    raise
                yield (path, None, None, None, None, None, None, None, str(e))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += 200 + len(row[7] or b"")
                    if size > 4_000_000:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                        held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    n = max(1, min(archives.count(), 20_000))
    return archives.select("path").repartition(n).mapInArrow(run, schema)


def archive_pages(pages: DataFrame, folder: str | None = None, revisit_bytes: int = 1000, **options) -> DataFrame:
    """Writes a record per page and returns the list of archives.

    Of pages with equal payloads of at least revisit_bytes, the one with the largest page_id is the response and the others
    revisit it; rows that repeat that id are responses too, and a page without an id revisits unless none has one. Null html
    is an empty payload. Other columns are ignored.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    mine = pages.select(
        F.col("page_id").cast("bigint").alias("page"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    large = mine.filter(F.octet_length("payload") >= revisit_bytes)
    groups = written(large.groupBy("digest").agg(F.max("page").alias("first"), F.count("*").alias("n")).filter("n > 1"), "payloads")
    placed = attach(mine, groups, ["digest"], "n")
    again = F.col("n").isNotNull() & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page"))
    records = placed.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first")))
    return write_archives(records, folder, **options)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `pages` through archives and back."""
    back = read_archives(archive_pages(table(spark, sf_dir, "pages")), with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     g AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
