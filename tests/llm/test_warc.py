import hashlib
import io
import struct

import pytest
import zstandard

from nearfold.llm.warc import DICTIONARY_MAGIC, WarcError, archive_pages, frames, parse, read_archives, record, train_dictionary, write_archives
from nearfold.scratch import new_path

LONG = "<html>" + "ab cd " * 300


def test_round_trip_with_revisits(spark):
    rows = [(1, "http://a/", LONG), (2, "http://b/\n x", LONG), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "é", "é" * 5000), (None, "n", LONG), (2, "again", LONG)]
    pages = spark.createDataFrame([(*r, 9, "clash") for r in rows], "page_id bigint, url string, html string, n int, digest string")
    archives = archive_pages(pages, archive_bytes=500)
    got = read_archives(archives).collect()
    assert len(got) == len(rows) and not any(r.error for r in got)
    by = {(r.page_id, r.url): r for r in got}
    assert by[2, "http://b/%0A%20x"].record_type == by[2, "again"].record_type == "response"
    one = by[1, "http://a/"]
    assert (one.record_type, one.refers_to, one.payload, one.payload_bytes) == ("revisit", 2, None, len(LONG))
    assert by[None, "n"].record_type == "revisit" and by[None, "n"].refers_to == 2
    assert by[3, None].payload == b"" and by[5, "u"].record_type == by[6, "u"].record_type == "response"
    assert bytes(by[7, "é"].payload).decode() == "é" * 5000
    for r in got:
        if r.payload is not None:
            assert r.payload_digest == hashlib.sha1(r.payload).hexdigest()


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert read_archives(archive_pages(pages)).count() == 0


def test_dictionary_in_the_leading_frame():
    samples = [record("response", str(i), (LONG + str(i)).encode(), "http://x/", "0", None, "2000") for i in range(300)]
    raw = train_dictionary(samples, 8192)
    assert raw and train_dictionary(samples[:3], 8192) is None
    writer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    body = b"".join(map(writer.compress, samples))
    for inner in (raw, zstandard.ZstdCompressor().compress(raw)):  # plain and compressed dictionaries
        data = struct.pack("<II", DICTIONARY_MAGIC, len(inner)) + inner + body
        assert list(frames(io.BytesIO(data), 777)) == samples
    with pytest.raises(WarcError, match="no dictionary"):
        list(frames(io.BytesIO(struct.pack("<II", DICTIONARY_MAGIC, 4) + b"abcd")))
    with pytest.raises(WarcError, match="cut off"):
        list(frames(io.BytesIO(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw + body[:-3])))
    with pytest.raises(WarcError):
        list(frames(io.BytesIO(body)))  # the dictionary is missing


GOOD = record("response", "1", b"hello", "http://x/", hashlib.sha1(b"hello").hexdigest(), None, "2000")


@pytest.mark.parametrize(
    "bad",
    [b"", b"HTTP/1.1\r\n\r\n", GOOD[:-1], GOOD + b"x", GOOD.replace(b"hello", b"hullo"), GOOD.replace(b"WARC-Date", b"WARC-Dote"), GOOD.replace(b"WARC-Type: response", b"WARC-Type: nothing"), GOOD.replace(b"WARC-Type: response", b"WARC-Type response")],
)
def test_validation(bad):
    assert parse(GOOD)["payload"] == b"hello"
    with pytest.raises(WarcError):
        parse(bad)


def test_bad_records_are_reported(spark):
    path = new_path(spark, "bad").removeprefix("file://")
    import os

    os.makedirs(path)
    with open(f"{path}/a.warc.zst", "wb") as f:
        f.write(zstandard.ZstdCompressor().compress(GOOD) + zstandard.ZstdCompressor().compress(GOOD[:-2]) + b"junk")
    archives = spark.createDataFrame([(f"file://{path}/a.warc.zst",)], "path string")
    got = read_archives(archives, strict=False).collect()
    assert [r.page_id for r in got] == [1, None, None] and got[1].error and got[2].error
    with pytest.raises(Exception, match="Content-Length"):
        read_archives(archives).collect()
    assert write_archives
