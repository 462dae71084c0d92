import struct

import pytest
import zstandard

from clickspark.llm import warc
from clickspark.llm.queries import ORACLES, op1_warc
from clickspark.llm.storage import new_path, read_blobs
from tests.compare import compare, duck
from tests.conftest import SF_SMALL

ROWS = [(1, "http://a/1", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://a/\r\nX: y", "ünï"), (4, "u", None), (5, "u", ""),
        (None, "u", "<p>same</p>"), (None, "u", "lonely"), (7, "u", "x" * 300_000), (7, "u", "x" * 300_000)]
SCHEMA = "page_id long, url string, html string, payload string, id int"


def pages(spark):
    return spark.createDataFrame([(*r, "clash", 0) for r in ROWS], SCHEMA)


def test_whole_table_equals_sql(spark):
    ok, n, detail = compare(spark, duck(SF_SMALL), "op1", op1_warc, ORACLES["op1_warc"], SF_SMALL)
    assert ok and n, detail


def test_round_trip_nulls_repeats_and_odd_headers(spark):
    path = new_path(spark, "warc")
    warc.write_archives(pages(spark), path, archive_bytes=1000)
    got = warc.read_archives(spark, path).collect()
    assert all(r.problem is None for r in got) and len(got) == len(ROWS)
    kinds = sorted((r.record_id, r.record_type, r.refers_to, r.payload_bytes, bytes(r.payload).decode()[:10]) for r in got)
    same = "<p>same</p"
    assert kinds == sorted([
        ("urn:page:1", "revisit", "urn:page:2", 11, ""), ("urn:page:2", "response", None, 11, same),
        ("urn:page:3", "response", None, 5, "ünï"), ("urn:page:4", "revisit", "urn:page:5", 0, ""),
        ("urn:page:5", "response", None, 0, ""), ("urn:page:none", "revisit", "urn:page:2", 11, ""),
        ("urn:page:none", "response", None, 6, "lonely"), ("urn:page:7", "response", None, 300000, "x" * 10),
        ("urn:page:7", "response", None, 300000, "x" * 10)])
    assert {r.target_uri for r in got} == {"http://a/1", None, "http://a/%0D%0AX: y", "u"}
    assert {r.payload_digest for r in got if r.record_id == "urn:page:1"} == {warc.digest(b"<p>same</p>")}


def test_small_payloads_are_never_revisited(spark):
    path = new_path(spark, "warc")
    warc.write_archives(pages(spark), path, least_bytes=12)
    assert {r.record_type for r in warc.read_archives(spark, path).collect()} == {"response"}
    empty = new_path(spark, "warc")
    warc.write_archives(pages(spark).limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_archive_starts_with_its_dictionary_and_has_a_frame_per_record(spark):
    path = new_path(spark, "warc")
    warc.write_archives(spark.read.parquet(f"{SF_SMALL}/pages.parquet").coalesce(1), path)
    content = max((bytes(r.content) for r in read_blobs(spark, path).collect()), key=len)
    trained, at = warc.load_dictionary(content)
    assert struct.unpack("<I", content[:4])[0] == 0x184D2A5D and trained is not None and content.endswith(warc.END)
    frames = 0
    while at < len(content) - len(warc.END):
        end = warc.frame_end(content, at)
        record = zstandard.ZstdDecompressor(dict_data=trained).decompress(content[at:end])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        frames, at = frames + 1, end
    assert frames == len(list(warc.parse_archive(content)))


def problems(data):
    return [r["problem"] for r in warc.parse_archive(data) if r["problem"]]


def test_broken_archives_are_reported():
    good = [warc.build_record(f"urn:page:{i}", "u", b"payload %d" % i, None, "2024-01-01T00:00:00Z") for i in range(3)]
    data = warc.build_archive(good) + warc.END
    assert problems(data) == [] and len(list(warc.parse_archive(data))) == 3
    assert problems(data[:-1]) and problems(data[:-9]) and problems(data[5:]) and problems(b"junk")
    assert "the archive has no end mark" in problems(data[:-8])
    one = lambda record: problems(warc.build_archive([record]) + warc.END)
    assert one(good[0].replace(b"payload 0", b"payload 00")) and one(good[0].replace(b"payload 0", b"payload 1"))
    assert one(good[0].replace(b"WARC-Date", b"WARC-Day")) and one(b"WARC/9.9\r\n\r\n") and one(good[0] + good[1])
    assert one(good[0].replace(b"WARC-Type: ", b"WARC-Type ")) and one(b"")
    flipped = bytearray(data)
    flipped[len(data) // 2] ^= 255
    assert problems(bytes(flipped))


@pytest.mark.parametrize("compressed", [True, False])
def test_dictionary_frame_forms(compressed):
    import random

    rng = random.Random(1)
    records = [warc.build_record(f"urn:page:{i}", "u", " ".join(rng.choices("alpha beta gamma delta epsilon".split(), k=300)).encode(), None, "2024-01-01T00:00:00Z") for i in range(80)]
    trained = zstandard.train_dictionary(4096, records)
    content = zstandard.ZstdCompressor().compress(trained.as_bytes()) if compressed else trained.as_bytes()
    frames = map(zstandard.ZstdCompressor(dict_data=trained).compress, records)
    data = struct.pack("<II", warc.DICTIONARY_MAGIC, len(content)) + content + b"".join(frames) + warc.END
    assert len(list(warc.parse_archive(data))) == 80 and problems(data) == []
